import hashlib
import random
import re
import zlib
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from variscope.llm import conversations as C


def cheapest(symbols):
    """(cost, audit, edits) by trying every edit, least cost first and then least audit."""

    @cache
    def best(i, s, inserted):
        options = [(0, "", "")] if i == len(symbols) and s in (0, 3) else []
        if inserted < 2:
            to = (2, 2, 3, 2)[s]
            c, a, e = best(i, to, inserted + 1)
            options.append((c + 3, "I" + a, ("u" if to == 2 else "a") + e))
        if i < len(symbols):
            x = symbols[i]
            c, a, e = best(i + 1, s, 0)
            options.append((c + 4, "D" + a, "D" + e))
            if x < 8:
                more = 3 if x >= 4 else 0
                kept = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}.get((s, x % 4))
                if kept is not None:
                    c, a, e = best(i + 1, kept, 0)
                    options.append((c + more, "K" + a, "K" + e))
                to = (2, 2, 3, 2)[s]
                c, a, e = best(i + 1, to, 0)
                options.append((c + more + 3, "R" + a, ("U" if to == 2 else "A") + e))
        return min(options) if options else (10**9, "", "")

    for i in range(len(symbols), -1, -1):  # from the end, so that no call goes deep
        for s in range(4):
            best(i, s, 0)
    return best(0, 0, 0)


def plain(rows):
    """The report by plain loops."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            how = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if how == 0:
                continue
            text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
            role = "user" if how == 4 else role
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            mine += [((turn is not None, turn or 0, role, digest), role, text)] * (2 if how == 3 else 1)
        mine.sort(key=lambda r: r[0])
        seen, symbols, n, initials = set(), [], [0, 0, 0], []
        for _, role, text in mine:
            body = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                n[fault] += 1
            who = "sua".find(role[:1]) if role else 3
            who = 3 if who < 0 else who
            initials.append(who)
            symbols.append(8 if fault in (0, 1) else who + 4 if fault == 2 else who)
        turns = {r[0][1] for r in mine if r[0][0]}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit, edits = cheapest(tuple(symbols))
        lines, i = [], 0
        for e in edits:
            if e in "ua":
                lines.append("user:" if e == "u" else "assistant:")
            else:
                _, role, text = mine[i]
                i += 1
                if e != "D":
                    lines.append({"K": role, "U": "user", "A": "assistant"}[e] + ":" + text)
        illegal = sum(p not in {(0, 1), (1, 2), (2, 1)} for p in zip(initials, initials[1:], strict=False))
        out[conv] = (gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def report(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r["conv_id"]: tuple(r[n] for n in names) for r in C.repair_conversations(df)[0].collect()}


def frame(spark, rows, parts=4):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumns({c: F.lit("kept") for c in ("id", "code", "part", "run", "codes", "digest", "edits", "pos")}).repartition(parts)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    texts = ["Yes.", "No!", "Well", "What? ", "", " \n", "Tab.\t", "a\x0b", "Ünï…", "Same again.", "Long " * 300 + "."]
    made = [(c, t, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), rng.choice(texts) if rng.random() < 0.5 else f"Text {c} {t}.")
            for c in range(60) for t in range(rng.randrange(1, 14)) if rng.random() < 0.9]
    odd = [(None, 0, "user", "Null."), (None, None, None, None), (None, 1, "assistant", "Yes."), (100, None, "user", "A."), (100, None, "assistant", "B."), (100, None, "assistant", "B."),
           (101, 5, None, "x"), (102, 3, "user", None), (103, -4, "system", "S."), (103, 9, "user", "U."), (104, 2, "assistant", "C" * 200_000)]
    dropped = [(200 + i, t, "user", "Gone.") for i in range(40) for t in range(3) if zlib.crc32(f"{200 + i}:{t}".encode()) % 20 == 0]
    return made + odd + dropped


def test_equals_plain_loops(spark, rows):
    got, want = report(frame(spark, rows)), plain(rows)
    assert got == want
    assert any(v == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for v in want.values())


def test_one_long_conversation_over_many_partitions(spark):
    """A conversation with most of the rows: its runs are chained, with the result of one run."""
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "user", "assistant", "system", "x"]), f"Say {t % 700}" + rng.choice([".", "", "?"])) for t in range(1500)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}.") for c in (6, 8) for t in range(150)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = C.repair_conversations(frame(spark, rows))
        noted = C.runs(C.faults(C.damage(frame(spark, rows))))
        assert noted.where("conv_id = 7").count() >= 3
        table = {r["conv_id"]: r for r in got[0].collect()}
        bodies = got[1].where("conv_id = 7").orderBy("part", "pos").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = plain(rows)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {c: tuple(r[n] for n in names) for c, r in table.items()} == want
    assert hashlib.sha256("\n".join(r["body"] for r in bodies).encode()).hexdigest() == want[7][-1]


def test_long_texts_are_hashed_in_pieces(spark):
    rows = [(1, 0, "x" * 150_000), (1, 1, "end"), (2, 0, ""), (2, 1, ""), (3, 0, "y" * 9_000_000), (3, 1, "z"), (4, 0, "w")]
    df = spark.createDataFrame([(c, 0, p, b) for c, p, b in rows], "conv_id long, part int, pos int, body string")
    got = {r["conv_id"]: r["sha256"] for r in C.digests(df).collect()}
    assert got == {c: hashlib.sha256("\n".join(b for d, _, b in rows if d == c).encode()).hexdigest() for c in (1, 2, 3, 4)}


def test_blocks_equal_single_steps():
    """Tables for blocks of any length, borders and traces agree with the exhaustive search."""
    rng = random.Random(2)
    for size in (1, 2, 3, 4):
        t = C.tables(size)
        for _ in range(400):
            symbols = [rng.randrange(9) for _ in range(rng.randrange(1, 12))]
            edits, state = t.trace(np.array(symbols, np.uint8), t.ends[4], C.START)
            tail = {C.USER: "a", C.SYSTEM: "ua"}.get(state, "")
            assert "".join(edits) + tail == cheapest(tuple(symbols))[2]


def test_empty_table(spark):
    assert C.repair_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))[0].count() == 0
