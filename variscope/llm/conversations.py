"""Repair of the structure of conversations by Four-Russians block tables.

A repair keeps, reroles or deletes every row and inserts rows, so that the roles read ``(s?(ua)+)?`` at the least
cost. What a row is worth to the repair is one of nine symbols, and the cost to go before a row is a vector over four
states. Up to a constant there are a few dozen such vectors, so the way a block of ``BLOCK`` symbols changes
them is one table, worked out beforehand. Conversations are run through from the end, a lookup for each block;
then each block is expanded backward from the vector at its right border into those of its rows, and the edits
are read off forward, the first letter that is still cheapest each time: this gives the
least text among the cheapest edits, which a trace from the end would not.

Rows are sorted over range partitions, so a long conversation lies in several of them. Its run in a partition
is summed up by what it makes of the four states (costs, then moves); these few rows, one
for each partition, are chained for each conversation, and give every run its start state and its right border.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from variscope.llm.common import WORD
from variscope.session import cut

#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Symbols of a block that one lookup works off.
BLOCK = 4
#: Bytes of a piece of repaired text, and of pieces that a task holds for one conversation.
PIECE, HELD = 1 << 16, 4 << 20

START, SYSTEM, USER, ASSISTANT = range(4)
#: Costs that stand for no way at all.
NEVER = 1 << 28
#: Symbols: 0 to 3 a whole row of role s, u, a or another, 4 to 7 a truncated one, 8 one that must go.
SYMBOLS = 9
_END = (0, NEVER, NEVER, 0)
#: The state after an inserted or reroled row, and after a kept row of role s, u or a.
_FORCED = (USER, USER, ASSISTANT, USER)
_KEPT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
RUNS = "conv_id {kind}, part int, run int, open boolean, codes binary, ids array<bigint>"


def _closed(v: list[int]) -> list[int]:
    """Cost vector when rows may be inserted first."""
    for _ in range(3):
        v = [min(c, NEVER, INSERT + v[_FORCED[s]]) for s, c in enumerate(v)]
    return v


def _choices(after: tuple[int, ...], symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost to the end, next state) of the edits of one row, without insertions."""
    found = [("D", DELETE + after[state], state)]
    if symbol < 8:
        extra = TRUNCATED if symbol >= 4 else 0
        if (state, symbol % 4) in _KEPT:
            to = _KEPT[state, symbol % 4]
            found.append(("K", extra + after[to], to))
        to = _FORCED[state]
        found.append(("U" if to == USER else "A", extra + REROLE + after[to], to))
    return found


def _step(after: tuple[int, ...], symbol: int) -> list[int]:
    return _closed([min(c for _, c, _ in _choices(after, symbol, s)) for s in range(4)])


def _normal(v: list[int]) -> tuple[tuple[int, ...], int]:
    low = min(v)
    return tuple(min(c - low, NEVER) if c < NEVER // 2 else NEVER for c in v), low


class Tables:
    """Normalised cost vectors and what symbols and blocks make of them.

    ``vectors`` lists them; ``ends`` are the numbers of the vectors for ending in each state and, last, of the end of
    a conversation. ``one[v, x]`` and ``block[v, b]`` are the vector before a symbol or block, ``one_cost`` and
    ``block_cost`` what to add. ``act[v][x][s]`` are the edits of a row in front of ``v``: letters and next state.
    """

    def __init__(self, size: int = BLOCK) -> None:
        self.size, self.vectors, self.number = size, [], {}
        self.ends = [self._known(_normal(_closed(list(v)))[0]) for v in (*(tuple(0 if i == s else NEVER for i in range(4)) for s in range(4)), _END)]
        one, cost = [], []
        for v in self.vectors:  # grows while new vectors turn up
            steps = [_normal(_step(v, x)) for x in range(SYMBOLS)]
            one.append([self._known(w) for w, _ in steps])
            cost.append([low for _, low in steps])
        self.one, self.one_cost = np.array(one, np.int32), np.array(cost, np.int64)
        self.block, self.block_cost = self.one, self.one_cost
        for _ in range(size - 1):  # a symbol in front of what is known
            at, base = self.block, self.block_cost
            self.block = self.one[at].transpose(0, 2, 1).reshape(len(at), -1)
            self.block_cost = (base[:, :, None] + self.one_cost[at]).transpose(0, 2, 1).reshape(len(at), -1)
        self.act = [[[self._edits(v, x, s) for s in range(4)] for x in range(SYMBOLS)] for v in self.vectors]

    def _known(self, v: tuple[int, ...]) -> int:
        if v not in self.number:
            self.number[v] = len(self.vectors)
            self.vectors.append(v)
        return self.number[v]

    def _edits(self, after: tuple[int, ...], symbol: int, state: int) -> tuple[str, int]:
        """Inserted rows (u, a) and the row's own edit (K, U, A or D), the least audit among the cheapest."""
        here, done = _step(after, symbol), ""
        if here[state] >= NEVER // 2:
            return "", -1
        while True:
            best = {audit_letter(e): (e, to) for e, c, to in _choices(after, symbol, state) if c == here[state]}
            if "D" in best:
                return done + "D", best["D"][1]
            if INSERT + here[_FORCED[state]] != here[state]:
                edit, to = best["K"] if "K" in best else best["R"]
                return done + edit, to
            state = _FORCED[state]
            done += "u" if state == USER else "a"

    def blocks(self, symbols: np.ndarray) -> np.ndarray:
        """Number of each whole block, from the left."""
        whole = symbols[: len(symbols) // self.size * self.size].reshape(-1, self.size)
        return whole.astype(np.int64) @ (SYMBOLS ** np.arange(self.size - 1, -1, -1, dtype=np.int64))

    def borders(self, symbols: np.ndarray, end: int) -> tuple[list[int], int]:
        """Vector at the left border of every block (the part block on the right included), and what to add to the first."""
        rest, total = symbols[len(symbols) // self.size * self.size :], 0
        at, found = end, [end]
        for x in rest[::-1]:
            total += int(self.one_cost[at, x])
            at = int(self.one[at, x])
        if len(rest):
            found.append(at)
        for b in self.blocks(symbols)[::-1].tolist():
            total += int(self.block_cost[at, b])
            at = int(self.block[at, b])
            found.append(at)
        return found[::-1], total

    def trace(self, symbols: np.ndarray, end: int, state: int) -> tuple[list[str], int]:
        """Edits of every row from ``state`` on, and the state after the last."""
        found, out = self.borders(symbols, end)[0], []
        for k, right in enumerate(found[1:]):
            part = symbols[k * self.size : (k + 1) * self.size].tolist()
            inner = [right]
            for x in part[:0:-1]:
                inner.append(int(self.one[inner[-1], x]))
            for x, after in zip(part, inner[::-1], strict=True):
                edits, state = self.act[after][x][state]
                out.append(edits)
        return out, state


@lru_cache(maxsize=4)
def tables(size: int = BLOCK) -> Tables:
    return Tables(size)


def audit_letter(edits: str) -> str:
    return edits.translate(str.maketrans("uaUA", "IIRR"))


def _cost(edits: str, truncated: bool) -> int:
    spent = {"u": INSERT, "a": INSERT, "D": DELETE, "K": 0, "U": REROLE, "A": REROLE}
    return sum(spent[e] for e in edits) + (TRUNCATED if truncated and edits[-1] != "D" else 0)


def _symbols(codes: bytes) -> np.ndarray:
    return np.minimum(np.frombuffer(codes, np.uint8), 8)


def damage(rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(id, conv_id, turn, role, text): rows damaged by crc32 of ``conv_id:turn`` modulo 20, nulls read as a space.

    0 drops a row, 1 empties its text, 2 removes ``.!?``, 3 repeats it, 4 sets the role user. ``conv_id`` and
    ``turn`` keep their nulls. ``id`` tells rows apart.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.pmod(F.crc32(F.concat(blank(conv_id), F.lit(":"), blank(turn)).cast("binary")), F.lit(20))
    body = F.when(F.col("_how") == 1, "").when(F.col("_how") == 2, F.translate("_text", ".!?", "")).otherwise(F.col("_text"))
    named = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), blank(role).alias("_role"), blank(text).alias("_text"), how.alias("_how")).where("_how <> 0")
    copies = F.explode(F.when(F.col("_how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return named.select("conv_id", "turn", F.when(F.col("_how") == 4, "user").otherwise(F.col("_role")).alias("role"), body.alias("text"), copies.alias("_copy")).drop("_copy").withColumn(
        "id", F.monotonically_increasing_id())


def faults(rows: DataFrame) -> DataFrame:
    """(id, conv_id, turn, role, digest, code) of damaged rows, without their texts.

    ``code`` is the role's initial (0 s, 1 u, 2 a, 3 another), plus 4 for truncated, 8 for blank, 12 for duplicate rows: the first of
    blank, duplicate, truncated that holds. Within a turn, rows are ordered by role and digest.
    """
    text = F.col("text")
    initial = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for x in ("s", 0, "u", 1, "a", 2)]), F.substring("role", 1, 1)), F.lit(3))
    whole = text.rlike(r"[.!?][\x20\x09-\x0D]*\z")
    noted = rows.select(
        "id", "conv_id", "turn", "role", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), text), 256)).alias("digest"),
        initial.alias("initial"), (~text.rlike(WORD)).alias("blank"), (~whole).alias("truncated"))
    firsts = noted.groupBy(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest")).agg(F.min(F.struct("turn", "id")).alias("f"), F.count("*").alias("n")).where("n > 1")
    met = noted.join(firsts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest")), "left")
    later = F.coalesce(F.col("f.id") != F.col("id"), F.lit(False))
    fault = F.when(F.col("blank"), 8).when(later, 12).when(F.col("truncated"), 4).otherwise(0)
    return met.select("id", "conv_id", "turn", "role", "digest", (F.col("initial") + fault).alias("code"))


def runs(noted: DataFrame) -> DataFrame:
    """(conv_id, part, run, open, codes, ids): the rows of a conversation in a partition of all rows in order.

    A run is open if it is the first or last of its partition: the conversation may go on beyond. Others are whole.
    """
    order = ["conv_id", "turn", "role", "digest", "id"]
    kind = noted.schema["conv_id"].dataType.simpleString()
    ordered = noted.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "id", F.col("code").cast("tinyint"))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, conv, codes, ids = TaskContext.get().partitionId(), 0, None, bytearray(), []

        def row(is_open: bool) -> tuple:
            return conv, part, n, is_open, bytes(codes), ids

        def batch(found: list[tuple]) -> pa.RecordBatch:
            kinds = [ordered_type, pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], ["conv_id", "part", "run", "open", "codes", "ids"])

        done: list[tuple] = []
        ordered_type = pa.int64()
        for b in batches:
            ordered_type = b.schema.field(0).type
            for c, i, code in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if ids and c != conv:
                    done.append(row(n == 0))
                    n, codes, ids = n + 1, bytearray(), []
                conv = c
                codes.append(code)
                ids.append(i)
            if len(done) > 1000:
                yield batch(done)
                done = []
        if ids:
            done.append(row(True))
        if done:
            yield batch(done)

    return ordered.mapInArrow(collect, RUNS.format(kind=kind))


def _mapped(df: DataFrame, columns: list[str], schema: str, work) -> DataFrame:
    """Rows of ``schema`` made one by one from the values of ``columns``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            made = [work(*values) for values in zip(*(pdf[c] for c in columns), strict=True)]
            yield pd.DataFrame({f: [m[i] for m in made] for i, f in enumerate(names)})

    names = [f.split()[0] for f in schema.split(", ")]
    return df.select(*columns).mapInPandas(run, schema)


def placed(found: DataFrame) -> DataFrame:
    """(part, run, right, start, before, last) of open runs: what a run needs to know of the rest of its conversation.

    ``right`` is the cost vector at its right border, ``start`` the state before it, ``before`` the initial of
    the row before it (-1 for none), ``last`` whether it ends the conversation.
    """
    opened = cut(found.where("open").drop("ids"))

    def costs(part, run, codes):
        t, symbols, rows = tables(), _symbols(codes), []
        for end in t.ends[:4]:
            borders, total = t.borders(symbols, end)
            rows.append([min(NEVER, c + total) if c < NEVER else NEVER for c in t.vectors[borders[0]]])
        return part, run, [c for row in rows for c in row], codes[0] % 4, codes[-1] % 4

    def backward(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part", ignore_index=True)
        right, after = [], list(_closed(list(_END)))
        for m in reversed(pdf["m"].tolist()):
            right.append(after)
            after = [min(NEVER, *(int(m[e * 4 + s]) + right[-1][e] for e in range(4))) for s in range(4)]
        last = [False] * (len(pdf) - 1) + [True]
        return pd.DataFrame({"part": pdf["part"], "run": pdf["run"], "right": [_normal(v)[0] for v in reversed(right)], "before": [-1, *pdf["tail"][:-1].astype(int)], "last": last})

    def moves(part, run, codes, right):
        t, symbols = tables(), _symbols(codes)
        v = t.number[tuple(int(c) for c in right)]
        return part, run, [t.trace(symbols, v, s)[1] if t.vectors[t.borders(symbols, v)[0][0]][s] < NEVER else -1 for s in range(4)]

    def forward(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, state, starts = pdf.sort_values("part", ignore_index=True), START, []
        for m in pdf["m"]:
            starts.append(state)
            state = int(m[state])
        return pd.DataFrame({"part": pdf["part"], "run": pdf["run"], "start": starts})

    keys = opened.select("conv_id", "part", "run")
    summed = _mapped(opened, ["part", "run", "codes"], "part int, run int, m array<int>, head int, tail int", costs)
    vectors = cut(keys.join(summed, ["part", "run"]).groupBy("conv_id").applyInPandas(backward, "part int, run int, right array<int>, before int, last boolean"))
    moved = _mapped(opened.join(vectors, ["part", "run"]), ["part", "run", "codes", "right"], "part int, run int, m array<int>", moves)
    starts = keys.join(moved, ["part", "run"]).groupBy("conv_id").applyInPandas(forward, "part int, run int, start int")
    return vectors.join(starts, ["part", "run"])


def traced(found: DataFrame) -> DataFrame:
    """(conv_id, part, illegal, cost, audit, ids, edits) of every run; ``edits`` has one element more at the end of a conversation."""
    kind = found.schema["conv_id"].dataType.simpleString()
    rows = found.join(cut(placed(found)), ["part", "run"], "left")
    legal = {(0, 1), (1, 2), (2, 1)}

    def work(conv, part, codes, ids, right, start, before, last):
        t, symbols = tables(), _symbols(codes)
        whole = right is None
        edits, state = t.trace(symbols, t.ends[4] if whole else t.number[tuple(int(c) for c in right)], START if whole else int(start))
        cost = sum(_cost(e, 4 <= x < 8) for e, x in zip(edits, symbols.tolist(), strict=True))
        if whole or last:
            tail = {USER: "a", SYSTEM: "ua"}.get(state, "")
            edits, cost = [*edits, tail], cost + INSERT * len(tail)
        initials = [*([] if whole or before < 0 else [int(before)]), *(c % 4 for c in codes)]
        return conv, part, sum(p not in legal for p in pairwise(initials)), cost, audit_letter("".join(edits)), ids, edits

    schema = f"conv_id {kind}, part int, illegal bigint, cost bigint, audit string, ids array<bigint>, edits array<string>"
    return _mapped_nullable(rows, ["conv_id", "part", "codes", "ids", "right", "start", "before", "last"], schema, work)


def _mapped_nullable(df: DataFrame, columns: list[str], schema: str, work) -> DataFrame:
    """As ``_mapped``, by Arrow, so that nulls and integers stay what they are."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 500):
                made = [work(*values) for values in zip(*(c.to_pylist() for c in b.slice(start, 500).columns), strict=True)]
                kinds = [b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)], names)

    return df.select(*columns).mapInArrow(run, schema)


def repaired(trace: DataFrame, rows: DataFrame) -> DataFrame:
    """(conv_id, part, pos, body): the rows of the repaired conversations as ``role:text``, inserted ones before them."""
    pairs = F.posexplode(F.arrays_zip("ids", "edits"))
    edits = trace.select("conv_id", "part", pairs.alias("pos", "x")).select("conv_id", "part", "pos", F.col("x.ids").alias("_id"), F.col("x.edits").alias("edits")).where("edits not in ('D', '')")
    met = edits.join(rows.select(F.col("id").alias("_row"), "role", "text"), F.col("_id") == F.col("_row"), "left")
    said = lambda who: F.concat(who, F.lit(":"), F.col("text"))
    lines = F.transform(F.split("edits", ""), lambda e: F.when(e == "u", "user:").when(e == "a", "assistant:").when(e == "K", said(F.col("role")))
                        .when(e == "U", said(F.lit("user"))).otherwise(said(F.lit("assistant"))))
    return met.select("conv_id", "part", "pos", F.array_join(lines, "\n").alias("body"))


def digests(bodies: DataFrame) -> DataFrame:
    """(conv_id, sha256) of each conversation's bodies, joined by newlines in order of (part, pos).

    Conversations that lie within a partition are hashed there. Of those at its edges, and of long ones, pieces of
    bounded size go on to a task that hashes a conversation piece by piece, as the digest of a text has to be taken in order.
    """
    kind = bodies.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "part", "pos"]
    ordered = bodies.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", F.col("body").cast("binary"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, conv, n = TaskContext.get().partitionId(), 0, None, -1
        held, size, total, opened = [], 0, 0, True

        def out(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            kinds = [kind, pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "part", "seq", "piece", "sha"])

        def pieces() -> list[tuple]:
            nonlocal seq
            data, made = b"".join(held), []
            for at in range(0, len(data), PIECE):
                made.append((conv, part, seq, data[at : at + PIECE], None))
                seq += 1
            return made

        kind = None
        for b in batches:
            kind, done = b.schema.field(0).type, []
            for c, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if n < 0 or c != conv:
                    if n >= 0:
                        done += pieces() if opened else [(conv, part, 0, None, hashlib.sha256(b"".join(held)[:-1]).digest())]
                    conv, n, held, size, opened = c, n + 1, [], 0, n < 0
                body = body.as_py()
                held += [body, b"\n"]
                size += len(body) + 1
                total += len(body) + 1
                if size >= HELD:
                    opened = True
                    done += pieces()
                    held, size = [], 0
                if total >= HELD and done:
                    yield out(done, kind)
                    done, total = [], 0
            if done:
                yield out(done, kind)
        if n >= 0 and held:
            yield out(pieces(), kind)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, hasher, pending = None, None, b""
        for b in batches:
            done = []
            for c, piece in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if hasher is None or c != conv:
                    if hasher is not None:
                        done.append((conv, hasher.digest()))
                    conv, hasher, pending = c, hashlib.sha256(), b""
                data = pending + piece.as_py()
                hasher.update(data[:-1])
                pending = data[-1:]  # the last newline of a conversation doesn't count
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], b.schema.field(0).type), pa.array([d[1] for d in done], pa.binary())], ["conv_id", "sha"])
        if hasher is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], b.schema.field(0).type), pa.array([hasher.digest()], pa.binary())], ["conv_id", "sha"])

    made = cut(ordered.mapInArrow(first, f"conv_id {kind}, part bigint, seq bigint, piece binary, sha binary"))
    chained = made.where("sha is null").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").select("conv_id", "piece").mapInArrow(second, f"conv_id {kind}, sha binary")
    return made.where("sha is not null").select("conv_id", "sha").unionByName(chained).select("conv_id", F.lower(F.hex("sha")).alias("sha256"))


def repair_conversations(conversations: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame]:
    """(report, repaired rows) of damaged conversations.

    The report has a row for every conv_id (null is one of its own): gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256; the second table the repaired rows in order. Rows are taken by turn, null turns first; equal turns by
    role, then by digest of role and text. A conversation without rows after the damage has zeros, an empty audit
    and the digest of the empty text. Extra columns are left out.
    """
    rows = cut(damage(conversations, **columns))
    noted = cut(faults(rows))
    trace = cut(traced(cut(runs(noted))))
    bodies = repaired(trace, rows)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def part(df: DataFrame, audit: Column | None = None, sha: Column | None = None, **values: Column) -> DataFrame:
        zero = F.lit(0).cast("long")
        return df.select("conv_id", *[values.get(n, zero).alias(n) for n in names], (F.lit("") if audit is None else audit).alias("audit"), (F.lit(None).cast("string") if sha is None else sha).alias("sha"))

    every = conversations.select(F.col(columns.get("conv_id", "conv_id")).alias("conv_id")).distinct()
    turns = noted.groupBy("conv_id", "turn").count().groupBy("conv_id").agg(F.max("turn").alias("b"), F.min("turn").alias("a"), F.count("turn").alias("n"))
    kinds = noted.groupBy("conv_id").agg(*[F.count_if((F.col("code") >= low) & (F.col("code") < low + 4)).alias(n) for n, low in (("blank", 8), ("duplicate", 12), ("truncated", 4))])
    edits = trace.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.sort_array(F.collect_list(F.struct("part", "audit"))).alias("x"))
    parts = [
        part(every), part(turns, gaps=F.coalesce(F.col("b") - F.col("a") + 1 - F.col("n"), F.lit(0)).cast("long")),
        part(kinds, **{n: F.col(n) for n in ("blank", "duplicate", "truncated")}),
        part(edits, F.array_join(F.col("x.audit"), ""), illegal=F.col("illegal"), cost=F.col("cost")), part(digests(bodies), sha=F.col("sha256")),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    report = whole.groupBy("conv_id").agg(*[F.sum(n).alias(n) for n in names], F.max("audit").alias("audit"), F.coalesce(F.max("sha"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
    return report, bodies
