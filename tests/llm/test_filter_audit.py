import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from variscope.llm import filter_audit as A


def plain(rows, labels):
    """The audit by plain loops over all documents, orders and steps."""
    least = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    docs = []
    for doc_id, text, _, part, _ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                 bool(re.search(r"[#$%&*|]", t)), doc_id is not None and doc_id > least[t]]
        own = [x for x in labels if x[0] == doc_id and doc_id is not None]
        docs.append((part or "", {k for k, f in zip("ABCDE", fails, strict=True) if f}, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    want = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, k in enumerate(order, 1):
                here = [d for d in left if k in d[1]]
                left = [d for d in left if k not in d[1]]
                failing = [d for d in mine if k in d[1]]
                want[part, order, step] = [len(left), len(here), len(failing) - len(here), sum(d[1] == {k} for d in mine), sum(d[2] for d in here), sum(d[3] for d in here)]
        for order, step in {(o, s) for p, o, s in want if p == part}:
            k = order[step - 1]
            want[part, order, step].append(sum(want[part, o, o.index(k) + 1][1] for o in map("".join, permutations("ABCDE"))))
    return want


def found(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in df.collect()}


@pytest.fixture(scope="module")
def many(odd_rows):
    """The odd rows, copies, texts that fail several filters, and one text that a third of the rows have."""
    rows = list(odd_rows) + [(100 + i, prose(220, i), "en", f"s{i % 3}", 0) for i in range(40)] + [(200 + i, prose(230, i // 3) + (" $ A B C" if i % 2 else ""), "en", "s0", 0) for i in range(40)]
    rows += [(300 + i, "All The Same & again", "en", "s1", 0) for i in range(60)] + [(90, "All The Same & again", "en", "a", 0)]
    return rows, [(i, i % 2, int(i % 3 == 0)) for i in range(0, 360, 2)] + [(102, 1, 1), (None, 1, 1), (104, None, None)]


@pytest.mark.parametrize("sent", [A.SENT, 0])
def test_equals_plain_loops(spark, many, sent):
    """Blocks sent to every task, and digests sent to their blocks."""
    rows, labels = many
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit("kept") for c in ("mask", "digest", "first", "part", "block")}).repartition(5)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = found(A.audit(A.mask_counts(docs, known, sent=sent)))
    want = plain(rows, labels)
    assert got == want
    assert any(v[1] for (_, o, s), v in want.items() if o[s - 1] == "E")


def test_unique_texts_are_cleared(spark):
    """Most unique texts never reach the exact stage; no repeated one is lost, though one text is half of all."""
    rows = [(i, prose(6, i)) for i in range(4000)] + [(10_000 + i, "the same") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("a")).repartition(7)
    noted = A.facts(docs).cache()
    bits = {r["block"]: r["bits"] for r in A.sketch(noted, 1).collect()}
    twice = A.np.unpackbits(A.np.frombuffer(bits[0], A.np.uint8))
    digests = [r["digest"] for r in noted.where("doc_id < 4000").collect()]
    passed = twice[A.cells([bytes(d) for d in digests], 1)[1]].all(1).mean()
    assert passed < 0.1
    least = {r["first"] for r in A.smallest_ids(docs, noted).collect()}
    texts = {}
    for i, t in rows:
        texts.setdefault(t, []).append(i)
    assert least == {min(v) for v in texts.values() if len(v) > 1}


def test_empty_tables(spark, none, no_labels):
    assert A.audit(A.mask_counts(none, no_labels)).count() == 0
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    got = found(A.audit(A.mask_counts(one, no_labels)))
    assert len(got) == 600 and got["", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120] and got["", "BACDE", 2] == [0, 1, 0, 1, 0, 0, 120]
