"""Conditions of blocks: plain form, literal groups, and blocks of which nothing is known."""

import itertools
import re

from pyspark.sql import functions as F

from variscope.functions import lines as L
from variscope.operators import blocks as B, coverage as V

SUPPORTED = [
    "!(A)", "(A) || (B)", "((A))", "!!A", "!(!(A))", "!(A || B)", "!(A && B)", "(A || B) && !C", "C && !(A || B)", "((A) && (B))", "1", "0", "A || 1", "A && 1",
    "A && 0", "!0", "(A) && ((B) || (C))", "! A", "!(A && B) || C", "A.. && !B.",
]
UNSUPPORTED = ["(A && B) || C", "!(A || B) || (A && C)", "FOO(A)", "A > 2", "A B", "(A", "!(A || B) || C"]


def test_groups_mean_the_same(spark):
    df = spark.createDataFrame([(e,) for e in SUPPORTED + UNSUPPORTED], "expr string")
    got = {r["expr"]: r["g"] for r in df.select("expr", L.literal_groups(F.col("expr")).alias("g")).collect()}
    assert {e for e in got if got[e] is None} == set(UNSUPPORTED)
    for e in SUPPORTED:
        names = sorted(set(re.findall(r"[A-Z][.]*", e)))
        code = e.replace("&&", " and ").replace("||", " or ").replace("!", " not ")
        for values in itertools.product([False, True], repeat=len(names)):
            on = dict(zip(names, values, strict=True))
            plain = code
            for n in sorted(names, key=len, reverse=True):
                plain = re.sub(rf"\b{re.escape(n)}(?![\w.])", str(on[n]), plain)
            want = bool(eval(plain))  # noqa: S307
            assert all(any(on[x["symbol"]] == x["positive"] for x in g) for g in got[e]) == want, (e, on)


def test_common_conditions_are_active(spark, source):
    lines = source("#if !defined(X)\na\n#endif", "#if defined(A) || defined(B)\na\n#endif", "#if 1\na\n#endif\n#if 0\nb\n#endif", "#if (A && B) || C\n#ifdef A\n#endif\n#endif\n#ifdef A\n#endif")
    tree = B.structure(lines)
    blocks = B.block_tree(tree)
    builds = spark.createDataFrame([(i, 1) for i in range(4)], "file_id long, config_id long")
    config = spark.createDataFrame([(1, "A", True)], "config_id long, var string, val boolean")
    on = {(r["file_id"], r["block_no"]) for r in V.enabled_blocks(blocks, builds, config).collect()}
    assert {(0, 0), (1, 0), (2, 0), (3, 2)} <= on and not on & {(2, 1), (3, 0), (3, 1)}
    unknown = V.undecided_blocks(blocks)
    assert {(r["file_id"], r["block_no"]) for r in unknown.collect()} == {(3, 0), (3, 1)}
    valid = spark.createDataFrame([(1, True)], "config_id long, valid boolean")
    dead = V.observed_dead(V.decided(blocks, unknown), builds, V.enabled_blocks(blocks, builds, config), valid).filter("state = 'never'")
    assert {(r["file_id"], r["block_no"]) for r in dead.collect()} == {(2, 1)}


def test_conditions_are_worked_out_once(spark):
    df = spark.createDataFrame([("A || B",)], "expr string")
    for made in (L.literal_groups(F.col("expr")), L.plain_condition(F.col("expr"))):
        plan = df.select(made.alias("g"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("expr#") < 8 and len(plan) < 50_000


def test_supported_conditions(spark):
    rows = SUPPORTED + UNSUPPORTED + ["", None]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, expr string")
    got = {r["i"]: r["plain"] for r in L.supported_conditions(df).collect()}
    assert set(got) == {i for i, e in enumerate(rows) if e is not None and e not in UNSUPPORTED}
    assert got[rows.index("")] == "" and got[rows.index("!(A || B)")] == "!A&&!B"
