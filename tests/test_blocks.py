"""Block structure: golden values, and segment widths that cut files into pieces."""

import pytest
from pyspark.sql import functions as F

from variscope.functions import lines as L, texts as X
from variscope.operators import blocks as B, constraints as C, symbols as Y

RANGES = """
int a;

int b;

#ifdef A
x
#endif

#if B
y
#elif C
z
#endif

#ifdef D
u
#ifdef E
v
#endif
#endif
"""

REWRITE = """
#define A
#if A
#define B
#undef B
#endif
#ifdef B
#if X
#else
#endif
#endif
"""


def test_ranges(source):
    lines = source("\n" + RANGES.strip("\n"))
    lines = lines.withColumn("txt", F.col("txt"))
    tree = B.structure(lines)
    got = {(r.name, r.start_line, r.end_line) for r in B.block_ranges(B.block_tree(tree), lines.select("file_id").distinct()).collect()}
    assert got == {("B00", 0, 0), ("B0", 5, 7), ("B1", 9, 11), ("B2", 11, 13), ("B3", 15, 20), ("B4", 17, 19)}


def test_constraint_text(source):
    lines = source("""
#define A
#define B
#define B
#if ! A
#endif
#ifdef B
#ifdef X
#define X
#else
#endif
#endif
""")
    tree = B.structure(lines)
    blocks = B.rewrite_symbols(B.block_tree(tree), B.define_versions(lines, tree))
    got = [r.text for r in C.block_constraint(blocks).orderBy("block_no").collect()]
    assert got == ["( B0 <-> ! A. )", "( B1 <-> B.. )", "( B2 <-> B1 && X )", "( B3 <-> B1 && ( ! (B2) ) )"]


@pytest.mark.parametrize("width", [1, 2, 3, 7])
def test_segments_do_not_matter(spark, width):
    from variscope.sources import projections as P

    lines = P.source_line(spark, "/root/testdata/sf0.001").filter("file_id < 200")
    whole, cut = B.structure(lines), B.structure(lines, width)
    assert whole.exceptAll(cut).isEmpty() and cut.exceptAll(whole).isEmpty()
    a, b = B.block_at(lines, whole), B.block_at(lines, whole, width)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    v, w = B.define_versions(lines, whole), B.define_versions(lines, whole, width)
    assert v.exceptAll(w).isEmpty() and w.exceptAll(v).isEmpty()


def test_continuations(source):
    lines = source("a \\\nb \\\nc\nd")
    for width in (1, 100):
        got = {(r.line_no, r.txt) for r in X.join_continuations(lines, width).collect()}
        assert got == {(1, "a b c"), (4, "d")}


def test_inline_enable(source):
    got = [r.txt for r in X.inline_enable(source("if (ENABLE_X) {\n#if ENABLE_Y")).orderBy("line_no").collect()]
    assert got == ["if (", "#if defined CONFIG_X", "1", "#else", "0", "#endif", ") {", "#if ENABLE_Y"]


def test_enable_macros(source):
    got = [r.txt for r in L.normalize_enable_macros(source("#if ENABLE_A && ENABLE_B\n#if defined ENABLE_C\nENABLE_D")).orderBy("line_no").collect()]
    assert got == ["#if defined CONFIG_A && defined CONFIG_B", "#if defined CONFIG_C", "ENABLE_D"]


def test_is_enabled(spark):
    df = spark.createDataFrame([("IS_ENABLED(CONFIG_A) && IS_MODULE(CONFIG_B) && IS_BUILTIN(CONFIG_C)",)], "e string")
    assert df.select(L.normalize_is_enabled(F.col("e"))).first()[0] == (
        "(defined(CONFIG_A) || defined(CONFIG_A_MODULE)) && defined(CONFIG_B_MODULE) && defined(CONFIG_C)"
    )


def test_symbol_stats(spark, source):
    lines = source("#ifdef CONFIG_SMP\n#define HAVE_SMP\n#endif\n#ifdef HAVE_SMP\n#endif\n#ifdef HAVE_SMP\n#endif")
    tree = B.structure(lines)
    rewritten = B.rewrite_symbols(B.block_tree(tree), B.define_versions(lines, tree))
    models = spark.createDataFrame([(0, "x86")], "file_id long, arch string")
    types = spark.createDataFrame([("x86", "CONFIG_SMP", "boolean")], "arch string, symbol string, type string")
    got = {(r.symbol, r.n_refs, r.n_rewrites, r.state, r.detail) for r in Y.symbol_stats(rewritten, models, types).collect()}
    assert got == {("CONFIG_SMP", 1, 0, "PRESENT", "BOOLEAN"), ("HAVE_SMP", 2, 1, "MISSING", "NOT_CONFIG_LIKE")}


def test_include_guard(source):
    lines = source("#ifndef G\n#define G\nx\n#ifdef A\n#endif\n#endif", "#ifndef H\n#define H\n#endif\n#ifdef A\n#endif")
    got = [(r.file_id, r.guard) for r in B.include_guards(lines, B.structure(lines)).collect()]
    assert got == [(0, "G")]


def test_short_files_need_one_shuffle(spark, source, tmp_path):
    source("#ifdef A\n#define X\n#endif", "#if B\n#else\n#endif").write.parquet(str(tmp_path / "lines"))
    lines = spark.read.parquet(str(tmp_path / "lines"))
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    tree = B.structure(lines)
    assert shuffles(tree) == 1
    kept = str(tmp_path / "tree")
    tree.write.parquet(kept)
    tree = spark.read.parquet(kept)
    assert shuffles(B.define_versions(lines, tree)) == 1
    assert shuffles(B.chain_position(B.block_tree(tree))) == 1


def test_one_long_file_among_short_ones(spark, tmp_path):
    """Only the long file's rows carry over; positions that are null or negative count as well."""
    from variscope.plans.scan import Run, scan

    rows = [(f, n, 1) for f in range(5) for n in range(3)] + [(9, n, 1) for n in range(40)] + [(10, -3, 1), (10, 2, 1)]
    df = spark.createDataFrame(rows, "f long, n long, v long")
    runs = [Run("s", "sum", F.col("v")), Run("p", "lag", F.col("n")), Run("q", "lead", F.col("n")), Run("b", "before", F.col("n"))]
    ordered = lambda out: sorted(map(tuple, out.select("f", "n", "s", "p", "q", "b").collect()))
    cut_up, whole = ordered(scan(df, ["f"], "n", runs, width=4)), ordered(scan(df.withColumn("n", F.col("n") + 3), ["f"], "n", runs))
    back = lambda x: None if x is None else x - 3
    assert cut_up == [(f, n - 3, s, back(p), back(q), back(b)) for f, n, s, p, q, b in whole]
