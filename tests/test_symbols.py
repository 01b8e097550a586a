"""Mergeable sketches of symbols: counts near the exact ones, merging upwards, nulls and empty tables."""

from variscope.operators import symbols as Y


def test_merged_sketches_are_near_the_exact_counts(spark):
    named = spark.range(60_000).selectExpr("case id % 3 when 0 then 'a/b' when 1 then 'a/c' else 'd' end as dir", "concat('S', id % 40000) as symbol")
    found = {r["dir"]: r["n_symbols"] for r in Y.symbols_below(named).collect()}
    exact = {r["dir"]: len(set(r["s"])) for r in Y.with_parents(named).groupBy("dir").agg({"symbol": "collect_set"}).toDF("dir", "s").collect()}
    assert set(found) == {"", "a", "a/b", "a/c", "d"} == set(exact)
    assert all(abs(found[d] - n) <= Y.SKETCH_ERROR * n for d, n in exact.items())


def test_repeated_rows_and_merging_twice_change_nothing(spark):
    named = spark.createDataFrame([("a/b", "X"), ("a/b", "X"), ("a", "X"), ("a", "Y"), ("c", None)], "dir string, symbol string")
    assert {r["dir"]: r["n_symbols"] for r in Y.symbols_below(named).collect()} == {"": 2, "a": 2, "a/b": 1, "c": 0}
    each = Y.symbol_sketches(named, ["dir"])
    again = Y.merge_sketches(each.unionByName(each), ["dir"])
    assert sorted(Y.sketched_counts(again).collect()) == sorted(Y.sketched_counts(each).collect())


def test_empty_table(spark):
    none = spark.createDataFrame([], "dir string, symbol string")
    assert Y.symbols_below(none).count() == 0
