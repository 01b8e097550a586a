"""What many source locations ask of a configuration, put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from variscope.functions import lines as L
from variscope.operators import blocks as B, clauses as E, configs as C, traces as R

ID = ["file_id", "block_no"]


def located_blocks(locations: DataFrame, files: DataFrame, tree: DataFrame) -> DataFrame:
    """(file_id, block_no) of the innermost blocks at (path, line_no); lines outside of blocks give none."""
    places = locations.join(files.select("file_id", "path"), "path").select("file_id", "line_no").distinct()
    return B.block_at(places, tree).filter(F.col("block_no").isNotNull()).select(*ID).distinct()


def left_out(located: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Located blocks that no configuration reaches; their conditions would spoil the rest."""
    return located.join(verdicts.filter("verdict = 'yes'").select(*ID), ID, "left_anti")


def _own(var: Column, file_id: Column) -> Column:
    """Block variables are a file's own; other variables are shared."""
    return F.when(var.rlike(r"^[BT]\d+$"), F.concat(F.lit("F"), file_id.cast("string"), F.lit(":"), var)).otherwise(var)


def merge_requirements(located: DataFrame, slices: DataFrame, verdicts: DataFrame, files: DataFrame, lists: DataFrame) -> DataFrame:
    """(clause): distinct clauses that a configuration for all located blocks meets.

    ``slices`` (file_id, block_no, lits) holds each block's own precondition. Blocks whose
    precondition can't be met alone are left out (``left_out`` lists them). Then the
    located files' variables hold, listed items are on or, on the black list, off.
    """
    good = located.join(verdicts.filter("verdict = 'yes'").select(*ID), ID, "left_semi")
    name = lambda l: F.concat(F.when(l["positive"], "").otherwise("!"), _own(l["var"], F.col("file_id")))
    text = F.array_join(F.array_sort(F.transform("lits", name)), " || ")
    code = slices.join(good, ID, "left_semi").select(text.alias("clause"))
    built = files.join(located.select("file_id").distinct(), "file_id", "left_semi").select(L.file_variable(F.col("path")).alias("clause"))
    listed = lists.select(F.concat(F.when(F.col("list") == "white", "").otherwise("!"), "item").alias("clause"))
    return code.unionByName(built).unionByName(listed).distinct()


def location_configuration(located: DataFrame, keys: DataFrame, slices: DataFrame, missing: DataFrame) -> DataFrame:
    """(file_id, block_no, symbol, value): the least configuration that enables each located block.

    ``keys`` (file_id, block_no, sid) points to the merged ``slices`` (sid, lits); equal slices
    are decided once.
    """
    wanted = keys.join(located, ID, "left_semi")
    needed = slices.join(wanted.select("sid").distinct(), "sid", "left_semi")
    rows = wanted.join(E.least_assignment(needed), "sid").select(*ID, "var", "val").filter(~F.col("var").rlike(r"^[BT]\d+$"))
    return C.fold_tristate(rows, missing, ID).select(*ID, "symbol", "value")


def tailored_configuration(
    addresses: DataFrame, places: DataFrame, ignored: DataFrame, files: DataFrame, tree: DataFrame, slices: DataFrame, verdicts: DataFrame, lists: DataFrame,
) -> DataFrame:
    """(clause): requirements of all source lines that a trace ran through.

    ``places`` (addr, path, line_no) resolves addresses; paths on the ignore list and those
    without a file drop out.
    """
    ran = R.first_seen(addresses).select("addr").join(places, "addr").select("path", "line_no").distinct()
    kept = R.drop_ignored(ran.select("path").distinct(), ignored)
    known, _ = R.existing_only(ran.join(kept.select("path").distinct(), "path", "left_semi"), files)
    return merge_requirements(located_blocks(known, files, tree), slices, verdicts, files, lists)
