"""Line operators that look at neighbouring lines or change the number of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from variscope.plans.scan import SEGMENT, Run, scan
from variscope.session import cut


def join_continuations(lines: DataFrame, width: int = SEGMENT) -> DataFrame:
    """Glue lines ending in a backslash to the next; ``line_no`` is the first of them."""
    more = F.col("txt").endswith("\\")
    marked = cut(lines).withColumn("_more", more)
    marked = cut(scan(marked, ["file_id"], "line_no", [Run("_prev_more", "lag", F.col("_more"))], width=width))
    head = F.when(F.coalesce("_prev_more", F.lit(False)), None).otherwise(F.col("line_no"))
    grouped = scan(marked, ["file_id"], "line_no", [Run("head", "last", head)], width=width)
    alone = grouped.filter((F.col("head") == F.col("line_no")) & ~F.col("_more"))
    parts = grouped.filter((F.col("head") != F.col("line_no")) | F.col("_more"))
    body = F.when(F.col("_more"), F.expr("left(txt, length(txt) - 1)")).otherwise(F.col("txt"))
    glued = parts.groupBy("file_id", "head").agg(
        F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("line_no", body.alias("t")))), lambda s: s["t"])).alias("txt")
    )
    return alone.select("file_id", "line_no", "txt").unionByName(
        glued.select("file_id", F.col("head").alias("line_no"), "txt")
    )


def inline_enable(lines: DataFrame, width: int = SEGMENT) -> DataFrame:
    """A code line using ``ENABLE_X`` becomes seven lines.

    What stands before the macro, the condition, ``1``, ``#else``, ``0``, ``#endif`` and
    what stands after it.
    """
    shape = r"^(.*?)ENABLE_([A-Za-z0-9_]+)(.*)$"
    hit = F.col("txt").rlike(shape) & ~F.col("txt").rlike(r"^#\s*if") & ~F.col("txt").contains("_ENABLE_")
    part = lambda i: F.regexp_extract("txt", shape, i)
    seven = F.array(
        part(1), F.concat(F.lit("#if defined CONFIG_"), part(2)),
        F.lit("1"), F.lit("#else"), F.lit("0"), F.lit("#endif"), part(3),
    )
    wide = cut(lines.withColumn("_out", F.when(hit, seven).otherwise(F.array("txt"))))
    wide = scan(wide, ["file_id"], "line_no", [Run("_upto", "sum", F.size("_out").cast("bigint"))], width=width)
    return wide.select(
        "file_id", (F.col("_upto") - F.size("_out")).alias("_base"), F.posexplode("_out").alias("_i", "txt")
    ).select("file_id", (F.col("_base") + F.col("_i") + 1).cast("bigint").alias("line_no"), "txt")
