"""Running values over long ordered groups without one task per group.

A plain window puts a whole group (a file, a configuration) in one task. Here each
group is split into segments of the integer column ``by``; windows run inside a
segment, and one row per segment carries the state over the segment boundary. The
carry window sees one row per segment, so a group of a trillion rows still spreads.

Only groups that leave the first segment need a carry. They are looked for first, by a filter that a
stored table answers from its statistics; where there are none, one window is all there is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from variscope.session import cut

SEGMENT = 1 << 16


@dataclass(frozen=True)
class Run:
    """One running column.

    ``sum``   running sum up to and including the row
    ``last``  last non-null value up to and including the row
    ``before`` last non-null value strictly before the row
    ``lag`` / ``lead`` value of the neighbouring row
    """

    name: str
    kind: str
    value: Column


def crossing(df: DataFrame, keys: list[str], by: str, width: int = SEGMENT) -> DataFrame | None:
    """Keys of the groups with rows outside of segment 0, or None when there are none."""
    at = F.col(by)
    far = df.filter(at.isNull() | (at < 0) | (at >= width)).select(*keys)
    return None if far.isEmpty() else cut(far.distinct())


def scan(
    df: DataFrame,
    keys: list[str],
    by: str,
    runs: list[Run],
    ties: list[str] | None = None,
    width: int = SEGMENT,
    far: DataFrame | str | None = "unknown",
) -> DataFrame:
    """Add the running columns ``runs`` over ``keys`` in order of ``by`` then ``ties``.

    Where groups leave their first segment, ``df`` is read twice; hand in a table (``cut``) when computing it is costly.
    Or hand in ``far``, the ``crossing`` of ``df`` or of a table with at least its groups and positions, over some of the
    keys: then ``df`` is written here, and only where it has to be.
    """
    order = [by, *(ties or [])]
    if isinstance(far, str):
        far = crossing(df, keys, by, width)
    elif far is not None:
        df = cut(df)
    if far is None:
        return _in_one(df, keys, order, runs)
    df = df.withColumn("_scan_seg", F.floor(F.col(by) / F.lit(width)).cast("bigint"))
    for r in runs:
        df = df.withColumn(f"_v_{r.name}", r.value)
    inside = Window.partitionBy(*keys, "_scan_seg").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("_scan_seg")
    across_earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    position = F.struct(*order)

    local, totals, carries = [], [], []
    for r in runs:
        v, c = F.col(f"_v_{r.name}"), f"_c_{r.name}"
        if r.kind == "sum":
            local.append(F.sum(v).over(upto).alias(f"_l_{r.name}"))
            totals.append(F.sum(v).alias(c))
            carries.append(F.sum(c).over(across_earlier).alias(c))
        elif r.kind in ("last", "before"):
            frame = upto if r.kind == "last" else earlier
            local.append(F.last(v, ignorenulls=True).over(frame).alias(f"_l_{r.name}"))
            totals.append(F.max_by(v, F.when(v.isNotNull(), position)).alias(c))
            carries.append(F.last(c, ignorenulls=True).over(across_earlier).alias(c))
        elif r.kind == "lag":
            local.append(F.lag(v).over(inside).alias(f"_l_{r.name}"))
            totals.append(F.max_by(v, position).alias(c))
            carries.append(F.lag(c).over(across).alias(c))
        elif r.kind == "lead":
            local.append(F.lead(v).over(inside).alias(f"_l_{r.name}"))
            totals.append(F.min_by(v, position).alias(c))
            carries.append(F.lead(c).over(across).alias(c))
        else:
            raise ValueError(r.kind)

    # Rows that would carry nothing are dropped.
    carry = (
        df.join(far.distinct(), far.columns, "left_semi").groupBy(*keys, "_scan_seg")
        .agg(*totals)
        .select(*keys, "_scan_seg", *carries)
        .filter(F.coalesce(*[F.col(f"_c_{r.name}").cast("string") for r in runs]).isNotNull())
    )
    kept = [c for c in df.columns if not c.startswith("_v_")]
    edge = []
    if any(r.kind in ("lag", "lead") for r in runs):
        edge = [F.row_number().over(inside).alias("_scan_at"), F.lead(F.lit(1)).over(inside).alias("_scan_more")]
    joined = df.select(*kept, *local, *edge)
    carry = carry.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_scan_seg").alias("_scan_k"),
                         *[f"_c_{r.name}" for r in runs])
    match = F.col("_scan_seg") == F.col("_scan_k")
    for k in keys:
        match = match & (F.col(k) == F.col(f"_k_{k}"))
    joined = joined.join(carry, match, "left")

    out = []
    for r in runs:
        l, c = F.col(f"_l_{r.name}"), F.col(f"_c_{r.name}")
        if r.kind == "sum":
            value = F.coalesce(l, F.lit(0)) + F.coalesce(c, F.lit(0))
        elif r.kind in ("last", "before"):
            value = F.coalesce(l, c)
        elif r.kind == "lag":
            value = F.when(F.col("_scan_at") == 1, c).otherwise(l)
        else:
            value = F.when(F.col("_scan_more").isNull(), c).otherwise(l)
        out.append(value.alias(r.name))
    base = [c for c in kept if c not in ("_scan_seg", *[r.name for r in runs])]
    return joined.select(*base, *out)


def _in_one(df: DataFrame, keys: list[str], order: list[str], runs: list[Run]) -> DataFrame:
    """``scan`` where no group leaves its first segment."""
    inside = Window.partitionBy(*keys).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    value = {
        "sum": lambda v: F.coalesce(F.sum(v).over(upto), F.lit(0)),
        "last": lambda v: F.last(v, ignorenulls=True).over(upto),
        "before": lambda v: F.last(v, ignorenulls=True).over(earlier),
        "lag": lambda v: F.lag(v).over(inside),
        "lead": lambda v: F.lead(v).over(inside),
    }
    base = [c for c in df.columns if c not in [r.name for r in runs]]
    return df.select(*base, *[value[r.kind](r.value).alias(r.name) for r in runs])


__all__ = ["Run", "crossing", "scan", "SEGMENT", "cut"]
