"""Joins whose large side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame


def lookup(big: DataFrame, small: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join ``big`` with the per-key table ``small``.

    ``big`` stands on the left, where adaptive execution cuts the partitions of a hot key into
    tasks of their own and repeats only the matching part of ``small``. Nothing is
    repeated for keys that are not hot, and Spark broadcasts ``small`` where its size allows.
    """
    return big.join(small, on, how)
