"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

#: What the contracts call a word, and the white space between words (fixed values).
WORD = r"[^\x20\x09-\x0D]+"
#: Share of rows kept apart for measuring classifiers.
FOLDS = 5


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo the number of folds; 0 is held out."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS))


def held_out(doc_id: str = "doc_id") -> Column:
    """True in the held-out fold; a null id is never held out."""
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, label) of at most ``limit`` labelled rows outside the held-out fold.

    A repeated id counts once. The rows with the smallest hashes of their ids are taken, so that runs agree. This is
    the documented bound on what a classifier is fitted on.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id))
        .groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).alias("label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(limit)
    )
    first = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = first.join(F.broadcast(known), F.col("doc_id") == F.col("_id"))  # limit rows of two numbers: about 24 bytes each
    return found.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text"))


def carried(df: DataFrame, **columns: Column) -> DataFrame:
    """All columns of ``df`` packed in one struct ``_row``, with the named ones beside it.

    Extra columns of any name then pass through an operator without clashing.
    """
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[c.alias(n) for n, c in columns.items()])


def map_column(df: DataFrame, column: str, make: Callable[[], Callable[[list], dict[str, pa.Array]]], added: pa.Schema, rows: int = 64, as_arrow: bool = False) -> DataFrame:
    """Add columns computed from one column, Arrow batch by Arrow batch.

    ``make`` runs once in each task and returns a function from a list of values to the new
    columns (``as_arrow``: from an Arrow array). Batches are worked off ``rows`` at a time, so memory stays bounded when texts are long.
    """
    schema = StructType([*df.schema.fields, *from_arrow_schema(added).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            at = batch.schema.get_field_index(column)
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                new = work(part.column(at) if as_arrow else part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *[new[f.name].cast(f.type) for f in added]], [*part.schema.names, *added.names])

    return df.mapInArrow(run, schema)


def pool_adjacent(scores: list[float], hits: list[float], counts: list[float]) -> tuple[list[float], list[float]]:
    """Isotonic regression by pooling adjacent violators.

    Takes points ordered by score with their positives and sizes; returns knots
    (mean score, rate) whose rates never fall.
    """
    blocks: list[list[float]] = []
    for s, h, n in zip(scores, hits, counts, strict=True):
        blocks.append([s * n, h, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return [b[0] / b[2] for b in blocks], [b[1] / b[2] for b in blocks]
