"""A corpus pipeline: each stage takes the documents that the one before kept.

Stages are written as Parquet to the shared folder and read again, so a lost executor repeats
tasks of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from variscope.llm import bpe, jaccard, mixing, personal, toxicity
from variscope.llm.common import table
from variscope.llm.queries import VOCABULARY
from variscope.session import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5; the model is fitted on the labelled rows among ``docs``.

    Columns but the text travel packed, so that a batch holds every text once.
    """
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    scored = toxicity.score_toxicity(docs.select(F.struct(*others).alias("_row"), "text"), model)
    kept = scored.where(F.col("tox_score") < 0.5)
    return kept.select(*[F.col("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group linked by the Jaccard join."""
    return jaccard.without_near_copies(docs, shingle=5, least=80)


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind, and the lengths of the new texts."""
    return personal.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids and the text they decode to."""
    ids = bpe.encode_bpe(docs.select("doc_id", "source", "text"), VOCABULARY).drop("text")
    return bpe.decode_bpe(ids, VOCABULARY)


STAGES = [
    ("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("personal_data", redact_personal),
    ("mixing", mix_sources), ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs


#: Trained dictionaries and merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None
