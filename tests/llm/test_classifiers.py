import random

from pyspark.sql import functions as F

from tests.llm.conftest import prose
from variscope.llm import quality, toxicity
from variscope.llm.common import pool_adjacent

BAD = ["blorfus", "grumzelt", "snarkwad"]


def labelled(spark, n=600):
    rng, rows, labels = random.Random(5), [], []
    for i in range(n):
        words, toxic, junk = prose(80, i).split(), i % 4 == 0, i % 3 == 0
        if toxic:
            for _ in range(5):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        if junk:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, int(not junk), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(found, labels, name):
    rows = found.where("held_out").join(labels, "doc_id").select((F.col("predicted") == F.col(name)).cast("int").alias("ok")).agg(F.avg("ok"), F.count("*")).first()
    assert rows[1] > 50
    return rows[0]


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    assert accuracy(toxicity.toxicity_of_documents(docs, labels), labels, "toxic") > 0.95
    assert accuracy(quality.quality_of_documents(docs, labels), labels, "quality") > 0.95


def test_odd_rows_are_scored(spark, odd):
    docs, labels = labelled(spark, 200)
    model = toxicity.fit_toxicity(docs, labels)
    scored = toxicity.score_toxicity(odd.select("doc_id", "text"), model).collect()
    assert len(scored) == 12 and all(0 <= r["tox_score"] <= 1 for r in scored)
    assert {r["tox_windows"] for r in scored if not (r["text"] or "").strip()} == {0}
    model = quality.fit_quality(docs, labels)
    scored = quality.score_quality(odd.select("doc_id", "text"), model).collect()
    assert len(scored) == 12 and all(0 <= r["quality_score"] <= 1 for r in scored)
    assert len({r["quality_score"] for r in scored if not (r["text"] or "").strip()}) == 1


def test_without_rows_or_labels(spark, odd, none, no_labels):
    for make in (toxicity.toxicity_of_documents, quality.quality_of_documents):
        assert make(none, no_labels).count() == 0
        rows = make(odd, no_labels).collect()
        assert len(rows) == 12 and len({r["score"] for r in rows}) == 1


def test_labels_of_the_held_out_fold_are_not_learned(spark):
    docs, labels = labelled(spark, 200)
    from variscope.llm.common import held_out

    turned = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit_toxicity(docs, labels) == toxicity.fit_toxicity(docs, turned)


def test_pool_adjacent():
    knots, rates = pool_adjacent([1, 2, 3, 4], [0, 2, 1, 2], [2, 2, 2, 2])
    assert rates == [0, 0.75, 1] and knots == [1, 2.5, 4]
