import random

import pytest

WORDS = "the quick brown fox jumps over a lazy dog while seven small birds sing softly near old stone walls and green rivers".split()


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, long, repeated and plain texts; ids with ties and a null."""
    long = prose(30_000, 1)
    return [
        (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \n\t ", "de", "b", 4), (4, long, "en", "a", len(long)),
        (5, prose(40, 2), "en", "b", 0), (5, prose(40, 2), "en", "b", 0), (6, prose(40, 2), "en", None, 0), (7, "one two", "en", "a", 7),
        (8, "Mail a.b@c.example.org or +1 (555) 123-4567, card 4111 1111 1111 1111 at 10.0.0.1", "en", "c", 0),
        (9, "ÄÖ <|endoftext|> naïve 日本 😀 don't", "fr", "c", 0), (None, prose(30, 3), None, "a", 0), (10, "x" * 50_000, "en", "b", 50_000),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = ["row", "spans", "ids", "n", "keys", "slot", "score", "tox_score", "key", "size", "_id", "fingerprint", "stats", "copies"]
    return df.withColumns({c: F.lit("kept") for c in clash})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
