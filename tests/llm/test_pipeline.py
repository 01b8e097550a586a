"""The pipeline's stages and its whole run on planted rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from tests.llm.conftest import prose
from variscope.llm.queries import VOCABULARY

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Clean, toxic, copied, nearly copied and personal texts, odd rows, and columns of clashing names."""
    slurs = ["grobnix", "vileslur", "hatefang", "scumrat"]
    rows = [(i, prose(60, i), "en", f"s{i % 3}", 0) for i in range(160)]
    rows += [(1000 + i, prose(40, 900 + i) + " " + " ".join(slurs[(i + k) % 4] for k in range(12)), "en", "s0", 0) for i in range(120)]
    rows += [(2000 + i, prose(60, 3), "en", "s1", 0) for i in range(30)] + [(3000, prose(60, 4) + " end", "en", "s2", 0)]
    rows += [(4000 + i, prose(30, 2000 + i) + f" write to u{i}@mail{i}.example.org now", "en", "s1", 0) for i in range(20)]
    rows += [(5000, None, None, None, None), (5001, "", "en", "s0", 0), (None, prose(25, 7000), "en", None, 0), (5002, " \n", "en", "s0", 2)]
    labels = [(i, 1, 0) for i in range(160)] + [(1000 + i, 0, 1) for i in range(120)]
    folder = str(tmp_path_factory.mktemp("docs"))
    docs = spark.createDataFrame(rows, COLUMNS).withColumns({c: F.lit("kept") for c in ("_row", "tox_score", "spans", "copies", "ids", "key")})
    docs.repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_stages_take_effect(spark, planted, tmp_path):
    folder, rows = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, folder)
        if name != "bpe":
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
    ids = {n: Counter(r["doc_id"] for r in rows_) for n, rows_ in seen.items()}
    toxic, clean = set(range(1000, 1120)), set(range(160))
    assert len(toxic - set(ids["toxicity"])) >= 114 and clean <= set(ids["toxicity"])
    assert set(ids["near_copies"]) == {i for i in ids["toxicity"] if i not in set(range(2000, 2030)) | {3000}}
    assert {5000, 5001, 5002, None} <= set(ids["near_copies"]) and clean <= set(ids["near_copies"])
    texts = {r["doc_id"]: r["text"] for r in seen["personal_data"]}
    assert all("<EMAIL>" in texts[4000 + i] and "@" not in texts[4000 + i] for i in range(20)) and texts[5000] is None
    assert {r["doc_id"]: r["text"] for r in seen["near_copies"] if r["doc_id"] in clean} == {i: texts[i] for i in clean}
    assert set(ids["mixing"]) <= set(ids["personal_data"]) and max(ids["mixing"].values()) <= 3
    library = Tokenizer.from_file(VOCABULARY)
    for r in seen["bpe"]:
        want = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert list(r["ids"]) == want and r["decoded"] == library.decode(want, skip_special_tokens=False)
    run = P.run(spark, folder).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in run) == Counter((r["doc_id"], tuple(r["ids"])) for r in seen["bpe"])


def test_empty_table(spark, none, no_labels, tmp_path):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    no_labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
