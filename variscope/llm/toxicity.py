"""Toxicity by compression distance.

Two dictionaries are trained by zstandard: one on passages of ordinary documents, drawn from
anywhere in their whole texts, one on passages of toxic documents. What ordinary documents
have too says nothing about toxicity, so a toxic passage is what is left of a whole text when
the words without a telling 5-gram are taken out; 5-grams are counted by label in Spark.

Every word of a text is a window; it is compressed with either dictionary. A window that gets
shorter with the toxic dictionary by ``gain`` bytes or more counts as a hit, and the hits for
each window, damped for short texts, are calibrated to a probability on labelled rows that
trained no dictionary.

zstandard stores a block raw unless compression saves a few bytes. A window is therefore
compressed as ``repeats`` copies of the word: the copies pay for the block's head in both
dictionaries, and the difference in length is what the dictionary knows about the word.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame, functions as F

from variscope.llm.common import held_out, labelled_sample, map_column, pool_adjacent
from variscope.session import cut

#: Entries of a task's memory of windows already compressed; it is emptied when full.
MEMORY = 60_000


@dataclass(frozen=True)
class ToxicityModel:
    """What scoring needs; a few tens of kB whatever the corpus."""

    ordinary: bytes
    toxic: bytes
    gain: int
    repeats: int
    damping: int
    knots: tuple[float, ...]
    rates: tuple[float, ...]


def _grams(word: str, n: int = 5) -> set[str]:
    word = f" {word} "
    return {word[i : i + n] for i in range(max(1, len(word) - n + 1))}


class _Gains(dict):
    """Bytes by which the toxic dictionary shortens a window; computed once for each word."""

    def __init__(self, ordinary: bytes, toxic: bytes, repeats: int) -> None:
        super().__init__()
        plain = dict(write_content_size=False, write_checksum=False, write_dict_id=False)
        log = max(13, (len(ordinary) + len(toxic)).bit_length())  # tables that hold the whole of both dictionaries
        p = zs.ZstdCompressionParameters(window_log=log + 3, chain_log=log, hash_log=log, search_log=6, min_match=4, target_length=64, strategy=zs.STRATEGY_GREEDY, **plain)
        raw = [zs.ZstdCompressionDict(b, dict_type=zs.DICT_TYPE_RAWCONTENT) for b in (ordinary, ordinary + toxic)]
        self.by_ordinary, self.by_toxic = (zs.ZstdCompressor(compression_params=p, dict_data=d).compress for d in raw)
        self.repeats = repeats

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        window = (f" {word}" * self.repeats + " ").encode()
        gain = self[word] = len(self.by_ordinary(window)) - len(self.by_toxic(window))
        return gain


def _evidence(text: str | None, gains: _Gains, gain: int, damping: int) -> tuple[float, int]:
    words = (text or "").lower().split()
    hits = sum(1 for g in map(gains.__getitem__, words) if g >= gain)
    return hits / (len(words) + damping), hits


def _trained(passages: list[bytes], size: int, **how: int) -> bytes:
    """The last ``size`` bytes, which hold the passages chosen, of a dictionary with room for zstandard's head; the passages where it finds too few."""
    try:
        return zs.train_dictionary(size + 512, passages, **how).as_bytes()[-size:]
    except zs.ZstdError:
        return b"".join(passages)[:size]


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, *, label: str = "toxic", sample: int = 20_000, share: float = 0.02, contrast: float = 0.02,
    passage: int = 600, ordinary_bytes: int = 4096, gain: int = 3, repeats: int = 3, damping: int = 60,
) -> ToxicityModel:
    """Learn dictionaries and calibration from at most ``sample`` labelled rows.

    A quarter of the rows, chosen by a hash of the id, trains no dictionary and calibrates. Every
    other ordinary row gives one passage of ``passage`` characters, from a place chosen by a hash of
    its id; every other toxic row gives the distinct words of its whole text that hold a
    telling 5-gram: one in ``share`` of the toxic rows at least and ``contrast`` times
    as often, at most, in the ordinary ones. The toxic dictionary is as long as these words together. Counting
    runs in Spark; the driver gets the telling 5-grams, the passages (``sample`` times ``passage``
    characters at most) and one number for each calibrating row.
    Without labelled rows of both kinds the model scores every text 0.
    """
    part = F.pmod(F.crc32(F.concat(F.lit("fit"), F.col("doc_id").cast("string")).cast("binary")), F.lit(4))
    rows = cut(labelled_sample(docs, labels, label, sample).withColumn("label", (F.col("label") > 0).cast("int")).withColumn("part", part))
    fit = rows.where("part > 0")

    def grams(texts: list[str]) -> dict[str, pa.Array]:
        found = [sorted(set().union(*map(_grams, set(t.lower().split())))) for t in texts]
        return {"gram": pa.array(found, pa.list_(pa.string()))}

    seen = {r["label"]: r["count"] for r in fit.groupBy("label").count().collect()}
    place = F.pmod(F.xxhash64(F.lit("passage"), "doc_id"), F.greatest(F.length("text") - passage, F.lit(0)) + 1) + 1
    drawn = fit.where("label = 0").orderBy("doc_id").select(F.substr("text", place.cast("int"), F.lit(passage)).alias("p"))
    passages = [r["p"].lower().encode() for r in drawn.collect()]
    ordinary = _trained(passages, ordinary_bytes, k=32, d=6)[-(ordinary_bytes * 7 // 8) :] or b" "
    if len(seen) < 2:
        return ToxicityModel(ordinary, b"", gain, repeats, damping, (0.0, 1.0), (0.0, 0.0))
    least = max(2, share * seen[1])
    counts = (
        map_column(fit.select("label", "text"), "text", lambda: grams, pa.schema([("gram", pa.list_(pa.string()))]))
        .select("label", F.explode("gram").alias("gram")).groupBy("gram")
        .agg(F.sum("label").alias("n"), F.sum(1 - F.col("label")).alias("others"))
    )
    telling = {r["gram"] for r in counts.where((F.col("n") >= least) & ((F.col("others") + 0.5) / seen[0] < contrast * F.col("n") / seen[1])).collect()}

    def told(texts: list[str]) -> dict[str, pa.Array]:
        return {"told": pa.array([[w for w in dict.fromkeys(t.lower().split()) if _grams(w) & telling] for t in texts], pa.list_(pa.string()))}

    toxic_rows = map_column(fit.where("label = 1").select("doc_id", "text"), "text", lambda: told, pa.schema([("told", pa.list_(pa.string()))]))
    left = [r["told"] for r in toxic_rows.where(F.size("told") > 0).orderBy("doc_id").select("told").collect()]
    if not left:
        return ToxicityModel(ordinary, b"", gain, repeats, damping, (0.0, 1.0), (0.0, 0.0))
    size = sum(len(w.encode()) + 2 for w in set().union(*left))
    toxic = _trained([f" {' '.join(words)} ".encode() for words in left], size, k=64, d=8)
    raw = ToxicityModel(ordinary, toxic, gain, repeats, damping, (0.0, 1.0), (0.0, 1.0))
    scored = score_toxicity(rows.where("part = 0").select("label", "text"), raw).select("tox_evidence", "label").collect()
    points = sorted((r["tox_evidence"], r["label"]) for r in scored)
    width = max(1, len(points) // 200)
    groups = [points[i : i + width] for i in range(0, len(points), width)]
    counted = [len(g) for g in groups]
    knots, rates = pool_adjacent([sum(p[0] for p in g) / len(g) for g in groups], [sum(p[1] for p in g) for g in groups], counted)
    return ToxicityModel(ordinary, toxic, gain, repeats, damping, (0.0, *knots, 1.0), (0.0, *rates, 1.0))


def calibrated(x: float, knots: tuple[float, ...], rates: tuple[float, ...]) -> float:
    """The rate at ``x``, in a straight line between the knots."""
    i = bisect.bisect_right(knots, x)
    if i == 0:
        return rates[0]
    if i == len(knots):
        return rates[-1]
    a, b = knots[i - 1], knots[i]
    return rates[i - 1] + (rates[i] - rates[i - 1]) * ((x - a) / (b - a) if b > a else 0.0)


def score_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``df`` with ``tox_score`` (0 to 1), ``tox_evidence`` and ``tox_windows`` (number of hits).

    Every word of the whole text is a window. Null and empty texts have no windows and get
    the score of no evidence.
    """
    out = pa.schema([("tox_score", pa.float64()), ("tox_evidence", pa.float64()), ("tox_windows", pa.int64())])

    def make():
        gains = _Gains(model.ordinary, model.toxic, model.repeats)

        def work(texts):
            found = [_evidence(t, gains, model.gain, model.damping) for t in texts]
            return {
                "tox_score": pa.array([min(1.0, max(0.0, calibrated(e, model.knots, model.rates))) for e, _ in found], pa.float64()),
                "tox_evidence": pa.array([e for e, _ in found], pa.float64()),
                "tox_windows": pa.array([h for _, h in found], pa.int64()),
            }

        return work

    return map_column(df, text, make, out)


def toxicity_of_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted."""
    scored = score_toxicity(docs.select("doc_id", "text"), fit_toxicity(docs, labels))
    return scored.select(
        "doc_id", held_out().alias("held_out"), F.col("tox_score").alias("score"),
        (F.col("tox_score") >= threshold).cast("int").alias("predicted"), "tox_windows",
    )
