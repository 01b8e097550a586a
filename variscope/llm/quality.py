"""Quality classifier: ridge regression on random Fourier features of document statistics.

Statistics of a whole text (shares of kinds of characters and words, repetition, line shapes) are
standardised and mapped to random Fourier features, whose inner products approximate a
Gaussian kernel. Each partition sums its part of the normal equations; the parts are added
in tasks by blocks of rows, and one matrix of fixed size reaches the driver. An isotonic
fit on rows kept apart turns ridge scores into probabilities.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from variscope.llm.common import held_out, labelled_sample, map_column, pool_adjacent
from variscope.session import cut

#: Rows of the normal equations that are added up in one task.
BLOCK = 64
STATISTICS = 22


def statistics(text: str | None) -> list[float]:
    """Numbers that describe a whole text; null counts as empty, and empty texts give zeros."""
    text = text or ""
    words, n = text.split(), len(text)
    if not words:
        return [0.0] * STATISTICS
    lines = [x for x in text.split("\n") if x.strip()]
    counts, w = Counter(words), len(words)
    lengths = np.fromiter(map(len, words), np.float64, w)
    codes = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256).astype(np.float64)
    total = codes.sum()
    share = codes[codes > 0] / total
    upper, digits, high = codes[65:91].sum(), codes[48:58].sum(), codes[128:].sum()
    lower, spaces = codes[97:123].sum(), codes[32] + codes[9:14].sum()
    marks = total - upper - digits - high - lower - spaces
    usual = codes[[33, 34, 39, 44, 46, 58, 59, 63]].sum()
    repeats = sum(map(str.__eq__, words, words[1:]))
    caps = sum(map(str.isupper, words))
    bare = sum(1 for x in words if not any(map(str.isalnum, x)))
    tails = sum(1 for x in words if len(x) > 2 and not x[-1].isalnum() and not x[-2].isalnum())
    return [
        math.log1p(n), math.log1p(w), float(lengths.mean()), float(lengths.std()), float(lengths.max() ** 0.5),
        upper / total, digits / total, high / total, spaces / total, marks / total, usual / total, (marks - usual) / total,
        float(-(share * np.log(share)).sum()), len(counts) / w, counts.most_common(1)[0][1] / w, repeats / w, caps / w, bare / w, tails / w,
        1 - len(set(lines)) / max(1, len(lines)), math.log1p(w / max(1, len(lines))), (codes[33] + codes[63]) / w,
    ]


@dataclass(frozen=True)
class QualityModel:
    """A fixed number of coefficients, whatever the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    rates: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant."""
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        waves = np.cos(z @ self.directions + self.phases) * math.sqrt(2 / len(self.phases))
        return np.hstack([waves, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.rates), 0.0, 1.0)


def with_statistics(df: DataFrame, text: str = "text", name: str = "stats") -> DataFrame:
    def make():
        return lambda texts: {name: pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))}

    return map_column(df, text, make, pa.schema([(name, pa.list_(pa.float64()))]))


def _normal_equations(rows: DataFrame, model: QualityModel) -> np.ndarray:
    """Sums of f f' with f = (features, label), added up over partitions."""
    size = len(model.phases) + 2

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for b in batches:
            x = np.array(b.column(0).to_pylist(), dtype=np.float64).reshape(-1, STATISTICS)
            f = np.hstack([model.features(x), np.array(b.column(1).to_pylist(), dtype=np.float64)[:, None]])
            total += f.T @ f
        for block in range(0, size, BLOCK):
            yield pa.RecordBatch.from_pydict({"block": [block], "sums": [total[block : block + BLOCK].tobytes()]}, pa.schema([("block", pa.int32()), ("sums", pa.binary())]))

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": pdf["block"][:1], "sums": [sum(np.frombuffer(s) for s in pdf["sums"]).tobytes()]})

    summed = rows.select("stats", "label").mapInArrow(parts, "block int, sums binary").groupBy("block").applyInPandas(add, "block int, sums binary")
    found = sorted((r["block"], r["sums"]) for r in summed.collect())  # size / BLOCK rows
    return np.concatenate([np.frombuffer(s) for _, s in found]).reshape(size, size) if found else np.zeros((size, size))


def fit_quality(docs: DataFrame, labels: DataFrame, *, label: str = "quality", sample: int = 30_000, features: int = 512, width: float = 4.0, ridge: float = 1e-3, seed: int = 7) -> QualityModel:
    """Fit on at most ``sample`` labelled rows outside the held-out fold; every fourth calibrates.

    ``width`` is the standard deviation of the Gaussian kernel, in standardised units. With labels
    of one kind only, every text gets that kind's rate; with none at all, 0.5.
    """
    rows = cut(with_statistics(labelled_sample(docs, labels, label, sample)).drop("text"))
    moments = {r["pos"]: r for r in rows.select(F.posexplode("stats").alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()}
    rng = np.random.default_rng(seed)
    mean = np.array([moments[i]["m"] if i in moments else 0.0 for i in range(STATISTICS)])
    scale = np.array([max(moments[i]["s"], 1e-6) if i in moments else 1.0 for i in range(STATISTICS)])
    empty = np.zeros(features + 1)
    model = QualityModel(mean, scale, rng.normal(size=(STATISTICS, features)) / width, rng.uniform(0, 2 * math.pi, features), empty, np.zeros(1), np.full(1, 0.5))
    part = F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(4))
    sums = _normal_equations(rows.where(part > 0), model)
    size = features + 1
    gram, right = sums[:size, :size], sums[:size, size]
    penalty = ridge * max(gram[-1, -1], 1.0) / features * np.eye(size)
    penalty[-1, -1] = 1e-9
    model = QualityModel(mean, scale, model.directions, model.phases, np.linalg.solve(gram + penalty, right), model.knots, model.rates)
    kept = rows.where(part == 0).select("stats", "label").toPandas()  # a quarter of the bounded sample
    if not len(kept):
        return model
    raw = model.raw(np.array(kept["stats"].tolist(), dtype=np.float64).reshape(-1, STATISTICS))
    order = np.lexsort((kept["label"].to_numpy(), raw))
    groups = [g for g in np.array_split(order, max(1, min(150, len(order) // 10))) if len(g)]
    truth = kept["label"].to_numpy(dtype=np.float64)
    knots, rates = pool_adjacent([raw[g].mean() for g in groups], [truth[g].sum() for g in groups], [len(g) for g in groups])
    return QualityModel(mean, scale, model.directions, model.phases, model.weights, np.array(knots), np.array(rates))


def score_quality(df: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """``df`` with ``quality_score`` (0 to 1) of each whole text; null and empty texts are scored as texts without words."""

    def make():
        return lambda texts: {"quality_score": pa.array(model.score(np.array([statistics(t) for t in texts]).reshape(-1, STATISTICS)), pa.float64())}

    return map_column(df, text, make, pa.schema([("quality_score", pa.float64())]))


def quality_of_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted."""
    scored = score_quality(docs.select("doc_id", "text"), fit_quality(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= threshold).cast("int").alias("predicted"))
