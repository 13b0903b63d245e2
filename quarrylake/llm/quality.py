"""Quality classifier: random Fourier features over document statistics.

Cosines of random projections of a document's statistics approximate a Gaussian
kernel. Each partition of the labelled sample sums its part of the normal
equations; the driver adds the parts (a fixed number, each of a fixed size),
solves for ridge weights and calibrates the scores of labelled rows kept aside
by isotonic regression. Scoring is one pass over the texts without a shuffle.

Defined cases: a null text is the empty text and is scored as such; a document
that repeats is scored each time; extra columns are kept by :func:`add_score`
except those named like its outputs; without labels of both kinds every score
is the share of label 1 (0.5 where there are none) and :func:`keep_good` keeps
every row; where no labelled row is drawn for calibration, all of them serve.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylake.llm import _common as C
from quarrylake.llm import _training as L

FEATURES = 192
RIDGE = 1e-3
WIDTH = 3.0
CUT = 0.7
#: Partitions of the labelled sample, each of which sends one sum of fixed size.
SUMS = 8
#: One labelled row in so many is for calibration, not for the weights.
CALIBRATE = 4

_CLASS = np.zeros(256, dtype=np.intp)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 0 if _b >= 128 or _c.islower() else 1 if _c.isupper() else 2 if _c.isdigit() else 3 if _c in " \t" else 4 if _c in "\n\r" else 5 if _c in ".,;:!?'\"()-" else 6
STATISTICS = 22


def statistics(text: str) -> np.ndarray:
    """Shape of a text: lengths, kinds of characters, repetition of words and lines."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    counts = np.bincount(data, minlength=256)
    kinds = np.bincount(_CLASS, weights=counts, minlength=7) / max(1, len(data))
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    distinct = set(words)
    share = counts[counts > 0] / max(1, len(data))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    filled = [x for x in lines if x.strip()] or [""]
    return np.array(
        [
            np.log1p(len(text)),
            np.log1p(len(words)),
            *kinds,
            lengths.mean(),
            lengths.std(),
            np.log1p(lengths.max()),
            len(distinct) / n,
            np.log1p(len(distinct)),
            sum(map(eq, words, words[1:])) / n,
            len(set(filled)) / len(filled),
            np.log1p(len(text) / len(lines)),
            sum(x.rstrip()[-1:] in (".", "!", "?") for x in filled) / len(filled),
            -(share * np.log(share)).sum(),
            sum(not x[-1].isalnum() and x[-1] not in ".,;:!?)'\"" for x in distinct) / max(1, len(distinct)),
            counts[ord("|")] / n,
            np.log1p(100 * counts[[35, 36, 37, 38, 42, 64, 94, 95, 124, 126]].sum() / max(1, len(data))),
        ]
    )


class Model:
    """Standardised statistics -> cosines -> ridge score -> calibrated score."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, width: float = WIDTH, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.turn = rng.standard_normal((len(mean), features)) / width
        self.shift = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.calibrate = L.Isotonic(np.zeros(0), np.zeros(0))
        self.constant: float | None = 0.5

    def cosines(self, x: np.ndarray) -> np.ndarray:
        """The random Fourier features of rows of statistics, and a one."""
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.turn + self.shift
        return np.hstack([np.cos(z) * np.sqrt(2 / len(self.shift)), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores of rows of statistics."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return self.calibrate(self.cosines(x) @ self.weights)


def _sums(rows: DataFrame, of, size: int) -> np.ndarray:
    """Add up ``of(statistics, y)`` (a flat array of ``size``) over partitions; each sends one row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for batch in batches:
            if len(batch):
                total += of(np.stack(batch["x"].to_numpy()), batch["y"].to_numpy(np.float64))
        yield pd.DataFrame({"s": [total]})

    return sum((np.asarray(r["s"]) for r in rows.select("x", "y").mapInPandas(run, "s array<double>").collect()), np.zeros(size))


def _statistics_udf():
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts], dtype=object)

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", mod: int = 4, rest: int = 2, max_rows: int = L.MAX_ROWS) -> Model:
    """Fit on labelled documents outside the held-out remainder; at most about ``max_rows`` of them."""
    sample = L.labelled_sample(docs, labels, label, mod, rest, max_rows)
    rows = C.spill(sample.select("doc_id", "y", _statistics_udf()("text").alias("x")).repartition(SUMS, "doc_id"), "quality-sample")
    rows = rows.coalesce(SUMS)
    d = STATISTICS
    s = _sums(rows, lambda x, y: np.concatenate([[len(x), y.sum()], x.sum(0), (x * x).sum(0)]), 2 + 2 * d)
    n, ones = s[0], s[1]
    mean = s[2 : 2 + d] / max(1, n)
    model = Model(mean, np.sqrt(np.maximum(s[2 + d :] / max(1, n) - mean**2, 1e-9)))
    if not 0 < ones < n:
        model.constant = float(ones / n) if n else 0.5
        return model
    k = FEATURES + 1
    weight = np.array([n / (2 * (n - ones)), n / (2 * ones)])

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z, w = model.cosines(x), weight[y.astype(int)]
        return np.concatenate([((z * w[:, None]).T @ z).ravel(), (z * w[:, None]).T @ y])

    aside = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(CALIBRATE)) == 0
    s = _sums(rows.where(~aside), normal, k * k + k)
    a, b = s[: k * k].reshape(k, k), s[k * k :]
    model.weights = np.linalg.solve(a + RIDGE * max(1.0, a.trace() / k) * np.eye(k), b)
    kept = rows.where(aside).select("x", "y").collect() or rows.select("x", "y").collect()
    x, y = np.array([r["x"] for r in kept]), np.array([r["y"] for r in kept], np.float64)
    model.calibrate = L.Isotonic(model.cosines(x) @ model.weights, y)
    model.constant = None
    return model


def score_column(docs: DataFrame, model: Model, text: Column | None = None) -> Column:
    """The score of a text column as an expression."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.stack([statistics(t) for t in texts])) if len(texts) else np.zeros(0))

    return run(C.whole_text() if text is None else text)


def add_score(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """Add score (0 to 1) and predicted (1 if the score reaches the cut)."""
    return docs.withColumn("score", score_column(docs, model)).withColumn("predicted", (F.col("score") >= cut).cast("int"))


def keep_good(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The rows whose text is predicted to be good, with the columns they had; all of them if the model has learnt nothing."""
    return docs if model.constant is not None else docs.where(score_column(docs, model) >= cut)
