"""Labelled rows for fitting: a bounded sample, the same rows whenever it is drawn."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.llm import _common as C

#: Most labelled rows that a model is fitted on; drawn by a hash of the id where there are more.
MAX_ROWS = 40_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, rest: int, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, text and y (0 or 1) of labelled documents whose crc32 remainder is not the held-out one.

    A document with several labels has their rounded mean; null labels and ids
    are left out. Of rows that repeat an id, the text with the least hash stands
    for it. The labels drawn, and so the rows, are at most about ``max_rows``, so
    that they are broadcast whatever the size of the tables.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~C.held_out(F.col("doc_id"), mod, rest)).select("doc_id", F.col(label).alias("__y"))
    share = min(1.0, max_rows / max(1, known.count()))
    drawn = known.where(C.share_below(F.xxhash64("doc_id", F.lit(7)), share)).groupBy("doc_id").agg((F.avg("__y") >= 0.5).cast("int").alias("y"))
    found = docs.select("doc_id", C.whole_text().alias("text")).join(F.broadcast(drawn), "doc_id")
    return found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("y").alias("y"))


class Isotonic:
    """Scores mapped to shares of label 1 by pooling adjacent violators; straight lines join the pools.

    ``y`` are labels or shares of label 1, ``weight`` the rows behind each. More
    pools than ``most_pools`` are merged with their neighbours, in proportion to
    their rows, so the result has a bounded size and every row stays in it.
    """

    def __init__(self, scores: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, most_pools: int = 200) -> None:
        weight = np.ones(len(scores)) if weight is None else weight
        order = np.argsort(scores, kind="stable")
        pools: list[list[float]] = []  # lowest and highest score, share, rows
        for s, t, n in zip(scores[order], y[order], weight[order], strict=True):
            pools.append([float(s), float(s), float(t), float(n)])
            while len(pools) > 1 and (pools[-2][2] >= pools[-1][2] or pools[-2][1] == pools[-1][0]):
                pools.append(_merged(pools.pop(-2), pools.pop()))
        if len(pools) > most_pools:
            place = (np.cumsum([p[3] for p in pools]) * most_pools / sum(p[3] for p in pools)).astype(int)
            kept: dict[int, list[float]] = {}
            for k, p in zip(place.tolist(), pools, strict=True):
                kept[k] = _merged(kept[k], p) if k in kept else p
            pools = list(kept.values())
        self.at = np.array([s for p in pools for s in p[:2]])
        self.share = np.array([p[2] for p in pools for _ in range(2)])
        self.centre, self.spread = (float(np.median(scores)), float(scores.std()) or 1.0) if len(scores) else (0.0, 1.0)

    def share_at(self, scores: np.ndarray) -> np.ndarray:
        """The share of label 1 at scores."""
        return np.interp(scores, self.at, self.share) if len(self.at) else np.full(len(scores), 0.5)

    def __call__(self, scores: np.ndarray) -> np.ndarray:
        """Between 0 and 1 and never falling; a thousandth keeps the order within a pool."""
        if not len(self.at):
            return np.full(len(scores), 0.5)
        flat = 1 / (1 + np.exp(-np.clip((scores - self.centre) / self.spread, -30, 30)))
        return np.clip(0.999 * self.share_at(scores) + 0.001 * flat, 0, 1)


def _merged(a: list[float], b: list[float]) -> list[float]:
    """Two neighbouring pools as one."""
    n = a[3] + b[3]
    return [a[0], b[1], (a[2] * a[3] + b[2] * b[3]) / n, n]
