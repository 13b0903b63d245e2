"""Embeddings of short texts by hashed word parts: the same text always has the same vector.

No model files are needed. Another embedder can take :func:`of_texts`'s place if
FINGERPRINT changes with it, so vectors of two pipelines are never compared.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 128
FINGERPRINT = f"hashed-parts|{DIMENSIONS}|v1"


#: Words whose parts a worker keeps; longer words are not kept.
KEPT_WORDS, KEPT_CHARS = 100_000, 64
_PARTS: dict[str, list[tuple[int, float]]] = {}


def _parts(word: str) -> list[tuple[int, float]]:
    """The places and weights of a word's parts."""
    found = _PARTS.get(word)
    if found is None:
        low = f"^{word}$"
        hashes = [(zlib.crc32(p.encode()), 2.0 if p == low else 1.0) for p in [low, *(low[k : k + 4] for k in range(len(low) - 3))]]
        found = [(h % DIMENSIONS, x if h >> 31 else -x) for h, x in hashes]
        if len(word) <= KEPT_CHARS:
            if len(_PARTS) >= KEPT_WORDS:
                _PARTS.clear()
            _PARTS[word] = found
    return found


def of_texts(texts: list[str]) -> list[list[float]]:
    """Unit vectors of texts; a text without words has the zero vector."""
    out = []
    for t in texts:
        sums = [0.0] * DIMENSIONS
        for word, n in Counter(w.lower() for w in re.findall(r"[A-Z]?[a-z0-9]+|[A-Z]+", t)).items():
            for place, x in _parts(word):
                sums[place] += n * x
        v = np.array(sums)
        norm = np.sqrt((v * v).sum())
        out.append([float(x) for x in (v / norm if norm else v).astype(np.float32)])
    return out


def vectors(texts: DataFrame) -> DataFrame:
    """Add the vector of embed_text."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(of_texts(list(batch)), dtype=object)

    # Short texts would be read by few tasks, but embedding is all work and no bytes.
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return texts.repartition(parts).withColumn("vector", run("embed_text"))


def with_reuse(texts: DataFrame, known: DataFrame | None) -> DataFrame:
    """(embed_text, vector, reused): vectors of an earlier snapshot where it has the text, else new ones."""
    if known is None:
        return vectors(texts.select("embed_text")).withColumn("reused", F.lit(False))
    before = known.where(F.size("vector") == DIMENSIONS).dropDuplicates(["embed_text"])
    old = texts.select("embed_text").join(before, "embed_text").withColumn("reused", F.lit(True))
    new = vectors(texts.select("embed_text").join(before, "embed_text", "left_anti")).withColumn("reused", F.lit(False))
    return old.unionByName(new)
