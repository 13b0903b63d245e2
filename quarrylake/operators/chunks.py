"""Overlapping line chunks that leave no gap."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.functions import text as X
from quarrylake.functions.batches import slices

CHUNK = ["ord int", "start_line int", "end_line int", "text string", "token_est int"]


def spans(text: str, target: int = X.CHUNK_TOKENS, overlap: int = X.CHUNK_OVERLAP, most: int = X.CHUNK_LINES) -> list[tuple[int, int]]:
    """Line spans (from zero, end excluded) of a text's chunks.

    A chunk ends with the line that brings its estimate to the target. The next
    begins ``overlap`` lines before that, if this is past the chunk's own start.
    One search in the running sums per chunk, not one step per line.
    """
    if not text:
        return []
    cost = [0, *accumulate(-(-len(line) // X.CHARS_PER_TOKEN) + 1 for line in text.split("\n"))]
    n, start, out = len(cost) - 1, 0, []
    while True:
        end = min(bisect_left(cost, cost[start] + target, start + 1), start + most, n)
        out.append((start, end))
        if end >= n:
            return out
        start = end - overlap if end - overlap > start else end


def chunks(files: DataFrame, key: list[str], text: str = "text", target: int = X.CHUNK_TOKENS, overlap: int = X.CHUNK_OVERLAP) -> DataFrame:
    """(key, ord, start_line, end_line, text, token_est) of every chunk of every file."""
    given = files.select(*key, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    names, kinds = [*key, *(c.split()[0] for c in CHUNK)], [given.schema[c].dataType.simpleString() for c in key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches):
            rows, ords, starts, ends, bodies, tokens = [], [], [], [], [], []
            for row, t in enumerate(some.column(len(key)).to_pylist()):
                lines = t.split("\n")
                for k, (a, b) in enumerate(spans(t, target, overlap)):
                    body = "\n".join(lines[a:b])
                    rows.append(row)
                    ords.append(k)
                    starts.append(a + 1)
                    ends.append(b)
                    bodies.append(body)
                    tokens.append(-(-len(body) // X.CHARS_PER_TOKEN))
            own = pa.array(rows, pa.int64())
            made = [pa.array(v, t) for v, t in zip((ords, starts, ends, bodies, tokens), (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(some.column(k).take(own) for k in range(len(key))), *made], names)

    return given.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in zip(key, kinds, strict=True)), *CHUNK]))
