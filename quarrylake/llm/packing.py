"""Best-fit packing of tokenised documents into sequences: minimum bin slack.

:func:`cut` tokenises documents and cuts those longer than a sequence;
:func:`pack` gives each piece a sequence and a place in it. How many pieces
there are of each length (at most one count per possible length) decides the
plan: for each bin, the longest piece left is set and a bitset subset-sum
dynamic program over the lengths still available finds the fullest combination,
which is used as many times as the counts allow and then removed. Only that
histogram reaches the driver; its size is bounded by the capacity. Pieces find
their place by their rank among pieces of equal length, counted in salted groups.

Defined cases: a null or empty text is one piece with the end token alone; a very
long text is encoded in segments and cut into as many pieces as it needs; repeated
rows are packed each; extra columns are left out; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.llm import _common as C
from quarrylake.llm import byte_bpe

CAPACITY = 1024
END_ID = 2
#: Pieces of one length are ranked in groups of about this many.
RANK_GROUP = 100_000
#: At least so many groups per length, so that one common length is spread over tasks.
LEAST_GROUPS = 32
#: Bytes of pieces that a task holds before it sends them on, about.
HELD = 1_000_000


def cut(docs: DataFrame, capacity: int = CAPACITY, file: str = byte_bpe.DEFAULT_FILE, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Tokenise ``text`` and cut it: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document's ids are its text's and the end id. A longer document is cut so
    that all pieces but the first have the full length.
    """
    fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = byte_bpe.load(file), end_id.to_bytes(4, "little")
        for batch in batches:
            texts = batch.column(1)
            encoder.check([texts[k].as_py() for k in range(0, batch.num_rows, byte_bpe.CHECK_EVERY)], 1)
            rows: list[list] = [[] for _ in fields]
            taken: list[int] = []
            held = 0
            for k in range(batch.num_rows):
                data = encoder.ids(texts[k].as_py()) + end
                n = len(data) // 4
                begin, stop, piece = 0, (n % capacity or capacity) if n > capacity else n, 0
                while begin < n:
                    part = data[4 * begin : 4 * stop]
                    for column, value in zip(rows, (piece, begin, stop - begin, C.crc(part), np.frombuffer(part, "<i4")), strict=False):
                        column.append(value)
                    taken.append(k)
                    held += len(part) if with_ids else 32
                    begin, stop, piece = stop, stop + capacity, piece + 1
                if held > HELD or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(taken, pa.int32())), *(pa.array(c, t) for c, (_, t) in zip(rows, fields, strict=True))], ["doc_id", *(n for n, _ in fields)])
                    rows, taken, held = [[] for _ in fields], [], 0

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", C.whole_text().alias("text")).mapInArrow(run, schema)


def fullest(left: dict[int, int], capacity: int) -> dict[int, int]:
    """The fullest feasible combination of lengths that contains the longest one left."""
    longest = max(left)
    room = capacity - longest
    whole = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in left if x <= room), reverse=True):
        copies = min(left[length] - (length == longest), room // length)
        steps.append((length, copies, reach))
        part = 1
        while copies > 0:
            reach |= reach << (min(part, copies) * length)
            copies -= part
            part *= 2
        reach &= whole
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    chosen = {longest: 1}
    for length, copies, before in reversed(steps):
        used = next(u for u in range(copies + 1) if total - u * length >= 0 and before >> (total - u * length) & 1)
        if used:
            chosen[length] = chosen.get(length, 0) + used
            total -= used * length
    return chosen


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, uses per sequence, first offset), sorted by length and rank."""
    left = {k: v for k, v in counts.items() if v}
    ranked: dict[int, int] = {}
    rows, sequence = [], 0
    while left:
        chosen = fullest(left, capacity)
        times = min(left[k] // u for k, u in chosen.items())
        offset = 0
        for length, uses in chosen.items():
            rows.append((length, ranked.get(length, 0), sequence, uses, offset))
            ranked[length] = ranked.get(length, 0) + times * uses
            offset += uses * length
            left[length] -= times * uses
            if not left[length]:
                del left[length]
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length and any others); no piece may exceed the capacity.

    ``pieces`` is read three times: pass a table, such as :func:`cut`'s result spilled.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = plan(counts, capacity)
    groups = max(LEAST_GROUPS, -(-sum(counts.values()) // RANK_GROUP))
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    sizes = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.partitionBy("length").orderBy("__salt")) - F.col("__n")).drop("__n")
    own = F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "piece"))
    ranked = salted.withColumn("__own", own).join(before, ["length", "__salt"]).withColumn("__rank", F.col("__before") + F.col("__own") - 1)
    shared = spark.sparkContext.broadcast(places)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        rows = shared.value
        step = np.int64(1) << 42
        at = np.searchsorted(rows[:, 0] * step + rows[:, 1], length.to_numpy() * step + rank.to_numpy(), side="right") - 1
        _, first, sequence, uses, offset = rows[at].T
        copy, slot = np.divmod(rank.to_numpy() - first, np.maximum(uses, 1))
        return pd.DataFrame({"sequence_id": sequence + copy, "offset": offset + slot * length.to_numpy()})

    placed = ranked.withColumn("__at", place("length", "__rank"))
    keep = C.without(pieces.columns, ["sequence_id", "offset"])
    return placed.select(*keep, "__at.sequence_id", "__at.offset")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, file: str = byte_bpe.DEFAULT_FILE, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Cut documents and pack the pieces; with_ids: keep the ids of each piece."""
    return pack(C.spill(cut(docs, capacity, file, end_id, with_ids), "pieces"), capacity)
