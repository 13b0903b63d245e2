"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows are dealt to blocks by a hash of themselves. From the blocks' sizes alone
the matrix of how many rows go from each block to each shard is drawn exactly as
a uniform permutation of all rows would give it (rows of the matrix are
multivariate hypergeometric draws from the room left in the shards). Each block
is then permuted by itself and cut as its row of the matrix says, rows are
exchanged, and each shard is permuted again, in sub-blocks of bounded size that
are laid one after another. Every shard has its exact size, and shards differ by
one row at most.

The draw is control code on the driver: it sees one number per block, and there
are at most MOST_BLOCKS blocks. Everything that touches rows is DataFrame
functions.

Defined cases: a null text has no bytes; rows without an id and repeated rows
are dealt like any other; with fewer rows than shards some shards are empty;
extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.llm import _common as C

SHARDS = 40
#: Rows of a block, about, while there are fewer than MOST_BLOCKS.
BLOCK_ROWS = 2_000
MOST_BLOCKS = 4_096
#: Rows of a sub-block of a shard, about.
SUB_ROWS = 20_000
SEED = 20_240_229
#: Standard deviations around the mode that a draw covers.
DEVIATIONS = 13


def capacities(rows: int, shards: int) -> np.ndarray:
    """Rows of each shard: as equal as can be, the first shards one more."""
    return np.full(shards, rows // shards) + (np.arange(shards) < rows % shards)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` rows without replacement are good.

    The weights of all numbers within DEVIATIONS standard deviations of the mode
    follow from one another by exact ratios, so none is computed from factorials,
    and the same way serves any number of rows; what lies further out has less
    weight than one rounding of the sum.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    rows = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (rows + 2)))
    reach = int(DEVIATIONS * (draws * (good / rows) * (bad / rows) * ((rows - draws) / max(1, rows - 1))) ** 0.5) + 40
    low, high = max(low, mode - reach), min(high, mode + reach)
    up = np.arange(mode, high, dtype=np.float64)
    down = np.arange(mode, low, -1, dtype=np.float64)
    above = np.cumprod((good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1)))
    below = np.cumprod(down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1)))
    total = np.cumsum(np.concatenate([below[::-1], [1.0], above]))
    return low + int(np.searchsorted(total, rng.random() * total[-1], side="right"))


def matrix(blocks: list[int], shards: int, seed: int = SEED) -> list[list[int]]:
    """Rows that go from each block to each shard."""
    rng = np.random.default_rng(seed)
    room = [int(x) for x in capacities(sum(blocks), shards)]
    out = []
    for size in blocks:
        left, rest, row = size, sum(room), []
        for s in range(shards):
            rest -= room[s]
            got = hypergeometric(rng, room[s], rest, left) if left and room[s] else 0
            room[s] -= got
            left -= got
            row.append(got)
        out.append(row)
    return out


def shuffle(rows: DataFrame, key: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Add shard (0 to shards - 1) and slot (gapless from 0 in each shard) to rows.

    ``key`` names the columns that tell rows apart; rows that are equal in all of
    them go to one block, so many equal rows need a number of their own among them.
    """
    number = rows.count()
    blocks = int(min(MOST_BLOCKS, max(1, -(-number // BLOCK_ROWS))))
    subs = int(max(1, -(-number // (shards * SUB_ROWS))))

    def chance(step: int) -> Column:
        return F.xxhash64(*key, F.lit(seed + step))

    dealt = rows.withColumn("__block", F.pmod(chance(1), F.lit(blocks)).cast("int"))
    sizes = {r["__block"]: r["n"] for r in dealt.groupBy("__block").agg(F.count("*").alias("n")).collect()}
    cuts = np.cumsum(matrix([sizes.get(b, 0) for b in range(blocks)], shards, seed), axis=1) if number else np.zeros((blocks, shards), int)
    sent = F.from_json(F.lit(json.dumps([{"b": b, "cuts": [int(x) for x in row]} for b, row in enumerate(cuts)])), "array<struct<b:int,cuts:array<bigint>>>")
    plan = rows.sparkSession.range(1).select(F.explode(sent).alias("p")).select(F.col("p.b").alias("__block"), F.col("p.cuts").alias("__cuts"))
    permuted = F.row_number().over(Window.partitionBy("__block").orderBy(chance(2), *key))
    # The plan has one row per block, at most MOST_BLOCKS.
    placed = dealt.withColumn("__at", permuted).join(F.broadcast(plan), "__block")
    shard = F.size(F.filter("__cuts", lambda c: c < F.col("__at"))).cast("int")
    placed = placed.withColumn("shard", shard).withColumn("__sub", F.pmod(chance(3), F.lit(subs)).cast("int")).drop("__block", "__at", "__cuts")
    counts = placed.groupBy("shard", "__sub").agg(F.count("*").alias("__n"))
    before = counts.select("shard", "__sub", (F.sum("__n").over(Window.partitionBy("shard").orderBy("__sub")) - F.col("__n")).alias("__before"))
    again = F.row_number().over(Window.partitionBy("shard", "__sub").orderBy(chance(4), *key))
    out = placed.withColumn("__own", again).join(before, ["shard", "__sub"])
    return out.withColumn("slot", F.col("__before") + F.col("__own") - 1).drop("__before", "__own", "__sub")


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document.

    The law is that of rows: shards hold numbers of documents that differ by one
    at most, whatever their texts' sizes.
    """
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(data) + 16).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    # Each row's number is written down with it, so that any number of equal rows is spread over blocks.
    numbered = C.spill(rows.withColumn("__nth", F.monotonically_increasing_id()), "sharding-rows")
    placed = shuffle(numbered, ["doc_id", "text_crc32", "size", "__nth"], shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
