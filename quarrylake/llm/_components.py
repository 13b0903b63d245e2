"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.llm import _common as C

MOST_ROUNDS = 60


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component_id) of every id that an edge (u, v) touches; component_id is the smallest id reachable.

    Each star reads tables written to the shared folder, so both sides of its
    join are plain exchanges that Spark can split where one hub has many edges,
    and neighbourhoods are only ever reduced to their smallest member, never
    gathered. The number of rounds grows with the logarithm of the graph's size; a
    round's tables are deleted when the next one is written.
    """
    now = C.spill(_apart(edges.select("u", "v")), name)
    before = None
    for _ in range(MOST_ROUNDS):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before, old = state, now
        middle = _large_star(old, name)
        now = _small_star(middle, name)
        C.drop(old, middle)
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component_id"))).distinct()


def _apart(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger to its smaller end; loops go."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame, name: str) -> DataFrame:
    """Larger neighbours of each node are tied to the smallest in its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = C.spill(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), name)
    out = C.spill(_apart(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))), name)
    C.drop(least)
    return out


def _small_star(edges: DataFrame, name: str) -> DataFrame:
    """Smaller neighbours of each node, and the node, are tied to the smallest of them."""
    least = C.spill(edges.groupBy("u").agg(F.min("v").alias("m")), name)
    tied = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = C.spill(_apart(tied.unionByName(least.select("u", F.col("m").alias("v")))), name)
    C.drop(least)
    return out
