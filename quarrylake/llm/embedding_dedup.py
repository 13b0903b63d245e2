"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

A rotation learnt on a bounded sample turns vectors into balanced 64-bit codes.
Codes are cut into substrings; every code is stored under each of its substrings
and looked up under those some bits away, so many in each table that all pairs of
codes up to the reach are found, whatever the size of the table (:func:`layout`).
The reach is REACH bits, or more where codes of the sample and of partners at the
least cosine are further apart, as in data with a mean (:func:`reach_of`). Pairs
of codes that are near enough are then compared vector by vector on the original
values, in blocks of bounded size. Pairs of vectors are never written out: a block
gives each vector the number of its links there and one edge to the smallest
member of its part. Pairs of different codes within reach are rows, though, so a
dense group of vectors with many different codes costs rows by the square of its
codes; vectors of one code do not.

Equal vectors are one class with a count before that.

Defined cases: vectors that are null, zero, hold null or non-finite components,
or have not the length that most vectors have, and rows without an id, link with
nothing; a repeated row counts as another vector; extra columns are left out; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.llm import _common as C
from quarrylake.llm._components import components

COSINE = 0.95
BITS = 64
#: All codes up to so many bits apart are compared, at least; vectors at a cosine of 0.95 are about 6.5 bits apart.
REACH = 14
#: What one row of a probe costs, in comparisons of two codes.
PROBE_COST = 64
#: Vectors that the rotation is learnt on, about.
SAMPLE = 20_000
#: Vectors of one code that are compared in one task with as many others.
BLOCK = 256


def usable(vector: Column, size: int) -> Column:
    """True for a vector of the size, of finite numbers that are not all zero."""
    number = F.size(vector) == size
    return F.coalesce(vector.isNotNull() & number & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without overflow for large numbers."""
    if not x.size:
        return x
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def learn_rotation(x: np.ndarray, bits: int = BITS, rounds: int = 40, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and the projection (dimensions x bits) that keeps most of the variance and is turned towards the corners of the cube."""
    rng = np.random.default_rng(seed)
    mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
    z = x - mean
    _, axes = np.linalg.eigh(z.T @ z) if len(x) else (None, np.eye(x.shape[1]))
    base = axes[:, ::-1][:, :bits]
    if base.shape[1] < bits:
        base = base @ rng.standard_normal((base.shape[1], bits)) / np.sqrt(bits)
    z = z @ base
    turn = np.linalg.qr(rng.standard_normal((bits, bits)))[0]
    for _ in range(rounds if len(x) else 0):
        corner = np.where(z @ turn >= 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(z.T @ corner)
        turn = u @ v
    return mean, base @ turn


def codes_of(x: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """64-bit codes of rows, as signed numbers."""
    bits = (x - mean) @ turn >= 0
    return np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel()


def reach_of(x: np.ndarray, mean: np.ndarray, turn: np.ndarray, least: float, share: float = 0.9995, seed: int = 5) -> int:
    """Bits within which the codes of a share of unit rows and of partners at the least cosine lie, at least REACH.

    Partners lie in any direction, and in the direction of another row.
    """
    reach, rng = REACH, np.random.default_rng(seed)
    for toward in (rng.standard_normal(x.shape), x[rng.permutation(len(x))]):
        side = toward - (toward * x).sum(1, keepdims=True) * x
        length = np.sqrt((side * side).sum(1))
        some = length > 1e-9
        if some.any():
            one = x[some]
            two = least * one + np.sqrt(max(0.0, 1 - least * least)) * side[some] / length[some, None]
            apart = np.bitwise_count(codes_of(one, mean, turn).view(np.uint64) ^ codes_of(two, mean, turn).view(np.uint64))
            reach = max(reach, int(np.quantile(apart, share, method="higher")))
    return reach


def layout(number: int, reach: int = REACH) -> list[tuple[int, int, int]]:
    """Tables (first bit, width, flips) for so many codes, the cheapest that find all pairs up to ``reach`` bits apart.

    If two codes differ by more than ``flips`` bits in each table, they differ by
    the sum of ``flips + 1`` at least, which is kept above ``reach``.
    """
    best: tuple[float, list[tuple[int, int, int]]] = (float("inf"), [])
    for tables in range(3, BITS // 4 + 1):
        edges = [BITS * k // tables for k in range(tables + 1)]
        width = [b - a for a, b in zip(edges, edges[1:], strict=False)]
        each = [PROBE_COST + number / 2**w for w in width]
        flips = [-1] * tables
        for _ in range(reach + 1):
            k = min((k for k in range(tables) if flips[k] < width[k]), key=lambda k: comb(width[k], flips[k] + 1) * each[k])
            flips[k] += 1
        cost = sum(each[k] * comb(width[k], d) for k in range(tables) for d in range(flips[k] + 1))
        best = min(best, (cost, [(a, w, t) for a, w, t in zip(edges, width, flips, strict=False) if t >= 0]))
    return best[1]


def code_pairs(cells: DataFrame, number: int, reach: int = REACH) -> DataFrame:
    """Pairs (c1 < c2) of distinct codes that are at most ``reach`` bits apart: all of them."""
    tables = layout(max(2, number), reach)
    masks = [[sum(1 << b for b in some) for d in range(t + 1) for some in combinations(range(w), d)] for _, w, t in tables]
    part = [F.struct(F.lit(k).alias("table"), F.shiftrightunsigned("code", at).bitwiseAND(F.lit((1 << w) - 1).cast("long")).cast("int").alias("part")) for k, (at, w, _) in enumerate(tables)]
    spread = cells.repartition("code")
    stored = spread.select("code", F.explode(F.array(*part)).alias("s")).select("code", "s.*")
    near = cells.sparkSession.createDataFrame([(k, m) for k, m in enumerate(masks)], "table int, flips array<int>")
    probes = stored.join(F.broadcast(near), "table").select(F.col("code").alias("c1"), "table", "part", F.explode("flips").alias("flip")).select("c1", "table", F.col("part").bitwiseXOR(F.col("flip")).alias("part"))
    close = (F.col("c1") < F.col("code")) & (F.bit_count(F.col("c1").bitwiseXOR(F.col("code"))) <= reach)
    # Both sides hold many rows for each code, more than the planner expects of so small a table: no broadcast.
    return probes.join(stored.hint("merge"), (probes["table"] == stored["table"]) & (probes["part"] == stored["part"]) & close).select("c1", F.col("code").alias("c2")).distinct()


def _parts(linked: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links, the smallest index that each row reaches."""
    label = np.arange(len(linked))
    reach = linked | np.eye(len(linked), dtype=bool)
    while True:
        new = np.where(reach, label[None, :], len(label)).min(1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Sorted rows of block pairs -> (rep, links, root)."""
    key, rows = None, []

    def told(rows) -> pa.RecordBatch:
        side = np.array([r[0] for r in rows])
        rep = np.array([r[1] for r in rows], np.int64)
        times = np.array([r[2] for r in rows], np.int64)
        x = np.frombuffer(b"".join(r[3] for r in rows), "<f8").reshape(len(rows), -1)
        linked = x @ x.T >= least
        np.fill_diagonal(linked, False)
        if side.any():
            linked &= side[:, None] != side[None, :]
        links = linked @ times
        some = np.flatnonzero(links)
        order = np.argsort(rep, kind="stable")
        label = np.empty(len(rep), np.int64)
        label[order] = order[_parts(linked[np.ix_(order, order)])]
        return pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(links[some]), pa.array(rep[label[some]])], ["rep", "links", "root"])

    for batch in batches:
        data = batch.to_pydict()
        for row in zip(data["c1"], data["b1"], data["c2"], data["b2"], data["side"], data["rep"], data["times"], data["vector"], strict=True):
            if row[:4] != key:
                if len(rows) > 1:
                    yield told(rows)
                key, rows = row[:4], []
            rows.append(row[4:])
    if len(rows) > 1:
        yield told(rows)


def near_duplicates(vectors: DataFrame, least: float = COSINE, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links (other vectors with a cosine of at least ``least``), component_id and kept."""
    spark = vectors.sparkSession
    given = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    usual = given.where("v is not null").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    size = usual["n"] if usual else 0
    fit = F.col("vec_id").isNotNull() & usable(F.col("v"), size)
    keyed = given.withColumn("k1", F.when(fit, F.xxhash64("v"))).withColumn("k2", F.when(fit, F.xxhash64(F.lit(2), "v")))
    grouped = keyed.where("k1 is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times"), F.max("v").alias("v"))
    classes = C.spill(grouped, "embedding-classes")
    number = classes.count()
    drawn = [r["v"] for r in classes.where(C.share_below(F.col("k1"), min(1.0, sample / max(1, number)))).select("v").collect()]
    x = np.array(drawn, np.float64).reshape(len(drawn), size)
    x = unit(x)
    mean, turn = learn_rotation(x) if size else (np.zeros(0), np.zeros((0, BITS)))
    reach = reach_of(x, mean, turn, least) if len(x) else REACH
    shared = spark.sparkContext.broadcast((mean, turn))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(batch.column(2).flatten().to_numpy().reshape(batch.num_rows, size))
            code = codes_of(x, *shared.value) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code), pa.array([r.tobytes() for r in x.astype("<f8")], pa.binary())], ["rep", "times", "code", "vector"])

    coded = C.spill(classes.select("rep", "times", "v").mapInArrow(encode, "rep long, times long, code long, vector binary"), "embedding-codes")
    cells = C.spill(coded.groupBy("code").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("long")), "embedding-cells")
    pairs = code_pairs(cells.select("code"), number, reach)
    one, two = (cells.select(F.col("code").alias(f"c{k}"), F.col("blocks").alias(f"n{k}"), F.col("n").alias(f"m{k}")) for k in (1, 2))
    tasks = pairs.join(one, "c1").join(two, "c2").unionByName(one.where("m1 > 1").select("c1", "n1", "m1", F.col("c1").alias("c2"), F.col("n1").alias("n2"), F.col("m1").alias("m2")))
    tasks = tasks.withColumn("b1", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n1") - 1))).withColumn("b2", F.explode(F.sequence(F.when(F.col("c1") == F.col("c2"), F.col("b1")).otherwise(F.lit(0).cast("long")), F.col("n2") - 1)))
    tasks = C.spill(tasks.select("c1", "b1", "c2", "b2"), "embedding-tasks")
    placed = C.spill(coded.join(cells.select("code", "blocks"), "code").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks")).drop("blocks"), "embedding-blocks")
    first = tasks.withColumn("code", F.col("c1")).withColumn("block", F.col("b1")).withColumn("side", F.lit(0))
    second = tasks.where("c1 <> c2 or b1 <> b2").withColumn("code", F.col("c2")).withColumn("block", F.col("b2")).withColumn("side", F.lit(1))
    order = ["c1", "b1", "c2", "b2"]
    rows = first.unionByName(second).join(placed, ["code", "block"]).select(*order, "side", "rep", "times", "vector")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = C.spill(rows.repartition(parts, *order).sortWithinPartitions(*order, "side").mapInArrow(lambda b: _compare(b, least), "rep long, links long, root long"), "embedding-links")
    label = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")), "embedding-components").withColumnRenamed("id", "rep")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    own = classes.select("k1", "k2", "rep", "times").join(links, "rep", "left").join(label, "rep", "left")
    result = C.spill(own.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")), "embedding-result")
    C.drop(classes, coded, cells, tasks, placed, found)
    out = keyed.select("vec_id", "k1", "k2").join(result, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
