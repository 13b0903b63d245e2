"""Shards: exact sizes, gapless slots, the law of the matrix, uniformity."""

import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from quarrylake.llm import sharding as S


def test_matrix_adds_up():
    for blocks, shards in (([5, 0, 17, 3], 4), ([2], 5), ([], 3), ([100] * 30, 7)):
        m = np.array(S.matrix(blocks, shards)).reshape(-1, shards)
        assert m.sum(1).tolist() == blocks and (not blocks or m.sum(0).tolist() == S.capacities(sum(blocks), shards).tolist())


def test_matrix_has_the_law_of_a_permutation():
    got = [S.matrix([6, 6], 3, seed)[0][0] for seed in range(3000)]
    n = Counter(got)
    from math import comb

    for k in range(5):
        p = comb(4, k) * comb(8, 6 - k) / comb(12, 6)
        assert abs(n[k] / 3000 - p) < 0.04


def test_large_draws():
    rng = np.random.default_rng(0)
    x = np.array([S.hypergeometric(rng, 10**10, 39 * 10**10, 4000) for _ in range(400)])
    assert abs(x.mean() - 100) < 2 and abs(x.std() - (4000 / 40 * 39 / 40) ** 0.5) < 1


def test_draws_have_the_exact_law():
    from math import comb

    rng = np.random.default_rng(2)
    for good, bad, draws in ((5, 7, 6), (1, 30, 4), (20, 3, 21), (40, 40, 3)):
        n = Counter(S.hypergeometric(rng, good, bad, draws) for _ in range(4000))
        for k in range(max(0, draws - bad), min(good, draws) + 1):
            p = comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws)
            assert abs(n[k] / 4000 - p) < 5 * (p * (1 - p) / 4000) ** 0.5 + 1e-9
        assert sum(n.values()) == 4000 and min(n) >= max(0, draws - bad) and max(n) <= min(good, draws)
    assert S.hypergeometric(rng, 0, 9, 4) == 0 and S.hypergeometric(rng, 9, 0, 4) == 4


def test_places_are_those_of_a_plain_permutation(spark):
    """Blocks, matrix, local permutation and exchange done again in plain Python."""
    rows = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(1).alias("size"))
    with_chance = rows.select("doc_id", *(F.xxhash64("doc_id", "size", F.lit(S.SEED + k)).alias(f"c{k}") for k in (1, 2, 3, 4))).collect()
    old, S.BLOCK_ROWS = S.BLOCK_ROWS, 60
    old_sub, S.SUB_ROWS = S.SUB_ROWS, 20
    try:
        got = {r["doc_id"]: (r["shard"], r["slot"]) for r in S.shuffle(rows, ["doc_id", "size"], 7).collect()}
    finally:
        S.BLOCK_ROWS, S.SUB_ROWS = old, old_sub
    blocks, subs = -(-500 // 60), -(-500 // (7 * 20))
    by_block = defaultdict(list)
    for r in with_chance:
        by_block[r["c1"] % blocks].append(r)
    sent = defaultdict(list)
    for b, row in enumerate(S.matrix([len(by_block[b]) for b in range(blocks)], 7, S.SEED)):
        own = sorted(by_block[b], key=lambda r: (r["c2"], r["doc_id"]))
        for shard, many in enumerate(row):
            sent[shard] += own[:many]
            own = own[many:]
    want = {r["doc_id"]: (shard, slot) for shard, some in sent.items() for slot, r in enumerate(sorted(some, key=lambda r: (r["c3"] % subs, r["c4"], r["doc_id"])))}
    assert got == want


def test_equal_rows_are_spread(spark):
    rows = spark.createDataFrame([(1, "same")] * 30_000, "doc_id long, text string")
    got = S.assign(rows, 4).collect()
    check(got, 30_000, 4)


def check(rows, n, shards):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert len(rows) == n and sum(map(len, by.values())) == n
    for s, slots in by.items():
        assert 0 <= s < shards and sorted(slots) == list(range(len(slots)))
    assert max(map(len, by.values()), default=0) - min([len(by[s]) for s in range(shards)] or [0]) <= 1


def test_cases(spark):
    texts = [None, "", "a", "é😀", "a", "x" * 10000]
    rows = [(i % 900, texts[i % 6], "own") for i in range(1000)] + [(None, "a", "own")] * 7
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = S.assign(docs, 16).collect()
    check(got, len(rows), 16)
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    check(S.assign(docs.limit(0), 4).collect(), 0, 4)
    check(S.assign(docs.limit(3), 40).collect(), 3, 40)


def test_it_mixes(spark):
    got = S.shuffle(spark.range(20000).withColumnRenamed("id", "doc_id"), ["doc_id"], 10).toPandas()
    table = got.groupby([got.doc_id // 2000, "shard"]).size().unstack(fill_value=0).to_numpy()
    assert ((table - 200) ** 2 / 200).sum() < 140
    assert abs(np.corrcoef(got.doc_id, got.slot)[0, 1]) < 0.03


def test_query(spark, small):
    from quarrylake.llm.queries import op5_sharding

    check(op5_sharding(spark, small).collect(), 200, 40)
