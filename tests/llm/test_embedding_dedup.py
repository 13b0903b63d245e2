"""Embedding links against brute force."""

import numpy as np

from quarrylake.llm import embedding_dedup as E
from tests.llm.test_components import plain


def brute(ids, x):
    y = x / np.linalg.norm(x, axis=1)[:, None]
    near = y @ y.T >= 0.95
    np.fill_diagonal(near, False)
    return dict(zip(ids, near.sum(1), strict=True)), plain([(ids[a], ids[b]) for a, b in np.argwhere(near)])


def test_links(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((30, 64))
    rows = [b / np.linalg.norm(b) + rng.standard_normal(64) * s for b in base[:6] for s in np.repeat([0.005, 0.02, 0.03], 60)]
    x = np.vstack([base, rows, np.repeat(base[:1], 40, 0), 3 * base[1:4]]).astype(np.float32)
    ids = [int(i) for i in rng.permutation(len(x)) + 5]
    odd = [(1, None), (2, [0.0] * 64), (3, [None] + [1.0] * 63), (4, [float("nan")] * 64), (0, [1.0, 2.0]), (None, x[0].tolist())]
    frame = spark.createDataFrame([(i, v.tolist(), "own") for i, v in zip(ids, x, strict=True)] + [(i, v, "own") for i, v in odd], "vec_id long, embedding array<float>, n_links string")
    got = {r["vec_id"]: r for r in E.near_duplicates(frame).collect()}
    links, part = brute(ids, x.astype(float))
    assert len(got) == len(ids) + 6
    missed = sum(abs(int(links[i]) - got[i]["n_links"]) for i in ids)
    assert missed <= 0.01 * sum(links.values()) and all(got[i]["n_links"] <= links[i] for i in ids)
    assert sum(got[i]["component_id"] != part.get(i, i) for i in ids) <= 3
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i, _ in odd)
    assert E.near_duplicates(frame.limit(0)).count() == 0


def test_code_pairs_up_to_the_promised_distance(spark):
    rng = np.random.default_rng(9)
    base = [int(v) for v in rng.integers(-(2**62), 2**62, 20)]
    flipped = [c ^ sum(1 << int(b) for b in rng.choice(62, d, replace=False)) for c in base for d in (1, 3, 5, 7)]
    codes = sorted({*base, *flipped})
    got = {(r["c1"], r["c2"]) for r in E.code_pairs(spark.createDataFrame([(c,) for c in codes], "code long"), 60_000).collect()}
    for a in codes:
        for b in codes:
            d = bin((a ^ b) & (2**64 - 1)).count("1")
            assert not (a < b and d <= 7) or (a, b) in got
            assert not (a, b) in got or (a < b and d <= E.REACH)


def test_the_reach_is_the_same_at_every_size(spark):
    rng = np.random.default_rng(10)
    base = [int(v) for v in rng.integers(-(2**62), 2**62, 15)]
    flipped = [c ^ sum(1 << int(b) for b in rng.choice(62, d, replace=False)) for c in base for d in (8, 11, 14)]
    codes = sorted({*base, *flipped})
    want = {(a, b) for a in codes for b in codes if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= E.REACH}
    frame = spark.createDataFrame([(c,) for c in codes], "code long")
    for number in (60_000, 2_000_000):
        assert {(r["c1"], r["c2"]) for r in E.code_pairs(frame, number).collect()} == want
    for number in (2, 10**3, 10**5, 10**7, 10**9):
        assert sum(flips + 1 for _, _, flips in E.layout(number)) > E.REACH


def test_links_at_the_least_cosine_lie_within_reach_with_and_without_a_mean():
    rng = np.random.default_rng(11)
    for mean in (0.0, 1.0, 2.0):
        x = E.unit(rng.standard_normal((8000, 64)) + mean * np.eye(64)[0] * 8)
        side = rng.standard_normal(x.shape)
        side = E.unit(side - (side * x).sum(1, keepdims=True) * x)
        y = 0.951 * x + np.sqrt(1 - 0.951**2) * side
        fitted = E.learn_rotation(x[:4000])
        apart = np.bitwise_count(E.codes_of(x, *fitted).view(np.uint64) ^ E.codes_of(y, *fitted).view(np.uint64))[4000:]
        reach = E.reach_of(x[:4000], *fitted, 0.95)
        print("mean", mean, "reach", reach, "share within", (apart <= reach).mean(), "within 14", (apart <= 14).mean())
        assert (apart <= reach).mean() > 0.998


def test_links_of_large_tables(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = E.unit(rng.standard_normal((3000, 64)) + np.eye(64)[0] * 8)
    side = E.unit((side := rng.standard_normal(x.shape)) - (side * x).sum(1, keepdims=True) * x)
    both = np.vstack([x, 0.951 * x + np.sqrt(1 - 0.951**2) * side])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(both)], "vec_id long, embedding array<double>")
    own = E.code_pairs
    for number in (65_000, 1_000_000):  # the tables of so many codes, on few
        monkeypatch.setattr(E, "code_pairs", lambda cells, _, *reach, n=number: own(cells, n, *reach))
        found = sum(r["n_links"] > 0 for r in E.near_duplicates(frame).collect()) / len(both)
        print("number", number, "links found", found)
        assert found > 0.995


def test_query_recall(spark):
    import duckdb

    from quarrylake.llm.queries import op7_embedding_dedup

    sf = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"select vec_id, embedding from '{sf}/embeddings.parquet'").fetchall()
    links, part = brute([r[0] for r in rows], np.array([r[1] for r in rows], float))
    for r in op7_embedding_dedup(spark, sf).collect():
        assert (r["n_links"], r["component_id"]) == (links[r["vec_id"]], part.get(r["vec_id"], r["vec_id"]))
