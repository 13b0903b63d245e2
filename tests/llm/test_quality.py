"""The quality classifier: accuracy on held-out labels, the defined cases."""

import duckdb
import numpy as np

from quarrylake.llm import quality as Q
from quarrylake.llm import _training as L
from quarrylake.llm.queries import op9_quality


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    return (rank[y == 1].mean() - rank[y == 0].mean()) / len(score) + 0.5


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = op9_quality(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    m = got.merge(labels, on="doc_id")
    m = m[m.held_out]
    assert len(got) == 10000 and got.score.between(0, 1).all()
    print("auc", auc(m.score.to_numpy(), m.quality.to_numpy()), "acc", (m.predicted == m.quality).mean(), m.groupby("quality").predicted.mean().to_dict())
    assert auc(m.score.to_numpy(), m.quality.to_numpy()) > 0.97 and (m.predicted == m.quality).mean() > 0.95


def test_statistics_have_one_size():
    for t in ["", " ", "\n\n", "a", "é" * 10, "x | y |\n|", "word " * 3000]:
        assert Q.statistics(t).shape == (Q.STATISTICS,) and np.isfinite(Q.statistics(t)).all()


def test_cases(spark):
    docs = spark.createDataFrame([(1, None, "own"), (2, "", "own"), (2, "", "own"), (None, "a b", "own")], "doc_id long, text string, score string")
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = Q.train(docs, empty)
    rows = Q.add_score(docs, model).collect()
    assert [r["score"] for r in rows] == [0.5] * 4 and Q.keep_good(docs, model).count() == 4
    assert Q.keep_good(docs, model).columns == ["doc_id", "text", "score"]
    one = spark.createDataFrame([(1, 1, None), (2, None, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert Q.add_score(docs, Q.train(docs, one)).first()["score"] in (0.5, 1.0)
    assert Q.add_score(docs.limit(0), model).count() == 0


def test_isotonic_never_falls():
    rng = np.random.default_rng(0)
    s = rng.normal(size=500)
    iso = L.Isotonic(s, (rng.random(500) < 1 / (1 + np.exp(-s))).astype(float))
    out = iso(np.linspace(-4, 4, 200))
    assert (np.diff(out) >= 0).all() and out[0] < 0.2 and out[-1] > 0.8


def test_features_are_the_gaussian_kernel():
    """Products of cosines against the kernel itself, and ridge scores against those of the exact kernel machine."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, Q.STATISTICS))
    model = Q.Model(np.zeros(Q.STATISTICS), np.ones(Q.STATISTICS), features=20_000)
    z = model.cosines(x)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * Q.WIDTH**2))
    assert np.abs(z @ z.T - kernel).max() < 0.06
    y = np.sin(x[:, 0])
    exact = kernel @ np.linalg.solve(kernel + 0.1 * np.eye(60), y)
    got = z @ z.T @ np.linalg.solve(z @ z.T + 0.1 * np.eye(60), y)
    assert np.abs(exact - got).max() < 0.2


def test_weights_are_those_of_the_normal_equations(spark):
    """The partition sums against one solve over all rows on the driver."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(["good", "plain", "text."], 30)) if i % 3 else "!!! $$$ " * int(rng.integers(1, 30)), int(i % 3 > 0)) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = Q.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"))
    used = [r["doc_id"] for r in docs.where(~Q.C.held_out(Q.F.col("doc_id"), 4, 2)).collect()]
    aside = {r["doc_id"] for r in docs.where(Q.F.pmod(Q.F.xxhash64("doc_id", Q.F.lit(3)), Q.F.lit(Q.CALIBRATE)) == 0).collect()}
    x = np.array([Q.statistics(rows[i][1]) for i in used])
    y = np.array([rows[i][2] for i in used], float)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, np.maximum(x.std(0), 1e-9**0.5))
    fit = np.array([i not in aside for i in used])
    z, w = model.cosines(x[fit]), np.where(y[fit] == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    a = (z * w[:, None]).T @ z
    want = np.linalg.solve(a + Q.RIDGE * max(1.0, a.trace() / len(a)) * np.eye(len(a)), (z * w[:, None]).T @ y[fit])
    assert np.allclose(model.cosines(x) @ model.weights, model.cosines(x) @ want, atol=1e-6)
    scored = Q.add_score(docs, model).orderBy("doc_id").collect()
    assert np.allclose([r["score"] for r in scored], model.calibrate(model.cosines(np.array([Q.statistics(r[1]) for r in rows])) @ want), atol=1e-3)


def brute_isotonic(y, w):
    """The largest over starts of the smallest over ends of the mean between them."""
    n = len(y)
    mean = lambda a, b: (y[a : b + 1] * w[a : b + 1]).sum() / w[a : b + 1].sum()
    return [max(min(mean(a, b) for b in range(k, n)) for a in range(k + 1)) for k in range(n)]


def test_isotonic_is_the_least_squares_one():
    rng = np.random.default_rng(9)
    s, y, w = np.arange(40.0), rng.random(40), rng.integers(1, 5, 40).astype(float)
    assert np.allclose(L.Isotonic(s, y, w).share_at(s), brute_isotonic(y, w))
    merged = L.Isotonic(np.arange(900.0), np.arange(900) / 900, most_pools=20)
    assert len(merged.at) <= 42 and np.abs(merged.share_at(np.arange(900.0)) - np.arange(900) / 900).max() < 0.06


def test_very_long_text(spark):
    assert np.isfinite(Q.statistics("word " * 500_000 + "x" * 1_000_000)).all()
