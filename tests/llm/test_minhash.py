"""ProbMinHash against the exact similarity; groups against brute force over all pairs."""

import itertools
import math
import re
from collections import Counter

import duckdb
import numpy as np

from quarrylake.llm import minhash as M
from tests.llm.test_components import plain


def bag(text):
    w = re.findall(r"[a-z0-9_\u0080-\U0010ffff]+", text.lower())
    s = [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] * bool(w)
    return {k: 1 + math.log(v) for k, v in Counter(s).items()}


def exact(x, y):
    return sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x.keys() | y.keys()) for d in x.keys() & y.keys())


def test_similarity_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(30):
        a, b = (" ".join(rng.choice(["x", "y"], 12)) for _ in range(2))
        doc, element, weight = M.shingles([a, b])
        parts = [(element[doc == k], weight[doc == k]) for k in (0, 1)]
        assert math.isclose(M.similarity(*parts), exact(bag(a), bag(b)), abs_tol=1e-9)


def test_blocks_of_a_long_text_change_nothing(monkeypatch):
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["a", "bcd", "é", "x" * 40, ",", "\n"], n)) for n in (0, 1, 7, 400)] + ["y" * 500]
    whole = M.shingles(texts)
    for size in (1, 10, 37, 100):
        monkeypatch.setattr(M, "CHUNK", size)
        assert all((a == b).all() for a, b in zip(whole, M.shingles(texts), strict=True))


def test_registers_estimate_it():
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in rng.integers(0, 50, 400)]
    other = words[:330] + [f"v{k}" for k in range(70)]
    texts = [" ".join(words), " ".join(other), "one two three"]
    doc, element, weight = M.shingles(texts)
    sig = M.signatures(3, doc, element, weight, 4000)
    assert abs((sig[0] == sig[1]).mean() - exact(bag(texts[0]), bag(texts[1]))) < 0.04
    again = M.signatures(1, *[x[doc == 1] if k else np.zeros((doc == 1).sum(), int) for k, x in enumerate((doc, element, weight))], 4000)
    assert (again[0] == sig[1]).all() and len(set(sig[2])) == 1


def brute(rows, least=0.8):
    edges, bags = [], [(i, t, bag(t or "")) for i, t in rows]
    for (i, s, a), (j, t, b) in itertools.combinations(bags, 2):
        if (s or "") == (t or "") or (a and b and min(len(a), len(b)) >= 0.5 * max(len(a), len(b)) and a.keys() & b.keys() and exact(a, b) >= least):
            edges.append((i, j))
    return plain(edges)


def test_groups(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [list(rng.choice(vocabulary, n)) for n in (40, 120, 300)]
    rows = []
    for b in base:
        for _ in range(25):
            c = list(b)
            for k in rng.integers(0, len(c), rng.integers(0, max(2, len(c) // 40))):
                c[k] = "zz"
            rows.append(" ".join(c))
    rows += ["", None, "  ", "one two", "One two", "one two", "." * 50, " ".join(rng.choice(vocabulary, 30000))] + [" ".join(rng.choice(vocabulary, 60)) for _ in range(20)]
    rows = list(enumerate(rows))
    docs = spark.createDataFrame([(i, t, "own") for i, t in rows] + [(None, rows[0][1], "own"), (3, rows[3][1], "own")], "doc_id long, text string, component_id string")
    got = M.near_duplicates(docs).collect()
    assert len(got) == len(rows) + 2
    want = brute(rows)
    assert len({want.get(i, i) for i in range(75)}) < 40
    for r in got:
        assert r["component_id"] == (want.get(r["doc_id"], r["doc_id"])) and r["kept"] == (r["doc_id"] == r["component_id"])
    assert M.near_duplicates(docs.limit(0)).count() == 0


def test_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 7)
    rng = np.random.default_rng(6)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(60):
        c = list(base)
        for k in rng.integers(0, len(c), i % 7):
            c[k] = f"x{i}"
        rows.append((i, " ".join(c)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert [r["doc_id"] for r in M.near_duplicates(docs).collect() if r["component_id"] != want.get(r["doc_id"], r["doc_id"])] == []


def test_query(spark):
    from quarrylake.llm.queries import op8_minhash

    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r["component_id"] for r in op8_minhash(spark, sf).collect()}
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet' order by doc_id").fetchall()
    owner = {}
    keys = [(i, t, set(bag(t))) for i, t in rows]
    near = {}
    for i, t, k in keys:
        for s in k:
            near.setdefault(s, []).append(i)
    bags = {i: bag(t) for i, t, _ in keys}
    shared = Counter(p for v in near.values() if len(v) < 60 for p in itertools.combinations(v, 2))
    edges = [p for p, n in shared.items() if n >= 0.6 * max(len(bags[p[0]]), len(bags[p[1]])) and exact(bags[p[0]], bags[p[1]]) >= 0.8]
    want = plain(edges)
    wrong = [i for i, _ in rows if got[i] != want.get(i, i)]
    assert len(wrong) <= 2, wrong


def test_two_texts_under_one_id(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(3, b), (5, a), (5, b), (5, a + " more"), (7, a), (7, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, digest string")
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in M.near_duplicates(docs).collect())
    assert [g[:2] for g in got] == [(3, 3), (5, 3), (5, 5), (5, 5), (7, 5), (7, 7), (8, 7)] and sum(k for _, _, k in got) == 3
    kept = sorted((r["doc_id"], r["text"] or "") for r in M.one_of_each(docs).collect())
    assert len(kept) == 3 and kept[0] == (3, b) and kept[1][0] == 5 and kept[1][1].startswith(a) and kept[2] == (7, "")


def test_blocks_by_bytes_give_the_same(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = sorted(map(tuple, M.near_duplicates(docs).collect()))
    monkeypatch.setattr(M, "BLOCK_BYTES", 3000)
    assert sorted(map(tuple, M.near_duplicates(docs).collect())) == want
