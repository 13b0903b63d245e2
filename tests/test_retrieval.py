"""BM25 against SQLite's full-text index; diversification against a plain loop; vectors."""

import re
import sqlite3

import numpy as np
import pytest

from quarrylake.functions import text
from quarrylake.operators import postings as P
from quarrylake.operators import retrieval as R

UNITS = [
    (1, "parse_args and run", "the Parser", None),
    (2, "café Parser-args, parse args", "", "args"),
    (3, "", "", ""),
    (4, "run run RUN fast", "parse", "x args"),
    (5, "Ärger über Straße", "naïve", "run"),
    (6, "args parse", "parse.args", "the the the"),
]
QUERIES = ["parse_args", "run", "café", "parse args", "the parser", "-", "run - fast", "über strasse", "zzz", "RUN run", "parser-args parse"]


@pytest.fixture(scope="module")
def fts():
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(a, b, c, tokenize='unicode61 remove_diacritics 2')")
    con.executemany("insert into t(rowid, a, b, c) values (?, ?, ?, ?)", UNITS)
    return con


def test_bm25_is_that_of_sqlite(spark, fts):
    units = spark.createDataFrame(UNITS, "id long, a string, b string, c string")
    got = R.bm25(units, "id", ["a", "b", "c"], R.query_table(spark, {q: q for q in QUERIES})).collect()
    for q in QUERIES:
        match = " ".join('"' + w.replace('"', '""') + '"' for w in q.split())
        want = dict(fts.execute("select rowid, -bm25(t) from t where t match ?", (match,)).fetchall())
        own = {r["unit_id"]: r["score"] for r in got if r["query_id"] == q}
        assert own.keys() == want.keys(), q
        assert all(abs(own[k] - want[k]) < 1e-9 for k in own), q


def test_bm25_on_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(a, tokenize='unicode61 remove_diacritics 2')")
    con.executemany("insert into t(rowid, a) values (?, ?)", [(r["doc_id"] + 1, r["text"]) for r in docs.collect()])
    queries = {"a": "the of", "b": "tion and", "c": "thing"}
    got = R.bm25(docs, "doc_id", ["text"], R.query_table(spark, queries)).collect()
    for name, q in queries.items():
        want = {i - 1: s for i, s in con.execute("select rowid, -bm25(t) from t where t match ?", (" ".join(f'"{w}"' for w in q.split()),))}
        own = {r["unit_id"]: r["score"] for r in got if r["query_id"] == name}
        assert own.keys() == want.keys() and all(abs(own[k] - want[k]) < 1e-9 for k in own)


def test_phrases():
    assert text.phrases("foo_bar  -\nÉté") == [["foo", "bar"], ["ete"]] and text.phrases(" ") == []


def plain_mmr(scores, bags, k):
    if len(scores) <= 1:
        return list(range(min(k, len(scores))))
    top = scores[0] if scores[0] > 0 else 1.0
    chosen, pool = [0], list(range(1, len(scores)))
    while pool and len(chosen) < k:
        best = None
        for i in pool:
            red = max((len(bags[i] & bags[s]) / len(bags[i] | bags[s])) if bags[i] and bags[s] else 0.0 for s in chosen)
            value = 0.5 * scores[i] / top - 0.5 * red
            if best is None or value > best[0]:
                best = (value, i)
        if best[0] <= 0 or scores[best[1]] / top < 0.1:
            break
        chosen.append(best[1])
        pool.remove(best[1])
    return chosen


def test_selection_is_that_of_the_plain_loop(spark):
    rng = np.random.default_rng(1)
    rows = []
    for q in range(20):
        n = int(rng.integers(1, 15))
        scores = sorted((round(float(x), 3) for x in rng.random(n)), reverse=True)
        snippets = [" ".join(rng.choice(["aa", "bb", "cc", "dd", "ee", "ff"], rng.integers(0, 5))) for _ in range(n)]
        assert R.select(scores, [R.tokens(None, s) for s in snippets], 6) == plain_mmr(scores, [set(re.findall("[a-z]+", s)) for s in snippets], 6)
        rows += [(q, k, s, None, t) for k, (s, t) in enumerate(zip(scores, snippets, strict=True))]
    got = R.diversify(spark.createDataFrame(rows, "query_id long, place int, score double, name string, snippet string"), 6).collect()
    assert {r["query_id"] for r in got} == set(range(20))


def test_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 8))
    vectors = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [1.0])], "id long, v array<float>")
    asked = vectors.where("id < 5").selectExpr("id as query_id", "v as vector")
    y = x.astype(np.float32).astype(float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    got = R.vector_top(vectors, "id", "v", asked, 4).collect()
    for q in range(5):
        own = [r["unit_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        assert own == list(np.argsort(-(y @ y[q]), kind="stable")[:4])


def indexed(spark, tmp_path, rows, columns, block, monkeypatch, schema):
    monkeypatch.setattr(P, "BLOCK", block)
    path = str(tmp_path / f"index-{block}")
    P.write_index(spark.createDataFrame(rows, schema), "id", columns, path)
    return P.Index(spark, path)


@pytest.mark.parametrize("block", [2, 256])
def test_index_scores_as_sqlite(spark, fts, tmp_path, monkeypatch, block):
    index = indexed(spark, tmp_path, UNITS, ["a", "b", "c"], block, monkeypatch, "id long, a string, b string, c string")
    asked = R.query_table(spark, {q: q for q in QUERIES})
    got, best = index.all(asked).collect(), index.top(asked, 2).collect()
    for q in QUERIES:
        match = " ".join('"' + w.replace('"', '""') + '"' for w in q.split())
        want = dict(fts.execute("select rowid, -bm25(t) from t where t match ?", (match,)).fetchall())
        own = {r["unit_id"]: r["score"] for r in got if r["query_id"] == q}
        assert own.keys() == want.keys() and all(abs(own[k] - want[k]) < 1e-9 for k in own), q
        order = sorted(((-round(s, 6), u) for u, s in want.items()))[:2]
        assert [(r["unit_id"], r["score"]) for r in sorted((r for r in best if r["query_id"] == q), key=lambda r: r["rank"])] == [(u, -s) for s, u in order], q
    words = [w for p in text.phrases("the parser") for w in p]
    assert [r["unit_id"] for r in index.all(R.query_table(spark, {"q": "the parser"}), words).collect()] == [1]


def test_blocks_are_skipped_and_nothing_is_lost(spark, tmp_path, monkeypatch):
    draw = np.random.default_rng(4)
    words = [f"w{k}" for k in range(30)]
    rows = [(i, " ".join(draw.choice(words, draw.integers(1, 40), p=np.arange(30, 0, -1) / 465)) + (" w20 w21" * 9 if i % 97 == 0 else "")) for i in range(3000)]
    index = indexed(spark, tmp_path, rows, ["a"], 32, monkeypatch, "id long, a string")
    asked = R.query_table(spark, {"two": "w20 w21", "phrase": "w20-w21", "rare": "w28 w29", "none": "w0 nowhere"})
    every = index.all(asked).collect()
    for q in ("two", "phrase", "rare", "none"):
        want = sorted((-round(r["score"], 6), r["unit_id"]) for r in every if r["query_id"] == q)[:5]
        assert [(-r["score"], r["unit_id"]) for r in sorted((r for r in index.top(asked, 5).collect() if r["query_id"] == q), key=lambda r: r["rank"])] == want
    found = index._phrases(asked, None)
    weights = index._weights(found, asked)
    blocks = index.bounded(found, weights).where("query_id = 'two'").collect()
    least = sorted((r["score"] for r in every if r["query_id"] == "two"), reverse=True)[4]
    assert len(blocks) > 50 and sum(r["bound"] >= least for r in blocks) < len(blocks) / 2
    assert max(r["score"] for r in every if r["query_id"] == "two") <= max(b["bound"] for b in blocks) + 1e-9


def test_index_of_odd_units(spark, tmp_path, monkeypatch):
    rows = [(1, None), (2, ""), (3, "x " * 300_000), (4, "x y"), (4, "x y"), (None, "y")]
    index = indexed(spark, tmp_path, rows, ["a"], 4, monkeypatch, "id long, a string")
    assert {(r["term"], r["units"], r["occurrences"]) for r in index.terms().collect()} == {("x", 3, 300_002), ("y", 3, 3)}
    assert sorted((r["unit_id"] or 0) for r in index.all(R.query_table(spark, {"q": "y"})).collect()) == [0, 4, 4]
    empty = indexed(spark, tmp_path, [], ["a"], 8, monkeypatch, "id long, a string")
    assert empty.top(R.query_table(spark, {"q": "y"}), 3).count() == 0


def test_vectors_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERY_BLOCK", 7)
    monkeypatch.setattr(R, "VECTOR_BLOCK", 13)
    draw = np.random.default_rng(1)
    vectors = [(i, draw.normal(size=8).tolist()) for i in range(200)] + [(300, None), (301, [0.0] * 8), (302, [1.0] * 3), (303, [1.0] * 8), (304, [2.0] * 8)]
    base = spark.createDataFrame(vectors, "id long, v array<double>")
    asked = base.where("id % 4 = 0 or id >= 300").selectExpr("id as query_id", "v as vector")
    got = {}
    for r in R.vector_top(base, "id", "v", asked, 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["unit_id"], r["score"]))
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1.0)
    for q, v in vectors:
        if v is None or not (q % 4 == 0 or q >= 300):
            assert q not in got
            continue
        want = sorted((-round(float(unit(v) @ unit(w)), 6), i) for i, w in vectors if w is not None and len(w) == len(v))[:5]
        assert [(i, s) for _, i, s in sorted(got[q])] == [(i, pytest.approx(-s, abs=2e-6)) for s, i in want]


def test_slices_hold_all_rows_within_bounds():
    import pyarrow as pa

    from quarrylake.functions.batches import slices

    sizes = [10, 5000, 1, 0, 900, 900, 900] + [3] * 40
    whole = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), pa.array(["x" * n for n in sizes])], ["id", "t"])
    got = list(slices([whole, whole.slice(2, 0)], rows=16, most=1500))
    assert [i for b in got for i in b.column(0).to_pylist()] == list(range(len(sizes)))
    assert all(b.num_rows <= 16 and (b.num_rows == 1 or b.nbytes <= 1500) for b in got)


def test_python_steps_tell_their_rows_in_slices():
    """What a worker holds as objects must not grow with its Arrow batch."""
    import pyarrow as pa

    part = {"phrase_no": 0, "places": [0, 2], "counts": [1, 3]}
    other = {"phrase_no": 1, "places": [2, 3], "counts": [2, 2]}
    kind = pa.list_(pa.struct([("phrase_no", pa.int32()), ("places", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(range(1000)), pa.array([[part, other]] * 1000, kind)], ["query_id", "block", "parts"])
    got = list(P._met([batch]))
    assert max(b.num_rows for b in got) <= 256 and sum(b.num_rows for b in got) == 1000
    assert all(r == {"query_id": r["query_id"], "block": r["query_id"], "places": [2], "counts": [[3, 2]]} for b in got for r in b.to_pylist())


def test_lists_of_an_index_are_bytes_of_any_width(spark, tmp_path):
    """Lists of numbers are written number by number, which took most of an index's time."""
    import numpy as np

    for top in (0, 255, 256, 65535, 65536, 2**31 - 1):
        values, ends = np.array([0, 1, top, 7, top]), np.array([0, 1, 3, 5])
        got = P._bytes(P._packed(values, ends).slice(1))
        assert [got(0, 2).tolist(), got(1, 2).tolist()] == [[1, top], [7, top]]
    far = " ".join(["zz"] * 70000 + ["alpha", "beta", "zz", "alpha"])
    units = spark.createDataFrame([(1, far), (2, "beta alpha"), (3, "alpha beta " * 300), (4, None)], "id long, t string")
    P.write_index(units, "id", ["t"], str(tmp_path / "index"))
    index = P.Index(spark, str(tmp_path / "index"))
    assert {c: t for c, t in index.rows.dtypes if c in ("places", "counts", "steps")} == dict.fromkeys(("places", "counts", "steps"), "binary")
    assert {r["term"]: (r["units"], r["occurrences"]) for r in index.terms().collect()} == {"zz": (1, 70001), "alpha": (3, 303), "beta": (3, 302)}
    asked = spark.createDataFrame([("q", 0, ["alpha", "beta"]), ("r", 0, ["zz"])], "query_id string, phrase_no int, phrase array<string>")
    assert {(r["query_id"], r["unit_id"]) for r in index.all(asked).collect()} == {("q", 1), ("q", 3), ("r", 1)}
    assert {(r["query_id"], r["unit_id"], r["dl"]) for r in index.parts(asked).collect()} == {("q", 1, 70004), ("q", 3, 600), ("r", 1, 70004)}


def test_an_index_without_positions(spark, tmp_path):
    units = spark.createDataFrame(UNITS, "id long, a string, b string, c string")
    for name, phrases in (("with", True), ("without", False)):
        P.write_index(units, "id", ["a", "b", "c"], str(tmp_path / name), phrases)
    asked = R.query_table(spark, {q: q for q in ("run", "parse args", "the parser", "zzz")})
    told = [sorted(tuple(r) for r in P.Index(spark, str(tmp_path / name)).top(asked, 3).collect()) for name in ("with", "without")]
    assert told[0] == told[1] and told[0]
    with pytest.raises(ValueError, match="no positions"):
        P.Index(spark, str(tmp_path / "without")).top(R.query_table(spark, {"q": "parse_args"}), 3)


def test_the_best_of_a_query_are_kept_before_they_are_exchanged(spark):
    rows = spark.createDataFrame([("q", k, float(k % 7)) for k in range(50)], "query_id string, unit_id long, score double")
    for found in (R.top(rows, 3), P.ranked(rows, 3)):
        assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()
        assert [tuple(r) for r in found.orderBy("rank").select("unit_id", "rank").collect()] == [(6, 0), (13, 1), (20, 2)]
