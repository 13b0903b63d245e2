"""Token trees against counting the whole edited text."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylake.llm import byte_bpe
from quarrylake.llm import edit_counts as E

TEXT = st.lists(st.one_of(st.sampled_from([*"ab  \n\t.,1'é日", "<|endoftext|>", "<|endof", "text|>"]), st.characters(blacklist_categories=("Cs",))), max_size=60).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(-3, 90), st.integers(-2, 40), TEXT), max_size=6))
def test_any_edits(text, edits):
    encoder = byte_bpe.load()
    count = encoder.count
    tree = E.TokenTree(text, count, 5)
    for start, length, new in edits:
        a = min(max(0, start), len(text))
        text = text[:a] + new + text[min(len(text), a + max(0, length)) :]
        tree.edit(start, length, new)
        assert tree.text() == text and tree.n_chars == len(text)
        assert tree.n_tokens == len(encoder.whole(text)) // 4
    again = E.TokenTree.of_leaves(text, *tree.leaves(), count, 5)
    assert (again.n_tokens, again.text()) == (tree.n_tokens, text)


def test_only_the_region_is_encoded_again():
    seen = []
    tree = E.TokenTree(" ".join(["word"] * 50_000), lambda t: seen.append(len(t)) or len(t), 160)
    seen.clear()
    tree.edit(100_000, 3, "x")
    assert sum(seen) < 1000 and tree.reencoded < 1000


def test_frames(spark, small):
    from quarrylake.llm.queries import op3_edit_counts

    encoder = byte_bpe.load()
    docs = spark.createDataFrame([(1, None, "own"), (2, "", "own"), (2, "", "own"), (None, "a b  c", "own"), (3, "x" * 9000, "own"), (4, "of thand " * 3000, "own")], "doc_id long, text string, n_tokens string")
    want = {r["text"] or "": r for r in docs.collect()}
    for frame in (docs, E.trees(docs)):
        got = E.edited_counts(frame, E.sample_edits(E.C.whole_text())).collect()
        assert len(got) == 6
        for r in got:
            assert r["n_tokens"] == len(encoder.whole(r["text"] or "")) // 4
    assert want and E.edited_counts(docs.limit(0), E.sample_edits(E.C.whole_text())).count() == 0
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in op3_edit_counts(spark, small).collect():
        t = texts[r["doc_id"]]
        n = len(t)
        e = t[: n // 3] + " [edited in place]" + t[n // 3 :]
        e = e[: n // 2] + e[n // 2 + min(40, n // 4) :]
        e = "Revised: " + e
        assert (r["n_tokens"], r["edited_tokens"], r["edited_chars"], r["edited_sha256"]) == (len(encoder.whole(t)) // 4, len(encoder.whole(e)) // 4, len(e), hashlib.sha256(e.encode()).hexdigest())
        assert len("Revised: ") <= r["reencoded_chars"] <= max(len(e) * 3, 3 * (2 * E.GROWN * E.LEAF))


def test_null_edits_and_long_texts(spark):
    text = "of thand " * 60_000
    schema = f"doc_id long, text string, e {E.EDITS}"
    rows = [(1, "a b", None), (2, "a b", [(0, 1, None)]), (3, None, [(None, None, "new")]), (4, text, [(250_000, 7, "middle")]), (5, "x" * 450_000, [(9, 0, " ")])]
    got = {r["doc_id"]: r for r in E.edited_counts(spark.createDataFrame(rows, schema), E.F.col("e")).collect()}
    count = byte_bpe.load().count
    assert got[1]["edited_tokens"] == got[1]["n_tokens"] and got[2]["edited_chars"] == 2 and got[3]["edited_chars"] == 3
    assert got[4]["edited_tokens"] == count(text[:250_000] + "middle" + text[250_007:]) and got[4]["reencoded_chars"] < 2000
    assert got[5]["edited_tokens"] == count("x" * 9 + " " + "x" * 449_991)


def test_clashing_names_in_any_case(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c", 7, 8)], "doc_id long, text string, N_Tokens int, LEAF_chars int")
    got = E.edited_counts(docs, E.sample_edits(E.C.whole_text()))
    got.write.parquet(str(tmp_path / "out"))
    assert [c.lower() for c in got.columns].count("n_tokens") == 1 and spark.read.parquet(str(tmp_path / "out")).first()["n_tokens"] == 3
    assert [c.lower() for c in E.trees(docs).columns].count("leaf_chars") == 1
