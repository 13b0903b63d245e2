"""The pipeline's stages one after another on a small table."""

import corpus_pipeline as P


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    before = spark.read.parquet(f"{sf}/documents.parquet")
    docs, sizes = before, [before.count()]
    for k, (name, stage) in enumerate(P.STAGES):
        out = P.C.spill(stage(spark, docs, sf), f"test-{name}")
        if k < 3:
            assert out.schema.names == before.schema.names
            assert out.join(docs, out.columns, "left_anti").count() == 0
            sizes.append(out.count())
        else:
            assert out.select("doc_id").distinct().count() == sizes[-1]
            assert out.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 1024").count() == 0
        docs = out
    print(sizes)
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] > 0.6 * sizes[0]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", "en", "s", 9), (1, "a b c d e f g", "en", "s", 9), (2, "a b c d e f g", "en", "s", 9), (None, None, None, None, None), (3, None, "x", None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = P.near_duplicate_stage(spark, docs, "")
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 1), (False, 3), (True, 0)]
    assert P.packing_stage(spark, kept, "").count() == 3


def test_packing_gives_the_ids(spark):
    docs = spark.createDataFrame([(1, "some text " * 900, "en", "s", 9), (2, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = P.packing_stage(spark, docs, "").collect()
    assert len(rows) > 2 and all(len(r["ids"]) == r["length"] for r in rows)
    assert [r["ids"] for r in rows if r["doc_id"] == 2] == [[P.packing.END_ID]]


def test_tables_without_rows_or_labels(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, rep string, band long, digest string"
    rows = [(1, "one two three four five six", "en", "s", 9, "x", "r", 1, "d"), (2, None, None, None, None, None, None, None, None), (2, "", "en", "s", 0, "x", "r", 1, "d"), (None, "a b", "en", "s", 3, "x", "r", 1, "d"), (4, "one two three four five six", "en", "s", 9, "x", "r", 1, "d")]
    labels = "doc_id long, quality int, toxic int"
    for name, docs, known, want in (("none", [], [], []), ("unlabelled", rows, [], [1, 2, 2, None]), ("one kind", rows, [(1, 1, 0), (2, None, None), (None, 1, 0)], [1, 2, 2, None])):
        folder = str(tmp_path / name)
        spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(known, labels).write.parquet(f"{folder}/labels.parquet")
        got = P.run(spark, folder).collect()
        assert sorted((r["doc_id"] for r in got), key=lambda i: i or 99) in (want, want[:2] + want[3:]), name


def test_stages_against_brute_force(spark):
    """Each stage's decisions on a small table, made again one document at a time."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    good = P.quality.train(docs, labels.select("doc_id", "quality"))
    kept = {r["doc_id"] for r in P.quality_stage(spark, docs, sf).collect()}
    assert kept == {i for i, t in text.items() if good.score(P.quality.statistics(t)[None])[0] >= P.quality.CUT}
    toxic = P.toxicity.train(docs, labels.select("doc_id", "toxic"))
    left = {r["doc_id"] for r in P.toxicity_stage(spark, docs, sf).collect()}
    known = P.toxicity.Evidence(toxic)
    assert left == {i for i, t in text.items() if toxic.constant is not None or toxic.score(known.of([t]))[0] < P.toxicity.CUT}
    groups = {r["doc_id"]: r["component_id"] for r in P.minhash.near_duplicates(docs).collect()}
    assert {r["doc_id"] for r in P.near_duplicate_stage(spark, docs, sf).collect()} == set(groups.values())
