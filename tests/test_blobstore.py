"""Contents in buckets: plans without exchanges of contents, states, batch reads; table functions of outliners."""

from quarrylake.functions import outliners
from quarrylake.operators import blobstore as B
from quarrylake.operators import outline

ROWS = [("a", b"one\ntwo\nthree"), ("b", b"one\ntwo\nthree"), ("c", b""), ("d", b"\xff bad"), ("e", None), ("f", b"x" * 300_000)]


def test_checks_and_reads_do_not_move_contents(spark, tmp_path):
    files, blobs = B.write(spark.createDataFrame(ROWS, "path string, content binary"), str(tmp_path / "own"), buckets=4)
    assert blobs.count() == 4 and files.count() == 5
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        states = B.checked(files, blobs)
        assert "Exchange" not in states._jdf.queryExecution().executedPlan().toString()
        assert {r["path"]: r["state"] for r in states.collect()} == dict.fromkeys("abcdf", "ok")
        asked = spark.createDataFrame([("a", 2, 9, "x"), ("b", 3, 3, "y"), ("c", 1, 1, "z"), ("d", 1, 1, "v"), ("gone", 1, 2, "w"), ("a", -5, 1, "u")], "path string, first int, last int, sha_of string")
        got = B.read_many(asked, files, blobs)
        plan = got._jdf.queryExecution().executedPlan().toString()
        scan = [part for part in plan.split("SortMergeJoin") if "content" in part][-1]
        assert plan.count("Exchange hashpartitioning(sha256") == 1 and "Bucketed: true" in scan
        assert {r["sha_of"]: r["lines"] for r in got.collect()} == {"x": "two\nthree", "y": "three", "z": "", "v": "\ufffd bad", "w": None, "u": "one"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lost = blobs.where("content <> cast('' as binary)")
    assert {r["path"] for r in B.checked(files, lost).where("state = 'missing'").collect()} == {"c"}


def test_nothing_to_store(spark, tmp_path):
    files, blobs = B.write(spark.createDataFrame([], "path string, content binary"), str(tmp_path / "none"), buckets=2)
    assert files.count() == blobs.count() == 0 and B.checked(files, blobs).count() == 0


def test_outliners_in_sql(spark):
    spark.createDataFrame([("a.py", "import os\nclass A:\n    def m(self): ...\n", "python"), ("b.md", "# T\n", "markdown"), ("c", None, "python"), ("d", "class X {", None)], "path string, text string, lang string").createOrReplaceTempView("own_files")
    outliners.register(spark, "own_outline")
    got = {(r["path"], r["kind"], r["name"], r["start_line"]) for r in spark.sql("SELECT f.path, s.* FROM own_files f, LATERAL own_outline(f.path, f.text, f.lang) s").collect()}
    assert got == {("a.py", "class", "A", 2), ("a.py", "method", "m", 3), ("b.md", "h1", "T", 1)}
    assert [tuple(r) for r in spark.sql("SELECT f.path, s.token FROM own_files f, LATERAL own_outline_imports(f.path, f.text, f.lang) s").collect()] == [("a.py", "os")]

    def shouting(path, text, lang):
        symbols, imports = outline.outline(path, text, lang)
        return [(s[0], s[1].upper(), *s[2:]) for s in symbols], imports

    outliners.register(spark, "loud_outline", shouting)
    assert {r["name"] for r in spark.sql("SELECT s.name FROM own_files f, LATERAL loud_outline(f.path, f.text, f.lang) s").collect()} == {"A", "M", "T"}
