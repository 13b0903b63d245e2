"""A small corpus from end to end."""

import random
import re
import subprocess

import pytest

from quarrylake.plans import corpus as C
from quarrylake.sources import dump

FILES = {
    "pkg/__init__.py": '"""What pkg is for."""\n',
    "pkg/core.py": '"""Core parts."""\nimport os\nfrom .util import helper\n\nLIMIT = 5\n\n\nclass Engine(Base, meta=M):\n    """Runs things."""\n\n    @prop\n    async def start(self, n: int = 1) -> bool:\n        return helper(n)\n\n\ndef quick(a, *b):\n    return a\n',
    "pkg/util.py": "def helper(x):\n    return x\n",
    "pkg/logging.py": "x = 1\n",
    "_v.py": "y = 2\n",
    ".hid.py": "z = 3\n",
    "app.py": "import logging\nimport pkg.core\n",
    "README.md": "# Title\n\n![badge](x)\n\nA café of things.\n",
    "docs/adr-1.md": "# Use Spark\n\nBecause it scales.\n\n```\n# not a heading\n```\n## Second\n",
    "web/a.ts": "export class Widget {\n  go() {}\n}\nimport { b } from './b'\nexport const f = (x) => x\n",
    "web/b.ts": "export interface Thing {}\n",
    "tests/test_core.py": "def test_engine_start():\n    pass\n",
    "node_modules/x.js": "function hidden() {}\n",
    "notes.txt": "naïve 😀\ttab\n" + "line of words here\n" * 400,
}


@pytest.fixture(scope="module")
def demo(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("src") / "demo"
    for name, body in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body.encode())
    (root / "blob.bin").write_bytes(b"a\0b")
    (root / "link.py").symlink_to(root / "app.py")
    home = tmp_path_factory.mktemp("home")
    return C.Store(spark, str(home)), root


def test_end_to_end(spark, demo):
    store, root = demo
    corpus = store.add(str(root), "Demo Repo")
    assert corpus.name == "demo-repo" and [m["name"] for m in store.list()] == ["demo-repo"]
    have = {r["path"]: r for r in corpus.files().collect()}
    assert set(have) == set(FILES) - {"node_modules/x.js"}
    skipped = {r["path"]: r["skipped"] for r in corpus.table("skipped").collect()}
    assert skipped == {"blob.bin": "binary", "link.py": "not-a-regular-file"}
    for path in have:
        assert corpus.read(path, 1, 10**6)["text"] == FILES[path]
    told = corpus.verify()
    assert told["ok"] and told["total"] == len(have) and told["failed"] == []
    symbols = {(r["path"], r["kind"], r["name"], r["parent"]) for r in corpus.table("symbols").collect()}
    assert {("pkg/core.py", "class", "Engine", None), ("pkg/core.py", "method", "start", "Engine"), ("pkg/core.py", "const", "LIMIT", None), ("pkg/core.py", "module", "core", None), ("web/a.ts", "class", "Widget", None), ("web/a.ts", "function", "f", None), ("docs/adr-1.md", "h1", "Use Spark", None), ("docs/adr-1.md", "h2", "Second", None)} <= symbols
    assert not any(s[2] == "not a heading" for s in symbols)
    signature = corpus.table("symbols").where("name = 'start'").first()["signature"]
    assert signature == "@prop async def start(self, n: int=1) -> bool"
    assert {r["path"]: r["dependents"] for r in corpus.dependents().collect()} == {"pkg/util.py": 1, "pkg/core.py": 1, "web/b.ts": 1}
    assert corpus.neighbors("pkg/util.py")["imported_by"] == ["pkg/core.py"]
    assert corpus.neighbors("Engine")["definitions"][0]["path"] == "pkg/core.py"
    assert corpus.read("Engine")["candidates"][0]["body"].startswith("class Engine")
    assert corpus.read("Widget")["candidates"][0]["last_line"] == 4
    hits = corpus.search("engine start").collect()
    assert hits and hits[0]["path"] == "pkg/core.py"
    assert corpus.search("CAFE", mode="lexical").first()["path"] == "README.md"
    assert corpus.search("   ").count() == 0 and corpus.search("- :", mode="lexical").count() == 0 and corpus.search("x", mode="odd").count() == 0
    assert 1 <= corpus.search("engine", diversify=True, k=3).count() <= 3
    asked = {"a": "engine start", "b": "CAFE", "c": "   ", "d": None, "e": "helper"}
    for mode in ("auto", "lexical", "semantic"):
        many = corpus.search_many(spark.createDataFrame(list(asked.items()), "query_id string, question string"), k=5, mode=mode).collect()
        for q, question in asked.items():
            own = sorted((r for r in many if r["query_id"] == q), key=lambda r: r["rank"])
            assert [(r["path"], r["start"], r["kind"], r["score"]) for r in own] == [(r["path"], r["start"], r["kind"], r["score"]) for r in corpus.search(question or "", k=5, mode=mode).collect()]
    text = corpus.map(2)
    for part in ("## Modules", "What pkg is for.", "## Key files", "app.py", "Use Spark", "async def start"):
        assert part in text
    assert "not shown" in corpus.map(1, budget=1600)
    assert {r["name"] for r in corpus.modules().collect()} == {"(root)", "pkg", "docs", "web", "tests"}
    assert store.remove("demo-repo") and store.list() == []


def test_again_reuses_vectors_and_replaces(spark, demo):
    store, root = demo
    first = store.add(str(root))
    before = {r["embed_text"]: list(r["vector"]) for r in first.table("embeddings").collect()}
    (root / "pkg/util.py").write_text("def other(x):\n    return x\n")
    second = store.add(str(root))
    rows = second.table("embeddings").collect()
    assert {r["embed_text"] for r in rows if not r["reused"]} == {"function other def other(x)"}
    assert all(list(r["vector"]) == before[r["embed_text"]] for r in rows if r["reused"])
    assert second.read("pkg/util.py")["text"].startswith("def other") and len(list((store.home / "demo").glob("v=*"))) == 1
    (root / "pkg/util.py").write_text(FILES["pkg/util.py"])


def test_versions_of_other_writers_stay(spark, demo):
    store, root = demo
    stale, busy = store.home / "demo" / "v=dead", store.home / "demo" / "v=elsewhere"
    stale.mkdir(parents=True)
    busy.mkdir()
    with C.Heartbeat(busy):
        store.add(str(root), semantic=False)
        assert not stale.exists() and busy.exists()
    store.add(str(root), semantic=False)
    assert not busy.exists() and not list((store.home / "demo").glob("*.alive"))


def test_reads_and_searches_reach_the_scan(spark, demo):
    store, root = demo
    corpus = store.add(str(root), semantic=False)
    some = corpus.table("blobs").where(C.F.col("sha256") == "0" * 64)
    assert "PushedFilters: [IsNotNull(sha256), EqualTo(sha256," in some._jdf.queryExecution().toString()
    assert corpus.table("index-chunks").where("term = 'helper'").count() > 0
    assert corpus.failures().count() == 0 and corpus.excluded().count() == 0


def test_git_trees(spark, demo, tmp_path):
    store, _ = demo
    root = tmp_path / "repo"
    root.mkdir()
    (root / "a.py").write_text("def a():\n    pass\n")
    (root / "untracked.py").write_text("x = 1\n")
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "a.py")
    run("commit", "-qm", "First step")
    corpus = store.add(str(root), semantic=False)
    assert [r["path"] for r in corpus.files().collect()] == ["a.py"]
    assert corpus.meta["git_commits"] == ["First step"] and corpus.history("a.py").first()["subject"] == "First step"


DUMP = """This file is a packed representation of a codebase.
Line numbers have been added to the beginning of each line.

# Directory Structure
```
src/
  a.py
  deep/
    logo.png
b.md
```

## File: src/a.py
```python
1: def a():
2:     return 1
⋮----
```

## File: b.md
````markdown
```
inner
```
````

## File: missing.txt
no fence here
"""


def test_dumps(spark, demo, tmp_path):
    path = tmp_path / "repomix-output-thing.txt"
    path.write_text(DUMP)
    assert C.classify(str(path)) == "dump" and dump.declared_transforms(str(path)) == ["line_numbers"]
    assert [r["path"] for r in dump.read_listings(spark, [str(path)]).collect()] == ["src/a.py", "src/deep/logo.png", "b.md"]
    assert {r["path"]: r["text"] for r in dump.read_dumps(spark, [str(path)]).collect()} == {"src/a.py": "1: def a():\n2:     return 1\n⋮----", "b.md": "```\ninner\n```"}
    (tmp_path / "plain.txt").write_text("A packed representation of nothing.\n")
    told = {r["dump"].rsplit("/")[-1]: (r["is_dump"], r["transforms"], r["entries"]) for r in dump.facts(spark, [str(path), str(tmp_path / "plain.txt")]).collect()}
    assert told == {path.name: (True, ["line_numbers"], DUMP.count("\n## File: ")), "plain.txt": (False, [], 0)}
    corpus = demo[0].add(str(path))
    assert corpus.name == "thing" and corpus.read("src/a.py")["text"] == "def a():\n    return 1"
    assert corpus.meta["excluded_files"] == ["src/deep/logo.png"] and not corpus.meta["complete"] and not corpus.verify()["ok"]


def plain_files(text):
    """The files of a dump by one loop over its lines."""
    out, name, fence, body = [], None, None, []
    for line in text.removesuffix("\n").split("\n"):
        if fence:
            if line == fence:
                out.append((name, "\n".join(body)))
                name, fence = None, None
            else:
                body.append(line)
        elif line.startswith("## File: "):
            name = line[9:].strip()
        elif name is not None and line.strip():
            begun = re.fullmatch(r"\s*(`{3,})\s*[\w.+-]*\s*", line)
            name, fence, body = (name, begun[1], []) if begun else (None, None, [])
    return out + [(name, "\n".join(body))] * bool(fence)


def plain_listing(text):
    """The paths listed, by one loop with a stack."""
    tree = re.split(r"(?m)^ *```.*$", text.split("# Directory Structure\n", 1)[1])[1]
    out, stack = [], {}
    for line in filter(str.strip, tree.split("\n")):
        level = (len(line) - len(line.lstrip(" "))) // 2
        stack = {k: v for k, v in stack.items() if k < level}
        if line.endswith("/"):
            stack[level] = line.strip().rstrip("/")
        else:
            out.append("/".join([*(stack[k] for k in sorted(stack)), line.strip()]))
    return out


def test_dumps_in_many_ranges(spark, tmp_path):
    draw = random.Random(7)
    pieces = ["## File: f{}", "```", "````", "`````py", "```", "````", "", "x", "plain é text of some length", "``` two words", "  ```", "` ` `", "## File: "]
    texts, listing = [], "# Directory Structure\n```\na/\n  b/\n    c.txt\n  d.txt\n      deep.txt\n  e/\n    f/\n      g.txt\nh.txt\n```\n"
    for n in range(6):
        texts.append(listing + "\n".join(draw.choice(pieces).format(k) for k in range(400)) + "\n## File: last\n\n```\nopen to the end\n" + "long " * 300 * n)
        (tmp_path / f"{n}.txt").write_text(texts[-1])
    files = [str(tmp_path / f"{n}.txt") for n in range(6)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("90", "1500", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = {}
            for r in dump.read_dumps(spark, files).collect():
                got.setdefault(r["dump"].rsplit("/")[-1], []).append((r["path"], r["text"]))
            assert {k: sorted(v) for k, v in got.items()} == {f"{n}.txt": sorted(plain_files(t)) for n, t in enumerate(texts)}
            assert sorted(r["path"] for r in dump.read_listings(spark, files).collect()) == sorted(plain_listing(listing) * 6)
        assert dump.lines(spark, files).rdd.getNumPartitions() < 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "none.txt").write_text("")
    assert dump.read_dumps(spark, [str(tmp_path / "none.txt")]).count() == 0 and dump.read_listings(spark, [str(tmp_path / "none.txt")]).count() == 0


def test_sources_are_told_apart(tmp_path):
    assert C.classify("https://example.org/x.git") == "git"
    with pytest.raises(FileNotFoundError):
        C.classify(str(tmp_path / "none"))
    (tmp_path / "plain.txt").write_text("x")
    with pytest.raises(ValueError):
        C.classify(str(tmp_path / "plain.txt"))
    with pytest.raises(ValueError):
        C.safe_name("../..")
    assert C.safe_name("A b/../c") == "a-b-..-c"


def test_coverage_counts_files_of_every_language(spark, tmp_path):
    from quarrylake.plans import registry

    spark.createDataFrame([(1, "en"), (2, "de"), (3, "fr"), (4, None)], "doc_id long, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1,), (2,), (2,), (9,)], "doc_id long").write.parquet(str(tmp_path / "labels.parquet"))
    assert registry.coverage_pct(spark, str(tmp_path)).first().asDict() == {"files": 4, "labelled": 2, "percent": 50.0}


def test_symbol_search_of_pages_that_share_a_url(spark, tmp_path):
    import duckdb

    from quarrylake.plans import corpus_queries, registry

    rows = [(0, "u", "<h1>of the</h1>"), (1, "u", "<h1>of and</h1>\n<h2>the</h2>"), (2, "u", "<h1>other</h1>\n<h2>and the</h2>"), (3, "v", "<h2>the and</h2>"), (4, "v", "<h1>to of</h1>"), (5, "w", "<h1>plain of</h1>\n<h3>to the</h3>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(con.sql(registry.oracle_sql()["symbol_search"]).fetchall())
    got = sorted(tuple(r) for r in corpus_queries.symbol_search(spark, str(tmp_path)).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want] and all(abs(g[2] - w[2]) < 1e-6 for g, w in zip(got, want, strict=True))
    assert got


def test_symbol_bodies_outline_each_file_once_and_only_code_goes_to_python(spark, small):
    from quarrylake.operators import outline
    from quarrylake.plans import corpus_queries

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "EvalPython" not in plan(corpus_queries.symbol_bodies(spark, small))
    rows = spark.createDataFrame([("a.txt", "text", "class A {"), ("b.kt", "kotlin", "class B {"), ("c", None, "class C {")], "path string, lang string, text string")
    assert "CASE WHEN lang" in plan(outline.outlines(rows))
    assert {r["path"]: [s["name"] for s in r["symbols"]] for r in outline.outlines(rows).collect()} == {"a.txt": [], "b.kt": ["B"], "c": []}


def test_only_files_with_an_outline_are_outlined_and_contents_are_hashed_once(spark, demo, tmp_path, monkeypatch):
    """Plain text went to Python and was written once more; a whole corpus was hashed again to name no failure."""
    told, looked = [], []
    outlines, check = C.outline.outlines, C.verify.check
    monkeypatch.setattr(C.outline, "outlines", lambda files: told.extend(files.select("path", "lang").collect()) or outlines(files))
    corpus = C.Store(spark, str(tmp_path / "home")).add(str(demo[1]), "again", semantic=False)
    assert {r["path"] for r in told} == {p for p in FILES if not p.startswith(("node_modules", "notes"))}
    assert {"notes.txt", "pkg/core.py"} <= {r["path"] for r in corpus.files().collect()} & {r["path"] for r in corpus.table("chunks").collect()}

    class Looked:
        def __init__(self, rows):
            self.rows = rows

        def agg(self, *given):
            looked.append("agg")
            return self.rows.agg(*given)

        def where(self, given):
            looked.append("where")
            return self.rows.where(given)

    monkeypatch.setattr(C.verify, "check", lambda *given: Looked(check(*given)))
    assert corpus.verify()["ok"] and looked == ["agg"]
