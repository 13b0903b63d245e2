"""A corpus: sources taken in as versioned tables, and the questions that they answer.

A snapshot is a folder of Parquet tables (files, blobs, symbols, chunks, edges,
embeddings, skipped, meta); a small pointer file names the current one. A
snapshot is written as a whole before the pointer moves, so readers never see a
part of it, and it is never changed afterwards.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import threading
import time
import uuid
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.functions import embed, paths, text
from quarrylake.operators import chunks, digest, graph, outline, postings, verify
from quarrylake.plans import search
from quarrylake.plans.ship import ship
from quarrylake.sources import dump, tree

INDEXED = {"chunks": ["text"], "symbols": ["name", "signature", "docstring"]}
TABLES = ["files", "blobs", "symbols", "chunks", "edges", "embeddings", "skipped", "declared"]
#: Seconds between two signs of a writer, and after which a silent one is taken for dead.
BEAT_SECONDS, SILENT_SECONDS = 10, 300
#: Paths that a report shows; the whole lists are tables.
SHOWN = 1000
READ_LINES, SYMBOL_BODIES, NAME_MATCHES = 1500, 3, 10


class NotFound(LookupError):
    """Nothing of that name is in the corpus."""


class Heartbeat:
    """Touches a file beside a version while it is written, so that others, on any machine, see that its writer lives."""

    def __init__(self, version: Path) -> None:
        self.file, self.over = version.with_name(f"{version.name}.alive"), threading.Event()

    def __enter__(self) -> Heartbeat:
        self.file.parent.mkdir(parents=True, exist_ok=True)
        self.file.touch()
        threading.Thread(target=self._beat, daemon=True).start()
        return self

    def _beat(self) -> None:
        while not self.over.wait(BEAT_SECONDS):
            self.file.touch()

    def __exit__(self, *_) -> None:
        self.over.set()
        self.file.unlink(missing_ok=True)


def _alive(version: Path) -> bool:
    """True if a version's writer has given a sign lately."""
    try:
        return time.time() - version.with_name(f"{version.name}.alive").stat().st_mtime < SILENT_SECONDS
    except OSError:
        return False


def classify(source: str) -> str:
    """What a source is: tree, dump or git."""
    if tree.looks_like_git_url(source):
        return "git"
    if os.path.isdir(source):
        return "tree"
    if not os.path.exists(source):
        raise FileNotFoundError(source)
    if os.path.isfile(source) and dump.looks_like_dump(source):
        return "dump"
    raise ValueError(f"neither a folder nor a packed dump: {source}")


def name_of(source: str) -> str:
    """A safe name from a source's last segment."""
    stem = source.rstrip("/").rsplit("/", 1)[-1]
    for end in (".md", ".txt", ".git"):
        stem = stem.removesuffix(end)
    for start in ("repomix-output-", "repomix-"):
        stem = stem.removeprefix(start)
    return safe_name(stem or "repo")


def safe_name(raw: str) -> str:
    """Lower case, other characters as single hyphens, at most 100 characters; an error if nothing is left."""
    import re

    made = re.sub(r"[^a-z0-9._-]+", "-", raw.strip().lower()).strip("._-")[:100].strip("._-")
    if not made:
        raise ValueError(f"no safe name can be made of {raw!r}")
    return made


def take_in(raw: DataFrame, folder: str, declared: DataFrame | None = None, reuse: DataFrame | None = None, semantic: bool = True) -> None:
    """Write all tables of a snapshot from (path, content, skipped).

    The source is read once and each file is outlined once: what was read is
    written first, and every other table is made from what was written, so that
    a file that changes meanwhile cannot make tables disagree. ``reuse`` has the
    embed_text and vector of an earlier snapshot made by the same pipeline: texts
    that it knows are not embedded again.
    """
    spark = raw.sparkSession

    def kept(name: str, rows: DataFrame) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    read = kept("read", verify.digests(raw))
    kept("skipped", read.where("skipped is not null").select("path", "skipped"))
    whole = read.where("skipped is null")
    decoded = F.make_valid_utf8(F.col("content").cast("string"))
    rows = whole.withColumn("text", decoded).withColumn("lang", paths.language(F.col("path")))
    files = kept("files", rows.select("path", "lang", "sha256", "size_bytes", text.line_count(F.col("text")).cast("long").alias("line_count")))
    # Other files have no outline: they neither go to Python nor are written once more.
    outlined = kept("outlined", outline.outlines(rows.where(F.col("lang").isin(*outline.LANGUAGES)).select("path", "lang", "text")).select("path", "lang", "symbols", "imports"))
    # Contents lie in order of their address, so that one is found without reading the others.
    kept("blobs", verify.blobs(whole).repartitionByRange("sha256").sortWithinPartitions("sha256"))
    symbols = kept("symbols", outlined.select("path", "lang", F.posexplode("symbols").alias("ord", "s")).select("path", "lang", "ord", "s.*"))
    kept("edges", outlined.select(F.col("path").alias("src"), F.explode("imports").alias("dst")).where("dst <> ''"))
    made = kept("chunks", chunks.chunks(rows.select("path", "text"), ["path"]))
    kept("declared", declared.select("path") if declared is not None else files.select("path"))
    texts = symbols.select(text.embed_text(F.col("kind"), F.col("name"), F.col("signature"), F.col("docstring")).alias("embed_text")).distinct()
    kept("embeddings", embed.with_reuse(texts, reuse) if semantic else texts.limit(0).select("embed_text", F.lit(None).cast("array<float>").alias("vector"), F.lit(False).alias("reused")))
    for name, rows in (("chunks", made.withColumn("at", F.struct("path", "start_line", "ord"))), ("symbols", symbols.withColumn("at", F.struct("path", "start_line", "ord")))):
        postings.write_index(rows, "at", INDEXED[name], f"{folder}/index-{name}")
    for name in ("read", "outlined"):
        shutil.rmtree(f"{folder}/{name}", ignore_errors=True)


class Store:
    """Corpora by name in a folder that the driver and all executors see."""

    def __init__(self, spark: SparkSession, home: str) -> None:
        ship(spark)
        self.spark, self.home = spark, Path(home)

    def add(self, source: str, name: str | None = None, semantic: bool = True, max_bytes: int = tree.MAX_BYTES, binary: bool = False) -> Corpus:
        """Take a source in; replaces the corpus of that name as a whole."""
        kind, folder = classify(source), None
        root = self.home / (safe_name(name) if name else name_of(source))
        try:
            if kind == "git":
                folder = tempfile.mkdtemp(prefix="quarrylake-clone-", dir=self._made())
                tree.clone(source, folder)
            origin = folder or source
            declared, transforms, count = None, [], None
            if kind == "dump":
                cleaned = text.clean_dump_text(F.col("text")).cast("binary")
                raw = dump.read_dumps(self.spark, [source]).select("path", cleaned.alias("content"), F.lit(None).cast("string").alias("skipped"))
                declared = dump.read_listings(self.spark, [source]).select("path")
                transforms, count = dump.declared_transforms(source), dump.count_entries(self.spark, source)
            else:
                raw = tree.read_tree(self.spark, os.path.abspath(origin), max_bytes, binary)
            previous = self._current(root)
            reuse = None
            if semantic and previous is not None and json.loads((previous / "meta.json").read_text()).get("fingerprint") == embed.FINGERPRINT:
                reuse = self.spark.read.parquet(str(previous / "embeddings")).select("embed_text", "vector")
            version = root / f"v={os.getpid()}-{uuid.uuid4().hex}"
            with Heartbeat(version):
                take_in(raw, str(version), declared, reuse, semantic)
            got = Corpus(self.spark, root.name, version, {})
            meta = {
                "name": root.name, "source_kind": "dir" if kind != "dump" else "repomix", "source_ref": source if kind == "git" else os.path.abspath(source), "ingested_at": datetime.now(UTC).isoformat(),
                "commit_sha": tree.head_sha(origin) if kind != "dump" else None, "git_commits": tree.recent_subjects(origin) if kind != "dump" else [], "fingerprint": embed.FINGERPRINT if semantic else None,
                "transforms": transforms, "declared_file_count": count, **got.counts(),
            }
            meta["complete"] = count is None or count == meta["file_count"]
            (version / "meta.json").write_text(json.dumps(meta))
            self._point(root, version)
            return self.open(root.name)
        finally:
            if folder:
                shutil.rmtree(folder, ignore_errors=True)

    def _made(self) -> Path:
        self.home.mkdir(parents=True, exist_ok=True)
        return self.home

    @staticmethod
    def _current(root: Path) -> Path | None:
        pointer = root / "CURRENT"
        return root / pointer.read_text().strip() if pointer.exists() else None

    def _point(self, root: Path, version: Path) -> None:
        """Move the pointer in one step, then clear away versions that it does not name and that nobody is writing."""
        fresh = root / f"CURRENT.{os.getpid()}"
        fresh.write_text(version.name)
        os.replace(fresh, root / "CURRENT")
        for old in root.glob("v=*"):
            if old.is_dir() and old != version and not _alive(old):
                shutil.rmtree(old, ignore_errors=True)
                old.with_name(f"{old.name}.alive").unlink(missing_ok=True)

    def open(self, name: str) -> Corpus:
        """The current snapshot of a corpus."""
        version = self._current(self.home / name)
        if version is None:
            raise NotFound(name)
        return Corpus(self.spark, name, version, json.loads((version / "meta.json").read_text()))

    def list(self) -> list[dict]:
        """What each corpus says of itself; one that cannot be read has its name alone."""
        out = []
        for root in sorted(p.parent for p in self.home.glob("*/CURRENT")):
            try:
                out.append(self.open(root.name).meta)
            except (OSError, ValueError, LookupError):
                out.append({"name": root.name})
        return out

    def enrich(self, name: str, ask: Callable[[str], str], model: str, most: int = 25, budget: int = 6000) -> Corpus:
        """Have each of the largest modules described by ``ask`` (a prompt in, a text out) and keep what it says.

        The engine itself calls no network; ``ask`` may.
        """
        corpus = self.open(name)
        told = {}
        for r in digest.modules(corpus.table("files")).limit(most).collect():
            glob = "*" if r["name"] == "(root)" else f"{r['name']}/*"
            told[r["name"]] = ask(f"Say in two sentences what this module is for.\n\n{corpus.map(2, budget, glob)}").strip()
        meta = corpus.meta | {"enrichment": told, "enrichment_model": model}
        fresh = corpus.folder / f"meta.json.{os.getpid()}"
        fresh.write_text(json.dumps(meta))
        os.replace(fresh, corpus.folder / "meta.json")
        return self.open(name)

    def remove(self, name: str) -> bool:
        """Delete a corpus."""
        root = self.home / safe_name(name)
        there = root.exists()
        shutil.rmtree(root, ignore_errors=True)
        return there


class Corpus:
    """One snapshot: each question gives a DataFrame, or plain data where a text is asked for."""

    def __init__(self, spark: SparkSession, name: str, folder: Path, meta: dict) -> None:
        self.spark, self.name, self.folder, self.meta = spark, name, folder, meta

    def table(self, name: str) -> DataFrame:
        """A table of the snapshot."""
        return self.spark.read.parquet(str(self.folder / name))

    def counts(self) -> dict[str, int]:
        """Sizes of the tables."""
        size = self.table("files").agg(F.count("*").alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("b")).first()
        n = {t: self.table(t).count() for t in ("symbols", "chunks", "edges", "skipped")}
        absent = self.excluded()
        excluded = [r["path"] for r in absent.orderBy("path").limit(SHOWN).collect()]
        return {"file_count": size["n"], "total_bytes": size["b"], "symbol_count": n["symbols"], "chunk_count": n["chunks"], "edge_count": n["edges"], "skipped_count": n["skipped"], "excluded_files": excluded, "excluded_count": absent.count()}

    def excluded(self) -> DataFrame:
        """Every path that the source declares and that is not among the files."""
        return verify.missing(self.table("declared"), self.table("files"))

    def failures(self) -> DataFrame:
        """Every file whose content is missing or corrupt, with its state."""
        return verify.check(self.table("files"), self.table("blobs")).where("state <> 'ok'")

    def files(self, lang: str | None = None) -> DataFrame:
        """Files in order of path."""
        rows = self.table("files")
        return (rows.where(F.col("lang") == lang) if lang else rows).orderBy("path")

    def texts(self) -> DataFrame:
        """Files with their text."""
        content = self.table("blobs").select("sha256", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
        return self.table("files").join(content, "sha256")

    def dependents(self) -> DataFrame:
        """How many files import each."""
        return graph.dependents(self.table("edges"), self.table("files"))

    def modules(self) -> DataFrame:
        """Modules with their files, languages, dependents and purpose."""
        purpose = digest.purposes(self.texts(), self.table("symbols"))
        return digest.modules(self.table("files"), self.dependents()).join(purpose, "name", "left").orderBy(F.desc("files"), "name")

    def searched(self) -> search.Searched:
        """The tables that a search looks at; vectors only of the embedder in use."""
        own = self.table("embeddings") if self.meta.get("fingerprint") == embed.FINGERPRINT else None
        return search.Searched(self.table("chunks"), str(self.folder / "index-chunks"), self.table("symbols"), str(self.folder / "index-symbols"), own)

    def search(self, query: str, k: int = 10, mode: str = "auto", diversify: bool = False) -> DataFrame:
        """Results by words (chunks and symbols) and by meaning (symbols), fused by reciprocal ranks."""
        asked = self.spark.createDataFrame([("q", query)], "query_id string, question string")
        words = [w for phrase in text.phrases(query) for w in phrase]
        found = search.search_many(self.spark, self.searched(), asked, k, mode, diversify, words)
        return found.orderBy("rank").drop("query_id", "rank")

    def search_many(self, questions: DataFrame, k: int = 10, mode: str = "auto", diversify: bool = False) -> DataFrame:
        """The same for many questions (query_id, question) at once, with query_id and rank."""
        return search.search_many(self.spark, self.searched(), questions, k, mode, diversify)

    def read(self, target: str, start: int | None = None, end: int | None = None) -> dict:
        """Lines of a file, or the places and, if they are few, the bodies of a symbol."""
        known = self.table("files").where(F.col("path") == target).select("sha256").first()
        if known is not None:
            return {"kind": "file", "path": target, **self._lines(self._text(known["sha256"]), start, end)}
        found = self.table("symbols").where(F.col("name") == target)
        extents = digest.symbol_extents(self.table("symbols").join(found.select("path").distinct(), "path", "left_semi"), self.table("files")).where(F.col("name") == target)
        rows = extents.select("path", "kind", "name", "signature", "start_line", "last_line").orderBy("path", "start_line").limit(NAME_MATCHES).collect()
        if not rows:
            raise NotFound(target)
        out = [r.asDict() for r in rows]
        if len(rows) <= SYMBOL_BODIES:
            known = self.table("files").where(F.col("path").isin(list({r["path"] for r in rows}))).select("path", "sha256").collect()
            texts = {r["path"]: self._text(r["sha256"]) for r in known}
            for r in out:
                r["body"] = "\n".join(texts[r["path"]].split("\n")[r["start_line"] - 1 : r["last_line"]])
        return {"kind": "symbol", "name": target, "candidates": out}

    def _text(self, sha256: str) -> str:
        """One content by its address, which the scan is filtered by."""
        row = self.table("blobs").where(F.col("sha256") == sha256).select(F.make_valid_utf8(F.col("content").cast("string")).alias("text")).first()
        if row is None:
            raise NotFound(sha256)
        return row["text"]

    @staticmethod
    def _lines(whole: str, start: int | None, end: int | None) -> dict:
        lines = whole.split("\n")
        cut = start is None and end is None and len(lines) > READ_LINES
        first = min(max(1, start or 1), max(1, len(lines)))
        last = max(first, min(end if end is not None else READ_LINES if cut else len(lines), len(lines)))
        return {"start": first, "end": last, "total_lines": len(lines), "truncated": cut, "text": "\n".join(lines[first - 1 : last])}

    def neighbors(self, target: str, limit: int = 50) -> dict:
        """What a file imports and defines and who imports it, or where a symbol is defined."""
        edges, symbols = self.table("edges"), self.table("symbols")
        if self.table("files").where(F.col("path") == target).limit(1).count():
            return {
                "kind": "file", "target": target,
                "imports": [r["dst"] for r in graph.imports_of(edges, target).limit(limit).collect()],
                "imported_by": [r["src"] for r in graph.imported_by(edges, target, limit).collect()],
                "defines": [r.asDict() for r in symbols.where(F.col("path") == target).select("kind", "name", "start_line").orderBy("start_line").limit(limit).collect()],
            }
        rows = [r.asDict() for r in symbols.where(F.col("name") == target).select("path", "kind", "name", "start_line").orderBy("path", "start_line").limit(limit).collect()]
        return {"kind": "symbol" if rows else "unknown", "target": target, "definitions": rows}

    def history(self, target: str | None = None, limit: int = 25) -> DataFrame:
        """Commits of the source, or of one file."""
        root = self.meta.get("source_ref") or ""
        known = self.meta.get("source_kind") == "dir" and os.path.isdir(root)
        return tree.history(self.spark, root if known else os.devnull, target, limit)

    def verify(self) -> dict:
        """Every content hashed again, completeness against what was declared, coverage by symbols."""
        files = self.table("files")
        bad = verify.check(files, self.table("blobs"))
        n = bad.agg(F.count("*").alias("total"), F.count_if(F.col("state") == "ok").alias("verified")).first()
        # Every content is hashed once more only to name those that failed.
        failed = [r["path"] for r in bad.where("state <> 'ok'").select("path").orderBy("path").limit(SHOWN).collect()] if n["verified"] < n["total"] else []
        cover = verify.coverage(files, self.table("symbols")).first()
        drift = None
        if self.meta.get("source_kind") == "repomix" and os.path.exists(self.meta["source_ref"]):
            drift = dump.count_entries(self.spark, self.meta["source_ref"]) != self.meta.get("declared_file_count")
        return {"total": n["total"], "verified": n["verified"], "failed": failed, "failed_count": n["total"] - n["verified"], "complete": self.meta["complete"], "drift": drift, "coverage_percent": cover["percent"], "ok": not failed and n["total"] > 0 and self.meta["complete"] and not drift}

    def map(self, level: int = 0, budget: int = 25_000, glob: str | None = None) -> str:
        """A summary in Markdown: the whole at level 0, top-level symbols at 1, methods too at 2, within a budget of tokens."""
        from quarrylake.plans.render import render

        return render(self, level, budget, glob)
