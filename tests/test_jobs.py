"""The jobs: growing input, replays, reruns, odd rows, and their command lines."""

import json
import os
import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import ingest, navigate
from jobs.common import DOCUMENTS
from quarrylake.operators import chunks

ROOT = Path(__file__).resolve().parent.parent


def put(spark, folder, rows, name):
    """One Parquet file of documents put into a folder as a whole, later than those before it."""
    made = f"{folder}-{name}"
    spark.createDataFrame(rows, DOCUMENTS).coalesce(1).write.parquet(made)
    os.makedirs(folder, exist_ok=True)
    part = next(Path(made).glob("*.parquet"))
    time.sleep(0.01)
    os.utime(part)
    part.rename(f"{folder}/{name}.parquet")


def doc(doc_id, text, lang="en", source="a"):
    return doc_id, text, lang, source, None


def files_in(folder):
    return {str(p): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


def standing(spark, target):
    return {(r["path"], r["sha256"], r["ord"], r["start_line"], r["end_line"], r["text"]) for r in ingest.current_chunks(spark, target).collect()}


def rebuilt(spark, texts):
    """The chunks of the texts as they should stand, made at once."""
    rows = spark.createDataFrame(list(texts.items()), "path string, text string").withColumn("sha256", F.sha2("text", 256))
    return {tuple(r) for r in chunks.chunks(rows, ["path", "sha256"]).select("path", "sha256", "ord", "start_line", "end_line", "text").collect()}


def changes(spark, target, batch):
    return {r["path"]: r["change"] for r in spark.read.parquet(f"{target}/changes").where(F.col("batch") == batch).collect()}


def test_ingest_of_growing_input(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("docs", "out", "mark"))
    long = "\n".join(f"line {k} of a long text" for k in range(300))
    put(spark, source, [doc(1, "one"), doc(2, long), doc(3, long), doc(4, ""), doc(5, "five", lang="de")], "first")
    assert ingest.run(spark, source, target, checkpoint) == 5
    texts = {"a/en/1": "one", "a/en/2": long, "a/en/3": long, "a/en/4": "", "a/de/5": "five"}
    assert standing(spark, target) == rebuilt(spark, texts) and len(standing(spark, target)) > 10
    written = files_in(target)
    assert ingest.run(spark, source, target, checkpoint) == 0 and files_in(target) == written

    # New, changed, retracted and unchanged documents; a document twice; one whose content is known under another path.
    put(spark, source, [doc(1, "one, again"), doc(2, None), doc(3, long), doc(6, "five", lang="de"), doc(7, None), doc(7, "seven")], "second")
    put(spark, source, [doc(8, "eight", lang=None), doc(1, "one at last")], "third")
    assert ingest.run(spark, source, target, checkpoint) == 8
    texts |= {"a/en/1": "one at last", "a/de/6": "five", "a/en/7": "seven", "a/none/8": "eight"}
    del texts["a/en/2"]
    assert standing(spark, target) == rebuilt(spark, texts)
    assert changes(spark, target, 1) == {"a/en/1": "changed", "a/en/2": "removed", "a/en/3": "unchanged", "a/de/6": "added", "a/en/7": "added", "a/none/8": "added"}
    # What was written stays as it is, and known contents are not cut again.
    assert written.items() <= files_in(target).items()
    own = spark.read.parquet(f"{target}/chunks")
    assert own.groupBy("sha256", "ord").count().where("count > 1").count() == 0 and own.where("batch = 1").count() == 3

    # A path that was retracted comes back; the same in small batches.
    put(spark, source, [doc(2, "two")], "fourth")
    put(spark, source, [doc(9, "nine")], "fifth")
    assert ingest.run(spark, source, target, checkpoint, files_per_batch=1) == 2
    texts |= {"a/en/2": "two", "a/en/9": "nine"}
    assert standing(spark, target) == rebuilt(spark, texts)
    assert changes(spark, target, 2) == {"a/en/2": "added"} and changes(spark, target, 3) == {"a/en/9": "added"}


def test_a_batch_may_run_twice(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("docs", "out", "mark"))
    for k in range(2):
        put(spark, source, [doc(1, f"text {k}"), doc(10 + k, "more")], f"f{k}")
        ingest.run(spark, source, target, checkpoint)
    before = standing(spark, target), changes(spark, target, 1)
    # As after a crash between a batch's writes and its commit.
    for p in [*Path(checkpoint, "commits").glob("1"), *Path(checkpoint, "commits").glob(".1.crc")]:
        p.unlink()
    assert ingest.run(spark, source, target, checkpoint) == 2
    assert (standing(spark, target), changes(spark, target, 1)) == before


def test_ingest_of_nothing(spark, tmp_path):
    source, target = str(tmp_path / "docs"), str(tmp_path / "out")
    put(spark, source, [], "empty")
    assert ingest.run(spark, source, target, str(tmp_path / "mark")) == 0
    assert ingest.current_chunks(spark, target).count() == 0
    assert ingest.pattern("s3://b/docs/") == "s3://b/doc[s]" and ingest.pattern("/x/*.parquet") == "/x/*.parquet"


def plain_digest(docs, budget, overview_budget):
    """The digests by loops."""
    cost = lambda block: -(-len(block) // 4) + 1
    by = {}
    for doc_id, text, lang, source, _ in docs:
        word = lambda v: "none" if v is None else str(v)
        text = text or ""
        by.setdefault(word(source), []).append((f"{word(source)}/{word(lang)}/{word(doc_id)}", word(lang), 0 if not text else text.count("\n") + 1, -(-len(text) // 4), " ".join(text.strip().split("\n\n")[0][:120].split())))
    out, heads = set(), {}
    for module, files in by.items():
        langs = {}
        for path, lang, *_ in sorted(files):
            n, first = langs.get(lang, (0, path))
            langs[lang] = n + 1, first
        most = ", ".join(sorted(langs, key=lambda x: (-langs[x][0], langs[x][1]))[:3])
        tokens = sum(f[3] for f in files)
        heads[module] = len(files), tokens, most
        head = f"# {module}\n{len(files)} files, {sum(f[2] for f in files)} lines, about {tokens} tokens ({most})"
        out.add((module, 0, "", head, cost(head)))
        used = shown = 0
        last = "the head"
        for path, lang, lines, own, begin in sorted(files):
            block = f"- {path} ({lang}, {lines} lines, {own} tokens)" + (f": {begin}" if begin else "")
            if used + cost(block) > budget:
                break
            used, shown, last = used + cost(block), shown + 1, path
            out.add((module, 1, path, block, used))
        if shown < len(files):
            note = f"{len(files) - shown} of {len(files)} files are not shown; go on after {last} or raise the budget"
            out.add((module, 2, "", note, used + cost(note)))
    view, used, shown = set(), 0, 0
    for module, (n, tokens, most) in sorted(heads.items(), key=lambda h: (-h[1][0], h[0])):
        block = f"- {module}: {n} files, about {tokens} tokens ({most})"
        if used + cost(block) > overview_budget:
            break
        used, shown = used + cost(block), shown + 1
        view.add((1, module, block, used))
    if shown < len(heads):
        note = f"{len(heads) - shown} of {len(heads)} modules are not shown; raise the budget"
        view.add((2, "", note, used + cost(note)))
    return out, view


def made(spark, target):
    digests = {(r["module"], r["part"], r["path"], r["block"], r["used"]) for r in navigate.digest_lines(spark, target).collect()}
    return digests, {(r["part"], r["module"], r["block"], r["used"]) for r in spark.read.parquet(f"{target}/overview").collect()}


@pytest.mark.parametrize("budget, overview_budget", [(4000, 1000), (60, 25), (1, 1)])
def test_digests(spark, tmp_path, budget, overview_budget):
    docs = [doc(k, f"Words of {k}.\nMore." * (k % 4), lang=["en", "de", "fr", None][k % 4], source=f"m{k % 3}" if k % 11 else None) for k in range(60)]
    docs += [doc(None, None), doc(70, "x" * 300_000), doc(1, "again", source="m1")]
    source, target = str(tmp_path / "docs"), str(tmp_path / "out")
    put(spark, source, docs, "all")
    for _ in range(2):
        navigate.run(spark, source, target, budget, overview_budget)
        assert made(spark, target) == plain_digest(docs, budget, overview_budget)


def test_some_modules_again(spark, tmp_path):
    target = str(tmp_path / "out")
    old = [doc(k, f"t{k}.", source=f"m{k % 3}") for k in range(9)]
    put(spark, str(tmp_path / "old"), old, "all")
    navigate.run(spark, str(tmp_path / "old"), target)
    new = [doc(k, f"new {k}.", source=f"m{k % 3}") for k in range(12)]
    put(spark, str(tmp_path / "new"), new, "all")
    navigate.run(spark, str(tmp_path / "new"), target, modules="m1,m9")
    mixed = [d for d in old if d[3] != "m1"] + [d for d in new if d[3] == "m1"]
    assert made(spark, target) == plain_digest(mixed, 4000, 1000)
    put(spark, str(tmp_path / "few"), new[:2], "all")  # a whole run forgets modules that are gone
    navigate.run(spark, str(tmp_path / "few"), target)
    assert made(spark, target) == plain_digest(new[:2], 4000, 1000)
    put(spark, str(tmp_path / "none"), [], "all")
    navigate.run(spark, str(tmp_path / "none"), str(tmp_path / "empty"))
    assert made(spark, str(tmp_path / "empty")) == (set(), set())


def test_command_lines(spark, tmp_path):
    put(spark, str(tmp_path / "docs"), [doc(1, "one"), doc(2, "two")], "all")
    config = tmp_path / "config.json"
    config.write_text(json.dumps({"source": str(tmp_path / "docs"), "target": "elsewhere", "checkpoint": str(tmp_path / "mark"), "files_per_batch": 8}))
    call = lambda *args: subprocess.run([sys.executable, "-m", *args], cwd=ROOT, capture_output=True, text=True, timeout=200)
    got = call("jobs.ingest", "--config", str(config), "--target", str(tmp_path / "out"))
    assert got.returncode == 0 and "read 2 documents" in got.stderr, got.stderr[-2000:]
    assert {r[0] for r in standing(spark, str(tmp_path / "out"))} == {"a/en/1", "a/en/2"}
    got = call("jobs.navigate", "--documents", str(tmp_path / "docs"), "--target", str(tmp_path / "told"))
    assert got.returncode == 0 and len(made(spark, str(tmp_path / "told"))[0]) == 3, got.stderr[-2000:]
    assert call("jobs.navigate").returncode == 2
