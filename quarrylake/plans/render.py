"""A corpus as Markdown for a reader with a budget of tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylake.functions import paths
from quarrylake.operators import digest

OUTLINED_FILES, MARGIN = 6000, 1500


def render(corpus, level: int, budget: int, glob: str | None) -> str:
    """Overview sections, then outlines of files in order of path as long as they fit."""
    files = corpus.table("files")
    if glob:
        files = files.where(paths.matches_glob(F.col("path"), glob))
    meta, texts, symbols = corpus.meta, corpus.texts(), corpus.table("symbols")
    total = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("b")).first()
    out = [f"# {corpus.name}", "", f"- source: {meta.get('source_ref')} ({meta.get('source_kind')})", f"- files: {total['n']}, {digest.human_bytes(total['b'])}", f"- symbols: {meta.get('symbol_count')}, chunks: {meta.get('chunk_count')}"]
    if glob:
        out.append(f"- scope: {glob}")
    out += ["", "## Languages", *(f"- {r['lang']}: {r['files']} files, {digest.human_bytes(r['bytes'])}" for r in digest.languages(files).limit(14).collect())]
    rows = digest.modules(files, corpus.dependents()).limit(20).collect()
    purpose = {r["name"]: r["purpose"] for r in digest.purposes(texts, symbols).collect()} if rows else {}
    out += ["", "## Modules", *(f"- {r['name']}: {r['files']} files ({', '.join(r['langs'])}), {r['dependents']} dependents" + (f" - {purpose[r['name']]}" if purpose.get(r["name"]) else "") for r in rows)]
    if meta.get("enrichment") and not glob:
        out += ["", f"## About the modules ({meta.get('enrichment_model')})", *(f"- {k}: {v}" for k, v in meta["enrichment"].items())]
    central = corpus.dependents().join(files.select("path"), "path", "left_semi").orderBy(F.desc("dependents"), "path").limit(12).collect()
    if central:
        out += ["", "## Key files", *(f"- {r['path']}: {r['dependents']} dependents" for r in central)]
    points = [r["path"] for r in digest.entry_points(files).collect()]
    if points:
        out += ["", "## Entry points", *(f"- {p}" for p in points)]
    out += ["", "## Tree", *("  " * (r["level"] - 1) + f"{r['prefix'].rsplit('/', 1)[-1]}/ ({r['files']})" for r in digest.tree_counts(files).orderBy("prefix").limit(digest.TREE_LINES).collect())]
    if not glob:
        told = digest.conventions(symbols, corpus.table("edges"))
        if told:
            out += ["", "## Conventions", *(f"- {x}" for x in told)]
        made = digest.decisions(texts, symbols).collect()
        if made:
            out += ["", "## Decisions", *(f"- {r['path']}: {r['title'] or ''} {r['summary'] or ''}".rstrip() for r in made)]
        about = digest.readme(texts).first()
        if about:
            out += ["", "## Readme", about["excerpt"]]
        docs = [r["path"] for r in digest.documents(files).limit(30).collect()]
        if docs:
            out += ["", "## Documents", *(f"- {p}" for p in docs)]
        if meta.get("git_commits"):
            out += ["", "## Recent commits", *(f"- {x}" for x in meta["git_commits"][:20])]
        if meta.get("excluded_files"):
            out += ["", "## Declared but not included", *(f"- {x}" for x in meta["excluded_files"][:40])]
    text = "\n".join(out)
    if level < 1:
        return text
    left = budget - MARGIN - len(text) // 4
    listed = files.select("path", "lang", "line_count").orderBy("path").limit(OUTLINED_FILES)
    own = F.array_sort(F.collect_list(F.struct("start_line", "parent", "kind", "name", "signature")))
    outlines = symbols.join(listed.select("path"), "path", "left_semi").groupBy("path").agg(own.alias("symbols"))
    blocks, shown = [], 0
    for r in listed.join(outlines, "path", "left").orderBy("path").toLocalIterator():
        lines = [f"### {r['path']} ({r['lang']}, {r['line_count']} lines)"]
        for s in r["symbols"] or []:
            if s["parent"] is None:
                lines.append(f"- {s['signature']} :{s['start_line']}")
                if level >= 2:
                    lines += [f"  - {m['signature']} :{m['start_line']}" for m in r["symbols"] if m["parent"] == s["name"]]
        block = "\n".join(lines)
        cost = -(-len(block) // 4)
        if cost > left:
            break
        left -= cost
        shown += 1
        blocks.append(block)
    if shown < total["n"]:
        blocks.append(f"({total['n'] - shown} of {total['n']} files are not shown; narrow the scope with a glob or raise the budget)")
    return text + "\n\n## Files\n\n" + "\n\n".join(blocks)
