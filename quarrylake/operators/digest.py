"""Summaries of a corpus: modules, key files, decisions, conventions, the tree, and their rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.functions import paths, text

# Fixed values of the summary.
TREE_DEPTH, TREE_LINES = 2, 80
TEST_FRAMEWORKS = ["pytest", "unittest", "vitest", "jest"]
LIBRARIES = ["dataclasses", "pydantic", "attrs", "zod"]
MANY_IMPORTS, MANY_ASYNC = 3, 5
README_CHARS = 1800
#: Parts of a group that are cut to a budget by themselves.
BUDGET_PARTS = 16


def languages(files: DataFrame) -> DataFrame:
    """(lang, files, bytes, lines), most bytes first."""
    return files.groupBy("lang").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), F.sum("line_count").alias("lines")).orderBy(F.desc("bytes"), "lang")


def modules(files: DataFrame, dependents: DataFrame | None = None, top: int = 3) -> DataFrame:
    """(name, files, langs, dependents): files by first directory, their commonest languages, the sum of their dependents.

    Equally common languages are in the order of the first path that has them.
    """
    rows = files.select("path", "lang", paths.module(F.col("path")).alias("name"))
    if dependents is not None:
        rows = rows.join(dependents, "path", "left").withColumn("dependents", F.coalesce("dependents", F.lit(0)))
    else:
        rows = rows.withColumn("dependents", F.lit(0).cast("long"))
    by_lang = rows.groupBy("name", "lang").agg(F.count("*").alias("n"), F.min("path").alias("first"), F.sum("dependents").alias("dependents"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", "lang"))), 1, top)
    out = by_lang.groupBy("name").agg(F.sum("n").alias("files"), F.transform(best, lambda x: x["lang"]).alias("langs"), F.sum("dependents").alias("dependents"))
    return out.orderBy(F.desc("files"), "name")


def tree_counts(files: DataFrame, depth: int = TREE_DEPTH) -> DataFrame:
    """(prefix, level, files): files below each directory down to a depth."""
    parts = paths.directories(F.col("path"))
    prefixes = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth))), lambda k: F.array_join(F.slice(parts, 1, k), "/")))
    return files.select(F.explode(prefixes).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("files")).withColumn("level", F.size(F.split("prefix", "/")))


def conventions(symbols: DataFrame, edges: DataFrame) -> list[str]:
    """What a corpus does often, from two aggregations."""
    names = [*TEST_FRAMEWORKS, *LIBRARIES]
    imported = edges.agg(*(F.count_if(F.col("dst") == n).alias(n) for n in names)).first()
    often = lambda some: [f"{n} in {imported[n]} files" for n in some if imported[n] > MANY_IMPORTS]
    s = convention_counts(symbols).first()
    told = {
        "tests use": often(TEST_FRAMEWORKS),
        "data models use": often(LIBRARIES),
        "own error types": [str(s["errors"])] * (s["errors"] > 0),
        "declared return types": [f"{s['typed']} of {s['functions']} functions"] * (s["functions"] > 0),
        "asynchronous functions": [str(s["asyncs"])] * (s["asyncs"] > MANY_ASYNC),
    }
    return [f"{what}: {', '.join(values)}" for what, values in told.items() if values]


def convention_counts(symbols: DataFrame) -> DataFrame:
    """One row: error classes, functions, functions with a return hint, asynchronous functions."""
    function = F.col("kind").isin("function", "method")
    return symbols.agg(
        F.count_if((F.col("kind") == "class") & (F.col("name").ilike("%Error") | F.col("name").ilike("%Exception"))).alias("errors"),
        F.count_if(function).alias("functions"),
        F.count_if(function & F.col("signature").ilike("%-> %")).alias("typed"),
        F.count_if(F.col("signature").ilike("async def%") | F.col("signature").ilike("%@% async def%")).alias("asyncs"),
    )


def readme(files: DataFrame) -> DataFrame:
    """The README nearest to the root, with its first characters (files: path, text)."""
    depth = F.size(F.split("path", "/"))
    return files.where(paths.is_readme(F.col("path"))).orderBy(depth, "path").limit(1).select("path", F.substring(text.strip_markdown_noise(F.col("text")), 1, README_CHARS).alias("excerpt"))


def entry_points(files: DataFrame) -> DataFrame:
    """Files named like entry points, the first twenty by path."""
    return files.where(paths.base_name(F.col("path")).isin(paths.ENTRY_POINTS)).select("path").orderBy("path").limit(20)


def documents(files: DataFrame) -> DataFrame:
    """Texts in the documentation directory, the first forty by path."""
    return files.where(paths.in_docs(F.col("path")) & paths.is_document(F.col("path"))).select("path").orderBy("path").limit(40)


def decisions(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, title, summary) of design documents: the first heading of level 1 and the first paragraph."""
    chosen = files.where(paths.is_document(F.col("path")) & paths.tells_decisions(F.col("path"))).orderBy("path").limit(20)
    titles = symbols.where("kind = 'h1'").groupBy("path").agg(F.min_by("name", "start_line").alias("title"))
    return chosen.join(titles, "path", "left").select("path", "title", text.first_paragraph(F.col("text")).alias("summary")).orderBy("path")


def purposes(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(name, purpose) of modules: the docstring of the package, else the first paragraph of a README in it."""
    package = symbols.where((F.col("kind") == "module") & F.col("docstring").isNotNull() & F.col("path").rlike("^[^/]+/__init__\\.py$"))
    by_doc = package.select(paths.module(F.col("path")).alias("name"), F.lit(0).alias("rank"), F.col("path"), F.col("docstring").alias("purpose"))
    told = files.where(F.col("path").contains("/") & paths.is_readme(F.col("path")))
    by_readme = told.select(paths.module(F.col("path")).alias("name"), F.lit(1).alias("rank"), "path", text.first_paragraph(F.col("text")).alias("purpose")).where("purpose is not null")
    return by_doc.unionByName(by_readme).groupBy("name").agg(F.min_by("purpose", F.struct("rank", "path")).alias("purpose"))


def within_budget(rows: DataFrame, group: list[str], order: str, cost: Column, budget: int) -> DataFrame:
    """Rows of each group in order, up to the first that does not fit the budget.

    Every row is taken to cost one at least, so a group has at most ``budget`` such rows, and
    they are among its first: the smallest ``budget`` orders of each salted part
    of a group are found first (a window limit that Spark pushes below the
    exchange), so no task sorts a whole hot group.
    """
    cost = F.greatest(cost, F.lit(1))
    part = F.pmod(F.xxhash64(order), F.lit(BUDGET_PARTS))
    place = F.row_number().over(Window.partitionBy(*group, part).orderBy(order))
    rows = rows.withColumn("__place", place).where(F.col("__place") <= budget).drop("__place")
    running = F.sum(cost).over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", running).where(F.col("used") <= budget)


def symbol_extents(symbols: DataFrame, files: DataFrame, window: int = 200) -> DataFrame:
    """Add last_line: a symbol's own end, or for one without extent the line before the next later symbol, at most ``window`` lines on."""
    later = Window.partitionBy("path").orderBy("start_line").rangeBetween(1, Window.unboundedFollowing)
    rows = symbols.withColumn("__next", F.min("start_line").over(later)).join(files.select("path", "line_count"), "path")
    cut = F.least(F.coalesce(F.col("__next") - 1, F.col("line_count")), F.col("start_line") + window, F.col("line_count"))
    return rows.withColumn("last_line", F.when(F.col("end_line") > F.col("start_line"), F.col("end_line")).otherwise(F.greatest(F.col("start_line"), cut))).drop("__next", "line_count")


def human_bytes(n: float) -> str:
    """A number of bytes in the unit that keeps it below 1024."""
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024:
            return f"{int(n)} B" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} TB"
