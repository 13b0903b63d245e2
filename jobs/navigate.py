"""Navigation digests: for each module of a corpus what is in it, file by file, within a budget of tokens.

A module is the first directory of a path. Its digest is a head (files, lines,
estimated tokens, the commonest languages), one block for each file in order of
path (where it is, how long, and how its text begins) as long as they fit the
budget, and where they do not, a note that tells how many are left out and where
to go on. The overview has one line for each module, the largest first, within a
budget of its own, and the same kind of note.

Texts are read once, into a table of what is told of each file. It and the digests
are written by module, the overview beside them. A run of all modules
overwrites the tables; one that names some overwrites the partitions of those
(dynamic partition overwrite) and leaves the others as they are. So a rerun gives
the same rows. The overview is made of the heads of all modules, those left as
they are too.

The budget is cut in two steps, by parts of a module and then by the module, so
no task sorts a module that holds a large share of the files.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import DOCUMENTS, as_files, main
from quarrylake.functions import paths, text
from quarrylake.operators import digest
from quarrylake.plans.ship import ship

log = logging.getLogger("jobs.navigate")

HEAD, FILE, NOTE = 0, 1, 2
BEGINNING = 120
LINES = "module string, part int, path string, block string, tokens long, used long"
#: What is told of each file; texts are read once, to write this.
FILES = "path string, lang string, lines long, tokens long, beginning string, module string"
#: Numbers that the overview is made of, kept in the heads.
HEADS = "module string, files long, lines long, tokens long, langs string"


def run(spark: SparkSession, documents: str, target: str, budget: int = 4000, overview_budget: int = 1000, modules: str = "") -> int:
    """Write the digests of all modules, or of those named with commas between; returns the number of blocks."""
    ship(spark)
    files = described(spark.read.schema(DOCUMENTS).parquet(documents))
    chosen = F.col("module").isin(modules.split(",")) if modules else F.lit(True)
    read = write(files.where(chosen), f"{target}/files", ["module"], bool(modules))
    files = spark.read.schema(FILES).parquet(f"{target}/files").where(chosen)
    write(heads_of(files), f"{target}/heads", ["module"], bool(modules))
    heads = spark.read.schema(HEADS).parquet(f"{target}/heads")
    own = heads.join(files.select("module").distinct(), "module", "left_semi") if modules else heads
    blocks = write(digests(files, own, int(budget)), f"{target}/digests", ["module"], bool(modules))
    lines = write(overview(heads, int(overview_budget)), f"{target}/overview", [])
    log.info("read %d documents of %s, wrote %d blocks and an overview of %d lines to %s", read, documents, blocks, lines, target)
    return blocks


def described(docs: DataFrame) -> DataFrame:
    """(module, path, lang, lines, tokens, beginning) of each document; a null text is empty."""
    body = F.coalesce(F.col("text"), F.lit(""))
    files = as_files(docs).select("path", F.coalesce("lang", F.lit("none")).alias("lang"), body.alias("text"))
    flat = F.trim(F.regexp_replace(F.substring(text.first_paragraph(F.col("text"), BEGINNING), 1, BEGINNING), r"\s+", " "))
    return files.select(paths.module(F.col("path")).alias("module"), "path", "lang", text.line_count(F.col("text")).cast("long").alias("lines"), text.token_estimate(F.col("text")).cast("long").alias("tokens"), F.coalesce(flat, F.lit("")).alias("beginning"))


def heads_of(files: DataFrame) -> DataFrame:
    """(module, files, lines, tokens, langs) of each module, from sums that tasks make first."""
    langs = digest.modules(files.select("path", "lang")).select(F.col("name").alias("module"), F.array_join("langs", ", ").alias("langs"))
    sums = files.groupBy("module").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"), F.sum("tokens").alias("tokens"))
    return sums.join(langs, "module").select("module", "files", "lines", "tokens", "langs")


def cost(block: Column) -> Column:
    """Estimated tokens of a block and its line break."""
    return (text.token_estimate(block) + 1).cast("long")


def digests(files: DataFrame, heads: DataFrame, budget: int) -> DataFrame:
    """(module, part, path, block, tokens, used): the blocks of each module's digest in order of part and path."""
    as_text = lambda c: F.col(c).cast("string")
    head = F.concat(F.lit("# "), "module", F.lit("\n"), as_text("files"), F.lit(" files, "), as_text("lines"), F.lit(" lines, about "), as_text("tokens"), F.lit(" tokens ("), "langs", F.lit(")"))
    tops = heads.select("module", F.lit(HEAD).alias("part"), F.lit("").alias("path"), head.alias("block")).withColumn("tokens", cost(F.col("block"))).withColumn("used", F.col("tokens"))
    told = F.concat(F.lit("- "), "path", F.lit(" ("), "lang", F.lit(", "), as_text("lines"), F.lit(" lines, "), as_text("tokens"), F.lit(" tokens)"), F.when(F.col("beginning") != "", F.concat(F.lit(": "), "beginning")).otherwise(""))
    rows = files.select("module", "path", told.alias("block")).withColumn("tokens", cost(F.col("block")))
    shown = digest.within_budget(rows, ["module"], "path", F.col("tokens"), budget).select("module", F.lit(FILE).alias("part"), "path", "block", "tokens", "used")
    last = shown.groupBy("module").agg(F.count("*").alias("n"), F.max("path").alias("last"), F.max("used").alias("used"))
    note = F.concat(as_text("left"), F.lit(" of "), as_text("files"), F.lit(" files are not shown; go on after "), F.coalesce("last", F.lit("the head")), F.lit(" or raise the budget"))
    cut = heads.join(last, "module", "left").withColumn("left", F.col("files") - F.coalesce("n", F.lit(0))).where("left > 0")
    notes = cut.select("module", F.lit(NOTE).alias("part"), F.lit("").alias("path"), note.alias("block"), F.coalesce("used", F.lit(0)).alias("before")).withColumn("tokens", cost(F.col("block")))
    return tops.unionByName(shown).unionByName(notes.select("module", "part", "path", "block", "tokens", (F.col("before") + F.col("tokens")).alias("used")))


def overview(heads: DataFrame, budget: int) -> DataFrame:
    """(part, module, block, tokens, used): a line for each module, the largest first, within a budget, and a note of what is left out."""
    told = F.concat(F.lit("- "), "module", F.lit(": "), F.col("files").cast("string"), F.lit(" files, about "), F.col("tokens").cast("string"), F.lit(" tokens ("), "langs", F.lit(")"))
    rows = heads.select(F.lit("all").alias("all"), "module", F.struct((-F.col("files")).alias("n"), "module").alias("order"), told.alias("block")).withColumn("tokens", cost(F.col("block")))
    shown = digest.within_budget(rows, ["all"], "order", F.col("tokens"), budget).select(F.lit(FILE).alias("part"), "module", "block", "tokens", "used")
    both = shown.select("used").unionByName(heads.select(F.lit(None).cast("long").alias("used")))
    sums = both.agg(F.count("used").alias("n"), F.coalesce(F.max("used"), F.lit(0)).alias("before"), F.count_if(F.col("used").isNull()).alias("all"))
    note = F.concat((F.col("all") - F.col("n")).cast("string"), F.lit(" of "), F.col("all").cast("string"), F.lit(" modules are not shown; raise the budget"))
    notes = sums.where("all > n").select(F.lit(NOTE).alias("part"), F.lit("").alias("module"), note.alias("block"), "before").withColumn("tokens", cost(F.col("block")))
    return shown.unionByName(notes.select("part", "module", "block", "tokens", (F.col("before") + F.col("tokens")).alias("used")))


def write(rows: DataFrame, path: str, by: list[str], some: bool = False) -> int:
    """Overwrite a table, or only the partitions that the rows belong to; returns the number of rows."""
    seen = Observation()
    writer = rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if some else "static")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return seen.get["n"]


def digest_lines(spark: SparkSession, target: str) -> DataFrame:
    """All blocks as they stand."""
    return spark.read.schema(LINES).parquet(f"{target}/digests")


if __name__ == "__main__":
    main(run, "navigate", ["documents", "target"])
