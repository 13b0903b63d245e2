"""Incremental ingest: what is new in a folder of documents becomes versions of files and chunks of new contents.

A file stream with a checkpoint takes the Parquet files that no run has taken
yet, in batches, and stops when it has caught up. Of each batch it writes

* ``files``: the new version of every path in it, with its content address, by
  batch and language. A null text retracts its path.
* ``chunks``: overlapping line chunks of contents that no earlier batch has, by
  batch. Contents are chunked once, however many paths or versions have them.
* ``changes``: whether a path was added, changed, removed or came again as it was.

Every batch overwrites the partitions of its own number (dynamic partition
overwrite), so one that runs twice, after a crash between its writes and the
checkpoint's commit, leaves the same rows. Nothing is rewritten that earlier
batches wrote: a retracted or replaced version stays and is left out on reading,
as :func:`current` does.

Two versions of a path in one batch: the one from the later file counts, then the
one with the greater address. Tables that do not exist yet are empty.
"""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import DOCUMENTS, as_files, main
from quarrylake.functions import text
from quarrylake.operators import chunks
from quarrylake.plans.ship import ship

log = logging.getLogger("jobs.ingest")

VERSIONS = "path string, doc_id long, source string, sha256 string, size_bytes long, line_count int, token_est int, arrived timestamp, batch long, lang string"
CHUNKS = "sha256 string, ord int, start_line int, end_line int, text string, token_est int, batch long"
CHANGES = "path string, change string, batch long"


def run(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 256) -> int:
    """Take in what is new in ``source``; returns the number of documents read."""
    ship(spark)
    stream = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", int(files_per_batch)).parquet(pattern(source))
    stream = stream.select("*", F.col("_metadata.file_modification_time").alias("arrived"))
    read: list[int] = []

    def each(batch: DataFrame, number: int) -> None:
        read.append(take_in(batch, number, target))

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = sum(read)
    log.info("read %d documents of %s, wrote to %s", rows, source, target)
    return rows


def pattern(source: str) -> str:
    """The source as a pattern that only it matches: a file stream takes a single file only by a pattern."""
    source = source.rstrip("/")
    return source if any(c in source for c in "*?[{") else f"{source[:-1]}[{source[-1]}]"


def take_in(batch: DataFrame, number: int, target: str) -> int:
    """Write one batch of documents (with ``arrived``) and return how many it has; the same batch may be written again."""
    spark, seen = batch.sparkSession, Observation()
    body = F.col("text")
    docs = as_files(batch).withColumn("sha256", F.sha2(body, 256))
    facts = docs.select(
        "path", "doc_id", "source", "lang", "sha256", F.octet_length(body).cast("long").alias("size_bytes"), text.line_count(body).cast("int").alias("line_count"),
        text.token_estimate(body).cast("int").alias("token_est"), "arrived",
    ).observe(seen, F.count(F.lit(1)).alias("n"))
    # A null address comes first, so that a text of the same file outlives its retraction.
    latest = facts.groupBy("path").agg(F.max_by(F.struct(*[c for c in facts.columns if c != "path"]), F.struct("arrived", F.coalesce("sha256", F.lit("")))).alias("v")).select("path", "v.*")
    files = write(latest.withColumn("batch", F.lit(number).cast("long")), f"{target}/files", ["batch", "lang"])

    before = versions(spark, target).where(F.col("batch") < number)
    own = versions(spark, target).where(F.col("batch") == number)
    known = latest_of(before).select("path", F.col("sha256").alias("was"), F.lit(True).alias("had"))
    change = (
        F.when(F.col("sha256").isNull(), F.when(F.col("was").isNotNull(), "removed").otherwise("unchanged"))
        .when(F.col("was").isNull(), "added").when(F.col("was") == F.col("sha256"), "unchanged").otherwise("changed")
    )
    told = write(own.join(known, "path", "left").select("path", change.alias("change"), "batch"), f"{target}/changes", ["batch"])

    # Of the copies of a content, the one with the least path gives the text, so that no task gets them all.
    fresh = own.where("sha256 is not null").groupBy("sha256").agg(F.min("path").alias("path")).join(before.select("sha256").distinct(), "sha256", "left_anti")
    contents = docs.select("sha256", "path", "text").join(fresh, ["sha256", "path"], "left_semi").groupBy("sha256").agg(F.any_value("text").alias("text"))
    made = chunks.chunks(contents, ["sha256"]).withColumn("batch", F.lit(number).cast("long"))
    cut = write(made, f"{target}/chunks", ["batch"])
    log.info("batch %d: read %d documents, wrote %d versions, %d changes, %d chunks", number, seen.get["n"], files, told, cut)
    return seen.get["n"]


def write(rows: DataFrame, path: str, by: list[str]) -> int:
    """Overwrite the partitions that the rows belong to; returns their number."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return seen.get["n"]


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the target; empty while nothing has been written there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def versions(spark: SparkSession, target: str) -> DataFrame:
    """Every version of every path."""
    return table(spark, f"{target}/files", VERSIONS)


def latest_of(rows: DataFrame) -> DataFrame:
    """The last version of each path, retractions too."""
    return rows.groupBy("path").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "path"]), "batch").alias("v")).select("path", "v.*")


def current(spark: SparkSession, target: str) -> DataFrame:
    """The files as they stand: the last version of each path that is not retracted."""
    return latest_of(versions(spark, target)).where("sha256 is not null")


def current_chunks(spark: SparkSession, target: str) -> DataFrame:
    """The chunks of the files as they stand: path, doc_id, sha256, ord, start_line, end_line, text, token_est."""
    made = table(spark, f"{target}/chunks", CHUNKS).drop("batch")
    return current(spark, target).select("path", "doc_id", "sha256").join(made, "sha256").select("path", "doc_id", "sha256", "ord", "start_line", "end_line", "text", "token_est")


if __name__ == "__main__":
    main(run, "ingest", ["source", "target", "checkpoint"])
