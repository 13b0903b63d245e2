"""Integrity: content addresses, completeness, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.functions import paths


def digests(files: DataFrame, content: str = "content") -> DataFrame:
    """Add sha256 of the exact bytes, and their number."""
    data = F.col(content).cast("binary")
    return files.withColumn("sha256", F.sha2(data, 256)).withColumn("size_bytes", F.octet_length(data).cast("long"))


def blobs(files: DataFrame, known: DataFrame | None = None, content: str = "content") -> DataFrame:
    """(sha256, content): each distinct content once, without those already known."""
    fresh = files.select("sha256", F.col(content).cast("binary").alias("content")).dropDuplicates(["sha256"])
    return fresh if known is None else fresh.join(known.select("sha256").distinct(), "sha256", "left_anti")


def check(files: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, sha256, state) with state ok, missing or corrupt, each content hashed again."""
    seen = stored.select("sha256", (F.sha2("content", 256) == F.col("sha256")).alias("same"))
    state = F.when(F.col("same").isNull(), "missing").when(F.col("same"), "ok").otherwise("corrupt")
    return files.select("path", "sha256").join(seen, "sha256", "left").select("path", "sha256", state.alias("state"))


def missing(declared: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """Declared rows that are not among the files."""
    return declared.join(files.select(key).distinct(), key, "left_anti")


def coverage(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row: files of code languages, those with a symbol, and the share in percent (100 without code files)."""
    code = files.where(paths.is_code(F.col("lang"))).select("path")
    with_any = symbols.select("path").distinct().withColumn("has", F.lit(1))
    n = code.join(with_any, "path", "left").agg(F.count("*").alias("code_files"), F.count("has").alias("with_symbols"))
    share = F.when(F.col("code_files") > 0, F.round(100 * F.col("with_symbols") / F.col("code_files"), 1)).otherwise(F.lit(100.0))
    return n.withColumn("percent", share)
