"""The graph of imports: resolution, dependents, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.functions import paths


def import_index(files: DataFrame) -> DataFrame:
    """(kind, value, target): every import key and every path, with the first file that has it."""
    keys = files.select("path", F.explode(paths.index_keys(F.col("path"))).alias("value")).groupBy("value").agg(F.min("path").alias("target"))
    own = files.select(F.lit("path").alias("kind"), F.col("path").alias("value"), F.col("path").alias("target")).distinct()
    return keys.select(F.lit("key").alias("kind"), "value", "target").unionByName(own)


def resolve(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, target) of the imports that mean a file: the first candidate that is known decides."""
    tried = edges.select("src", "dst").distinct().select("src", "dst", F.posexplode(paths.import_candidates(F.col("dst"), F.col("src"))).alias("place", "c")).select("src", "dst", "place", "c.kind", "c.value")
    return tried.join(import_index(files), ["kind", "value"]).groupBy("src", "dst").agg(F.min_by("target", "place").alias("target"))


def dependents(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(path, dependents): how many other files import a file."""
    pairs = resolve(edges, files).select("src", "target").where("src <> target").distinct()
    return pairs.groupBy(F.col("target").alias("path")).agg(F.count("*").alias("dependents"))


def key_files(edges: DataFrame, files: DataFrame, most: int = 15) -> DataFrame:
    """The files with the most dependents; ties go by path."""
    return dependents(edges, files).orderBy(F.desc("dependents"), "path").limit(most)


def imports_of(edges: DataFrame, path: str) -> DataFrame:
    """The distinct tokens that a file imports."""
    return edges.where(F.col("src") == path).select("dst").distinct().orderBy("dst")


def importers(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(path, src): for every file at once, the other files whose imports equal a key of it or end in one, whatever the case of ASCII letters.

    A suffix index: each distinct import is cut to its endings of those lengths
    that keys have, and endings are joined to keys by equality, so no file is
    compared with imports that do not mean it.
    """
    low = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keys = files.select("path", F.explode(paths.neighbour_keys(F.col("path"))).alias("key")).select("path", low("key").alias("ending")).distinct()
    # As many values as a path may have characters.
    sizes = sorted(r["n"] for r in keys.select(F.char_length("ending").alias("n")).distinct().collect())
    tokens = edges.select("dst").distinct()
    fits = F.filter(F.array(*(F.lit(n) for n in sizes)) if sizes else F.array().cast("array<int>"), lambda n: n <= F.char_length("dst"))
    endings = tokens.select("dst", F.explode(fits).alias("n")).select("dst", low(F.expr("right(dst, n)")).alias("ending"))
    means = endings.join(keys, "ending").select("dst", "path").distinct()
    return edges.select("src", "dst").distinct().join(means, "dst").where("src <> path").select("path", "src").distinct()


def imported_by(edges: DataFrame, path: str, limit: int = 50) -> DataFrame:
    """Files whose imports equal a key of a file or end in it, whatever the case of ASCII letters.

    The keys of one file are few, so they are literals of one filter, and the
    edges are read once without a join.
    """
    keys = edges.sparkSession.range(1).select(paths.neighbour_keys(F.lit(path)).alias("keys")).first()["keys"]
    match = F.lit(False)
    for key in keys:
        match = match | (F.col("dst") == key) | F.lower("dst").endswith(key.lower())
    return edges.where(match & (F.col("src") != path)).select("src").distinct().orderBy("src").limit(limit)
