"""Contents by address in bucketed tables: reads and checks join them where they lie.

``files`` (path and address of every file) and ``blobs`` (each content once) are
written in the same number of buckets of the address, sorted in each. A check of
all contents joins bucket to bucket without an exchange of either; a batch of
reads exchanges its requests alone. Tables have paths of their own and names that
nothing else has.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.functions import text
from quarrylake.operators import verify

#: Rows of a bucket, about.
BUCKET_ROWS = 250_000


def bucketed(rows: DataFrame, path: str, buckets: int, key: str = "sha256") -> DataFrame:
    """Write rows as a table of so many buckets, one file each, and read it back."""
    name = f"bucketed_{uuid.uuid4().hex}"
    rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
    return rows.sparkSession.table(name)


def buckets_for(rows: DataFrame) -> int:
    """Buckets for so many rows: never fewer than the session's own setting."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // BUCKET_ROWS))


def write(files: DataFrame, path: str, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Store (path, content) as tables of files (path, sha256, size_bytes) and blobs (sha256, content); a null content is no file."""
    rows = verify.digests(files.where("content is not null").select("path", "content"))
    buckets = buckets or buckets_for(rows)
    own = bucketed(rows.select("path", "sha256", "size_bytes"), f"{path}/files", buckets)
    return own, bucketed(verify.blobs(rows), f"{path}/blobs", buckets)


def checked(files: DataFrame, blobs: DataFrame) -> DataFrame:
    """(path, sha256, state) of every file, each content hashed again where it lies."""
    return verify.check(files, blobs)


def read_many(requests: DataFrame, files: DataFrame, blobs: DataFrame) -> DataFrame:
    """The lines of a batch of requests (path, first, last, and any others): those of the file's text, moved into it; null where there is no such file.

    Requests find their address, and then go to its bucket.
    """
    known = requests.join(files.select("path", "sha256"), "path", "left")
    body = F.make_valid_utf8(F.col("content").cast("string"))
    met = known.join(blobs.hint("merge"), "sha256", "left")
    return met.select(*requests.columns, F.when(F.col("content").isNotNull(), text.line_slice(body, F.col("first"), F.col("last"))).alias("lines"))
