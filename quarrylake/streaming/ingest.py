"""Files that arrive over time: an extension of the batch engine to Structured Streaming.

New rows (path, text) are hashed, those whose content a day's state has seen are
dropped, and the rest is cut into chunks and appended. Each micro-batch writes to
a folder of its own number, so a batch that runs twice does no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrylake.operators import chunks

SCHEMA = "path string, text string, arrived timestamp"


def fresh(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Rows whose content has not been seen within the delay; state older than that is dropped."""
    addressed = stream.withColumn("sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    return addressed.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["sha256"])


def counts(stream: DataFrame, window: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Files and characters by window of arrival."""
    return stream.withWatermark("arrived", delay).groupBy(F.window("arrived", window)).agg(F.count("*").alias("files"), F.sum(F.char_length("text")).alias("chars"))


def chunk_stream(spark: SparkSession, source: str, out: str, checkpoint: str, delay: str = "1 day") -> StreamingQuery:
    """Chunks of all files that are in or come into a folder of Parquet tables; stops when it has caught up."""
    stream = spark.readStream.schema(SCHEMA).parquet(source)

    def append(batch: DataFrame, number: int) -> None:
        chunks.chunks(batch, ["path", "sha256"]).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return fresh(stream, delay).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
