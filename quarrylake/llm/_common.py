"""What the operators of this package share: scratch tables, sizes and text rules."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows are dealt to tasks of about this many; tasks then stay small at any input size.
ROWS_PER_TASK = 200_000
SPACE = re.compile(r"\s")


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    """The named columns of a table; no other column is read from its files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset in
    a session of one machine a folder of our own is made and set for the session;
    on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quarrylake-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def scratch_folder(spark: SparkSession) -> str:
    """Where this application's scratch tables are."""
    return f"{shared_folder(spark)}/quarrylake/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables; results that are not written yet may still need them."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spill(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame to the shared folder and read it again.

    Cuts lineage so that a lost executor costs a reread, not a recomputation,
    and fixes values that a second evaluation might otherwise compute anew.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._scratch = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete scratch tables whose readers have all been written."""
    for df in tables:
        path = getattr(df, "_scratch", None)
        if path is not None:
            spark = df.sparkSession
            there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def partitions_for(spark: SparkSession, rows: int, per_task: int = ROWS_PER_TASK) -> int:
    """Tasks for so many rows: never fewer than the session's own setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """True where crc32 of the document id as text leaves the given remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


def without(columns: list[str], names: list[str]) -> list[str]:
    """The columns that are not named like one of the names; Spark tells names apart by more than case."""
    known = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in known]


def share_below(key: Column, share: float) -> Column:
    """True for about this share of rows by a hashed key; as fine as a double, so that a small share of many rows is not rounded to none."""
    parts = 2**53
    return F.pmod(key, F.lit(parts)) < F.lit(round(share * parts))


def whole_text(column: str = "text") -> Column:
    """The text, with a null taken as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def blocks(text: str, size: int = 1_000_000) -> Iterator[str]:
    """A text in parts of about so many characters that end before white space; a longer run without any stays whole."""
    begin = 0
    while begin < len(text):
        gap = SPACE.search(text, begin + size)
        end = gap.start() if gap else len(text)
        yield text[begin:end]
        begin = end


def pieces(texts: list[str], size: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters each."""
    begin, held = 0, 0
    for k, t in enumerate(texts, 1):
        held += len(t)
        if held > size or k == len(texts):
            yield begin, k
            begin, held = k, 0


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer file; looked up where it is used, so executors find their own copy."""
    import public_tokenizers

    return public_tokenizers.path(name)


def crc(data) -> int:
    """CRC-32 as an unsigned number."""
    return zlib.crc32(data) & 0xFFFFFFFF


def single_threaded() -> None:
    """Keep a tokenizer's own threads off: the executor's cores are already busy."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
