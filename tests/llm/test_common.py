"""Scratch tables and the held-out rule."""

import zlib

from quarrylake.llm import _common as C


def test_scratch(spark):
    rows = C.spill(spark.range(5), "five")
    assert sorted(r["id"] for r in rows.collect()) == [0, 1, 2, 3, 4]
    assert spark.conf.get("spark.checkpoint.dir") == C.shared_folder(spark)
    C.clear_scratch(spark)
    assert sorted(r["id"] for r in C.spill(spark.range(3), "three").collect()) == [0, 1, 2]


def test_held_out(spark):
    rows = spark.range(200).select("id", C.held_out(C.F.col("id"), 4, 2).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)
    assert spark.sql("select cast(null as long) id").select(C.held_out(C.F.col("id"), 4, 2).alias("h")).first()["h"] is False


def test_small_shares_of_many_rows(spark):
    from pyspark.sql import functions as F

    rows = spark.range(200_000).select(F.xxhash64("id").alias("k"))
    assert 150 < rows.where(C.share_below(F.col("k"), 0.001)).count() < 250
    assert rows.where(C.share_below(F.col("k"), 1.0)).count() == 200_000
    assert C.share_below(F.lit(0), 20_000 / 4e11)._jc.toString().split("<")[1].strip(" )") != "0"
    assert C.without(["A", "text", "N_Tokens"], ["n_tokens", "a"]) == ["text"]
