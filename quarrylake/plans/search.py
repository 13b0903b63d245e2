"""Search for many questions at once: words in chunks and symbols, meaning in symbols, fused by reciprocal ranks."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylake.functions import embed, paths, text
from quarrylake.operators import postings, retrieval

RESULT = "path string, start int, end int, score double, snippet string, kind string, name string, source string"
LEXICAL, SEMANTIC = ("auto", "hybrid", "lexical"), ("auto", "hybrid", "semantic")


class Searched(NamedTuple):
    """What is searched: chunks and symbols with their indexes by (path, start_line, ord), and vectors of symbols' texts, or None."""

    chunks: DataFrame
    chunk_index: str
    symbols: DataFrame
    symbol_index: str
    vectors: DataFrame | None = None


def phrases_of(questions: DataFrame) -> DataFrame:
    """(query_id, phrase_no, phrase) of (query_id, question): a phrase for each word between white space, of its terms."""
    words = F.split(F.translate(F.coalesce("question", F.lit("")), "\n", " "), " ")
    found = F.filter(F.transform(words, text.terms), lambda p: F.size(p) > 0)
    return questions.select("query_id", F.posexplode(found).alias("phrase_no", "phrase"))


def search_many(spark: SparkSession, where: Searched, questions: DataFrame, k: int = 10, mode: str = "auto", diversify: bool = False, words: list[str] | None = None) -> DataFrame:
    """(query_id, rank, path, start, end, score, snippet, kind, name, source): the k best results of each question.

    Each ranker gives a pool for every question; pools are fused by reciprocal
    ranks and results in test files lowered unless a question asks for tests. Ties
    go to the list and rank that had the result first. ``words``: all terms of the
    questions, if they are few; then no other row groups of the indexes are read.
    """
    pool, lists = retrieval.pool_size(k), []
    questions = questions.select("query_id", F.coalesce("question", F.lit("")).alias("question"))
    units = where.chunks.select("path", "ord", "start_line", "end_line", F.col("text").alias("snippet"), F.lit("chunk").alias("kind"), F.lit(None).cast("string").alias("name"))
    shown = F.concat(F.col("kind"), F.lit(" "), F.col("name"), F.lit(": "), F.col("signature"))
    symbols = where.symbols.select("path", "ord", "start_line", "end_line", shown.alias("snippet"), "kind", "name", "signature", "docstring")
    columns = ["list_no", "query_id", "rank", "path", "start_line", "end_line", "snippet", "kind", "name"]
    if mode in LEXICAL:
        phrases = phrases_of(questions)
        for n, (path, rows) in enumerate(((where.chunk_index, units), (where.symbol_index, symbols))):
            found = postings.Index(spark, path).top(phrases, pool, words)
            named = rows.withColumn("unit_id", F.struct("path", "start_line", "ord"))
            lists.append(found.join(named, "unit_id").withColumn("snippet", text.snippet(F.col("snippet"))).withColumn("list_no", F.lit(n)).select(columns))
    if mode in SEMANTIC and where.vectors is not None:
        of_text = F.xxhash64("embed_text")
        asked = embed.vectors(questions.where(F.trim(F.col("question")) != "").select("query_id", F.col("question").alias("embed_text")))
        numbered = asked.where(F.exists("vector", lambda x: x != 0)).withColumn("number", F.xxhash64("query_id"))
        known = where.vectors.select("embed_text", "vector").withColumn("id", of_text)
        near = retrieval.vector_top(known, "id", "vector", numbered.select(F.col("number").alias("query_id"), "vector"), pool)
        texts = text.embed_text(F.col("kind"), F.col("name"), F.col("signature"), F.col("docstring"))
        meant = symbols.withColumn("embed_text", texts).withColumn("unit_id", of_text)
        scored = near.select(F.col("query_id").alias("number"), "unit_id", "score").join(numbered.select("number", "query_id"), "number").join(meant, "unit_id").withColumn("at", F.struct("path", "start_line", "ord"))
        lists.append(retrieval.top(scored.drop("unit_id"), pool, "at").withColumn("list_no", F.lit(2)).select(columns))
    if not lists:
        return spark.createDataFrame([], f"query_id {questions.schema['query_id'].dataType.simpleString()}, rank int, {RESULT}")
    ranked = lists[0]
    for more in lists[1:]:
        ranked = ranked.unionByName(more)
    fused = retrieval.fuse(ranked, ["path", "start_line", "kind"], ["path", "start_line", "kind", "end_line", "snippet", "name"]).join(questions, "query_id")
    score = F.round(retrieval.demote_tests(F.col("raw"), F.col("path"), paths.asks_for_tests(F.col("question"))), 6)
    source = F.when(F.array_contains("lists", 2), F.when(F.size("lists") > 1, "hybrid").otherwise("semantic")).otherwise("lexical")
    rows = fused.select("query_id", "path", F.col("start_line").alias("start"), F.col("end_line").alias("end"), score.alias("score"), "snippet", "kind", "name", source.alias("source"), "order")
    # A question has three pools at most, so its rows are few.
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "order", "path", "start", "kind")) - 1
    placed = rows.withColumn("place", place).drop("order")
    best = retrieval.diversify(placed, k).withColumn("place", F.col("pick")) if diversify else placed.where(F.col("place") < k)
    return best.select("query_id", F.col("place").alias("rank"), "path", "start", "end", "score", "snippet", "kind", "name", "source")
