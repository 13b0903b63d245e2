"""Ranked retrieval: exact phrase BM25, vector search, fusion and diversification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.functions import paths, text
from quarrylake.operators.postings import LEAST_IDF, K1, B

# Fixed values of the ranking rules.
RRF_K = 60
TEST_PENALTY = 0.4
MMR_WEIGHT, LEAST_RELEVANCE = 0.5, 0.1
POOL_TIMES, LEAST_POOL = 3, 20
#: Query vectors that a task compares at once, and vectors of a group that meets them.
QUERY_BLOCK, VECTOR_BLOCK = 1024, 262_144


def pool_size(k: int) -> int:
    """Candidates that each ranker gives for k results."""
    return max(POOL_TIMES * k, LEAST_POOL)


def query_table(spark, queries: dict[str, str]) -> DataFrame:
    """(query_id, phrase_no, phrase): a row for each phrase of each query."""
    rows = [(q, n, p) for q, given in queries.items() for n, p in enumerate(text.phrases(given))]
    return spark.createDataFrame(rows, "query_id string, phrase_no int, phrase array<string>")


def positions(units: DataFrame, unit_id: str, columns: list[str]) -> DataFrame:
    """The inverted index's rows: (unit_id, dl, col, pos, term). Write them sorted by term to prune by it later."""
    parts = F.array(*(F.struct(F.lit(c).alias("col"), text.terms(F.coalesce(F.col(c), F.lit(""))).alias("terms")) for c in columns))
    whole = units.select(F.col(unit_id).alias("unit_id"), parts.alias("parts"))
    by_column = whole.select("unit_id", F.aggregate("parts", F.lit(0), lambda n, p: n + F.size(p["terms"])).alias("dl"), F.explode("parts").alias("part"))
    return by_column.select("unit_id", "dl", "part.col", F.posexplode("part.terms").alias("pos", "term"))


def lengths(units: DataFrame, unit_id: str, columns: list[str]) -> DataFrame:
    """(unit_id, dl): terms over all columns, for every unit."""
    return units.select(F.col(unit_id).alias("unit_id"), sum((F.size(text.terms(F.coalesce(F.col(c), F.lit("")))) for c in columns), F.lit(0)).alias("dl"))


def bm25(units: DataFrame, unit_id: str, columns: list[str], queries: DataFrame) -> DataFrame:
    """(query_id, unit_id, score) of units that hold every phrase of a query, for units without an index."""
    stats = lengths(units, unit_id, columns).agg(F.count("*").alias("rows"), F.avg("dl").alias("mean")).first()
    return _scored(positions(units, unit_id, columns), stats["rows"], stats["mean"] or 1.0, queries).drop("dl")


def _scored(postings: DataFrame, rows: int, mean: float, queries: DataFrame) -> DataFrame:
    """Score postings (unit_id, dl, col, pos, term).

    A phrase lies inside one column; phrases may lie in different ones.
    Statistics are over all units. Terms that no query has are dropped before
    anything is exchanged.
    """
    asked = queries.select("query_id", "phrase_no", F.size("phrase").alias("terms"), F.posexplode("phrase").alias("at", "term"))
    of_query = queries.groupBy("query_id").agg(F.count("*").alias("phrases"))
    met = postings.join(asked, "term")
    starts = met.groupBy("query_id", "phrase_no", "terms", "unit_id", "dl", "col", (F.col("pos") - F.col("at")).alias("start")).agg(F.count("*").alias("n")).where("n = terms")
    found = starts.groupBy("query_id", "phrase_no", "unit_id", "dl").agg(F.count("*").alias("tf"))
    frequency = found.groupBy("query_id", "phrase_no").agg(F.count("*").alias("df"))
    idf = F.log((F.lit(rows) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(F.greatest(idf, F.lit(LEAST_IDF)))
    score = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(mean or 1.0)))
    scored = found.join(frequency, ["query_id", "phrase_no"]).select("query_id", "unit_id", "dl", score.alias("part"))
    whole = scored.groupBy("query_id", "unit_id", "dl").agg(F.sum("part").alias("score"), F.count("*").alias("met")).join(of_query, "query_id")
    return whole.where("met = phrases").select("query_id", "unit_id", "dl", "score")


def top(scored: DataFrame, k: int, tie: str = "unit_id") -> DataFrame:
    """The k best rows of each query, with rank from 0; ties go to the smaller unit."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), tie))
    # The bare row number is compared, so that Spark keeps k rows of a query in each task before it exchanges them.
    return scored.withColumn("rank", place).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def normalized(vector: Column) -> Column:
    """The vector scaled to length 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(vector, lambda x: x / norm)).otherwise(F.transform(vector, lambda x: x.cast("double")))


def vector_top(vectors: DataFrame, vec_id: str, vector: str, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, unit_id, score): the k nearest vectors of each query by cosine, by brute force in blocks on the executors.

    ``queries`` has query_id (long) and vector. Queries are dealt to blocks of
    about QUERY_BLOCK, vectors to groups of about VECTOR_BLOCK, and each block
    meets each group in one task, which holds the block and its k best while the
    group streams by. The plan does not grow with either side, nothing passes the
    driver but the two counts. Null vectors and those of another dimension than a
    query's are left out.
    """
    spark = vectors.sparkSession
    asked = queries.select(F.col("query_id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("v")).where("v is not null and id is not null")
    base = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    blocks = -(-asked.count() // QUERY_BLOCK) or 1
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-base.count() // VECTOR_BLOCK))
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n).cast("long"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = asked.select("id", "v", F.lit(0).alias("base"), place(blocks).alias("b")).withColumn("g", each(groups))
    right = base.select("id", "v", F.lit(1).alias("base"), place(groups).alias("g")).withColumn("b", each(blocks)).select(*left.columns[:4], "g")
    met = left.unionByName(right).repartition("b", "g").sortWithinPartitions("b", "g", "base")
    found = met.select("b", "g", "base", "id", "v").mapInArrow(lambda batches: _nearest(batches, k), "query_id long, unit_id long, score double")
    return top(found.withColumn("score", F.round("score", 6)), k)


def _nearest(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best of each query in each cell: a cell's queries come before its vectors."""
    cell, asked = None, {}

    def told() -> Iterator[pa.RecordBatch]:
        for ids, _, score, unit in asked.values():
            n = score.shape[1]
            keep = np.isfinite(score.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)[keep]), pa.array(unit.ravel()[keep]), pa.array(score.ravel()[keep])], ["query_id", "unit_id", "score"])

    for batch in batches:
        b, g, base = (batch.column(n).to_numpy() for n in range(3))
        edges = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (g[1:] != g[:-1]) | (base[1:] != base[:-1])]))
        for begin, end in zip(edges, np.append(edges[1:], len(b)), strict=True):
            if (b[begin], g[begin]) != cell:
                yield from told()
                cell, asked = (b[begin], g[begin]), {}
            rows = batch.slice(begin, end - begin)
            sizes = np.diff(rows.column(4).offsets.to_numpy())
            for size in np.unique(sizes):
                at = pa.array(np.flatnonzero(sizes == size))
                ids, x = rows.column(3).take(at).to_numpy(), _unit(rows.column(4).take(at).flatten().to_numpy().reshape(len(at), size))
                if not base[begin]:
                    before = asked.get(size, (ids[:0], x[:0], np.zeros((0, k)), np.zeros((0, k), np.int64)))
                    n = len(ids)
                    asked[size] = np.append(before[0], ids), np.vstack([before[1], x]), np.vstack([before[2], np.full((n, k), -np.inf)]), np.vstack([before[3], np.zeros((n, k), np.int64)])
                elif size in asked:
                    own, q, score, unit = asked[size]
                    for part in range(0, len(ids), 4096):
                        some = ids[part : part + 4096]
                        score = np.hstack([score, q @ x[part : part + 4096].T])
                        unit = np.hstack([unit, np.broadcast_to(some, (len(own), len(some)))])
                        order = np.lexsort((unit, -np.round(score, 12)), axis=1)[:, :k]
                        score, unit = np.take_along_axis(score, order, 1), np.take_along_axis(unit, order, 1)
                    asked[size] = own, q, score, unit
    yield from told()


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=x.copy(), where=norm > 0)


def fuse(ranked: DataFrame, key: list[str], carry: list[str] | None = None) -> DataFrame:
    """Reciprocal rank fusion of lists (query_id, list_no, rank, key columns): fused score, and the lists that have the row.

    ``carry`` columns are those of the first list that has the row.
    """
    first = F.min_by(F.struct(*(carry or key)), F.struct("list_no", "rank")).alias("first")
    fused = ranked.groupBy("query_id", *key).agg(F.sum(1 / (RRF_K + F.col("rank") + 1)).alias("raw"), F.array_sort(F.collect_set("list_no")).alias("lists"), F.min(F.struct("list_no", "rank")).alias("order"), first)
    rest = [F.col(f"first.{c}").alias(c) for c in carry or [] if c not in key]
    return fused.select("query_id", *key, *rest, "raw", "lists", "order")


def demote_tests(score: Column, path: Column, wants_tests: Column) -> Column:
    """Scores of test files are lowered unless the query is about tests."""
    return F.when(paths.is_test(path) & ~wants_tests, score * TEST_PENALTY).otherwise(score)


def diversify(ranked: DataFrame, k: int) -> DataFrame:
    """Maximal marginal relevance within each query's pool (query_id, score, place, name, snippet and others).

    A pool is bounded by the rankers, so one query's rows fit one task. Rows keep
    their columns and get pick, their place in the new order.
    """

    def run(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values("place", kind="stable").reset_index(drop=True)
        picked = select(pool["score"].tolist(), [tokens(n, s) for n, s in zip(pool["name"], pool["snippet"], strict=True)], k)
        return pool.iloc[picked].assign(pick=range(len(picked)))

    from pyspark.sql import types as T

    schema = T.StructType([*ranked.schema.fields, T.StructField("pick", T.IntegerType())])
    return ranked.groupBy("query_id").applyInPandas(run, schema)


def tokens(name: str | None, snippet: str | None) -> frozenset[str]:
    """Content words of a result: of its name and the first 240 characters of its snippet."""
    import re

    return frozenset(w for w in re.findall("[a-z0-9]+", f"{name or ''} {(snippet or '')[:240]}".lower()) if len(w) > 1)


def select(scores: list[float], words: list[frozenset[str]], k: int) -> list[int]:
    """Places picked: the best first, then those whose relevance outweighs what they share with the picked."""
    if len(scores) <= 1:
        return list(range(min(k, len(scores))))
    norm = scores[0] if scores[0] > 0 else 1.0
    relevance = np.array(scores) / norm
    shared = np.zeros(len(scores))
    picked, left = [0], np.ones(len(scores), bool)
    left[0] = False
    while left.any() and len(picked) < k:
        last = words[picked[-1]]
        shared = np.maximum(shared, [len(w & last) / len(w | last) if w and last else 0.0 for w in words])
        value = np.where(left, MMR_WEIGHT * relevance - (1 - MMR_WEIGHT) * shared, -np.inf)
        best = int(value.argmax())
        if value[best] <= 0 or relevance[best] < LEAST_RELEVANCE:
            break
        picked.append(best)
        left[best] = False
    return picked


def hit_metrics(ranked: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """hit_rate, mrr and mean_tokens of ranked rows (query_id, rank, relevant, tokens) over all queries.

    Tokens count what is read up to the first relevant row, or all rows if none is.
    """
    own = ranked.where(F.col("rank") < k)
    read = Window.partitionBy("query_id").orderBy("rank")
    seen = own.withColumn("first", F.min(F.when(F.col("relevant"), F.col("rank"))).over(Window.partitionBy("query_id"))).withColumn("cost", F.sum("tokens").over(read))
    each = seen.groupBy("query_id").agg(F.min("first").alias("first"), F.max(F.when(F.col("first").isNull() | (F.col("rank") <= F.col("first")), F.col("cost"))).alias("cost"))
    every = queries.select("query_id").distinct().join(each, "query_id", "left")
    return every.agg(
        F.count("*").alias("queries"),
        F.count("first").alias("hits"),
        F.round(F.avg(F.coalesce(1 / (F.col("first") + 1), F.lit(0.0))), 6).alias("mrr"),
        F.round(F.avg(F.coalesce("cost", F.lit(0))), 6).alias("mean_tokens"),
    )
