"""The queries of this package, by name, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.llm import _common as C
from quarrylake.llm import conversations, edit_counts, embedding_dedup, fingerprints, minhash, packing, piece_codec, quality, sharding, site_tree, toxicity, warc


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into pieces of at most 1024 tokens, packed by minimum bin slack."""
    docs = C.table(spark, sf_dir, "documents", ["doc_id", "text"])
    return packing.pack_documents(docs, with_ids=False)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of every document and of its edited text, compared."""
    return fingerprints.compared(C.table(spark, sf_dir, "documents", ["doc_id", "text"]))


def op3_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after three edits, kept by a tree of its segments."""
    docs = C.table(spark, sf_dir, "documents", ["doc_id", "text"])
    return edit_counts.edited_counts(docs, edit_counts.sample_edits(C.whole_text())).drop("text")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written to archives and read back."""
    return warc.round_trip(C.table(spark, sf_dir, "pages", ["page_id", "url", "html"]))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in one of forty shards of equal numbers of rows."""
    return sharding.assign(C.table(spark, sf_dir, "documents", ["doc_id", "text"]))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, learnt from the labels outside the held-out remainder."""
    docs = C.table(spark, sf_dir, "documents", ["doc_id", "text"])
    model = toxicity.train(docs, C.table(spark, sf_dir, "labels", ["doc_id", "toxic"]))
    return toxicity.add_score(docs, model).select("doc_id", C.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding with its number of links at a cosine of 0.95 and its component."""
    return embedding_dedup.near_duplicates(C.table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the group of near-duplicates that it belongs to."""
    return minhash.near_duplicates(C.table(spark, sf_dir, "documents", ["doc_id", "text"]))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document, learnt from the labels outside the held-out remainder."""
    docs = C.table(spark, sf_dir, "documents", ["doc_id", "text"])
    model = quality.train(docs, C.table(spark, sf_dir, "labels", ["doc_id", "quality"]))
    return quality.add_score(docs, model).select("doc_id", C.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids and the decoded text of every document, as digests."""
    return piece_codec.round_trip_digest(C.table(spark, sf_dir, "documents", ["doc_id", "text"]))


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, by the style tree of its host."""
    return site_tree.main_texts(C.table(spark, sf_dir, "pages", ["page_id", "url", "html"]))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by rule, with its faults and its cheapest repair."""
    return conversations.repair(conversations.damaged(C.table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_fingerprints": op2_fingerprints,
    "op3_edit_counts": op3_edit_counts,
    "op4_warc": op4_warc,
    "op5_sharding": op5_sharding,
    "op6_toxicity": op6_toxicity,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_minhash": op8_minhash,
    "op9_quality": op9_quality,
    "op10_piece_codec": op10_piece_codec,
    "op11_html_text": op11_html_text,
    "op12_conversation_repair": op12_conversation_repair,
}
ORACLES: dict[str, str] = {
    "op4_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), t AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top, sha1(h) AS d FROM p)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(d, CAST(k // 8 * 10 + 1 AS INTEGER), 10) AS BIGINT) >> CAST(35 - 5 * (k % 8) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM t""",
    "op7_embedding_dedup": """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS l FROM v),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.95 * a.l * b.l),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b), parts AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM parts LEFT JOIN counts USING (vec_id)""",
    # CRC-32 bit by bit, the damage, then the four states' (cost, audit) row by row.
    "op12_conversation_repair": r"""WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')) AS k FROM conversations),
harm AS (SELECT *, xor(list_reduce(flatten(list_transform(range(octet_length(k)), lambda i: list_transform(range(8), lambda b: (CAST('0x' || substr(hex(k), 2 * i + 1, 2) AS BIGINT) >> b) & 1))), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295), 4294967295) % 20 AS h FROM src),
rows_ AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM harm, range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
nth AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS copy, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS prior, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, left(role, 1) AS i FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM rows_)),
faults AS (SELECT *, bare = '' AS blank, bare <> '' AND copy > 1 AS duplicate, bare <> '' AND copy = 1 AND right(bare, 1) NOT IN ('.', '!', '?') AS cut, prior IS NOT NULL AND prior || i NOT IN ('su', 'ua', 'au') AS illegal FROM nth),
ids AS (SELECT DISTINCT conv_id FROM conversations),
walk AS (SELECT conv_id, CAST(0 AS BIGINT) AS n, {'c': 0, 'a': ''} AS p0, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR)) AS p1, {'c': 5, 'a': 'I'} AS p2, {'c': 10, 'a': 'II'} AS p3 FROM ids
  UNION ALL SELECT conv_id, n, p0, p1, CASE WHEN p3.c IS NULL THEN p2 ELSE least(p2, {'c': p3.c + 5, 'a': p3.a || 'I'}) END, p3 FROM (
    SELECT conv_id, n, p0, p1, p2, CASE WHEN p2.c IS NULL THEN p3 WHEN p3.c IS NULL THEN {'c': p2.c + 5, 'a': p2.a || 'I'} ELSE least(p3, {'c': p2.c + 5, 'a': p2.a || 'I'}) END AS p3 FROM (
      SELECT conv_id, n, p0, p1, list_min(list_filter([p2, {'c': p0.c + 5, 'a': p0.a || 'I'}, {'c': p1.c + 5, 'a': p1.a || 'I'}, {'c': p3.c + 5, 'a': p3.a || 'I'}], lambda x: x.c IS NOT NULL)) AS p2, p3 FROM (
        SELECT w.conv_id, f.n, {'c': p0.c + 2, 'a': p0.a || 'D'} AS p0,
          list_min(list_filter([{'c': p1.c + 2, 'a': p1.a || 'D'}, {'c': CASE WHEN NOT (blank OR duplicate) AND i = 's' THEN p0.c + 5 * cut::INT END, 'a': p0.a || 'K'}], lambda x: x.c IS NOT NULL)) AS p1,
          list_min(list_filter([{'c': p2.c + 2, 'a': p2.a || 'D'}, {'c': u + p0.c, 'a': p0.a || lu}, {'c': u + p1.c, 'a': p1.a || lu}, {'c': u + p3.c, 'a': p3.a || lu}], lambda x: x.c IS NOT NULL)) AS p2,
          list_min(list_filter([{'c': p3.c + 2, 'a': p3.a || 'D'}, {'c': s + p2.c, 'a': p2.a || ls}], lambda x: x.c IS NOT NULL)) AS p3
        FROM walk w JOIN (SELECT *, CASE WHEN NOT (blank OR duplicate) THEN 5 * cut::INT + (i <> 'u')::INT END AS u, CASE WHEN i = 'u' THEN 'K' ELSE 'R' END AS lu, CASE WHEN NOT (blank OR duplicate) THEN 5 * cut::INT + (i <> 'a')::INT END AS s, CASE WHEN i = 'a' THEN 'K' ELSE 'R' END AS ls FROM faults) f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.n = w.n + 1)))),
ended AS (SELECT conv_id, CASE WHEN p3.c IS NULL THEN p0 ELSE least(p0, p3) END AS p FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1),
edits AS (SELECT conv_id, j, substr(p.a, CAST(j AS INTEGER), 1) AS e, len(replace(substr(p.a, 1, CAST(j AS INTEGER)), 'I', '')) AS n, len(replace(substr(p.a, 1, CAST(j AS INTEGER) - 1), 'D', '')) - len(replace(p.a, 'D', '')) % 2 AS place FROM ended, range(1, len(p.a) + 1) AS t(j)),
turns AS (SELECT e.conv_id, j, CASE WHEN e = 'K' THEN f.role WHEN place % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE f.text END AS t FROM edits e LEFT JOIN faults f ON e.conv_id IS NOT DISTINCT FROM f.conv_id AND e.n = f.n AND e.e <> 'I' WHERE e <> 'D'),
mended AS (SELECT conv_id, string_agg(t, chr(10) ORDER BY j) AS t FROM turns GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (illegal) AS illegal FROM faults GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(p.c AS BIGINT) AS cost, p.a AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM ended e LEFT JOIN counts c ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN mended m ON e.conv_id IS NOT DISTINCT FROM m.conv_id""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Each opN query by name."""
    return QUERIES


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    return ORACLES
