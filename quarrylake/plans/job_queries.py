"""The jobs as queries: each runs twice into one new folder, and its whole output is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import ingest, navigate
from quarrylake.plans import scratch
from quarrylake.plans.registry import ORACLES, query


@query("SELECT source || '/' || lang || '/' || c.doc_id AS path, c.doc_id, lower(sha256(text)) AS sha256, 'added' AS change, ord, start_line, end_line, token_est FROM (" + ORACLES["chunk_documents"] + ") c JOIN documents d ON d.doc_id = c.doc_id")
def job1_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X21, S18, K3, C3 as a stream: documents taken in by content, and the chunks of the files as they stand."""
    target = scratch.fresh(spark, "job1")
    for _ in range(2):
        ingest.run(spark, f"{sf_dir}/documents.parquet", f"{target}/tables", f"{target}/checkpoint")
    changes = spark.read.parquet(f"{target}/tables/changes").select("path", "change")
    return ingest.current_chunks(spark, f"{target}/tables").join(changes, "path").select("path", "doc_id", "sha256", "change", "ord", "start_line", "end_line", "token_est")


NAVIGATE = r"""RECURSIVE f AS (SELECT source || '/' || lang || '/' || doc_id AS path, source AS module, lang, text, CASE WHEN text = '' THEN 0 ELSE len(str_split(text, chr(10))) END AS lines, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents),
clean AS (SELECT path, regexp_replace(regexp_replace(array_to_string(list_filter(str_split(text, chr(10)), lambda x: NOT regexp_matches(ltrim(x), '^(<|!\[|\[!\[)')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM f),
begun AS (SELECT path, coalesce(trim(regexp_replace(left(list_filter(list_transform(str_split(t, chr(10) || chr(10)), lambda p: regexp_replace(regexp_replace(regexp_replace(p, '^\s+|\s+$', '', 'g'), '^#+', ''), '^\s+|\s+$', '', 'g')), lambda p: p <> '' AND NOT starts_with(p, '!'))[1], 120), '\s+', ' ', 'g')), '') AS beginning FROM clean),
l AS (SELECT module, lang, count(*) AS n, min(path) AS first FROM f GROUP BY ALL),
h AS (SELECT module, count(*) AS files, sum(lines) AS lines, sum(tokens) AS tokens, (SELECT string_agg(lang, ', ' ORDER BY n DESC, first) FROM (SELECT * FROM l WHERE l.module = f.module ORDER BY n DESC, first LIMIT 3)) AS langs FROM f GROUP BY module),
b AS (SELECT module, path, '- ' || path || ' (' || lang || ', ' || lines || ' lines, ' || tokens || ' tokens)' || CASE WHEN beginning <> '' THEN ': ' || beginning ELSE '' END AS block FROM f JOIN begun USING (path)),
c AS (SELECT *, CAST(ceil(length(block) / 4.0) AS BIGINT) + 1 AS tokens FROM b),
s AS (SELECT * FROM (SELECT *, CAST(sum(tokens) OVER (PARTITION BY module ORDER BY path) AS BIGINT) AS used FROM c) WHERE used <= 4000),
top AS (SELECT module, '# ' || module || chr(10) || files || ' files, ' || lines || ' lines, about ' || tokens || ' tokens (' || langs || ')' AS block FROM h),
e AS (SELECT module, files - coalesce(n, 0) || ' of ' || files || ' files are not shown; go on after ' || coalesce(last, 'the head') || ' or raise the budget' AS block, coalesce(used, 0) AS used FROM h LEFT JOIN (SELECT module, count(*) AS n, max(path) AS last, max(used) AS used FROM s GROUP BY module) USING (module) WHERE files > coalesce(n, 0)),
o AS (SELECT module, '- ' || module || ': ' || files || ' files, about ' || tokens || ' tokens (' || langs || ')' AS block, row_number() OVER (ORDER BY files DESC, module) AS place FROM h),
u AS (SELECT * FROM (SELECT *, CAST(sum(CAST(ceil(length(block) / 4.0) AS BIGINT) + 1) OVER (ORDER BY place) AS BIGINT) AS used FROM o) WHERE used <= 1000)
SELECT 'digest' AS kind, module, CAST(0 AS INTEGER) AS part, '' AS path, block, CAST(ceil(length(block) / 4.0) AS BIGINT) + 1 AS used FROM top
UNION ALL SELECT 'digest', module, 1, path, block, used FROM s
UNION ALL SELECT 'digest', module, 2, '', block, used + CAST(ceil(length(block) / 4.0) AS BIGINT) + 1 FROM e
UNION ALL SELECT 'overview', module, 1, '', block, used FROM u
UNION ALL SELECT 'overview', '', 2, '', (count(*) - (SELECT count(*) FROM u)) || ' of ' || count(*) || ' modules are not shown; raise the budget', coalesce((SELECT max(used) FROM u), 0) + CAST(ceil(length((count(*) - (SELECT count(*) FROM u)) || ' of ' || count(*) || ' modules are not shown; raise the budget') / 4.0) AS BIGINT) + 1 FROM h HAVING count(*) > (SELECT count(*) FROM u)"""


@query(f"WITH {NAVIGATE}")
def job2_navigate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of all modules within budgets, with their overview."""
    target = scratch.fresh(spark, "job2")
    for _ in range(2):
        navigate.run(spark, f"{sf_dir}/documents.parquet", target)
    blocks = navigate.digest_lines(spark, target).select(F.lit("digest").alias("kind"), "module", "part", "path", "block", "used")
    lines = spark.read.parquet(f"{target}/overview").select(F.lit("overview").alias("kind"), "module", "part", F.lit("").alias("path"), "block", "used")
    return blocks.unionByName(lines)
