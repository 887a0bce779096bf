"""Hard-negative mining. The origin of query q is the candidate at rank (q / 10) % 30 + 1 of 50."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mining
from . import fixtures
from .registry import query
from .sampling import digest_sql

_BASE = (
    fixtures.retrieved_sql(50)
    + f""",
k AS (SELECT *, 'doc ' || doc_id AS doc, 'query ' || query_id AS query FROM r),
o AS (SELECT query_id, doc_id, doc, score AS pos_score FROM k WHERE rank = (query_id // 10) % 30 + 1 AND query_id % 70 > 0),
b AS (SELECT o.*, pos_score AS raw, ref, CASE WHEN pos_score * 0.95 < ref THEN 'A' ELSE 'B' END AS branch FROM o JOIN (SELECT query_id, score AS ref FROM k WHERE rank = 20) USING (query_id)),
p AS (SELECT k.*, branch, raw FROM k JOIN b USING (query_id) WHERE k.doc_id <> b.doc_id),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN branch = 'A' THEN {digest_sql(42, 'query_id', 'doc_id')} ELSE lpad(CAST(rank AS VARCHAR), 10, '0') END, rank) AS INTEGER) AS place FROM p
  WHERE (branch = 'A' AND rank > 5 AND rank <= 20) OR (branch = 'B' AND score < raw * 0.95) QUALIFY place <= 8)"""
)


def _candidates(spark, d):
    rows = fixtures.retrieved(spark, d, 50)
    return rows.select("*", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("doc"), F.concat(F.lit("query "), F.col("query_id").cast("string")).alias("query"))


def _own(rows):
    return rows.where((F.col("rank") == F.floor(F.col("query_id") / 10) % 30 + 1) & (F.col("query_id") % 70 > 0)).select("query_id", "doc_id", "doc", F.col("score").alias("pos_score"))


def _mined(spark, d):
    rows = _candidates(spark, d)
    origins = _own(rows)
    return rows, origins, mining.mined(origins, mining.negatives(rows, origins, 5, 20, 8))


@query("n01_origins", f"""WITH {_BASE} SELECT query_id, doc_id, CASE WHEN query_id % 30 = 10 THEN NULL ELSE round(pos_score, 6) END AS pos_score,
CASE query_id % 30 WHEN 0 THEN 'own' WHEN 10 THEN 'sibling' ELSE 'item' END AS found FROM o""")
def n01(spark, d):
    rows = _candidates(spark, d)
    own = _own(rows)
    marked = rows.join(own.select("query_id", F.col("doc_id").alias("_o")), "query_id").withColumn("is_original", F.col("doc_id") == F.col("_o")).withColumn("source_id", F.col("_o"))
    items = own.select("query_id", F.col("doc_id").alias("source_id"), "doc", F.when(F.col("query_id") % 30 == 20, F.col("pos_score")).alias("pos_score"))
    # a document's other queries: given under ids of their own
    siblings = marked.where("query_id % 30 = 10").withColumn("query_id", F.col("query_id") + 1)
    cache = own.where("query_id < 0").select(F.col("doc_id").alias("source_id"), "doc")
    first = mining.resolve_origins(marked.where("query_id % 30 = 0"), siblings, cache, items.where("query_id % 30 <> 20"))
    last = mining.resolve_origins(marked.where("false"), siblings.where("false"), cache, items.where("query_id % 30 = 20"))
    return first.union(last).select("query_id", "doc_id", F.round("pos_score", 6).alias("pos_score"), "found")


@query("n02_branches", f"WITH {_BASE} SELECT query_id, round(raw, 6) AS raw, round(ref, 6) AS ref, branch FROM b")
def n02(spark, d):
    rows = _candidates(spark, d)
    return mining.branches(rows, _own(rows), 20).select("query_id", F.round("raw", 6).alias("raw"), F.round("ref", 6).alias("ref"), "branch")


@query("n03_pool", f"WITH {_BASE} SELECT query_id, doc_id, rank FROM p")
def n03(spark, d):
    rows = _candidates(spark, d)
    return mining.pool(rows, _own(rows)).select("query_id", "doc_id", "rank")


@query("n04_branch_a", f"WITH {_BASE} SELECT query_id, doc_id, place FROM n WHERE branch = 'A'")
def n04(spark, d):
    rows = _candidates(spark, d)
    return mining.negatives(rows, _own(rows), 5, 20, 8).where("branch = 'A'").select("query_id", "doc_id", "place")


@query("n05_branch_b", f"WITH {_BASE} SELECT query_id, doc_id, place FROM n WHERE branch = 'B'")
def n05(spark, d):
    rows = _candidates(spark, d)
    return mining.negatives(rows, _own(rows), 5, 20, 8).where("branch = 'B'").select("query_id", "doc_id", "place")


@query("n06_status", f"WITH {_BASE} SELECT query_id, CASE WHEN query_id % 70 = 0 THEN 'no_orig_doc' WHEN query_id NOT IN (SELECT query_id FROM n) THEN 'no_negatives' ELSE 'ok' END AS status FROM q")
def n06(spark, d):
    rows, origins, records = _mined(spark, d)
    return mining.skipped(rows.select("query_id").distinct(), origins, records)


@query("n07_verified", f"WITH {_BASE} SELECT DISTINCT query_id FROM n WHERE query_id % 40 > 0")
def n07(spark, d):
    _, _, records = _mined(spark, d)
    judged = records.select("query_id", F.when(F.col("query_id") % 40 > 0, "positive").otherwise("hard_negative").alias("classification"))
    return mining.verified(records, judged)[1].select("query_id")


@query("l09_mined_records", f"WITH {_BASE} SELECT query_id, n.query, 'doc ' || o.doc_id AS pos, string_agg(n.doc, '|' ORDER BY place) AS neg FROM n JOIN o USING (query_id) GROUP BY ALL")
def l09(spark, d):
    _, _, records = _mined(spark, d)
    return records.select("query_id", "query", F.array_join("pos", "|").alias("pos"), F.array_join("neg", "|").alias("neg"))


@query("a03_by_document", f"WITH {_BASE}, m AS (SELECT query_id, o.doc_id, count(*) AS k FROM n JOIN o USING (query_id) GROUP BY 1, 2) SELECT CAST(doc_id AS VARCHAR) AS doc_id, min(query_id) AS first_at, count(*) AS n, round(avg(k), 2) AS mean_negatives FROM m GROUP BY 1")
def a03(spark, d):
    _, _, records = _mined(spark, d)
    return mining.by_document(records.withColumnRenamed("pos_doc_id", "doc_id"), "doc_id", "query_id").drop("queries")


@query("a04_mining_statistics", f"""
WITH {_BASE}, st AS (SELECT CASE WHEN query_id % 70 = 0 THEN 'no_orig_doc' WHEN query_id NOT IN (SELECT query_id FROM n) THEN 'no_negatives' ELSE 'ok' END AS status FROM q)
SELECT 'status:' || status AS what, count(*) AS n FROM st GROUP BY 1 UNION ALL SELECT 'branch:' || branch, count(DISTINCT query_id) FROM n GROUP BY 1 UNION ALL SELECT 'negatives', count(*) FROM n""")
def a04(spark, d):
    rows, origins, records = _mined(spark, d)
    return mining.statistics(mining.skipped(rows.select("query_id").distinct(), origins, records), records)
