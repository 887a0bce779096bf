"""Rankings, positions, first and last rows, tiles and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import relational, sampling
from . import fixtures
from .registry import query, table

_R = fixtures.retrieved_sql()


@query("w01_retrieval_rank", f"WITH {_R} SELECT query_id, doc_id, rank FROM r")
def w01(spark, d):
    return fixtures.retrieved(spark, d).select("query_id", "doc_id", "rank")


@query("w02_min_rank", "WITH m AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) SELECT source, lang, CAST(rank() OVER (PARTITION BY lang ORDER BY n DESC) AS INTEGER) AS place FROM m")
def w02(spark, d):
    counts = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return counts.select("source", "lang", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("n"))).alias("place"))


@query("w03_first_per_key", "SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def w03(spark, d):
    return relational.first_per(table(spark, d, "documents"), ["text"], ["doc_id"]).select("doc_id", "text")


@query("w04_last_per_key", "SELECT max(doc_id) AS doc_id, text FROM documents GROUP BY text")
def w04(spark, d):
    return relational.last_per(table(spark, d, "documents"), ["text"], ["doc_id"]).select("doc_id", "text")


@query("w05_rank_window", f"WITH {_R} SELECT query_id, doc_id, rank FROM r WHERE rank > 5 AND rank <= 12")
def w05(spark, d):
    return sampling.rank_slice(fixtures.retrieved(spark, d), 5, 12).select("query_id", "doc_id", "rank")


@query("w06_reference_rank", f"WITH {_R} SELECT query_id, round(max(score) FILTER (rank = least(15, n)), 6) AS ref FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM r) GROUP BY 1")
def w06(spark, d):
    return sampling.score_at(fixtures.retrieved(spark, d), 15).select("query_id", F.round("ref", 6).alias("ref"))


@query("w07_running_hits", f"WITH {_R} SELECT query_id, rank, CAST(sum(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS hits FROM r")
def w07(spark, d):
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return fixtures.retrieved(spark, d).select("query_id", "rank", F.sum((F.col("doc_id") % 3 == 0).cast("int")).over(w).alias("hits"))


@query("w08_positional_ids", "WITH f AS (SELECT text, min(doc_id) AS first_at FROM documents GROUP BY 1) SELECT first_at, 'd' || lpad(CAST(row_number() OVER (ORDER BY first_at) - 1 AS VARCHAR), 6, '0') AS id FROM f")
def w08(spark, d):
    return relational.positional_ids(table(spark, d, "documents"), "text", "doc_id", prefix="d").select("first_at", "id")


@query("w09_chunks", f"WITH {_R} SELECT query_id, doc_id, CAST((rank - 1) // 6 AS BIGINT) AS chunk FROM r")
def w09(spark, d):
    return relational.chunked(fixtures.retrieved(spark, d), ["rank"], 6, partition=["query_id"]).select("query_id", "doc_id", "chunk")


@query("w10_ntile", "SELECT doc_id, CAST(ntile(7) OVER (ORDER BY doc_id) AS INTEGER) AS part FROM documents")
def w10(spark, d):
    return relational.tiled(table(spark, d, "documents").select("doc_id"), ["doc_id"], 7)


@query("k08_even_split", "SELECT part, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM (SELECT doc_id, CAST(ntile(3) OVER (ORDER BY doc_id) AS INTEGER) AS part FROM documents) GROUP BY 1")
def k08(spark, d):
    return relational.tiled(table(spark, d, "documents").select("doc_id"), ["doc_id"], 3).groupBy("part").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query("k09_halves", "SELECT doc_id, CAST(ntile(2) OVER (ORDER BY doc_id) AS INTEGER) AS half FROM documents")
def k09(spark, d):
    return relational.halves(table(spark, d, "documents").select("doc_id"), ["doc_id"])


@query("s08_batch_slice", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50 OFFSET 30")
def s08(spark, d):
    return relational.batch_slice(table(spark, d, "documents").select("doc_id"), ["doc_id"], 30, 50)
