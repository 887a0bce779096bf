"""Shapes built from the test tables, with the SQL of the same shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import vectors
from .registry import table


def vector_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Vectors whose id is divisible by 20 are queries, all vectors the corpus."""
    v = table(spark, d, "embeddings")
    return v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v.select(F.col("vec_id").alias("doc_id"), "embedding")


def retrieved(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    queries, corpus = vector_sides(spark, d)
    return vectors.dense_top_k(queries, corpus, k)


def retrieved_sql(k: int = 20) -> str:
    return f"""q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 20 = 0),
c AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT query_id, doc_id, list_inner_product(q.e, c.e) AS score FROM q, c),
r AS (SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= {k})"""


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Retrieved documents with scores 0 to 3 from their rank, by the offline judge."""
    from ..plans.models import rank_score

    rows = retrieved(spark, d)
    return rows.withColumn("label", rank_score(F.col("query_id"), F.col("rank"))).withColumn("doc", F.concat(F.lit("doc "), F.col("doc_id").cast("string"))).withColumn("query", F.concat(F.lit("query "), F.col("query_id").cast("string")))


def labelled_sql() -> str:
    return (
        retrieved_sql()
        + """,
l AS (SELECT *, CASE WHEN e <= 2 THEN 3 WHEN e <= 6 THEN 2 WHEN e <= 12 THEN CASE WHEN (query_id // 10) % 7 = 3 THEN 0 ELSE 1 END ELSE 0 END AS label,
  'doc ' || doc_id AS doc, 'query ' || query_id AS query FROM (SELECT *, rank + (query_id // 10) % 14 AS e FROM r))"""
    )


def annotated(spark: SparkSession, d: str) -> DataFrame:
    """One row a query: candidates, annotations and the three id lists, in rank order."""
    rows = labelled(spark, d).withColumn("id", F.col("doc_id").cast("string"))
    grouped = rows.groupBy("query_id", "query").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "doc", "label", "score"))).alias("all"))
    ids = lambda test: F.transform(F.filter("all", test), lambda x: x.id)
    return grouped.select(
        "query_id",
        "query",
        F.transform("all", lambda x: F.struct(x.id.alias("doc_id"), x.doc.alias("doc"))).alias("candidates"),
        F.transform("all", lambda x: F.struct(x.id.alias("doc_id"), x.label.alias("score"))).alias("annotations"),
        ids(lambda x: x.label >= 2).alias("positive_doc_ids"),
        ids(lambda x: x.label == 1).alias("hard_negative_doc_ids"),
        ids(lambda x: x.label == 0).alias("easy_negative_doc_ids"),
    )


def training(spark: SparkSession, d: str) -> DataFrame:
    """query_id, query, pos, neg: positives, and hard negatives or else easy ones."""
    from ..operators import export

    return export.hard_else_easy(annotated(spark, d))


def training_sql() -> str:
    return (
        labelled_sql()
        + """,
t AS (SELECT query_id, query, list(doc ORDER BY rank) FILTER (label >= 2) AS pos, list(doc ORDER BY rank) FILTER (label = 1) AS hard, list(doc ORDER BY rank) FILTER (label = 0) AS easy FROM l GROUP BY ALL),
x AS (SELECT query_id, query, pos, coalesce(hard, easy) AS neg FROM t WHERE pos IS NOT NULL AND coalesce(hard, easy) IS NOT NULL)"""
    )


def joined(column: str):
    return F.array_join(column, "|")
