"""Vector and index operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import index, vectors
from ..plans.models import HashEmbedder, embed
from ..session import folder
from ..sources import sinks
from ..streaming import index_build
from . import fixtures
from .registry import query, table

_R = fixtures.retrieved_sql()


def _corpus(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


@query("v01_normalise", "SELECT vec_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: pow(x / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 2))), 6) AS norm, round(embedding[1] / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS first FROM embeddings")
def v01(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", vectors.normalised(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(vectors.dot(F.col("v"), F.col("v")), 6).alias("norm"), F.round(F.col("v")[0], 6).alias("first"))


@query("v01_embed_texts", None)
def v01_embed(spark, d):
    from ..plans.models import HashEmbedder, embed

    rows = embed(table(spark, d, "benchmark"), "text", HashEmbedder)
    return rows.select("item_id", F.size("embedding").alias("dimensions"), F.round(vectors.dot(F.col("embedding"), F.col("embedding")), 6).alias("norm"))


@query("v02_index_build", "SELECT CAST(vec_id AS VARCHAR) AS doc_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings")
def v02(spark, d):
    from ..operators.relational import numbered

    return numbered(_corpus(spark, d).select("doc_id"), ["doc_id"], "n").select(F.col("doc_id").cast("string").alias("doc_id"), (F.col("n") - 1).alias("pos"))


class _Fussy(HashEmbedder):
    """A model that breaks off at a text of over 9,000 characters."""

    def embed(self, texts):
        if any(len(t) > 9_000 for t in texts):
            raise ValueError("text too long")
        return super().embed(texts)


_STREAM = "WITH d AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 19 = 0 THEN ' ' ELSE text END AS doc FROM documents), f AS (SELECT *, CASE WHEN doc IS NULL OR trim(doc) = '' THEN 'no text' WHEN length(doc) > 9000 THEN 'text too long' END AS reason FROM d)"


def _streamed(spark, d):
    """Two drops of files: even ids, then odd ones."""
    base = folder(spark, "index-stream")
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.when(F.col("doc_id") % 17 == 0, F.lit(None)).when(F.col("doc_id") % 19 == 0, " ").otherwise(F.col("text")).alias("doc"))
    for odd in (0, 1):
        rows.where(F.col("doc_id").cast("long") % 2 == odd).write.mode("append").parquet(f"{base}/in")
        index_build.build_index(spark, f"{base}/in", "doc_id string, doc string", f"{base}/out", _Fussy, files=1000)
    return f"{base}/out"


@query("v02_streamed_index", f"{_STREAM} SELECT CAST(doc_id AS VARCHAR) AS doc_id, row_number() OVER (ORDER BY doc_id % 2, CAST(doc_id AS VARCHAR)) - 1 AS pos, 64 AS dimensions FROM f WHERE reason IS NULL")
def v02_streamed(spark, d):
    return index_build.read_index(spark, _streamed(spark, d)).select("doc_id", "pos", F.size("embedding").alias("dimensions"))


@query("v02_rejected_rows", f"{_STREAM} SELECT CAST(doc_id AS VARCHAR) AS doc_id, reason FROM f WHERE reason IS NOT NULL")
def v02_rejects(spark, d):
    return index_build.read_rejects(spark, _streamed(spark, d)).select("doc_id", F.regexp_extract("reason", "no text|text too long", 0).alias("reason"))


@query("v02_cursor", f"{_STREAM} SELECT count(*) AS lines, count(*) FILTER (reason IS NULL) AS indexed, count(*) FILTER (reason IS NOT NULL) AS rejected, 0 AS streak FROM f")
def v02_cursor(spark, d):
    return index_build.read_cursor(spark, _streamed(spark, d)).select("lines", "indexed", "rejected", "streak")


_GREEDY = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (ORDER BY md5('42:' || vec_id), vec_id) AS n FROM embeddings),
near AS (SELECT a.n AS u, list(b.n) AS vs FROM v a JOIN v b ON a.n < b.n WHERE list_inner_product(a.e, b.e) > 0.3 GROUP BY 1),
walk(n, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT w.n + 1, CASE WHEN list_contains(w.gone, w.n + 1) THEN w.gone ELSE list_concat(w.gone, coalesce((SELECT vs FROM near WHERE u = w.n + 1), []::BIGINT[])) END FROM walk w WHERE w.n < (SELECT max(n) FROM v)),
final AS (SELECT gone FROM walk ORDER BY n DESC LIMIT 1)
SELECT vec_id AS doc_id, md5('42:' || vec_id) AS priority FROM v WHERE NOT list_contains((SELECT gone FROM final), n)"""


@query("v03_diverse_selection", _GREEDY)
def v03(spark, d):
    return vectors.diverse(_corpus(spark, d), 0.3)


@query("v03_diverse_target", _GREEDY + " ORDER BY priority, doc_id LIMIT 40")
def v03_target(spark, d):
    return vectors.diverse(_corpus(spark, d), 0.3, target=40)


@query("v04_cell_parameters", "WITH c AS (SELECT doc_id, n_chars * n_chars + 1 AS n, greatest(1, least(CAST(floor(4 * sqrt(n)) AS BIGINT), n // 39 + 1)) AS cells FROM documents) SELECT doc_id, CAST(n AS BIGINT) AS n, cells, greatest(8, CAST(floor(sqrt(cells)) AS BIGINT)) AS probes, least(256 * cells, n) AS training_rows FROM c")
def v04(spark, d):
    sizes = table(spark, d, "documents").select("doc_id", (F.col("n_chars") * F.col("n_chars") + 1).alias("n"))
    return sizes.select("doc_id", "n", *vectors.cell_parameters(F.col("n")))


def _index(spark, d):
    """An inverted file of four fifths of the vectors, to which the whole table is then appended."""
    path, corpus = folder(spark, "index"), _corpus(spark, d)
    index.build(corpus.where("doc_id % 5 > 0"), path)
    index.append(corpus, path)
    return path


@query("v05_approximate_top_k", None)
def v05(spark, d):
    return index.search(fixtures.vector_sides(spark, d)[0], _index(spark, d), 10)


@query("v05_all_cells", f"WITH {fixtures.retrieved_sql(10)} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r")
def v05_all(spark, d):
    """With all cells probed the index gives the exact answer, so it holds every row."""
    path = _index(spark, d)
    return index.search(fixtures.vector_sides(spark, d)[0], path, 10, probes=spark.read.parquet(f"{path}/centres").count()).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("v05_indexed_rows", "SELECT vec_id AS doc_id FROM embeddings")
def v05_rows(spark, d):
    return index.stored_vectors(spark, _index(spark, d)).select("doc_id")


@query("v06_all_neighbours", "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT a.vec_id AS doc_id, count(*) AS n FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_inner_product(a.e, b.e) > 0.3 GROUP BY 1")
def v06(spark, d):
    return vectors.neighbour_counts(_corpus(spark, d), 0.3)


@query("v07_export_indexed", "SELECT CAST(vec_id AS VARCHAR) AS doc_id, 'doc ' || vec_id AS doc FROM embeddings")
def v07(spark, d):
    return _corpus(spark, d).orderBy("doc_id").select(F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("doc"))


@query("v08_origin_scores", f"WITH {_R} SELECT query_id, doc_id, round(score, 6) AS pos_score FROM s WHERE doc_id = query_id + 1")
def v08(spark, d):
    queries, corpus = fixtures.vector_sides(spark, d)
    return vectors.origin_scores(queries, corpus, queries.select("query_id", (F.col("query_id") + 1).alias("doc_id"))).select("query_id", "doc_id", F.round("pos_score", 6).alias("pos_score"))


@query("v10_missing_vectors", "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def v10(spark, d):
    return vectors.missing_vectors(table(spark, d, "documents"), _corpus(spark, d), "doc_id")


@query("v10_checked_embeddings", "SELECT doc_id, 64 AS dimensions, (SELECT count(*) FROM documents) AS texts FROM documents")
def v10_checked(spark, d):
    """Embeddings of all texts, published only if none is missing; counted in the pass that writes them."""
    rows, path = embed(table(spark, d, "documents").select("doc_id", "text"), "text", HashEmbedder), folder(spark, "embeddings")
    counters = {"texts": F.count("*"), "missing": F.count_if(F.col("embedding").isNull() | (F.size("embedding") != 64))}
    seen = sinks.write_checked(rows, path, counters, lambda n: f"{n['missing']} texts have no vector" if n["missing"] else None, columns=["doc_id", "embedding"])
    return spark.read.parquet(path).select("doc_id", F.size("embedding").alias("dimensions"), F.lit(seen["texts"]).alias("texts"))
