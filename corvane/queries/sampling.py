"""Top-k, samples and picks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling, vectors
from . import fixtures
from .registry import query, table

_R = fixtures.retrieved_sql()


def digest_sql(seed, *keys: str) -> str:
    return "sha256('" + str(seed) + "'" + "".join(f" || chr(0) || CAST({k} AS VARCHAR)" for k in keys) + ")"


@query("t01_dense_top_k", f"WITH {_R} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM r")
def t01(spark, d):
    return fixtures.retrieved(spark, d).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query("t02_euclidean_top_k", f"WITH {_R}, x AS (SELECT query_id, doc_id, -pow(list_distance(q.e, c.e), 2) AS score FROM q, c) SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, round(score, 6) AS score FROM x QUALIFY rank <= 10")
def t02(spark, d):
    return vectors.dense_top_k(*fixtures.vector_sides(spark, d), 10, "euclidean").select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query("t03_partial_sort", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def t03(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(25)


@query("t04_random_sample", f"SELECT doc_id FROM documents ORDER BY {digest_sql(42, 'doc_id')}, doc_id LIMIT 100")
def t04(spark, d):
    return sampling.sample(table(spark, d, "documents").select("doc_id"), 100, 42, "doc_id")


@query("t05_closed_range", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 11 OFFSET 20")
def t05(spark, d):
    return sampling.closed_range(table(spark, d, "documents").select("doc_id"), ["doc_id"], "20-30")


@query("t06_index_list", "WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents) SELECT doc_id FROM n WHERE n IN (3, 5, 150)")
def t06(spark, d):
    return sampling.index_list(table(spark, d, "documents").select("doc_id"), ["doc_id"], [5, 3, 3, 150, 10**9])


@query("t07_reservoir", f"SELECT conv_id, turn FROM conversations WHERE role = 'user' ORDER BY {digest_sql(7, 'conv_id * 1000 + turn')}, conv_id * 1000 + turn LIMIT 20")
def t07(spark, d):
    rows = table(spark, d, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    return sampling.reservoir(rows, 20, 7, "id", F.col("role") == "user").select("conv_id", "turn")


@query("t08_nested_samples", f"WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY {digest_sql(9, 'doc_id')}, doc_id) AS place FROM documents) SELECT doc_id, place, CASE WHEN place <= 20 THEN 20 WHEN place <= 40 THEN 40 ELSE 80 END AS smallest FROM n WHERE place <= 80")
def t08(spark, d):
    return sampling.nested(table(spark, d, "documents").select("doc_id"), [20, 40, 80], 9, "doc_id")


@query("t09_half_sample", f"SELECT doc_id FROM documents ORDER BY {digest_sql(3, 'doc_id')}, doc_id LIMIT (SELECT count(*) // 2 FROM documents)")
def t09(spark, d):
    return sampling.half(table(spark, d, "documents").select("doc_id"), 3, "doc_id")


@query("t10_weighted_mixture", f"""
WITH c AS (SELECT conv_id * 1000 + turn AS id, CAST(turn % 4 AS INTEGER) AS slot FROM conversations),
k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY slot ORDER BY {digest_sql('5-cap', 'id')}, id) <= 50)
SELECT id, slot, CAST(copy AS INTEGER) AS copy, {digest_sql(5, 'id', 'copy')} AS "order" FROM k, unnest(range(1, CASE WHEN slot < 2 THEN 3 ELSE 2 END)) AS u(copy)""")
def t10(spark, d):
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), (F.col("turn") % 4).cast("int").alias("slot"))
    return sampling.weighted_mixture(rows, "slot", {0: 2, 1: 2, 2: 1, 3: 1}, 5, "id", cap=50)


@query("t11_one_positive", f"WITH i AS (SELECT doc_id, unnest(['a', 'b', 'c']) AS item, unnest([0, 1, 2]) AS i FROM documents) SELECT doc_id, min_by(item, {digest_sql(1, 'doc_id', 'i')}) AS pos FROM i GROUP BY 1")
def t11(spark, d):
    return table(spark, d, "documents").select("doc_id", sampling.one_of(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 1, "doc_id").alias("pos"))


@query("t12_one_query", f"SELECT source, min_by(doc_id, {digest_sql(2, 'source', 'doc_id')}) AS doc_id FROM documents GROUP BY 1")
def t12(spark, d):
    return sampling.one_per_group(table(spark, d, "documents"), ["source"], "doc_id", 2)


@query("t13_annotator_order", f"SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY {digest_sql('ann-1', 'source', 'doc_id')}) AS INTEGER) AS place FROM documents")
def t13(spark, d):
    return sampling.annotator_order(table(spark, d, "documents").select("doc_id", "source"), "ann-1", "source", "doc_id")


@query("t14_first_rows", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 12")
def t14(spark, d):
    return sampling.first_rows(table(spark, d, "documents").select("doc_id"), ["doc_id"], 12)


@query("t15_query_cap", "SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 2")
def t15(spark, d):
    return sampling.capped(table(spark, d, "conversations").select("conv_id", "turn"), ["conv_id"], ["turn"], 2)


@query("t17_best_pick", "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars % 10 DESC, length(lang) DESC, abs(n_chars - 350), text, doc_id) = 1")
def t17(spark, d):
    return sampling.best_of(table(spark, d, "documents"), ["source"], [F.desc(F.col("n_chars") % 10), F.desc(F.length("lang")), F.abs(F.col("n_chars") - 350), F.col("text"), F.col("doc_id")]).select("source", "doc_id")


@query("t18_greedy_distinct", None)
def t18(spark, d):
    docs = table(spark, d, "documents").withColumn("abstract", F.col("n_chars") % 3 == 0)
    rows = sampling.greedy_distinct(docs.select("doc_id", "source", "lang", "abstract", "n_chars"), [F.desc("n_chars"), F.col("doc_id")], ["source", "lang"], 4, "abstract")
    return spark.createDataFrame([(r.doc_id, r.source, r.lang) for r in rows], "doc_id long, source string, lang string")


@query("t19_length_hint", f"WITH u AS (SELECT doc_id, CAST('0x' || {digest_sql(8, 'doc_id')}[1:8] AS BIGINT) / 4294967296.0 AS u FROM documents) SELECT doc_id, CASE WHEN u < 0.25 THEN 'short' WHEN u < 0.75 THEN 'medium' ELSE 'long' END AS bucket FROM u")
def t19(spark, d):
    return sampling.length_hint(table(spark, d, "documents").select("doc_id"), [("short", 0.25), ("medium", 0.5), ("long", 0.25)], 8, "doc_id")
