"""Ranking metrics and agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement, evaluation, statistics
from . import fixtures
from .registry import query, table

_R = fixtures.retrieved_sql()
_QRELS = """e AS (SELECT vec_id, label FROM embeddings), j AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, CASE WHEN a.vec_id % 7 = b.vec_id % 7 THEN 2 ELSE 1 END AS rel FROM e a JOIN e b ON a.label = b.label WHERE a.vec_id % 20 = 0)"""


def qrels(spark, d, graded: bool = True):
    v = table(spark, d, "embeddings").select("vec_id", "label")
    q, c = v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), v.withColumnRenamed("vec_id", "doc_id")
    rel = F.when(F.col("query_id") % 7 == F.col("doc_id") % 7, 2).otherwise(1) if graded else F.lit(1)
    return q.join(c, "label").select("query_id", "doc_id", rel.alias("rel"))


def metrics_sql(k: int) -> str:
    return f"""WITH {_R}, {_QRELS},
t AS (SELECT r.*, coalesce(rel, 0) AS rel FROM r LEFT JOIN j USING (query_id, doc_id) WHERE rank <= {k}),
h AS (SELECT *, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM t),
g AS (SELECT query_id, sum((pow(2, rel) - 1) / log2(rank + 1)) AS dcg, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) AS found, sum(CASE WHEN rel > 0 THEN hits / rank ELSE 0 END) AS ps, min(rank) FILTER (rel > 0) AS fh FROM h GROUP BY 1),
i AS (SELECT query_id, sum(CASE WHEN place <= {k} THEN (pow(2, rel) - 1) / log2(place + 1) ELSE 0 END) AS ideal, count(*) AS relevant FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) AS place FROM j) GROUP BY 1),
m AS (SELECT query_id, coalesce(dcg, 0) / ideal AS ndcg, coalesce(found, 0) / relevant AS recall, coalesce(found, 0) / {k} AS precision, coalesce(ps, 0) / least(relevant, {k}) AS map, coalesce(1.0 / fh, 0) AS mrr FROM i LEFT JOIN g USING (query_id))"""


def _one(metric: str, name: str, k: int = 10):
    @query(name, f"{metrics_sql(k)} SELECT query_id, round({metric}, 6) AS {metric} FROM m")
    def run(spark, d):
        return evaluation.per_query(fixtures.retrieved(spark, d), qrels(spark, d), k).select("query_id", F.round(metric, 6).alias(metric))

    return run


_one("ndcg", "a19_ndcg")
_one("recall", "a20_recall")
_one("precision", "a20_precision")
_one("map", "a21_map")
_one("mrr", "a22_mrr")


@query("a23_mean_metrics", f"{metrics_sql(10)} SELECT 10 AS k, count(*) AS queries, round(avg(ndcg), 6) AS ndcg, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(map), 6) AS map, round(avg(mrr), 6) AS mrr FROM m")
def a23(spark, d):
    return evaluation.mean_metrics(fixtures.retrieved(spark, d), qrels(spark, d), [10])


@query("a24_judged_rates", f"WITH {_R}, {_QRELS}, b AS (SELECT query_id, avg(CASE WHEN rel IS NULL THEN 0.0 ELSE 1.0 END) AS x, max(CASE WHEN rel > 0 THEN 1.0 ELSE 0.0 END) AS y FROM r LEFT JOIN j USING (query_id, doc_id) WHERE rank <= 10 GROUP BY 1) SELECT round(100 * avg(x), 2) AS judged, round(100 * avg(CAST(y AS DOUBLE)), 2) AS positive_hits FROM b")
def a24(spark, d):
    return evaluation.judged_rates(fixtures.retrieved(spark, d), qrels(spark, d), 10)


@query("a33_group_scores", f"{metrics_sql(10)}, n AS (SELECT query_id, recall AS r20 FROM ({metrics_sql(20)} SELECT * FROM m)) SELECT 'g' || query_id % 3 AS \"group\", round(avg(ndcg), 6) AS ndcg, round(avg(r20), 6) AS recall FROM m JOIN n USING (query_id) GROUP BY 1")
def a33(spark, d):
    queries, _ = fixtures.vector_sides(spark, d)
    groups = queries.select("query_id", F.concat(F.lit("g"), (F.col("query_id") % 3).cast("string")).alias("group"))
    return evaluation.per_group(fixtures.retrieved(spark, d), qrels(spark, d), groups, 10, 20)[0]


@query("k06_trec_run", f"WITH {_R} SELECT query_id || ' Q0 ' || doc_id || ' ' || rank || ' ' || printf('%.8f', score) || ' corvane' AS value FROM r")
def k06(spark, d):
    return evaluation.trec_lines(fixtures.retrieved(spark, d), "corvane")


# -- raters: quality, toxicity and a third, as votes for labels 0 and 1


_V = "v AS (SELECT l.doc_id, quality AS a, toxic AS b, CAST(l.doc_id % 3 > 0 AS INTEGER) AS c, lang FROM labels l JOIN documents USING (doc_id))"
_M = f"{_V}, g AS (SELECT x.l AS reference, y.l AS predicted FROM (VALUES (0), (1)) x(l), (VALUES (0), (1)) y(l)), m AS (SELECT reference, predicted, (SELECT count(*) FROM v WHERE a = reference AND b = predicted) AS n FROM g)"


def _votes(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("doc_id", F.col("quality").alias("a"), F.col("toxic").alias("b"), (F.col("doc_id") % 3 > 0).cast("int").alias("c"), "lang")


def _long(spark, d):
    return _votes(spark, d).select("doc_id", F.explode(F.array("a", "b", "c")).alias("label"))


def _matrix(spark, d):
    return agreement.confusion(_votes(spark, d), "a", "b", [0, 1])


@query("a13_confusion", f"WITH {_M} SELECT CAST(reference AS BIGINT) AS reference, CAST(predicted AS BIGINT) AS predicted, n FROM m")
def a13(spark, d):
    return _matrix(spark, d)


@query("a14_cohen_kappa", f"WITH {_M}, o AS (SELECT count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS o, avg(a) AS p, avg(b) AS q FROM v), e AS (SELECT *, p * q + (1 - p) * (1 - q) AS e FROM o) SELECT n, round(CAST(o AS DOUBLE), 6) AS observed, round(e, 6) AS expected, round((o - e) / (1 - e), 6) AS kappa FROM e")
def a14(spark, d):
    return agreement.kappa(_matrix(spark, d)).select(F.col("n").cast("long").alias("n"), "observed", "expected", "kappa")


@query("a15_label_scores", f"""WITH {_M}, s AS (SELECT l, coalesce(max(n) FILTER (reference = l AND predicted = l), 0) AS hit, sum(n) FILTER (reference = l) AS support, sum(n) FILTER (predicted = l) AS said FROM m, (VALUES (0), (1)) x(l) GROUP BY 1),
p AS (SELECT CAST(l AS VARCHAR) AS label, CASE WHEN said = 0 THEN 0 ELSE hit / said END AS precision, CASE WHEN support = 0 THEN 0 ELSE hit / support END AS recall, support FROM s),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM p)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM f
UNION ALL SELECT 'macro', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""")
def a15(spark, d):
    return agreement.label_scores(_matrix(spark, d))


@query("a16_fleiss_kappa", f"WITH {_V}, k AS (SELECT doc_id, a + b + c AS k FROM v), p AS (SELECT (k * k + (3 - k) * (3 - k) - 3) / 6 AS p, k FROM k), s AS (SELECT count(*) AS n, avg(p) AS o, pow(sum(k) / (3 * count(*)), 2) + pow(sum(3 - k) / (3 * count(*)), 2) AS e FROM p) SELECT n, round(o, 6) AS observed, round(e, 6) AS expected, round((o - e) / (1 - e), 6) AS kappa FROM s")
def a16(spark, d):
    return agreement.fleiss(_long(spark, d), "doc_id", "label", 3)


@query("a17_consensus", f"WITH {_V} SELECT doc_id, CASE WHEN a + b + c >= 2 THEN 1 ELSE 0 END AS label, false AS tie FROM v")
def a17(spark, d):
    return agreement.consensus(_long(spark, d), "doc_id", "label", 0)


@query("a18_by_data_set", f"WITH {_V} SELECT lang AS dataset, count(*) AS n, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS agreement FROM v GROUP BY 1 UNION ALL SELECT 'all', count(*), round(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END), 6)::DOUBLE FROM v")
def a18(spark, d):
    return agreement.by_data_set(_votes(spark, d).withColumn("same", F.col("a") == F.col("b")), "lang", "same")


@query("d21_submissions", f"WITH {_V} SELECT doc_id, a AS ann1, b AS ann2, c AS ann3 FROM v")
def d21(spark, d):
    rows = _votes(spark, d).select("doc_id", F.explode(F.array(*(F.struct(F.lit(n).alias("annotator"), F.col(c).alias("score")) for n, c in (("ann1", "a"), ("ann2", "b"), ("ann3", "c"))))).alias("x")).select("doc_id", "x.*")
    return agreement.submissions(rows, "annotator", "doc_id", "score", ["ann1", "ann2", "ann3"])[0]


@query("a32_metric_table", "WITH f AS (SELECT event_type, value, user_id FROM events WHERE event_id % 4 = (SELECT min(event_id % 4) FROM events e WHERE e.event_type = events.event_type)), b AS (SELECT event_type AS task, avg(value) AS ndcg, avg(user_id) AS recall FROM f GROUP BY 1) SELECT task, round(ndcg, 6) AS ndcg, round(recall, 6) AS recall FROM b UNION ALL SELECT 'average', round(avg(ndcg), 6), round(avg(recall), 6) FROM b")
def a32(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("task"), (F.col("event_id") % 4).alias("split"), F.col("value").alias("ndcg"), F.col("user_id").alias("recall"))
    return statistics.metric_table(rows, "task", "split", ["ndcg", "recall"])
