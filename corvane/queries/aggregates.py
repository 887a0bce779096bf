"""Counts, distributions and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import relational, statistics
from . import fixtures
from .registry import query, table
from .scalars import words_sql

_L, _T = fixtures.labelled_sql(), fixtures.training_sql()
_W = f"w AS (SELECT item_id, CAST({words_sql('text')} AS BIGINT) AS w FROM benchmark)"


@query("a01_query_count", "SELECT count(*) AS n FROM conversations WHERE trim(coalesce(text, '')) <> ''")
def a01(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("query"))
    return statistics.query_count(relational.nest(rows, ["conv_id"], "turn", ["query"], "queries"))


@query("a02_score_histogram", f"WITH {_L} SELECT count(*) FILTER (label = 0) AS score_0, count(*) FILTER (label = 1) AS score_1, count(*) FILTER (label = 2) AS score_2, count(*) FILTER (label = 3) AS score_3, count(*) FILTER (label >= 2) AS passed, count(*) FILTER (label < 2) AS failed FROM l")
def a02(spark, d):
    return statistics.score_histogram(fixtures.labelled(spark, d), "label")


@query("a05_annotation_totals", f"WITH {_L} SELECT count(DISTINCT query_id) AS queries, count(*) AS candidates, count(*) FILTER (label >= 2) AS positive_doc_ids, count(*) FILTER (label = 1) AS hard_negative_doc_ids, count(*) FILTER (label = 0) AS easy_negative_doc_ids FROM l")
def a05(spark, d):
    return statistics.annotation_totals(fixtures.annotated(spark, d))


@query("a06_list_lengths", f"WITH {_T}, n AS (SELECT 'pos' AS list, len(pos) AS n FROM x UNION ALL SELECT 'neg', len(neg) FROM x) SELECT list, count(*) AS rows, CAST(sum(n) AS BIGINT) AS total, round(avg(n), 6) AS mean, min(n) AS least, max(n) AS most FROM n GROUP BY 1")
def a06(spark, d):
    return statistics.list_lengths(fixtures.training(spark, d), ["pos", "neg"])


@query("a07_binned", "WITH b AS (SELECT n_chars // 500 * 500 AS low, count(*) AS n FROM documents GROUP BY 1) SELECT low, n, round(100 * n / sum(n) OVER (), 6) AS percent FROM b")
def a07(spark, d):
    return statistics.binned(table(spark, d, "documents"), F.col("n_chars"), 500)


@query("a08_length_distribution", "SELECT count(*) AS n, round(avg(n_chars), 6) AS mean, round(median(n_chars), 6) AS median, round(stddev_pop(n_chars), 6) AS deviation, CAST(min(n_chars) AS DOUBLE) AS least, CAST(max(n_chars) AS DOUBLE) AS most, " + ", ".join(f"round(quantile_cont(n_chars, {q / 100}), 6) AS p{q}" for q in (25, 75, 90, 95, 99)) + " FROM documents")
def a08(spark, d):
    return statistics.length_distribution(table(spark, d, "documents"), F.col("n_chars"))


@query("a09_ranges", f"WITH {_W}, e AS (SELECT low, lead(low, 1, 1000000000) OVER (ORDER BY low) AS high FROM (VALUES (1), (3), (6), (11), (16), (21)) v(low)) SELECT low, count(item_id) AS n, round(100 * count(item_id) / (SELECT count(*) FROM w), 6) AS percent FROM e LEFT JOIN w ON w >= low AND w < high GROUP BY 1")
def a09(spark, d):
    return statistics.ranged(table(spark, d, "benchmark"), text.word_count(F.col("text")), [1, 3, 6, 11, 16, 21])


@query("a10_most_common", f"WITH {_W} SELECT w AS value, count(*) AS n FROM w GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def a10(spark, d):
    return statistics.most_common(table(spark, d, "benchmark"), text.word_count(F.col("text")), 15)


@query("a11_length_buckets", f"""
WITH {_W}, s AS (SELECT list(w ORDER BY w) AS v, count(*) AS n FROM w),
p AS (SELECT v, n, greatest(1, least((n + 1) // 4, n - 1)) AS i, greatest(1, least(3 * (n + 1) // 4, n - 1)) AS k FROM s),
q AS (SELECT v, n, CAST(floor((v[i] * (4 - ((n + 1) - i * 4)) + v[i + 1] * ((n + 1) - i * 4)) / 4) AS BIGINT) AS lo, CAST(floor((v[k] * (4 - (3 * (n + 1) - k * 4)) + v[k + 1] * (3 * (n + 1) - k * 4)) / 4) AS BIGINT) AS hi, v[n // 2 + 1] AS mid FROM p),
r AS (SELECT v, n, CASE WHEN lo >= hi THEN greatest(1, mid - 1) ELSE lo END AS lo, CASE WHEN lo >= hi THEN mid ELSE hi END AS hi FROM q),
b AS (SELECT 'short' AS label, v[1] AS word_min, lo AS word_max, round(len(list_filter(v, lambda x: x <= lo)) / n, 6) AS probability FROM r
UNION ALL SELECT 'medium', lo + 1, hi, round(len(list_filter(v, lambda x: x > lo AND x <= hi)) / n, 6) FROM r
UNION ALL SELECT 'long', hi + 1, NULL, round(len(list_filter(v, lambda x: x > hi)) / n, 6) FROM r)
SELECT * FROM b WHERE probability > 0""")
def a11(spark, d):
    return statistics.length_buckets(table(spark, d, "benchmark"), text.word_count(F.col("text")))


@query("a12_rounded_median", f"WITH {_T}, m AS (SELECT median(len(pos)) AS median FROM x) SELECT median, CAST(floor(median) AS BIGINT) AS floor, CAST(ceil(median) AS BIGINT) AS ceil, CAST(floor(median + 0.5) AS BIGINT) AS round FROM m")
def a12(spark, d):
    return statistics.rounded_median(fixtures.training(spark, d), F.size("pos"))


@query("a12_continuous_median", "WITH m AS (SELECT median(value) AS median FROM events) SELECT median, CAST(floor(median) AS BIGINT) AS floor, CAST(ceil(median) AS BIGINT) AS ceil, CAST(floor(median + 0.5) AS BIGINT) AS round FROM m")
def a12_continuous(spark, d):
    return statistics.rounded_median(table(spark, d, "events"), F.col("value"))


@query("a25_task_means", "SELECT event_type AS task, round(sum(value * (1 + user_id % 3)) / sum(1 + user_id % 3), 6) AS mean FROM events GROUP BY 1")
def a25(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("task"), F.array_repeat(F.lit("en"), (1 + F.col("user_id") % 3).cast("int")).alias("languages"), "value")
    return statistics.task_means(rows, "task", "languages", "value")


@query("a26_type_means", "WITH b AS (SELECT event_type AS kind, avg(value) AS mean FROM events GROUP BY 1) SELECT kind, round(mean, 6) AS mean FROM b UNION ALL SELECT 'all', round(avg(mean), 6) FROM b")
def a26(spark, d):
    return statistics.type_means(table(spark, d, "events").withColumnRenamed("event_type", "kind"), "kind", "value")


@query("a27_pivot", "SELECT source AS task, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr FROM documents GROUP BY 1")
def a27(spark, d):
    counts = table(spark, d, "documents").groupBy(F.col("source").alias("task"), "lang").agg(F.count("*").alias("n"))
    return statistics.pivoted(counts, "task", "lang", "n", ["de", "en", "fr"]).fillna(0)


@query("a28_split_by_score", "WITH g AS (SELECT doc_id % 50 AS query_id, string_agg(l.doc_id, '|' ORDER BY l.doc_id) FILTER (quality = 1) AS pos, string_agg(l.doc_id, '|' ORDER BY l.doc_id) FILTER (quality = 0) AS neg FROM labels l GROUP BY 1) SELECT * FROM g WHERE pos IS NOT NULL AND neg IS NOT NULL")
def a28(spark, d):
    rows = table(spark, d, "labels").select((F.col("doc_id") % 50).alias("query_id"), "doc_id", F.col("doc_id").cast("string").alias("doc"), F.col("quality").alias("score"))
    return statistics.split_by_score(rows, "query_id", "doc", "score", "doc_id").select("query_id", F.array_join("pos", "|").alias("pos"), F.array_join("neg", "|").alias("neg"))


@query("a29_distinct_counts", "SELECT count(DISTINCT text) AS text, count(DISTINCT lang) AS lang, count(DISTINCT source) AS source FROM documents")
def a29(spark, d):
    return statistics.distinct_counts(table(spark, d, "documents"), ["text", "lang", "source"])


@query("a30_even_share", """
WITH s AS (SELECT source AS model, CASE WHEN doc_id % 2 = 0 THEN 'beir' ELSE 'nano' END AS benchmark, lang, n_chars / 9973 AS score FROM documents),
b AS (SELECT model, benchmark, CASE WHEN count(DISTINCT lang) = 4 THEN round(100 * avg(score), 2) END AS mean FROM s GROUP BY 1, 2),
w AS (SELECT model, max(mean) FILTER (benchmark = 'beir') AS beir, max(mean) FILTER (benchmark = 'nano') AS nano FROM b GROUP BY 1)
SELECT model, beir, nano, round(nano - beir, 2) AS delta FROM w""")
def a30(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("model"), F.when(F.col("doc_id") % 2 == 0, "beir").otherwise("nano").alias("benchmark"), "lang", (F.col("n_chars") / 9973).alias("score"))
    return statistics.even_share(rows, "model", "benchmark", "lang", "score", 4)


@query("a31_spearman", "WITH r AS (SELECT rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS a, rank() OVER (ORDER BY length(lang || source), doc_id % 97) + (count(*) OVER (PARTITION BY length(lang || source), doc_id % 97) - 1) / 2 AS b FROM documents) SELECT round(corr(a, b), 6) AS rho FROM r")
def a31(spark, d):
    rows = table(spark, d, "documents").select("n_chars", (F.length(F.concat("lang", "source")) * 1000 + F.col("doc_id") % 97).alias("other"))
    return statistics.spearman(rows, "n_chars", "other")
