"""Dataset building."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import convert
from . import fixtures
from .registry import query, table
from .sampling import digest_sql

_T = fixtures.training_sql()


def _docs(spark, d):
    return fixtures.training(spark, d).select(F.explode("pos").alias("doc")).distinct().withColumn("doc_id", F.col("doc"))


@query("d11_queries_of_sample", f"""
WITH {_T}, p AS (SELECT DISTINCT query_id, query, unnest(pos) AS doc FROM x), d AS (SELECT DISTINCT doc FROM p ORDER BY {digest_sql(4, 'doc')}, doc LIMIT 30),
m AS (SELECT doc, query, min(query_id) AS first_at FROM p JOIN d USING (doc) GROUP BY 1, 2)
SELECT doc AS doc_id, query, row_number() OVER (PARTITION BY doc ORDER BY first_at, query) AS place FROM m QUALIFY place <= 2""")
def d11(spark, d):
    return convert.queries_of_sample(_docs(spark, d), fixtures.training(spark, d), 30, 4, 2, "query_id")[0].select("doc_id", "query", "place")


@query("d12_positive_pairs", "SELECT b.text AS query, l.doc_id, lang AS doc FROM labels l JOIN documents USING (doc_id) JOIN benchmark b ON item_id = l.doc_id % 40 WHERE quality = 1")
def d12(spark, d):
    qrels = table(spark, d, "labels").select("doc_id", (F.col("doc_id") % 40).alias("query_id"), F.col("quality").alias("score"), F.col("doc_id").alias("position"))
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    corpus = table(spark, d, "documents").select("doc_id", F.col("lang").alias("doc"))
    return convert.positive_pairs(qrels, queries, corpus, "position").select("query", "doc_id", "doc")


def _choices(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("position"), F.concat(F.lit(" q"), F.col("doc_id").cast("string")).alias("query"), F.array(F.concat("source", F.lit(" ")), "lang", F.concat("lang", "source")).alias("candidates"), (F.col("doc_id") % 3).cast("int").alias("correct_index"))


_CHOICE = "o AS (SELECT doc_id, 'q' || doc_id AS query, doc_id * 1000 + i AS ord, i, CASE i WHEN 0 THEN source WHEN 1 THEN lang ELSE lang || source END AS option FROM documents, (VALUES (0), (1), (2)) v(i)), c AS (SELECT option, 'option' || lpad(CAST(row_number() OVER (ORDER BY min(ord), option) - 1 AS VARCHAR), 6, '0') AS id FROM o GROUP BY 1)"


@query("d13_choice_corpus", f"WITH {_CHOICE} SELECT id AS doc_id, option AS text FROM c")
def d13(spark, d):
    return convert.multiple_choice(_choices(spark, d), 6)[0]


@query("d13_choice_queries", f"WITH {_CHOICE} SELECT id AS doc_id, option AS doc, min_by(query, {digest_sql(6, 'option', 'query')}) AS query FROM o JOIN c USING (option) WHERE i = o.doc_id % 3 GROUP BY 1, 2")
def d13_queries(spark, d):
    return convert.multiple_choice(_choices(spark, d), 6)[1]


def _papers(spark, d):
    docs = table(spark, d, "documents")
    sentences = F.split("text", "\n")
    kind = F.transform(sentences, lambda s, i: F.element_at(F.array(F.lit("abstract"), F.lit("normal paragraph"), F.lit("title")), ((F.col("n_chars") + i) % 3 + 1).cast("int")))
    papers = docs.select((2 * F.col("doc_id")).alias("position"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("paper_id"), sentences.alias("sentences"), kind.alias("kinds"))
    return papers.union(papers.where("position % 10 = 0").withColumn("position", F.col("position") + 1))


_SENT = "s AS (SELECT doc_id, 'p' || doc_id || '#' || lpad(CAST(i AS VARCHAR), 6, '0') AS id, i, l[i + 1] AS text, ['abstract', 'normal paragraph', 'title'][(n_chars + i) % 3 + 1] AS kind FROM (SELECT doc_id, n_chars, string_split(text, chr(10)) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents))"


@query("d15_sentences", f"WITH {_SENT} SELECT id AS doc_id, text, kind FROM s")
def d15(spark, d):
    return convert.sentence_corpus(_papers(spark, d), "position")[0]


@query("d15_generation_sentences", rf"WITH {_SENT} SELECT id AS doc_id, text, kind FROM s WHERE kind <> 'title' AND trim(text) <> '' QUALIFY row_number() OVER (PARTITION BY replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ß', 'ss') ORDER BY doc_id, i) = 1")
def d15_fit(spark, d):
    return convert.sentence_corpus(_papers(spark, d), "position")[1]


@query("d16_few_shot", None)
def d16(spark, d):
    from ..operators.sampling import greedy_distinct

    docs = table(spark, d, "documents")
    pairs = docs.select(F.col("doc_id").alias("record_id"), "source", "lang", F.substring_index("text", ".", 4).alias("hypothesis"), F.explode(F.split("text", r"(?<=\.)\s")).alias("sentence"), F.array(F.lit("a")).alias("labels"), F.create_map(F.lit("a"), F.substring_index("text", ".", 2)).alias("aspects"))
    best = convert.few_shot_candidates(pairs)
    rows = greedy_distinct(best.select("record_id", "source", "lang", "hypothesis", "sentence", "alignment", "coverage", "hypothesis_words"), [F.desc("alignment"), F.desc("coverage"), F.abs(F.col("hypothesis_words") - 18), F.col("record_id")], ["source", "hypothesis"], 5)
    return spark.createDataFrame([(r.record_id, r.hypothesis, r.sentence, r.alignment) for r in rows], "record_id long, hypothesis string, sentence string, alignment long")


@query("d17_search_corpus", "SELECT source AS doc_id, concat_ws(chr(10), first(lang ORDER BY doc_id), CASE WHEN min(doc_id) % 2 > 0 THEN CAST(min(doc_id) AS VARCHAR) END) AS text FROM documents GROUP BY source")
def d17(spark, d):
    c = F.struct(F.col("source").alias("doc_id"), F.col("lang").alias("title"), F.lit("").alias("abstract"), F.lit(None).cast("string").alias("venue"), F.when(F.col("doc_id") % 2 == 0, 0).otherwise(F.col("doc_id")).alias("year"))
    return convert.search_corpus(table(spark, d, "documents").select("doc_id", F.array(c, c).alias("candidates")).withColumnRenamed("doc_id", "position"), "position")


def _records(spark, d):
    e = table(spark, d, "events")
    rel = F.element_at(F.array(F.lit("yes"), F.lit("no"), F.lit("2")), (F.col("event_id") % 3 + 1).cast("int"))
    return e.select(F.col("event_id").alias("position"), F.concat(F.lit("q"), (F.col("user_id") % 20).cast("string")).alias("query_id"), F.col("event_type").alias("query"), F.concat(F.lit("d"), (F.col("event_id") % 30).cast("string")).alias("doc_id"), F.col("props").alias("doc"), rel.alias("rel"))


_REL = "r AS (SELECT event_id, 'q' || user_id % 20 AS query_id, event_type AS query, 'd' || event_id % 30 AS doc_id, props AS doc, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 2 END AS rel FROM events)"


@query("d18_beir_corpus", f"WITH {_REL} SELECT doc_id, min_by(doc, event_id) AS text FROM r GROUP BY 1")
def d18(spark, d):
    return convert.to_beir(_records(spark, d), "position")[0]


@query("d18_beir_queries", f"WITH {_REL} SELECT query_id, min_by(query, event_id) AS text FROM r GROUP BY 1")
def d18_queries(spark, d):
    return convert.to_beir(_records(spark, d), "position")[1]


@query("d18_beir_qrels", f"WITH {_REL} SELECT query_id, doc_id, CAST(max_by(rel, event_id) AS INTEGER) AS rel FROM r WHERE rel > 0 GROUP BY 1, 2")
def d18_qrels(spark, d):
    return convert.to_beir(_records(spark, d), "position")[2]


def _custom(spark, d):
    corpus = table(spark, d, "documents").where("doc_id % 4 > 0").select("doc_id", "text")
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    qrels = table(spark, d, "labels").select((F.col("doc_id") % 60).alias("query_id"), "doc_id", F.col("quality").alias("rel"))
    return convert.custom_layout(corpus, queries, qrels.union(qrels.withColumn("rel", F.lit(0))))


@query("d19_custom_qrels", "SELECT doc_id % 60 AS query_id, doc_id, quality AS rel FROM labels WHERE doc_id % 4 > 0 AND doc_id % 60 IN (SELECT item_id FROM benchmark)")
def d19(spark, d):
    return _custom(spark, d)[0]


@query("d19_problems", "SELECT 'repeated documents' AS what, 0::BIGINT AS n UNION ALL SELECT 'dangling documents', 2 * count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 4 > 0) UNION ALL SELECT 'dangling queries', 2 * count(*) FROM labels WHERE doc_id % 60 NOT IN (SELECT item_id FROM benchmark)")
def d19_problems(spark, d):
    return _custom(spark, d)[1]


def _pairs(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(F.col("lang").alias("dataset"), F.col("doc_id").alias("pair_id"), F.col("source").alias("query"), F.col("text").alias("document"), (F.col("doc_id") % 4).alias("label"))


_BLIND = f"b AS (SELECT lang, doc_id, source, text, lang || '-' || lpad(CAST(row_number() OVER (PARTITION BY lang ORDER BY {digest_sql(10, 'lang', 'doc_id')}, doc_id) AS VARCHAR), 3, '0') AS sample_id, row_number() OVER (PARTITION BY lang ORDER BY {digest_sql(10, 'lang', 'doc_id')}, doc_id) AS n FROM documents)"


@query("d20_public_samples", f"WITH {_BLIND} SELECT sample_id, lang AS dataset, source AS query, text AS document FROM b WHERE n <= 15")
def d20(spark, d):
    return convert.blind_samples(_pairs(spark, d), 15, 10)[0]


@query("d20_private_answers", f"WITH {_BLIND} SELECT sample_id, doc_id AS pair_id, doc_id % 4 AS label FROM b WHERE n <= 15")
def d20_private(spark, d):
    return convert.blind_samples(_pairs(spark, d), 15, 10)[1]


@query("d20_manifest", f"WITH {_BLIND}, s AS (SELECT lang, count(*) AS samples, sha256(string_agg(sample_id || chr(10) || source || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY sample_id)) AS samples_sha256 FROM b WHERE n <= 15 GROUP BY 1), p AS (SELECT lang, count(*) AS pairs, CAST(sum(CAST('0x' || substring(sha256(doc_id || chr(10) || source || chr(10) || coalesce(text, '') || chr(10) || doc_id % 4 || chr(10)), 1, 15) AS BIGINT)) AS VARCHAR) AS source_mark FROM documents GROUP BY 1) SELECT lang AS dataset, pairs, source_mark, samples, samples_sha256 FROM p JOIN s USING (lang)")
def d20_manifest(spark, d):
    return convert.blind_manifest(_pairs(spark, d), 15, 10)
