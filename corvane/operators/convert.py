"""Conversions of source layouts to corpora, qrels and training queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.labels import relevance
from .relational import best_match, first_per, labelled_pairs, numbered, positional_ids, queries_by_text, violations  # noqa: F401
from .sampling import digest, one_per_group, sample


def case_text(fields: Sequence[Column], charges: Column) -> Column:
    """Case fields by line, charges by comma, and a final line end."""
    return F.concat(F.concat_ws("\n", *fields, F.array_join(charges, ",")), F.lit("\n"))


def queries_of_sample(docs: DataFrame, training: DataFrame, n: int, seed: int, per_doc: int, position: str) -> tuple[DataFrame, DataFrame]:
    """A sample of documents with the queries of training rows that hold them, and the sampled documents without any. A
    caller refuses an empty first table."""
    chosen = sample(docs, n, seed, "doc_id")
    found = queries_by_text(chosen, training, per_doc, position)
    return found, chosen.join(found.select("doc_id"), "doc_id", "left_anti")


def positive_pairs(qrels: DataFrame, queries: DataFrame, corpus: DataFrame, position: str) -> DataFrame:
    """Labelled pairs of score 1, the first of each (query text, document)."""
    rows = labelled_pairs(qrels, queries, corpus).where("score = 1")
    return first_per(rows, ["query", "doc_id"], [position])


def multiple_choice(records: DataFrame, seed: int, position: str = "position") -> tuple[DataFrame, DataFrame, DataFrame]:
    """From query, candidates and correct_index: a corpus of distinct trimmed options with ids in the order in which they
    occur, one query for each option that is an answer, and queries with different answers, which a caller refuses."""
    options = records.select(position, F.trim("query").alias("query"), "correct_index", F.posexplode("candidates").alias("i", "option")).withColumn("option", F.trim("option"))
    options = options.withColumn("order", F.struct(position, "i"))
    corpus = positional_ids(options, "option", "order", prefix="option", name="doc_id").select("doc_id", F.col("option").alias("text"))
    answers = options.where("i = correct_index").select("query", "option").distinct()
    conflicts = answers.groupBy("query").count().where("count > 1").select("query")
    chosen = one_per_group(answers, ["option"], "query", seed)
    return corpus, chosen.join(corpus, chosen.option == corpus.text).select("doc_id", F.col("option").alias("doc"), "query"), conflicts


def sentence_corpus(papers: DataFrame, position: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From paper_id, sentences and kinds (parallel arrays): all sentences with composite ids, the sentences fit for
    generation with equal ones once, and papers that are repeated with another content."""
    content = F.struct("sentences", "kinds")
    differ = papers.groupBy("paper_id").agg(F.count_distinct(content).alias("n")).where("n > 1").select("paper_id")
    once = first_per(papers, ["paper_id"], [position])
    rows = once.select("paper_id", position, F.posexplode(F.arrays_zip("sentences", "kinds")).alias("i", "s")).select("paper_id", position, "i", text.composite_id(F.col("paper_id"), F.col("i")).alias("doc_id"), F.col("s.sentences").alias("text"), F.col("s.kinds").alias("kind"))
    fit = rows.where(F.col("kind").isin("abstract", "normal paragraph") & ~text.blank(F.col("text")))
    fit = first_per(fit.withColumn("_d", text.text_digest(F.col("text"))), ["_d"], [position, "i"]).drop("_d")
    return rows.select("doc_id", "text", "kind"), fit.select("doc_id", "text", "kind"), differ


def few_shot_candidates(pairs: DataFrame) -> DataFrame:
    """From record_id, hypothesis, sentence, labels and aspects: records whose hypothesis has 8 to 35 words, with their best
    labelled sentence of 12 to 80 words: alignment, coverage, closeness to 35 words, text."""
    words, own = text.regex_word_count(F.col("sentence")), text.regex_word_count(F.col("hypothesis"))
    rows = pairs.withColumns({"sentence_words": words, "hypothesis_words": own}).where("hypothesis_words between 8 and 35 and sentence_words between 12 and 80 and size(labels) > 0")
    rows = rows.withColumns({"alignment": text.alignment(F.col("hypothesis"), F.col("sentence"), F.col("labels"), F.col("aspects")), "coverage": F.size(F.array_distinct("labels"))})
    return first_per(rows, ["record_id"], [F.desc("alignment"), F.desc("coverage"), F.abs(F.col("sentence_words") - 35), F.col("sentence")])


def search_corpus(rows: DataFrame, position: str, fields: Sequence[str] = ("title", "abstract", "venue", "year")) -> DataFrame:
    """From candidates (doc_id and fields): one document an id, its first one, as its non-empty fields by line. A year of 0
    is empty."""
    c = rows.select(position, F.posexplode("candidates").alias("i", "c")).select(position, "i", "c.*")
    value = lambda f: F.when(F.col(f).cast("string") != "0", F.col(f).cast("string"))
    body = text.join_present("\n", *map(value, fields))
    return first_per(c.withColumn("text", body), ["doc_id"], [position, "i"]).select("doc_id", "text")


def to_beir(records: DataFrame, position: str, default: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From query_id, query, doc_id, doc and rel (any spelling): corpus (the first text of an id), queries, and qrels
    (the last positive relevance of a pair)."""
    rows = records.withColumn("rel", relevance(F.col("rel"), default))
    corpus = first_per(rows, ["doc_id"], [position]).select("doc_id", F.col("doc").alias("text"))
    queries = first_per(rows, ["query_id"], [position]).select("query_id", F.col("query").alias("text"))
    return corpus, queries, first_per(rows.where("rel > 0"), ["query_id", "doc_id"], [F.desc(position)]).select("query_id", "doc_id", "rel")


def custom_layout(corpus: DataFrame, queries: DataFrame, qrels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """qrels whose ends exist, the greatest relevance of each pair, and a table of problems: what, n."""
    known = qrels.join(corpus.select("doc_id").distinct(), "doc_id", "left_semi").join(queries.select("query_id").distinct(), "query_id", "left_semi")
    clean = known.groupBy("query_id", "doc_id").agg(F.max("rel").alias("rel"))
    one = lambda what, df: df.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    problems = one("repeated documents", corpus.groupBy("doc_id").count().where("count > 1")).union(one("dangling documents", qrels.join(corpus, "doc_id", "left_anti"))).union(one("dangling queries", qrels.join(queries, "query_id", "left_anti")))
    return clean, problems


def blind_manifest(pairs: DataFrame, n: int, seed: int, dataset: str = "dataset", key: str = "pair_id") -> DataFrame:
    """What an audit needs of ``blind_samples``: per data set pairs, samples, source_mark and samples_sha256.

    source_mark is the sum of 60 bits of each pair's SHA-256, so it is the same for any order of the rows and a task never
    holds a data set; samples_sha256 is over the public samples in the order of their ids, at most ``n`` of them.
    """
    lines = lambda *c: F.concat(*(x for name in c for x in (F.coalesce(F.col(name).cast("string"), F.lit("")), F.lit("\n"))))
    mark = F.conv(F.substring(F.sha2(lines(key, "query", "document", "label"), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    source = pairs.groupBy(dataset).agg(F.count("*").alias("pairs"), F.sum(mark).cast("string").alias("source_mark"))
    public = blind_samples(pairs, n, seed, dataset, key)[0].select(dataset, "sample_id", lines("sample_id", "query", "document").alias("_line"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sample_id", "_line"))), lambda x: x["_line"]), "")
    return source.join(public.groupBy(dataset).agg(F.count("*").alias("samples"), F.sha2(listed, 256).alias("samples_sha256")), dataset)


def blind_samples(pairs: DataFrame, n: int, seed: int, dataset: str = "dataset", key: str = "pair_id") -> tuple[DataFrame, DataFrame]:
    """n pairs of each data set under neutral ids: what annotators see, and the answers."""
    order = digest(seed, dataset, key)
    rows = numbered(pairs.withColumn("_d", order), ["_d", key], "_n", [dataset]).where(F.col("_n") <= n)
    rows = rows.withColumn("sample_id", F.format_string("%s-%03d", F.col(dataset), F.col("_n"))).drop("_d", "_n")
    return rows.select("sample_id", dataset, "query", "document"), rows.select("sample_id", key, "label")
