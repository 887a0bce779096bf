"""Hard-negative mining by score, and what a run of it amounts to.

Rows: candidates (query_id, query, doc_id, doc, score, rank), one row a candidate, and origins (query_id, doc_id, doc,
pos_score), the document that a query was written for; its score may be unknown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sampling import digest, score_at

#: A negative scores under this share of the origin.
MARGIN = 0.95


def resolve_origins(candidates: DataFrame, siblings: DataFrame, cache: DataFrame, items: DataFrame) -> DataFrame:
    """Per query its origin: its own candidate marked ``is_original``, else one of another query of the document (whose
    score does not count), else the cached text, else the item's. items: query_id, source_id, doc, pos_score; a pos_score
    stands before any other score. ``found`` is own, sibling, cache, item or none."""
    own = candidates.where("is_original").groupBy("query_id").agg(F.min_by(F.struct("doc_id", "doc", "score"), "rank").alias("own"))
    other = siblings.where("is_original").groupBy("source_id").agg(F.min_by(F.struct("doc_id", "doc"), F.struct("query_id", "rank")).alias("other"))
    cached = cache.groupBy("source_id").agg(F.min("doc").alias("cached"))
    rows = items.join(own, "query_id", "left").join(other, "source_id", "left").join(cached, "source_id", "left")
    found = F.when(F.col("own").isNotNull(), "own").when(F.col("other").isNotNull(), "sibling").when(F.col("cached").isNotNull(), "cache").when(F.trim(F.coalesce("doc", F.lit(""))) != "", "item").otherwise("none")
    text = F.coalesce("own.doc", "other.doc", "cached", F.nullif(F.trim("doc"), F.lit("")))
    return rows.select("query_id", F.coalesce("own.doc_id", "other.doc_id", "source_id").alias("doc_id"), text.alias("doc"), F.coalesce("pos_score", "own.score").alias("pos_score"), found.alias("found"))


def branches(candidates: DataFrame, origins: DataFrame, range_end: int) -> DataFrame:
    """Per query with an origin: raw, the origin's score, else the best candidate's, else 1; ref, the score at rank
    ``range_end`` or the last; branch A if raw * MARGIN < ref, else B."""
    best = candidates.groupBy("query_id").agg(F.max_by("score", -F.col("rank")).alias("best"))
    rows = origins.join(score_at(candidates, range_end), "query_id", "left").join(best, "query_id", "left")
    rows = rows.withColumn("raw", F.coalesce("pos_score", "best", F.lit(1.0)))
    return rows.withColumn("branch", F.when(F.col("raw") * MARGIN < F.col("ref"), "A").otherwise("B")).drop("best")


def pool(candidates: DataFrame, origins: DataFrame) -> DataFrame:
    """Candidates that are neither the origin, by id or by text, nor the query itself."""
    o = origins.select("query_id", F.col("doc_id").alias("_origin"), F.col("doc").alias("_doc"), *(c for c in ("raw", "branch") if c in origins.columns))
    return candidates.join(o, "query_id").where(F.col("doc_id").cast("string") != F.col("_origin").cast("string")).where((F.col("doc") != F.col("_doc")) & (F.col("doc") != F.col("query"))).drop("_origin", "_doc")


def negatives(candidates: DataFrame, origins: DataFrame, start: int, end: int, n: int, seed: int = 42) -> DataFrame:
    """Negatives of each query with their branch and place. A: up to n of the pool in ranks start + 1 to end of the whole
    list, by digest. B: the first n of the pool by rank that score under raw * MARGIN."""
    rows = pool(candidates, branches(candidates, origins, end))
    a = (F.col("branch") == "A") & (F.col("rank") > start) & (F.col("rank") <= end)
    b = (F.col("branch") == "B") & (F.col("score") < F.col("raw") * MARGIN)
    order = F.when(F.col("branch") == "A", digest(seed, "query_id", "doc_id")).otherwise(F.lpad(F.col("rank").cast("string"), 10, "0"))
    w = Window.partitionBy("query_id").orderBy(order, "rank")
    return rows.where(a | b).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def mined(origins: DataFrame, chosen: DataFrame) -> DataFrame:
    """One record a query with negatives: query_id, query, pos, pos_doc_id, neg, neg_doc_ids, pos_score, branch."""
    grouped = chosen.groupBy("query_id", "query", "branch").agg(F.sort_array(F.collect_list(F.struct("place", "doc", F.col("doc_id").cast("string").alias("id")))).alias("all"))
    rows = grouped.join(origins.select("query_id", F.col("doc_id").cast("string").alias("pos_doc_id"), F.col("doc").alias("_doc"), "pos_score"), "query_id")
    return rows.select("query_id", "query", F.array("_doc").alias("pos"), "pos_doc_id", F.transform("all", lambda x: x.doc).alias("neg"), F.transform("all", lambda x: x.id).alias("neg_doc_ids"), "pos_score", "branch")


def skipped(queries: DataFrame, origins: DataFrame, records: DataFrame) -> DataFrame:
    """Per query ok, no_orig_doc or no_negatives."""
    rows = queries.select("query_id").join(origins.select("query_id", F.lit(True).alias("_o")), "query_id", "left").join(records.select("query_id", F.lit(True).alias("_m")), "query_id", "left")
    return rows.select("query_id", F.when(F.col("_o").isNull(), "no_orig_doc").when(F.col("_m").isNull(), "no_negatives").otherwise("ok").alias("status"))


def verified(records: DataFrame, judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All records, and those whose origin is labelled positive. judged: query_id, classification."""
    return records, records.join(judged.where("classification = 'positive'").select("query_id"), "query_id", "left_semi")


def by_document(records: DataFrame, key: str, position: str) -> DataFrame:
    """Records gathered by document, documents by first position: key, first_at, queries, n, mean_negatives (2 digits)."""
    item = F.struct(position, "query", "pos", "neg")
    return records.groupBy(key).agg(F.min(position).alias("first_at"), F.sort_array(F.collect_list(item)).alias("queries"), F.count("*").alias("n"), F.round(F.avg(F.size("neg")), 2).alias("mean_negatives"))


def statistics(status: DataFrame, records: DataFrame) -> DataFrame:
    """Counts over a run: each status, each branch, negatives."""
    one = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c)).alias("what")
    counts = status.select(one("status", "status")).union(records.select(one("branch", "branch"))).groupBy("what").agg(F.count("*").alias("n"))
    return counts.union(records.select(F.lit("negatives").alias("what"), F.coalesce(F.sum(F.size("neg")), F.lit(0)).alias("n")))
