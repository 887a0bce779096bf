"""Ranking metrics over a run (query_id, doc_id, score, rank) and qrels (query_id, doc_id, rel)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stored

#: Rows of a run up to which digests of their pairs are sent to the judgements; beyond it all judgements are shuffled.
SENT_PAIRS = 4_000_000


def with_qrels(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    return queries.join(qrels.select("query_id"), "query_id", "left_semi")


def judged_run(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Adds rel (0 where there is no judgement) and judged. The run is computed once; judgements of other pairs stay where
    they are."""
    run = stored(run, "run")
    q = qrels.select("query_id", "doc_id", "rel", F.lit(True).alias("judged"))
    pair, same = F.xxhash64("query_id", "doc_id"), all(run.schema[c].dataType == q.schema[c].dataType for c in ("query_id", "doc_id"))
    if same and run.count() <= SENT_PAIRS:
        q = q.withColumn("_pair", pair).join(F.broadcast(run.select(pair.alias("_pair")).distinct()), "_pair", "left_semi").drop("_pair")
    return run.join(q, ["query_id", "doc_id"], "left").withColumns({"rel": F.coalesce("rel", F.lit(0)), "judged": F.coalesce("judged", F.lit(False))})


def gain(rel: Column, rank: Column) -> Column:
    return (F.pow(2.0, rel) - 1) / F.log2(rank + 1.0)


def per_query(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Per query with qrels: ndcg, recall, precision, map and mrr at k; a query without results, or without positive
    judgements, scores 0."""
    top = judged_run(run.where(F.col("rank") <= k), qrels)
    hit = (F.col("rel") > 0).cast("int")
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    got = top.withColumn("hits", F.sum(hit).over(upto)).groupBy("query_id").agg(
        F.sum(gain(F.col("rel"), F.col("rank"))).alias("dcg"),
        F.sum(hit).alias("found"),
        F.sum(F.when(hit == 1, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("precision_sum"),
        F.min(F.when(hit == 1, F.col("rank"))).alias("first_hit"),
    )
    # the order within a relevance does not matter, so its judgements are counted and each count fills the next places
    level = qrels.groupBy("query_id", "rel").agg(F.count("*").alias("n"))
    above = Window.partitionBy("query_id").orderBy(F.desc("rel")).rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n").over(above), F.lit(0)) + 1
    last = F.least(F.col("first") + F.col("n") - 1, F.lit(k))
    places = F.when((F.col("rel") > 0) & (F.col("first") <= last), F.sequence("first", last))
    best = level.withColumn("first", first).groupBy("query_id").agg(
        F.coalesce(F.sum(F.aggregate(places, F.lit(0.0), lambda s, p: s + gain(F.col("rel"), p))), F.lit(0.0)).alias("ideal"), F.coalesce(F.sum(F.when(F.col("rel") > 0, F.col("n"))), F.lit(0)).alias("relevant")
    )
    rows = best.join(got, "query_id", "left").fillna(0, ["dcg", "found", "precision_sum"])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return rows.select(
        "query_id",
        ratio(F.col("dcg"), F.col("ideal")).alias("ndcg"),
        ratio(F.col("found").cast("double"), F.col("relevant")).alias("recall"),
        (F.col("found") / k).alias("precision"),
        ratio(F.col("precision_sum"), F.least(F.col("relevant"), F.lit(k))).alias("map"),
        F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)).alias("mrr"),
    )


def mean_metrics(run: DataFrame, qrels: DataFrame, cutoffs: Sequence[int]) -> DataFrame:
    """Means over the queries with qrels: k, queries, and each metric to 6 digits."""
    out = None
    for k in cutoffs:
        row = per_query(run, qrels, k).agg(F.lit(k).alias("k"), F.count("*").alias("queries"), *(F.round(F.coalesce(F.avg(m), F.lit(0.0)), 6).alias(m) for m in ("ndcg", "recall", "precision", "map", "mrr")))
        out = row if out is None else out.union(row)
    return out


def judged_rates(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Percent of the first k that are judged, and of queries with a relevant one among them, to 2 digits."""
    top = judged_run(run.where(F.col("rank") <= k), qrels)
    by = top.groupBy("query_id").agg(F.avg(F.col("judged").cast("double")).alias("judged"), F.max((F.col("rel") > 0).cast("double")).alias("hit"))
    return by.agg(F.round(100 * F.avg("judged"), 2).alias("judged"), F.round(100 * F.avg("hit"), 2).alias("positive_hits"))


def per_group(run: DataFrame, qrels: DataFrame, groups: DataFrame, k: int, recall_at: int) -> tuple[DataFrame, DataFrame]:
    """Mean ndcg at k and recall at another cut for each group of queries (query_id, group), and the queries of qrels that
    the run lacks, for which a caller refuses the result."""
    a, b = per_query(run, qrels, k).select("query_id", "ndcg"), per_query(run, qrels, recall_at).select("query_id", "recall")
    rows = a.join(b, "query_id").join(groups, "query_id").groupBy("group").agg(F.round(F.avg("ndcg"), 6).alias("ndcg"), F.round(F.avg("recall"), 6).alias("recall"))
    return rows, qrels.select("query_id").distinct().join(run.select("query_id"), "query_id", "left_anti")


def trec_lines(run: DataFrame, tag: str) -> DataFrame:
    return run.select(F.format_string("%s Q0 %s %d %.8f %s", F.col("query_id").cast("string"), F.col("doc_id").cast("string"), F.col("rank"), F.col("score"), F.lit(tag)).alias("value"))
