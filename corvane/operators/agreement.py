"""Agreement between raters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import safe_divide


def confusion(df: DataFrame, a: str, b: str, labels: Sequence) -> DataFrame:
    """Counts for every pair of labels: reference, predicted, n."""
    grid = df.sparkSession.createDataFrame([(x, y) for x in labels for y in labels], ["reference", "predicted"])
    counts = df.groupBy(F.col(a).alias("reference"), F.col(b).alias("predicted")).agg(F.count("*").alias("n"))
    return grid.join(counts, ["reference", "predicted"], "left").fillna(0, ["n"])


def kappa(matrix: DataFrame) -> DataFrame:
    """From a confusion matrix: n, observed, expected, kappa; full expected agreement gives 1 if observed is full too."""
    total = matrix.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("reference") == F.col("predicted"), F.col("n")).otherwise(0)).alias("same"))
    rows, columns = matrix.groupBy(F.col("reference").alias("label")).agg(F.sum("n").alias("r")), matrix.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("c"))
    chance = rows.join(columns, "label").agg(F.sum(F.col("r") * F.col("c")).alias("product"))
    x = total.crossJoin(chance).select("n", safe_divide(F.col("same"), F.col("n")).alias("o"), safe_divide(F.col("product"), F.col("n") * F.col("n")).alias("e"))
    k = F.when(F.col("e") == 1, F.when(F.col("o") == 1, 1.0).otherwise(0.0)).otherwise((F.col("o") - F.col("e")) / (1 - F.col("e")))
    return x.select("n", F.round("o", 6).alias("observed"), F.round("e", 6).alias("expected"), F.round(k, 6).alias("kappa"))


def label_scores(matrix: DataFrame) -> DataFrame:
    """Per label precision, recall, f1 and support; macro and weighted means as further rows."""
    same = F.sum(F.when(F.col("reference") == F.col("predicted"), F.col("n")).otherwise(0))
    r = matrix.groupBy(F.col("reference").alias("label")).agg(same.alias("hit"), F.sum("n").alias("support"))
    c = matrix.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("said"))
    p, q = safe_divide(F.col("hit"), F.col("said")), safe_divide(F.col("hit"), F.col("support"))
    by = r.join(c, "label").select(F.col("label").cast("string"), p.alias("precision"), q.alias("recall"), safe_divide(2 * p * q, p + q).alias("f1"), "support")
    names = ("precision", "recall", "f1")
    macro = by.agg(F.lit("macro").alias("label"), *(F.avg(x).alias(x) for x in names), F.sum("support").alias("support"))
    weighted = by.agg(F.lit("weighted").alias("label"), *(safe_divide(F.sum(F.col(x) * F.col("support")), F.sum("support")).alias(x) for x in names), F.sum("support").alias("support"))
    return by.union(macro).union(weighted).select("label", *(F.round(x, 6).alias(x) for x in names), "support")


def fleiss(df: DataFrame, item: str, label: str, raters: int) -> DataFrame:
    """From one row a vote; every item must have ``raters`` votes."""
    votes = df.groupBy(item, label).agg(F.count("*").alias("c"))
    p = votes.groupBy(item).agg(((F.sum(F.col("c") * F.col("c")) - raters) / (raters * (raters - 1))).alias("p"))
    mean = p.agg(F.count("*").alias("n"), F.avg("p").alias("observed"))
    share = votes.groupBy(label).agg(F.sum("c").alias("c")).crossJoin(mean.select("n")).agg(F.sum(F.pow(F.col("c") / (F.col("n") * raters), 2)).alias("expected"))
    x = mean.crossJoin(share)
    k = F.when(F.col("expected") == 1, 1.0).otherwise((F.col("observed") - F.col("expected")) / (1 - F.col("expected")))
    return x.select("n", F.round("observed", 6).alias("observed"), F.round("expected", 6).alias("expected"), F.round(k, 6).alias("kappa"))


def consensus(df: DataFrame, item: str, label: str, tie_label: str, tie_votes: int = 2) -> DataFrame:
    """The label with at least ``tie_votes`` votes; without one, ``tie_label``, flagged."""
    votes = df.groupBy(item, label).agg(F.count("*").alias("c"))
    best = votes.withColumn("_n", F.row_number().over(Window.partitionBy(item).orderBy(F.desc("c"), label))).where("_n = 1")
    won = F.col("c") >= tie_votes
    return best.select(item, F.when(won, F.col(label)).otherwise(tie_label).alias("label"), (~won).alias("tie"))


def by_data_set(df: DataFrame, dataset: str, same: str) -> DataFrame:
    """Agreement of each data set and, as ``all``, of the whole."""
    got = df.rollup(dataset).agg(F.grouping(dataset).alias("_g"), F.count("*").alias("n"), F.round(F.avg(F.col(same).cast("double")), 6).alias("agreement"))
    return got.select(F.when(F.col("_g") == 1, "all").otherwise(F.col(dataset)).alias("dataset"), "n", "agreement")


def submissions(df: DataFrame, annotator: str, item: str, score: str, annotators: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """A wide table, one column a rater, and violations: items that a rater missed or scored twice."""
    wide = df.groupBy(item).pivot(annotator, list(annotators)).agg(F.min(score))
    bad = [wide.where(F.col(a).isNull()).select(item, F.lit(f"{a} missing").alias("violation")) for a in annotators]
    twice = df.groupBy(item, annotator).count().where("count > 1").select(item, F.concat(F.col(annotator), F.lit(" repeated")).alias("violation"))
    for b in bad:
        twice = twice.union(b)
    return wide, twice
