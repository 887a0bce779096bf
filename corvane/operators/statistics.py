"""Counts, distributions and reports."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import blank, safe_size
from ..session import stored
from .relational import numbered, running


def query_count(batch: DataFrame) -> DataFrame:
    """Usable queries of nested documents."""
    return batch.agg(F.coalesce(F.sum(F.size(F.filter("queries", lambda q: ~blank(q.query)))), F.lit(0)).cast("long").alias("n"))


def score_histogram(df: DataFrame, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Counts of scores 0 to 3, and of passes (2 and more) and failures."""
    counts = [F.count_if(F.col(score) == s).alias(f"score_{s}") for s in range(4)]
    return df.groupBy(*keys).agg(*counts, F.count_if(F.col(score) >= 2).alias("passed"), F.count_if(~F.coalesce(F.col(score) >= 2, F.lit(False))).alias("failed"))


def annotation_totals(rows: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(safe_size(F.col(c))), F.lit(0)).alias(c)
    return rows.agg(F.count("*").alias("queries"), *map(total, ("candidates", "positive_doc_ids", "hard_negative_doc_ids", "easy_negative_doc_ids")))


def list_lengths(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, sum, mean, least and greatest length of list columns, one row a column."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("list"), safe_size(F.col(c)).alias("n")) for c in columns))).alias("x")).select("x.*")
    return long.groupBy("list").agg(F.count("*").alias("rows"), F.sum("n").alias("total"), F.round(F.avg("n"), 6).alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"))


def binned(df: DataFrame, value: Column, width: int) -> DataFrame:
    """Bins of a width: low, n, percent."""
    counts = df.select((F.floor(value / width) * width).cast("long").alias("low")).groupBy("low").agg(F.count("*").alias("n"))
    return counts.select("low", "n", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("percent"))


def length_distribution(df: DataFrame, value: Column) -> DataFrame:
    """Mean, median, population deviation, extremes and linear percentiles."""
    x = stored(df.select(value.cast("double").alias("x")), "lengths")
    shares = {"median": 0.5, **{f"p{q}": q / 100 for q in (25, 75, 90, 95, 99)}}
    at = exact_quantiles(x, F.col("x"), list(shares.values()))
    p = {n: F.round(F.lit(v).cast("double"), 6).alias(n) for n, v in zip(shares, at, strict=True)}
    return x.agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean"), p.pop("median"), F.round(F.stddev_pop("x"), 6).alias("deviation"), F.min("x").alias("least"), F.max("x").alias("most"), *p.values())


#: Distinct values that are counted one by one; more are first narrowed down by a sketch of this accuracy.
FEW, ACCURACY = 10_000, 10_000


def _at_ranks(x: DataFrame, ranks: Sequence[int]) -> list[float]:
    """The values of the stored table ``x`` (x) at places 0, 1, ... in ascending order, by distributed selection.

    Each place has a bracket of values that it lies in, at first the extremes. A sketch of what lies in a bracket gives a
    narrower one, and exact counts below and inside tell whether the place is still in it. When a bracket has few distinct
    values, these are counted and the place is read off. No task and no buffer holds more than ``FEW`` of them.
    """
    least, most = x.agg(F.min("x"), F.max("x")).first()
    bracket = {r: (least, most, 0) for r in ranks}  # low, high, rows below low
    inside = lambda r: F.col("x").between(bracket[r][0], bracket[r][1])
    out: dict[int, float] = {}
    while len(out) < len(bracket):
        left = [r for r in bracket if r not in out]
        seen = x.agg(*(F.approx_count_distinct(F.when(inside(r), F.col("x"))).alias(f"d{r}") for r in left), *(F.count_if(inside(r)).alias(f"n{r}") for r in left)).first()
        few = [r for r in left if 2 * seen[f"d{r}"] <= FEW or bracket[r][0] == bracket[r][1]]
        counted: dict[tuple, list] = {}  # places in one bracket are read off together
        for r in few:
            if bracket[r] not in counted:
                counted[bracket[r]] = x.where(inside(r)).groupBy("x").agg(F.count("*").alias("c")).orderBy("x").collect()
            upto = bracket[r][2]
            for value, c in counted[bracket[r]]:
                upto += c
                if r < upto:
                    out[r] = value
                    break
        many = [r for r in left if r not in few]
        if not many:
            continue
        near = lambda r: [min(1.0, max(0.0, (r - bracket[r][2] + d * (2 + seen[f"n{r}"] / ACCURACY)) / seen[f"n{r}"])) for d in (-2, 2)]
        sketch = x.agg(*(F.percentile_approx(F.when(inside(r), F.col("x")), near(r), ACCURACY).alias(f"s{r}") for r in many)).first()
        ends = {r: sketch[f"s{r}"] for r in many}
        counts = x.agg(*(F.count_if(F.col("x") < ends[r][0]).alias(f"b{r}") for r in many), *(F.count_if(F.col("x") <= ends[r][1]).alias(f"u{r}") for r in many)).first()
        for r in many:
            low, high, below = bracket[r]
            if ends[r] == [low, high]:  # as wide as before: halved, so that every round narrows it
                middle = low + (high - low) / 2
                upto = x.where(F.col("x") <= middle).count()
                bracket[r] = (low, middle, below) if r < upto else (float(np.nextafter(middle, np.inf)), high, upto)
            elif r < counts[f"b{r}"]:  # the sketch was off: what lies below it, or above
                bracket[r] = (low, float(np.nextafter(ends[r][0], -np.inf)), below)
            elif r >= counts[f"u{r}"]:
                bracket[r] = (float(np.nextafter(ends[r][1], np.inf)), high, counts[f"u{r}"])
            else:
                bracket[r] = (ends[r][0], ends[r][1], counts[f"b{r}"])
    return [out[r] for r in ranks]


def exact_quantiles(df: DataFrame, value: Column, shares: Sequence[float]) -> list[float | None]:
    """Quantiles with linear interpolation between neighbours, exactly; nulls and NaN do not count. None for each if there are
    no values."""
    x = stored(df.select(value.cast("double").alias("x")).where("x is not null and not isnan(x)"), "quantiles")
    n = x.count()
    if not n:
        return [None for _ in shares]
    places = [(int((n - 1) * q), (n - 1) * q - int((n - 1) * q)) for q in shares]
    ranks = sorted({r for i, part in places for r in ((i, i + 1) if part else (i,))})
    at = dict(zip(ranks, _at_ranks(x, ranks), strict=True))
    return [at[i] + part * (at[i + 1] - at[i]) if part else at[i] for i, part in places]


def ranged(df: DataFrame, value: Column, edges: Sequence[int]) -> DataFrame:
    """Counts of half-open ranges between edges, the last one open; also empty ranges. low, n, percent."""
    at = F.array(*map(F.lit, edges))
    low = F.array_max(F.filter(at, lambda e: e <= value))
    total = df.agg(F.count("*").alias("total"))
    counts = df.select(low.alias("low")).where("low is not null").groupBy("low").agg(F.count("*").alias("n"))
    every = df.sparkSession.createDataFrame([(e,) for e in edges], "low int")
    rows = every.join(F.broadcast(counts), "low", "left").crossJoin(F.broadcast(total))
    return rows.select("low", F.coalesce("n", F.lit(0)).alias("n"), F.round(100 * F.coalesce("n", F.lit(0)) / F.greatest("total", F.lit(1)), 6).alias("percent"))


def most_common(df: DataFrame, value: Column, k: int) -> DataFrame:
    return df.select(value.alias("value")).groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def length_buckets(df: DataFrame, words: Column) -> DataFrame:
    """At most three buckets of word counts, split at the exclusive quartiles: label, word_min, word_max, probability.

    With one row: medium, one word around it. With equal quartiles the split is around the upper middle. Without rows:
    medium from one word on.
    """
    x = df.select(words.cast("long").alias("w")).where("w is not null")
    counts = x.groupBy("w").agg(F.count("*").alias("c"))
    # places are read off cumulative counts of distinct lengths, not off sorted rows
    upto = Window.orderBy("w")
    cum = counts.withColumn("cum", F.sum("c").over(upto))
    n = F.sum("c").over(Window.partitionBy())
    cum = cum.withColumn("n", n)

    def at(place: Column) -> Column:
        return F.min(F.when(F.col("cum") >= place, F.col("w")))

    def quartile(j: int) -> Column:
        # place j * (n + 1) / 4, kept inside 1 .. n - 1 and interpolated
        pos = F.greatest(F.lit(1), F.least(F.floor((F.col("n") + 1) * j / 4), F.col("n") - 1))
        part = (F.col("n") + 1) * j - pos * 4
        low, high = at(pos), at(pos + 1)
        return ((low * (4 - F.first(part)) + high * F.first(part)) / 4).alias(f"q{j}")

    s = cum.agg(F.first("n").alias("n"), F.min("w").alias("w_min"), F.max("w").alias("w_max"), quartile(1), quartile(3), at(F.floor(F.col("n") / 2) + 1).alias("middle"))
    lo, hi = F.col("q1").cast("long"), F.col("q3").cast("long")
    flat = lo >= hi
    s = s.withColumns({"lo": F.when(flat, F.greatest(F.lit(1), F.col("middle") - 1)).otherwise(lo), "hi": F.when(flat, F.col("middle")).otherwise(hi)})
    parts = x.crossJoin(F.broadcast(s)).groupBy("n", "w_min", "lo", "hi").agg(F.count_if(F.col("w") <= F.col("lo")).alias("short"), F.count_if((F.col("w") > F.col("lo")) & (F.col("w") <= F.col("hi"))).alias("medium"), F.count_if(F.col("w") > F.col("hi")).alias("long"))
    bucket = lambda label, low, high, c: F.struct(F.lit(label).alias("label"), low.cast("long").alias("word_min"), high.cast("long").alias("word_max"), F.round(c / F.col("n"), 6).alias("probability"))
    none = F.lit(None)
    three = F.filter(F.array(bucket("short", F.col("w_min"), F.col("lo"), F.col("short")), bucket("medium", F.col("lo") + 1, F.col("hi"), F.col("medium")), bucket("long", F.col("hi") + 1, none, F.col("long"))), lambda b: b.probability > 0)
    single = F.array(bucket("medium", F.greatest(F.lit(1), F.col("w_min") - 1), F.col("w_min") + 1, F.col("n")))
    got = parts.select(F.explode(F.when(F.col("n") == 1, single).otherwise(three)).alias("b")).select("b.*")
    empty = x.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("medium").alias("label"), F.lit(1).cast("long").alias("word_min"), none.cast("long").alias("word_max"), F.lit(1.0).alias("probability"))
    return got.union(empty)


def rounded_median(df: DataFrame, value: Column) -> DataFrame:
    """One row: the exact median, and its three roundings; nulls without values."""
    m = df.sparkSession.createDataFrame([tuple(exact_quantiles(df, value, [0.5]))], "median double")
    return m.select("median", F.floor("median").alias("floor"), F.ceil("median").alias("ceil"), F.floor(F.col("median") + 0.5).alias("round"))


def split_by_score(df: DataFrame, key: str, text: str, score: str, position: str, keep_incomplete: bool = False) -> DataFrame:
    """Texts of score 1 as pos and of score 0 as neg, in order; keys that lack one go unless kept."""
    rows = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(position, text, score))).alias("all"))
    side = lambda s: F.transform(F.filter("all", lambda x: x[score] == s), lambda x: x[text])
    rows = rows.select(key, side(1).alias("pos"), side(0).alias("neg"))
    return rows if keep_incomplete else rows.where((F.size("pos") > 0) & (F.size("neg") > 0))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*(F.count_distinct(c).alias(c) for c in columns))


def task_means(df: DataFrame, task: str, languages: str, score: str) -> DataFrame:
    """A task's score counts once for each of its languages."""
    return df.select(task, F.explode(languages).alias("_l"), score).groupBy(task).agg(F.round(F.avg(score), 6).alias("mean"))


def type_means(df: DataFrame, kind: str, score: str) -> DataFrame:
    """Mean of each type, and as ``all`` the mean of these means."""
    by = df.groupBy(kind).agg(F.avg(score).alias("mean"))
    return by.select(kind, F.round("mean", 6).alias("mean")).union(by.agg(F.lit("all").alias(kind), F.round(F.avg("mean"), 6).alias("mean")))


def pivoted(df: DataFrame, row: str, column: str, value: str, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(row).pivot(column, list(columns)).agg(F.min(value))


def even_share(df: DataFrame, model: str, benchmark: str, task: str, score: str, tasks: int) -> DataFrame:
    """Per model the mean of each benchmark times 100, null if it lacks a task, and their difference (second less first in
    name order)."""
    by = df.groupBy(model, benchmark).agg(F.when(F.count_distinct(task) == tasks, F.round(100 * F.avg(score), 2)).alias("mean"))
    names = [r[0] for r in by.select(benchmark).distinct().orderBy(benchmark).limit(2).collect()]
    wide = by.groupBy(model).pivot(benchmark, names).agg(F.min("mean"))
    return wide.withColumn("delta", F.round(F.col(f"`{names[1]}`") - F.col(f"`{names[0]}`"), 2))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation, ties at their mean rank; ranks come from counts of distinct values."""

    def ranks(c: str, name: str) -> DataFrame:
        counts = df.groupBy(c).agg(F.count("*").alias("_c"))
        # distinct values may be as many as rows, so no task sees them all
        rows = running(numbered(counts, [c], "_n"), "_n", {"_before": F.col("_c")})
        return rows.select(c, (F.col("_before") + (F.col("_c") + 1) / 2).alias(name))

    return df.join(ranks(a, "_ra"), a).join(ranks(b, "_rb"), b).agg(F.round(F.corr("_ra", "_rb"), 6).alias("rho"))


def metric_table(df: DataFrame, task: str, split: str, metrics: Sequence[str]) -> DataFrame:
    """Per task the mean of each metric over the rows of its first split, and the mean of tasks as ``average``."""
    first = df.withColumn("_s", F.min(split).over(Window.partitionBy(task))).where(F.col(split) == F.col("_s"))
    by = first.groupBy(task).agg(*(F.avg(m).alias(m) for m in metrics))
    both = by.union(by.agg(F.lit("average").alias(task), *(F.avg(m).alias(m) for m in metrics)))
    return both.select(task, *(F.round(m, 6).alias(m) for m in metrics))
