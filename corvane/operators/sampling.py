"""Reproducible samples. Randomness is a keyed digest of an id, so a sample is the same in any engine, for any
partitioning, and a smaller sample is a prefix of a larger one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .relational import numbered


def digest(seed: int | str, *keys: str | Column) -> Column:
    """SHA-256 of the seed and keys, separated by NUL."""
    parts = [F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys)]
    return F.sha2(F.concat_ws("\0", *parts), 256)


def uniform(seed: int | str, *keys: str | Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the digest."""
    return F.conv(F.substring(digest(seed, *keys), 1, 8), 16, 10).cast("double") / float(1 << 32)


#: Rows up to which a task may hold the first of a table in a heap.
HEAP = 10_000


def _first(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    """The first n rows: by a heap in each task if they are few, else by a distributed sort and their numbers."""
    return df.orderBy(*order).limit(n) if n <= HEAP else numbered(df, order, "_n").where(F.col("_n") <= n).drop("_n")


def sample(df: DataFrame, n: int | None, seed: int | str, key: str) -> DataFrame:
    """n rows; all of them without n, or if there are no more."""
    return df if n is None else _first(df, [digest(seed, key), key], n)


def closed_range(df: DataFrame, order: Sequence[str], spec: str | None) -> DataFrame:
    """``start-end``, from 0, both included; an unreadable spec gives all rows."""
    try:
        a, b = (int(x) for x in (spec or "").split("-"))
    except ValueError:
        return df
    return numbered(df, order, "_n").where((F.col("_n") > a) & (F.col("_n") <= b + 1)).drop("_n")


def index_list(df: DataFrame, order: Sequence[str], indices: Sequence[int] | None) -> DataFrame:
    """Rows at these places, from 0, each once; places beyond the table are skipped."""
    if not indices:
        return df
    return numbered(df, order, "_n").where((F.col("_n") - 1).isin(sorted(set(indices)))).drop("_n")


def reservoir(df: DataFrame, k: int, seed: int | str, key: str, predicate: Column | None = None) -> DataFrame:
    """A uniform sample of k rows that fulfil a predicate, as one-pass reservoirs draw; it merges over parts of a stream."""
    return sample(df if predicate is None else df.where(predicate), k, seed, key)


def nested(df: DataFrame, sizes: Sequence[int], seed: int | str, key: str) -> DataFrame:
    """The largest sample, with ``smallest``, the least of the sizes whose sample holds the row."""
    ranked = numbered(sample(df, max(sizes), seed, key).withColumn("_d", digest(seed, key)), ["_d", key], "place").drop("_d")
    which = F.array_min(F.filter(F.array(*map(F.lit, sorted(sizes))), lambda s: s >= F.col("place")))
    return ranked.withColumn("smallest", which)


def half(df: DataFrame, seed: int | str, key: str) -> DataFrame:
    """Half of the rows, rounded down; sort by position to restore the order."""
    return _first(df, [digest(seed, key), key], df.count() // 2)


def weighted_mixture(df: DataFrame, slot: str, weights: Mapping[int, int], seed: int | str, key: str, cap: int | None = None) -> DataFrame:
    """Rows of slot i as often as weights[i] says, at most ``cap`` rows a slot before that, in the order of digests.
    Adds copy and order."""
    if cap is not None:
        w = Window.partitionBy(slot).orderBy(digest(f"{seed}-cap", key), key)
        df = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")
    table = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    rows = df.withColumn("_w", F.coalesce(F.try_element_at(table, F.col(slot)), F.lit(0))).where("_w > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_w")))).drop("_w")
    return rows.withColumn("order", digest(seed, key, "copy"))


def one_of(items: Column, seed: int | str, *keys: str) -> Column:
    """One element of an array, by the smallest digest of the keys and the element's place."""
    marked = F.transform(items, lambda x, i: F.struct(digest(seed, *(F.col(k) for k in keys), i).alias("d"), x.alias("x")))
    return F.array_min(marked).x


def one_per_group(df: DataFrame, keys: Sequence[str], column: str, seed: int | str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(column, F.struct(digest(seed, *keys, column), F.col(column))).alias(column))


def annotator_order(df: DataFrame, annotator: str, dataset: str, key: str) -> DataFrame:
    """Adds place: the order in which an annotator sees the samples of a data set."""
    mark = F.sha2(F.concat_ws("\0", F.lit(annotator), F.col(dataset), F.col(key).cast("string")), 256)
    return df.withColumn("place", F.row_number().over(Window.partitionBy(dataset).orderBy(mark)))


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return _first(df, order, n)


def capped(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def best_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The best row of each key under several criteria."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def greedy_distinct(df: DataFrame, order: Sequence[Column], fields: Sequence[str], count: int, preferred: str | None = None, slots: int = 2, pool: int = 10_000) -> list:
    """Up to ``count`` rows in order, none sharing a value of ``fields`` with an earlier pick, as a walk over the whole
    table gives them; the first ``slots`` go to rows with ``preferred`` if there are such. Nulls are one value.

    The walk takes the best ``pool`` rows at a time, and after them the best of those rows that share nothing with a pick:
    all others are settled. The first row of each part is picked, so there are at most ``count`` parts, and one for each
    of the two walks where nothing is left.
    """
    picked: list = []
    used: dict[str, set] = {f: set() for f in fields}

    def take(candidates, most):
        while len(picked) < most:
            free = candidates
            for f in fields:
                for value in used[f]:
                    free = free.where(~F.col(f).eqNullSafe(F.lit(value)))
            rows = free.orderBy(*order).limit(pool).collect()
            for r in rows:
                if len(picked) < most and not any(r[f] in used[f] for f in fields):
                    picked.append(r)
                    for f in fields:
                        used[f].add(r[f])
            if len(rows) < pool:
                return

    if preferred:
        take(df.where(F.col(preferred).cast("boolean")), min(slots, count))
    take(df, count)
    return picked


def length_hint(df: DataFrame, buckets: Sequence[tuple[str, float]], seed: int | str, key: str) -> DataFrame:
    """Adds bucket: a label drawn with the buckets' probabilities."""
    u, total, out = uniform(seed, key), 0.0, None
    for label, p in buckets[:-1]:
        total += p
        out = F.when(u < total, label) if out is None else out.when(u < total, label)
    last = F.lit(buckets[-1][0])
    return df.withColumn("bucket", last if out is None else out.otherwise(last))


def rank_slice(df: DataFrame, start: int, end: int) -> DataFrame:
    """Ranks start + 1 to end."""
    return df.where((F.col("rank") > start) & (F.col("rank") <= end))


def score_at(df: DataFrame, end: int) -> DataFrame:
    """Per query the score at rank ``end``, or at the last rank."""
    return df.where(F.col("rank") <= end).groupBy("query_id").agg(F.max_by("score", "rank").alias("ref"))
