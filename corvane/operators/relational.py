"""Filters, keyed de-duplication, positions, joins and restructuring of nested batches.

A batch is documents -> queries -> candidates -> annotations. Inside the engine it is flat, keyed by doc_id and positions;
the nested form is made and taken apart at the edges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..functions.labels import verdict
from ..session import stored

# -- filters


def usable_queries(df: DataFrame, column: str) -> DataFrame:
    return df.where(~text.blank(F.col(column)))


def has_candidates(queries: Column) -> Column:
    return F.coalesce(F.exists(queries, lambda q: F.size(q.candidates) > 0), F.lit(False))


def without_fields(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def generation_candidates(df: DataFrame, kind: str, column: str, words: int) -> DataFrame:
    """Sentences of running text with enough words."""
    return df.where(F.col(kind).isin("abstract", "normal paragraph") & ~text.blank(F.col(column)) & (text.regex_word_count(F.col(column)) >= words))


def violations(df: DataFrame, key: str, text_columns: Sequence[str] = (), index_columns: Mapping[str, str] | None = None, same_length: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Rows (key, violation); a valid table gives none. index_columns: integer column to the array that it points into."""
    checks = [F.when(text.blank(F.col(c)), f"blank {c}") for c in text_columns]
    checks += [F.when(F.coalesce((F.col(i) < 0) | (F.col(i) >= F.size(a)), F.lit(True)), "index out of range") for i, a in (index_columns or {}).items()]
    checks += [F.when(F.size(a) != F.size(b), f"{a} and {b} differ in length") for a, b in same_length]
    own = df.select(key, F.explode(F.array_compact(F.array(*checks))).alias("violation")) if checks else df.select(key, F.lit("").alias("violation")).limit(0)
    return own.union(df.groupBy(key).count().where("count > 1").select(key, F.lit("duplicate id").alias("violation")))


# -- rows by key and position


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def first_rows_per(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def last_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return first_per(df, keys, [F.col(c).desc() for c in order])


def distinct_queries(df: DataFrame, keys: Sequence[str], column: str, position: str) -> DataFrame:
    """Trimmed, non-blank queries, the first of equal ones."""
    rows = usable_queries(df, column).withColumn("query", F.trim(column))
    return first_per(rows, [*keys, "query"], [position])


#: Rows that are summed in one task.
PART = 100_000


def running(df: DataFrame, place: str, sums: Mapping[str, Column]) -> DataFrame:
    """Adds sums over all rows before each, in the order of ``place`` (1, 2, ... as ``numbered`` gives it): inside parts of
    rows, and over the parts before."""
    rows = df.withColumns({"_part": F.floor((F.col(place) - 1) / PART), **{f"_x_{c}": x for c, x in sums.items()}})
    earlier = lambda w, x: F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = rows.groupBy("_part").agg(*(F.sum(f"_x_{c}").alias(f"_s_{c}") for c in sums))
    begun = parts.select("_part", *(earlier(Window.orderBy("_part"), f"_s_{c}").alias(f"_b_{c}") for c in sums))
    inside = Window.partitionBy("_part").orderBy(place)
    rows = rows.join(begun, "_part").withColumns({c: F.col(f"_b_{c}") + earlier(inside, f"_x_{c}") for c in sums})
    return rows.drop("_part", *(f"{k}_{c}" for c in sums for k in ("_x", "_s", "_b")))


def numbered(df: DataFrame, order: Sequence[str | Column], name: str, partition: Sequence[str] = ()) -> DataFrame:
    """Adds 1, 2, ... in the given order.

    Over the whole table no task sees all rows: the table is sorted across partitions and stored once, and a row's
    number is its place in its partition plus the rows of earlier partitions, a table with one row a partition.
    """
    if partition:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)).cast("long"))
    rows = stored(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumn("_part", F.shiftright("_id", 33))
    counts = rows.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    numbered_rows = rows.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1)
    return numbered_rows.drop("_id", "_part", "_start")


def batch_slice(df: DataFrame, order: Sequence[str], skip: int, rows: int | None = None) -> DataFrame:
    """Rows after the first ``skip``, at most ``rows`` of them."""
    n = numbered(df, order, "_n").where(F.col("_n") > skip)
    return (n if rows is None else n.where(F.col("_n") <= skip + rows)).drop("_n")


def chunked(df: DataFrame, order: Sequence[str], size: int, name: str = "chunk", partition: Sequence[str] = ()) -> DataFrame:
    """Consecutive chunks of ``size`` rows, from 0."""
    return numbered(df, order, "_n", partition).withColumn(name, F.floor((F.col("_n") - 1) / size).cast("long")).drop("_n")


def tiled(df: DataFrame, order: Sequence[str], parts: int, name: str = "part") -> DataFrame:
    """Parts 1 to ``parts`` of equal size, the first ones a row larger where it does not divide."""
    rows = numbered(df, order, "_n")
    total = rows.agg(F.count("*").alias("_total"))
    rows = rows.join(F.broadcast(total))
    small, extra = F.floor(F.col("_total") / parts), F.col("_total") % parts
    wide = (small + 1) * extra
    tile = F.when(F.col("_n") <= wide, F.floor((F.col("_n") - 1) / (small + 1))).otherwise(extra + F.floor((F.col("_n") - wide - 1) / F.greatest(small, F.lit(1))))
    return rows.withColumn(name, (tile + 1).cast("int")).drop("_n", "_total")


def halves(df: DataFrame, order: Sequence[str], name: str = "half") -> DataFrame:
    return tiled(df, order, 2, name)


def positional_ids(df: DataFrame, key: str, position: str, prefix: str = "", width: int = 6, name: str = "id") -> DataFrame:
    """Per distinct ``key``, a zero-padded number in the order in which it first occurs, from 0."""
    firsts = df.groupBy(key).agg(F.min(position).alias("first_at"))
    return numbered(firsts, ["first_at", key], "_n").withColumn(name, F.concat(F.lit(prefix), F.lpad((F.col("_n") - 1).cast("string"), width, "0"))).drop("_n")


# -- joins


def query_verdicts(rows: DataFrame, scored: DataFrame, key: str) -> DataFrame:
    """A missing score fails, one that cannot be read counts as 0."""
    score = F.coalesce(F.col("score").cast("string").try_cast("int"), F.lit(0))
    return rows.join(scored.select(key, "score"), key, "left").withColumn("verdict", verdict(score))


def document_verdicts(rows: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    return rows.join(verdicts.select(key, "verdict"), key, "left").withColumn("verdict", F.coalesce("verdict", F.lit("fail")))


def resolve(ids: Column, candidates: Column) -> Column:
    """Texts of ids in their order; of repeated candidates the last text counts, unknown ids drop out."""
    known = F.map_from_entries(F.filter(candidates, lambda c, i: ~F.exists(F.slice(candidates, i + 2, F.size(candidates)), lambda later: later.doc_id == c.doc_id)))
    texts = F.transform(ids, lambda x: F.try_element_at(known, x))
    return F.filter(texts, lambda t: t.isNotNull())


def with_texts(hits: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds doc; an unknown id has an empty one. Of repeated ids the last text counts."""
    return hits.join(docs.select(key, "doc"), key, "left").withColumn("doc", F.coalesce("doc", F.lit("")))


def query_origins(rows: DataFrame, batch: DataFrame, position: str) -> DataFrame:
    """Adds origin_doc: the document of the last query with the same text, or null."""
    last = last_per(batch.select("query", F.col("doc").alias("origin_doc"), position), ["query"], [position])
    return rows.join(last.select("query", "origin_doc"), "query", "left")


def queries_by_text(docs: DataFrame, training: DataFrame, most: int, position: str) -> DataFrame:
    """Per document (doc_id, doc) up to ``most`` distinct queries of training rows (query, pos) that have its text among
    their positives, in scan order. Texts meet by hash and are compared whole."""
    pos = training.select("query", position, F.explode("pos").alias("doc")).withColumn("_h", F.xxhash64("doc"))
    met = docs.withColumn("_h", F.xxhash64("doc")).join(pos, ["_h", "doc"])
    once = met.groupBy("doc_id", "query").agg(F.min(position).alias(position))
    return numbered(once, [position, "query"], "place", ["doc_id"]).where(F.col("place") <= most)


def labelled_pairs(qrels: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """qrels (query_id, doc_id, score 0 or 1) with both texts; rows that miss one drop out."""
    return qrels.where(F.col("score").isin(0, 1)).join(queries, "query_id").join(corpus, "doc_id")


def not_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key), key, "left_anti")


def complement(full: DataFrame, sample: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``full`` outside ``sample``, and rows of ``sample`` that ``full`` does not hold alike (none if it is a
    subset)."""
    return not_done(full, sample, key), sample.select(*full.columns).exceptAll(full)


def candidate_scores(annotations: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Annotations joined with candidates on (query_id, doc_id), and violations: unmatched or repeated pairs."""
    key = ["query_id", "doc_id"]
    joined = annotations.join(candidates.withColumn("_found", F.lit(True)), key, "left")
    bad = joined.where("_found is null").select(*key, F.lit("unmatched").alias("violation"))
    twice = annotations.groupBy(*key).count().where("count > 1").select(*key, F.lit("repeated").alias("violation"))
    return joined.drop("_found"), bad.union(twice)


def best_match(targets: DataFrame, rows: DataFrame) -> DataFrame:
    """Targets (sample_id, query, document, source_doc_id) with rows (query, doc_id, doc, score) of the same query: id and
    text first, then id, then text. ``ties`` counts equally good rows; it must be 1."""
    same_id, same_text = F.col("doc_id") == F.col("source_doc_id"), F.col("doc") == F.col("document")
    priority = F.when(same_id & same_text, 0).when(same_id, 1).when(same_text, 2)
    met = targets.join(rows, "query").withColumn("priority", priority).where("priority is not null")
    ranked = met.withColumn("_r", F.rank().over(Window.partitionBy("sample_id").orderBy("priority"))).where("_r = 1")
    return ranked.groupBy("sample_id").agg(F.min("priority").alias("priority"), F.min("doc_id").alias("doc_id"), F.min("score").alias("score"), F.countDistinct("doc_id").alias("ties"))


def expected_and_predicted(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """Per expected (query_id, doc_id, expected_label) the predicted classification, or ``missing``."""
    return expected.join(predicted.select("query_id", "doc_id", "classification"), ["query_id", "doc_id"], "left").withColumn("predicted", F.coalesce("classification", F.lit("missing"))).drop("classification")


def attach(rows: DataFrame, extra: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The join, and keys that only one side has (none if the sets are equal)."""
    return rows.join(extra, key), key_differences(rows, extra, key)


def zipped(a: DataFrame, b: DataFrame, order: Sequence[str], on: str) -> tuple[DataFrame, DataFrame]:
    """Two tables row by row, and the positions at which ``on`` differs."""
    left, right = numbered(a, order, "position"), numbered(b, order, "position")
    both = left.select("position", *(F.col(c).alias(f"a_{c}") for c in a.columns)).join(right.select("position", *(F.col(c).alias(f"b_{c}") for c in b.columns)), "position", "full_outer")
    return both, both.where(~F.col(f"a_{on}").eqNullSafe(F.col(f"b_{on}"))).select("position")


def by_plan(plans: DataFrame, queries: DataFrame, key: str = "plan_key") -> DataFrame:
    return plans.join(queries, key)


# -- sets and nesting


def key_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: (key, side), ``missing`` from b or ``extra`` in b."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    return x.join(y, key, "full_outer").where("_a is null or _b is null").select(key, F.when(F.col("_b").isNull(), "missing").otherwise("extra").alias("side"))


def union_rows(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merge_batches(*parts: tuple[dict, DataFrame]) -> tuple[dict, DataFrame]:
    """Batches with one header, in order; other headers raise."""
    header = parts[0][0]
    for other, _ in parts[1:]:
        if other != header:
            raise ValueError(f"headers differ: {header} and {other}")
    return header, union_rows(*(rows.withColumn("part", F.lit(i)) for i, (_, rows) in enumerate(parts)))


def flatten_queries(batch: DataFrame) -> DataFrame:
    """Documents with queries to one row a query; a query given as a bare string must be a struct already."""
    rows = batch.select(*(c for c in batch.columns if c != "queries"), F.posexplode("queries").alias("query_pos", "_q"))
    return rows.select("*", "_q.*").drop("_q")


def flatten_candidates(rows: DataFrame) -> DataFrame:
    return rows.select(*(c for c in rows.columns if c != "candidates"), F.posexplode("candidates").alias("candidate_pos", "_c")).select("*", F.col("_c.doc_id").alias("candidate_id"), F.col("_c.doc").alias("candidate_doc")).drop("_c")


def nest(rows: DataFrame, keys: Sequence[str], position: str, fields: Sequence[str], name: str) -> DataFrame:
    """Rows gathered by key, in the order of their positions."""
    grouped = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(position, *(f for f in fields if f != position)))).alias("_all"))
    return grouped.select(*keys, F.transform("_all", lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias(name))


def keep_position(batch: DataFrame, p: int) -> DataFrame:
    """The p-th query of each document, from 1; documents with fewer go."""
    return batch.where(F.size("queries") >= p).withColumn("queries", F.array(F.element_at("queries", p))).withColumn("num_queries", F.lit(1))
