"""Mixing sources to target weights under a time-varying curriculum.

Training time runs from 0 to 1. At time t source s is read at a rate of target(s) * r(s, t), where r integrates to 1 over
the run; by default r rises or falls linearly, r = 1 + tilt(s) * (2t - 1). Integrated, the demand for s up to t is

    D(s, t) = target(s) * ((1 - tilt) * t + tilt * t**2).

A source's documents, in the order of a digest of their ids and for as many epochs as the target needs, lie end to end on
its demand: a copy that begins ``before`` words into the stream is trained at the t with D(s, t) = before, and is taken
if before < target. Documents, with their copies, are then range-sorted by position, so each part of the output is a
span of training time and needs no further shuffling.

Targets follow the weights; a source stops at ``cap`` times its size and the excess goes to the others by weight, until
none is above. That is a water level: sorted by cap * size / weight, the sources up to some rank are full.

Running sums never gather a source in one task: documents fall into digest ranges, ranges are summed first, and a
document's place is its range's start plus a sum inside the range.

Nulls and edge cases: null text has size 0. A null source is a source of its own and comes last. A document of size 0
takes 0 words and is not in the mix. Rows with a null doc_id are spread by their text. Rows that repeat a doc_id lie side
by side, ordered by text, and are placed each. A text is counted whole where it is read; a task holds one at a time. An
empty table, or one without words, gives no mix. Other columns are kept by ``mix`` whatever their names; its own column
is ``position``, with underscores added while the table has one of that name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import keep, scope, small, unused

#: Hexadecimal digits of the digest that name a range: 4,096 ranges a source.
RANGE_DIGITS = 3


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), percent: int = 150, cap: int = 2) -> DataFrame:
    """From (source, source_size), one row a source: adds place (0, 1, ... by code point, null last), weight, target.

    This is a table of sources, one row each; its windows run over that table alone.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*map(F.lit, weights))
    rows = sizes.withColumn("place", (F.row_number().over(order) - 1).cast("int")).withColumn("weight", F.element_at(cycle, F.col("place") % len(weights) + 1).cast("long"))
    everyone = Window.partitionBy()
    rows = rows.withColumn("demand", F.sum("source_size").over(everyone) * percent)  # in hundredths
    # fill order: a source with less size for its weight is full at a lower level
    fill = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), "place")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("full", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * 100 * cap)
    rows = rows.withColumn("open", F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # the level if this source and all after it were not full; it is full if that level is above its cap
    rows = rows.withColumn("over", (F.col("demand") - F.col("full")) * F.col("weight") > F.col("source_size") * 100 * cap * F.col("open"))
    # sources after the last full one share what is left
    free = F.struct((F.col("demand") - F.col("full")).alias("left"), F.col("open").alias("open"))
    rows = rows.withColumn("level", F.min_by(F.when(~F.col("over"), free), F.when(~F.col("over"), F.struct("full", -F.col("open")))).over(everyone))
    share = F.col("level.left").cast("double") * F.col("weight").cast("double") / F.col("level.open").cast("double") / 100.0
    target = F.when(F.col("over") | F.col("level").isNull(), (F.col("source_size") * cap).cast("double")).otherwise(share)
    return rows.select("source", "source_size", "place", "weight", target.alias("target"))


def _text_key() -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64(F.col("text").cast("string"), F.col("source").cast("string"))


def plan(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), percent: int = 150, cap: int = 2, tilts: Sequence[float] = (-0.5, 0.0, 0.5)) -> DataFrame:
    """Per row of ``docs``: doc_id, text_key, nth (1, 2, ... among rows that repeat both), size, source_size, target, copies
    (0 to ``cap``), taken (words), positions (of each copy, 0 to 1), shares (of all words in the mix, those that come before each position).

    weights, tilts: of the sources by code point, repeating; a tilt of -1 to 1 moves a source to the start or the end, and
    one beyond raises.
    """
    if not all(-1 <= x <= 1 for x in tilts):
        raise ValueError("a tilt is between -1 and 1, or rates would be negative")
    rows = docs.select(F.col("doc_id").cast("long"), _text_key().alias("text_key"), F.col("source").cast("string"), size_of(F.col("text")).alias("size"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.col("text_key").cast("string")))
    rows = keep(rows.withColumn("digest", F.md5(name.cast("binary"))), "mix-rows")
    rows = rows.withColumn("part", F.substring("digest", 1, RANGE_DIGITS))
    # sources by ranges: a table of at most 4,096 rows a source
    parts = keep(rows.groupBy("source", "part").agg(F.sum("size").alias("part_size")), "mix-parts")
    goal = targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, percent, cap)
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begun = parts.withColumn("begun", F.coalesce(F.sum("part_size").over(ahead), F.lit(0))).drop("part_size")
    same = F.col("g.source").eqNullSafe(F.col("b.source"))
    table = keep(begun.alias("b").join(goal.alias("g"), same).select("b.source", "part", "begun", "source_size", "place", "target"), "mix-table")
    # the demand of all sources up to t is level * t + rise * t**2
    tilt = F.element_at(F.array(*(F.lit(float(x)) for x in tilts)), F.col("place") % len(tilts) + 1)
    one = table.groupBy("place").agg(F.max("target").alias("target"))
    level, rise = (x or 0.0 for x in one.agg(F.sum(F.col("target") * (1 - tilt)), F.sum(F.col("target") * tilt)).first())
    table = table.alias("t")
    inside = Window.partitionBy("source", "part").orderBy("digest", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    again = Window.partitionBy("source", "part", "digest", "doc_id", "text_key").orderBy("size")
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).withColumn("nth", F.row_number().over(again)).alias("r")
    placed = rows.join(table, F.col("r.source").eqNullSafe(F.col("t.source")) & (F.col("r.part") == F.col("t.part")))
    before = F.col("begun") + F.col("inside")
    placed = placed.select("doc_id", "text_key", "nth", "size", "source_size", "target", "place", before.alias("before"))
    # epoch e of a document begins at before + e * source_size
    epochs = F.array(*(F.col("before") + e * F.col("source_size") for e in range(cap)))
    starts = F.when(F.col("size") > 0, F.filter(epochs, lambda x: x < F.col("target"))).otherwise(F.array().cast("array<bigint>"))
    # D(s, t) = before, solved for t
    when = lambda x: F.when(tilt == 0, x / F.col("target")).otherwise((F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * x / F.col("target")) - (1 - tilt)) / (2 * tilt))
    positions = F.transform("starts", when)
    # a document's words are taken at its positions: no position, no words
    placed = placed.withColumn("starts", starts).withColumn("positions", positions)
    copies = F.size("positions").cast("long")
    shares = F.transform("positions", lambda t: (level * t + rise * t * t) / ((level + rise) or 1.0))
    return placed.select("doc_id", "text_key", "nth", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "positions", shares.alias("shares"))


def _in_order(rows: DataFrame, position: str, share: str, parts: int | None) -> DataFrame:
    """Range-sorted by position, in parts of equal numbers of words, whatever the tilts: a part is a range of the share of
    words that come before a position, which follows from the schedules, without a sampling pass."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = F.least(F.floor(F.col(share) * n), F.lit(n - 1)).cast("int")
    return rows.repartitionById(n, F.greatest(own, F.lit(0))).sortWithinPartitions(F.col(position).asc_nulls_last(), "doc_id")


def schedule(docs: DataFrame, parts: int | None = None, **options) -> DataFrame:
    """``plan``, range-sorted by the position of each document's first copy, with ``first_position``; what the mix does not
    take comes last. Rows are narrow here, so ranges are even in rows and not in words."""
    rows = keep(plan(docs, **options).withColumn("first_position", F.get("positions", F.lit(0))), "mix-plan")
    keys = [F.col("first_position").asc_nulls_last(), F.col("doc_id"), F.col("text_key")]
    ranged = rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)


def mix(docs: DataFrame, parts: int | None = None, **options) -> DataFrame:
    """The mixture: rows of ``docs``, as often as they are taken, range-sorted by training position, with ``position``."""
    position, share, key, own, mix_id, mix_key, mix_nth = unused(docs, "position", "share", "text_key", "nth", "mix_id", "mix_key", "mix_nth")
    with scope(docs.sparkSession):
        copies = plan(docs, **options).select(F.col("doc_id").alias(mix_id), F.col("text_key").alias(mix_key), F.col("nth").alias(mix_nth), F.explode(F.arrays_zip("positions", "shares")).alias("at"))
        copies = copies.select(mix_id, mix_key, mix_nth, F.col("at.positions").alias(position), F.col("at.shares").alias(share))
        taken = keep(copies, "mix-taken", outside=True)
    side = F.broadcast(taken) if small(taken) else taken
    rows = docs.withColumn(key, _text_key())
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(mix_id)) & (F.col(key) == F.col(mix_key))
    if not taken.where(F.col(mix_nth) > 1).isEmpty():
        # rows that repeat a document with its text take one place each
        rows = rows.withColumn(own, F.row_number().over(Window.partitionBy(F.col("doc_id").cast("long"), key).orderBy(F.monotonically_increasing_id())))
        same &= F.col(own) == F.col(mix_nth)
    return _in_order(rows.join(side, same).select(*docs.columns, position, share), position, share, parts).drop(share)
