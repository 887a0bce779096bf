"""Who may learn from a row: the fold rule and bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def held_out(doc_id: Column) -> Column:
    """True for the quarter of documents kept for evaluation; a null doc_id is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def sample(rows: DataFrame, group: str, bound: int) -> DataFrame:
    """At most ``bound`` rows of (doc_id, group) for each group, by the smallest digests of their doc_id.

    A group is counted first, and digests beyond four times the share that is needed drop out where they are read: about
    4 * bound rows of a group meet for ranking, however large it is. (That fewer than bound of them are left has, at a
    bound of 1,000, a probability below 1e-300; smaller groups pass whole.)
    """
    digest = F.md5(F.col("doc_id").cast("string").cast("binary"))
    marked = rows.select("doc_id", group, digest.alias("digest"))
    # one row a group, broadcast, so that rows drop out where they are read and not after a shuffle by group
    counts = marked.groupBy(group).agg(F.count("*").alias("held"))
    share = F.conv(F.substring("digest", 1, 8), 16, 10).cast("double") / float(1 << 32)
    near = marked.join(F.broadcast(counts), group).where(share * F.col("held") <= 4 * max(bound, 100))
    order = Window.partitionBy(group).orderBy("digest", "doc_id")
    return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= bound).select("doc_id", group)
