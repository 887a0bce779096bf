"""A Merkle tree over the rows of a dataset: digests that prove a row's content and place.

A row is a leaf, the SHA-256 of its fields. The leaves of a group, in the order of their key, are children 0, 1, 2, ... of
nodes of ``ARITY`` children; those of the next level, and so on up to one node, the group's subroot. The subroots, in the
order of the groups, are the leaves of one more tree.

Trees are built by combining by key, as events: a parent's key is (tree, level, index), what has been seen of it is a list
of indexed child digests, and its arity follows from the size of the tree. A child that completes its parent makes that
parent a child in turn, so complete subtrees rise inside a task. Leaves lie range-sorted, and whatever is complete in a range
never leaves it. What stays open, a few parents at both ends of each range, is the frontier: its children are shuffled by
the ancestor three levels further up, where all that can complete it meets, and are combined in the same way, until
nothing is open: a third as many rounds as the tree has levels. A task keeps at most ``OPEN`` open parents, and a shuffled
group has at most ``ARITY`` ** 3 children.

Complete parents are written with their children, which are the reverse links: the siblings on the way from a leaf to the
root are found top-down, a level a join, each row of siblings being joined by at most ``ARITY`` children. A proof is that
way: per level, what stands left and right of the node. It folds a leaf's digest to the root in one expression.

Digests are lowercase hexadecimal text, also where they are hashed again.

Nulls and edge cases: a null field is ``-``; others are their count of UTF-8 bytes, ``:`` and the value, so no two rows
have the same text. A null group is a group of its own and comes first; a null key comes first in its group. Rows that
repeat a key are ordered by their leaves, and equal rows are leaves each. A group of one row is its leaf. Texts are hashed
whole, by Spark's expressions. A table without rows has no root: all results are empty. Column names are those that the
caller gives; leaves carry only group, key and digests.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import partial, reduce
from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import keep, small

ARITY = 16
#: Levels that a frontier rises in one round.
RISE = 3
#: Open parents that a task keeps before it gives the oldest to the frontier.
OPEN = 50_000

CHILD = pa.struct([("slot", pa.int32()), ("digest", pa.string())])
#: A parent: ``children`` by slot, all of them where ``digest`` is given; ``size`` is the tree's number of leaves.
PARENT = "tree string, size long, level int, index long, children array<struct<slot: int, digest: string>>, digest string"


def leaf(fields: Sequence[Column]) -> Column:
    """Digest of a row's fields."""
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame, fields: Sequence[str], group: str, key: str, observed: Mapping[str, Column] | None = None) -> DataFrame:
    """Per row of ``docs``: tree (a name of its group that is not null and sorts as the group does), key, digest, observed.

    observed: what stands in some fields when the row is looked at again; the digest of that goes to ``observed``, in the
    same pass over the texts. Without it ``observed`` is the digest.
    """
    tree = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
    rows = docs.select(tree.alias("tree"), F.col(key).alias("key"), leaf([F.col(f) for f in fields]).alias("digest"), *([leaf([observed.get(f, F.col(f)) for f in fields]).alias("observed")] if observed else []))
    return rows if observed else rows.withColumn("observed", F.col("digest"))


def _numbered(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with ``index``, the place in the tree by ``keys``, and ``size``, the tree's number of rows. Stored in
    range-sorted order; offsets come from one row for each tree and range. Rows that tie are equal, and spread by ``tie``."""
    order = [F.col(k).asc_nulls_first() for k in ("tree", *keys, "tie")]
    ranged = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    placed = keep(ranged.withColumn("row", F.monotonically_increasing_id()), "merkle-sorted")
    part = F.shiftright("row", 33)
    ranges = placed.groupBy("tree", part.alias("part")).agg(F.count("*").alias("held"), F.min("row").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("held").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = keep(ranges.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("held").over(tree).alias("size")), "merkle-ranges")
    side = F.broadcast(ranges) if small(ranges, 256) else ranges
    return placed.withColumn("part", part).join(side, ["tree", "part"]).withColumn("index", F.col("row") + F.col("shift")).drop("row", "part", "shift")


def _combine(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Nodes to parents. A node joins the children that its parent has so far; while that completes the parent, the parent
    is a node in turn. What is still open at the end, or the oldest when too much is, is given away as it stands."""
    pending: dict[tuple[str, int, int], tuple[int, dict[int, str]]] = {}
    out: list[tuple] = []

    def rows() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 6
        out.clear()
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.list_(CHILD), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["tree", "size", "level", "index", "children", "digest"])

    def give(key: tuple[str, int, int], size: int, seen: dict[int, str], digest: str | None) -> None:
        out.append((key[0], size, key[1], key[2], [{"slot": i, "digest": seen[i]} for i in sorted(seen)], digest))

    for batch in batches:
        for tree, size, level, index, digest in zip(*(batch.column(c).to_pylist() for c in ("tree", "size", "level", "index", "digest")), strict=True):
            width = -(-size // ARITY**level)
            while width > 1:
                parent, slot = divmod(index, ARITY)
                key = (tree, level, parent)
                seen = pending.setdefault(key, (size, {}))[1]
                seen[slot] = digest
                if len(seen) < min(ARITY, width - parent * ARITY):
                    break
                del pending[key]
                digest = sha256("".join(seen[i] for i in range(len(seen))).encode()).hexdigest()
                give(key, size, seen, digest)
                level, index, width = level + 1, parent, -(-width // ARITY)
        while len(pending) > most:
            oldest = next(iter(pending))
            give(oldest, *pending.pop(oldest), None)
        yield rows()
    for key, (size, seen) in pending.items():
        give(key, size, seen, None)
    yield rows()


def _grow(nodes: DataFrame, most: int = OPEN) -> DataFrame:
    """All parents over the numbered leaves ``nodes``."""
    events, done, top = nodes.select("tree", "size", F.lit(0).alias("level"), "index", "digest"), [], 0
    while True:
        found = keep(events.mapInArrow(partial(_combine, most=most), PARENT), "merkle-parents")
        done.append(found.where("digest is not null"))
        frontier = found.where("digest is null")
        if frontier.isEmpty():
            return reduce(DataFrame.unionAll, done)
        top += RISE
        children = frontier.select("tree", "size", "level", F.col("index").alias("parent"), F.explode("children").alias("child"))
        children = children.select("tree", "size", "level", (F.col("parent") * ARITY + F.col("child.slot")).alias("index"), F.col("child.digest").alias("digest"))
        # the ancestor where they meet: at ``top``, or the parent of nodes that are there already
        children = children.withColumn("up", F.greatest(F.lit(top), F.col("level") + 1)).withColumn("meet", F.expr(f"index div cast(power({ARITY}, up - level) as bigint)"))
        meet = ["tree", "up", "meet"]
        events = children.repartition(*meet).sortWithinPartitions(*meet, "level", "index").drop("up", "meet")


def _height(nodes: DataFrame) -> int:
    """Levels of parents in the tallest tree."""
    most, height = nodes.agg(F.max("size")).first()[0] or 0, 0
    while most > 1:
        most, height = -(-most // ARITY), height + 1
    return height


def _is_top() -> Column:
    """Whether a parent is the one node of its level."""
    return F.col("size") <= F.pow(F.lit(float(ARITY)), F.col("level") + 1)


def _others(children: Column, slot: Column) -> Column:
    """What stands left and right of a child."""
    joined = lambda of: F.array_join(F.transform(F.filter(children, of), lambda c: c.digest), "")
    return F.struct(joined(lambda c: c.slot < slot).alias("left"), joined(lambda c: c.slot > slot).alias("right"))


def _ways(nodes: DataFrame, parents: DataFrame, above: DataFrame) -> DataFrame:
    """``nodes`` with ``steps``: their siblings level by level, then the steps of their tree, from ``above`` (tree, steps)."""
    here = above.withColumnRenamed("steps", "above")
    tops, rest, down = parents.where(_is_top()).join(here, "tree"), parents.where(~_is_top()), None
    kept = ["tree", "index", "children", "above"]
    for level in reversed(range(_height(nodes))):
        rows = tops.where(F.col("level") == level).select(*kept)
        if down is not None:
            rows = rows.unionByName(rest.where(F.col("level") == level).join(down, ["tree", "index"]).select(*kept))
        each = rows.select("tree", F.col("index").alias("parent"), "above", "children", F.explode("children").alias("child"))
        down = each.select("tree", (F.col("parent") * ARITY + F.col("child.slot")).alias("index"), F.concat(F.array(_others(F.col("children"), F.col("child.slot"))), F.col("above")).alias("above"))
        last = rows
    alone = nodes.where("size = 1").join(here, "tree").withColumnRenamed("above", "steps")
    if down is None:
        return alone
    # leaves meet their parents, which carry the way that all their children share
    at = F.col("index")
    many = nodes.where("size > 1").withColumn("parent", F.expr(f"index div {ARITY}")).join(last.withColumnRenamed("index", "parent"), ["tree", "parent"])
    many = many.withColumn("steps", F.concat(F.array(_others(F.col("children"), at % ARITY)), F.col("above")))
    return many.select(*nodes.columns, "steps").unionByName(alone.select(*nodes.columns, "steps"))


def folded(digest: Column, steps: Column) -> Column:
    """The root that a leaf's digest and its proof give."""
    return F.aggregate(steps, digest, lambda node, s: F.sha2(F.concat(s.left, node, s.right), 256))


def siblings(steps: Column) -> Column:
    """All digests of a proof, joined."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s.left, s.right)), "")


class Manifest(NamedTuple):
    leaves: DataFrame  #: tree, key, digest, observed, index, size
    parents: DataFrame  #: tree, size, level, index, children, digest: the nodes over leaves, with their reverse links
    subroots: DataFrame  #: tree, subroot, root, steps (from the subroot to the root)


def manifest(rows: DataFrame, most: int = OPEN) -> Manifest:
    """Trees over ``leaves``. most: open parents that a task keeps."""
    nodes = _numbered(rows, ["key", "digest", "observed"])
    parents = _grow(nodes, most)
    single = nodes.where("size = 1").select("tree", F.col("digest").alias("subroot"))
    tops = parents.where(_is_top()).select("tree", F.col("digest").alias("subroot")).unionByName(single)
    # one more tree over the subroots
    upper = _numbered(tops.select(F.lit("").alias("tree"), F.col("tree").alias("member"), F.col("subroot").alias("digest")), ["member"])
    joints = _grow(upper, most)
    root = joints.where(_is_top()).select("tree", F.col("digest").alias("root")).unionByName(upper.where("size = 1").select("tree", F.col("digest").alias("root")))
    none = root.select("tree", F.array().cast("array<struct<left: string, right: string>>").alias("steps"))
    ways = _ways(upper, joints, none).join(root, "tree")
    subroots = keep(ways.select(F.col("member").alias("tree"), F.col("digest").alias("subroot"), "root", "steps"), "merkle-subroots")
    return Manifest(nodes, parents, subroots)


def prove(found: Manifest) -> DataFrame:
    """Per leaf: key, digest, observed, subroot, root, and steps (array of left and right siblings, from the leaf up)."""
    subroots = found.subroots
    side = F.broadcast(subroots.drop("steps")) if small(subroots, 400) else subroots.drop("steps")
    return _ways(found.leaves, found.parents, subroots.select("tree", "steps")).join(side, "tree").select("key", "digest", "observed", "subroot", "root", "steps")
