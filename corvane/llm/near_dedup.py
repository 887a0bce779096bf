"""MinHash near-duplicate detection by a signature-coordinate inverted join.

Every class of equal shingle sets is a node with one MinHash signature of ``coordinates`` values. It is posted under each
(coordinate, value) pair, a 64-bit key in which the whole minimum is mixed, so unrelated sets do not meet by chance. Two
sets are candidates when they collide in at least ``matches`` coordinates, so each pair must meet among the
``coordinates - matches + 1`` rarest postings of a set: only this prefix is joined, postings held by one set count towards
the prefix without being stored, and a set with too few shared postings is left out whole.

Collisions are counted where a pair first meets: of the prefix postings that both have, the lowest coordinate owns the
pair, and all others leave it to that one. Members of a posting are counted by merging, coordinate after coordinate, the
posting lists among them; members that the coordinates still to come cannot lift to ``matches`` with any other are
skipped. Pairs whose members are in one component already are left out too. To have few others, each node is first compared with a centre, the member of a posting
that shares the most coordinates, which it meets most often; a posting whose members are in one component is skipped whole.

No group is expanded into all its pairs. A posting's members are compared in blocks of bounded size. Of each block either
the retained pairs leave, at most ``SPARSE`` for each member, or, where more are retained, only a tree that spans them.
Pairs are confirmed on their full sets. What trees connect is a dense group: its full sets are compared in blocks that
count all intersections at once and let only links out. So no link is approximate; a pair at the similarity threshold is
missed only if its signatures agree in fewer than ``matches`` places (at 0.8, 64 and 32: about 1e-8). A word, a shingle and
a set stand as hashes, of 64, 64 and 128 bits.

Work is linear but for dense groups and postings, whose blocks grow with the square of their members that are left after
the centres; memory of a task does not grow.

Nulls and edge cases: null text has no shingles, and a text without words likewise; both are linked with nothing. Fewer
words than a shingle form one shingle of that length, which equals no longer one. Rows that share a doc_id are one
document: its texts are linked with each other. A null doc_id is linked with nothing and is kept. A text is held whole
with its shingles, about 40 bytes for each byte of the longest text. An empty table gives an empty result. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels as K
from .components import components
from .scratch import keep, only_keys, scope, small, unused

#: Nodes on each side of a block, and columns of an incidence matrix that are held at a time.
BLOCK, COLUMNS = 512, 4096
#: Nodes on each side of a block of signatures, pairs that are counted at a time, pairs a member from which a block is dense,
#: and values up to which a block is compared as it stands.
SIGNS, PAIRS, SPARSE, DIRECT = 2048, 1 << 21, 16, 1 << 20
#: Rows of small postings that are compared in one call.
BATCH = 4096
#: Ids of texts that repeat another text's doc_id lie above all doc_ids.
ABOVE = 1 << 62


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Per text, the sorted distinct hashes of its shingles of ``size`` words, A-Z folded."""
    for batch in batches:
        for part in K.slices(batch):
            w = K.words(part.column("text"), fold=K.LOWER)
            g, _ = K.grams(w, size)
            out = []
            for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
                if b - a >= size:
                    out.append(np.unique(g[a : b - size + 1]))
                elif b > a:
                    h = np.uint64(b - a)
                    for x in w.hash[a:b]:
                        h = K.mix(np.array([h * np.uint64(K.BASE) + x], np.uint64))[0]
                    out.append(np.array([h], np.uint64))
                else:
                    out.append(np.zeros(0, np.uint64))
            yield part, out


@K.releasing
def _sign(batches: Iterator[pa.RecordBatch], size: int, coordinates: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Per text its number of shingles, a mark of its set, and one posting key for each coordinate."""
    rng = np.random.default_rng(seed)
    flip = rng.integers(0, 1 << 64, (coordinates, 1), np.uint64)
    times = rng.integers(0, 1 << 64, (coordinates, 1), np.uint64) | np.uint64(1)
    salt = rng.integers(0, 1 << 64, coordinates, np.uint64)
    with np.errstate(over="ignore"):
        for part, sets in _sets(batches, size):
            full = np.array([len(s) > 0 for s in sets], bool)
            keys = np.zeros((int(full.sum()), coordinates), np.uint64)
            for row, s in enumerate(s for s in sets if len(s)):
                least = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
                for i in range(0, len(s), 4096):
                    np.minimum(least, ((s[None, i : i + 4096] ^ flip) * times).min(1), out=least)
                # minima crowd near 0; mixed, they are spread over all 64 bits
                keys[row] = K.mix(least ^ salt)
            marks = pa.array([blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary())
            ends = np.concatenate([[0], np.cumsum(full * coordinates)])
            signs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.view(np.int64).reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), marks, signs], ["doc_id", "n_shingles", "mark", "sign"])


@K.releasing
def _shingles(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for part, sets in _sets(batches, size):
        marks = [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        ends = np.cumsum([0, *map(len, sets)])
        flat = pa.array(np.concatenate(sets).view(np.int64))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(marks, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["doc_id", "mark", "shingles"])


def _full_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, size: int, name: str) -> DataFrame:
    """Shingles of the nodes in ``wanted`` (node): node, shingles."""
    ends = wanted.select("node").distinct().join(nodes, "node").select("node", F.col("doc").alias("doc_id"), "mark")
    ends = keep(ends, f"{name}-ends")
    texts = only_keys(docs.select(F.col("doc_id").cast("long"), "text"), ends, ["doc_id"])
    # a row that shares a node's doc_id but not its text has another mark
    sets = texts.mapInArrow(partial(_shingles, size=size), "doc_id long, mark binary, shingles array<long>").join(F.broadcast(ends) if small(ends) else ends, ["doc_id", "mark"])
    return keep(sets.select("node", "shingles"), f"{name}-sets")


def _colliding(nodes: DataFrame, pairs: DataFrame, matches: int, name: str) -> DataFrame:
    """Of pairs (a, b), those whose signatures agree in enough coordinates."""
    sign = lambda x: nodes.select(F.col("node").alias(x), F.col("sign").alias(f"sign_{x}"))
    met = pairs.join(sign("a"), "a").join(sign("b"), "b")
    return keep(met.where(F.size(F.array_intersect("sign_a", "sign_b")) >= matches).select("a", "b"), f"{name}-near")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets are similar enough."""
    part = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s_{x}"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    return pairs.join(part("a"), "a").join(part("b"), "b").where(100 * both >= percent * (F.size("s_a") + F.size("s_b") - both)).select("a", "b").distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


def _mixed(prefix: DataFrame, found: DataFrame | None, name: str) -> DataFrame:
    """Postings whose members are in more than one component so far: posting, node, home."""
    if found is not None:
        prefix = keep(prefix.join(found, prefix.node == found.member, "left").select("posting", "node", F.coalesce("component", "node").alias("home")), f"{name}-placed")
    # kept first, so that few postings are broadcast and a common one's rows stay where they are
    mixed = keep(prefix.groupBy("posting").agg(F.min("home").alias("low"), F.max("home").alias("high")).where("low < high").select("posting"), f"{name}-postings")
    return keep(only_keys(prefix, mixed, ["posting"]), f"{name}-mixed")


def _tree(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a graph of pairs: each member, and the smallest member that it is connected with."""
    members, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(members))
    while True:
        least = root.copy()
        np.minimum.at(least, x, root[y])
        np.minimum.at(least, y, root[x])
        np.minimum.at(least, root, least)
        least = least[least]
        if (least == root).all():
            return members, members[root]
        root = least


def _merge(count: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Adds 1 for each pair of members that are posted under one value: the lists of a coordinate, merged by value."""
    order = np.argsort(right, kind="stable")
    low, high = (np.searchsorted(right[order], left, side) for side in ("left", "right"))
    held = high - low
    if 16 * held.sum() > count.size:  # long lists: as a product
        count += left[:, None] == right[None]
        return
    x = np.repeat(np.arange(len(left)), held)
    y = order[np.arange(len(x)) - np.repeat(np.cumsum(held) - held - low, held)]
    count[x, y] += 1


def _collisions(a: np.ndarray, b: np.ndarray, sign: np.ndarray, matches: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of ``a`` and ``b`` whose signatures agree in ``matches`` coordinates or more.

    Coordinate after coordinate, the posting lists of both sides are merged and collisions counted. Once the coordinates that
    are left cannot lift every pair to the threshold, members that are in reach of none are skipped.
    """
    n = sign.shape[1]
    if len(a) * len(b) * n <= DIRECT:
        x, y = np.nonzero(np.count_nonzero(sign[a][:, None] == sign[b][None], axis=2) >= matches)
        return a[x], b[y]
    count = np.zeros((len(a), len(b)), np.uint8)
    for c in range(n):
        if c > n - matches:
            reach = count >= matches - (n - c)
            rows, columns = reach.any(1), reach.any(0)
            if not rows.any():
                return a[:0], b[:0]
            if 2 * rows.sum() * columns.sum() < count.size:
                a, b, count = a[rows], b[columns], count[np.ix_(rows, columns)]
        _merge(count, sign[a, c], sign[b, c])
    x, y = np.nonzero(count >= matches)
    return a[x], b[y]


def _retained(a: np.ndarray, b: np.ndarray, rows: dict[str, np.ndarray], matches: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of left rows ``a`` and right rows ``b`` that this posting owns and whose signatures collide often enough."""
    node, home, main, sign, prefix = (rows[x] for x in ("node", "home", "main", "sign", "prefix"))
    own = rows["coordinate"][a[0]]
    out = []
    step = max(1, PAIRS // len(b))
    for i in range(0, len(a), step):
        x, y = _collisions(a[i : i + step], b, sign, matches)
        # in one component already, or met from the other side
        new = (home[x] != home[y]) & ((home[y] == main[y]) | (node[x] < node[y]))
        x, y = x[new], y[new]
        # skipped where a lower coordinate of both prefixes has the pair
        below = prefix[x] & prefix[y] & np.uint64((1 << int(own)) - 1)
        for c in np.flatnonzero([(int(np.bitwise_or.reduce(below)) >> c) & 1 for c in range(int(own))]) if len(below) else []:
            meets = ((below >> np.uint64(c)) & np.uint64(1)).astype(bool) & (sign[x, c] == sign[y, c])
            x, y, below = x[~meets], y[~meets], below[~meets]
        out.append((node[x], node[y]))
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def _count(table: pa.Table, matches: int, sparse: int) -> pa.Table:
    """Retained pairs (a, b) of the postings in ``table``, or, of dense postings, a tree of them."""
    table = table.combine_chunks()
    rows = {c: table.column(c).to_numpy() for c in ("posting", "node", "home", "main", "is_left", "whole", "coordinate")}
    rows["prefix"] = table.column("prefix").to_numpy().view(np.uint64)
    rows["sign"] = table.column("sign").combine_chunks().flatten().to_numpy().reshape(len(table), -1)
    order = np.argsort(rows["posting"], kind="stable")
    parts: list[tuple] = []
    for own in np.split(order, np.flatnonzero(np.diff(rows["posting"][order])) + 1):
        left = rows["is_left"][own]
        a, b = own[left], own if rows["whole"][own[0]] else own[~left]
        if not len(a) or not len(b):
            continue
        x, y = _retained(a, b, rows, matches)
        dense = len(x) > sparse * (len(a) + len(b))
        if dense:
            x, y = _tree(x, y)
            x, y = x[x != y], y[x != y]
        parts.append((np.minimum(x, y), np.maximum(x, y), np.full(len(x), dense)))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("dense", pa.bool_())])
    return pa.table([np.concatenate(c) for c in zip(*parts, strict=True)], schema=schema) if parts else schema.empty_table()


def _sides(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Adds to rows (key, node, home) what their key's members are dealt by: main (its largest home), n, n_left (blocks of
    members outside it) and n_right (blocks of all)."""
    counts = rows.groupBy(key, "home").agg(F.count("*").alias("held")).groupBy(key).agg(F.max_by("home", F.struct("held", "home")).alias("main"), F.sum("held").alias("n"), F.max("held").alias("n_main"))
    blocks = lambda n: F.ceil(n / size).cast("int")
    return rows.join(counts, key).withColumns({"n_right": blocks(F.col("n")), "n_left": blocks(F.col("n") - F.col("n_main"))})


def _dealt(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Left and right copies of rows, for blocks (i, j): each member outside the main home meets all members once."""
    at = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.where("home <> main").select(*fields, F.lit(True).alias("is_left"), at("n_left").alias("i"), every("n_right").alias("j"))
    right = rows.where("n_left > 0").select(*fields, F.lit(False).alias("is_left"), every("n_left").alias("i"), at("n_right").alias("j"))
    return left.unionByName(right)


def _counted(mixed: DataFrame, nodes: DataFrame, matches: int) -> DataFrame:
    """Candidates among nodes of different homes that share a prefix posting: a, b, dense."""
    members = mixed.groupBy("node").agg(F.min("home").alias("home"), F.collect_list("posting").alias("postings"))
    place = "cast(array_position(sign, x) - 1 as int)"
    members = members.join(nodes.select("node", "sign"), "node").selectExpr(
        "node",
        "home",
        "sign",
        f"aggregate(postings, 0L, (m, x) -> m | shiftleft(1L, {place})) AS prefix",
        f"explode(transform(postings, x -> struct(x AS posting, {place} AS coordinate))) AS p",
    )
    rows = _sides(members.select("p.posting", "p.coordinate", "node", "home", "sign", "prefix"), "posting", SIGNS)
    rows = keep(rows.where("n_left > 0"), "near-members")
    fields = ["posting", "coordinate", "node", "home", "main", "sign", "prefix"]
    buckets = rows.count() // BATCH + 1
    small_ones = rows.where("n_right = 1").select(*fields, (F.col("home") != F.col("main")).alias("is_left"), F.lit(True).alias("whole"), F.pmod(F.xxhash64("posting"), F.lit(buckets)).alias("bucket"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    large = _dealt(rows.where("n_right > 1"), fields).withColumns({"whole": F.lit(False), "bucket": F.col("posting")})

    sparse = SPARSE

    def count(table: pa.Table) -> pa.Table:
        try:
            return _count(table, matches, sparse)
        finally:
            K.release()

    return small_ones.unionByName(large).groupBy("bucket", "i", "j").applyInArrow(count, "a long, b long, dense boolean")


def _block(table: pa.Table, percent: int) -> pa.Table:
    """Links between the left and the right nodes of a block: intersections by a product of incidence matrices."""
    table = table.combine_chunks()
    node, home, left, main = (table.column(c).to_numpy() for c in ("node", "home", "is_left", "main"))
    lists = table.column("shingles").combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    unique, index, held = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(node)), size)
    shared = held[index] > 1
    row, index = row[shared], np.unique(index[shared], return_inverse=True)[1]
    order = np.argsort(index, kind="stable")
    row, index = row[order], index[order]
    a, b = np.flatnonzero(left), np.flatnonzero(~left)
    place = np.zeros(len(node), np.int64)
    place[a], place[b] = np.arange(len(a)), np.arange(len(b))
    both = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, int(index[-1]) + 1 if len(index) else 0, COLUMNS):
        i, j = np.searchsorted(index, [lo, lo + COLUMNS])
        part, column, of_left = row[i:j], index[i:j] - lo, left[row[i:j]]
        x, y = np.zeros((len(a), COLUMNS), np.float32), np.zeros((len(b), COLUMNS), np.float32)
        x[place[part[of_left]], column[of_left]] = 1
        y[place[part[~of_left]], column[~of_left]] = 1
        both += x @ y.T
    near = 100 * both >= percent * (size[a][:, None] + size[b][None] - both)
    near &= (home[a][:, None] != home[b][None]) & ((home[b] == main[b])[None] | (node[a][:, None] < node[b][None]))
    x, y = np.nonzero(near)
    x, y = node[a[x]], node[b[y]]
    return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _linked_in_blocks(trees: DataFrame, homes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different homes inside each dense group: what ``trees`` (a, b) connect.

    Of a group the nodes outside its largest home stand against all; large groups are cut into blocks on both sides, so a
    task never holds more than two blocks, and only links leave it.
    """
    groups = components(trees, "a", "b").withColumnRenamed("component", "group")
    rows = keep(homes.join(groups, homes.node == groups.member).select("group", "node", "home"), "near-groups")
    rows = _sides(rows, "group", BLOCK).join(sets, "node")

    def block(table: pa.Table) -> pa.Table:
        try:
            return _block(table, percent)
        finally:
            K.release()

    return _dealt(rows, ["group", "node", "home", "main", "shingles"]).groupBy("group", "i", "j").applyInArrow(block, "a long, b long")


def _nodes(signed: DataFrame) -> DataFrame:
    """One row for each set: mark, node (its smallest doc_id), doc (a row to read it from), sign, n; ids of further texts
    of a document lie above all doc_ids."""
    nodes = keep(signed.groupBy("mark").agg(F.min("doc_id").alias("node"), F.min("sign").alias("sign"), F.min("n_shingles").alias("n")).withColumn("doc", F.col("node")), "near-nodes")
    if nodes.groupBy("node").agg(F.count("*").alias("texts")).where("texts > 1").isEmpty():
        return nodes
    again = F.row_number().over(Window.partitionBy("doc").orderBy("mark")) > 1
    return keep(nodes.withColumn("node", F.when(again, F.lit(ABOVE) + F.xxhash64("mark").bitwiseAND(F.lit(ABOVE - 1))).otherwise(F.col("node"))), "near-nodes-apart")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, coordinates: int = 64, matches: int = 32, seed: int = 1) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept.

    size: words in a shingle. percent: least 100 * intersection / union. coordinates, matches: see the module.
    """
    if not 0 < matches <= coordinates <= 64:
        raise ValueError("at most 64 coordinates, and no more matches than these")
    signed = keep(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(partial(_sign, size=size, coordinates=coordinates, seed=seed), "doc_id long, n_shingles long, mark binary, sign array<long>"), "near-signed")
    known = signed.where("doc_id is not null and mark is not null")
    nodes = _nodes(known)

    posted = nodes.select(F.explode("sign").alias("posting"), "node")
    shared = posted.groupBy("posting").agg(F.count("*").alias("held")).where("held > 1")
    ranked = posted.join(shared, "posting").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("held", "posting"))).alias("postings"), F.count("*").alias("has"))
    # of the coordinates - matches + 1 rarest postings, those that are held by one set are not stored
    prefix = ranked.where(F.col("has") >= matches).select("node", "has", F.explode(F.slice("postings", F.lit(1), F.col("has").cast("int") - (matches - 1))).alias("p"))
    prefix = keep(prefix.select("p.posting", "node", "has"), "near-prefix")

    # each node with a centre: of its postings' members with the most shared coordinates, the one that it meets most often
    centres = prefix.groupBy("posting").agg(F.max_by("node", F.struct("has", -F.col("node"))).alias("a"), F.count("*").alias("members")).where("members > 1").select("posting", "a")
    centres = keep(centres, "near-centres")
    met = prefix.join(F.broadcast(centres) if small(centres) else centres, "posting").where("node <> a").groupBy("node", "a").agg(F.count("*").alias("times"))
    first = met.groupBy(F.col("node").alias("b")).agg(F.max_by("a", F.struct("times", -F.col("a"))).alias("a")).select("a", "b")
    near = _colliding(nodes, first, matches, "near-first")
    links = keep(_confirmed(near, _full_sets(docs, nodes, _ends(near), size, "near-first"), percent), "near-links")

    # what is left: members outside the largest component of a posting, and members of other components
    stars = components(links, "a", "b")
    mixed = _mixed(prefix, stars, "near")
    sets = _full_sets(docs, nodes, mixed, size, "near-mixed")
    # shingles that no other of these nodes has cannot be shared
    alone = sets.select("node", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("last")).where("node = last").groupBy("node").agg(F.count("*").alias("alone"))
    bound = keep(sets.select("node", F.size("shingles").alias("n")).join(alone, "node", "left").select("node", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("most")).where(f"100 * most >= {percent} * n").select("node").distinct(), "near-bound")
    mixed = _mixed(mixed.join(bound, "node").select("posting", "node", "home"), None, "near-bounded")
    candidates = keep(_counted(mixed, nodes, matches), "near-candidates")
    more = _confirmed(candidates.where("not dense").select("a", "b"), sets, percent)
    trees = candidates.where("dense").select("a", "b")
    if not trees.isEmpty():
        more = more.unionByName(_linked_in_blocks(trees, mixed.select("node", "home").distinct(), sets, percent))
    more = keep(more, "near-more")

    # texts of one document are one; what is connected already enters as stars
    joined = stars.select(F.col("member").alias("a"), F.col("component").alias("b")).unionByName(more).unionByName(nodes.where("node <> doc").select(F.col("doc").alias("a"), F.col("node").alias("b")))
    found = components(joined, "a", "b")
    classes = nodes.select("mark", "node").join(found, F.col("node") == F.col("member"), "left").select("mark", F.coalesce("component", "node").alias("component"))
    placed = signed.drop("sign").join(classes, "mark", "left")
    least = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return placed.select("doc_id", "n_shingles", least.alias("component_id"), F.coalesce(F.col("doc_id") == least, F.lit(True)).alias("kept"))


def representatives(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, one document for each component, with all their columns."""
    (gone_id,) = unused(docs, "gone_id")
    with scope(docs.sparkSession):
        gone = keep(near_duplicates(docs, **options).where("not kept").select(F.col("doc_id").alias(gone_id)).distinct(), "near-gone", outside=True)
    return docs.join(F.broadcast(gone) if small(gone) else gone, F.col("doc_id").cast("long") == F.col(gone_id), "left_anti")
