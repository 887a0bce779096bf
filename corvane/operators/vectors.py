"""Vectors: exact top-k, neighbours over a threshold, greedy diverse selection, cells for approximate search."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stored

#: Bytes that one pass keeps in every worker: query vectors, and the best of each query so far. More queries take more passes.
PASS_BYTES = 64 << 20
#: Queries and corpus rows whose scores a worker holds at once.
TILE_QUERIES, TILE_ROWS = 512, 2048
#: Up to this k a partition keeps the best of each query; beyond it, it sends all its pairs to the final ranking.
MOST_KEPT = 8192


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """Unit length; the zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.values if isinstance(column, pa.ListArray) else column.combine_chunks().values
    return values.slice(column.offsets[0].as_py(), column.offsets[len(column)].as_py() - column.offsets[0].as_py()).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class Scorer:
    """Scores of tiles of queries with tiles of rows."""

    def __init__(self, queries: np.ndarray, metric: str = "inner"):
        self.queries, self.metric = queries, metric
        self.square = (queries**2).sum(1)

    def tile(self, at: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the queries ``at`` with the rows ``m`` by a product of matrices, whose last digits depend on where a
        row stands; and, a query, how far they may lie from the exact ones."""
        score, square = self.queries[at] @ m.T, (m**2).sum(1)
        size = np.sqrt(self.square[at]) + np.sqrt(square.max())
        if self.metric == "euclidean":
            score *= -2
            score += self.square[at][:, None]
            score += square[None]
            np.negative(score, out=score)
        return score, 8 * (m.shape[1] + 4) * np.finfo(np.float64).eps * size**2

    def exact(self, row: np.ndarray, m: np.ndarray, col: np.ndarray) -> np.ndarray:
        """Scores of pairs, each summed in the order of the dimensions: equal vectors have equal scores."""
        out = np.zeros(len(row))
        for x, y in zip(self.queries.T, m.T, strict=True):
            a, b = x[row], y[col]
            out += a * b if self.metric == "inner" else -((a - b) ** 2)
        return out


class Best:
    """The best k rows seen so far for each of some queries; ties by id, and NaN before any number, as in SQL."""

    def __init__(self, scorer: Scorer, k: int):
        n = len(scorer.queries)
        self.scorer, self.k = scorer, k
        self.ids, self.scores = np.empty((n, k), np.int64), np.empty((n, k))
        self.kept, self.cut = np.zeros(n, np.int64), np.full(n, -np.inf)

    def add(self, docs: np.ndarray, m: np.ndarray, at: np.ndarray | None = None) -> None:
        """Rows seen by all queries, or by the queries ``at``."""
        at = np.arange(len(self.kept)) if at is None else at
        for j in range(0, len(m) if self.k else 0, TILE_ROWS):
            for i in range(0, len(at), TILE_QUERIES):
                self._tile(at[i : i + TILE_QUERIES], docs[j : j + TILE_ROWS], m[j : j + TILE_ROWS])

    def _tile(self, at: np.ndarray, docs: np.ndarray, m: np.ndarray) -> None:
        score, slack = self.scorer.tile(at, m)
        # not below the cut, rather than above it: NaN stays
        passed = ~(score < (self.cut[at] - slack)[:, None])
        if score.shape[1] > self.k and passed.sum() > 2 * self.k * len(at):
            lowest = np.partition(score, score.shape[1] - self.k, axis=1)[:, score.shape[1] - self.k] - 2 * slack
            passed &= ~(score < lowest[:, None])
        row, col = np.divmod(np.flatnonzero(passed), passed.shape[1])
        if not len(row):
            return
        value = self.scorer.exact(at[row], m, col)
        # with what these queries have
        had = at[np.unique(row)]
        old = np.repeat(had, self.kept[had])
        place = np.arange(len(old)) - np.repeat(np.cumsum(self.kept[had]) - self.kept[had], self.kept[had])
        query, ids, value = np.concatenate([old, at[row]]), np.concatenate([self.ids[old, place], docs[col]]), np.concatenate([self.scores[old, place], value])
        order = np.lexsort((ids, -value, ~np.isnan(value), query))
        query, ids, value = query[order], ids[order], value[order]
        begin = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        size = np.diff(np.r_[begin, len(query)])
        place = np.arange(len(query)) - np.repeat(begin, size)
        good = place < self.k
        self.ids[query[good], place[good]], self.scores[query[good], place[good]] = ids[good], value[good]
        seen = query[begin]
        self.kept[seen] = np.minimum(size, self.k)
        full = seen[self.kept[seen] == self.k]
        last = self.scores[full, self.k - 1]
        self.cut[full] = np.where(np.isnan(last), np.inf, last)

    def batches(self, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        """What is kept, for queries of these ids, some queries at a time."""
        step = max(1, TILE_QUERIES * TILE_ROWS // max(1, self.k))
        for i in range(0, len(ids), step):
            kept = self.kept[i : i + step]
            have = np.arange(self.k)[None] < kept[:, None]
            if have.any():
                yield _pairs(np.repeat(ids[i : i + step], kept), self.ids[i : i + step][have], self.scores[i : i + step][have])


def _pairs(queries: np.ndarray, docs: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(queries), pa.array(docs), pa.array(scores)], ["query_id", "doc_id", "score"])


def _score_block(batches: Iterator[pa.RecordBatch], sent, k: int, metric: str) -> Iterator[pa.RecordBatch]:
    """The best k of a partition for each query of the block."""
    ids, queries = sent.value
    best = Best(Scorer(queries, metric), k)
    for batch in batches:
        if batch.num_rows:
            best.add(batch.column("doc_id").to_numpy(), _matrix(batch.column("embedding")))
    yield from best.batches(ids)


def _all_block(batches: Iterator[pa.RecordBatch], sent, metric: str) -> Iterator[pa.RecordBatch]:
    """All pairs of a partition with the queries of the block, a tile at a time."""
    ids, queries = sent.value
    scorer = Scorer(queries, metric)
    for batch in batches:
        docs, m = batch.column("doc_id").to_numpy(), _matrix(batch.column("embedding")) if batch.num_rows else np.zeros((0, 1))
        for j in range(0, len(m), TILE_ROWS):
            for i in range(0, len(ids), TILE_QUERIES):
                part, some = np.arange(i, min(i + TILE_QUERIES, len(ids))), docs[j : j + TILE_ROWS]
                row, col = np.repeat(part, len(some)), np.tile(np.arange(len(some)), len(part))
                yield _pairs(ids[row], some[col], scorer.exact(row, m[j : j + TILE_ROWS], col))


def _total_block(batches: Iterator[pa.RecordBatch], sent, metric: str) -> Iterator[pa.RecordBatch]:
    """Per query of the block: a partition's pairs, their best score and the sum of their scores."""
    ids, queries = sent.value
    scorer, n, best, total = Scorer(queries, metric), 0, np.full(len(ids), -np.inf), np.zeros(len(ids))
    for batch in batches:
        m = _matrix(batch.column("embedding")) if batch.num_rows else np.zeros((0, 1))
        n += len(m)
        for j in range(0, len(m), TILE_ROWS):
            for i in range(0, len(ids), TILE_QUERIES):
                at = np.arange(i, min(i + TILE_QUERIES, len(ids)))
                score, _ = scorer.tile(at, m[j : j + TILE_ROWS])
                best[at], total[at] = np.maximum(best[at], score.max(1)), total[at] + score.sum(1)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), n)), pa.array(best), pa.array(total)], ["query_id", "n", "best", "total"])


def dense_top_k(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "inner") -> DataFrame:
    """Per query the k best documents: query_id, doc_id, score, rank; ties by doc_id.

    queries: query_id, embedding, a stated set, taken in blocks of bounded size. corpus: doc_id, embedding, read once a
    block; a partition sends at most k rows a query to the final ranking. A worker holds a block, its best k, and the
    scores of one tile, however many queries and rows there are. metric: ``inner``, or ``euclidean`` for minus the squared
    distance.
    """
    if k <= MOST_KEPT:
        found = _by_block(queries, corpus, partial(_score_block, k=k, metric=metric), _PAIR, 16 * k)
    else:
        found = all_pairs(queries, corpus, metric)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


_PAIR = "query_id long, doc_id long, score double"


def all_pairs(queries: DataFrame, corpus: DataFrame, metric: str = "inner") -> DataFrame:
    """The score of each query with each document: query_id, doc_id, score. Tiles of pairs leave a worker as they are
    scored; as many rows as there are pairs."""
    return _by_block(queries, corpus, partial(_all_block, metric=metric), _PAIR)


def pair_totals(queries: DataFrame, corpus: DataFrame, metric: str = "inner") -> DataFrame:
    """Per query, over its pairs with all documents: query_id, n, best and mean score. Each pair is scored, and summed up
    where it is scored: a partition sends one row a query."""
    rows = _by_block(queries, corpus, partial(_total_block, metric=metric), "query_id long, n long, best double, total double")
    return rows.groupBy("query_id").agg(F.sum("n").alias("n"), F.max("best").alias("best"), (F.sum("total") / F.sum("n")).alias("mean"))


def _by_block(queries: DataFrame, corpus: DataFrame, score, schema: str, state: int = 0) -> DataFrame:
    """What ``score`` finds in each partition of the corpus for each block of queries. state: bytes that it keeps a query.

    The corpus is dealt to as many tasks as can run: the work is in the pairs, and a file of few bytes, or of one row
    group, is one task of a scan. Blocks share what was dealt.
    """
    spark = queries.sparkSession
    head = queries.select(F.size("embedding").alias("n")).first()
    corpus = corpus.select(F.col("doc_id").cast("long"), "embedding").repartition(spark.sparkContext.defaultParallelism)
    parts = []
    if head is not None:
        rows = max(1, PASS_BYTES // (8 * max(1, head.n) + state))
        blocks = max(1, -(-queries.count() // rows))
        for b in range(blocks):
            block = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
            got = block.select(F.col("query_id").cast("long"), "embedding").toArrow().combine_chunks()
            if got.num_rows:
                sent = spark.sparkContext.broadcast((got.column("query_id").to_numpy(), _matrix(got.column("embedding").combine_chunks())))
                parts.append(corpus.mapInArrow(partial(score, sent=sent), schema))
    found = parts[0] if parts else spark.createDataFrame([], schema)
    for p in parts[1:]:
        found = found.union(p)
    return found


def origin_scores(queries: DataFrame, corpus: DataFrame, origins: DataFrame) -> DataFrame:
    """Scores of queries with their own documents, also those outside any top-k. origins: query_id, doc_id."""
    rows = origins.join(queries.withColumnRenamed("embedding", "_q"), "query_id").join(corpus, "doc_id")
    return rows.select("query_id", "doc_id", dot(F.col("_q"), F.col("embedding")).alias("pos_score"))


#: Cells of a similarity join, and rows that a cell stands for at least. Rows and bytes, as doubles, of a block, two of which a
#: worker holds; rows on each side of a tile, of which it holds one set of scores; pairs that leave a worker together, or a tile's.
CELLS, CELL_ROWS, BLOCK_ROWS, BLOCK_BYTES, JOIN_TILE, SENT_PAIRS = 1024, 2048, 1 << 17, 32 << 20, 1024, 1 << 16


def _gaps(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of rows from centres."""
    return np.sqrt(np.maximum((m**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * m @ centres.T, 0.0))


def _extents(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """Per tile of rows and cell: rows, the largest distance from the centre, and the largest length."""
    for batch in batches:
        for k in range(0, batch.num_rows, TILE_ROWS):
            m = _matrix(batch.column("embedding").slice(k, TILE_ROWS))
            gap = _gaps(m, sent.value)
            home = gap.argmin(1)
            cells = np.unique(home)
            far = [gap[home == c, c].max() for c in cells]
            length = [np.sqrt((m[home == c] ** 2).sum(1).max()) for c in cells]
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array([int((home == c).sum()) for c in cells]), pa.array(far, pa.float64()), pa.array(length, pa.float64())], ["cell", "rows", "radius", "length"])


def _open(centres: np.ndarray, radius: np.ndarray, length: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of cells may hold partners; those with NaN may."""
    # x.y > t means |x - y|^2 < |x|^2 + |y|^2 - 2t, and |x - y| is at least the gap of the centres less both radii
    reach = (length**2)[:, None] + (length**2)[None] - 2 * threshold
    size = length + np.sqrt((centres**2).sum(1))
    slack = 1e-6 * (size[:, None] + size[None])
    return ~(reach < -(slack**2)) & ~(_gaps(centres, centres) > radius[:, None] + radius[None] + np.sqrt(np.maximum(reach, 0)) + slack)


def _blocks(rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """Per cell its first block and how many it has, and the cells of each block: whole cells together, or a part of one."""
    first, pieces, blocks, room = np.zeros(len(rows), np.int64), np.ones(len(rows), np.int64), [], 0
    for c, n in enumerate(rows):
        if n > most:
            first[c], pieces[c], room = len(blocks), -(-n // most), 0
            blocks += [[c] for _ in range(pieces[c])]
        elif n:
            if room < n:
                blocks.append([])
                room = most
            first[c], room = len(blocks) - 1, room - n
            blocks[-1].append(c)
    return first, pieces, blocks


def _deal(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """Each row to its own block, and to each pair of that with a block in which a partner may be."""
    centres, first, pieces, near = sent.value
    for batch in batches:
        for k in range(0, batch.num_rows, TILE_ROWS):
            part = batch.slice(k, TILE_ROWS)
            home = _gaps(_matrix(part.column("embedding")), centres).argmin(1)
            mixed = part.column("doc_id").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            own = first[home] + (mixed % pieces[home].astype(np.uint64)).astype(np.int64)
            for other in range(near.shape[1]):
                at = np.flatnonzero(near[home, other] | (own == other))
                if len(at):
                    x = own[at]
                    data = part.select(["doc_id", "embedding"]).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, other)), pa.array(np.maximum(x, other)), pa.array(x <= other), pa.array(home[at]), *data.columns], ["i", "j", "is_left", "cell", "doc_id", "embedding"])


def _over(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows over the threshold, and their scores; NaN is over it, as in SQL. What lies so near the threshold that the
    order of summation could decide is summed in the order of the dimensions."""
    score = a @ b.T
    square = [x[np.isfinite(x)].max(initial=0) for x in ((a**2).sum(1), (b**2).sum(1))]
    slack = 8 * (a.shape[1] + 4) * np.finfo(np.float64).eps * np.sqrt(square[0] * square[1])
    row, col = np.divmod(np.flatnonzero(~(score <= threshold - slack)), max(1, len(b)))
    value = score[row, col]
    close = np.flatnonzero(np.abs(value - threshold) <= slack)
    if len(close):
        value[close] = Scorer(a).exact(row[close], b, col[close])
        good = ~(value <= threshold)
        row, col, value = row[good], col[good], value[good]
    return row, col, value


class _Side:
    """Rows of a block, in tiles that lie in one cell each."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        cell, ids, m = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        order = np.argsort(cell, kind="stable")
        self.ids, self.m, cell = ids[order], m[order], cell[order]
        edges = np.r_[np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]), len(cell)]
        self.tiles = [(cell[x], slice(k, min(k + JOIN_TILE, y))) for x, y in zip(edges[:-1], edges[1:], strict=True) for k in range(x, y, JOIN_TILE)]


def _pairs_over(batches: Iterator[pa.RecordBatch], threshold: float, near: np.ndarray) -> Iterator[tuple]:
    """Of one pair of blocks: both sides, and the pairs of their rows over the threshold, a tile at a time."""
    parts: dict[bool, list] = {True: [], False: []}
    alone = False
    for batch in batches:
        if batch.num_rows:
            alone = batch.column("i")[0] == batch.column("j")[0]
            cell, left, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "is_left", "doc_id"))
            values = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for side in (True, False):
                if (left == side).any():
                    parts[side].append((cell[left == side], ids[left == side], values[left == side]))
    if not parts[True] or not (alone or parts[False]):
        return
    a = _Side(parts[True])
    b = a if alone else _Side(parts[False])
    for k, (c, x) in enumerate(a.tiles):
        m = a.m[x].astype(np.float64)
        for d, y in b.tiles[k if alone else 0 :]:
            if near[c, d]:
                row, col, value = _over(m, b.m[y].astype(np.float64), threshold)
                row, col = row + x.start, col + y.start
                good = a.ids[row] != b.ids[col]
                if alone:
                    good &= row < col
                if good.any():
                    yield a, b, row[good], col[good], value[good]


def _join(corpus: DataFrame, threshold: float, cells: int | None, found, schema: str) -> DataFrame:
    """What ``found``, given the batches of a pair of blocks and the open pairs of cells, makes of each pair of blocks."""
    spark = corpus.sparkSession
    kind = "array<float>" if corpus.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = corpus.select(F.col("doc_id").cast("long"), F.col("embedding").cast(kind).alias("embedding")).where("doc_id is not null and embedding is not null")
    total, tasks = rows.count(), spark.sparkContext.defaultParallelism
    picked = rows.orderBy(priority(42), "doc_id").limit(max(1, cells or min(CELLS, -(-total // CELL_ROWS)))).select("embedding").toArrow().combine_chunks()
    if not picked.num_rows:
        return spark.createDataFrame([], schema)
    centres = np.unique(_matrix(picked.column("embedding").combine_chunks()), axis=0)
    rows = rows.repartition(tasks)
    extents = rows.mapInArrow(partial(_extents, sent=spark.sparkContext.broadcast(centres)), "cell long, rows long, radius double, length double")
    count, radius, length = np.zeros(len(centres), np.int64), np.zeros(len(centres)), np.zeros(len(centres))
    for r in extents.groupBy("cell").agg(F.sum("rows").alias("rows"), F.max("radius").alias("radius"), F.max("length").alias("length")).collect():  # one row a cell
        count[r.cell], radius[r.cell], length[r.cell] = r.rows, r.radius, r.length
    near = _open(centres, radius, length, threshold)
    # as few as fit a worker, but pairs of blocks for all tasks
    most = min(BLOCK_ROWS, max(1, BLOCK_BYTES // (8 * max(1, centres.shape[1]))), max(CELL_ROWS, -(-total // int(np.ceil(np.sqrt(8 * tasks))))))
    first, pieces, blocks = _blocks(count, most)
    to = np.stack([near[:, c].any(1) for c in blocks], 1)
    dealt = rows.mapInArrow(partial(_deal, sent=spark.sparkContext.broadcast((centres, first, pieces, to))), f"i long, j long, is_left boolean, cell long, doc_id long, embedding {kind}")
    sent = spark.sparkContext.broadcast(near)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return found(batches, threshold, sent.value)

    return dealt.groupBy("i", "j").applyInArrow(run, schema)


def _found_pairs(batches: Iterator[pa.RecordBatch], threshold: float, near: np.ndarray) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def sent() -> pa.RecordBatch:
        x, y, score = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(score)], ["a", "b", "score"])

    for a, b, row, col, value in _pairs_over(batches, threshold, near):
        held.append((a.ids[row], b.ids[col], value))
        size += len(row)
        if size >= SENT_PAIRS:
            yield sent()
            size = 0
    if held:
        yield sent()


def _found_counts(batches: Iterator[pa.RecordBatch], threshold: float, near: np.ndarray) -> Iterator[pa.RecordBatch]:
    counts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for a, b, row, col, _ in _pairs_over(batches, threshold, near):
        for side, at in ((a, row), (b, col)):
            n = counts.setdefault(id(side), (side.ids, np.zeros(len(side.ids), np.int64)))[1]
            low = at.min()
            some = np.bincount(at - low)
            n[low : low + len(some)] += some
    for ids, n in counts.values():
        yield pa.RecordBatch.from_arrays([pa.array(ids[n > 0]), pa.array(n[n > 0])], ["doc_id", "n"])


def neighbours(corpus: DataFrame, threshold: float, cells: int | None = None) -> DataFrame:
    """Pairs a < b with inner product over the threshold, exactly: a, b, score.

    Rows fall to the nearest of some centres, and cells to blocks of bounded size. Each pair of blocks is one group; a row is
    sent to those of its own block with blocks that have a cell which the triangle inequality leaves open: one whose
    radius and the threshold reach the row's cell. A worker holds two blocks and the scores of one tile, and pairs leave it
    as they are found. How much the cells spare depends on how the vectors lie; the worst case is the square of the
    corpus, and a row is then sent as many times as there are blocks.
    """
    return _join(corpus, threshold, cells, _found_pairs, "a long, b long, score double")


def neighbour_counts(corpus: DataFrame, threshold: float, cells: int | None = None) -> DataFrame:
    """Per document how many others are over the threshold, those without any left out: doc_id, n. Pairs are counted where
    they are found."""
    rows = _join(corpus, threshold, cells, _found_counts, "doc_id long, n long")
    return rows.groupBy("doc_id").agg(F.sum("n").alias("n"))


def priority(seed: int, key: str = "doc_id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


#: Rows of the first part of a greedy selection, as expected, and how many times as far each next part reaches.
FIRST_ROWS, FURTHER = 4096, 4
_DIGESTS = 1 << 32


def _near_block(batches: Iterator[pa.RecordBatch], sent, threshold: float) -> Iterator[pa.RecordBatch]:
    """Ids of rows that are over the threshold with any of the block."""
    queries = sent.value[1]
    for batch in batches:
        if batch.num_rows:
            m, found = _matrix(batch.column("embedding")), np.zeros(batch.num_rows, bool)
            for k in range(0, len(queries), TILE_QUERIES):
                for y in range(0, len(m), TILE_ROWS):
                    at = y + np.flatnonzero(~found[y : y + TILE_ROWS])
                    if len(at):
                        found[at[_over(queries[k : k + TILE_QUERIES], m[at], threshold)[1]]] = True
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").filter(pa.array(found))], ["doc_id"])


def _walk(rows: DataFrame, threshold: float, seed: int, rounds: int) -> DataFrame:
    """The greedy selection of rows, all neighbours at once: doc_id, p."""
    nodes = stored(rows.select("doc_id", "p").distinct(), "diverse-nodes")
    near = neighbours(rows, threshold)
    # from the earlier row to the later one
    first = F.struct(priority(seed, "a"), "a") < F.struct(priority(seed, "b"), "b")
    edges = stored(near.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v")).distinct(), "diverse-edges")
    undecided, picked = nodes, nodes.limit(0)
    for _ in range(rounds):
        ready = stored(undecided.join(edges.select(F.col("v").alias("doc_id")), "doc_id", "left_anti"), "diverse-ready")
        picked = picked.unionByName(ready)
        gone = edges.join(ready.select(F.col("doc_id").alias("u")), "u", "left_semi").select(F.col("v").alias("doc_id")).distinct()
        undecided = stored(undecided.join(ready, "doc_id", "left_anti").join(gone, "doc_id", "left_anti"), "diverse-undecided")
        if undecided.isEmpty():
            return picked
        alive = lambda x: undecided.select(F.col("doc_id").alias(x))  # noqa: B023, E731
        edges = stored(edges.join(alive("u"), "u", "left_semi").join(alive("v"), "v", "left_semi"), "diverse-edges")
    raise RuntimeError(f"the selection did not settle in {rounds} rounds")


def diverse(corpus: DataFrame, threshold: float, seed: int = 42, target: int | None = None, rounds: int = 100) -> DataFrame:
    """Greedy selection in the order of a keyed digest, each pick removing its neighbours: doc_id, priority. Rows without an
    id are left out; those without a vector have no neighbours.

    The order is taken in parts, each reaching some times as far as the one before. Picks of a part remove their neighbours
    from all later rows, so that few pairs are left to a part, however many there are: only pairs inside of parts are ever
    written, and all others are scored with picks alone. Within a part the greedy set is the lexicographically first
    maximal independent set, found in parallel rounds: an undecided row that precedes all its undecided neighbours is picked,
    and its neighbours go. Later picks never change earlier ones, so ``target`` is a prefix, and parts after it are not
    begun. Rounds are stored; too many raise.
    """
    place = F.conv(F.substring("p", 1, 8), 16, 10).cast("long")
    rest = corpus.select(F.col("doc_id").cast("long"), "embedding").where("doc_id is not null").withColumn("p", priority(seed)).withColumn("place", place)
    rest = stored(rest, "diverse-rows")
    n, reach, picked = rest.count(), 0, None
    while True:
        reach = min(_DIGESTS, FURTHER * reach or _DIGESTS * FIRST_ROWS // max(1, n) + 1)
        part, later = rest.where(F.col("place") < reach), rest.where(F.col("place") >= reach)
        some = stored(_walk(part, threshold, seed, rounds), "diverse-picked")
        picked = some if picked is None else picked.unionByName(some)
        if reach == _DIGESTS or (target is not None and picked.count() >= target):
            break
        taken = part.join(some.select("doc_id"), "doc_id", "left_semi").where("embedding is not null").select(F.col("doc_id").alias("query_id"), "embedding")
        gone = _by_block(taken, later.where("embedding is not null"), partial(_near_block, threshold=threshold), "doc_id long").distinct()
        rest = stored(later.join(gone, "doc_id", "left_anti"), "diverse-rest")
        if rest.isEmpty():
            break
    picked = picked.select("doc_id", F.col("p").alias("priority"))
    return picked if target is None else picked.orderBy("priority", "doc_id").limit(target)


def cell_parameters(n: Column) -> list[Column]:
    """Cells, cells to probe and training rows for n vectors."""
    cells = F.greatest(F.lit(1), F.least(F.floor(4 * F.sqrt(n)), F.floor(n / 39) + 1)).cast("long")
    return [cells.alias("cells"), F.greatest(F.lit(8), F.floor(F.sqrt(cells))).cast("long").alias("probes"), F.least(256 * cells, n).cast("long").alias("training_rows")]


def cells(corpus: DataFrame, n_cells: int, sample: int = 20_000, seed: int = 42, rounds: int = 10) -> np.ndarray:
    """Centres by spherical k-means on a bounded sample of at most ``sample`` rows."""
    rows = corpus.orderBy(priority(seed), "doc_id").limit(sample).select("embedding").toArrow().combine_chunks()
    m = _matrix(rows.column("embedding").combine_chunks()) if rows.num_rows else np.zeros((0, 1))
    centres = m[: max(1, min(n_cells, len(m)))].copy()
    for _ in range(rounds):
        own = (m @ centres.T).argmax(1)
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = m[own == c].mean(0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def probes_for(queries: DataFrame, corpus: DataFrame, k: int, centres: np.ndarray, least: int = 1, recall: float = 0.95, sample: int = 512, seed: int = 42) -> int:
    """The fewest cells to probe, ``least`` or more, that hold a share ``recall`` of the exact top k of at most ``sample``
    queries. The exact search is over the whole corpus; the share is over the sampled queries together."""
    some = queries.orderBy(priority(seed, "query_id"), "query_id").limit(sample)
    best = dense_top_k(some, corpus, k).select("query_id", "doc_id")
    met = best.join(some.select("query_id", F.col("embedding").alias("_q")), "query_id").join(corpus.select("doc_id", "embedding"), "doc_id").select("_q", "embedding").toArrow().combine_chunks()
    if not met.num_rows:
        return min(least, len(centres))
    q, m = (_matrix(met.column(c).combine_chunks()) for c in ("_q", "embedding"))
    own = (m @ centres.T).argmax(1)
    place = np.sort((np.argsort(-(q @ centres.T), axis=1, kind="stable") == own[:, None]).argmax(1) + 1)
    return min(len(centres), max(least, int(place[int(np.ceil(recall * len(place))) - 1])))


def missing_vectors(rows: DataFrame, corpus: DataFrame, key: str) -> DataFrame:
    """Ids without a vector; a complete table gives none."""
    return rows.select(key).distinct().join(corpus.select(key), key, "left_anti")
