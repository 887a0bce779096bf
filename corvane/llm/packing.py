"""Order-preserving packing into fixed windows by dynamic programming.

Texts are packed in the order in which the table stores them (by file, and by place in the file), or in that of given
columns. Windows are cut at document ends, at sentence ends or, in a stretch without either, at small fixed steps. Over
the positions b where a cut may be, the least cost of a cut there is

    f(j) = penalty(j) + min over i with b(j) - b(i) <= size of f(i) + padding(b(j) - b(i)) + window,

where padding is what a window lacks to ``size``, and nothing at a power of two. For the first case f(i) + b(i) is kept in
a monotone queue, so each position costs constant time; positions a power of two apart are listed beforehand.

A run is a stretch of rows whose order is known: one split of a file, or one range of the given columns. Each run is packed
in one pass, in blocks whose last window stays open for the next one, so stored order needs no shuffle of the texts; only
the last window of a run may stay short. The narrow pieces are written, runs are counted and put in order, and windows are
numbered through: sequence_id grows with the order of the texts, from 0, without gaps. A lost task gives the same windows
again.

Nulls and edge cases: null text is empty; an empty text is its end id alone. Texts over the window size are cut; a text
is held whole with its ids. Rows that share or lack a doc_id are packed each. Rows that tie in the given columns are
ordered by doc_id. An empty table gives no window. Other columns are ignored. Rows that were shuffled since they were read
are packed in the order in which they lie in their partitions; where that mixes files in one task, it raises unless columns
are given.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels as K
from .scratch import keep, small
from .tokens import encoder

#: Ids gathered before windows are cut; a longer text is gathered whole.
BLOCK = 1 << 19
#: A stretch without sentence ends may be cut if it is longer than this part of a window, at this many places in one.
WIDE, STEPS = 16, 64
#: What a piece's row consists of; the last three name the run and the window in it until windows are numbered.
PIECE = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset", "window")


def cuts(at: np.ndarray, penalty: np.ndarray, size: int, window: float = 4.0) -> list[int]:
    """Indices into ``at`` of the best cuts, first and last included. at: increasing positions whose gaps are at most
    ``size``; penalty: cost of a cut at each; window: cost of each window, which keeps short ones rare."""
    b, p = at.tolist(), penalty.tolist()
    n = len(b)
    f, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque()
    # pairs of positions that lie a power of two apart: few, so they are found beforehand
    later, earlier = [], []
    for power in (1 << i for i in range((size - 1).bit_length())):
        k = np.searchsorted(at, at - power)
        hit = np.flatnonzero(at[k] == at - power)
        later.append(hit)
        earlier.append(k[hit])
    order = np.argsort(later := np.concatenate(later or [np.zeros(0, np.int64)]), kind="stable")
    pairs = iter(zip(later[order].tolist(), np.concatenate(earlier or [np.zeros(0, np.int64)])[order].tolist(), strict=True))
    at_j, k = next(pairs, (n, 0))
    for j in range(1, n):
        cost = f[j - 1] + b[j - 1]
        while queue and queue[-1][0] >= cost:
            queue.pop()
        queue.append((cost, j - 1))
        x = b[j]
        while b[queue[0][1]] < x - size:
            queue.popleft()
        best, i = queue[0]
        best += size - x
        while at_j == j:
            if f[k] < best:
                best, i = f[k], k
            at_j, k = next(pairs, (n, 0))
        f[j], back[j] = best + p[j] + window, i
    out = [n - 1]
    while out[-1]:
        out.append(back[out[-1]])
    return out[::-1]


class _Stream:
    """Ids of one run's texts that no closed window has yet."""

    def __init__(self, size: int, sentence: float, hard: float, file: str, block: int):
        self.size, self.sentence, self.hard, self.file, self.block, self.sequence = size, sentence, hard, file, block, 0
        self.docs: list[tuple] = []  # doc_id, ids, ids before these, ids of the whole text, positions of sentence ends
        self.waiting = 0

    def add(self, doc_id, ids: np.ndarray, ends: np.ndarray) -> None:
        self.docs.append((doc_id, ids, 0, len(ids), ends))
        self.waiting += len(ids)

    def close(self, last: bool) -> pa.RecordBatch:
        out: dict[str, list] = {x: [] for x in PIECE}
        if self.waiting:
            self._cut(out, last)
        n = len(out["doc_id"])
        return pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in out.values()), pa.array([self.file] * n, pa.string()), pa.array([self.block] * n, pa.int64())], [*out, "file", "block"])

    def _cut(self, out: dict[str, list], last: bool) -> None:
        where, cost, base = [np.zeros(1, np.int64)], [np.zeros(1)], 0
        for _, ids, _, _, ends in self.docs:
            where.append(np.append(ends + base, base + len(ids)))
            cost.append(np.append(np.full(len(ends), self.sentence), 0.0))
            base += len(ids)
        at, penalty = np.concatenate(where), np.concatenate(cost)
        step = max(1, self.size // STEPS)
        wide = np.flatnonzero(np.diff(at) > self.size // WIDE)
        if len(wide):
            extra = np.concatenate([np.arange(at[i] + step, at[i + 1], step) for i in wide])
            at, penalty = np.concatenate([at, extra]), np.concatenate([penalty, np.full(len(extra), self.hard)])
            order = np.argsort(at, kind="stable")
            at, penalty = at[order], penalty[order]
        chosen = at[cuts(at, penalty, self.size)].tolist()
        if not last:
            chosen.pop()  # the last window stays open
        d, done, begin = 0, 0, 0  # the text that holds ``begin``, and the ids before that text
        for a, b in zip(chosen[:-1], chosen[1:], strict=True):
            while begin < b:
                doc_id, ids, before, total, _ = self.docs[d]
                end = min(b, done + len(ids))
                piece = ids[begin - done : end - done]
                for key, value in (("doc_id", doc_id), ("start", before + begin - done), ("length", end - begin), ("ids_crc32", crc32(piece.astype("<u4").tobytes())), ("doc_tokens", total), ("offset", begin - a), ("window", self.sequence)):
                    out[key].append(value)
                begin = end
                if begin == done + len(ids):
                    done, d = done + len(ids), d + 1
            self.sequence += 1
        rest = self.docs[d:]
        if rest and begin > done:
            doc_id, ids, before, total, ends = rest[0]
            k = begin - done
            rest[0] = (doc_id, ids[k:], before + k, total, ends[ends > k] - k)
        self.docs, self.waiting = rest, base - begin


@K.releasing
def _pack(batches: Iterator[pa.RecordBatch], name: str, size: int, end_id: int, sentence: float, hard: float) -> Iterator[pa.RecordBatch]:
    coder = encoder(name)
    task, done, stream = TaskContext.get().partitionId(), set(), None
    for batch in batches:
        for part in K.slices(batch):
            files = part.column("file").to_pylist()
            blocks = part.column("block").to_pylist()
            texts = part.column("text").to_pylist()
            for file, block, doc_id, text in zip(files, blocks, part.column("doc_id").to_pylist(), texts, strict=True):
                run = ("", task) if file is None else (file, block)
                if stream is None or run != (stream.file, stream.block):
                    if stream is not None:
                        yield stream.close(True)
                    if run in done:
                        raise ValueError("these rows are no longer in the order of their files: name columns to order them by")
                    done.add(run)
                    stream = _Stream(size, sentence, hard, *run)
                ids = coder.ids(text or "")
                # a sentence ends after a stop before white space, or after a line end
                ends = np.flatnonzero(coder.line_end[ids[:-1]] | (coder.stop[ids[:-1]] & coder.gap[ids[1:]])) + 1
                stream.add(doc_id, np.append(ids, np.uint32(end_id)), ends)
                if stream.waiting >= BLOCK:
                    yield stream.close(False)
    if stream is not None:
        yield stream.close(True)


def _in_runs(docs: DataFrame, order: Sequence[str] | None) -> DataFrame:
    """doc_id, text, and the run of each row: file and block, or null where the partition is the run."""
    columns = [F.col("doc_id").cast("long").alias("doc_id"), "text"]
    alone = [F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("block")]
    if order:
        keys = [F.col(c) for c in order]
        ranged = docs.repartitionByRange(*keys, "doc_id").sortWithinPartitions(*keys, "doc_id")
        return ranged.select(*columns, *alone)
    try:
        return docs.select(*columns, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").cast("long").alias("block"))
    except AnalysisException:
        return docs.select(*columns, *alone)


def pack(docs: DataFrame, size: int = 2048, vocabulary: str = "byte_bpe_50k", end_id: int = 1, sentence: float = 2.0, hard: float = 64.0, order: Sequence[str] | None = None) -> DataFrame:
    """Pieces of texts in windows of at most ``size`` ids: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    sentence, hard: what a cut inside a document costs at a sentence end and elsewhere, in padded ids.
    order: columns whose order the texts take; without them the stored order.
    """
    schema = ", ".join(f"{c} long" for c in PIECE) + ", file string, block long"
    pieces = _in_runs(docs, order).mapInArrow(partial(_pack, name=vocabulary, size=size, end_id=end_id, sentence=sentence, hard=hard), schema)
    pieces = keep(pieces, "packed")
    # one row a run, a table of file splits; files written by Spark are numbered in their names
    runs = pieces.groupBy("file", "block").agg((F.max("window") + 1).alias("windows"))
    number = F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).try_cast("long")
    before = Window.orderBy(F.regexp_extract("file", r"^(.*/)", 1), number.asc_nulls_last(), "file", "block").rowsBetween(Window.unboundedPreceding, -1)
    runs = keep(runs.withColumn("first", F.coalesce(F.sum("windows").over(before), F.lit(0))).drop("windows"), "packed-runs")
    side = F.broadcast(runs) if small(runs, 400) else runs
    placed = pieces.join(side, ["file", "block"])
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("window")).alias("sequence_id"), "offset")
