"""Periodic runs of words: stretches that repeat with one period, found on a harmonic grid.

A run is a maximal stretch of words in which words q apart are identical, q being the smallest such distance, and that is at
least ``least`` words and ``times`` periods long. In such a stretch of length L the words at x and x + q agree for L - q
places, so one of the grid points x = 0, q, 2q, ... lies in it, and for every period p the longest common extensions,
forward and backward, between x = jp and (j + 1)p give the whole stretch. Over all periods that is n/1 + n/2 + n/3 + ...
queries. Each is answered in constant time by a suffix array of the text, one of the reversed text, and range minima over
their common prefixes. Where L - q leaves room, only every second or third of a small period's points is asked; a point is
asked at all only where the next ``GRAM`` words at x and x + p have equal hashes, as they must within a run. Of the periods
found for a stretch, the smallest counts; that is exact since a stretch of two periods or more has a smallest period that
divides the others.

Everything happens inside one text, so nothing is shuffled and no key can be hot; texts are taken together, up to half a MB
of them, to make arrays long. Words stand as 64-bit hashes.

Nulls and edge cases: null text is empty. Rows that share or lack a doc_id are treated each. A text is held whole: about 40
bytes for each byte of the longest, and where it has candidates about 8 * log2(words) bytes more for each word. Queries are
asked in slices of ``ASKED`` pairs. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

#: Words compared by hash before a pair of positions is asked for its extensions.
GRAM = 8
#: Pairs of positions that are laid out at a time.
ASKED = 1 << 20

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Extensions:
    """Longest common extensions in one array of numbers: its suffix array, and minima over neighbours' common prefixes."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        # ranks of the 1, 2, 4, ... numbers from each place on, until all differ
        rank = np.unique(values, return_inverse=True)[1].astype(np.int32)
        ranks, k = [rank], 1
        while k < n and rank.max() < n - 1:
            key = rank.astype(np.int64) * (n + 1)
            key[:-k] += rank[k:] + 1
            rank = np.unique(key, return_inverse=True)[1].astype(np.int32)
            ranks.append(rank)
            k *= 2
        self.place = rank
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        # common prefixes of neighbours in the order: as many doublings of equal rank as fit
        a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(max(n - 1, 0), np.int32)
        for i in range(len(ranks) - 1, -1, -1):
            r = ranks.pop()
            equal = (np.maximum(a, b) < n) & (r[np.minimum(a, n - 1)] == r[np.minimum(b, n - 1)])
            step = equal.astype(np.int64) << i
            a += step
            b += step
            common += step.astype(np.int32)
        self.minima = [common]
        while len(self.minima[-1]) > 1 << (len(self.minima) - 1):
            half, low = 1 << (len(self.minima) - 1), self.minima[-1]
            self.minima.append(np.minimum(low[:-half], low[half:]))

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How far the values from x and from y on agree; x differs from y."""
        a, b = self.place[x], self.place[y]
        low, high = np.minimum(a, b).astype(np.int64), np.maximum(a, b).astype(np.int64)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(x), np.int64)
        for k in np.unique(level).tolist():
            mine = np.flatnonzero(level == k)
            minima = self.minima[k]
            out[mine] = np.minimum(minima[low[mine]], minima[high[mine] - (1 << k)])
        return out


def _grid(first: np.ndarray, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of positions to compare: x, period, words that must agree from both on; texts begin at ``first``."""
    n = np.diff(first)
    most = n // times
    # a row for each text and period
    text = np.repeat(np.arange(len(n)), most)
    p = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    agree = np.maximum(least - p, (times - 1) * p)  # a run agrees with itself, a period on, at so many places at least
    gram = np.where(agree - p + 1 >= GRAM, GRAM, 1)
    step = np.maximum(1, (agree - gram + 1) // p) * p
    room = n[text] - p - gram
    count = np.where((room >= 0) & (n[text] >= least), room // step + 1, 0)
    ends = np.cumsum(count)
    i = 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + ASKED, "right")))
        c = count[i:j]
        own = np.repeat(np.arange(i, j), c)
        x = (np.arange(len(own)) - np.repeat(np.cumsum(c) - c, c)) * step[own] + first[text[own]]
        yield x, p[own], gram[own]
        i = j


def find_runs(words: np.ndarray, first: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of texts of hashed words, that begin at ``first``: start (among all words), end, period, by start and period."""
    none = (np.zeros(0, np.int64),) * 3
    n = len(words)
    ahead = words.copy()  # a hash of the next GRAM words; those over the end of a text are never asked
    for k in range(1, min(GRAM, n)):
        ahead[: n - k] = K.mix(ahead[: n - k] * np.uint64(K.BASE) + words[k:])
    found = []
    for x, p, gram in _grid(first, least, times):
        hit = words[x] == words[x + p]
        x, p, gram = x[hit], p[hit], gram[hit]
        hit = (gram == 1) | (ahead[x] == ahead[x + p])
        found.append((x[hit], p[hit]))
    if not sum(len(x) for x, _ in found):
        return none
    x, p = (np.concatenate(c) for c in zip(*found, strict=True))
    # only texts with candidates are indexed, each ended by a number of its own
    text = np.searchsorted(first, x, "right") - 1
    asked = np.unique(text)
    size = first[asked + 1] - first[asked]
    moved = np.cumsum(size + 1) - (size + 1)  # where each begins now
    total = int(size.sum()) + len(asked)
    source = np.arange(total) - np.repeat(moved - first[asked], size + 1)
    last = moved + size
    source[last] = 0
    values = np.unique(words[source], return_inverse=True)[1] + len(asked)
    values[last] = np.arange(len(asked))
    shift = moved - first[asked]
    own = shift[np.searchsorted(asked, text)]
    a = x + own
    after = Extensions(values)(a, a + p)
    # backward: the places before a and a + p, read from the end
    before = np.zeros(len(a), np.int64)
    some = np.flatnonzero(a > moved[np.searchsorted(asked, text)])
    if len(some):
        before[some] = Extensions(values[::-1])(total - a[some], total - a[some] - p[some])
    start, end = x - before, x + p + after
    long = end - start >= np.maximum(least, times * p)
    start, end, p = start[long], end[long], p[long]
    order = np.lexsort((p, end, start))
    start, end, p = start[order], end[order], p[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, p = start[new], end[new], p[new]
    order = np.lexsort((p, start))
    return start[order], end[order], p[order]


def _runs(batches: Iterator[pa.RecordBatch], least: int, times: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in K.slices(batch):
            words = K.words(part.column("text"))
            start, end, period = find_runs(words.hash, words.first, least, times)
            # words in a run after its first period go
            edge = np.zeros(len(words.hash) + 1, np.int64)
            np.add.at(edge, start + period, 1)
            np.add.at(edge, end, -1)
            kept = np.cumsum(edge[:-1]) == 0
            data, collapsed = words.data.tobytes(), []
            bounds = np.searchsorted(start, words.first)
            for r in range(part.num_rows):
                if bounds[r] == bounds[r + 1]:
                    collapsed.append(b" ".join(data[words.at[r] : words.at[r + 1]].split()))
                else:
                    i = np.flatnonzero(kept[words.first[r] : words.first[r + 1]]) + words.first[r]
                    collapsed.append(b" ".join(data[a:b] for a, b in zip(words.start[i].tolist(), words.end[i].tolist(), strict=True)))
            own = start - words.first[np.searchsorted(words.first, start, "right") - 1]
            runs = pa.StructArray.from_arrays([pa.array(v.astype(np.int64)) for v in (own, end - start, period)], fields=list(RUN))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(words.first).astype(np.int64)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), runs), pa.array(collapsed, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"],
            )


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, runs (array of start, length, period, by start and period; in words, from 0),
    collapsed (the words that are in no run after its first period, joined by one space).

    least, times: a run has at least so many words, and so many periods; ``times`` is 2 or more.
    """
    if times < 2 or least < 2:
        raise ValueError("a run has two periods and two words at least")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_runs, least=least, times=times), "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
