"""Removal of long passages that an earlier document already has: seeds by winnowing, extension both ways.

With a threshold of ``least`` words, seeds are hashes of k = least // 2 + 1 words, and of every w = least - k + 1
consecutive seeds the smallest is an anchor. So a window of ``least`` words holds an anchor, the same one wherever its
words stand, and since w <= k the seeds of neighbouring anchors touch.

Documents meet on anchors, never in pairs: an anchor's group is reduced, before the shuffle, to the smallest document
that has it. Extension goes both ways from each shared anchor. Where neighbouring anchors match that document at one
offset, the match runs on and needs no more work; such runs cover the inside of copies. Around everything else, up to
``least - k`` words to either side, each window is looked up among the windows that other documents grew around the same
anchors. A window is emitted unless a run proves that a smaller document has it, hence the smallest document with a
window always emits it, and the union of runs and of windows found in a smaller document is exactly the union of
maximal repeats of at least ``least`` words. Window identity is a 64-bit and a 32-bit hash of whole words.

Both hashes are polynomials over one 64-bit hash of each word. A text is held whole: about 100 bytes for each byte of the
longest, and half a MB of shorter ones at a time.

Nulls and edge cases: null text is empty; texts under ``least`` words lose nothing. Rows that share a doc_id never remove
each other's words. A row whose doc_id is null neither removes nor loses words. Equal rows are treated alike. Repeats
inside one document stay. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import BROADCAST_BYTES, keep, only_keys, small

#: A row of a table of documents: repeated doc_ids with different texts stay apart.
KEY = ["doc_id", "text_key"]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")


def _anchors(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    k = least // 2 + 1
    w = least - k + 1
    for batch in batches:
        for part in K.slices(batch):
            words = K.words(part.column("text"))
            seeds, whole = K.grams(words, k)
            if len(seeds) < w:
                continue
            full = K.sliding(whole, w, np.logical_and)
            # a window of seeds inside one text: its first and last seed are there, and the words between are in one text
            text = np.repeat(np.arange(part.num_rows), np.diff(words.first))
            n = len(seeds) - w + 1
            full &= text[:n] == text[w - 1 : w - 1 + n]
            lowest = np.where(full, K.sliding(seeds, w, np.minimum), np.uint64(0))
            around = np.concatenate([np.zeros(w - 1, np.uint64), lowest, np.zeros(w - 1, np.uint64)])
            chosen = np.flatnonzero((K.sliding(around, w, np.maximum) == seeds) & whole)
            row = text[chosen]
            yield pa.RecordBatch.from_arrays([part.column(c).take(pa.array(row)) for c in KEY] + [pa.array((chosen - words.first[row]).astype(np.int32)), pa.array(seeds[chosen].view(np.int64))], [*KEY, "at", "anchor"])


def _extend(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """From each text with its shared anchors (at, and where the smallest document has them): repeats proven by runs of
    anchors as (at, length), and around the other anchors all windows as (at, hashes)."""
    k = least // 2 + 1
    for batch in batches:
        for part in K.slices(batch):
            words = K.words(part.column("text"))
            one, _ = K.grams(words, least)
            two, _ = K.grams(words, least, K.BASE)
            for r in range(part.num_rows):
                found = part.column("found")[r].values
                at, other, there = (found.field(c).to_numpy(zero_copy_only=False) for c in ("at", "source", "source_at"))
                order = np.argsort(at, kind="stable")
                at, other, there = at[order].astype(np.int64), other[order], there[order].astype(np.int64)
                doc = part.column("doc_id")[r].as_py()
                base, n = int(words.first[r]), int(words.first[r + 1] - words.first[r])
                # runs: neighbouring anchors with one source and offset whose seeds touch
                joined = (other[1:] == other[:-1]) & (at[1:] - there[1:] == at[:-1] - there[:-1]) & (at[1:] - at[:-1] <= k) & (other[1:] != doc)
                head = np.flatnonzero(np.concatenate([[True], ~joined]))
                tail = np.append(head[1:] - 1, len(at) - 1)
                start, end = at[head], at[tail] + k
                long = end - start >= least
                start, end = start[long], end[long]
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, np.maximum(0, at - (least - k)), 1)
                np.add.at(edge, np.minimum(at, n - least) + 1, -1)
                near = np.cumsum(edge)[: n - least + 1] > 0
                edge[:] = 0
                np.add.at(edge, start, 1)
                np.add.at(edge, end - least + 1, -1)
                near &= np.cumsum(edge)[: n - least + 1] == 0
                grown = np.flatnonzero(near)
                m, g = len(start), len(grown)
                none = np.zeros(m, bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(np.full(m + g, part.column(c)[r].as_py(), np.int64)) for c in KEY),
                        pa.array(np.concatenate([start, grown]).astype(np.int32)),
                        pa.array(np.concatenate([end - start, np.full(g, least)]).astype(np.int32)),
                        pa.array(np.concatenate([np.zeros(m, np.int64), one[base + grown].view(np.int64)]), mask=np.concatenate([~none, np.zeros(g, bool)])),
                        pa.array(np.concatenate([np.zeros(m, np.int32), (two[base + grown] >> np.uint64(32)).astype(np.uint32).view(np.int32)])),
                    ],
                    [*KEY, "at", "length", "window", "check"],
                )


#: Word ranges.
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping, touching and repeated ranges (at, length) of each text as disjoint ones."""
    for batch in batches:
        found = batch.column("found")
        out = []
        for r in range(batch.num_rows):
            own = found[r].values
            start, length = (own.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "length"))
            order = np.argsort(start, kind="stable")
            start, end = start[order], np.maximum.accumulate((start + length)[order])
            head = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
            out.append([{"start": a, "end": b} for a, b in zip(start[head].tolist(), end[np.append(head[1:] - 1, len(end) - 1)].tolist(), strict=True)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(out, SPANS)], [*KEY, "found"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words of their ranges."""
    for batch in batches:
        out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": [], "removed": []}
        for i, text in enumerate(batch.column("text")):
            words = (text.as_py() or "").encode().split()
            out["n_words"].append(len(words))
            spans = batch.column("found")[i].as_py() or []
            kept, last = [], 0
            for x in spans:
                kept += words[last : x["start"]]
                last = x["end"]
            kept += words[last:]
            out["n_removed"].append(len(words) - len(kept))
            out["kept_sha256"].append(sha256(b" ".join(kept)).hexdigest())
            out["removed"].append(spans)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_sha256"], pa.string()), pa.array(out["removed"], SPANS)], ["doc_id", *out])


def repeats(docs: DataFrame, least: int = 50) -> DataFrame:
    """Per (doc_id, text_key) with something to remove: found, an array of word ranges (start, end)."""
    keyed = _keyed(docs).where("doc_id is not null")
    anchors = keep(keyed.mapInArrow(partial(_anchors, least=least), "doc_id long, text_key long, at int, anchor long"), "anchors")
    # kept first, so that the join below reads plain shuffles, whose hot partitions Spark splits
    groups = keep(anchors.groupBy("anchor").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"), F.min_by("at", "doc_id").alias("source_at")).where("source < last").drop("last"), "anchor-groups")
    shared = anchors.join(groups, "anchor").groupBy(*KEY).agg(F.collect_list(F.struct("at", "source", "source_at")).alias("found"))
    shared = keep(shared, "shared")
    grown = keep(only_keys(keyed, shared, KEY).join(shared, KEY).mapInArrow(partial(_extend, least=least), "doc_id long, text_key long, at int, length int, window long, check int"), "grown")
    windows = grown.where("window is not null")
    first = keep(windows.groupBy("window", "check").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").drop("high"), "first-windows")
    met = windows.join(first, ["window", "check"]).where("doc_id > low").select(*KEY, "at", "length")
    every = met.union(grown.where("window is null").select(*KEY, "at", "length")).groupBy(*KEY).agg(F.collect_list(F.struct("at", "length")).alias("found"))
    return every.mapInArrow(_merge, "doc_id long, text_key long, found array<struct<start: long, end: long>>")


def remove_repeats(docs: DataFrame, least: int = 50) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by a space), removed (array
    of word ranges start, end)."""
    found = keep(repeats(docs, least), "repeats")
    # bounded by the ranges, not only by the rows
    ranges = found.agg(F.coalesce(F.sum(F.size("found")), F.lit(0))).first()[0]
    side = F.broadcast(found) if small(found) and 32 * ranges <= BROADCAST_BYTES else found
    return _keyed(docs).join(side, KEY, "left").select("doc_id", "text", "found").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start: long, end: long>>")
