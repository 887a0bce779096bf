"""Language identification by one bit-sliced Bloom filter over byte 4-grams.

Position p of the filter holds a bit mask of languages; the AND of the masks at an n-gram's positions names at once all
languages that contain it. A text's masks are counted per language and each count is corrected for that language's
false-positive rate; the largest share decides, ties going to the first language by code point.

Learning takes at most ``per_language`` documents of each language (a documented bound on a sample; the smallest digests
of doc_id), and of each language its ``top`` most frequent n-grams. An n-gram belongs to a language if its rate there is
at least ``share`` of its highest rate in any language.

A text is held whole: about 30 bytes for each byte of the longest, and half a MB of shorter ones at a time. Rows that repeat
a doc_id are predicted each, and learned from together.

Nulls and edge cases: null text and text without a letter give ``und`` and 0.0; so does a table without any learnable
row. A text whose n-grams are all unknown gives the first language and 0.0. Null lang or doc_id is never learned from;
the rows are still predicted. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels as K
from .split import held_out, sample

#: Bytes of n-grams: ASCII letters in lower case, bytes of other letters as they are, all else one separator.
FOLD = np.array([K.LOWER[i] if i >= 128 or chr(i).isalpha() else 32 for i in range(256)], np.uint8)
GRAM = 4
HASHES = 3


class Filter(NamedTuple):
    languages: list[str]
    masks: np.ndarray  #: per position, one unsigned word for each 64 languages or part of it
    wrong: np.ndarray  #: per language, the rate at which an n-gram of no language hits


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of many texts as integers, and per text where its own begin; one more entry ends the last."""
    data, at = K.texts(column)
    b = FOLD[data].astype(np.uint32)
    n = len(b) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
    g = b[:n] << np.uint32(24)
    for i in range(1, GRAM):
        g |= b[i : n + i] << np.uint32(8 * (GRAM - 1 - i))
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    # one text, and no two separators together
    wide = b == 32
    pair = wide[:-1] & wide[1:]
    ok = (text[:n] == text[GRAM - 1 :]) & ~K.sliding(pair, GRAM - 1, np.logical_or)
    where = np.flatnonzero(ok)
    return g[where], np.searchsorted(where, at)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in K.slices(batch):
            grams, at = _grams(part.column("text"))
            codes = part.column("lang").to_pylist()
            for lang in sorted(set(codes)):
                own = [grams[at[i] : at[i + 1]] for i, x in enumerate(codes) if x == lang]
                u, n = np.unique(np.concatenate(own), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(u.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])


def _places(grams: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    h = K.mix(grams.astype(np.uint64) + np.uint64(K.BASE))
    for i in range(HASHES):
        yield (h >> np.uint64(i * 20)) & np.uint64((1 << bits) - 1)


def fit(train: DataFrame, per_language: int = 1000, top: int = 20_000, share: float = 0.2, bits: int = 20) -> Filter:
    """``train``: doc_id, text, lang. What reaches the driver is at most ``top`` n-grams for each language."""
    known = train.where("lang is not null and doc_id is not null")
    chosen = F.broadcast(sample(known, "lang", per_language).select("doc_id").distinct())
    counts = known.join(chosen, "doc_id").select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("lang"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = counts.withColumn("rate", F.col("n") / total).withColumn("place", place).where(F.col("place") <= top).select("lang", "gram", "rate").toArrow()
    languages = sorted(set(rows.column("lang").to_pylist()))
    code = {x: i for i, x in enumerate(languages)}
    lang = np.array([code[x] for x in rows.column("lang").to_pylist()], np.int64)
    gram, rate = rows.column("gram").to_numpy().astype(np.uint32), rows.column("rate").to_numpy()
    if not languages:
        return Filter([], np.zeros((1 << bits, 1), np.uint8), np.zeros(0))
    unique, index = np.unique(gram, return_inverse=True)
    highest = np.zeros(len(unique))
    np.maximum.at(highest, index, rate)
    own = rate >= share * highest[index]
    width = (len(languages) + 63) // 64
    masks = np.zeros((1 << bits, width), np.uint64)
    for place in _places(gram[own], bits):
        np.bitwise_or.at(masks, (place, lang[own] // 64), np.uint64(1) << (lang[own] % 64).astype(np.uint64))
    full = np.array([np.count_nonzero(masks[:, i // 64] & (np.uint64(1) << np.uint64(i % 64))) for i in range(len(languages))])
    kind = next(t for n, t in ((8, np.uint8), (16, np.uint16), (32, np.uint32), (1 << 30, np.uint64)) if len(languages) <= n)
    return Filter(languages, masks.astype(kind), (full / (1 << bits)) ** HASHES)


def _predict(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    f: Filter = model.value
    bits = int(len(f.masks)).bit_length() - 1
    for batch in batches:
        for part in K.slices(batch):
            grams, at = _grams(part.column("text"))
            n = np.diff(at)
            hits = np.zeros((part.num_rows, len(f.languages)))
            if len(grams) and f.languages:
                found = None
                for place in _places(grams, bits):
                    m = f.masks[place.astype(np.int64)]
                    found = m if found is None else found & m
                some = np.flatnonzero(n)
                for i in range(len(f.languages)):
                    bit = ((found[:, i // 64] >> found.dtype.type(i % 64)) & found.dtype.type(1)).astype(np.int64)
                    hits[some, i] = np.add.reduceat(bit, at[some])
            share = np.clip((hits / np.maximum(n, 1)[:, None] - f.wrong) / (1 - np.minimum(f.wrong, 0.999)), 0, 1) if f.languages else hits
            total = share.sum(1)
            best = share.argmax(1) if f.languages else np.zeros(part.num_rows, int)
            readable = np.array(part.column("readable").to_pylist(), bool)
            known = readable & bool(f.languages)
            score = np.where(known & (total > 0), share[np.arange(part.num_rows), best] / np.where(total > 0, total, 1), 0.0) if f.languages else np.zeros(part.num_rows)
            pred = [f.languages[b] if k else "und" for b, k in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])


def predict(docs: DataFrame, model: Filter) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score. Only the text is read for the prediction."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("readable"))
    return rows.mapInArrow(partial(_predict, model=sent), "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, **options) -> DataFrame:
    """Fit on the learnable fold of ``docs`` (doc_id, text, lang) and predict every row."""
    return predict(docs, fit(docs.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long"), "text", "lang"), **options))
