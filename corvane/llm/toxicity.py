"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence scores sigmoid(bias + sum of the weights of its distinct signs: words and the
beginnings of words); a
document is toxic if any sentence is, so sentence scores combine by noisy-or, 1 - prod(1 - p). Only document labels are
known: the gradient of the document's log-likelihood trains weights through the noisy-or, and the sentences that carry
a document's score are then the offending ones.

Learning takes at most ``per_label`` labelled documents of each label (a documented bound on a sample; the smallest
digests of doc_id) and at most ``words`` words, those whose document rates lie at least 4.5 standard
errors apart between labels (if none does, the ten that come closest). The score is
raised to the power that puts the best threshold on the training sample at 0.3, so order is kept.

A text is held whole: about 60 bytes for each byte of the longest, and half a MB of shorter ones at a time. Documents that
tie in a score are judged alike; an empty table gives an empty result.

Nulls and edge cases: a text without words scores 0.0. Without labelled rows of both kinds every score is 0.0. Labels
that are null, or whose doc_id is, are not used; if a document has several, 1 counts. Rows that share a doc_id share its
label. Sentences end at ``.``, ``!``, ``?`` or a line end; case is ignored for A-Z. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import keep
from .split import held_out, sample

THRESHOLD = 0.3
#: Bytes of a word's beginning, a sign of its own: inflected forms share it.
STEM = 4
#: Standard errors from which a word is taken to differ between labels.
ERRORS = 4.5
#: Share of labels of either kind taken to be wrong, so that a document without any sign does not move the bias.
NOISE = 0.02
STOPS = np.zeros(256, np.int64)
STOPS[[10, 33, 46, 63]] = 1


class Model(NamedTuple):
    words: np.ndarray  #: sorted hashes
    weights: np.ndarray
    bias: float
    power: float


def _sentences(column: pa.Array) -> tuple[K.Words, np.ndarray, np.ndarray]:
    """Words, the text of each word, and a number for the sentence of each word that grows along the batch."""
    w = K.words(column, K.NON_ALNUM, K.LOWER, STEM)
    stops = np.concatenate([[0], np.cumsum(STOPS[w.data])])
    text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    if not len(w.hash):
        return w, text, np.zeros(0, np.int64)
    new = (np.diff(stops[w.start], prepend=-1) > 0) | (np.diff(text, prepend=-1) > 0)
    return w, text, np.cumsum(new) - 1


@K.releasing
def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (label, doc, sentence, word) of the training sample; sentences are numbered inside their text."""
    for batch in batches:
        for part in K.slices(batch):
            w, text, sentence = _sentences(part.column("text"))
            if not len(text):
                continue
            local = sentence - sentence[w.first[text]]
            label = part.column("toxic").to_numpy()[text]
            for sign in (w.hash, w.prefix):
                yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), part.column("doc_id").take(pa.array(text)), pa.array(local), pa.array(sign.view(np.int64))], ["label", "doc_id", "sentence", "word"])


def _train(doc: np.ndarray, sentence: np.ndarray, word: np.ndarray, label: np.ndarray, n_words: int, rounds: int = 300, rate: float = 0.3, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Adam on the noisy-or likelihood. doc: of each sentence; sentence, word: pairs; label: of each document."""
    theta, m, v = np.zeros(n_words + 1), np.zeros(n_words + 1), np.zeros(n_words + 1)
    theta[-1] = -6.0
    weigh = np.where(label == 1, 0.5 / max(1, label.sum()), 0.5 / max(1, len(label) - label.sum()))
    for step in range(1, rounds + 1):
        z = np.bincount(sentence, theta[word], len(doc)) + theta[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(label))  # log of P(no sentence is toxic)
        toxic = -np.expm1(clean)
        # P(label 1) = NOISE + (1 - 2 NOISE) * toxic; d(toxic)/dz = P(no sentence is toxic) * p
        said = NOISE + (1 - 2 * NOISE) * toxic
        by_doc = (1 - 2 * NOISE) * np.exp(clean) * np.where(label == 1, 1 / said, -1 / (1 - said)) * weigh
        dz = by_doc[doc] * p
        grad = np.append(np.bincount(word, dz[sentence], n_words), dz.sum()) - decay * np.append(theta[:-1], 0) / n_words
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 1000, words: int = 400) -> Model:
    """What reaches the driver: ``words`` words, and their places in at most 2 * ``per_label`` documents."""
    none = Model(np.zeros(0, np.uint64), np.zeros(0), -30.0, 1.0)
    marked = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long")).agg(F.max("toxic").alias("toxic"))
    chosen = sample(marked, "toxic", per_label)
    bags = keep(docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id").mapInArrow(_bags, "label int, doc_id long, sentence long, word long").distinct(), "toxic-bags")
    sizes = {r.label: r.n for r in bags.groupBy("label").agg(F.countDistinct("doc_id").alias("n")).collect()}
    if len(sizes) < 2:
        return none
    held = bags.groupBy("word").agg(F.countDistinct(F.when(F.col("label") == 1, F.col("doc_id"))).alias("t"), F.countDistinct(F.when(F.col("label") == 0, F.col("doc_id"))).alias("c"))
    # how many standard errors the labels' document rates lie apart; many words are tried, so the bar is high
    t, c = F.col("t") / sizes[1], F.col("c") / sizes[0]
    pooled = (F.col("t") + F.col("c")) / (sizes[1] + sizes[0])
    gap = F.abs(t - c) / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-9)) * (1 / sizes[1] + 1 / sizes[0]))
    vocabulary = keep(held.withColumn("gap", gap).orderBy(F.desc("gap"), "word").limit(words), "toxic-words")
    sure = vocabulary.where(F.col("gap") >= ERRORS).select("word")
    vocabulary = vocabulary.orderBy(F.desc("gap"), "word").limit(10).select("word") if sure.isEmpty() else sure
    rows = bags.join(F.broadcast(vocabulary), "word", "left").select("label", "doc_id", "sentence", F.col("word").alias("w"))
    known = bags.join(F.broadcast(vocabulary), "word").toArrow()
    lengths = rows.groupBy("label", "doc_id").agg(F.countDistinct("sentence").alias("n")).toArrow()
    ids = np.sort(np.unique(known.column("word").to_numpy()).view(np.uint64))
    doc_ids, sentences = lengths.column("doc_id").to_numpy(), lengths.column("n").to_numpy()
    order = np.argsort(doc_ids, kind="stable")
    doc_ids, sentences, label = doc_ids[order], sentences[order], lengths.column("label").to_numpy()[order]
    # sentences with a known word, numbered; all others of a document score the bias alone
    doc_of = np.searchsorted(doc_ids, known.column("doc_id").to_numpy())
    pair = np.stack([doc_of, known.column("sentence").to_numpy()], 1)
    unique, sentence = np.unique(pair, axis=0, return_inverse=True)
    sentence = sentence.reshape(-1)
    rest = np.repeat(np.arange(len(doc_ids)), sentences - np.bincount(unique[:, 0], minlength=len(doc_ids)))
    doc = np.concatenate([unique[:, 0], rest])
    word = np.searchsorted(ids, known.column("word").to_numpy().view(np.uint64))
    weights, bias = _train(doc, sentence, word, label, len(ids))
    z = np.bincount(sentence, weights[word], len(doc)) + bias
    score = -np.expm1(np.bincount(doc, np.log1p(-np.minimum(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1 - 1e-9)), len(label)))
    # the threshold with the best accuracy on the sample; between the two scores around it
    order = np.argsort(-score, kind="stable")
    ranked, hit = score[order], label[order] == 1
    good = (np.cumsum(hit) - np.cumsum(~hit)).astype(float)
    good[:-1][ranked[:-1] == ranked[1:]] = -np.inf
    i = int(good.argmax())
    cut = float(np.clip(np.sqrt(max(ranked[i], 1e-12) * max(ranked[i + 1] if i + 1 < len(ranked) else 1e-6, 1e-12)), 1e-6, 0.999))
    return Model(ids, weights, bias, float(np.log(THRESHOLD) / np.log(cut)))


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m: Model = model.value
    for batch in batches:
        for part in K.slices(batch):
            w, text, sentence = _sentences(part.column("text"))
            n = part.num_rows
            score = np.zeros(n)
            spans: list[list[dict]] = [[] for _ in range(n)]
            if len(sentence) and len(m.words):
                where, which = [], []
                for sign in (w.hash, w.prefix):
                    place = np.minimum(np.searchsorted(m.words, sign), len(m.words) - 1)
                    at = np.flatnonzero(m.words[place] == sign)
                    where.append(sentence[at])
                    which.append(place[at])
                # each sign counts once in a sentence
                once = np.unique(np.concatenate(where) * len(m.words) + np.concatenate(which))
                z = np.bincount(once // len(m.words), m.weights[once % len(m.words)], sentence[-1] + 1) + m.bias
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                head = np.flatnonzero(np.diff(sentence, prepend=-1))
                owner = text[head]
                score = np.clip(-np.expm1(np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-9)), n)), 0, 1) ** m.power
                tail = np.append(head[1:], len(sentence)) - 1
                for s in np.flatnonzero(p**m.power >= THRESHOLD):
                    o = owner[s]
                    spans[o].append({"start": int(head[s] - w.first[o]), "end": int(tail[s] + 1 - w.first[o]), "score": float(p[s] ** m.power)})
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array(spans, kind)], [part.schema.field(0).name, "score", "offending"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, score, offending (sentences over the threshold: start and end as word numbers, score)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(partial(_score, model=sent), "doc_id long, score double, offending array<struct<start: long, end: long, score: double>>")


@K.releasing
def _keep_clean(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("text")
        alone = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), text], ["row", "text"])
        scores = np.concatenate([np.zeros(0), *(x.column("score").to_numpy() for x in _score([alone], model))])
        yield batch.filter(pa.array(scores < THRESHOLD))


def clean_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that score under the threshold, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **options))
    return docs.mapInArrow(partial(_keep_clean, model=model), docs.schema)
