"""The Merkle manifest, byte-level BPE and periodic runs against plain versions."""

from __future__ import annotations

import base64
import random
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import bpe, merkle, periodic_runs, queries


def h(text):
    return sha256(text.encode()).hexdigest()


# ---- Merkle manifest


def plain_tree(digests):
    """The top, and per leaf its (left, right) on the way there."""
    steps, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for leaf, i in enumerate(at):
            run = level[i // 16 * 16 : i // 16 * 16 + 16]
            steps[leaf].append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
            at[leaf] = i // 16
        level = [h("".join(level[i : i + 16])) for i in range(0, len(level), 16)]
    return level[0], steps


def plain_manifest(rows):
    """rows: (group, key, text); per row key, leaf, subroot, root, steps."""
    encoded = lambda *fields: "".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields)
    groups = {}
    for group, key, text in rows:
        groups.setdefault(group, []).append((key is not None, key or 0, h(encoded(group, key, text)), key))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [plain_tree([x[2] for x in sorted(groups[g])]) for g in names]
    root, above = plain_tree([t[0] for t in trees])
    return [(x[3], x[2], top, root, [*own, *way]) for g, (top, steps), way in zip(names, trees, above, strict=True) for x, own in zip(sorted(groups[g]), steps, strict=True)]


def proved(spark, rows, parts=4, **options):
    docs = spark.createDataFrame(rows, "source string, doc_id long, text string").repartition(parts)
    out = merkle.prove(merkle.manifest(merkle.leaves(docs, ["source", "doc_id", "text"], "source", "doc_id"), **options))
    return sorted(((r["key"], r["digest"], r["subroot"], r["root"], [tuple(s) for s in r["steps"]]) for r in out.collect()), key=repr)


@pytest.mark.parametrize("kept_open", [50_000, 3])
def test_trees_by_hand(spark, kept_open):
    """Sizes around powers of the arity, a null and an empty group, repeated and null keys; also where tasks keep few parents open."""
    rng = random.Random(3)
    sizes = {None: 17, "": 1, "a": 16, "b": 257, "ß": 2, "z": 530}
    rows = [(g, i, f"{g} {rng.random()}") for g, n in sizes.items() for i in range(n)]
    rows += [("b", 5, "again"), ("b", 5, "again"), ("b", None, "x"), ("z", 9, None), (None, None, None)]
    rng.shuffle(rows)
    assert proved(spark, rows, most=kept_open) == sorted(plain_manifest(rows), key=repr)


def test_one_row_and_many_groups(spark):
    assert proved(spark, [("a", 1, "x")]) == plain_manifest([("a", 1, "x")])
    rows = [(f"g{i}", i, "x") for i in range(300)]
    assert proved(spark, rows) == sorted(plain_manifest(rows), key=repr)


def test_most_nodes_never_leave_their_task(spark):
    """What is complete in a range of leaves is not shuffled: the frontier is a few parents at each end of it."""
    nodes = spark.range(0, 40_000, numPartitions=4).select(F.lit("1a").alias("tree"), F.lit(40_000).cast("long").alias("size"), F.lit(0).alias("level"), F.col("id").alias("index"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    found = nodes.mapInArrow(partial(merkle._combine, most=merkle.OPEN), merkle.PARENT)
    assert found.where("digest is null").count() <= 4 * 2 * 4
    assert found.where("digest is not null").count() >= 40_000 / 16 - 8


def test_tampering_is_found(spark):
    docs = spark.createDataFrame([(i, f"Text {i}", "s") for i in range(100)], "doc_id long, text string, source string")
    rows = merkle.leaves(docs, ["doc_id", "text"], "source", "doc_id", {"text": F.when(F.col("doc_id") % 7 == 0, F.lower("text")).otherwise(F.col("text"))})
    out = merkle.prove(merkle.manifest(rows)).select("key", (merkle.folded(F.col("observed"), F.col("steps")) == F.col("root")).alias("verified"), (merkle.folded(F.col("digest"), F.col("steps")) == F.col("root")).alias("sound"))
    got = {r["key"]: r.verified for r in out.collect() if r.sound}
    assert got == {i: i % 7 != 0 for i in range(100)}


# ---- byte-level BPE


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import public_tokenizers as files
    import tiktoken

    with open(files.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})


SIGNS = ["a", "s", "t", "re", "ve", "ll", "m", "d", "'", "'", " ", " ", "\n", "\t", " ", "　", "1", "²", "½", "é", "!", "-", "_", "\x1c", "՘", "؀", "字", "😀", "́", "R", "E", "\r", "\u0085", "<|endoftext|>"]


def test_splits_are_those_of_the_library(tiktoken_encoding):
    rng = random.Random(5)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 30))) for _ in range(20_000)] + [None, "", "'", "x'", "'s", " 's", "'ll", "'l"]
    w, word = bpe.pretokens(pa.array(texts)), bpe.vocabulary("byte_bpe_multi_50k").word
    data = w.data.tobytes()
    for i, text in enumerate(texts):
        own = slice(w.first[i], w.first[i + 1])
        pieces = [data[a:b].decode() for a, b in zip(w.start[own].tolist(), w.end[own].tolist(), strict=True)]
        assert "".join(pieces) == (text or "")
        assert [k for x in pieces for k in word(x)] == tiktoken_encoding.encode_ordinary(text or "")


@pytest.mark.parametrize("block", [1, 2000, bpe.BLOCK])
def test_ids_are_those_of_the_library(spark, tmp_path, block, tiktoken_encoding):
    rng = random.Random(block)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 200))) for _ in range(120)] + [None, "", "the the the", "  ", "a" * 5000]
    rows = [(i // 2 if i % 11 else None, x) for i, x in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.repartition(3).write.parquet(f"{tmp_path}/docs")
    want = sorted(((i, tiktoken_encoding.encode_ordinary(x or ""), (x or "").encode()) for i, x in rows), key=repr)
    for table in (docs, spark.read.parquet(f"{tmp_path}/docs"), docs.union(docs.limit(0))):
        got = bpe.decode(bpe.encode(table, buckets=16, block=block)).collect()
        assert sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in got), key=repr) == want


def test_words_are_encoded_once(spark, monkeypatch):
    """All blocks of a bucket meet in one task, which asks the vocabulary for each distinct word once."""
    asked = []
    monkeypatch.setattr(bpe, "vocabulary", lambda name: type("V", (), {"word": staticmethod(lambda x: asked.append(x) or [len(x)])}))
    block = bpe._Block([(pa.array([1], pa.int64()), w := bpe.pretokens(pa.array(["b a b c a"])), *bpe._hashes(w))], 1)
    words = np.array([len(x) for x in block.words()], "<u4")
    payload = bpe._squeezed(block.mark, words, np.frombuffer(b"".join(block.words()), np.uint8))
    batch = bpe._rows([1, 2, 3], [0, 0, 0], [payload] * 3)
    (out,) = bpe._encode(iter([batch]), "any")
    assert sorted(asked) == sorted({"b", " a", " b", " c"})
    assert bpe._expanded(out.column("payload")[2].as_py())[1].tolist() == [1, 1, 1, 1]


def test_hashes_that_collide_are_told_apart():
    first = np.array([5, 5, 7, 5, 7], np.uint64)
    codes, one = bpe._codes(first, np.array([1, 2, 3, 1, 3], np.uint64))
    assert len(one) == 3
    assert codes[0] == codes[3] != codes[1]
    assert codes[2] == codes[4]


# ---- periodic runs


def plain_runs(words, least, times):
    best = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                best.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in best.items())


def periodic_text(rng):
    k = rng.choice([1, 2, 3, 20, 1000])
    words = [str(rng.randint(1, k)) for _ in range(rng.randint(0, 60))]
    for _ in range(rng.randint(0, 3)):
        block, at = [str(rng.randint(1, k)) for _ in range(rng.randint(1, 15))], rng.randint(0, len(words))
        words[at:at] = [block[i % len(block)] for i in range(rng.randint(1, 90))]
    return words


@pytest.mark.parametrize(("least", "times"), [(24, 3), (6, 2), (10, 3), (2, 2), (30, 5)])
def test_runs_by_brute_force(spark, least, times):
    rng = random.Random(least)
    texts = [periodic_text(rng) for _ in range(400)] + [[], ["x"] * 3000]
    docs = spark.createDataFrame([(i, rng.choice([" ", "\n", "\t "]).join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    for r in periodic_runs.periodic_runs(docs, least, times).collect():
        words, want = texts[r.doc_id], plain_runs(texts[r.doc_id], least, times)
        assert [tuple(x) for x in r.runs] == want
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert r.collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)
        assert r.n_words == len(words)


def test_extensions_by_brute_force():
    rng = np.random.default_rng(2)
    for n, k in ((1, 1), (2, 1), (50, 1), (60, 2), (200, 3)):
        values = rng.integers(0, k, n)
        x, y = (a.ravel() for a in np.meshgrid(np.arange(n), np.arange(n)))
        x, y = x[x != y], y[x != y]
        if not len(x):
            continue
        far = [next((d for d in range(n) if max(a, b) + d >= n or values[a + d] != values[b + d]), 0) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
        assert periodic_runs.Extensions(values)(x, y).tolist() == far


def test_grid_in_slices(monkeypatch):
    words, first = np.tile(np.arange(9, dtype=np.uint64), 40), np.array([0, 100, 360])
    whole = periodic_runs.find_runs(words, first, 24, 3)
    monkeypatch.setattr(periodic_runs, "ASKED", 7)
    sliced = periodic_runs.find_runs(words, first, 24, 3)
    assert [a.tolist() for a in whole] == [a.tolist() for a in sliced] == [[0, 100], [100, 360], [9, 9]]


def test_planted_periods(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(i % 50))) for i in range(300)], "doc_id long, text string")
    from zlib import crc32

    texts = {r.doc_id: r.text for r in queries.with_planted_period(docs).collect()}
    for i in range(300):
        words, c = [f"w{i}x{j}" for j in range(i % 50)], crc32(str(i).encode())
        n, g = len(words), c // 10
        if c % 10 == 0 and n:
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        assert texts[i].split() == words
