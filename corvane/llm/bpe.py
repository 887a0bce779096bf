"""Byte-level BPE in which each distinct word of a corpus is encoded once, and decoding by a table of token bytes.

Texts are split into pre-tokens by the pattern that goes with the rank files; the classes of characters are asked from
``tiktoken`` itself, so its splits are matched whatever Unicode version it has. Pre-tokens are exploded with their
positions in blocks of several MB of text: a block lists its distinct words and, in order, which of them stands where.
The words are shuffled over the whole corpus by buckets of their hash. A bucket's words arrive together, each distinct one
is encoded once, and its ids are joined back to all blocks that have it; there, the pre-tokens of a text are put together by
position. A word has one row a block, so the most frequent word costs no more than others and no group grows with the
corpus. Decoding looks ids up in the vocabulary's table of token bytes, which is bounded by the vocabulary.

Blocks are made twice, for words and for positions, which costs less than a copy of all positions; a table that is not read
from files is stored first, so that both see the same rows.

Nulls and edge cases: null text is empty and has no ids. A text is held whole: about 150 bytes for each byte of the longest,
and blocks of ``BLOCK`` bytes of shorter ones. Rows that share or lack a doc_id are encoded each. Strings of special tokens
are ordinary text. An empty table gives an empty result. Other columns are ignored, whatever their names. Words are told
apart by 128 bits of hash. Unknown ids raise on decoding; null ids decode to no bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import keep

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK = 8 << 20
#: Buckets that the words of a corpus fall to: a task of encoding holds the distinct words of one.
BUCKETS = 1024
OTHER, LETTER, NUMBER, SPACE = range(4)
ROWS = "block long, bucket int, payload binary"


class Vocabulary:
    """Ids of single words by a rank file, and the bytes of each id."""

    def __init__(self, name: str):
        import public_tokenizers as files
        import tiktoken

        with open(files.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # a word is one piece here: it has been split already
        self.word = tiktoken.Encoding(name, pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pieces = [None] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.pieces[i] = piece


@lru_cache(4)
def vocabulary(name: str) -> Vocabulary:
    """One for each worker."""
    return Vocabulary(name)


@lru_cache(1)
def character_classes() -> np.ndarray:
    """Per code point its class, as the splitting pattern of ``tiktoken`` sees it."""
    import tiktoken

    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    single = {bytes([i]): i for i in range(256)}
    found = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        matched = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        found[_points(matched.decode_bytes(matched.encode_ordinary(every)))] = kind
    return found


def _points(data: bytes) -> np.ndarray:
    return np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)


class Pretokens(NamedTuple):
    start: np.ndarray  #: byte position of each pre-token in ``data``
    end: np.ndarray  #: byte position after it
    first: np.ndarray  #: per text, the index of its first pre-token; one more entry ends the last text
    data: np.ndarray  #: the texts' bytes


def pretokens(column: pa.Array) -> Pretokens:
    """Split texts as the pattern does: contractions; runs of letters, of numbers or of other signs, each with one space
    before it; white space, of which the last character before a word stands apart."""
    data, at = K.texts(column)
    lead = (data & 0xC0) != 0x80
    where = np.flatnonzero(lead)
    c = data if len(where) == len(data) else _points(data.tobytes())
    n, kind = len(c), character_classes()[c]
    begins = np.zeros(n + 1, bool)
    texts = np.searchsorted(where, at)
    begins[texts] = True
    space, gap = c == 32, kind == SPACE
    # neighbours inside the text
    same, after_gap, after_space, before_word = (np.zeros(n, bool) for _ in range(4))
    inside = ~begins[1:n]
    same[1:] = (kind[1:] == kind[:-1]) & inside
    after_gap[1:] = gap[:-1] & inside
    after_space[1:] = space[:-1] & inside
    before_word[:-1] = ~gap[1:] & inside
    head = np.where(gap, before_word | ~after_gap, ~same & ~after_space)
    # contractions: an apostrophe that begins a pre-token, and one or two letters
    quote = np.flatnonzero((c == 39) & head)
    if len(quote):
        stop = texts[np.searchsorted(texts, quote, "right")]
        one, two = (np.where(quote + k < stop, c[np.minimum(quote + k, n - 1)], 0) for k in (1, 2))
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = ~short & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        head[quote[short | long] + 1] = False
        rest = np.concatenate([quote[short] + 2, quote[long] + 3])
        rest_stop = np.concatenate([stop[short], stop[long]])
        head[rest[rest < rest_stop]] = True
    heads = np.flatnonzero(head)
    start = where[heads]
    return Pretokens(start, np.append(start[1:], len(data))[: len(start)], np.searchsorted(heads, texts), data)


def _hashes(w: Pretokens) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of 64 bits of each pre-token."""
    out, n = [], len(w.data)
    value = w.data.astype(np.uint64) + np.uint64(1)
    for base in (K.BASE, K.BASE2):
        up, down = K.powers(base, n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(value * up[:n], out=total[1:])
        out.append(K.mix((total[w.end] - total[w.start]) * down[w.start] + (w.end - w.start).astype(np.uint64) * np.uint64(K.BASE2)))
    return out[0], out[1]


def _squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned integers, byte by byte of their values, compressed."""
    head = np.array([x for a in arrays for x in (len(a), a.itemsize)], "<u4")
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(3).compress(np.array([len(arrays)], "<u4").tobytes() + head.tobytes() + b"".join(planes))


def _expanded(payload: bytes) -> list[np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8)
    n = int(data[:4].view("<u4")[0])
    head, at, out = data[4 : 4 + 8 * n].view("<u4").tolist(), 4 + 8 * n, []
    for length, size in zip(head[::2], head[1::2], strict=True):
        out.append(np.ascontiguousarray(data[at : at + length * size].reshape(size, length).T).reshape(-1).view(f"<u{size}"))
        at += length * size
    return out


def _codes(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per pre-token the number of its word, and per word a pre-token that is it."""

    def numbered(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = keys.dictionary_encode()
        codes = found.indices.to_numpy(zero_copy_only=False)
        one = np.zeros(len(found.dictionary), np.int64)
        one[codes[::-1]] = np.arange(len(codes))[::-1]
        return codes, one

    codes, one = numbered(pa.array(first))
    if (second[one][codes] != second).any():  # two words share the first hash
        both = np.stack([first, second], 1).tobytes()
        codes, one = numbered(pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(first), [None, pa.py_buffer(both)]))
    return codes, one


class _Block:
    """Texts of one block: their rows, and their pre-tokens by words numbered from the most frequent one."""

    def __init__(self, parts: list[tuple[pa.Array, Pretokens, np.ndarray, np.ndarray]], buckets: int):
        self.parts = parts
        self.doc_ids = pa.concat_arrays([p[0] for p in parts])
        self.counts = np.concatenate([np.diff(p[1].first) for p in parts])
        first, second = (np.concatenate([p[k] for p in parts]) for k in (2, 3))
        codes, one = _codes(first, second)
        order = np.argsort(-np.bincount(codes, minlength=len(one)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        self.codes, self.one = rank[codes], one[order]
        self.bucket = (first[self.one] % np.uint64(buckets)).astype(np.uint16)
        # of the words in their order: the same wherever the block is made
        self.mark = np.bitwise_xor.reduce(K.mix(first[self.one] + np.arange(len(self.one), dtype=np.uint64)), initial=0, keepdims=True)

    def words(self) -> list[bytes]:
        """By number."""
        out: list[bytes] = [b""] * len(self.one)
        ends = np.cumsum([len(p[1].start) for p in self.parts])
        part = np.searchsorted(ends, self.one, "right")
        for k, (_, w, _, _) in enumerate(self.parts):
            mine = np.flatnonzero(part == k)
            at = self.one[mine] - (ends[k] - len(w.start))
            data = w.data.tobytes()
            for i, a, b in zip(mine.tolist(), w.start[at].tolist(), w.end[at].tolist(), strict=True):
                out[i] = data[a:b]
        return out


def _blocks(batches: Iterator[pa.RecordBatch], buckets: int, most: int) -> Iterator[tuple[int, _Block]]:
    held, size, number = [], 0, None
    for batch in batches:
        if number is None and batch.num_rows:
            number = batch.column("part")[0].as_py() << 32
        for part in K.slices(batch):
            w = pretokens(part.column("text"))
            held.append((part.column("doc_id"), w, *_hashes(w)))
            size += len(w.data)
            if size >= most:
                yield number, _Block(held, buckets)
                held, size, number = [], 0, number + 1
                K.release()
    if held:
        yield number, _Block(held, buckets)


def _rows(block: list[int], bucket: list[int], payload: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(bucket, pa.int32()), pa.array(payload, pa.binary())], ["block", "bucket", "payload"])


def _words(batches: Iterator[pa.RecordBatch], buckets: int, most: int) -> Iterator[pa.RecordBatch]:
    """A row for each block and bucket: the block's words of that bucket, by their numbers."""
    for number, block in _blocks(batches, buckets, most):
        words, order = block.words(), np.argsort(block.bucket, kind="stable")
        held, starts = np.unique(block.bucket[order], return_index=True)
        payload = []
        for own in np.split(order, starts[1:]) if len(order) else []:
            mine = [words[i] for i in own.tolist()]
            payload.append(_squeezed(block.mark, np.array(list(map(len, mine)), "<u4"), np.frombuffer(b"".join(mine), np.uint8)))
        yield _rows([number] * len(held), held.tolist(), payload)


def _places(batches: Iterator[pa.RecordBatch], buckets: int, most: int) -> Iterator[pa.RecordBatch]:
    """A row for each block: its texts, and the numbers of their words in order."""
    for number, block in _blocks(batches, buckets, most):
        ids = block.doc_ids.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
        null = block.doc_ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
        yield _rows([number], [-1], [_squeezed(block.mark, ids, null, block.counts.astype("<u4"), block.codes, block.bucket)])


def _encode(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """Words to ids. Rows come sorted by bucket; a bucket's distinct words are encoded once."""
    encode, bucket, known = vocabulary(name).word, None, {}
    for batch in batches:
        out = []
        for own, payload in zip(batch.column("bucket").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            if own != bucket:
                bucket, known = own, {}
            mark, lengths, data = _expanded(payload)
            ends, data, ids = np.cumsum(lengths, dtype=np.int64).tolist(), data.tobytes(), []
            begin = 0
            for end in ends:
                word = data[begin:end]
                found = known.get(word)
                if found is None:
                    found = known[word] = encode(word.decode())
                ids.append(found)
                begin = end
            out.append(_squeezed(mark, np.array(list(map(len, ids)), "<u4"), np.array([i for x in ids for i in x], "<u4")))
        yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("bucket"), pa.array(out, pa.binary())], ["block", "bucket", "payload"])


def _spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices of ranges laid end to end."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


def _assemble(group: pa.Table) -> pa.Table:
    """The texts of a block with their ids: words by number, and pre-tokens by position."""
    bucket, payload = group.column("bucket").to_pylist(), group.column("payload").to_pylist()
    order = sorted(range(len(bucket)), key=bucket.__getitem__)
    mark, doc_ids, null, counts, codes, buckets = _expanded(payload[order[0]])
    replies = [_expanded(payload[i]) for i in order[1:]]
    lengths, ids = (np.concatenate([r[k] for r in replies]) if replies else np.zeros(0, "<u4") for k in (1, 2))
    if bucket[order[0]] != -1 or any(r[0][0] != mark[0] for r in replies) or len(lengths) != len(buckets):
        raise ValueError("texts were not read twice in the same order: store the table first")
    # replies come by bucket and number; words are wanted by number
    place = np.argsort(buckets, kind="stable")
    length, start = np.zeros((2, len(place)), np.int64)
    length[place], start[place] = lengths, np.cumsum(lengths, dtype=np.int64) - lengths
    flat = ids[_spans(start[codes], length[codes])]
    ends = np.concatenate([[0], np.cumsum(length[codes])])[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
    listed = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32)))
    K.release()
    return pa.Table.from_arrays([pa.array(doc_ids.view(np.int64), mask=null.astype(bool)), listed], ["doc_id", "ids"])


def encode(docs: DataFrame, name: str = "byte_bpe_multi_50k", buckets: int = BUCKETS, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: doc_id, ids (array<int>), by the rank file ``name`` as ``tiktoken`` gives them without special
    tokens.

    buckets: up to 65,536; more of them make an encoding task hold fewer distinct words. block: bytes of text in a block.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    try:
        docs.select("_metadata.file_path")
    except AnalysisException:
        rows = keep(rows, "bpe-texts")
    rows = rows.withColumn("part", F.spark_partition_id())  # of the table, wherever the task that reads it runs
    words = rows.mapInArrow(partial(_words, buckets=buckets, most=block), ROWS)
    known = words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(partial(_encode, name=name), ROWS)
    return known.union(rows.mapInArrow(partial(_places, buckets=buckets, most=block), ROWS)).groupBy("block").applyInArrow(_assemble, "doc_id long, ids array<int>")


def _decode(batches: Iterator[pa.RecordBatch], name: str, ids: str, out: str) -> Iterator[pa.RecordBatch]:
    pieces = vocabulary(name).pieces
    for batch in batches:
        column = batch.column(ids)
        flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        found = [b"".join(map(pieces.__getitem__, flat[a:b].tolist())) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield batch.append_column(out, pa.array(found, pa.large_binary()).cast(pa.binary()))


def decode(tokens: DataFrame, name: str = "byte_bpe_multi_50k", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``tokens`` with the bytes that its array of ids stands for."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields), f"`{out}` binary"])
    return tokens.mapInArrow(partial(_decode, name=name, ids=ids, out=out), schema)
