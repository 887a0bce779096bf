"""Byte-level BPE ids from public vocabulary files, and token counts by section.

A rank file and a ``tokenizers`` file of one vocabulary give the same ids. The rank file is faster, so it is used, with
two exceptions that keep the ids: a text with two white-space characters in a row needs the full splitting pattern, and
a run of thousands of characters without a split goes to ``tokenizers``, whose merging does not slow down with length.
A text that holds the string of a special token goes to ``tokenizers`` too, which gives that token's one id.

A text is held whole, with its ids: about 20 bytes for each byte of the longest text, and 2 MB of shorter ones at a time.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

DOUBLE = re.compile(r"\s\s")
LONG = re.compile(r"\S{4000}|\s{4000}")
#: The part of the splitting pattern that only matters for runs of white space.
LOOKAHEAD = r"|\s+(?!\S)"


class Encoder:
    """Ids of texts, and the bytes of each id."""

    def __init__(self, name: str):
        import public_tokenizers as files
        import tiktoken

        self.json = files.path(f"{name}.json")
        with open(files.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        make = lambda pattern: tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.exact, self.quick = make(files.PATTERN), make(files.PATTERN.replace(LOOKAHEAD, ""))
        with open(self.json, "rb") as f:
            special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or r"(?!)")
        self.pieces = [b""] * (max([*ranks.values(), *special.values()]) + 1)
        for piece, i in [*ranks.items(), *((x.encode(), i) for x, i in special.items())]:
            self.pieces[i] = piece
        self.lengths = np.array([len(x) for x in self.pieces], np.int64)
        last, first = ([x[i] if x else 0 for x in self.pieces] for i in (-1, 0))
        self.line_end = np.array([x == 10 for x in last])
        self.stop = np.array([x in b".!?" for x in last])
        self.gap = np.array([x in b" \n\t\r\v\f" for x in first])

    @property
    def reference(self):
        if not hasattr(self, "_reference"):
            from tokenizers import Tokenizer

            self._reference = Tokenizer.from_file(self.json)
        return self._reference

    def ids(self, text: str) -> np.ndarray:
        if LONG.search(text) or self.special.search(text):
            return np.array(self.reference.encode(text, add_special_tokens=False).ids, np.uint32)
        encoding = self.exact if DOUBLE.search(text) else self.quick
        return encoding.encode_to_numpy(text, disallowed_special=())


@lru_cache(4)
def encoder(name: str) -> Encoder:
    """One for each worker."""
    return Encoder(name)


def _attribute(batches: Iterator[pa.RecordBatch], name: str, rule: str) -> Iterator[pa.RecordBatch]:
    coder = encoder(name)
    for batch in batches:
        for part in K.slices(batch):
            data, at = K.texts(part.column("text"))
            given = part.column("spans") if "spans" in part.schema.names else None
            out: dict[str, list[np.ndarray]] = {x: [] for x in ("row", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens")}
            for r in range(part.num_rows):
                own = data[at[r] : at[r + 1]]
                ids = coder.ids(part.column("text")[r].as_py() or "")
                ends = np.cumsum(coder.lengths[ids])
                begins = ends - coder.lengths[ids]
                chars = np.append(np.flatnonzero((own & 0xC0) != 0x80), len(own))  # first byte of each character
                if given is None:
                    breaks = np.flatnonzero(own == 10) + 1
                    start = np.concatenate([[0], breaks])
                    end = np.append(breaks, len(own))
                    if len(start) > 1 and start[-1] == len(own):  # the text ends with its last line
                        start, end = start[:-1], end[:-1]
                    section = np.arange(len(start))
                else:
                    spans = given[r].values
                    n = 0 if spans is None else len(spans)
                    section = spans.field("section").to_numpy(zero_copy_only=False) if n else np.zeros(0, np.int64)
                    start, end = (chars[np.clip(spans.field(x).to_numpy(zero_copy_only=False), 0, len(chars) - 1)] if n else np.zeros(0, np.int64) for x in ("start", "end"))
                # interval join on sorted spans of tokens: a token is a section's by its first byte, or by its middle byte
                mark = begins if rule == "start" else (begins + ends - 1) // 2
                low, high = np.searchsorted(mark, start), np.searchsorted(mark, end)
                crossing = sum(((x > 0) & (x < len(own)) & (begins[np.minimum(np.searchsorted(ends, x, "right"), max(0, len(ids) - 1))] < x) if len(ids) else np.zeros(len(x), bool)).astype(np.int64) for x in (start, end))
                m = len(section)
                for key, values in (("row", np.full(m, r)), ("section", section), ("start", np.searchsorted(chars, start)), ("end", np.searchsorted(chars, end)), ("n_tokens", np.maximum(high - low, 0)), ("n_crossing", crossing), ("doc_tokens", np.full(m, len(ids)))):
                    out[key].append(np.asarray(values, np.int64))
            flat = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(flat.pop("row"))), *map(pa.array, flat.values())], ["doc_id", *flat])


def token_counts(docs: DataFrame, spans: DataFrame | None = None, vocabulary: str = "byte_bpe_50k", rule: str = "start") -> DataFrame:
    """Tokens of each section: doc_id, section, start, end (code points), n_tokens, n_crossing (tokens over its two
    edges), doc_tokens.

    Each text is encoded once, whole, so a section's count is what it costs inside its document. Sections are the lines
    of a text with the line end that closes them, or rows of ``spans`` (doc_id, section, start, end in code points),
    which may overlap or leave gaps. A token that crosses an edge counts once: where its first byte is (``start``), or
    where its middle byte is (``middle``). With lines the counts of a document add up to doc_tokens.

    Null and empty texts have one empty line with 0 tokens. Spans beyond the text are cut to it; a null edge is taken as
    0. A document without spans gives no row; spans of unknown documents give none. Rows that share a doc_id are counted
    each. An empty table gives an empty result. Other columns are ignored.
    """
    if rule not in ("start", "middle"):
        raise ValueError(f"unknown rule {rule}")
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    if spans is not None:
        zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
        listed = spans.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct(zero("section").alias("section"), zero("start").alias("start"), zero("end").alias("end")))).alias("spans"))
        rows = rows.join(listed, "doc_id")
    return rows.mapInArrow(partial(_attribute, name=vocabulary, rule=rule), "doc_id long, section long, start long, end long, n_tokens long, n_crossing long, doc_tokens long")
