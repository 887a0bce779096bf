"""The training-data operators against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import bpe, chat, exact_dedup, kernels, language_id, merkle, mixing, near_dedup, packing, periodic_runs, quality, queries, split, substring_dedup, tokens, toxicity
from corvane.llm.components import components

from ..compare import same

DOCS = "doc_id long, text string, source string, mark string, digest string, size long, node long, component long"


def frame(spark, rows):
    """(doc_id, text[, source]); the further columns have names that operators use inside."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "s", "m", "d", 7, 8, 9) for r in rows], DOCS)


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "a"), (5, "a"), (None, "b c d e f g"), (6, "b c d e f g"), (7, "x" * 9000), (8, "y " * 6000), (9, "é ü ß 語"), (10, "<|im_end|> \\ <\\|")]

ROWS = {
    "mixing": lambda d: mixing.plan(d),
    "tokens": lambda d: tokens.token_counts(d),
    "quality": lambda d: quality.judge(d),
    "exact": lambda d: exact_dedup.deduplicate(d),
    "chat": lambda d: chat.read_chats(chat.format_chats(d.select(F.col("doc_id").alias("conv_id"), F.col("node").alias("turn"), F.col("mark").alias("role"), "text", "size"))),
    "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, d.select("doc_id", (F.col("doc_id") % 2).alias("toxic"), "size"))),
    "language": lambda d: language_id.identify(d.withColumn("lang", F.lit("en"))),
    "packing": lambda d: packing.pack(d),
    "substring": lambda d: substring_dedup.remove_repeats(d),
    "near": lambda d: near_dedup.near_duplicates(d),
    "merkle": lambda d: merkle.prove(merkle.manifest(merkle.leaves(d, ["doc_id", "text", "mark"], "source", "doc_id"))).withColumnRenamed("key", "doc_id"),
    "bpe": lambda d: bpe.decode(bpe.encode(d)),
    "runs": lambda d: periodic_runs.periodic_runs(d),
}


@pytest.mark.parametrize("name", ROWS)
def test_odd_rows_and_empty_tables(spark, name):
    assert ROWS[name](frame(spark, ODD).limit(0)).count() == 0
    got = ROWS[name](frame(spark, ODD)).count()
    if name == "chat":
        assert got == len({i for i, _ in ODD})
    else:
        assert got == len(ODD) if name not in ("packing", "tokens") else got >= len(ODD)


#: Names that operators use inside, some in another case.
CLASHING = "text_key position nth mix_id MIX_KEY copy kept_id kept_key gone_id node home digest own all file block window".split()


@pytest.mark.parametrize("name", ["mix", "exact", "near", "toxic", "pack"])
def test_clashing_names_are_kept(spark, name):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (None, "z y"), (None, "z y"), (4, "q r")]
    docs = frame(spark, rows).select("doc_id", "text", "source", *(F.lit(x).alias(x) for x in CLASHING))
    if name == "mix":
        got = mixing.mix(docs)
        assert got.columns == [*docs.columns, "position_"]
        plan = mixing.plan(docs).collect()
        assert got.count() == sum(r.copies for r in plan) > 0
        return
    if name == "pack":
        assert packing.pack(docs, order=["position"]).count() == len(rows)
        return
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = {"exact": exact_dedup.distinct_documents, "near": near_dedup.representatives, "toxic": lambda d: toxicity.clean_documents(d, labels)}[name](docs)
    assert got.columns == docs.columns
    assert all(r[x] == x for r in got.collect() for x in CLASHING)
    ids = sorted((r.doc_id for r in got.collect()), key=str)
    assert ids == {"exact": [1, 3, 4, None], "near": [1, 3, 4, None, None], "toxic": [1, 2, 2, 3, 4, None, None]}[name]


@pytest.mark.parametrize("name", sorted(set(ROWS) - {"chat"}))
def test_very_long_texts(spark, name):
    """A text of millions of characters is taken whole."""
    docs = spark.range(2).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(400_000)), lambda i: F.concat(F.lit("w"), F.pmod(i.cast("long") * i, F.lit(9973)).cast("string"))), " ").alias("text"), F.lit("m").alias("mark"), F.lit(7).alias("size"))
    got = ROWS[name](docs).collect()
    assert {r.doc_id for r in got} == {0, 1}
    if name == "quality":
        assert {r.n_words for r in got} == {400_000}
    if name == "near":
        assert {r.component_id for r in got} == {0}
    if name == "substring":
        assert sorted(r.n_removed for r in got) == [0, 400_000]
    if name == "packing":
        assert all(sum(r.length for r in got if r.doc_id == i) == next(r.doc_tokens for r in got if r.doc_id == i) for i in (0, 1))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(name, spark, data, duck):
    same(queries.QUERIES[name](spark, data), duck.sql(queries.ORACLE_SQL[name]).to_arrow_table())


# -- kernels


def test_words_and_windows():
    import pyarrow as pa

    texts = ["a b  a b", None, "", " a\tb\n", "é a"]
    w = kernels.words(pa.array(texts))
    expected = [x for t in texts for x in (t or "").encode().split()]
    assert [bytes(w.data[a:b]) for a, b in zip(w.start, w.end, strict=True)] == expected
    assert len(set(w.hash.tolist())) == len(set(expected))
    assert np.diff(w.first).tolist() == [4, 0, 0, 2, 2]
    g, whole = kernels.grams(w, 2)
    assert whole.tolist() == [True, True, True, False, True, False, True]
    assert g[0] == g[2] == g[4] != g[1]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)]
    home = {x: x for e in edges for x in e}

    def root(x):
        while home[x] != x:
            x = home[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        home[max(a, b)] = min(a, b)
    got = {r.member: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


# -- 1


def test_targets_stop_at_the_cap(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), (None, 500), ("c", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got["a"] == 20.0
    assert got["c"] == 0.0
    assert sum(got.values()) == pytest.approx(1.5 * 1510)
    # what is left is shared 2 to 5 (b, and null as the fourth source), under the caps of 2000 and 1000
    assert got[None] == pytest.approx(1000.0)
    assert got["b"] == pytest.approx(2265 - 20 - 1000)


def test_mix_follows_targets_and_positions(spark):
    rng = random.Random(2)
    docs = frame(spark, [(i, "w " * rng.randrange(1, 30), rng.choice("abbbb")) for i in range(400)])
    plan = mixing.plan(docs).collect()
    by = defaultdict(list)
    for r in plan:
        by[r.source_size].append(r)
        assert r.taken in (0, r.size, 2 * r.size)
        assert len(r.positions) == r.copies
        assert all(0 <= p <= 1 for p in r.positions)
    for rows in by.values():
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= max(r.size for r in rows)
    mixed = mixing.mix(docs).collect()
    assert Counter(r.doc_id for r in mixed) == {r.doc_id: r.copies for r in plan if r.copies}
    assert [r.position for r in mixed] == sorted(r.position for r in mixed)
    again = mixing.plan(docs.repartition(5)).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, plan), key=str)
    ordered = [r.first_position for r in mixing.schedule(docs, parts=3).collect() if r.first_position is not None]
    assert ordered == sorted(ordered)
    assert len(ordered) == sum(r.copies > 0 for r in plan)
    # the demand that a source has until a document's position is what lies before it
    tilts = dict(zip(sorted({"a", "b"}), (-0.5, 0.0), strict=True))
    source = {r.doc_id: r.source for r in docs.collect()}
    for name, tilt in tilts.items():
        own = sorted((p, r.size, r.target, r.source_size) for r in plan if source[r.doc_id] == name for p in r.positions)
        before = 0
        for p, size, target, _ in own:
            assert target * ((1 - tilt) * p + tilt * p * p) == pytest.approx(before, abs=1e-6)
            before += size


@pytest.mark.parametrize("tilts", [(-1.0, -1.0), (1.0, 0.5), (-0.5, 0.0), (0.0,)])
def test_parts_have_equal_numbers_of_words(spark, tilts):
    rng = random.Random(5)
    docs = frame(spark, [(i, "w " * rng.randrange(1, 9), rng.choice("aab")) for i in range(3000)])
    mixed = mixing.mix(docs, parts=8, tilts=tilts).select("position", F.spark_partition_id().alias("part"), mixing.size_of(F.col("text")).alias("size")).collect()
    words = Counter()
    for r in mixed:
        words[r.part] += r["size"]
    assert len(words) == 8
    assert max(words.values()) - min(words.values()) <= 60
    assert [r.position for r in mixed] == sorted(r.position for r in mixed)


def test_tilts_beyond_one_are_refused(spark):
    with pytest.raises(ValueError, match="between -1 and 1"):
        mixing.plan(frame(spark, [(1, "a")]), tilts=(1.5,))


def test_rows_without_id_are_spread(spark):
    docs = frame(spark, [(None, f"w {i}") for i in range(300)])
    plan = mixing.plan(docs).collect()
    assert len({r.positions[0] for r in plan}) == 300
    assert mixing.mix(docs).count() == sum(r.copies for r in plan)


# -- 2


TEXTS = ["", "hi", "<|im_end|>", "\\", "\\\\<|", "<\\|", "a\nb", "<", "|x", "<|turn|>", None, "\\n"]


def test_chats_round_trip(spark):
    rng = random.Random(3)
    turns = [(c, t, rng.choice(["user", "assistant", "sys\n\\n", None]), rng.choice(TEXTS)) for c in range(60) for t in range(rng.randrange(1, 9))]
    turns += [(None, 0, "user", "x"), (99, None, "user", "first"), (99, 1, "user", "tie"), (99, 1, "assistant", "tie")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    formatted = chat.format_chats(df)
    read = chat.read_chats(formatted).collect()
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in read}
    expected = defaultdict(list)
    for c, _, role, text in sorted(turns, key=lambda t: (str(t[0]), t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        expected[c].append((role or "", text or ""))
    assert got == expected
    assert {r.conv_id: r.loss for r in read} == {c: [t for role, t in rows if role == "assistant"] for c, rows in expected.items()}
    for r in formatted.collect():
        assert sum(m.length for m in r["mask"]) == len(r.formatted.encode())
    blocks = {r.conv_id: r.formatted.count("<|im_start|>") for r in formatted.collect()}
    for c, rows in expected.items():
        assert blocks[c] == 1 + sum(a[0] != b[0] for a, b in zip(rows, rows[1:], strict=False))
    assert chat.read_chats(chat.format_chats(df.limit(0))).count() == 0


def test_loss_is_what_lies_under_the_mask(spark):
    df = spark.createDataFrame([(1, 0, "user", "é hi"), (1, 1, "assistant", "yés"), (1, 2, "assistant", "<|no"), (1, 3, "user", "x")], "conv_id long, turn long, role string, text string")
    right = chat.format_chats(df)
    r = right.first()
    at, under = 0, []
    for m in r["mask"]:
        if m.loss:
            under.append(r.formatted.encode()[at : at + m.length].decode())
        at += m.length
    assert under == ["yés", "<\\|no"]
    assert chat.read_chats(right).first().loss == ["yés", "<|no"]
    wrong = right.withColumn("mask", F.transform("mask", lambda m: F.struct((m.length - m.loss.cast("long")).alias("length"), m.loss.alias("loss"))))
    assert chat.read_chats(wrong).first().loss != ["yés", "<|no"]


# -- 3


def reference():
    import public_tokenizers as files
    from tokenizers import Tokenizer

    return Tokenizer.from_file(files.path("byte_bpe_50k.json"))


def test_ids_are_the_reference_ids(data):
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{data}/documents.parquet").column("text").to_pylist()
    texts += ["", "  ", "a  b", "x\n\n\ny", "<|endoftext|>", "a <|endoftext|> b", "<|endoftext|", "it's  I'll", "語 é́  　 x", "z" * 5000, " " * 5000 + "q", " a\x1cb\x85"]
    ref, own = reference(), tokens.encoder("byte_bpe_50k")
    for t in texts:
        assert own.ids(t).tolist() == ref.encode(t, add_special_tokens=False).ids, t[:50]


def test_counts_add_up_and_spans_take_their_tokens(spark):
    text = "First line.\nSecond línea, longer\n\nend"
    docs = frame(spark, [(1, text), (2, None)])
    got = [r for r in tokens.token_counts(docs).orderBy("doc_id", "section").collect()]
    assert [text[r.start : r.end] for r in got if r.doc_id == 1] == ["First line.\n", "Second línea, longer\n", "\n", "end"]
    assert sum(r.n_tokens for r in got if r.doc_id == 1) == len(reference().encode(text, add_special_tokens=False).ids)
    assert [(r.start, r.end, r.n_tokens) for r in got if r.doc_id == 2] == [(0, 0, 0)]
    offsets = reference().encode(text, add_special_tokens=False).offsets
    spans = spark.createDataFrame([(1, 0, 0, 8), (1, 1, 8, 999), (1, 2, 3, 3), (5, 0, 0, 1)], "doc_id long, section long, start long, end long")
    got = {r.section: r for r in tokens.token_counts(docs, spans).collect()}
    assert got[0].n_tokens + got[1].n_tokens == len(offsets)
    assert got[2].n_tokens == 0
    assert set(got) == {0, 1, 2}
    inner = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 2, 37)], "doc_id long, section long, start long, end long")
    got = {r.section: r for r in tokens.token_counts(docs, inner).collect()}
    assert got[0].n_tokens == 1
    assert got[0].n_crossing == got[1].n_crossing == 1
    with pytest.raises(ValueError, match="rule"):
        tokens.token_counts(docs, rule="odd")


@pytest.mark.parametrize("rule", ["start", "middle"])
def test_token_spans_by_brute_force(spark, rule):
    """Every token of random texts against every span, overlapping ones too."""
    rng = random.Random(8)
    texts = {i: "".join(rng.choice(["word", " ", "  ", "é", "語", "\n", ".", "Longer", "x", "<|endoftext|>", "🙂"]) for _ in range(rng.randrange(60))) for i in range(40)}
    spans = [(i, k, *sorted((rng.randrange(len(t) + 3), rng.randrange(len(t) + 3)))) for i, t in texts.items() for k in range(5)]
    got = {(r.doc_id, r.section): r for r in tokens.token_counts(frame(spark, list(texts.items())), spark.createDataFrame(spans, "doc_id long, section long, start long, end long"), rule=rule).collect()}
    pieces, ref = tokens.encoder("byte_bpe_50k").pieces, reference()
    for i, k, start, end in spans:
        t = texts[i]
        low, high = (len(t[:x].encode()) for x in (start, end))
        n = crossing = at = 0
        ids = ref.encode(t, add_special_tokens=False).ids
        for x in ids:
            a, b = at, at + len(pieces[x])
            at = b
            n += low <= (a if rule == "start" else (a + b - 1) // 2) < high
            crossing += (a < low < b) + (a < high < b)
        assert at == len(t.encode())
        assert (got[i, k].n_tokens, got[i, k].n_crossing, got[i, k].doc_tokens) == (n, crossing, len(ids))


# -- 4


def test_counts_by_hand(spark):
    text = "a b c a b c\n\nx # y\nx # y\n  \nx # y "
    r = quality.judge(frame(spark, [(1, text)])).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines) == (15, 15, 3, 4, 1)
    words = text.split()
    grams = [tuple(words[i : i + 3]) for i in range(13)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    assert r.n_repeat_words == len(covered)
    assert r.base_failed
    assert "length" in r.failed


def test_workers_give_memory_back(monkeypatch):
    """After the last batch of a partition too, however small it is."""
    given = []
    monkeypatch.setattr(kernels, "release", lambda: given.append(True))
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a b c d e f", None]})
    assert sum(x.num_rows for x in near_dedup._sign(iter([batch]), 5, 64, 1)) == 2
    assert given == [True]


def test_rules_find_low_quality(spark, data):
    labels = spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/labels.parquet")
    docs = spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/documents.parquet")
    rows = quality.judge(docs).join(labels, "doc_id").where("not base_failed")
    kept = {(r.quality, r.kept): r["count"] for r in rows.groupBy("quality", "kept").count().collect()}
    assert kept.get((0, True), 0) == 0
    assert kept.get((1, False), 0) <= 0.01 * kept[(1, True)]


# -- 5


def test_collisions_are_settled_by_the_texts(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice([None, "", "a", " a", "a b", "ab", "c\n", "c", "d" * rng.randrange(3)])) for i in range(120)]
    weak = lambda c: (F.length(exact_dedup.normalised(c)) % 2).cast("string")
    for digest in (exact_dedup.digest, weak):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.deduplicate(frame(spark, docs), digest).collect()}
        groups = defaultdict(list)
        for i, t in docs:
            groups["".join((t or "").split())].append((-len(t or ""), i))
        for members in groups.values():
            keep = min(members)[1]
            for _, i in members:
                assert got[i] == (keep, len(members), i == keep)


@pytest.mark.parametrize("weak", [False, True])
def test_state_carries_over(spark, tmp_path, weak):
    """Each run answers for its rows against all earlier ones, also where digests collide; a repeated run counts once."""
    rng = random.Random(9)
    digest_of = (lambda c: (F.length(exact_dedup.normalised(c)) % 2).cast("string").cast("binary")) if weak else exact_dedup.digest
    state, seen = f"file://{tmp_path}/state", []
    for n, ids in enumerate((range(10, 20), range(0, 10), range(20, 30), range(30, 31))):
        rows = [(i, rng.choice(["a", "a ", "b", "ab", "a b", " c", "", None])) for i in ids]
        frame(spark, rows).repartition(2).write.parquet(f"{tmp_path}/{n}")
        seen += rows
        for _ in range(1 + (n == 1)):
            answer = exact_dedup.deduplicate(spark.read.parquet(f"{tmp_path}/{n}"), digest_of, state=state, run=f"run{n}").collect()
        groups = defaultdict(list)
        for i, t in seen:
            groups["".join((t or "").split())].append((-len(t or ""), i))
        assert len(answer) == len(rows)
        for r in answer:
            own = groups["".join((dict(seen)[r.doc_id] or "").split())]
            assert (r.keep_id, r.group_size) == (min(own)[1], len(own)), (n, r)


def test_state_needs_files(spark, tmp_path):
    with pytest.raises(ValueError, match="write the table to files"):
        exact_dedup.deduplicate(frame(spark, [(1, "a")]), state=f"file://{tmp_path}/state")
    assert not os.path.exists(f"{tmp_path}/state")


def test_a_run_reads_its_own_changes(spark, tmp_path, monkeypatch):
    """Ten runs into one state: each reads the changes of its own micro-batches, and no rows of earlier runs."""
    state, read = f"file://{tmp_path}/state", []
    real = exact_dedup.stream_groups
    monkeypatch.setattr(exact_dedup, "stream_groups", lambda *a: (read.append(real(*a).inputFiles()), real(*a))[1])
    monkeypatch.setattr(exact_dedup, "_earlier", None)
    monkeypatch.setattr(exact_dedup, "FILES", 2)
    for n in range(10):
        frame(spark, [(100 * n + i, f"text {i % 5} {n // 2}") for i in range(20)]).repartition(3).write.parquet(f"{tmp_path}/{n}")
        answer = exact_dedup.deduplicate(spark.read.parquet(f"{tmp_path}/{n}"), state=state).collect()
        assert {(r.keep_id, r.group_size) for r in answer} == {(n // 2 * 200 + i, 4 * (1 + n % 2)) for i in range(5)}
    folders = [{x.rsplit("/", 2)[1] for x in files} for files in read]
    assert all(len(x) == 1 for x in folders)
    assert len(set.union(*folders)) == 10


def test_state_is_closed_with_its_tasks(spark):
    """No store of a partition stays open in an executor once the stream is done."""
    held = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.execution.streaming.state.StateStore$").getDeclaredField("loadedProviders")
    held.setAccessible(True)
    runs = lambda: set(re.findall(r"queryRunId=([\w-]+)", held.get(None).toString()))
    before = runs()
    exact_dedup.deduplicate(frame(spark, [(i, f"text {i % 7}") for i in range(30)]))
    assert runs() <= before


def test_one_row_of_each_text_stays(spark):
    rows = frame(spark, [(1, "a"), (1, "a"), (2, " a"), (2, "a"), (3, None), (4, ""), (None, "z"), (None, "z")])
    got = exact_dedup.distinct_documents(rows)
    assert got.columns == rows.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(2, " a"), (3, None), (None, "z")], key=str)


# -- 6, 7


def test_language_of_held_out_documents(spark, data):
    docs = spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/documents.parquet")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_texts(spark):
    docs = frame(spark, [(i, t) for i, t in enumerate(["the cat and the dog", "le chat et le chien"] * 20)] + [(100, None), (101, "123 !!"), (102, "")]).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("fr"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs).collect()}
    assert got[100] == got[101] == got[102] == ("und", 0.0)
    assert (got[0][0], got[1][0]) == ("en", "fr")
    assert all(r.lang_pred == "und" for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect())


def test_filter_by_plain_sets(spark):
    """Every learned n-gram hits its languages, others hit by chance at the stated rate, and predictions follow from hits."""
    rng = random.Random(12)
    letters = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "mnopqrstuvé"}
    make = lambda lang, n: " ".join("".join(rng.choices(letters[lang], k=rng.randrange(2, 8))) for _ in range(n))
    rows = [(i, make(lang, 60), lang) for i, lang in enumerate(sorted(letters) * 12)]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 3", "aa"), (902, "zzzz", "bb")], "doc_id long, text string, lang string")
    model = language_id.fit(docs, per_language=1000, top=10_000, share=0.0, bits=14)

    def grams(text):
        b = bytes(language_id.FOLD[list((text or "").encode())].tolist())
        return [b[i : i + 4] for i in range(len(b) - 3) if b"  " not in b[i : i + 4]]

    def mask(gram):
        out = ~0
        for place in language_id._places(np.array([int.from_bytes(gram, "big")], np.uint32), 14):
            out &= int(model.masks[int(place[0]), 0])
        return out & 7

    known = {lang: {g for _, t, x in rows if x == lang for g in grams(t)} for lang in letters}
    for k, lang in enumerate(model.languages):
        assert all(mask(g) >> k & 1 for g in known[lang])
        strange = [bytes(rng.randrange(128, 256) for _ in range(4)) for _ in range(3000)]
        assert abs(np.mean([mask(g) >> k & 1 for g in strange]) - model.wrong[k]) < 0.02
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    for i, text, _ in [*rows, (902, "zzzz", "")]:
        own = grams(text)
        share = [min(1, max(0, (np.mean([mask(g) >> k & 1 for g in own]) - w) / (1 - w))) for k, w in enumerate(model.wrong)]
        best = int(np.argmax(share))
        assert got[i].lang_pred == model.languages[best]
        assert got[i].score == pytest.approx(share[best] / sum(share) if sum(share) else 0.0)
    assert got[900].lang_pred == got[901].lang_pred == "und"


def test_many_languages(spark):
    words = ["".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz", k=7)) for i in range(70)]
    docs = spark.createDataFrame([(i, (w + " ") * 5, f"l{i % 70:02d}") for i, w in enumerate(words * 4)], "doc_id long, text string, lang string")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) == len(got)


def test_toxicity_of_held_out_documents(spark, data):
    base = data.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").where(split.held_out(F.col("doc_id"))).collect()
    bad, good = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in bad for b in good])
    assert auc > 0.95
    assert np.mean(np.array(good) < toxicity.THRESHOLD) > 0.98


def test_scores_by_plain_noisy_or(spark):
    """Sentence by sentence, sign by sign, for any weights."""
    import re

    import pyarrow as pa

    rng = random.Random(13)
    words = ["Sun", "sunny", "rain", "a1", "é", "trees", "tree", "vile", "VILE", "x"]
    texts = {i: "".join(rng.choice(words) + rng.choice([" ", ", ", ". ", "!\n", "? ", "; "]) for _ in range(rng.randrange(25))) for i in range(40)} | {90: None, 91: "", 92: "..!"}
    low = lambda w: "".join(c.lower() if c.isascii() else c for c in w)
    of = lambda w: kernels.words(pa.array([w]), kernels.NON_ALNUM, kernels.LOWER, toxicity.STEM)
    whole, front = {w: int(of(w).hash[0]) for w in words}, {w: int(of(w).prefix[0]) for w in words}
    assert whole["vile"] == whole["VILE"]
    assert front["Sun"] != front["sunny"]
    assert front["trees"] == front["tree"]
    weight = {h: rng.uniform(-3, 3) for h in sorted({whole[w] for w in words[:7]} | {front[w] for w in words[3:]})}
    model = toxicity.Model(np.array(sorted(weight), np.uint64), np.array([weight[h] for h in sorted(weight)]), -1.5, 0.7)
    got = {r.doc_id: r for r in toxicity.score(frame(spark, list(texts.items())), model).collect()}
    for i, text in texts.items():
        clean, bad = 1.0, 0
        for sentence in re.split(r"[.!?\n]", text or ""):
            own = re.findall(r"[^\W_]+", sentence)
            if own:
                signs = {h for w in own for h in (whole[next(x for x in words if low(x) == low(w))], front[next(x for x in words if low(x) == low(w))])}
                p = 1 / (1 + np.exp(-(model.bias + sum(weight.get(h, 0.0) for h in signs))))
                clean *= 1 - p
                bad += p**model.power >= toxicity.THRESHOLD
        assert got[i].score == pytest.approx((1 - clean) ** model.power, abs=1e-9)
        assert len(got[i].offending) == bad


def test_ties_and_empty_tables_of_toxicity(spark):
    docs = frame(spark, [(i, "same words here") for i in range(40)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    scores = {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert len(scores) == 1
    model = toxicity.fit(docs.limit(0), labels)
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.clean_documents(docs.limit(0), labels).count() == 0


def test_offending_sentences_are_found(spark):
    rng = random.Random(5)
    fine = ["sun", "rain", "tree", "road", "song", "home"]
    rows, marks = [], []
    for i in range(160):
        s = [" ".join(rng.choices(fine, k=6)) for _ in range(5)]
        if i % 4 == 0:
            s[2] += " vile"
        rows.append((i, ". ".join(s)))
        marks.append((i, 1, int(i % 4 == 0)))
    docs, labels = frame(spark, [*rows, (900, None), (901, "")]), spark.createDataFrame([*marks, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all((got[i].score >= 0.3) == (i % 4 == 0) for i in range(160))
    assert [(o.start, o.end) for o in got[0].offending] == [(12, 19)]
    assert got[900].score == got[901].score == 0.0
    clean = toxicity.clean_documents(docs, labels)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {i for i in range(160) if i % 4} | {900, 901}
    assert all(r.score == 0 for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect())


# -- 8


def test_cuts_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(60):
        size = int(rng.choice([16, 24, 32, 64]))
        b = np.concatenate([[0], np.cumsum(rng.integers(1, size // 2, rng.integers(1, 25)))])
        p = rng.choice([0.0, 2.0, 9.0], len(b))
        pad = lambda n: 0 if n & (n - 1) == 0 else size - n  # noqa: B023, E731
        best = [0.0] + [np.inf] * (len(b) - 1)
        for j in range(1, len(b)):
            best[j] = min(best[i] + pad(b[j] - b[i]) + p[j] + 4 for i in range(j) if b[j] - b[i] <= size)
        c = packing.cuts(b, p, size)
        assert sum(pad(b[y] - b[x]) + p[y] + 4 for x, y in zip(c, c[1:], strict=False)) == pytest.approx(best[-1])


def test_pieces_rebuild_their_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()} | {-1: None, -2: "one " * 9000, -3: "w" * 9000}
    more = spark.createDataFrame([(i, t) for i, t in texts.items() if i < 0], "doc_id long, text string")
    rows = packing.pack(docs.select("doc_id", "text").union(more).coalesce(2)).collect()
    by, windows, ref = defaultdict(list), defaultdict(list), reference()
    for r in rows:
        by[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    assert set(by) == set(texts)
    for i, pieces in by.items():
        ids = np.array([*ref.encode(texts[i] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for pieces in windows.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.03 * total


def test_windows_follow_the_stored_order(spark, tmp_path):
    """Several files of uneven size, dealt to tasks by size: windows are numbered in the order in which rows were written."""
    rng = random.Random(10)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(1, 40 if i % 400 < 300 else 4000)))) for i in range(1200)]
    spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(9, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{tmp_path}/t")
    had = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        stored = packing.pack(spark.read.parquet(f"{tmp_path}/t"), size=256).collect()
        assert {r.doc_id for r in packing.pack(spark.read.parquet(f"{tmp_path}/t").repartition(3), size=256).collect()} == set(range(1200))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", had)
    mixed = spark.createDataFrame(rows, "doc_id long, text string").withColumn("position", F.col("doc_id") * 2).repartition(5)
    for got in (stored, packing.pack(mixed, size=256, order=["position"]).collect()):
        got = sorted(got, key=lambda r: (r.sequence_id, r.offset))
        assert [(r.doc_id, r.start) for r in got] == sorted((r.doc_id, r.start) for r in got)
        assert sorted({r.sequence_id for r in got}) == list(range(got[-1].sequence_id + 1))
        assert {r.doc_id for r in got} == set(range(1200))


def test_padding_without_sentence_ends(spark):
    """Cuts are free: texts of a little over half a window hardly pad."""
    rows = packing.pack(frame(spark, [(i, "one " * 1300) for i in range(60)]).coalesce(1)).collect()
    lengths = Counter()
    for r in rows:
        lengths[r.sequence_id] += r.length
    assert sum(2048 - n for n in lengths.values() if n & (n - 1)) <= 0.04 * sum(lengths.values())


def test_packing_costs_what_brute_force_finds(spark):
    """The query's windows over random texts: the least padding and penalties over all ways to cut at the allowed places."""
    rng = random.Random(14)
    ref, coder = reference(), tokens.encoder("byte_bpe_50k")
    for n in range(3):
        texts = ["".join(rng.choice(["one ", "two. ", "three! ", "\n", "four "]) for _ in range(rng.randrange(40))) for _ in range(12)]
        rows = packing.pack(frame(spark, list(enumerate(texts))).coalesce(1), size=32, sentence=2.0, hard=64.0).collect()
        at, cost, base = [0], [0.0], 0
        for t in texts:
            ids = ref.encode(t, add_special_tokens=False).ids
            pieces = [coder.pieces[i] for i in ids]
            stops = [k for k in range(1, len(ids)) if pieces[k - 1][-1:] == b"\n" or (pieces[k - 1][-1:] in (b".", b"!", b"?") and pieces[k][:1] in (b" ", b"\n"))]
            for a, b in zip([0, *stops], [*stops, len(ids) + 1], strict=True):
                # stretches of over a sixteenth of a window may be cut anywhere
                inner = range(a + 1, b) if b - a > 2 else []
                at += [*(base + k for k in inner), base + b]
                cost += [*(64.0 for _ in inner), 2.0 if b <= len(ids) else 0.0]
            base += len(ids) + 1
        pad = lambda x: 0 if x & (x - 1) == 0 else 32 - x
        price = dict(zip(at, cost, strict=True))
        best = {0: 0.0}
        for j in at[1:]:
            best[j] = min(best[i] + pad(j - i) + price[j] + 4 for i in range(max(0, j - 32), j) if i in best)
        got = Counter()
        for r in rows:
            got[r.sequence_id] += r.length
        ends = np.cumsum([got[k] for k in sorted(got)])
        assert sum(pad(got[k]) for k in got) + sum(price[int(e)] + 4 for e in ends) == pytest.approx(best[base]), n


# -- 9, 10


def corpus(n, seed, vocabulary=400):
    """Random prose with copies, near copies, shared passages, repeats inside a text and a very common line."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    passages = [[word() for _ in range(rng.choice([49, 50, 51, 80, 140]))] for _ in range(6)]
    line = [word() for _ in range(12)]
    out = []
    for i in range(n):
        kind = rng.randrange(7)
        if kind == 0 and out:
            words = list(rng.choice(out)[1])
            for _ in range(rng.randrange(8)):
                if words:
                    words[rng.randrange(len(words))] = word()
        else:
            words = [word() for _ in range(rng.choice([0, 2, 3, 30, 120, 300]))]
            if kind == 1:
                words[rng.randrange(len(words) + 1) :] += rng.choice(passages)
            if kind == 2:
                words += words[:70] + ["same"] * 120
        out.append((i, line + words if i % 3 else words))
    return [(i, " ".join(w) if i % 11 else "\n\t".join(w)) for i, w in out]


@pytest.mark.parametrize("seed", [0, 1])
def test_repeats_by_brute_force(spark, seed):
    rows = corpus(150, seed)
    seen, expected = {}, {}
    for i, text in rows:
        w = text.split()
        gone, own = set(), set()
        for k in range(len(w) - 49):
            window = tuple(w[k : k + 50])
            own.add(window)
            if window in seen:
                gone |= set(range(k, k + 50))
        for x in own:
            seen.setdefault(x, i)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        expected[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    docs = frame(spark, rows).repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == expected
    assert sum(x[1] for x in expected.values()) > 0


def shingles(text, size):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def near_components(rows, size):
    sets = {i: shingles(t, size) for i, t in rows}
    home = {i: i for i in sets}
    place = {x: k for k, x in enumerate({x for s in sets.values() for x in s})}
    bits = {i: sum(1 << place[x] for x in s) for i, s in sets.items()}

    def root(x):
        while home[x] != x:
            x = home[x]
        return x

    for a in sets:
        for b in sets:
            if b < a and sets[a] and sets[b]:
                both = (bits[a] & bits[b]).bit_count()
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    home[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


@pytest.mark.parametrize(("seed", "size"), [(0, 4), (1, 5)])
def test_near_duplicates_by_brute_force(spark, seed, size):
    rows = [(i, t.upper() if i % 5 == 0 else t) for i, t in corpus(160, seed)] + [(900, None), (901, ""), (902, "A b"), (903, "a B"), (904, "a b c")]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame(spark, rows).repartition(4), size=size).collect()}
    assert got == near_components(rows, size)


@pytest.mark.parametrize("direct", [0, 1 << 30])
@pytest.mark.parametrize("spread", [2, 6, 60, 10**6])
def test_collisions_by_brute_force(monkeypatch, direct, spread):
    """Merged lists with skips find the pairs that a comparison of whole signatures finds."""
    monkeypatch.setattr(near_dedup, "DIRECT", direct)
    rng = np.random.default_rng(spread)
    sign = rng.integers(0, spread, (90, 64))
    for i in range(0, 60, 3):  # copies that differ in some coordinates
        sign[i + 1] = np.where(rng.random(64) < rng.random(), sign[i], sign[i + 1])
    a, b = rng.permutation(90)[:50], rng.permutation(90)[:70]
    for matches in (1, 20, 32, 64):
        x, y = near_dedup._collisions(a, b, sign, matches)
        want = {(i, j) for i in a.tolist() for j in b.tolist() if (sign[i] == sign[j]).sum() >= matches}
        assert sorted(zip(x.tolist(), y.tolist(), strict=True)) == sorted(want)


def test_chained_groups_by_brute_force(spark):
    """Three thousand rows at the real sizes of blocks: dense groups of variants, chained by texts between two of them."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(5000)]
    base = [[rng.choice(words) for _ in range(60)] for _ in range(8)]
    rows = []
    for g in range(8):
        for _ in range(300):
            text = list(base[g])
            for _ in range(rng.randrange(3)):
                text[rng.randrange(60)] = rng.choice(words)
            rows.append(text)
    for g in range(0, 8, 2):  # from one group to the next, a few words at a time
        for k in range(0, 60, 2):
            rows.append(base[g + 1][:k] + base[g][k:])
    rows += [[rng.choice(words) for _ in range(rng.randrange(1, 60))] for _ in range(500)]
    rng.shuffle(rows)
    texts = [(i, " ".join(t)) for i, t in enumerate(rows)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame(spark, texts).repartition(8)).collect()}
    want = near_components(texts, 5)
    assert got == {i: tuple(x) for i, x in want.items()}
    assert len({x[1] for x in want.values()}) < len(rows) / 2


@pytest.mark.parametrize(("signs", "sparse"), [(16, 0), (16, 10**6), (2048, 2)])
def test_a_dense_group_of_variants(spark, signs, sparse):
    """Variants of one text, many of them too far from it to be linked: components as brute force finds them."""
    rng = random.Random(7)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(140):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(60)}"
        rows.append((i, " ".join(w)))
    names = {"BLOCK": 16, "SIGNS": signs, "SPARSE": sparse, "BATCH": 50}
    had = {x: getattr(near_dedup, x) for x in names}
    for x, v in names.items():
        setattr(near_dedup, x, v)
    try:
        got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(spark, rows), size=4).collect()}
    finally:
        for x, v in had.items():
            setattr(near_dedup, x, v)
    expected = {i: x[1] for i, x in near_components(rows, 4).items()}
    assert got == expected
    assert len(set(expected.values())) > 10


def test_representatives_keep_their_columns(spark):
    rows = frame(spark, [(1, "a b c d e f g"), (2, "A b c d e f g"), (3, "other"), (None, "a b c d e f g"), (4, None)])
    got = near_dedup.representatives(rows)
    assert got.columns == rows.columns
    assert {r.doc_id for r in got.collect()} == {1, 3, None, 4}


def test_unrelated_sets_do_not_meet(spark):
    """Minima of unrelated sets give different posting keys; equal minima give equal ones."""
    rng = random.Random(11)
    rows = [(i, " ".join(f"{rng.randrange(10**9)}" for _ in range(300))) for i in range(600)]
    rows += [(1000, rows[0][1]), (1001, rows[1][1] + " more words")]
    docs = frame(spark, rows).select("doc_id", "text")
    signed = docs.mapInArrow(lambda b: near_dedup._sign(b, 5, 64, 1), "doc_id long, n_shingles long, mark binary, sign array<long>").collect()
    held = Counter(k for r in signed for k in r.sign)
    both = len(set(signed[1].sign) & set(signed[601].sign))
    assert both >= 55
    assert sum(n > 1 for n in held.values()) == 64 + both
    # high and low halves are spread alike
    for shift in (0, 32):
        assert abs(np.mean([(k >> shift) & 0xFFFFFFFF for k in held]) / 2**32 - 0.5) < 0.01


def test_texts_of_one_document_are_one(spark):
    rows = [(3, "a b c d e f g"), (3, "other words stand here now"), (5, "a b c d e f g"), (4, "other words stand here now"), (9, "alone")]
    got = sorted((r.doc_id, r.component_id) for r in near_dedup.near_duplicates(frame(spark, rows), size=4).collect())
    assert got == [(3, 3), (3, 3), (4, 3), (5, 3), (9, 9)]
