"""The rules on small fixtures with exact results."""

from __future__ import annotations

import json
import os
import re
import statistics as py
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions import json5, labels, nested, plans, text
from corvane.operators import agreement, evaluation, export, index, mining, relational, sampling, statistics, vectors
from corvane.plans import annotate, calibrate, checks, models, planning
from corvane.plans.models import HashEmbedder, RuleCompleter, ask, embed
from corvane.queries import ORACLE_SQL, QUERIES
from corvane.sources import arrow_files, readers, sinks
from corvane.streaming import index_build

from .compare import same
from .conftest import DATA


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


# -- functions


@pytest.mark.parametrize(("raw", "n"), [(None, 0), ("", 0), ("   ", 0), ("a  b\tc\n", 3), ("a b", 2)])
def test_word_count(spark, raw, n):
    assert one(spark, text.word_count(F.lit(raw).cast("string"))) == n


def test_content_tokens(spark):
    assert one(spark, text.content_tokens(F.lit("The THAT it's well-known Well-Known ab about cats"))) == ["the", "it's", "well-known", "cats"]


def test_alignment_takes_the_best_aspect(spark):
    got = text.alignment(F.lit("red cats sleep"), F.lit("cats run"), F.array(F.lit("a"), F.lit("b"), F.lit("none")), F.create_map(F.lit("a"), F.lit("red"), F.lit("b"), F.lit("red sleep")))
    assert one(spark, got) == 3


def test_head_and_tail(spark):
    assert one(spark, text.head_and_tail(F.lit("a  b " * 3), 100)) == "a b a b a b"
    assert one(spark, text.head_and_tail(F.lit("x" * 30), 15)) == "x" * 7 + " ... " + "x" * 3
    assert one(spark, text.head_and_tail(F.lit("x" * 30), 6)) == "x" * 6


@pytest.mark.parametrize(("raw", "rel"), [("TRUE", 1), ("no", 0), ("2.7", 2), ("junk", 1), (None, 1), ("0", 0)])
def test_relevance(spark, raw, rel):
    assert one(spark, labels.relevance(F.lit(raw).cast("string"))) == rel


@pytest.mark.parametrize(("score", "stated", "out"), [("2", None, "pass"), ("1", "pass", "fail"), ("x", "fail", "fail"), (None, None, "pass")])
def test_verdict(spark, score, stated, out):
    assert one(spark, labels.verdict(F.lit(score).cast("string"), F.lit(stated).cast("string"))) == out


def test_case_folding(spark):
    raw = ["Straße ẞ", "ΣΊΣΥΦΟΣ ς", "ﬁn oﬃce", "İstanbul ı", "ŉ ǰ և", "ſ K Å", "🙂ß🙂", "ᾳ ᾼ", "plain", "", "ßß"]
    got = [r.t for r in spark.createDataFrame(list(enumerate(raw)), "i int, x string").orderBy("i").select(text.casefold(F.col("x")).alias("t")).collect()]
    assert got == [x.casefold() for x in raw]


#: JSON5 texts and their values; None where there is none.
JSON5 = [
    ('{"query": "is [1,2,] a list, }"}', {"query": "is [1,2,] a list, }"}),
    ("{'q': 'say \\'no\\', // not a comment'}", {"q": "say 'no', // not a comment"}),
    ("{'q': \"/* not a comment */\"}", {"q": "/* not a comment */"}),
    ("{a: 1, /* c */ b: [2,], // d\n}", {"a": 1, "b": [2]}),
    ("/* a */ [1] // b", [1]),
    ("// only\n{}", {}),
    ("/* ** / */1", 1),
    ("[1,2,]", [1, 2]),
    ("{a: {b: {},},}", {"a": {"b": {}}}),
    ("[[],[[]],]", [[], [[]]]),
    ("[,]", None),
    ("[1,,2]", None),
    ("{,}", None),
    ("{a: 1 b: 2}", None),
    ("{a}", None),
    ("[1", None),
    ("{", None),
    ("", None),
    ("  ", None),
    ("1 2", None),
    ("/* open", None),
    ("0x1F", 31),
    ("-0XaB", -171),
    ("0x", None),
    ("+1", 1),
    ("+-1", None),
    (".5", 0.5),
    ("-.5e1", -5.0),
    ("5.", 5.0),
    ("1e3", 1000.0),
    ("1E-2", 0.01),
    (".", None),
    ("01", None),
    ("1_000", None),
    ("12345678901234567890", 12345678901234567890),
    ("[Infinity, -Infinity, +Infinity]", [float("inf"), float("-inf"), float("inf")]),
    ("true", True),
    ("[false, null]", [False, None]),
    ("True", None),
    ("nul", None),
    ("undefined", None),
    ("'single'", "single"),
    ("'\"'", '"'),
    ('"\'"', "'"),
    ('"a\\\nb"', "ab"),
    ('"a\\\r\nb"', "ab"),
    ('"a\nb"', None),
    ("'open", None),
    ('"open', None),
    ('"\\x41\\u0042\\0"', "AB\0"),
    ('"\\b\\f\\n\\r\\t\\v\\\\\\/"', "\b\f\n\r\t\v\\/"),
    ('"\\q\\-"', "q-"),
    ('"\\01"', None),
    ('"\\1"', None),
    ('"\\x4"', None),
    ('"\\u12"', None),
    ('"\\ud83d\\ude00"', "\U0001f600"),
    ("'\\ud83d'", "\ufffd"),
    ("{$a_1: 1, \\u0062: 2, ñ: 3}", {"$a_1": 1, "b": 2, "ñ": 3}),
    ("{1a: 1}", None),
    ("{'a': 1, a: 2}", {"a": 2}),
    ("\ufeff\u00a0\u3000{}", {}),
    ("'\u2028'", "\u2028"),
    ("[" * 500 + "]" * 500, "deep"),
    ("```json\n{'a': [1,],}\n```", {"a": [1]}),
    ("```\n[1]\n```", [1]),
    ("Sure:\n```json\n{\"a\": \"```\"}\n``` done", {"a": "```"}),
    ('{"a": "```json 1```"}', {"a": "```json 1```"}),
    ("```\nnot this\n``` but ```json5\n{b: 2}\n```", {"b": 2}),
    ("```json\n{a: 1} more\n```", None),
    ("no value", None),
]


def test_json5_texts(spark):
    assert len(JSON5) > 60
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(JSON5)] + [(-1, None)], "i int, t string").repartition(3)
    got = {r.i: (r.s, r.p) for r in rows.select("i", json5.strict_json(F.col("t")).alias("s"), json5.json_problem(F.col("t")).alias("p")).collect()}
    assert got[-1] == (None, "no answer")
    for i, (t, value) in enumerate(JSON5):
        strict, problem = got[i]
        if value == "deep":
            assert json.loads(strict)
        elif value is None and t != "null":
            assert (t, strict) == (t, None)
            assert problem
        else:
            assert (t, json.loads(strict)) == (t, value)
            assert problem is None


def test_lenient_json(spark):
    raw = "```json\n{'a': 1, /* c */ b: ['x ,]', 'y // z',],}\n```"
    got = one(spark, text.lenient_json(F.lit(raw), "a int, b array<string>"))
    assert (got.a, got.b) == (1, ["x ,]", "y // z"])


def test_strict_json_stays_as_it_is(spark):
    assert one(spark, json5.strict_json(F.lit('{"a":   "[1,]"}'))) == '{"a":   "[1,]"}'


@pytest.mark.parametrize(("raw", "found"), [('x {"a": {"b": 1}}', '{"a": {"b": 1}}'), ('{"a": 1} {"b": 2} }', None), ('{"a": 1} {b: [2,],} {', "{b: [2,],}"), ("none", None), (None, None), ('{"a": 1', None)])
def test_last_balanced(raw, found):
    assert nested.last_balanced(raw) == found


def test_document_text(spark, duck, tmp_path):
    """Parts that are null, empty, blank, or in white space of Unicode."""
    parts = [None, "", "  ", " a ", "\u00a0b\u3000", "\u2003 ", "\tc\n", "\u200bd"]
    rows = [(i * 3 + j if i % 5 else -i * 3 - j, source, t) for i, (source, t) in enumerate((x, y) for x in parts for y in parts) for j in (0, 1)]
    spark.createDataFrame([*rows, (None, "e", "f")], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    same(QUERIES["p02_document_text"](spark, str(tmp_path)), duck.sql(f"WITH documents AS (SELECT * FROM '{tmp_path}/documents.parquet/*.parquet') {ORACLE_SQL['p02_document_text']}").to_arrow_table())
    assert [one(spark, text.document_text(*map(F.lit, x))) for x in ((" ", "t", "\u00a0"), (None, None, "x "), ("", "t ", "x"), (" d", "t", "x"))] == ["t", "x", "t\nx", "d"]


def test_flat_text():
    assert nested.flat_text({"n": 1, "text": " b ", "title": "a"}) == "a\nb"
    assert nested.flat_text({"n": 1, "m": ["x", None, ""]}) == "n: 1\nm: x"


def test_valid_plan_needs_every_dimension(spark):
    known = F.array(F.struct(F.lit("a").alias("dimension"), F.array(F.lit("1")).alias("options")), F.struct(F.lit("b").alias("dimension"), F.array(F.lit("2")).alias("options")))
    ids = F.array(F.lit("i"))
    full = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    assert one(spark, plans.valid_plan(ids, full, ids, known)) is True
    assert one(spark, plans.valid_plan(ids, F.create_map(F.lit("a"), F.lit("1")), ids, known)) is False
    assert one(spark, plans.valid_plan(F.array(F.lit("i"), F.lit("j")), full, ids, known)) is False


# -- relational


def test_resolve_takes_the_last_text_and_skips_unknown_ids(spark):
    c = F.from_json(F.lit('[{"doc_id":"a","doc":"1"},{"doc_id":"b","doc":"2"},{"doc_id":"a","doc":"3"}]'), "array<struct<doc_id:string,doc:string>>")
    assert one(spark, relational.resolve(F.array(F.lit("b"), F.lit("x"), F.lit("a")), c)) == ["2", "3"]


@pytest.mark.parametrize(("n", "parts"), [(10, 3), (2, 5), (7, 7), (0, 2)])
def test_tiles_are_even_and_in_order(spark, n, parts):
    got = [r.part for r in relational.tiled(spark.range(n), ["id"], parts).orderBy("id").collect()]
    assert got == sorted(got)
    sizes = [got.count(i + 1) for i in range(parts)]
    assert sizes == [n // parts + (i < n % parts) for i in range(parts)]


def test_numbers_follow_the_order(spark):
    rows = relational.numbered(spark.range(1000).repartition(7), [F.desc("id")], "n").collect()
    assert all(r.n == 1000 - r.id for r in rows)


def test_merge_batches_refuses_other_headers(spark):
    with pytest.raises(ValueError, match="headers"):
        relational.merge_batches(({"n": 1}, spark.range(1)), ({"n": 2}, spark.range(1)))


def test_violations(spark):
    rows = spark.createDataFrame([(1, "a", 0), (2, " ", 3), (2, "b", None)], "id int, t string, i int").withColumn("options", F.array(F.lit("x")))
    got = {tuple(r) for r in relational.violations(rows, "id", ["t"], {"i": "options"}).collect()}
    assert got == {(2, "blank t"), (2, "index out of range"), (2, "duplicate id")}


# -- exports


def annotated(spark, pos, hard, easy):
    c = [(i, f"t{i}") for i in "abcdef"]
    scores = [("a", 3), ("b", 2), ("gone", 3)]
    return spark.createDataFrame([(1, " q ", c, scores, pos, hard, easy)], "query_id long, query string, candidates array<struct<doc_id: string, doc: string>>, annotations array<struct<doc_id: string, score: int>>, positive_doc_ids array<string>, hard_negative_doc_ids array<string>, easy_negative_doc_ids array<string>")


def records(df):
    return [(r.query, r.pos, r.neg) for r in df.collect()]


def test_exports(spark):
    rows = annotated(spark, ["a", "b"], ["c"], ["d", "e", "f"])
    assert records(export.positives_and_hard(rows)) == [("q", ["ta", "tb"], ["tc"])]
    assert records(export.hard_else_easy(rows)) == [("q", ["ta", "tb"], ["tc"])]
    assert records(export.hard_filled(rows, 3)) == [("q", ["ta", "tb"], ["tc", "td", "te"])]
    assert records(export.hard_filled(rows, 9)) == [("q", ["ta", "tb"], ["tc", "td", "te", "tf"])]
    assert records(export.score_three(rows)) == [("q", ["ta"], ["tc"])]
    none = annotated(spark, ["x"], [], ["d"])
    assert records(export.hard_else_easy(none)) == []
    assert export.outcome(none).first().outcome == "skip_pos_empty"
    assert records(export.hard_else_easy(annotated(spark, ["a"], [], ["d"]))) == [("q", ["ta"], ["td"])]


def test_median_split_wraps_around(spark):
    rows = spark.createDataFrame([("q1", ["a", "b"], ["n"]), ("q2", ["c", "d"], ["n"]), ("q3", ["e"], ["n"])], "query string, pos array<string>, neg array<string>")
    batch = spark.createDataFrame([("q1", "b", 1), ("q9", "z", 2)], "query string, doc string, position int")
    got = sorted((r.query, r.split, r.pos[0]) for r in export.median_split(rows, batch, "position").collect())
    assert got == [("q1", 0, "b"), ("q1", 1, "a"), ("q2", 0, "c"), ("q2", 1, "d"), ("q3", 0, "e"), ("q3", 1, "e")]


def test_origin_filter_is_idempotent(spark):
    rows = spark.createDataFrame([(1, "q1", ["a", "b"], ["n"]), (2, "q2", ["c"], ["n"])], "query_id int, query string, pos array<string>, neg array<string>")
    batch = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 2)], "query string, doc string, position int")
    once = export.origin_only(rows, batch, "position", keep_others=True)
    assert sorted(records(once)) == [("q1", ["b"], ["n"]), ("q2", ["c"], ["n"])]
    assert sorted(records(export.origin_only(once, batch, "position", keep_others=True))) == sorted(records(once))
    assert records(export.origin_only(rows, batch, "position", keep_others=False)) == [("q1", ["b"], ["n"])]


# -- mining


def test_branches_and_negatives(spark):
    c = spark.createDataFrame([(q, f"q{q}", d, f"t{d}", s, r) for q, top in ((1, 0.9), (2, 0.5)) for r, (d, s) in enumerate([(10, top), (11, 0.5), (12, 0.48), (13, 0.2)], 1)], "query_id long, query string, doc_id long, doc string, score double, rank int")
    o = spark.createDataFrame([(1, 10, "t10", 0.9), (2, 10, "t10", 0.5)], "query_id long, doc_id long, doc string, pos_score double")
    got = {r.query_id: r.branch for r in mining.branches(c, o, 2).collect()}
    assert got == {1: "B", 2: "A"}
    neg = {(r.query_id, r.doc_id) for r in mining.negatives(c, o, 1, 2, 5).collect()}
    assert neg == {(1, 11), (1, 12), (1, 13), (2, 11)}


# -- samples


def test_nested_samples_are_prefixes(spark):
    rows = sampling.nested(spark.range(200).withColumnRenamed("id", "k"), [10, 30], 1, "k").collect()
    small = {r.k for r in rows if r.place <= 10}
    assert small == {r.k for r in sampling.sample(spark.range(200).withColumnRenamed("id", "k"), 10, 1, "k").collect()}
    assert len(rows) == 30
    assert all(r.smallest == (10 if r.place <= 10 else 30) for r in rows)


def test_bad_specs_give_all_rows(spark):
    assert sampling.closed_range(spark.range(5), ["id"], "x").count() == 5
    assert sampling.index_list(spark.range(5), ["id"], []).count() == 5
    assert sampling.sample(spark.range(5), 9, 1, "id").count() == 5


# -- vectors


def vector_rows(spark, n, size, seed):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, size))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    return m, spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "doc_id long, embedding array<float>")


def test_blocks_agree_with_expressions(spark):
    _, corpus = vector_rows(spark, 60, 8, 0)
    queries = corpus.where("doc_id % 10 = 0").withColumnRenamed("doc_id", "query_id")
    key = lambda df: {(r.query_id, r.doc_id, r["rank"]) for r in df.collect()}
    # the definition that the block form is held to
    rows = queries.withColumnRenamed("embedding", "q").crossJoin(corpus).withColumn("score", vectors.dot(F.col("q"), F.col("embedding")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    plain = rows.withColumn("rank", F.row_number().over(order)).where("rank <= 7")
    assert key(vectors.dense_top_k(queries, corpus.repartition(5), 7)) == key(plain)


def test_top_k_of_copies_and_wide_k(spark, monkeypatch):
    """Equal vectors have equal scores wherever they stand, so ties go by id; any k, also one that keeps nothing back."""
    rng = np.random.default_rng(5)
    m = np.concatenate([np.repeat(rng.normal(size=(9, 7)), 23, 0), np.zeros((5, 7)), rng.normal(size=(40, 7))]).astype(np.float32)
    ids = rng.permutation(len(m))
    corpus = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, m, strict=True)], "doc_id long, embedding array<float>").repartition(3)
    queries = corpus.where("doc_id % 10 = 0").withColumnRenamed("doc_id", "query_id")
    monkeypatch.setattr(vectors, "TILE_QUERIES", 5, raising=False)
    monkeypatch.setattr(vectors, "TILE_ROWS", 16, raising=False)
    by_id = {int(i): [float(x) for x in v] for i, v in zip(ids, m, strict=True)}

    def plain(q, k, metric):
        scores = []
        for i, v in by_id.items():
            total = 0.0
            for x, y in zip(by_id[q], v, strict=True):
                total += x * y if metric == "inner" else -((x - y) * (x - y))
            scores.append((-total, i))
        return [(q, i, n, -s) for n, (s, i) in enumerate(sorted(scores)[:k], 1)]

    for k, kept, metric in [(7, 8192, "inner"), (30, 8192, "euclidean"), (30, 4, "inner"), (1000, 8192, "inner"), (1_000_000_000, 8192, "euclidean")]:
        monkeypatch.setattr(vectors, "MOST_KEPT", kept, raising=False)
        got = sorted((r.query_id, r.doc_id, r["rank"], r.score) for r in vectors.dense_top_k(queries, corpus, k, metric).collect())
        assert got == sorted(x for q in by_id if q % 10 == 0 for x in plain(q, k, metric))
    assert vectors.dense_top_k(queries, corpus, 0).count() == 0


@pytest.fixture(scope="module")
def many_vectors(tmp_path_factory):
    """8,000 vectors beside the other tables; 400 of them are queries."""
    d = tmp_path_factory.mktemp("vectors")
    for f in os.listdir(DATA):
        if f != "embeddings.parquet":
            os.symlink(f"{DATA}/{f}", d / f)
    m = np.random.default_rng(6).normal(size=(8000, 64)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(8000), "embedding": list(m), "label": pa.array(np.arange(8000) % 10, pa.int32())}), d / "embeddings.parquet")
    return str(d)


#: Queries over scores of all vectors, whose worker must not hold the scores of a batch, or of a partition, at once.
BOUNDED = ["j14_all_pairs", "n04_branch_a", "d06_outcomes", "d01_export_hard", "a19_ndcg", "a21_map", "d02_export_hard_else_easy", "n11_calibration", "a20_recall", "a24_judged_rates", "n05_branch_b", "l08_candidate_annotator", "d04_export_score_three", "l06_query_to_passage", "k06_trec_run", "a22_mrr", "n12_draft_pools", "n03_pool", "d11_queries_of_sample", "n09_annotate_queries", "d07_origin_only"]


@pytest.mark.parametrize("name", BOUNDED)
def test_scores_are_held_a_tile_at_a_time(spark, many_vectors, name, monkeypatch):
    """Scores of the batch with all queries are 26 MB; a worker gets by with less than that, beside its input."""
    monkeypatch.setattr(vectors, "TILE_QUERIES", 64, raising=False)
    monkeypatch.setattr(vectors, "TILE_ROWS", 256, raising=False)
    kernels, frame = [], type(spark.range(1))
    plain = frame.mapInArrow

    def watched(df, kernel, schema, *more):
        kernels.append(kernel)
        return plain(df, kernel, schema, *more)

    monkeypatch.setattr(frame, "mapInArrow", watched)
    QUERIES[name](spark, many_vectors)
    rows = pq.read_table(f"{many_vectors}/embeddings.parquet").select(["vec_id", "embedding"]).rename_columns(["doc_id", "embedding"])
    batch = rows.combine_chunks().to_batches()[0]
    tracemalloc.start()
    try:
        for _ in kernels[0](iter([batch])):
            pass
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 20e6


@pytest.mark.parametrize("name", ["t01_dense_top_k", "j14_all_pairs", "d06_outcomes"])
def test_scoring_is_dealt_to_all_tasks(spark, many_vectors, name, monkeypatch):
    """One file of one row group is scored by as many tasks as can run, each with its share of the rows."""
    scored, frame = [], type(spark.range(1))
    plain = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda df, *more: scored.append(df) or plain(df, *more))
    QUERIES[name](spark, many_vectors)
    sizes = [r["count"] for r in scored[0].groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 8000
    assert len(sizes) == spark.sparkContext.defaultParallelism
    assert max(sizes) < 2 * 8000 / len(sizes)


def test_diverse_selection_is_greedy(spark):
    import hashlib

    m, corpus = vector_rows(spark, 80, 5, 1)
    got = {r.doc_id for r in vectors.diverse(corpus.repartition(6), 0.5).collect()}
    m = m.astype(np.float32).astype(np.float64)
    kept: list[int] = []
    for i in sorted(range(len(m)), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i)):
        if all(m[i] @ m[j] <= 0.5 for j in kept):
            kept.append(i)
    assert got == set(kept)


@pytest.mark.parametrize(("cells", "threshold"), [(1, 0.4), (7, 0.4), (60, 0.9), (7, -0.2)])
def test_neighbours_by_brute_force(spark, cells, threshold, monkeypatch):
    """Clusters, copies, a zero vector and vectors of any length; cells are cut into blocks."""
    rng = np.random.default_rng(3)
    m = np.concatenate([rng.normal(size=(60, 4)), np.repeat(rng.normal(size=(4, 4)), 20, 0), np.zeros((1, 4)), rng.normal(size=(40, 4)) * 0.1 + 3])
    m[:90] /= np.linalg.norm(m[:90], axis=1, keepdims=True)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    rows = spark.createDataFrame([*((i, [float(x) for x in v]) for i, v in enumerate(m)), (None, [1.0] * 4), (999, None)], "doc_id long, embedding array<double>").repartition(5)
    got = sorted((r.a, r.b) for r in vectors.neighbours(rows, threshold, cells).collect())
    assert got == sorted((i, j) for i in range(len(m)) for j in range(i + 1, len(m)) if m[i] @ m[j] > threshold)
    assert vectors.neighbours(rows.limit(0), threshold).count() == 0


def odd_vectors(spark, path):
    """Copies, a zero vector, NaN, infinite and long ones, scores at the threshold, and rows without a vector."""
    rng = np.random.default_rng(4)
    m = np.concatenate([rng.normal(size=(120, 4)), np.repeat(rng.normal(size=(3, 4)), 30, 0), [[0.0] * 4, [0.5, 0, 0, 0], [0.6, 0, 0, 0], [np.nan, 0, 0, 0], [np.inf, 1, 1, 1], [1e4, 0, 0, 1]]])
    m[:210] /= np.linalg.norm(m[:210], axis=1, keepdims=True)
    rows = [*((i, [float(x) for x in v]) for i, v in enumerate(m)), (500, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return f"WITH embeddings AS (SELECT * FROM '{path}/embeddings.parquet/*.parquet') SELECT * FROM ("


@pytest.mark.parametrize("name", ["j15_neighbour_pairs", "v06_all_neighbours", "v03_diverse_selection", "v03_diverse_target"])
def test_neighbours_of_odd_vectors(spark, duck, tmp_path, monkeypatch, name):
    before = odd_vectors(spark, str(tmp_path))
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 40)
    monkeypatch.setattr(vectors, "CELL_ROWS", 25)
    monkeypatch.setattr(vectors, "FIRST_ROWS", 20)
    same(QUERIES[name](spark, str(tmp_path)), duck.sql(f"{before}{ORACLE_SQL[name]})").to_arrow_table())


@pytest.mark.parametrize("copies", [False, True])
def test_neighbours_leave_workers_in_bounded_batches(spark, monkeypatch, copies):
    """Though all cells are open to all rows, and though all rows are near each other."""
    m, corpus = vector_rows(spark, 4000, 8, 5)
    if copies:
        corpus = corpus.withColumn("embedding", F.array(*[F.lit(0.5).cast("float")] * 8))
    seen = []
    frame, group = type(corpus), type(corpus.groupBy())
    deal, join = frame.mapInArrow, group.applyInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda df, f, *more: seen.append((f, df)) or deal(df, f, *more))
    monkeypatch.setattr(group, "applyInArrow", lambda g, f, *more: seen.append((f, g._df)) or join(g, f, *more))
    near = vectors.neighbours(corpus, -0.9, 10)
    assert len(seen) == 3
    made = [[b.num_rows for b in f(iter(df.toArrow().combine_chunks().to_batches()[:1]))] for f, df in seen[:2]]
    assert max(max(x) for x in made) <= vectors.TILE_ROWS
    table = seen[2][1].where("i = j").toArrow()
    sizes = [b.num_rows for b in seen[2][0](iter(table.filter(pa.compute.equal(table["i"], table["i"][0])).combine_chunks().to_batches()))]
    assert sum(sizes) > vectors.SENT_PAIRS
    assert max(sizes) < vectors.SENT_PAIRS + vectors.JOIN_TILE**2
    assert near.count() == (4000 * 3999 // 2 if copies else int((np.triu(m.astype(np.float32).astype(float) @ m.astype(np.float32).astype(float).T > -0.9, 1)).sum()))


def test_counts_of_neighbours_leave_workers_as_counts(spark, data, monkeypatch):
    made = []
    group = type(spark.range(1).groupBy())
    join = group.applyInArrow
    monkeypatch.setattr(group, "applyInArrow", lambda g, f, schema: made.append(join(g, f, schema)) or made[0])
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 200)
    n = sum(r.n for r in QUERIES["v06_all_neighbours"](spark, data).collect())
    assert made[0].columns == ["doc_id", "n"]
    made.clear()
    assert QUERIES["j15_neighbour_pairs"](spark, data).count() * 2 == n


@pytest.mark.parametrize("target", [None, 20])
def test_diverse_selection_writes_few_pairs(spark, monkeypatch, target):
    """Of 3,000 rows in 30 groups of copies, which have 148,500 pairs; a target needs the first part alone."""
    m, _ = vector_rows(spark, 30, 40, 8)
    corpus = spark.createDataFrame([(i, [float(x) for x in m[i % 30]]) for i in range(3000)], "doc_id long, embedding array<float>")
    monkeypatch.setattr(vectors, "FIRST_ROWS", 200, raising=False)
    pairs, scored = [], []
    near, block = vectors.neighbours, vectors._by_block
    monkeypatch.setattr(vectors, "neighbours", lambda rows, t: pairs.append(near(rows, t)) or pairs[-1])
    monkeypatch.setattr(vectors, "_by_block", lambda *a: scored.append(a) or block(*a))
    got = vectors.diverse(corpus, 0.9, target=target).collect()
    assert len({r.doc_id % 30 for r in got}) == len(got) == (target or 30)
    assert sum(p.count() for p in pairs) < 5_000
    assert not target or len(pairs) == 1 and not scored


def test_samples_beyond_a_heap(spark, monkeypatch):
    rows = spark.range(300).withColumnRenamed("id", "k")
    few = [[r.k for r in f.collect()] for f in (sampling.sample(rows, 70, 1, "k"), sampling.half(rows, 1, "k"))]
    monkeypatch.setattr(sampling, "HEAP", 10)
    many = [[r.k for r in f.collect()] for f in (sampling.sample(rows, 70, 1, "k"), sampling.half(rows, 1, "k"))]
    assert [sorted(x) for x in few] == [sorted(x) for x in many]
    assert [len(x) for x in many] == [70, 150]


def test_rank_correlation_over_many_parts(spark, monkeypatch):
    monkeypatch.setattr(relational, "PART", 7)
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 40, 200), rng.integers(0, 40, 200)
    rank = lambda x: np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    got = statistics.spearman(spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b, strict=True)], "a long, b long"), "a", "b").first().rho
    assert got == pytest.approx(np.corrcoef(rank(a), rank(b))[0, 1], abs=1e-6)


def files_read(df):
    """Rows of a DataFrame, and how many files its scans of vectors have opened, by their metrics."""
    rows = df.collect()

    def scans(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return scans(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return scans(plan.plan())
        if name == "FileSourceScanExec" and "/vectors" in plan.toString() + plan.relation().location().rootPaths().toString():
            return plan.metrics().apply("numFiles").value()
        children = plan.children()
        return sum(scans(children.apply(i)) for i in range(children.size()))

    return rows, scans(df._jdf.queryExecution().executedPlan())


def clustered(n, clusters, width, seed):
    """Unit vectors around some centres; one cluster holds a third of them."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(clusters, width))
    own = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, clusters, n))
    m = centre[own] + 0.3 * rng.normal(size=(n, width))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def test_index_reads_fewer_files_for_fewer_probes(spark, tmp_path):
    m = clustered(3000, 30, 8, 5)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(None, [1.0] * 8), (5000, None)], "doc_id long, embedding array<float>")
    path = f"{tmp_path}/index"
    index.build(rows.where("doc_id is null or doc_id % 3 > 0"), path, cells=40)
    index.append(rows, path)
    index.append(rows, path)  # what is there stays as it is
    assert sorted(r.doc_id for r in index.stored_vectors(spark, path).collect()) == list(range(3000))
    queries = rows.where("doc_id in (17, 1001)").withColumnRenamed("doc_id", "query_id")
    exact = {(r.query_id, r.doc_id, r["rank"]) for r in vectors.dense_top_k(queries, rows.where("doc_id is not null and embedding is not null"), 10).collect()}
    read, share = [], []
    for probes in (1, 4, 12, 40):
        got, files = files_read(index.search(queries, path, 10, probes))
        read.append(files)
        share.append(len({(r.query_id, r.doc_id) for r in got} & {x[:2] for x in exact}) / len(exact))
    assert read == sorted(set(read))
    assert read[0] <= read[-1] / 8
    assert share == sorted(share)
    assert {(r.query_id, r.doc_id, r["rank"]) for r in got} == exact


def test_index_of_no_rows(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, embedding array<float>")
    index.build(none, f"{tmp_path}/none")
    assert index.search(spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<float>"), f"{tmp_path}/none", 3).count() == 0
    with pytest.raises(ValueError, match="build it anew"):
        index.append(none, f"{tmp_path}/none")


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_index_recalls_all_rows(spark, data, size, tmp_path):
    """Against the exact search with every twentieth row as a query, before rows are appended and after."""
    d = os.path.join(os.path.dirname(data), size)
    corpus = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
    queries = corpus.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    own = lambda df: {(r.query_id, r.doc_id) for r in df.collect() if r.query_id != r.doc_id}  # noqa: E731  # a row finds itself
    some, path = corpus.where("doc_id % 5 > 0"), f"{tmp_path}/index"
    index.build(some, path)
    for rows in (some, corpus):
        exact, near = own(vectors.dense_top_k(queries, rows, 10)), own(index.search(queries, path, 10))
        assert len(exact & near) >= 0.9 * len(exact)
        index.append(corpus, path)
    assert own(QUERIES["v05_approximate_top_k"](spark, d)) == near


def drop_files(spark, path, names):
    """One file for each of the texts' groups, written in their order."""
    for rows in names:
        spark.createDataFrame(rows, "doc_id string, doc string").coalesce(1).write.mode("append").parquet(path)


class Moody(HashEmbedder):
    """Breaks at a text that says so, and everywhere while a file stands."""

    def __init__(self, down):
        super().__init__(8)
        self.down = down

    def embed(self, texts):
        if os.path.exists(self.down) or any("bad" in t for t in texts):
            raise OSError("down")
        return super().embed(texts)


def index_state(spark, target):
    found = {t: sorted(map(str, f(spark, target).collect())) for t, f in (("index", index_build.read_index), ("rejects", index_build.read_rejects))}
    return found, index_build.read_cursor(spark, target).drop("batch").first()


def test_index_build_can_be_killed_after_any_batch(spark, tmp_path):
    rows = [[(f"{b}-{i}", None if i == 3 else " " if i == 4 else f"bad {i}" if (b, i) == (2, 1) else f"text {b} {i}") for i in range(7)] + [(None, "no id")] for b in range(5)]
    drop_files(spark, f"{tmp_path}/in", rows)
    args = (spark, f"{tmp_path}/in", "doc_id string, doc string")
    build = lambda target, **o: index_build.build_index(*args, target, lambda: Moody(f"{tmp_path}/down"), size=2, files=1, **o)
    build(f"{tmp_path}/whole")
    want = index_state(spark, f"{tmp_path}/whole")
    assert tuple(want[1]) == (40, 24, 16, 0)
    assert sorted(r.pos for r in index_build.read_index(spark, f"{tmp_path}/whole").collect()) == list(range(24))

    def die(cursor):
        raise KeyError("killed")

    for _ in range(5):  # each run ends with the batch written and not yet committed, and the next one does it again
        with pytest.raises(Exception, match="killed"):
            build(f"{tmp_path}/parts", progress=die)
        seen = []
        with pytest.raises(Exception, match="killed"):
            build(f"{tmp_path}/parts", progress=lambda c: seen.append(c) or (die(c) if len(seen) == 2 else None))
        if index_build.read_cursor(spark, f"{tmp_path}/parts").first().lines == 40:
            break
    build(f"{tmp_path}/parts")
    assert index_state(spark, f"{tmp_path}/parts") == want


def test_index_build_stops_when_the_model_is_down(spark, tmp_path):
    drop_files(spark, f"{tmp_path}/in", [[(f"{b}-{i}", f"text {i}") for i in range(2)] for b in range(5)])
    build = lambda: index_build.build_index(spark, f"{tmp_path}/in", "doc_id string, doc string", f"{tmp_path}/out", lambda: Moody(f"{tmp_path}/down"), size=2, files=1)
    open(f"{tmp_path}/down", "w").close()
    with pytest.raises(Exception, match="batches in succession embedded nothing"):
        build()
    cursor = index_build.read_cursor(spark, f"{tmp_path}/out").first()
    assert (cursor.lines, cursor.indexed, cursor.rejected, cursor.streak) == (4, 0, 4, 2)
    os.remove(f"{tmp_path}/down")
    build()  # goes on with the batch that was given up
    cursor = index_build.read_cursor(spark, f"{tmp_path}/out").first()
    assert (cursor.lines, cursor.indexed, cursor.rejected, cursor.streak) == (10, 6, 4, 0)


# -- files in splits, releases, checked writes


def arrow_file(path, batches, form):
    with form(path, batches[0].schema) as out:
        for b in batches:
            out.write_batch(b)


@pytest.mark.parametrize("form", [pa.ipc.new_file, pa.ipc.new_stream])
def test_arrow_files_are_read_in_splits(spark, tmp_path, form):
    """No task holds a file: each reads the bytes of its own batches. Columns by dictionary, compressed bodies, unwanted columns."""
    columns = lambda n: {"_id": [f"{n}-{i}" for i in range(100)], "text": [f"text {n} {i}" * 20 for i in range(100)], "kind": pa.array(["a", "b"] * 50).dictionary_encode(), "big": ["x" * 1000] * 100}
    batches = [pa.RecordBatch.from_pydict(columns(n)) for n in range(30)]
    path = f"{tmp_path}/set/part.arrow"
    os.mkdir(f"{tmp_path}/set")
    arrow_file(path, batches, lambda p, s: form(p, s, options=pa.ipc.IpcWriteOptions(compression="zstd")) if form is pa.ipc.new_file else form(p, s))
    arrow_file(f"{tmp_path}/set/cache-1.arrow", batches[:1], form)
    parts = arrow_files.splits(path, os.path.getsize(path) // 10)
    assert len(parts) > 8
    assert sum(len(p.batches) for p in parts) == 30
    assert all(sum(m.length for m in p.batches) <= os.path.getsize(path) // 10 for p in parts)
    rows = readers.read_arrow(spark, f"{tmp_path}/set", split=os.path.getsize(path) // 10)
    assert rows.rdd.getNumPartitions() == len(parts)
    want = [(r["_id"], r["text"], r["kind"], r["big"]) for b in batches for r in b.to_pylist()]
    assert sorted(map(tuple, rows.select("_id", "text", "kind", "big").collect())) == sorted(want)
    narrow = readers.read_arrow(spark, f"{tmp_path}/set", ["kind", "_id"])
    assert narrow.columns == ["kind", "_id"]
    assert sorted(map(tuple, narrow.collect())) == sorted((k, i) for i, _, k, _ in want)
    decoded = next(arrow_files.read_split(parts[0], ["text"]))
    assert decoded.schema.names == ["text"]
    assert readers.read_corpus(spark, f"{tmp_path}/set", split=9_000).count() == 3000


def test_arrow_streams_without_batches(spark, tmp_path):
    arrow_file(f"{tmp_path}/none.arrow", [pa.RecordBatch.from_pydict({"_id": pa.array([], pa.string()), "text": pa.array([], pa.string())})], pa.ipc.new_stream)
    assert readers.read_corpus(spark, str(tmp_path)).count() == 0


def test_a_release_is_whole_or_not_there(spark, tmp_path, monkeypatch):
    import hashlib

    os.makedirs(f"{tmp_path}/src/deep")
    content = {"a.jsonl": b'{"a": 1}\n\n  \n{"a": 2}', "deep/b.jsonl": b"x\n" * 70_000 + b"last", "empty.jsonl": b"", "deep/blank.jsonl": b"\n \n"}
    for name, data in content.items():
        with open(f"{tmp_path}/src/{name}", "wb") as f:
            f.write(data)
    spark.range(7).coalesce(1).write.parquet(f"{tmp_path}/table")
    (part,) = [x for x in os.listdir(f"{tmp_path}/table") if x.endswith(".parquet")]
    sources = {"data": f"{tmp_path}/src", "t.parquet": f"{tmp_path}/table/{part}"}
    monkeypatch.setattr(sinks, "CHUNK", 64)  # of the driver; executors keep theirs
    assert sinks._streamed(f"{tmp_path}/src/deep/b.jsonl", None) == (70_001, 140_004, hashlib.sha256(content["deep/b.jsonl"]).hexdigest())
    got = {r.path: (r.rows, r.bytes, r.sha256) for r in sinks.package(spark, sources, f"{tmp_path}/out", {"release": 1}).collect()}
    rows = {"a.jsonl": 2, "deep/b.jsonl": 70_001, "empty.jsonl": 0, "deep/blank.jsonl": 0}
    assert {k: v for k, v in got.items() if k != "t.parquet"} == {f"data/{k}": (rows[k], len(v), hashlib.sha256(v).hexdigest()) for k, v in content.items()}
    assert got["t.parquet"][0] == 7
    for name, data in content.items():
        assert open(f"{tmp_path}/out/data/{name}", "rb").read() == data
    listed = json.load(open(f"{tmp_path}/out/manifest.json"))
    assert listed["release"] == 1
    assert {f["path"]: (f["rows"], f["bytes"], f["sha256"]) for f in listed["files"]} == got
    with pytest.raises(FileExistsError):
        sinks.package(spark, sources, f"{tmp_path}/out")
    os.chmod(f"{tmp_path}/src", 0o755)
    monkeypatch.setattr(sinks, "_listed", lambda files: files.where("path not like '%b.jsonl'").select("path", F.lit(1).cast("long").alias("rows"), F.col("length").alias("bytes"), F.lit("").alias("sha256")))
    with pytest.raises(OSError, match="not copied whole"):
        sinks.package(spark, sources, f"{tmp_path}/other")
    assert sorted(os.listdir(tmp_path)) == ["out", "src", "table"]


def jobs_of(spark, run):
    import uuid

    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_checked_writes_count_in_the_pass_that_writes(spark, tmp_path):
    rows = spark.range(100).repartition(3)
    had = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counters = {"all": F.count("*"), "odd": F.count_if(F.col("id") % 2 == 1)}
        seen = {}
        assert jobs_of(spark, lambda: seen.update(sinks.write_checked(rows, f"{tmp_path}/odd", counters, lambda n: None, F.col("id") % 2 == 1))) == 1
        assert seen == {"all": 100, "odd": 50}
        assert spark.read.parquet(f"{tmp_path}/odd").count() == 50
        with pytest.raises(ValueError, match="too odd"):
            sinks.write_checked(rows, f"{tmp_path}/bad", counters, lambda n: "too odd" if n["odd"] else None)
        with pytest.raises(FileExistsError):
            sinks.write_checked(rows, f"{tmp_path}/odd", counters, lambda n: None)
        full = spark.createDataFrame([(i, f"t{i}") for i in range(20)] + [(None, "n")], "k long, t string")
        assert jobs_of(spark, lambda: seen.update(sinks.write_complement(full, full.where("k < 5 or k is null"), "k", f"{tmp_path}/rest"))) == 1
        assert {k: seen[k] for k in ("full", "sample", "complement", "foreign")} == {"full": 21, "sample": 6, "complement": 15, "foreign": 0}
        assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/rest").collect()) == list(range(5, 20))
        for sample, why in ((full.limit(1).withColumn("t", F.lit("other")), "1 rows of the sample"), (full.limit(2).union(full.limit(1)), "keys repeat"), (spark.createDataFrame([(99, "t")], full.schema), "not in the table")):
            with pytest.raises(ValueError, match=why):
                sinks.write_complement(full, sample, "k", f"{tmp_path}/never")
    finally:
        for k, v in had.items():
            spark.conf.set(k, v)
    assert sorted(os.listdir(tmp_path)) == ["odd", "rest"]


# -- exact quantiles


@pytest.mark.parametrize("few", [4, 10_000])
def test_exact_quantiles(spark, duck, monkeypatch, few):
    """Continuous values, heavy ties and few distinct ones, odd and even counts; no more than a few values are ever counted one
    by one."""
    monkeypatch.setattr(statistics, "FEW", few)
    rng = np.random.default_rng(few)
    sets = [rng.normal(size=1001), rng.normal(size=1000), np.concatenate([np.full(500, 2.0), rng.normal(size=301), np.full(400, -1.0)]), np.repeat([1.0, 2.0], 300), np.array([3.0]), 10.0 ** rng.integers(-300, 300, 500)]
    shares = [0.25, 0.5, 0.99]
    for x in sets:
        rows = spark.createDataFrame([(float(v),) for v in x] + [(None,)] * 3, "v double").repartition(3)
        got = statistics.exact_quantiles(rows, F.col("v"), shares)
        plain = pa.table({"v": x})  # noqa: F841
        want = duck.sql(f"SELECT quantile_cont(v, {shares}) FROM plain").fetchall()[0][0]
        assert got == pytest.approx(want, rel=1e-12)
    assert statistics.exact_quantiles(rows.where("v is null"), F.col("v"), [0.5]) == [None]


# -- clients and kept answers


class Counted:
    """A client that leaves a mark when it is made and when it is asked."""

    def __init__(self, folder):
        import uuid

        self.folder, self.mark = folder, lambda kind: open(f"{folder}/{kind}-{uuid.uuid4().hex}", "w").close()
        self.mark("made")

    def complete(self, prompts):
        for p in prompts:
            self.mark("asked")
            if os.path.exists(f"{self.folder}/stop") and p.endswith("7"):
                raise OSError("down")
        return [p.upper() for p in prompts]


def marks(folder, kind):
    return sum(x.startswith(kind) for x in os.listdir(folder))


def test_a_worker_keeps_its_client(spark, tmp_path):
    folder = str(tmp_path)
    rows = spark.range(40).select(F.col("id").cast("string").alias("p")).repartition(20)
    for _ in range(2):
        assert sorted(r.a for r in ask(rows, "p", "a", lambda: Counted(folder)).collect()) == sorted(str(i) for i in range(40))
    assert marks(folder, "asked") == 80
    assert marks(folder, "made") < 20  # tasks were 40


def test_answers_outlive_a_run_that_breaks_off(spark, tmp_path):
    marked, store = f"{tmp_path}/marks", f"{tmp_path}/store"
    os.mkdir(marked)
    rows = spark.createDataFrame([(i, f"q{i % 50}") for i in range(100)] + [(100, None)], "i long, p string").repartition(2)
    once = lambda **o: models.ask_once(rows, "p", "a", lambda: Counted(marked), store, wave=10, attempts=1, **o)
    open(f"{marked}/stop", "w").close()
    with pytest.raises(Exception, match="calls in succession failed"):
        once(give_up=1, threads=1)
    at = models.progress(spark, store).first() if os.path.exists(store) else None
    kept = at.answers if at else 0
    asked = marks(marked, "asked")
    os.remove(f"{marked}/stop")
    got = once()
    assert sorted((r.i, r.a) for r in got.collect() if r.p) == [(i, f"Q{i % 50}") for i in range(100)]
    assert [r.a for r in got.where("p is null").collect()] == [None]
    assert marks(marked, "asked") == asked + 50 - kept
    at = models.progress(spark, store).first()
    assert (at.waves, at.done, at.answers) == (at.waves, at.waves, 50)
    assert once().count() == 101
    assert marks(marked, "asked") == asked + 50 - kept


def walked(rows, fields, count, preferred, slots=2):
    """The plain walk over all rows in order."""
    picked: list = []
    for most, some in ((slots, [r for r in rows if r[preferred]]), (count, rows)):
        for r in some:
            if len(picked) < most and not any(r[f] == p[f] for f in fields for p in picked):
                picked.append(r)
    return [r["id"] for r in picked]


@pytest.mark.parametrize("pool", [1, 7, 10_000])
def test_greedy_distinct_walks_the_whole_table(spark, pool):
    # one source fills the first 12,000 places; preferred rows and other sources come after it
    n = 12_000
    rows = [{"id": i, "source": "hot", "lang": f"l{i % 3}", "best": False} for i in range(n)]
    rows += [{"id": n + i, "source": [None, "a", "b", "a", "c", None, "d"][i % 7], "lang": [f"l{i}", "l0", None][i % 3], "best": i % 5 == 4} for i in range(60)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "id long, source string, lang string, best boolean").repartition(4)
    for count in (1, 4, 9):
        got = sampling.greedy_distinct(df, [F.col("id")], ["source", "lang"], count, "best", pool=pool)
        assert [r.id for r in got] == walked(rows, ["source", "lang"], count, "best", min(2, count))


def test_pick_queries_walk_the_whole_table(spark, tmp_path):
    hot = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen."
    cold = "Two other words stand here with six more of them and then a few further ones."
    is_hot = F.col("id") < 10_010
    name = F.when(is_hot, "hot").otherwise("cold")
    docs = spark.range(10_050).select(F.col("id").alias("doc_id"), F.when(is_hot, hot).otherwise(cold).alias("text"), name.alias("lang"), name.alias("source"), F.when(is_hot, 91).otherwise(78).cast("long").alias("n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.record_id for r in QUERIES["d16_few_shot"](spark, str(tmp_path)).collect()] == [0, 10_010]
    assert [r.doc_id for r in QUERIES["t18_greedy_distinct"](spark, str(tmp_path)).collect()] == [10_010, 0]


@pytest.mark.parametrize("name", ["l01_document_filter", "l01_document_scores", "l02_attributes", "l04_diverse_queries", "l14_concurrent_calls"])
def test_whole_texts_reach_the_model(spark, duck, tmp_path, monkeypatch, name):
    texts = [None, "", "[2] 7\n[3] d 9 \n\nlast", "word " * 20_000, "d 1\r\nx", "```json\n[]```", "%d {0} \\n 'x'", "a\n" * 500, "x"] * 6
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    prompts = []
    for module in (annotate, models, planning):
        real = module.ask
        monkeypatch.setattr(module, "ask", lambda df, prompt, *a, real=real, **b: (prompts.append(df.select(prompt)), real(df, prompt, *a, **b))[1])
    same(QUERIES[name](spark, str(tmp_path)), duck.sql(f"WITH documents AS (SELECT * FROM '{tmp_path}/documents.parquet/*.parquet') {ORACLE_SQL[name]}").to_arrow_table())
    sent = [r[0] for r in prompts[0].collect()]
    assert all(any(f"d {i}\n{texts[i]}" in p if texts[i] is not None else f"d {i}" in p for p in sent) for i in range(len(texts)))


def test_each_prompt_is_sent_once(spark, data, tmp_path):
    """Rounds, and the two results of a filter, come from stored answers."""
    spark.read.parquet(f"{data}/documents.parquet").limit(40).write.parquet(f"{tmp_path}/documents.parquet")
    calls = f"{tmp_path}/calls"
    os.mkdir(calls)

    def counted(rule):
        def run(prompt):
            import uuid

            with open(f"{calls}/{uuid.uuid4().hex}", "w") as f:
                f.write(prompt)
            return rule(prompt)

        return lambda: RuleCompleter(run)

    def sent():
        out = [open(f"{calls}/{f}").read() for f in os.listdir(calls)]
        for f in os.listdir(calls):
            os.remove(f"{calls}/{f}")
        return out

    from corvane.queries import model_calls as m

    docs = annotate.generate_attributes(m._doc_rows(spark, str(tmp_path)), "Find.", lambda: RuleCompleter(m._attributes))
    planning.generate_queries(docs, "Write.", 3, counted(m._writer)).collect()
    prompts = sent()
    assert len(prompts) == len(set(prompts))
    rounds = Counter(p.split(":")[0] for p in prompts)
    assert rounds == {"plan 3": 40, "plan 2": 40, "plan 1": 40, "write 0": 40, "write 1": 40}
    passed, judged = annotate.filter_documents(m._doc_rows(spark, str(tmp_path)), "Score.", 7, counted(m._by_text))
    assert 0 < passed.count() < judged.count() == 40
    assert len(sent()) == 6


def test_calls_that_keep_failing_end_the_job(spark):
    def rule(prompt):
        if prompt.startswith("bad"):
            raise OSError("down")
        return "ok"

    few = spark.createDataFrame([(i, "bad" if i % 3 else "good") for i in range(60)], "i long, p string").coalesce(1)
    assert [r.a for r in ask(few, "p", "a", lambda: RuleCompleter(rule), give_up=5).orderBy("i").collect()] == [None if i % 3 else "ok" for i in range(60)]
    with pytest.raises(Exception, match="calls in succession failed"):
        ask(few.where("i % 3 > 0"), "p", "a", lambda: RuleCompleter(rule), give_up=20).collect()


def test_arrow_scan_reads_every_row(spark, data, duck):
    d = os.path.join(os.path.dirname(data), "sf0.1")
    got = QUERIES["s05_arrow_scan"](spark, d).select("doc_id", "title", "text")
    same(got, duck.sql(f"WITH benchmark AS (SELECT * FROM '{d}/benchmark.parquet') {ORACLE_SQL['s03_jsonl_scan']}").to_arrow_table())


def test_batches_are_read_in_pieces(spark, tmp_path, monkeypatch):
    """A file cut into many splits, with braces, quotes and escapes in texts, objects in its header and after its list."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(relational, "PART", 11)
    parts = ["}", "{", '"', "\\", "\n", "a ", "é", '\\"}', '"results": [', "]", ", ", "{}"]
    results = [{"doc_id": str(i), "doc": "".join(rng.choice(parts, rng.integers(0, 30))), "meta": {"k": {"deep": int(i)}, "l": [{"x": "}"}]}} for i in range(120)]
    batch = {"note": 'a "results": [{} in a text', "config": {"results": "x", "list": [{"a": {}}]}, "results": results, "tail": {"n": {"m": 1}}, "last": [{"doc_id": "no"}]}
    schema = "doc_id: string, doc: string, meta: struct<k: struct<deep: int>>"
    had = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        for n, text in enumerate((json.dumps(batch), json.dumps(batch, indent=2, ensure_ascii=False), json.dumps({"results": []}), json.dumps({"a": 1}))):
            with open(f"{tmp_path}/{n}.json", "w") as f:
                f.write(text)
            got = [(r.position, r.doc_id, r.doc, r.meta.k.deep) for r in readers.read_batch(spark, f"{tmp_path}/{n}.json", schema).orderBy("position").collect()]
            assert got == ([(i, r["doc_id"], r["doc"], i) for i, r in enumerate(results)] if n < 2 else [])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", had)


def test_header_stands_anywhere_before_the_results(spark, tmp_path):
    with open(f"{tmp_path}/b.json", "w") as f:
        f.write(json.dumps({"a": "x" * 200_000, "n": 3, "results": [{"n": 4}]}))
    assert readers.batch_header(spark, f"{tmp_path}/b.json") == {"a": "x" * 200_000, "n": 3}


def test_manifest_lists_every_file(spark, data):
    import hashlib

    with open(f"{data}/region.parquet", "rb") as f:
        content = f.read()
    got = sinks.manifest(spark, f"{data}/region.parquet").first()
    assert tuple(got) == ("region.parquet", 5, len(content), hashlib.sha256(content).hexdigest())


# -- metrics


def test_metrics_by_hand(spark):
    run = spark.createDataFrame([("q1", d, 1.0 / r, r) for r, d in enumerate(["x", "a", "b"], 1)], "query_id string, doc_id string, score double, rank int")
    qrels = spark.createDataFrame([("q1", "a", 2), ("q1", "c", 1), ("q2", "a", 1), ("q3", "a", 0)], "query_id string, doc_id string, rel int")
    got = {r.query_id: r for r in evaluation.per_query(run, qrels, 10).collect()}
    ideal = 3 / np.log2(2) + 1 / np.log2(3)
    assert got["q1"].ndcg == pytest.approx(3 / np.log2(3) / ideal)
    assert (got["q1"].recall, got["q1"].precision, got["q1"].map, got["q1"].mrr) == (0.5, 0.1, 0.25, 0.5)
    assert (got["q2"].ndcg, got["q2"].mrr, got["q3"].ndcg) == (0.0, 0.0, 0.0)


@pytest.mark.parametrize("sent", [0, 1000])
def test_metrics_of_many_judgements(spark, sent, monkeypatch):
    """Against a sorted list of judgements in plain Python; what is sorted or joined are counts and the run's own pairs."""
    monkeypatch.setattr(evaluation, "SENT_PAIRS", sent, raising=False)
    rng = np.random.default_rng(8)
    rel = {(q, d): int(rng.integers(-1, 4)) if q else 0 for q in range(4) for d in range(0, 200, q + 1)}
    qrels = spark.createDataFrame([(*k, v) for k, v in rel.items()] + [(0, 1000, None)], "query_id long, doc_id long, rel int")
    ranked = {q: [int(d) for d in rng.permutation(250)[:12]] for q in (0, 1, 2, 9)}
    run = spark.createDataFrame([(q, d, -float(r), r) for q, docs in ranked.items() for r, d in enumerate(docs, 1)], "query_id long, doc_id long, score double, rank int")
    for k in (1, 5, 10, 150):
        got = {r.query_id: r for r in evaluation.per_query(run, qrels, k).collect()}
        assert got.keys() == {0, 1, 2, 3}
        for q, r in got.items():
            found, every = [rel.get((q, d), 0) for d in ranked.get(q, [])[:k]], sorted((v for (x, _), v in rel.items() if x == q and v > 0), reverse=True)
            ideal, dcg = (sum((2**v - 1) / np.log2(i + 1) for i, v in enumerate(x[:k], 1)) for x in (every, found))
            assert r.ndcg == pytest.approx(dcg / ideal if ideal else 0)
            assert r.recall == pytest.approx(sum(v > 0 for v in found) / len(every) if every else 0)
    many = spark.range(20).select((F.col("id") % 2).alias("query_id"), F.col("id").alias("doc_id"), F.lit(1).alias("rel")).crossJoin(spark.range(3000).select(F.col("id").alias("_n")))
    many = many.select("query_id", (F.col("doc_id") + 20 * F.col("_n")).alias("doc_id"), "rel")
    df = evaluation.per_query(run, many, 10)
    assert len(df.collect()) == 2
    assert not sent or max(shuffled_rows(df)) <= 48


def shuffled_rows(df):
    """Rows that each shuffle of a collected DataFrame has written."""

    def exchanges(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return exchanges(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return exchanges(plan.plan())
        own = [plan.metrics().apply("shuffleRecordsWritten").value()] if name == "ShuffleExchangeExec" else []
        children = plan.children()
        return own + [x for i in range(children.size()) for x in exchanges(children.apply(i))]

    return exchanges(df._jdf.queryExecution().executedPlan())


def test_agreement(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "x string, y string")
    m = agreement.confusion(rows, "x", "y", ["a", "b", "c"])
    assert m.count() == 9
    k = agreement.kappa(m).first()
    assert (k.observed, k.kappa) == (round(2 / 3, 6), 0.4)
    single = spark.createDataFrame([("a", "a")], "x string, y string")
    assert agreement.kappa(agreement.confusion(single, "x", "y", ["a"])).first().kappa == 1.0
    votes = spark.createDataFrame([(1, "p"), (1, "p"), (1, "h"), (2, "p"), (2, "h"), (2, "e")], "i int, v string")
    got = {r.i: (r.label, r.tie) for r in agreement.consensus(votes, "i", "v", "h").collect()}
    assert got == {1: ("p", False), 2: ("h", True)}


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=2, max_size=25))
def test_length_buckets_use_exclusive_quartiles(spark, counts):
    rows = spark.createDataFrame([(x,) for x in counts], "w int")
    got = {r.label: r for r in statistics.length_buckets(rows, F.col("w")).collect()}
    q1, _, q3 = py.quantiles(sorted(counts), n=4)
    lo, hi = int(q1), int(q3)
    if lo < hi and "medium" in got:
        assert (got["medium"].word_min, got["medium"].word_max) == (lo + 1, hi)
    assert sum(r.probability for r in got.values()) == pytest.approx(1, abs=1e-5)


def test_length_buckets_of_few_rows(spark):
    rows = spark.createDataFrame([(5,)], "w int")
    assert [tuple(r) for r in statistics.length_buckets(rows, F.col("w")).collect()] == [("medium", 4, 6, 1.0)]
    assert [tuple(r) for r in statistics.length_buckets(rows.limit(0), F.col("w")).collect()] == [("medium", 1, None, 1.0)]


# -- model calls


def test_failed_calls_give_null(spark):
    def boom(prompt):
        if "2" in prompt:
            raise RuntimeError("no answer")
        return "ok"

    rows = ask(spark.range(4).select(F.col("id").cast("string").alias("p")), "p", "a", lambda: RuleCompleter(boom))
    assert {r.p: r.a for r in rows.collect()} == {"0": "ok", "1": "ok", "2": None, "3": "ok"}


def test_made_up_ids_drop_out(spark):
    rows = spark.createDataFrame([(1, "q", "a<:/", "x", 1), (1, "q", "b", "y", 2)], "query_id long, query string, doc_id string, doc string, rank int")
    seen = []

    def rule(prompt):
        assert "a<:/" not in prompt
        return json.dumps([{"id": "0", "score": 3, "classification": "positive"}, {"id": "1", "score": 0, "classification": "odd"}, {"id": "7", "score": 3, "classification": "positive"}])

    got = annotate.annotate(rows, "Label", 5, lambda: RuleCompleter(rule)).collect()
    assert {(r.doc_id, r.classification) for r in got} == {("a<:/", "positive"), ("b", "odd")}
    lists = annotate.label_lists(annotate.annotate(rows, "Label", 5, lambda: RuleCompleter(rule)), rows.select("query_id", "doc_id", "rank")).first()
    assert (lists.positive_doc_ids, lists.hard_negative_doc_ids) == (["a<:/"], [])
    assert seen == []


def candidates(spark, per_query):
    return spark.createDataFrame([(q, f"query {q}", i, f"doc {i}", i + 1) for q, n in per_query.items() for i in range(n)], "query_id long, query string, doc_id long, doc string, rank int")


def test_answers_are_usable_repaired_or_failed(spark):
    """Chunks of two. Query 1: fine, prose at first, prose always. Query 2: prose always. Query 3: labels nothing. Query 4: the
    call fails. The second prompt carries the first answer and what is wrong with it."""

    def rule(prompt):
        asked, _, again = prompt.partition("Your answer was:")
        label = json.dumps({"annotations": [{"doc_id": "0", "score": "3", "classification": "Positive"}, {"id": 1, "score": 0, "classification": "easy negative", "reasoning": "r"}]})
        if "query 2" in asked or "doc 4" in asked:
            return "no idea"
        if "query 3" in asked:
            return '{"annotations": [{"id": "9", "score": 1}]}'
        if "query 4" in asked:
            raise OSError("down")
        if "doc 2" in asked and not again:
            return "{annotations: [}"
        if again:
            assert "{annotations: [}" in again
            assert "unexpected '}'" in again
        return label

    rows = candidates(spark, {1: 6, 2: 4, 3: 2, 4: 2})
    chunks = {(r.query_id, r.chunk): r for r in annotate.annotate_chunks(rows, "Label", 2, lambda: RuleCompleter(rule)).collect()}
    assert {k: r.outcome for k, r in chunks.items()} == {(1, 0): "usable", (1, 1): "repaired", (1, 2): "failed", (2, 0): "failed", (2, 1): "failed", (3, 0): "usable", (4, 0): "failed"}
    assert [(a.doc_id, a.score, a.classification, a.reasoning) for a in chunks[1, 1].annotations] == [(2, 3, "positive", None), (3, 0, "easy_negative", "r")]
    assert chunks[4, 0].problem == "no answer"
    assert chunks[3, 0].annotations == []
    got = {r.query_id: (r.chunks, r.repaired, r.failed, r.positive_doc_ids, r.easy_negative_doc_ids) for r in annotate.annotate_queries(rows, "Label", 2, lambda: RuleCompleter(rule)).collect()}
    assert got == {1: (3, 1, 1, ["0", "2"], ["1", "3"]), 2: (2, 0, 2, None, None), 3: (1, 0, 0, [], []), 4: (1, 0, 1, None, None)}
    once = annotate.annotate_chunks(rows, "Label", 2, lambda: RuleCompleter(rule), retries=0).where("query_id = 1 and chunk = 1").first()
    assert (once.outcome, once.annotations) == ("failed", None)


def test_hidden_ids_take_any_form(spark):
    forms = ['{"score": 2, "classification": "positive"}', '[{"score": 2, "classification": "positive"}]', '{"annotations": [{"doc_id": "x", "score": 2, "classification": "positive"}]}']
    got = annotate.annotate(candidates(spark, {1: 3}), "Label", 9, lambda: RuleCompleter(lambda p: forms[int(p[-1])]), hide_ids=True).collect()
    assert sorted((r.doc_id, r.score, r.classification) for r in got) == [(i, 2, "positive") for i in range(3)]


def test_repeated_ids_are_judged_each(spark):
    """Ids that repeat, with equal and other texts, and ids that are null: as many rows as went in, each text in one prompt."""
    rows = [(1, "a 1"), (1, "a 1"), (1, "b 2"), (None, "c 3"), (None, "c 3"), (None, None), (2, "a 1")]
    seen = []

    def rule(prompt):
        items = re.findall(r"^\[(\d+)\] (.*)$", prompt, re.M)
        assert len(items) == len({n for n, _ in items}) == 5
        return json.dumps([{"id": n, "score": int(t[-1:] or 0)} for n, t in items])

    docs = spark.createDataFrame(rows, "doc_id long, doc string").repartition(3)
    got = annotate.filter_documents(docs, "Score", 10, lambda: RuleCompleter(rule))[1].collect()
    assert sorted(((r.doc_id, r.doc, r.score) for r in got), key=str) == sorted(((i, t, int(t[-1]) if t else 0) for i, t in rows), key=str)
    assert seen == []
    queries = spark.createDataFrame([(1, 0, "q 3"), (1, 0, "q 3"), (1, 0, "r 1"), (None, 0, "s 2"), (2, 0, "t 3")], "doc_id long, query_pos int, query string")
    passed, every = annotate.filter_queries(queries, "Score", 10, lambda: RuleCompleter(lambda p: json.dumps([{"id": n, "score": int(t[-1])} for n, t in re.findall(r"^\[(\d+)\] (.*)$", p, re.M)])))
    assert every.count() == 5
    assert sorted((r.query for r in passed.collect())) == ["q 3", "q 3", "s 2", "t 3"]


def test_planning_goes_on_until_the_target(spark, tmp_path):
    """One document reaches its number in a round, one in three, one never; chunks hold at most two plans; what is missing is
    asked for again, once."""
    options = [f"o{i}" for i in range(9)]
    docs = spark.createDataFrame([(1, "fast"), (2, "slow"), (3, "poor"), (3, "fast"), (4, "none")], "doc_id long, doc string")
    listed = F.array(F.struct(F.lit("size").alias("dimension"), F.array(*map(F.lit, options)).alias("options")))
    ids = F.array(F.struct(F.lit("t").alias("type"), F.lit("x").alias("identifier"), F.lit("x").alias("label")))
    docs = docs.withColumn("identifiers", F.when(F.col("doc") != "none", ids).otherwise(F.array().cast("array<struct<type: string, identifier: string, label: string>>"))).withColumn("attributes", listed)
    log = f"{tmp_path}/log"

    def rule(prompt):
        first, doc, rest = prompt.split("\n", 2)
        used = lambda text: re.findall(r'"size":"(o\d)"', text)
        with open(log, "a") as f:
            f.write(f"{first.split(':')[0]} {doc} {len(used(rest.split('plans: ')[-1])) if first.startswith('write') else len(used(rest.split('planned: ')[-1]))}\n")
        plan = lambda o: {"used_identifier": ["x"], "used_attributes": {"size": o}}
        if first.startswith("plan"):
            have, wanted = used(rest.split("planned: ")[1]), int(first.split()[1].rstrip(":"))
            new = [o for o in options if o not in have]
            return json.dumps({"plans": [plan(o) for o in have + new[: {"fast": 9, "slow": 2, "poor": int(not have)}[doc]]] + [plan("o99")] * wanted})
        asked = used(rest.split("plans: ")[1])
        return json.dumps({"queries": [{"query": f" {doc} {o} ", **plan(o)} for o in asked + ["o8"] if not (o == "o1" and first.startswith("write 0")) and not (o == "o2" and doc == "slow")]})

    got = planning.generate_queries(docs.coalesce(1), "Go", 5, lambda: RuleCompleter(rule), chunk=2).collect()
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.doc_id, r.query.split()[0], r.query_pos)):
        found[r.doc_id, r.query.split()[0]].append(r.query.split()[1])
    assert found == {(1, "fast"): ["o0", "o2", "o3", "o4", "o1"], (2, "slow"): ["o0", "o3", "o4", "o1"], (3, "poor"): ["o0"], (3, "fast"): ["o0", "o2", "o3", "o4", "o1"]}
    lines = Counter(open(log).read().split("\n")[:-1])
    assert lines["plan 5 fast 0"] == 2
    assert [lines[f"plan {5 - n} slow {n}"] for n in (0, 2, 4)] == [1, 1, 1]
    assert (lines["plan 5 poor 0"], lines["plan 4 poor 1"]) == (1, 2)
    assert (lines["write 0 fast 2"], lines["write 0 fast 1"], lines["write 1 fast 1"], lines["write 1 slow 2"]) == (4, 2, 2, 1)
    assert not any("none" in x for x in lines)


def test_embeddings_are_unit_vectors(spark):
    got = embed(spark.createDataFrame([("a b",), ("",)], "t string"), "t", HashEmbedder).collect()
    assert np.linalg.norm(got[0].embedding) == pytest.approx(1)
    assert np.linalg.norm(got[1].embedding) == 0


def test_refinement_stops(spark):
    calls = []
    done = calibrate.refine(lambda a: a, lambda x: (x == "xx", "more"), lambda a, f: calls.append(f) or a + "x", attempts=3)
    assert (done.passed, done.artefact, len(done.history)) == (True, "xx", 3)
    failed = calibrate.refine(lambda a: a, lambda x: (False, "no"), lambda a, f: calls.append(f) or a, attempts=2)
    assert not failed.passed
    assert calls == ["more", "more", "no"]


def test_calibration_counts_missing_labels(spark):
    e = spark.createDataFrame([(1, 1, "positive"), (1, 2, "hard_negative"), (1, 3, "easy_negative")], "query_id int, doc_id int, expected_label string")
    p = spark.createDataFrame([(1, 1, "positive"), (1, 2, "easy_negative")], "query_id int, doc_id int, classification string")
    assert tuple(calibrate.compare(e, p).first()) == (3, 1, 2, False)
    assert tuple(calibrate.compare(e, p, two=True).first()) == (3, 2, 1, False)
    assert calibrate.compare(e.limit(0), p).first().passed is False


def test_preflight_shows_no_secret():
    found = checks.preflight({"task": "x", "input_path": "<path>", "output_dir": "o", "api_key": "s3cret"}, ["y"])
    assert len(found) == 3
    assert "s3cret" not in " ".join(found)


# -- files


def test_jsonl_with_a_broken_first_line_raises(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n{oops\n")
    with pytest.raises(ValueError):
        readers.read_corpus(spark, str(tmp_path / "a.jsonl"))


def test_readers_need_an_id(spark):
    with pytest.raises(ValueError, match="id or text"):
        readers.normalise_rows(spark.createDataFrame([("a",)], "text string"))


def test_text_tree(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "c.txt").write_text(" hi \n")
    (tmp_path / "d.txt").write_text(" ")
    (tmp_path / "e.txt").write_text("")
    got = {r.doc_id: r.blank for r in readers.read_text_tree(spark, str(tmp_path)).collect()}
    assert got == {"a b/c.txt": False, "d.txt": True}
    assert readers.empty_files(spark, str(tmp_path)) == ["e.txt"]


def test_batch_header_reads_scalars_only(spark, tmp_path):
    path = str(tmp_path / "b.json")
    sinks.replace_file(spark, path, '{"input_path": "x", "num_queries": 2, "results": [' + ",".join(["{}"] * 50) + "]}")
    assert readers.batch_header(spark, path) == {"input_path": "x", "num_queries": 2}


def test_instructions():
    from corvane.plans import instructions as i

    task = i.Task("t", "questions", "passages", "it answers")
    assert "Not relevant: c" in i.query_prompt(task, [{"query": "a", "positive": "b", "negative": "c"}])
    answers = iter(["", "no part", "has X"])
    assert i.generate("p", ["X"], RuleCompleter(lambda p: next(answers))) == "has X"
    with pytest.raises(ValueError, match="X"):
        i.generate("p", ["X"], RuleCompleter(lambda p: "none"))
    calls, cache = [], {}
    model = RuleCompleter(lambda p: calls.append(p) or '{"query_type": "q", "doc_type": "d", "relevance": "r"}')
    for _ in range(2):
        assert i.define_task("t", [{"query": "a", "positive": "b"}], model, cache).doc_type == "d"
    assert len(calls) == 1
