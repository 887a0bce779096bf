"""The pipeline's stages, each on what the one before it kept, against plain versions."""

from __future__ import annotations

import corpus_pipeline
from corvane.llm import mixing, toxicity

from .test_operators import near_components


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    columns, kept = docs.columns, [docs]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], data).write.parquet(f"{tmp_path}/{n}")
        kept.append(spark.read.parquet(f"{tmp_path}/{n}"))
    assert all(k.columns == columns for k in kept[:-1])
    ids = [[r.doc_id for r in k.select("doc_id").collect()] for k in kept]

    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert sorted(ids[1]) == sorted(i for i in ids[0] if scores[i] < toxicity.THRESHOLD)

    best: dict[str, tuple] = {}
    for r in kept[1].collect():
        key = "".join((r.text or "").encode().decode().split())
        best[key] = min(best.get(key, (1, 0)), (-len(r.text or ""), r.doc_id))
    assert sorted(ids[2]) == sorted(x[1] for x in best.values())

    near = near_components([(r.doc_id, r.text) for r in kept[2].collect()], 5)
    assert sorted(ids[3]) == sorted(i for i, x in near.items() if x[2])

    plan = {r.doc_id: r.copies for r in mixing.plan(kept[3]).collect()}
    assert max(plan.values()) == 2
    assert sorted(ids[4]) == sorted(i for i, n in plan.items() for _ in range(n))

    assert set(ids[5]) == set(ids[4])
    assert corpus_pipeline.run(spark, data).count() >= len(ids[4])


def test_stages_of_odd_rows_and_empty_tables(spark, data, tmp_path):
    """Nulls in any column, repeated rows and further columns pass all stages; an empty table stays one."""
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c d e f g", None, "s", 13), (3, "a b c d e f g", "en", None, 13), (3, "a b c d e f g", "en", None, 13), (4, "z " * 3000, "en", "s", 6000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    labels = spark.createDataFrame([(2, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/d/labels.parquet")
    for case, some in (("rows", rows), ("none", [])):
        docs = spark.createDataFrame(some, schema).selectExpr("*", "'x' AS text_key", "'y' AS position", "'z' AS file")
        columns = docs.columns
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, f"{tmp_path}/d").write.parquet(f"{tmp_path}/{case}{n}")
            docs = spark.read.parquet(f"{tmp_path}/{case}{n}")
            if n < 4:
                assert docs.columns == columns
        assert (docs.count() > 0) == bool(some)


def test_order_survives_the_stages(spark, data, tmp_path):
    """Windows are numbered in the order of training positions, after the mixture went through files."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    mixed = mixing.mix(docs, parts=7)
    order = [(r.doc_id, r.position) for r in mixed.select("doc_id", "position").collect()]
    assert [p for _, p in order] == sorted(p for _, p in order)
    had = spark.conf.get("spark.sql.files.maxPartitionBytes")
    mixed.select(*docs.columns).write.parquet(f"{tmp_path}/mixed")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        pieces = corpus_pipeline.packed(spark, spark.read.parquet(f"{tmp_path}/mixed"), data).orderBy("sequence_id", "offset").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", had)
    # one entry a copy: pieces that begin a document
    assert [r.doc_id for r in pieces if r.start == 0] == [i for i, _ in order]
