"""Incremental runs over the test tables, in two file drops."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import ensure_checkpoints
from ..streaming import incremental
from .registry import query, table
from .sampling import digest_sql


def _twice(spark, d, name, columns, run):
    """The operator after a first file drop, and again after a second one that holds the whole table."""
    base = f"{ensure_checkpoints(spark)}/stream-{uuid.uuid4().hex}"
    rows = table(spark, d, name).select(*columns)
    key = columns[0]
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    rows.where(F.col(key) % 2 == 0).write.mode("append").parquet(f"{base}/in")
    run(f"{base}/in", schema, f"{base}/out")
    rows.write.mode("append").parquet(f"{base}/in")
    return run(f"{base}/in", schema, f"{base}/out")


@query("x01_incremental_index", "SELECT doc_id, length(text) AS n FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, length(text) FROM documents")
def x01(spark, d):
    return _twice(spark, d, "documents", ["doc_id", "text"], lambda s, schema, t: incremental.append_index(spark, s, schema, t, lambda b: b.select("doc_id", F.length("text").cast("long").alias("n"))))


@query("x02_resumable_generation", "SELECT doc_id, upper(lang) AS out FROM documents")
def x02(spark, d):
    return _twice(spark, d, "documents", ["doc_id", "lang"], lambda s, schema, t: incremental.generate_missing(spark, s, schema, t, "doc_id", lambda b: b.select("doc_id", F.upper("lang").alias("out"))))


@query("x03_stream_reservoir", f"WITH e AS (SELECT event_id FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id FROM events) SELECT event_id FROM e ORDER BY {digest_sql(11, 'event_id')}, event_id LIMIT 40")
def x03(spark, d):
    return _twice(spark, d, "events", ["event_id"], lambda s, schema, t: incremental.stream_reservoir(spark, s, schema, t, 40, 11, "event_id"))


@query("x04_stream_distinct", "SELECT DISTINCT lang, source FROM documents")
def x04(spark, d):
    return _twice(spark, d, "documents", ["doc_id", "lang", "source"], lambda s, schema, t: incremental.stream_distinct(spark, s, schema, t, ["lang", "source"]))
