"""Building a vector index from a stream of files, so that it can be stopped and resumed anywhere.

Each micro-batch writes its vectors, the rows that it rejects, and then a cursor, under its own number: a batch that was cut
off and runs again replaces its parts. The cursor counts all rows read, so those that are rejected are not read again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank
from ..operators.relational import numbered
from ..plans.models import Embedder
from ..session import exists, stored
from .incremental import _run

CURSOR = "batch long, lines long, indexed long, rejected long, streak int"


def _embedded(rows: DataFrame, embedder: Callable[[], Embedder], size: int, budget: int) -> DataFrame:
    """Rows (doc_id, doc) with ``embedding`` and ``reason``. They go to the model in chunks of ``size``; where a chunk fails its rows go alone, so
    that one bad row costs no other. ``whole`` is false on rows of a chunk in which every row failed; ``budget`` such chunks in
    succession end the task."""
    schema = "doc_id string, doc string, embedding array<double>, reason string, whole boolean"

    def attempt(model: Embedder, texts: list[str]) -> list | str:
        try:
            m = np.asarray(model.embed(texts), np.float64)
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            return list(m / np.where(norm > 0, norm, 1))
        except Exception as e:  # noqa: BLE001  a model may raise anything
            return f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, streak = embedder(), 0
        for batch in batches:
            vectors, reasons, whole = [], [], []
            for i in range(0, len(batch), size):
                texts = batch["doc"].iloc[i : i + size].tolist()
                got = attempt(model, texts)
                each = [(v, None) for v in got] if isinstance(got, list) else [(None, x) if isinstance(x, str) else (x[0], None) for x in (attempt(model, [t]) for t in texts)]
                vectors += [v for v, _ in each]
                reasons += [r for _, r in each]
                fine = any(v is not None for v, _ in each)
                whole += [fine] * len(each)
                streak = 0 if fine else streak + 1
                if streak >= budget:
                    raise RuntimeError(f"{streak} chunks in succession failed: {each[-1][1]}")
            yield batch.assign(embedding=vectors, reason=reasons, whole=whole)

    return rows.mapInPandas(run, schema)


def build_index(spark: SparkSession, source: str, schema: str, target: str, embedder: Callable[[], Embedder], size: int = 32, budget: int = 3, files: int = 100, progress: Callable[[dict], None] | None = None) -> None:
    """Index the files of ``source`` (doc_id, doc, ...; Parquet) that ``target`` has not read yet.

    A row without an id or text, or which the model does not take, is written to the rejects with its reason. ``budget``
    micro-batches in succession that embed nothing of what they hold, or as many chunks of ``size`` rows within a task, end the
    run: the model is down, and rows are worth more than rejects. That batch counts as not read. Positions are dense; they
    follow the batches, and ids within one. Rows that repeat an id are indexed each. progress: called with the cursor after
    each batch.
    """

    def each(batch: DataFrame, n: int) -> None:
        before = spark.read.schema(CURSOR).parquet(f"{target}/cursor").where(F.col("batch") < n).orderBy(F.desc("batch")).first() if exists(spark, f"{target}/cursor") else None
        lines, indexed, rejected, streak = (before.lines, before.indexed, before.rejected, before.streak) if before else (0, 0, 0, 0)
        given = stored(batch.select(F.col("doc_id").cast("string").alias("doc_id"), "doc"), "index-batch")
        bad = F.when(blank(F.col("doc_id")), "no id").when(blank(F.col("doc")), "no text")
        tried = stored(_embedded(given.where(bad.isNull()), embedder, size, budget), "index-embedded")
        good = numbered(tried.where("embedding is not null").select("doc_id", "doc", "embedding"), ["doc_id", F.xxhash64("doc")], "_n")
        good.select("doc_id", "doc", "embedding", (F.col("_n") - 1 + indexed).alias("pos")).write.mode("overwrite").parquet(f"{target}/index/batch={n}")
        lost = given.where(bad.isNotNull()).select("doc_id", "doc", bad.alias("reason")).unionByName(tried.where("embedding is null").select("doc_id", "doc", "reason"))
        lost.write.mode("overwrite").parquet(f"{target}/rejects/batch={n}")
        read = given.count()
        seen = tried.agg(F.count("*").alias("tried"), F.count("embedding").alias("good"), F.count_if("whole").alias("whole")).first()
        # rows that no chunk could embed: the streak goes on over batches of nothing else
        streak = streak + 1 if seen.tried and not seen.whole else 0 if seen.good else streak
        if streak >= budget:
            raise RuntimeError(f"{streak} batches in succession embedded nothing")
        now = {"batch": n, "lines": lines + read, "indexed": indexed + seen.good, "rejected": rejected + read - seen.good, "streak": streak}
        spark.createDataFrame([tuple(now.values())], CURSOR).coalesce(1).write.mode("overwrite").parquet(f"{target}/cursor/n={n}")
        if progress:
            progress(now)

    _run(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source), target, each)


def read_cursor(spark: SparkSession, target: str) -> DataFrame:
    """One row: batch, lines (all rows read), indexed, rejected, streak."""
    found = spark.read.schema(CURSOR).parquet(f"{target}/cursor").select("batch", "lines", "indexed", "rejected", "streak")
    return found.orderBy(F.desc("batch")).limit(1)


def _committed(spark: SparkSession, target: str, table: str) -> DataFrame:
    """Rows of batches whose cursor stands; what a batch that was cut off has left is not part of the index."""
    done = spark.read.schema(CURSOR).parquet(f"{target}/cursor").select("batch")
    return spark.read.parquet(f"{target}/{table}").join(F.broadcast(done), "batch", "left_semi").drop("batch")


def read_index(spark: SparkSession, target: str) -> DataFrame:
    """doc_id, doc, embedding, pos."""
    return _committed(spark, target, "index")


def read_rejects(spark: SparkSession, target: str) -> DataFrame:
    """doc_id, doc, reason."""
    return _committed(spark, target, "rejects")
