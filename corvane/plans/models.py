"""Model calls: what they are asked through, deterministic offline stand-ins, and how answers come back as columns.

A ``Completer`` turns prompts into answers, an ``Embedder`` texts into vectors. Both run inside ``mapInPandas``, one
instance a worker; write their output to a table, since running them again repeats the calls.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from hashlib import sha256
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import exists, stored


class Completer(Protocol):
    def complete(self, prompts: Sequence[str]) -> list[str]: ...


class Embedder(Protocol):
    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


class RuleCompleter:
    """Offline: a function of the prompt."""

    def __init__(self, rule: Callable[[str], str]):
        self.rule = rule

    def complete(self, prompts: Sequence[str]) -> list[str]:
        return [self.rule(p) for p in prompts]


class HashEmbedder:
    """Offline: signed counts of hashed words, as unit vectors."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        from zlib import crc32

        out = np.zeros((len(texts), self.size))
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = crc32(w.encode())
                out[i, h % self.size] += 1 if h >> 31 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


#: Clients of this worker, by what makes them: a worker serves many tasks, one after the other.
_clients: dict[bytes, Completer] = {}
#: Clients that a worker keeps; the oldest goes first.
KEPT_CLIENTS = 8


def _client(key: bytes, completer: Callable[[], Completer]) -> Completer:
    if key not in _clients:
        while len(_clients) >= KEPT_CLIENTS:
            _clients.pop(next(iter(_clients)))
        _clients[key] = completer()
    return _clients[key]


def ask(df: DataFrame, prompt: str, answer: str, completer: Callable[[], Completer], threads: int = 8, attempts: int = 2, give_up: int = 50) -> DataFrame:
    """Adds the answer to each row's prompt; calls of a batch overlap, rows keep their place, a call that fails after all
    attempts gives null. ``give_up`` such rows in succession end the job: the service is down, and the rows are worth more
    than nulls. completer: makes a client, once a worker, which keeps it for later tasks and jobs. threads: calls in flight
    in a worker; a worker runs one task at a time, so a cluster has ``threads`` times its cores in flight at most."""
    schema = df.withColumn(answer, F.lit(None).cast("string")).schema
    key = sha256(cloudpickle.dumps(completer)).digest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = _client(key, completer)

        def one(p: str) -> str | None:
            for _ in range(attempts):
                try:
                    return client.complete([p])[0]
                except Exception:  # noqa: BLE001  a client may raise anything
                    continue
            return None

        failed = 0
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                got = []
                for i in range(0, len(batch), give_up):
                    for a in pool.map(one, batch[prompt].iloc[i : i + give_up]):
                        failed = 0 if a is not None else failed + 1
                        got.append(a)
                    if failed >= give_up:
                        raise RuntimeError(f"{failed} calls in succession failed")
                yield batch.assign(**{answer: got})

    return df.mapInPandas(run, schema)


def ask_once(df: DataFrame, prompt: str, answer: str, completer: Callable[[], Completer], store: str, wave: int = 100_000, **options) -> DataFrame:
    """``ask``, with answers that outlive the run: they are kept in the folder ``store`` by the digest of their prompt, and
    only prompts without one are sent. Equal prompts are sent once; failed calls are not kept, so they are sent again.

    Prompts go out in waves of about ``wave``, by their digests; each wave is a job that adds its answers when it is done, so
    a run that breaks off has lost one wave at most, whatever executors it loses. ``progress`` reads how far it is.
    """
    spark = df.sparkSession
    rows = stored(df.withColumn("_digest", F.sha2(prompt, 256)), "asked")
    asked = rows.where(F.col(prompt).isNotNull()).select("_digest", F.col(prompt).alias("_prompt")).dropDuplicates(["_digest"])
    open_prompts = stored(asked.join(_answers(spark, store).select("_digest"), "_digest", "left_anti"), "open-prompts")
    waves = max(1, -(-open_prompts.count() // wave))
    for n in range(waves):
        part = open_prompts.where(F.pmod(F.xxhash64("_digest"), F.lit(waves)) == n)
        got = ask(part, "_prompt", "_answer", completer, **options).where("_answer is not null")
        got.select("_digest", "_answer").write.mode("append").parquet(f"{store}/answers")
        spark.createDataFrame([(waves, n + 1)], "waves int, done int").coalesce(1).write.mode("overwrite").parquet(f"{store}/progress")
    return rows.join(_answers(spark, store).withColumnRenamed("_answer", answer), "_digest", "left").drop("_digest")


def _answers(spark: SparkSession, store: str) -> DataFrame:
    schema = "_digest string, _answer string"
    if not exists(spark, f"{store}/answers"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{store}/answers").dropDuplicates(["_digest"])


def progress(spark: SparkSession, store: str) -> DataFrame:
    """One row: waves and done of the run that is at work or was last, and answers (all that are kept)."""
    at = spark.read.parquet(f"{store}/progress") if exists(spark, f"{store}/progress") else spark.createDataFrame([(0, 0)], "waves int, done int")
    return at.crossJoin(F.broadcast(_answers(spark, store).agg(F.count("*").alias("answers"))))


def embed(df: DataFrame, column: str, embedder: Callable[[], Embedder]) -> DataFrame:
    """Adds ``embedding``, unit vectors of the column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = embedder()
        for batch in batches:
            m = model.embed([x or "" for x in batch[column]])
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            yield batch.assign(embedding=list((m / np.where(norm > 0, norm, 1)).astype(np.float64)))

    return df.mapInPandas(run, df.withColumn("embedding", F.lit(None).cast("array<double>")).schema)


def rank_score(query: Column, rank: Column) -> Column:
    """The offline judge: scores 3, 2, 1, 0 down the ranks, shifted by query; every seventh query has no 1."""
    block = F.floor(query / 10)
    at = rank + block % 14
    return F.when(at <= 2, 3).when(at <= 6, 2).when(at <= 12, F.when(block % 7 == 3, 0).otherwise(1)).otherwise(0).cast("int")
