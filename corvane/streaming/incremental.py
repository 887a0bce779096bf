"""Incremental forms: a file stream, a checkpoint that remembers what was read, and idempotent appends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import digest


def _run(stream: DataFrame, state: str, each: Callable[[DataFrame, int], None]) -> None:
    stream.writeStream.option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).foreachBatch(each).start().awaitTermination()


def append_index(spark: SparkSession, source: str, schema: str, target: str, prepare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Adds the new files of ``source`` to the table; a batch that is run again replaces its own part."""

    def each(batch: DataFrame, n: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{target}/table/batch={n}")

    _run(spark.readStream.schema(schema).parquet(source), target, each)
    return spark.read.parquet(f"{target}/table").drop("batch")


def generate_missing(spark: SparkSession, source: str, schema: str, target: str, key: str, generate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs a generator on rows whose key has no output yet."""

    def each(batch: DataFrame, n: int) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/table")
        new = batch.dropDuplicates([key])
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            done = spark.read.parquet(f"{target}/table").where(F.col("batch") != n).select(key)
            new = new.join(done, key, "left_anti")
        generate(new).write.mode("overwrite").parquet(f"{target}/table/batch={n}")

    _run(spark.readStream.schema(schema).parquet(source), target, each)
    return spark.read.parquet(f"{target}/table").drop("batch")


def stream_reservoir(spark: SparkSession, source: str, schema: str, target: str, k: int, seed: int | str, key: str) -> DataFrame:
    """A uniform sample of k rows of all files so far: the k least digests of a batch merge with those before it."""

    def each(batch: DataFrame, n: int) -> None:
        marked = batch.withColumn("_d", digest(seed, key))
        if n:
            marked = marked.unionByName(spark.read.parquet(f"{target}/sample/{n - 1}"))
        marked.orderBy("_d", key).limit(k).write.mode("overwrite").parquet(f"{target}/sample/{n}")
        spark.createDataFrame([(n,)], "n long").coalesce(1).write.mode("overwrite").parquet(f"{target}/last")

    _run(spark.readStream.schema(schema).parquet(source), target, each)
    last = spark.read.parquet(f"{target}/last").first().n
    return spark.read.parquet(f"{target}/sample/{last}").drop("_d")


def stream_distinct(spark: SparkSession, source: str, schema: str, target: str, keys: list[str]) -> DataFrame:
    """The keys of all files so far, each once, by unbounded keyed state."""

    def each(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/table/batch={n}")

    _run(spark.readStream.schema(schema).parquet(source).select(*keys).dropDuplicates(keys), target, each)
    return spark.read.parquet(f"{target}/table").drop("batch")
