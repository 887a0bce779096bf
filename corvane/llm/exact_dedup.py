"""Exact de-duplication as a stateful stream.

A stream of (digest, identifier, length, locator) rows meets keyed state on disk (RocksDB) that never expires: per digest
it retains the row to keep, its locator and the group's size. Rows of one digest are combined inside each task before
they are shuffled, so a digest that holds a third of all rows costs one row per task. The state outlives the run: give
``state`` a folder and later runs add only new rows to it; each answers for its own rows against all that came before.

A digest only proposes. On hits, digests that more than one row has, the whole normalised texts are compared: those of
this run, and, fetched through its locator, the first text that the state has met under the digest, if that was in an
earlier run; the texts of earlier runs were compared with it then. They are grouped by
(digest, text), again combined before the shuffle. Where a digest stands for one text, as it does unless it collides, the
state's answer holds; otherwise all its rows, earlier ones by their locators, are regrouped by text.

Nulls and edge cases: null text counts as empty, and all empty texts (also those of white space only) are equal. Of equal
texts the one with the most code points stays, then the smallest doc_id; a null doc_id comes last. Rows that repeat a
doc_id share its answer, also ``kept``; ``distinct_documents`` keeps one of them. Texts are compared whole; a task holds a
few at a time, so the longest text bounds its memory. An empty table gives an empty result. Other columns are ignored,
whatever their names.

With ``state``, earlier tables must still be where they were read from, unchanged, and every table must come from files;
one that does not is refused before anything is written. A run reads what its own rows changed in the state, not the
changes of earlier runs, and of earlier tables only the files that hold hits, ``FILES`` at a time. Only digests that are known
to stand for several texts make it look through the rows of all runs.
"""

from __future__ import annotations

from itertools import islice
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import keep, new_path, null_safe, only_keys, scope, small, unused

#: Keyed state on disk, sent to the checkpoint as changes; without files allocated ahead, which many small stores multiply. A
#: store is closed with its task: an executor has as many open as it has cores, not one for each partition until a minute
#: after the stream.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
#: Bytes of narrow rows that one micro-batch takes in.
BATCH_BYTES = 4_000_000_000
#: Files of earlier tables that are read at a time.
FILES = 10_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(null_safe(text), r"[\x20\x09-\x0D]+", "")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text's UTF-8 bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


def _in_files(docs: DataFrame) -> bool:
    """Whether rows can be found again by file and place."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return False
    return True


def _located(docs: DataFrame, columns: list[Column]) -> DataFrame:
    """``columns`` and the locator: a file and a row in it where the table is read from files, else the doc_id."""
    if _in_files(docs):
        return docs.select(*columns, F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string")).alias("locator"))
    return docs.select(*columns, F.concat(F.lit("doc:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("locator"))


def _narrow(digest_of) -> list[Column]:
    return [F.col("doc_id").cast("long").alias("doc_id"), digest_of(F.col("text")).cast("binary").alias("digest"), F.length(null_safe(F.col("text"))).cast("long").alias("n_chars"), F.xxhash64("text").alias("text_key")]


def _best() -> Column:
    """The row to keep sorts first."""
    return F.struct((-F.col("n_chars")).alias("shorter"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "locator")


def _whole(digest_of) -> list[Column]:
    return [*_narrow(digest_of)[:3], normalised(F.col("text")).alias("whole"), F.xxhash64("text").alias("text_key")]


#: Rows of the stream, and what its state says of a digest; ``first`` is a row of the first run that had it.
ROW = "doc_id long, digest binary, n_chars long, text_key long, locator string, turn long"
GROUP = "digest binary, best struct<shorter: long, unnamed: boolean, doc_id: long, locator: string>, first struct<turn: long, locator: string>, size long"


def stream_groups(spark: SparkSession, path: str, state: str, since: int = 0) -> DataFrame:
    """Run the stream over the narrow rows in and under ``path``; ``state`` keeps checkpoints, keyed state and what changed
    in each micro-batch. Returns per digest that changed in micro-batch ``since`` or later the latest: best, first, size."""
    had = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        rows = spark.readStream.schema(ROW).option("maxBytesPerTrigger", BATCH_BYTES).option("recursiveFileLookup", "true").parquet(path)
        grouped = rows.groupBy("digest").agg(F.min(_best()).alias("best"), F.min(F.struct("turn", "locator")).alias("first"), F.count("*").alias("size"))
        changed = f"{state}/changed"

        def write(batch: DataFrame, n: int) -> None:
            # a replayed batch overwrites its own folder
            batch.withColumn("batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{changed}/n={n}")

        grouped.writeStream.outputMode("update").option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    finally:
        for k, v in had.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    names = f"{GROUP}, batch long"
    parts = [f"{changed}/n={n}" for n in _batches(spark, state) if n >= since]
    found = spark.read.schema(names).parquet(*parts) if parts else spark.createDataFrame([], names)
    return found.groupBy("digest").agg(F.max_by(F.struct("best", "first", "size"), "batch").alias("now")).select("digest", "now.best", "now.first", "now.size")


def _listed(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, none if it is missing."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []


def _batches(spark: SparkSession, state: str) -> list[int]:
    """Micro-batches that changed the state, a folder each."""
    return sorted(int(x[2:]) for x in _listed(spark, f"{state}/changed") if x.startswith("n="))


def _begun(spark: SparkSession, state: str, run: str) -> tuple[int, int]:
    """This run's turn, and the first micro-batch that can hold its rows; kept, so that a repeated call finds them again."""
    path = f"{state}/runs/{run}"
    if not _exists(spark, f"{path}/_SUCCESS"):
        past = _batches(spark, state)
        spark.createDataFrame([(len(_listed(spark, f"{state}/runs")), past[-1] + 1 if past else 0)], "turn long, since long").coalesce(1).write.mode("overwrite").parquet(path)
    row = spark.read.parquet(path).first()
    return row.turn, row.since


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _fetched(spark: SparkSession, places: DataFrame, digest_of) -> DataFrame:
    """Rows of earlier tables, by the kept table ``places`` (locator), from the files that hold them, as ``_whole`` has
    them. ``FILES`` names of files are held at a time."""
    found = spark.createDataFrame([], "doc_id long, digest binary, n_chars long, whole string, text_key long, locator string")
    names = places.select(F.substring_index("locator", "#", 1).alias("file")).distinct().sort("file").toLocalIterator()
    while files := [r.file for r in islice(names, FILES)]:
        found = found.unionByName(keep(only_keys(_located(spark.read.parquet(*files), _whole(digest_of)), places, ["locator"], 400), "exact-fetched"))
    return found


def _earlier(spark: SparkSession, state: str, own: str) -> DataFrame:
    """Narrow rows of the runs before."""
    others = [f"{state}/rows/{x}" for x in _listed(spark, f"{state}/rows") if x != own]
    return spark.read.schema(ROW).parquet(*others) if others else spark.createDataFrame([], ROW)


def deduplicate(docs: DataFrame, digest_of=digest, state: str | None = None, run: str | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, text_key, n_chars, keep_id, group_size, kept, text_sha256 (the digest in lowercase hex),
    locator (where the kept content is).

    digest_of: text column to digest column; a weaker one costs comparisons, not correctness.
    state: a folder that outlives the run; without it a new one. run: this run's name there; a call that failed may be
    repeated under its name and takes its rows in once.
    """
    spark = docs.sparkSession
    if state and not _in_files(docs):
        raise ValueError("a state that outlives the run finds texts again by file and row: write the table to files and read it from there")
    state, run = state or new_path(spark, "exact-state"), run or uuid4().hex
    turn, since = _begun(spark, state, run)
    began = turn > 0
    if not _exists(spark, f"{state}/rows/{run}/_SUCCESS"):
        _located(docs, _narrow(digest_of)).withColumn("turn", F.lit(turn).cast("long")).write.mode("overwrite").option("compression", "zstd").parquet(f"{state}/rows/{run}")
    rows = spark.read.schema(ROW).parquet(f"{state}/rows/{run}")
    groups = stream_groups(spark, f"{state}/rows", state, since)
    if began:  # digests of this run only
        groups = groups.join(rows.select("digest").distinct(), "digest", "left_semi")
    groups = keep(groups, "exact-groups")

    # whole texts of hits: this run's, and one that the state retains from before
    hit = keep(groups.where("size > 1").select("digest"), "exact-hits")
    texts = only_keys(_located(docs, _whole(digest_of)), hit, ["digest"])
    seen = texts.select("digest", "whole")
    if began:
        one = keep(groups.where((F.col("size") > 1) & (F.col("first.turn") < turn)).select("first.locator"), "exact-before")
        seen = seen.unionByName(_fetched(spark, one, digest_of).select("digest", "whole"))
    different = seen.groupBy("digest", "whole").agg(F.lit(1).alias("one")).groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")
    if began and _exists(spark, f"{state}/collided"):  # digests known to stand for several texts
        known = spark.read.schema("digest binary").option("recursiveFileLookup", "true").parquet(f"{state}/collided")
        different = different.unionByName(only_keys(known, hit, ["digest"])).distinct()
    different.write.mode("overwrite").parquet(f"{state}/collided/{run}")
    different = spark.read.schema("digest binary").parquet(f"{state}/collided/{run}")

    fields = ["doc_id", "text_key", "n_chars", "digest", "best", "size"]
    answer = rows.drop("locator", "turn").join(groups.drop("first"), "digest").select(*fields)
    if not different.isEmpty():
        apart = keep(only_keys(texts, different, ["digest"]), "exact-apart")
        all_texts = apart
        if began:
            places = keep(only_keys(_earlier(spark, state, run), different, ["digest"]).select("locator"), "exact-places")
            all_texts = apart.unionByName(_fetched(spark, places, digest_of))
        classes = all_texts.groupBy("digest", "whole").agg(F.min(_best()).alias("best"), F.count("*").alias("size"))
        regrouped = apart.join(classes, ["digest", "whole"])
        answer = answer.join(different, "digest", "left_anti").unionByName(regrouped.select(*fields))
    best = [F.col("best.doc_id").alias("keep_id"), F.col("size").alias("group_size"), F.lower(F.hex("digest")).alias("text_sha256"), F.col("best.locator").alias("locator")]
    return answer.select("doc_id", "text_key", "n_chars", *best, F.col("doc_id").eqNullSafe(F.col("best.doc_id")).alias("kept"))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with all their columns."""
    key, copy, kept_id, kept_key = unused(docs, "text_key", "copy", "kept_id", "kept_key")
    with scope(docs.sparkSession):
        # rows of a group that share the kept doc_id: the longest, once
        kept = deduplicate(docs).where("kept").groupBy("doc_id", "text_sha256").agg(F.max(F.struct("n_chars", "text_key")).alias("longest"), F.count("*").alias("rows"))
        once = keep(kept.select(F.col("doc_id").alias(kept_id), F.col("longest.text_key").alias(kept_key), "rows"), "exact-kept", outside=True)
    side = once.select(kept_id, kept_key)
    rows = docs.withColumn(key, F.xxhash64("text"))
    stays = rows.join(F.broadcast(side) if small(once) else side, F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)) & (F.col(key) == F.col(kept_key)), "left_semi")
    # rows that repeat a kept row with its doc_id
    if not once.where("rows > 1").isEmpty():
        stays = stays.withColumn(copy, F.row_number().over(Window.partitionBy("doc_id", key).orderBy(F.monotonically_increasing_id()))).where(F.col(copy) == 1)
    return stays.select(*docs.columns)
