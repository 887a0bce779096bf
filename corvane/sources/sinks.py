"""Writers. Spark's commit protocol publishes a folder at once; single files go through a staged rename."""

from __future__ import annotations

import contextlib
import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from hashlib import sha256
from uuid import uuid4

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .arrow_files import located
from .readers import _fs


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_batch(df: DataFrame, path: str, header: Mapping[str, object]) -> None:
    """Results as Parquet and the header beside them: the distributed form of a nested batch file."""
    df.write.mode("overwrite").parquet(f"{path}/results")
    replace_file(df.sparkSession, f"{path}/header.json", json.dumps(dict(header), ensure_ascii=False))


def replace_file(spark: SparkSession, path: str, content: str) -> None:
    """Written beside the target, then renamed over it."""
    fs, where = _fs(spark, path)
    _, staged = _fs(spark, path + ".staged")
    out = fs.create(staged, True)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()
    fs.delete(where, False)
    if not fs.rename(staged, where):
        raise OSError(f"cannot publish {path}")


def append_new(df: DataFrame, path: str, key: str) -> DataFrame:
    """Appends rows whose key the table does not have; returns them."""
    fs, where = _fs(df.sparkSession, path)
    new = df
    if fs.exists(where):
        new = df.join(df.sparkSession.read.parquet(path).select(key), key, "left_anti")
    new.write.mode("append").parquet(path)
    return new


def write_beir(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, folder: str) -> None:
    corpus.select(F.col("doc_id").cast("string").alias("_id"), F.lit("").alias("title"), "text").write.mode("overwrite").json(f"{folder}/corpus")
    queries.select(F.col("query_id").cast("string").alias("_id"), "text").write.mode("overwrite").json(f"{folder}/queries")
    rows = qrels.select(F.col("query_id").cast("string").alias("query-id"), F.col("doc_id").cast("string").alias("corpus-id"), F.col("rel").alias("score"))
    rows.orderBy("query-id", "corpus-id").write.mode("overwrite").options(sep="\t", header="true").csv(f"{folder}/qrels")


def write_lines(df: DataFrame, path: str) -> None:
    """A column ``value``, such as lines of a TREC run."""
    df.select("value").write.mode("overwrite").text(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_parts(df: DataFrame, path: str, part: str) -> None:
    """One folder a part."""
    df.write.mode("overwrite").partitionBy(part).json(path)


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def publish(spark: SparkSession, staged: str, path: str) -> None:
    """A folder appears under its name at once, by one rename; what is there already is never replaced."""
    fs, where = _fs(spark, path)
    if fs.exists(where):
        if fs.listStatus(where):
            raise FileExistsError(f"{path} is not empty")
        fs.delete(where, False)
    fs.mkdirs(where.getParent())
    if not fs.rename(_fs(spark, staged)[1], where):
        raise OSError(f"cannot publish {path}")


def write_checked(df: DataFrame, path: str, counters: Mapping[str, Column], broken: Callable[[dict], str | None], keep: Column | None = None, columns: Sequence[str] | None = None) -> dict:
    """Write ``df``, or its rows where ``keep`` and of them ``columns``, as Parquet, and count in the same pass.

    counters: aggregates over all rows of ``df``, observed while they are written; no second job reads them. broken: says
    from the counters what is wrong, or None. Where something is, the staged output goes and ValueError tells what; else it
    is published under ``path``, which must be new. Returns the counters.
    """
    spark, seen, staged = df.sparkSession, Observation(), f"{path}.staged-{uuid4().hex}"
    rows = df.observe(seen, *(c.alias(n) for n, c in counters.items()))
    rows = rows if keep is None else rows.where(keep)
    try:
        (rows if columns is None else rows.select(*columns)).write.parquet(staged)
        found = seen.get
        wrong = broken(found)
        if wrong:
            raise ValueError(wrong)
        publish(spark, staged, path)
    except BaseException:
        delete(spark, staged)
        raise
    return found


def write_complement(full: DataFrame, sample: DataFrame, key: str, path: str) -> dict:
    """Write the rows of ``full`` outside ``sample``, with the proof that it is a part of ``full``, in one pass: full, sample,
    complement, foreign (rows of the sample that ``full`` does not hold alike) and repeated (keys that a side has twice).
    Where a row is foreign or a key repeats, nothing is written and ValueError tells why. Null is a key like others."""
    row = F.struct(*full.columns)
    side = lambda df, name: df.select(F.col(key).alias("_k"), *(row.alias(n) if n == name else F.lit(None).cast(full.select(row).schema[0].dataType).alias(n) for n in ("_f", "_s")))
    held = side(full, "_f").unionByName(side(sample, "_s")).groupBy("_k").agg(*(x for n in ("_f", "_s") for x in (F.first(n, ignorenulls=True).alias(n), F.count(n).alias(f"n{n}"))))
    outside = F.col("n_s") == 0
    counters = {
        "full": F.coalesce(F.sum("n_f"), F.lit(0)),
        "sample": F.coalesce(F.sum("n_s"), F.lit(0)),
        "complement": F.count_if(outside),
        "foreign": F.count_if((F.col("n_s") > 0) & ~F.col("_f").eqNullSafe(F.col("_s"))),
        "repeated": F.count_if((F.col("n_f") > 1) | (F.col("n_s") > 1)),
    }

    def broken(n: dict) -> str | None:
        if n["repeated"]:
            return f"{n['repeated']} keys repeat"
        return f"{n['foreign']} rows of the sample are not in the table" if n["foreign"] else None

    rows = held.select(*(F.col(f"_f.`{c}`").alias(c) for c in full.columns), "_f", "_s", "n_f", "n_s")
    return write_checked(rows, path, counters, broken, outside, full.columns)


#: Bytes of a file that are held while it is read.
CHUNK = 1 << 20


def _opened(path: str, write: bool = False):
    """A stream of a file in any store that ``pyarrow`` knows."""
    store, name = located(path)
    if write:
        store.create_dir(name.rsplit("/", 1)[0], recursive=True)
        return store.open_output_stream(name)
    return store.open_input_stream(name)


def _streamed(source: str, target: str | None) -> tuple[int, int, str]:
    """Lines that are not blank, bytes and SHA-256 of a file, read in chunks; it is copied on the way."""
    digest, size, lines, blank = sha256(), 0, 0, True
    with _opened(source) as read, contextlib.ExitStack() as stack:
        out = stack.enter_context(_opened(target, True)) if target else None
        while chunk := read.read(CHUNK):
            digest.update(chunk)
            size += len(chunk)
            if out:
                out.write(chunk)
            # a line may go on from the chunk before
            first, *rest = chunk.split(b"\n")
            blank = blank and not first.strip()
            for part in rest:
                lines += not blank
                blank = not part.strip()
    return lines + (not blank), size, digest.hexdigest()


def _footer_rows(path: str) -> int:
    store, name = located(path)
    return pq.read_metadata(name, filesystem=store).num_rows


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, source, target in zip(*(batch.column(c).to_pylist() for c in ("path", "source", "target")), strict=True):
            lines, size, digest = _streamed(source, target)
            rows = _footer_rows(source) if path.endswith(".parquet") else lines
            yield pa.RecordBatch.from_pylist([{"path": path, "rows": rows, "bytes": size, "sha256": digest}], pa.schema([("path", pa.string()), ("rows", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """Names below a folder, relative to it, where they are, and their lengths; empty files too. Hidden ones are left out."""
    fs, where = _fs(spark, folder)
    base, rows = fs.getFileStatus(where).getPath().toString(), []
    listed = fs.listFiles(where, True)
    while listed.hasNext():
        file = listed.next()
        path = file.getPath().toString()
        name = path.removeprefix(base + "/") if path != base else path.rsplit("/", 1)[1]
        if not any(x.startswith((".", "_")) for x in name.split("/")):
            rows.append((name, path, file.getLen()))
    return spark.createDataFrame(rows, "path string, source string, length long")


def _listed(files: DataFrame) -> DataFrame:
    """Files dealt to tasks one by one, since a file is a stream of its own."""
    n = max(1, min(files.count(), 10_000))
    return files.repartition(n, "path").mapInArrow(_digested, "path string, rows long, bytes long, sha256 string")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """path (below the folder), rows, bytes and sha256 of every file. rows are those of a Parquet file's footer, or else the
    lines that are not blank. Executors read files as streams, whatever their size."""
    return _listed(_files(spark, folder).withColumn("target", F.lit(None).cast("string")))


def package(spark: SparkSession, sources: Mapping[str, str], target: str, about: Mapping[str, object] | None = None) -> DataFrame:
    """Copy files and folders into a release: ``sources`` maps names below ``target`` to where they are. Returns, and leaves
    as ``manifest.json`` beside the files, what ``manifest`` says of each, with what ``about`` adds.

    Executors copy and digest in one pass into a staging folder. Only when every file is there with its whole length is
    the folder renamed; a copy that fails publishes nothing, and a target that is not empty is refused.
    """
    fs, where = _fs(spark, target)
    if fs.exists(where) and fs.listStatus(where):
        raise FileExistsError(f"{target} is not empty")
    # with its store's name, as executors see it
    staged = fs.makeQualified(_fs(spark, f"{target}.staged-{uuid4().hex}")[1]).toString()
    found = None
    for name, source in sources.items():
        one = _fs(spark, source)
        files = _files(spark, source)
        path = F.concat(F.lit(name + "/"), F.col("path")) if one[0].getFileStatus(one[1]).isDirectory() else F.lit(name)
        files = files.select(path.alias("path"), "source", "length", F.concat(F.lit(staged + "/"), path).alias("target"))
        found = files if found is None else found.unionByName(files)
    try:
        copied = stored(_listed(found), "package").orderBy("path")
        short = found.join(copied, "path", "left").where("bytes is null or bytes <> length").select("path").first()
        if short is not None:
            raise OSError(f"{short.path} was not copied whole")
        rows = [r.asDict() for r in copied.collect()]  # a row a file, as the manifest lists them
        replace_file(spark, f"{staged}/manifest.json", json.dumps({**(about or {}), "files": rows}, ensure_ascii=False, indent=2))
        publish(spark, staged, target)
    except BaseException:
        delete(spark, staged)
        raise
    return copied
