"""Tables between jobs, kept in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table that may be broadcast, counted as rows by a width that the caller states.
BROADCAST_BYTES = 64_000_000


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only for a local master without that setting."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="corvane-")
    atexit.register(shutil.rmtree, path, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{path}")
    return f"file://{path}"


class _Scopes(threading.local):
    """Paths of the scopes that are open in this thread, innermost last."""

    def __init__(self) -> None:
        self.open: list[list[str]] = []


_scopes = _Scopes()


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, the tables kept inside it but for those kept with ``outside``."""
    _scopes.open.append([])
    try:
        yield
    finally:
        for path in _scopes.open.pop():
            _delete(spark, path)


#: Folders of applications that are removed when the process ends.
_folders: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _clear(spark: SparkSession, folder: str) -> None:
    """Tables that results still depended on go with the application; after the session is stopped they stay."""
    if spark.sparkContext._jsc is not None:
        _delete(spark, folder)


def new_path(spark: SparkSession, name: str, outside: bool = False) -> str:
    folder = f"{shared_dir(spark)}/corvane/{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_clear, spark, folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    scopes = _scopes.open[:-1] if outside else _scopes.open
    if scopes:
        scopes[-1].append(path)
    return path


#: Rows that go to a Python worker at a time while a table is kept: whole texts lie in both processes.
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def keep(df: DataFrame, name: str, outside: bool = False, rows: int = 1000) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path, had = new_path(spark, name, outside), spark.conf.get(ROWS)
    spark.conf.set(ROWS, str(rows))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(ROWS, had)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, width: int = 64) -> bool:
    """Whether a kept table is within the broadcast bound. Its row count comes from Parquet footers; ``width`` is what a row
    takes at most: 64 bytes hold four numbers or a digest and one of them."""
    return df.count() * width <= BROADCAST_BYTES


def only_keys(df: DataFrame, keys: DataFrame, on: list[str], width: int = 64) -> DataFrame:
    """Rows of ``df`` whose ``on`` is in the kept table ``keys``: by broadcast up to the bound, else by a shuffled semi join."""
    side = F.broadcast(keys.select(*on)) if small(keys, width) else keys.select(*on)
    return df.join(side, on, "left_semi")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names that start with ``names`` and that ``df`` does not have, whatever its own are called."""
    had = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in had:
            name += "_"
        out.append(name)
    return out


def has(df: DataFrame, column: str) -> bool:
    return column in df.columns


def null_safe(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))
