"""Sessions, and the folder that jobs share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "corvane", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; other settings come from the cluster or ``conf``."""
    base = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    return SparkSession.builder.appName(name).config(map=base | conf).getOrCreate()


def ensure_checkpoints(spark: SparkSession) -> str:
    """The checkpoint folder; a temporary one only for a local master that has none."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="corvane-")
        atexit.register(shutil.rmtree, found, True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


#: Folders of applications that are removed when the process ends.
_folders: set[str] = set()


def _clear(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share; it goes when the process ends."""
    top = f"{ensure_checkpoints(spark).rstrip('/')}/stored/{spark.sparkContext.applicationId}"
    if top not in _folders:
        _folders.add(top)
        atexit.register(_clear, spark, top)
    return f"{top}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df``, computed once: written to the shared folder and read back, so that lineage ends here. (A checkpoint computes
    its last stage twice.) The table goes when the process ends."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
