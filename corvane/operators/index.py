"""An inverted file of vectors: cells around centres, kept as the partitions of a table, and searches that read few of them.

A folder holds ``centres`` (a row a cell), ``vectors`` (partitioned by cell) and ``about`` (what searches need to know, written
last). Every vector is in the cell of its nearest centre. A search goes to the cells whose centres are nearest to a query and
reads no others; within them it is exact. Appended vectors join the cells that there are.

Nulls and edge cases: rows without an id or a vector are not indexed. Rows that repeat an id are kept each; ``append`` skips
ids that the index has, so it may be repeated. An empty corpus gives an index that finds nothing. Vectors have one length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import vectors

#: Bytes of all centres, which every worker holds.
CENTRE_BYTES = 64 << 20


def _assign(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """Adds each vector's cell."""
    for batch in batches:
        if batch.num_rows:
            own = (vectors._matrix(batch.column("embedding")) @ sent.value.T).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], ["doc_id", "embedding", "cell"])


def _put(corpus: DataFrame, centres: np.ndarray, path: str) -> None:
    """Write vectors to their cells. Partitions are balanced by what they hold, so that small cells make one file and a
    large one is written by several tasks."""
    sent = corpus.sparkSession.sparkContext.broadcast(centres)
    kind = corpus.schema["embedding"].dataType.simpleString()
    placed = corpus.mapInArrow(partial(_assign, sent=sent), f"doc_id long, embedding {kind}, cell int")
    placed.hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(f"{path}/vectors")


def _rows(corpus: DataFrame) -> DataFrame:
    return corpus.select(F.col("doc_id").cast("long").alias("doc_id"), "embedding").where("doc_id is not null and embedding is not null")


def _centres(spark: SparkSession, path: str) -> np.ndarray:
    found = spark.read.parquet(f"{path}/centres").orderBy("cell").select("centre").toArrow().combine_chunks()
    return vectors._matrix(found.column("centre").combine_chunks()) if found.num_rows else np.zeros((0, 1))


def build(corpus: DataFrame, path: str, k: int = 10, recall: float = 0.95, cells: int | None = None, sample: int = 20_000, seed: int = 42) -> None:
    """A new index of all of ``corpus`` (doc_id, embedding) in the folder ``path``.

    Centres come from at most ``sample`` rows; their number follows the number of rows unless it is given, up to
    ``CENTRE_BYTES``. How many cells hold a share ``recall`` of the exact ``k`` best of other rows is found once, for 512
    rows as queries, and kept for searches.
    """
    spark, rows = corpus.sparkSession, _rows(corpus)
    sizes = rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).select("n", "width", *vectors.cell_parameters(F.col("n"))).first()
    most = max(1, CENTRE_BYTES // (8 * max(1, sizes.width or 1)))
    centres = vectors.cells(rows, min(cells or sizes.cells, most), sample, seed) if sizes.n else np.zeros((0, 1))
    table = [(c, [float(x) for x in v]) for c, v in enumerate(centres)]
    spark.createDataFrame(table, "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    _put(rows, centres, path)
    own = rows.withColumnRenamed("doc_id", "query_id")
    probes = vectors.probes_for(own, rows, k + 1, centres, min(sizes.probes, len(centres)), recall, seed=seed) if sizes.n else 0
    spark.createDataFrame([(sizes.width or 0, probes)], "width int, probes int").coalesce(1).write.parquet(f"{path}/about")


def append(corpus: DataFrame, path: str) -> None:
    """Add the rows of ``corpus`` whose ids the index does not have."""
    spark = corpus.sparkSession
    centres = _centres(spark, path)
    if not len(centres):
        raise ValueError("an index of no rows has no cells: build it anew")
    _put(_rows(corpus).join(stored_vectors(spark, path).select("doc_id"), "doc_id", "left_anti"), centres, path)


def stored_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The table of vectors: doc_id, embedding, cell."""
    try:
        return spark.read.parquet(f"{path}/vectors").select("doc_id", "embedding", F.col("cell").cast("int").alias("cell"))
    except AnalysisException:  # nothing was indexed, so no file has a schema
        return spark.createDataFrame([], "doc_id long, embedding array<double>, cell int")


def _best(batches: Iterator[pa.RecordBatch], sent, k: int) -> Iterator[pa.RecordBatch]:
    """The best k of a partition for each query, among rows whose cell the query probes."""
    ids, queries, askers, begin = sent.value
    best = vectors.Best(vectors.Scorer(queries), k)
    for batch in batches:
        if not batch.num_rows:
            continue
        docs, m, own = batch.column("doc_id").to_numpy(), vectors._matrix(batch.column("embedding")), batch.column("cell").to_numpy()
        for c in np.unique(own):
            here = own == c
            best.add(docs[here], m[here], askers[begin[c] : begin[c + 1]])
    yield from best.batches(ids)


def search(queries: DataFrame, path: str, k: int, probes: int | None = None) -> DataFrame:
    """Per query (query_id, embedding) the k best of the rows in its ``probes`` nearest cells: query_id, doc_id, score, rank;
    ties by doc_id. Without ``probes`` as many as the index keeps for its recall; with as many as there are cells it is the
    exact search.

    Queries are a stated set and go to all workers in blocks of bounded size; a block reads the cells that its queries
    probe, once, and no other file.
    """
    spark = queries.sparkSession
    about, centres, corpus = spark.read.parquet(f"{path}/about").first(), _centres(spark, path), stored_vectors(spark, path)
    found = spark.createDataFrame([], "query_id long, doc_id long, score double")
    if len(centres):
        probes = min(len(centres), about.probes if probes is None else probes)
        rows = max(1, vectors.PASS_BYTES // (8 * (about.width + 2 * k + probes)))
        blocks = max(1, -(-queries.count() // rows))
        for b in range(blocks):
            block = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
            got = block.select(F.col("query_id").cast("long"), "embedding").where("embedding is not null").toArrow().combine_chunks()
            if not got.num_rows:
                continue
            m = vectors._matrix(got.column("embedding").combine_chunks())
            # queries exploded to the cells that they probe, by cell
            near = np.concatenate([np.argpartition(-(m[i : i + 4096] @ centres.T), probes - 1, axis=1)[:, :probes] for i in range(0, len(m), 4096)])
            askers = np.repeat(np.arange(len(m)), probes)[np.argsort(near.reshape(-1), kind="stable")]
            begin = np.searchsorted(np.sort(near.reshape(-1)), np.arange(len(centres) + 1))
            sent = spark.sparkContext.broadcast((got.column("query_id").to_numpy(), m, askers, begin))
            # a filter by partition: other cells' files are not opened
            read = corpus.where(F.col("cell").isin([int(c) for c in np.unique(near)]))
            found = found.union(read.mapInArrow(partial(_best, sent=sent, k=k), "query_id long, doc_id long, score double"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
