"""Corpus and benchmark readers. All give plain DataFrames; rows that a reader rejects stay countable where the format
counts them."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relational import numbered, running
from ..session import stored
from . import arrow_files

# Column names by which a corpus is read, first match first.
ID_NAMES = ("_id", "id", "pid", "doc_id", "docid", "document_id")
TEXT_NAMES = ("text", "passage", "body", "content", "document")
TITLE_NAMES = ("title", "doc_title")
# Keys under which a JSON file may hold its records.
RECORD_KEYS = ("data", "examples", "questions", "instances", "rows")

FORMATS = {".tsv": "tsv", ".csv": "csv", ".jsonl": "jsonl", ".ndjson": "jsonl", ".parquet": "parquet"}


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def format_of(path: Column) -> Column:
    """The format that a file's name tells, in any case; null if it tells none."""
    found = F.lit(None).cast("string")
    for ext, name in FORMATS.items():
        found = F.when(F.lower(path).endswith(ext), name).otherwise(found)
    return found


def detect_format(spark: SparkSession, path: str) -> str:
    """By extension; a folder is Arrow files, or Parquet if it holds such."""
    for ext, name in FORMATS.items():
        if path.lower().endswith(ext):
            return name
    fs, where = _fs(spark, path)
    if fs.exists(where) and fs.getFileStatus(where).isDirectory():
        names = [f.getPath().getName() for f in fs.listStatus(where)]
        return "parquet" if any(n.endswith(".parquet") for n in names) else "arrow"
    raise ValueError(f"unknown corpus format: {path}")


def find_column(columns: Sequence[str], names: Sequence[str], given: str | None = None) -> str | None:
    """The given column, or the first of ``names`` that there is, ignoring case."""
    known = {c.lower(): c for c in reversed(columns)}
    if given:
        if given.lower() not in known:
            raise ValueError(f"no column {given} among {list(columns)}")
        return known[given.lower()]
    return next((known[n] for n in names if n in known), None)


def header_of(first: str, sep: str) -> tuple[list[str], bool]:
    """Column names from the first line, and whether it is a header: at least two cells are known names."""
    cells = first.rstrip("\r\n").split(sep)
    known = {*ID_NAMES, *TEXT_NAMES, *TITLE_NAMES}
    if sum(c.strip().lower() in known for c in cells) >= 2:
        return [c.strip() for c in cells], True
    names = ["pid", "passage"] if len(cells) == 2 else ["pid", "title", "passage", *(f"_col{i}" for i in range(3, len(cells)))]
    return names[: len(cells)] if len(cells) < 2 else names, False


def read_delimited(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """No quoting: a quote is a character."""
    first = spark.read.text(path).first()
    names, header = header_of(first.value if first else "", sep)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.options(sep=sep, quote="", escape="", header=header, mode="PERMISSIVE", enforceSchema=True).schema(schema).csv(path)


def json_keys(line: str) -> list[str]:
    found = json.loads(line)
    if not isinstance(found, dict):
        raise ValueError("the first line is no JSON object")
    return list(found)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """The keys of the first non-empty line are the columns, as strings; it must be valid. Other blank or broken lines are
    rows whose ``_ok`` is false, so that raw rows can be counted."""
    lines = spark.read.text(path)
    first = lines.where(F.trim("value") != "").first()
    keys = json_keys(first.value) if first else []
    row = F.from_json("value", T.StructType([T.StructField(k, T.StringType()) for k in keys] + [T.StructField("_broken", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    rows = lines.select("value", row.alias("j"))
    ok = (F.trim("value") != "") & F.col("j").isNotNull() & F.col("j._broken").isNull()
    return rows.select(*(F.col(f"j.`{k}`").alias(k) for k in keys), F.coalesce(ok, F.lit(False)).alias("_ok"))


def _arrow_files(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            data = content.as_buffer()
            try:
                reader = pa.ipc.open_file(data)
                found = (reader.get_batch(i) for i in range(reader.num_record_batches))
            except pa.ArrowInvalid:
                found = pa.ipc.open_stream(data)
            for b in found:
                yield pa.RecordBatch.from_arrays([b.column(n).cast(schema.field(n).type) for n in schema.names], schema=schema)


def _arrow_schema(spark: SparkSession, path: str) -> pa.Schema:
    """From a file's head: its first message, after the mark of the file format if there is one."""
    fs, where = _fs(spark, path)
    stream = fs.open(where)
    take = lambda n: bytes(b & 0xFF for b in stream.readNBytes(n))
    try:
        head = take(8)
        if head.startswith(b"ARROW1"):
            head = take(8)
        # a mark of four bytes and the message's length
        return pa.ipc.read_schema(pa.py_buffer(head + take(int.from_bytes(head[4:], "little"))))
    finally:
        stream.close()


def read_arrow(spark: SparkSession, path: str, columns: Sequence[str] | None = None, split: int = arrow_files.SPLIT) -> DataFrame:
    """All ``*.arrow`` files of a folder but those whose names begin with cache; files or streams of Arrow IPC. They are read
    in splits of about ``split`` bytes, and of columns only those wanted. Where only Spark's own readers reach the store, a
    task reads a whole file, of 2 GB at most."""
    from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.arrow").option("recursiveFileLookup", "true").load(path).where(~F.element_at(F.split("path", "/"), -1).startswith("cache"))
    paths = [r.path for r in files.select("path").orderBy("path").collect()]  # names, as any listing has them
    if not paths:
        raise ValueError(f"no Arrow files in {path}")
    schema = from_arrow_schema(arrow_files.plain(_arrow_schema(spark, paths[0])))
    if columns is not None:
        schema = T.StructType([schema[c] for c in columns])
    if arrow_files.readable(paths[0]):
        spark.dataSource.register(arrow_files.ArrowFiles)
        return spark.read.format("arrow_files").schema(schema).options(paths="\n".join(paths), split=split).load()
    target = to_arrow_schema(schema)
    return files.select("content").mapInArrow(lambda batches: _arrow_files(batches, target), schema)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    kind = detect_format(spark, path)
    if kind in ("tsv", "csv"):
        return read_delimited(spark, path, "\t" if kind == "tsv" else ",")
    return {"jsonl": read_jsonl, "parquet": lambda s, p: s.read.parquet(p), "arrow": read_arrow}[kind](spark, path)


def _corpus_columns(names: Sequence[str], doc_id: str | None, text: str | None, title: str | None) -> tuple[str, str, str | None]:
    names = [c for c in names if not c.startswith("_") or c == "_id"]
    i, t = find_column(names, ID_NAMES, doc_id), find_column(names, TEXT_NAMES, text)
    if i is None or t is None:
        raise ValueError(f"no id or text column among {names}")
    return i, t, None if title == "" else find_column(names, TITLE_NAMES, title)


def normalise_rows(df: DataFrame, doc_id: str | None = None, text: str | None = None, title: str | None = None) -> DataFrame:
    """(doc_id, title, text) as strings; rows whose text is null, NaN or blank go. ``title=""`` leaves titles out."""
    i, t, h = _corpus_columns(df.columns, doc_id, text, title)
    col = lambda c: F.col(f"`{c}`").cast("string")
    rows = df.where("_ok") if "_ok" in df.columns else df
    body = F.trim(col(t))
    return rows.select(col(i).alias("doc_id"), (F.coalesce(col(h), F.lit("")) if h else F.lit("")).alias("title"), body.alias("text")).where((F.col("text") != "") & (F.lower("text") != "nan"))


def read_corpus(spark: SparkSession, path: str, split: int = arrow_files.SPLIT, **columns: str | None) -> DataFrame:
    """Any format, as ``normalise_rows`` gives it. split: of Arrow files, whose other columns are not decoded."""
    if detect_format(spark, path) != "arrow":
        return normalise_rows(read_raw(spark, path), **columns)
    wanted = _corpus_columns(read_arrow(spark, path).columns, *(columns.get(c) for c in ("doc_id", "text", "title")))
    return normalise_rows(read_arrow(spark, path, [c for c in wanted if c], split), **columns)


def row_count(df: DataFrame) -> int:
    """For Parquet, from the files' footers."""
    return df.count()


def read_batch(spark: SparkSession, path: str, results: str) -> DataFrame:
    """One row a result of a nested batch file {header..., results: [...]}; ``results``: their schema.

    The file is read in splits, whatever its size, as pieces that end in ``}``. Running sums over the pieces say whether a
    piece begins inside a text, and how deep in objects; the pieces from a result's opening to its closing are joined, so
    only single results are ever held whole.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_in"))
    # an escape never ends a piece: it would escape a brace
    pieces = numbered(pieces, ["_at", "_in"], "_n").withColumn("_parts", F.split(F.regexp_replace("value", r"\\.", ""), '"', -1))
    pieces = running(pieces, "_n", {"_quotes": (F.size("_parts") - 1).cast("long")})
    # parts stand between quotes: in turn outside of texts and inside
    inside = lambda i: (i + F.col("_quotes")) % 2 == 1
    part = lambda i: F.get("_parts", i)
    places = F.sequence(F.lit(0), F.size("_parts") - 1)
    outside = F.filter("_parts", lambda x, i: ~inside(i))
    closes = (~inside(F.size("_parts") - 1)).cast("long")
    opens = F.size(F.split(F.array_join(outside, ""), r"\{", -1)).cast("long") - 1
    pieces = running(pieces, "_n", {"_depth": opens - closes})
    # keys of the outermost object stand in a piece before the first brace that opens another one
    brace = F.array_min(F.filter(places, lambda i: ~inside(i) & part(i).contains("{") & ((F.col("_depth") == 1) | (i > 0))))
    key = F.exists(places, lambda i: inside(i) & (part(i) == "results") & (i < F.coalesce(brace, F.size("_parts"))) & part(i + 1).rlike(r"^\s*:\s*\[\s*\{"))
    more = (F.col("_depth") == 1) & part(F.lit(0)).rlike(r"^\s*,\s*\{")
    starts = (F.col("_depth") == 1).cast("long")
    pieces = running(pieces.withColumns({"_key": (F.col("_depth") <= 1) & key, "_more": more}), "_n", {"_begun": starts})
    pieces = stored(pieces.select("_n", "value", "_depth", "_key", "_more", (F.col("_begun") + starts).alias("_item")), "batch-pieces")
    first = pieces.where("_key").orderBy("_n").first()
    if first is None:
        return spark.createDataFrame([], f"position int, {results}")
    end = pieces.where((F.col("_n") > first["_n"]) & (F.col("_depth") <= 1) & ~F.col("_more")).agg(F.min("_n")).first()[0]
    own = pieces.where(F.col("_n") >= first["_n"]) if end is None else pieces.where(F.col("_n").between(first["_n"], end - 1))
    head = F.when(F.col("_n") == first["_n"], F.regexp_replace("value", r'(?s)^.*?(?<!\\)"results"\s*:\s*\[', "")).otherwise(F.regexp_replace("value", r"^\s*,", ""))
    text = F.when(F.col("_depth") <= 1, head).otherwise(F.col("value"))
    items = own.groupBy("_item").agg(F.sort_array(F.collect_list(F.struct("_n", text.alias("x")))).alias("_x"))
    record = F.from_json(F.concat(F.array_join(F.transform("_x", lambda x: x.x), "}"), F.lit("}")), f"struct<{results}>")
    return items.select((F.col("_item") - first["_item"]).cast("int").alias("position"), record.alias("r")).select("position", "r.*")


def batch_header(spark: SparkSession, path: str, size: int = 1 << 16) -> dict:
    """Scalar values that stand before ``results``; the file is read ``size`` bytes at a time until that name."""
    fs, where = _fs(spark, path)
    stream = fs.open(where)
    try:
        head = b""
        while b'"results"' not in head and (more := bytes(b & 0xFF for b in stream.readNBytes(size))):
            head += more
    finally:
        stream.close()
    before = head.decode("utf-8", "ignore").split('"results"', 1)[0].rstrip().rstrip(",")
    return {k: v for k, v in json.loads(before + ("" if before.endswith("}") else "}")).items() if not isinstance(v, (list, dict))}


def read_beir(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """corpus (doc_id, text), queries (query_id, text) and qrels (query_id, doc_id, rel) of a BEIR folder. The text of a
    document is its title, a line end and its text."""
    either = F.coalesce(F.col("_id"), F.col("id"))
    corpus = spark.read.schema("_id string, id string, title string, text string").json(f"{folder}/corpus.jsonl")
    queries = spark.read.schema("_id string, id string, text string").json(f"{folder}/queries.jsonl")
    body = F.trim(F.concat_ws("\n", F.nullif("title", F.lit("")), F.coalesce("text", F.lit(""))))
    return corpus.select(either.alias("doc_id"), body.alias("text")), queries.select(either.alias("query_id"), "text"), read_qrels(spark.read.text(f"{folder}/qrels/test.tsv"))


def read_qrels(lines: DataFrame) -> DataFrame:
    """Lines of 3 columns, or 4 with an unused second; a line whose last column is no number is a header."""
    cells = F.split(F.trim("value"), r"\s+")
    rel = F.element_at(cells, -1).try_cast("double").cast("int")
    rows = lines.where(F.trim("value") != "").select(cells.alias("c"), rel.alias("rel")).where("rel is not null and size(c) >= 3")
    return rows.select(F.col("c")[0].alias("query_id"), F.element_at("c", -2).alias("doc_id"), "rel")


def records_by_columns(lines: DataFrame, sep: str = "\t") -> DataFrame:
    """Delimited lines without a header by their number of columns: 2 are query and document, 3 query, document and
    relevance, more have an unused second column."""
    c = F.split("value", sep)
    n = F.size(c)
    rows = lines.where((F.trim("value") != "") & (n >= 2)).select(c.alias("c"), n.alias("n"))
    doc = F.when(F.col("n") <= 3, F.col("c")[1]).otherwise(F.col("c")[2])
    rel = F.when(F.col("n") == 3, F.col("c")[2]).when(F.col("n") > 3, F.col("c")[3])
    return rows.select(F.col("c")[0].alias("query"), doc.alias("doc"), rel.alias("rel"))


def json_records(raw: Column) -> Column:
    """Records of a JSON text: a list, the first known key that holds one, or the object itself, as JSON strings."""
    as_list = F.from_json(raw, "array<string>")
    inner = [F.from_json(F.get_json_object(raw, f"$.{k}"), "array<string>") for k in RECORD_KEYS]
    return F.when(F.trim(raw).startswith("["), as_list).otherwise(F.coalesce(*inner, F.array(raw)))


def read_json_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all JSON files under a folder: path, position, record (JSON)."""
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(folder).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.select("path", F.posexplode(json_records(F.col("value"))).alias("position", "record"))


def read_text_tree(spark: SparkSession, folder: str) -> DataFrame:
    """One document a ``*.txt`` file: its path below the folder, and its trimmed text. ``blank`` marks files without text,
    which a caller refuses; Spark leaves out files of no bytes, which ``empty_files`` lists."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(folder).select("path", F.decode("content", "UTF-8").alias("value"))
    root = _fs(spark, folder)[0].makeQualified(_fs(spark, folder)[1]).toUri().getPath().rstrip("/") + "/"
    path = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    return files.select(F.replace(path, F.lit(root), F.lit("")).alias("doc_id"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("text")).withColumn("blank", F.col("text") == "")


def empty_files(spark: SparkSession, folder: str, ending: str = ".txt") -> list[str]:
    """Names of files of no bytes below a folder, from its listing."""
    fs, where = _fs(spark, folder)
    found, files = [], fs.listFiles(where, True)
    while files.hasNext():
        f = files.next()
        if f.getLen() == 0 and f.getPath().getName().endswith(ending):
            found.append(f.getPath().getName())
    return sorted(found)


def read_numbered_json(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """One record a file; ``number`` is the file's name as a number, by which callers sort."""
    files = spark.read.option("multiLine", "true").option("pathGlobFilter", "*.json").schema(schema).json(folder)
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1)
    return files.select(stem.try_cast("long").alias("number"), "*")


def summary_scores(lines: DataFrame) -> DataFrame:
    """Task names and scores of summary lines such as ``NanoXRetrieval 0.53``."""
    pattern = r"(Nano\w+Retrieval)\W+([0-9]+(?:\.[0-9]+)?)"
    return lines.select(F.regexp_extract("value", pattern, 1).alias("task"), F.regexp_extract("value", pattern, 2).try_cast("double").alias("score")).where("task <> ''")


def log_progress(lines: DataFrame, position: str, begin: str, end: str, hit: str = '" 200', calls: int = 1) -> DataFrame:
    """Successful calls between the lines that match ``begin`` and ``end``: calls, queries done, calls of the next one."""
    first = lambda mark: F.min(F.when(F.col("value").contains(mark), F.col(position)))
    x = lines.crossJoin(F.broadcast(lines.agg(first(begin).alias("_begin"), first(end).alias("_end"))))
    inside = (F.col(position) > F.col("_begin")) & (F.col("_end").isNull() | (F.col(position) < F.col("_end")))
    n = F.count_if(inside & F.col("value").contains(hit))
    return x.agg(n.alias("calls"), F.floor(n / calls).alias("queries"), (n % calls).alias("in_flight"), F.coalesce(F.bool_or(F.col("_end").isNotNull()), F.lit(False)).alias("finished"))

