"""Readers and writers: test tables are written in each format to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import ensure_checkpoints
from ..sources import readers, sinks
from .registry import each_row, query, table


def _path(spark, name: str) -> str:
    return f"{ensure_checkpoints(spark)}/files-{uuid.uuid4().hex}/{name}"


def _bench(spark, d, lines: bool = True):
    """Texts keep their line ends where the format can hold them."""
    return table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("_id"), "text" if lines else F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))


_BENCH = "SELECT CAST(item_id AS VARCHAR) AS doc_id, '' AS title, trim(text) AS text FROM benchmark"


@query("s01_detect_format", "SELECT doc_id, ['tsv', 'csv', 'jsonl', 'jsonl', 'parquet', NULL][doc_id % 6 + 1] AS format FROM documents")
def s01(spark, d):
    """Names of files in any case."""
    ending = F.get(F.array(*(F.lit(x) for x in (".tsv", ".CSV", ".jsonl", ".ndjson", ".Parquet", ".txt"))), (F.col("doc_id") % 6).cast("int"))
    return table(spark, d, "documents").select("doc_id", readers.format_of(F.concat(F.lit("/data/set."), "source", F.col("doc_id").cast("string"), ending)).alias("format"))


@query("s02_delimited_scan", "SELECT CAST(item_id AS VARCHAR) AS doc_id, CAST(item_id AS VARCHAR) || ' \"t' AS title, trim(replace(text, chr(10), ' ')) AS text FROM benchmark")
def s02(spark, d):
    path = _path(spark, "corpus.tsv")
    rows = _bench(spark, d, False).select(F.concat_ws("\t", "_id", F.concat("_id", F.lit(' "t')), "text").alias("value"))
    header = spark.createDataFrame([("_id\ttitle\ttext",)], "value string")
    header.union(rows).coalesce(1).write.text(path)
    return readers.read_corpus(spark, path)


@query("s02_headerless_scan", _BENCH.replace("trim(text)", "trim(replace(text, chr(10), ' '))"))
def s02_headerless(spark, d):
    path = _path(spark, "corpus.tsv")
    _bench(spark, d, False).select(F.concat_ws("\t", "_id", "text").alias("value")).write.text(path)
    return readers.read_corpus(spark, path)


@query("s03_jsonl_scan", _BENCH)
def s03(spark, d):
    path = _path(spark, "corpus.jsonl")
    broken = spark.createDataFrame([("",), ('{"_id": "x", "text": ',), ('{"_id": "y", "text": " "}',)], "value string")
    _bench(spark, d).select(F.to_json(F.struct("_id", "text")).alias("value")).union(broken).coalesce(1).write.text(path)
    return readers.read_corpus(spark, path)


@query("s03_raw_count", "SELECT count(*) + 2 AS raw, count(*) AS good FROM benchmark")
def s03_raw(spark, d):
    path = _path(spark, "corpus.jsonl")
    broken = spark.createDataFrame([("",), ("{oops",)], "value string")
    _bench(spark, d).select(F.to_json(F.struct("_id", "text")).alias("value")).union(broken).coalesce(1).write.text(path)
    return readers.read_jsonl(spark, path).agg(F.count("*").alias("raw"), F.count_if("_ok").alias("good"))


@query("s04_parquet_scan", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, '' AS title, trim(text) AS text FROM documents WHERE trim(text) <> ''")
def s04(spark, d):
    return readers.read_corpus(spark, f"{d}/documents.parquet")


@query("s05_arrow_scan", _BENCH)
def s05(spark, d):
    """A file and a stream, of many record batches each, read in splits of a few batches; one column is not asked for."""
    import pyarrow as pa

    path = _path(spark, "arrow")
    rows = _bench(spark, d).withColumn("unused", F.reverse("text")).toArrow()
    half = rows.num_rows // 2
    fs, _ = readers._fs(spark, path)
    for name, part, form in (("a/data-0.arrow", rows[:half], pa.ipc.new_file), ("b/data-1.arrow", rows[half:], pa.ipc.new_stream)):
        sink = pa.BufferOutputStream()
        with form(sink, rows.schema) as out:
            out.write_table(part, max_chunksize=16)
        stream = fs.create(readers._fs(spark, f"{path}/{name}")[1], True)
        stream.write(bytearray(sink.getvalue().to_pybytes()))
        stream.close()
    return readers.read_corpus(spark, path, split=20_000)


@query("s06_row_count", "SELECT count(*) AS n FROM documents")
def s06(spark, d):
    return spark.createDataFrame([(readers.row_count(table(spark, d, "documents")),)], "n long")


@query("s07_normalise_rows", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang AS title, trim(text) AS text FROM documents WHERE trim(text) <> '' AND doc_id % 5 > 2")
def s07(spark, d):
    text = F.when(F.col("doc_id") % 5 == 0, F.lit(None)).when(F.col("doc_id") % 5 == 1, "  ").when(F.col("doc_id") % 5 == 2, "NaN").otherwise(F.col("text"))
    return readers.normalise_rows(table(spark, d, "documents").select("doc_id", F.col("lang").alias("Title"), text.alias("Body")))


@query("s09_nested_json_scan", "SELECT CAST(row_number() OVER (ORDER BY item_id) - 1 AS INTEGER) AS position, CAST(item_id AS VARCHAR) AS doc_id, text AS doc FROM benchmark")
def s09(spark, d):
    path = _path(spark, "batch.json")
    items = table(spark, d, "benchmark").agg(F.sort_array(F.collect_list(F.struct("item_id", "text"))).alias("r"))
    batch = items.select(F.to_json(F.struct(F.lit("in").alias("input_path"), F.lit(1).alias("num_queries"), F.transform("r", lambda x: F.struct(x.item_id.cast("string").alias("doc_id"), x.text.alias("doc"))).alias("results"))).alias("value"))
    batch.coalesce(1).write.text(path)
    return readers.read_batch(spark, path, "doc_id: string, doc: string")


@query("s10_header_read", "SELECT 'input_path' AS key, string_agg(text, '|' ORDER BY item_id) AS value FROM benchmark UNION ALL SELECT 'num_queries', CAST(count(*) AS VARCHAR) FROM benchmark")
def s10(spark, d):
    """The header of a batch: its values are longer than one read, and results of all items follow."""
    path = _path(spark, "batch.json")
    items = table(spark, d, "benchmark").agg(F.sort_array(F.collect_list(F.struct("item_id", "text"))).alias("r"))
    head = [F.array_join(F.transform("r", lambda x: x.text), "|").alias("input_path"), F.size("r").alias("num_queries")]
    items.select(F.to_json(F.struct(*head, F.transform("r", lambda x: F.struct(x.item_id.alias("doc_id"), x.text.alias("doc"))).alias("results"))).alias("value")).coalesce(1).write.text(path)
    (part,) = [r.path for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path").collect()]
    return spark.createDataFrame([(k, str(v)) for k, v in readers.batch_header(spark, part, 1 << 10).items()], "key string, value string")


@query("s11_beir_read", "SELECT CAST(l.doc_id AS VARCHAR) AS query_id, CAST(l.doc_id AS VARCHAR) AS doc_id, quality AS rel FROM labels l")
def s11(spark, d):
    lines = table(spark, d, "labels").select(F.format_string("%d 0 %d %d.0", "doc_id", "doc_id", "quality").alias("value"))
    head = spark.createDataFrame([("query-id corpus-id score",)], "value string")
    return readers.read_qrels(head.union(lines))


@query("s12_records_by_columns", "SELECT lang AS query, source AS doc, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) END AS rel FROM documents")
def s12(spark, d):
    id_ = F.col("doc_id").cast("string")
    lines = table(spark, d, "documents").select(F.when(F.col("doc_id") % 2 == 0, F.concat_ws("\t", "lang", F.lit("0"), "source", id_)).otherwise(F.concat_ws("\t", "lang", "source")).alias("value"))
    return readers.records_by_columns(lines)


@query("s13_json_tree", "SELECT item_id, CAST(k AS INTEGER) AS position, '{\"n\":' || k || '}' AS record FROM benchmark, (VALUES (0), (1)) v(k) WHERE item_id % 3 < 2 OR k = 0")
def s13(spark, d):
    pair = '[{"n":0},{"n":1}]'
    raw = F.when(F.col("item_id") % 3 == 0, pair).when(F.col("item_id") % 3 == 1, '{"data":' + pair + "}").otherwise('{"n":0}')
    return table(spark, d, "benchmark").select("item_id", F.posexplode(readers.json_records(raw)).alias("position", "record"))


def _put(df, path):
    """A file for each row (name, content), written where the rows are."""

    def run(r):
        with sinks._opened(f"{path}/{r['name']}", True) as out:
            out.write(r["content"].encode())
        return [(1,)]

    each_row(df, "n int", run).agg(F.sum("n")).collect()


@query("s14_text_tree", "SELECT 'sub' || item_id % 3 || '/doc ' || item_id || '.txt' AS doc_id, trim(text) AS text, trim(text) = '' AS blank FROM benchmark")
def s14(spark, d):
    path = _path(spark, "tree")
    name = F.format_string("sub%d/doc %d.txt", F.col("item_id") % 3, F.col("item_id"))
    _put(table(spark, d, "benchmark").select(name.alias("name"), F.concat(F.lit(" "), "text", F.lit("\n\t")).alias("content")), path)
    return readers.read_text_tree(spark, path)


@query("s15_numbered_json", "SELECT item_id AS number, item_id * 2 AS pid, text AS fact FROM benchmark")
def s15(spark, d):
    """One record a file, over several lines; names sort as numbers."""
    path = _path(spark, "cases")
    content = F.concat(F.lit("{\n"), F.regexp_replace(F.to_json(F.struct((F.col("item_id") * 2).alias("pid"), F.col("text").alias("fact"))), r"^\{", ""), F.lit("\n"))
    _put(table(spark, d, "benchmark").select(F.concat(F.col("item_id").cast("string"), F.lit(".json")).alias("name"), content.alias("content")), path)
    return readers.read_numbered_json(spark, path, "pid long, fact string").orderBy("number")


@query("s17_summary_scan", "SELECT 'NanoX' || item_id || 'Retrieval' AS task, item_id / 8.0 AS score FROM benchmark")
def s17(spark, d):
    lines = table(spark, d, "benchmark").select(F.concat(F.lit("| NanoX"), F.col("item_id").cast("string"), F.lit("Retrieval | "), (F.col("item_id") / 8).cast("string"), F.lit(" |")).alias("value"))
    return readers.summary_scores(lines.union(spark.createDataFrame([("no score here",)], "value string")))


@query("s18_log_scan", "WITH n AS (SELECT count(*) AS n FROM events WHERE event_id > 100 AND event_id < 900 AND event_type = 'click') SELECT n AS calls, n // 3 AS queries, n % 3 AS in_flight, true AS finished FROM n")
def s18(spark, d):
    line = F.when(F.col("event_id") == 100, "=== Step 5 ===").when(F.col("event_id") == 900, "Step 5 done").when(F.col("event_type") == "click", 'POST "HTTP/1.1" 200 OK').otherwise("waiting")
    return readers.log_progress(table(spark, d, "events").select("event_id", line.alias("value")), "event_id", "=== Step 5", "Step 5 done", calls=3)


@query("k01_jsonl_sink", _BENCH)
def k01(spark, d):
    path = _path(spark, "out.jsonl")
    sinks.write_jsonl(_bench(spark, d), path)
    return readers.read_corpus(spark, path)


@query("k02_batch_sink", "SELECT CAST(item_id AS VARCHAR) AS _id, text FROM benchmark")
def k02(spark, d):
    path = _path(spark, "batch")
    sinks.write_batch(_bench(spark, d), path, {"num_queries": 1})
    return spark.read.parquet(f"{path}/results")


@query("k04_append_sink", "SELECT doc_id FROM documents")
def k04(spark, d):
    path = _path(spark, "appended")
    docs = table(spark, d, "documents").select("doc_id")
    sinks.append_new(docs.where("doc_id % 2 = 0"), path, "doc_id")
    sinks.append_new(docs, path, "doc_id")
    return spark.read.parquet(path)


@query("k05_beir_sink", "SELECT CAST(doc_id AS VARCHAR) AS query_id, CAST(doc_id AS VARCHAR) AS doc_id, quality AS rel FROM labels")
def k05(spark, d):
    path = _path(spark, "beir")
    labels = table(spark, d, "labels")
    docs = table(spark, d, "documents")
    sinks.write_beir(docs, docs.select(F.col("doc_id").alias("query_id"), "text"), labels.select(F.col("doc_id").alias("query_id"), "doc_id", F.col("quality").alias("rel")), path)
    return readers.read_qrels(spark.read.text(f"{path}/qrels"))


@query("k07_report_sink", "SELECT source, CAST(count(*) AS VARCHAR) AS n FROM documents GROUP BY 1")
def k07(spark, d):
    path = _path(spark, "report")
    sinks.write_report(table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")), path)
    return spark.read.option("header", "true").csv(path)


def _lines(spark, d):
    """A file of lines for each source, in the order of ids."""
    path = _path(spark, "release")
    rows = table(spark, d, "documents").select("doc_id", "source", F.concat_ws(" ", "doc_id", F.replace("text", F.lit("\n"), F.lit(" "))).alias("value"))
    rows.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "value").write.partitionBy("source").option("compression", "none").text(path)
    return path


_FILES = "SELECT 'source=' || source AS folder, count(*) AS rows, CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes, sha256(string_agg(line || chr(10), '' ORDER BY doc_id)) AS sha256 FROM (SELECT *, concat_ws(' ', doc_id, replace(text, chr(10), ' ')) AS line FROM documents) GROUP BY source"


@query("k10_manifest", _FILES)
def k10(spark, d):
    files = sinks.manifest(spark, _lines(spark, d)).where("path like 'source=%'")
    return files.select(F.substring_index("path", "/", 1).alias("folder"), "rows", "bytes", "sha256")


@query("k10_release", f"SELECT 'lines/' || folder AS folder, rows, bytes, sha256 FROM ({_FILES}) UNION ALL SELECT 'table', (SELECT count(*) FROM region), NULL, NULL")
def k10_release(spark, d):
    target = _path(spark, "published")
    sinks.package(spark, {"lines": _lines(spark, d), "table.parquet": f"{d}/region.parquet"}, target, {"release": "1"})
    files = spark.read.option("multiLine", "true").json(f"{target}/manifest.json").select(F.explode("files").alias("f")).select("f.*")
    folder = F.when(F.col("path") == "table.parquet", "table").otherwise(F.substring_index("path", "/", 2))
    only = lambda c: F.when(F.col("path") != "table.parquet", F.col(c)).alias(c)
    return files.where("path like '%source=%' or path = 'table.parquet'").select(folder.alias("folder"), "rows", only("bytes"), only("sha256"))


@query("k03_atomic_replace", "SELECT source, count(*) AS n FROM documents GROUP BY 1")
def k03(spark, d):
    """A state of counts, replaced whole: first by one without ids from 100 on, then by that of the table."""
    path = _path(spark, "state.json")
    for rows in (table(spark, d, "documents").where("doc_id < 100"), table(spark, d, "documents")):
        state = rows.groupBy("source").agg(F.count("*").alias("n")).select(F.to_json(F.struct("source", "n")).alias("line"))
        sinks.replace_file(spark, path, "\n".join(r.line for r in state.collect()))  # a row a source
    return spark.read.schema("source string, n long").json(path)
