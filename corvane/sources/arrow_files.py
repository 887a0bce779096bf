"""Arrow files and streams in splits: a data source that plans a partition for each group of record batches.

Planning walks over a file's messages and reads their heads alone; a task then reads the bytes of its own batches, one batch
at a time, so no task holds a file, however large. Files (with a footer) and streams (as data sets are cached) hold the same
messages and are read alike. Only wanted columns are decoded. Stores are opened with ``pyarrow.fs``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of record batches in a partition; a larger batch is one of its own.
SPLIT = 128 << 20
SCHEMA, DICTIONARY, BATCH = 1, 2, 3
MAGIC, GOES_ON = b"ARROW1", 0xFFFFFFFF


class Message(NamedTuple):
    kind: int
    start: int
    length: int


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path, which may begin with its scheme, and the name in it. Raises where ``pyarrow`` knows no such store."""
    scheme, _, name = path.partition(":")
    if "/" in scheme or not name:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + name.lstrip("/")
    return fs.FileSystem.from_uri(f"{scheme}:{quote(name, safe='/:@?&=%')}")


def opened(path: str) -> pa.NativeFile:
    """A file that can be read at any place."""
    store, name = located(path)
    return store.open_input_file(name)


def readable(path: str) -> bool:
    try:
        opened(path).close()
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def messages(file: pa.NativeFile) -> Iterator[Message]:
    """The file's messages in order. Of each only the head is read: a mark, the length of its description, and from that,
    a table of offsets, what kind it is and how long a body follows."""
    number = lambda data, at, size=4, signed=False: int.from_bytes(data[at : at + size], "little", signed=signed)
    at, end = (8 if file.read_at(6, 0) == MAGIC else 0), file.size()
    while at + 8 <= end:
        mark = file.read_at(8, at)
        skip = 8 if number(mark, 0) == GOES_ON else 4
        length = number(mark, skip - 4)
        if not length:
            return
        head = file.read_at(length, at + skip)
        table = number(head, 0)
        offsets = table - number(head, table, signed=True)
        field = lambda i: number(head, offsets + 4 + 2 * i, 2) if 4 + 2 * i < number(head, offsets, 2) else 0  # noqa: B023, E731
        kind, body = field(1), field(3)
        whole = skip + length + (number(head, table + body, 8) if body else 0)
        yield Message(head[table + kind] if kind else 0, at, whole)
        at += whole


class Split(InputPartition):
    """Batches of one file, with what is needed to decode them."""

    def __init__(self, path: str, needed: list[Message], batches: list[Message]):
        self.path, self.needed, self.batches = path, needed, batches


def splits(path: str, size: int) -> list[Split]:
    with opened(path) as file:
        found = list(messages(file))
    needed = [m for m in found if m.kind in (SCHEMA, DICTIONARY)]
    groups: list[list[Message]] = []
    held = 0
    for m in found:
        if m.kind == BATCH:
            if not groups or held + m.length > size:
                groups.append([])
                held = 0
            groups[-1].append(m)
            held += m.length
    return [Split(path, needed, g) for g in groups]


def file_schema(path: str) -> pa.Schema:
    with opened(path) as file:
        m = next(messages(file))
        return pa.ipc.read_schema(pa.py_buffer(file.read_at(m.length, m.start)))


def read_split(split: Split, columns: Sequence[str] | None = None) -> Iterator[pa.RecordBatch]:
    """The batches of a split, one at a time."""
    with opened(split.path) as file:
        before = b"".join(file.read_at(m.length, m.start) for m in split.needed)
        schema = pa.ipc.read_schema(pa.py_buffer(file.read_at(split.needed[0].length, split.needed[0].start)))
        options = pa.ipc.IpcReadOptions(included_fields=[schema.get_field_index(c) for c in columns] if columns else None)
        for m in split.batches:
            with pa.ipc.open_stream(pa.py_buffer(before + file.read_at(m.length, m.start)), options=options) as stream:
                yield from stream


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.paths, self.split = schema, options["paths"].split("\n"), int(options.get("split", SPLIT))

    def partitions(self) -> Sequence[InputPartition]:
        with ThreadPoolExecutor(16) as pool:
            return [s for found in pool.map(lambda p: splits(p, self.split), self.paths) for s in found]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(self.schema)
        for batch in read_split(partition, self.schema.names):
            yield pa.RecordBatch.from_arrays([batch.column(n).cast(target.field(n).type) for n in target.names], schema=target)


class ArrowFiles(DataSource):
    """``spark.read.format("arrow_files")`` with a schema of the wanted columns; options: paths (one a line), split (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "arrow_files"

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(plain(file_schema(self.options["paths"].split("\n")[0])))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)


def plain(schema: pa.Schema) -> pa.Schema:
    """Columns that are stored by dictionary have the type of their values."""
    return pa.schema([f.with_type(f.type.value_type) if pa.types.is_dictionary(f.type) else f for f in schema])
