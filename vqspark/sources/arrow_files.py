"""A data source for Arrow IPC files and streams: spark.read.format("arrow_ipc").load(path).

Files are listed by pyarrow's file systems (local, hdfs://, s3:// and others by address). A file with a footer is cut into
runs of record batches, which are read apart; a stream is one piece. With a schema of some columns only these are read from
files; columns that a file lacks are null. The option `batches` is the number of record batches that one task reads.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

NAME = "arrow_ipc"
#: Record batches of a file that one task reads, unless the option `batches` says otherwise.
BATCHES = 64


def _open(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of an address and the path in it."""
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (pa.fs.LocalFileSystem(), path)


def files(path: str) -> list[str]:
    """Arrow files at or under a path, by name; hidden ones and those of other kinds aren't looked at."""
    fs, root = _open(path.rstrip("/").replace("file:///", "/"))
    info = fs.get_file_info(root)
    if info.type == pa.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [path]
    found = [f.path for f in fs.get_file_info(pa.fs.FileSelector(root, recursive=True)) if f.is_file and f.base_name[0] not in "._" and f.extension in ("arrow", "feather", "ipc", "arrows")]
    scheme = path.split("://")[0] + "://" if "://" in path and not path.startswith("file:") else ""
    return sorted(scheme + f for f in found)


def _reader(path: str, columns: list[str] | None = None) -> pa.ipc.RecordBatchFileReader | pa.ipc.RecordBatchStreamReader:
    fs, name = _open(path.replace("file:///", "/"))
    try:
        whole = pa.ipc.open_file(fs.open_input_file(name))
    except pa.ArrowInvalid:
        return pa.ipc.open_stream(fs.open_input_stream(name))
    if columns is None:
        return whole
    kept = [i for i, field in enumerate(whole.schema) if field.name in columns]
    return pa.ipc.open_file(fs.open_input_file(name), options=pa.ipc.IpcReadOptions(included_fields=kept)) if kept else whole


@dataclass
class Piece(InputPartition):
    """Record batches of a file from one number up to another; None for all of a stream."""

    path: str
    start: int
    end: int | None


class ArrowFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        """Columns of all files in the order in which they come."""
        merged = pa.unify_schemas([_reader(f).schema for f in files(self.options["path"])])
        return from_arrow_schema(merged)

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArrowReader(schema, self.options["path"], int(self.options.get("batches", BATCHES)))


class ArrowReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, batches: int) -> None:
        self.columns, self.path, self.arrow, self.batches = schema.names, path, to_arrow_schema(schema), batches

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in files(self.path):
            reader = _reader(path)
            n = getattr(reader, "num_record_batches", None)
            out += [Piece(path, 0, None)] if n is None else [Piece(path, a, min(n, a + self.batches)) for a in range(0, n, self.batches)]
        return out or [Piece("", 0, 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        reader = _reader(partition.path, self.columns)
        batches = reader if partition.end is None else (reader.get_batch(i) for i in range(partition.start, partition.end))
        for batch in batches:
            there = set(batch.schema.names)
            made = [batch.column(f.name).cast(f.type) if f.name in there else pa.nulls(batch.num_rows, f.type) for f in self.arrow]
            yield pa.record_batch(made, schema=self.arrow)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArrowFiles)
