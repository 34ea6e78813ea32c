"""Tables whose packing and separator are not known: a Spark data source named `unknown_table`.

    spark.dataSource.register(UnknownTable)
    spark.read.format("unknown_table").load("s3://bucket/folder")

The first bytes of each file tell gzip, zip and plain apart, its name plays no part. The separator is
the most frequent of four in the header line. All columns are texts under the names of the header;
empty fields are null. Of a zip archive the first member named .csv or .txt is the table; with
`members=all` each such member is one. Every file or member is one partition, read as a stream, so a
task holds a batch of rows and never a whole file. A plain file can be dealt out in ranges of
`split_bytes`; a range owns the lines that start in it, so quoted fields must then not hold line ends.

`suffixes` leaves out files of other names, for folders that hold more than tables.

Columns are those of the first table in path order; tables that follow are matched by name, and a
column they lack is null. A line with more fields than its header fails the read and is named; a line
with fewer has nulls at its end. Blank lines are skipped; of columns with one name the first counts.
"""
from __future__ import annotations

import csv
import gzip
import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from .stores import listed, store

SEPARATORS = ",;\t|"
GZIP, ZIP = b"\x1f\x8b", b"PK"
BATCH = 4096
csv.field_size_limit(1 << 30)


@dataclass
class Piece(InputPartition):
    """One table or a range of one: bytes from `start` to `stop`, to the end if `stop` is None."""

    path: str
    packing: str  # plain, gzip or zip
    member: str = ""
    start: int = 0
    stop: int | None = None


def packing(path: str) -> str:
    system, inside = store(path)
    with system.open_input_stream(inside, compression=None) as f:
        head = f.read(2)
    return "gzip" if head == GZIP else "zip" if head == ZIP else "plain"


def members(path: str) -> list[str]:
    system, inside = store(path)
    with system.open_input_file(inside) as f, zipfile.ZipFile(f) as archive:
        return [n for n in archive.namelist() if n.lower().endswith((".csv", ".txt"))]


def _opened(piece: Piece) -> tuple[io.BufferedIOBase, list]:
    """A stream of the table's bytes, and what has to be closed after it."""
    system, inside = store(piece.path)
    f = system.open_input_file(inside)
    if piece.packing == "zip":
        archive = zipfile.ZipFile(f)
        return archive.open(piece.member), [archive, f]
    if piece.packing == "gzip":
        return gzip.GzipFile(fileobj=f), [f]
    return io.BufferedReader(f, 1 << 20), [f]


def _header(piece: Piece) -> tuple[str, list[str]]:
    stream, others = _opened(piece)
    try:
        line = stream.readline().decode("utf-8-sig", errors="replace").rstrip("\r\n")
    finally:
        for x in (stream, *others):
            x.close()
    sep = max(SEPARATORS, key=line.count)
    return sep, next(csv.reader([line], delimiter=sep), [])


def _lines(stream: io.BufferedIOBase, piece: Piece) -> Iterator[str]:
    """The texts of a range's lines; a range after the first starts behind its first line end."""
    at = piece.start
    if at:
        stream.seek(at - 1)
        at += len(stream.readline()) - 1
    while piece.stop is None or at < piece.stop:
        raw = stream.readline()
        if not raw:
            return
        yield raw.decode("utf-8-sig" if at == 0 else "utf-8")
        at += len(raw)


class UnknownReader(DataSourceReader):
    def __init__(self, schema: StructType, pieces: list[Piece]):
        self.names, self.pieces = schema.names, pieces

    def partitions(self) -> list[Piece]:
        return self.pieces

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        sep, head = _header(partition)
        places = [head.index(n) if n in head else -1 for n in self.names]
        stream, others = _opened(partition)
        rows: list[list[str]] = []
        try:
            lines = csv.reader(_lines(stream, partition), delimiter=sep)
            if partition.start == 0:
                next(lines, None)
            for row in lines:
                if len(row) > len(head):
                    raise ValueError(f"{partition.path} {partition.member}: line {lines.line_num} of the range from byte {partition.start} has {len(row)} fields, the header has {len(head)}")
                if row:
                    rows.append(row)
                if len(rows) == BATCH:
                    yield self._batch(rows, places)
                    rows = []
            if rows:
                yield self._batch(rows, places)
        finally:
            for x in (stream, *others):
                x.close()

    def _batch(self, rows: list[list[str]], places: list[int]) -> pa.RecordBatch:
        columns = [pa.array([r[p] or None if 0 <= p < len(r) else None for r in rows], pa.string()) for p in places]
        return pa.RecordBatch.from_arrays(columns, names=self.names)


class UnknownTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "unknown_table"

    def _pieces(self) -> list[Piece]:
        step = int(self.options.get("split_bytes", 0))
        out: list[Piece] = []
        for path in listed(self.options["path"], tuple(filter(None, self.options.get("suffixes", "").split(",")))):
            kind = packing(path)
            if kind == "zip":
                held = members(path)
                if not held:
                    raise ValueError(f"{path}: no member is named .csv or .txt")
                out += [Piece(path, kind, m) for m in (held if self.options.get("members") == "all" else held[:1])]
            elif kind == "plain" and step > 0:
                system, inside = store(path)
                size = system.get_file_info(inside).size
                out += [Piece(path, kind, "", at, min(at + step, size)) for at in range(0, max(size, 1), step)]
            else:
                out.append(Piece(path, kind))
        return out

    def schema(self) -> StructType:
        found = self._pieces()
        names = _header(found[0])[1] if found else []
        if not any(names):
            raise ValueError(f"{self.options['path']}: no header")
        return StructType([StructField(n, StringType()) for n in dict.fromkeys(names) if n])

    def reader(self, schema: StructType) -> UnknownReader:
        return UnknownReader(schema, self._pieces())


def read_unknown(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(UnknownTable)
    return spark.read.format(UnknownTable.name()).options(**options).load(path)
