"""Footers of Parquet files: the key-value pairs as they stand, and row groups of many files at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import TerravaneError
from . import storage

_MAGIC = b"PAR1"
_FIXED = {3: 1, 7: 8}  # byte and double
ROWS = "file string, row_group int, first long, rows long"


class _Compact:
    """What a footer needs of Thrift's compact protocol: fields that are read and fields that are skipped."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def number(self) -> int:
        out = shift = 0
        while True:
            byte = self.data[self.at]
            self.at += 1
            out |= (byte & 0x7F) << shift
            if byte < 0x80:
                return out
            shift += 7

    def binary(self) -> bytes:
        n = self.number()
        self.at += n
        return self.data[self.at - n : self.at]

    def fields(self) -> Iterator[tuple[int, int]]:
        """(id, kind) of a struct's fields; each must be read or skipped before the next."""
        ident = 0
        while (head := self.data[self.at]) != 0:
            self.at += 1
            if head >> 4:
                ident += head >> 4
            else:
                raw = self.number()
                ident = (raw >> 1) ^ -(raw & 1)
            yield ident, head & 15
        self.at += 1

    def items(self) -> tuple[int, int]:
        """Count and kind of a list's items."""
        head = self.data[self.at]
        self.at += 1
        return (self.number() if head >> 4 == 15 else head >> 4), head & 15

    def skip(self, kind: int, item: bool = False) -> None:
        if kind in (1, 2):
            self.at += item
        elif kind in _FIXED:
            self.at += _FIXED[kind]
        elif kind in (4, 5, 6):
            self.number()
        elif kind == 8:
            self.binary()
        elif kind in (9, 10):
            n, of = self.items()
            for _ in range(n):
                self.skip(of, True)
        elif kind == 12:
            for _, of in self.fields():
                self.skip(of)
        else:
            raise ValueError(f"unexpected kind {kind} in a footer")


def pairs_of(footer: bytes) -> list[tuple[str, str]]:
    """Every key-value pair of a footer, in order; a key stated twice is there twice."""
    read, out = _Compact(footer), []
    for ident, kind in read.fields():
        if ident != 5 or kind != 9:
            read.skip(kind)
            continue
        n, _ = read.items()
        for _ in range(n):
            pair = {1: b"", 2: b""}
            for field, of in read.fields():
                if field in pair and of == 8:
                    pair[field] = read.binary()
                else:
                    read.skip(of)
            out.append((pair[1].decode("utf-8", "replace"), pair[2].decode("utf-8", "replace")))
    return out


def pairs(path: str, file: str | None = None) -> list[tuple[str, str]]:
    """Those of a file, or of a folder's first file; two short reads from its end."""
    with storage.open_file(path, file) as source:
        size = source.size()
        source.seek(max(0, size - 8))
        tail = source.read(8)
        if len(tail) < 8 or tail[4:] != _MAGIC:
            raise TerravaneError(f'failed to read "{path}" as parquet: no footer')
        n = int.from_bytes(tail[:4], "little")
        if n > size - 8:
            raise TerravaneError(f'failed to read "{path}" as parquet: the footer is longer than the file')
        source.seek(size - 8 - n)
        try:
            return pairs_of(source.read(n))
        except (IndexError, ValueError) as e:
            raise TerravaneError(f'failed to read "{path}" as parquet: {e}') from e


def file_key(path: Column) -> Column:
    """A file's address as Spark's `_metadata.file_path` and file listings both have it."""
    return F.regexp_replace(path, "^([A-Za-z0-9+.-]+):/+", "$1:/")


def each_file(spark: SparkSession, path: str) -> DataFrame:
    """(file): the addresses of the data files that Spark reads at `path`, spread over tasks."""
    files = sorted(spark.read.parquet(storage.readable(path)).inputFiles())
    return spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, min(len(files), 1000)))


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_group, first, rows) of every row group: its first row's number in its file, and how
    many it has. Each file's footer is read by a task."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found: list[tuple] = []
            for file in batch.column(0).to_pylist():
                meta, at = storage.open_parquet(storage.address(file)).metadata, 0
                for i in range(meta.num_row_groups):
                    n = meta.row_group(i).num_rows
                    found.append((file, i, at, n))
                    at += n
                if not meta.num_row_groups:
                    found.append((file, -1, 0, 0))  # an empty file is a file
            cols = list(zip(*found)) if found else [()] * 4
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["file", "row_group", "first", "rows"])

    return each_file(spark, path).mapInArrow(run, ROWS)


def totals(spark: SparkSession, path: str) -> tuple[int, int]:
    """Rows and row groups of all files."""
    files = storage.parquet_files(path)
    if len(files) == 1:
        meta = storage.open_parquet(path, files[0]).metadata
        return meta.num_rows, meta.num_row_groups
    found = row_groups(spark, path).where("row_group >= 0").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("r"), F.count(F.lit(1)).alias("g")).first()
    return found.r, found.g


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    """(file, start): how many rows the files before it hold, in order of their addresses. Only a
    row for each file meets in one task."""
    sizes = row_groups(spark, path).groupBy("file").agg(F.sum("rows").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
