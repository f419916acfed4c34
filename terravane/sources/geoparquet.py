"""Parquet with geometry metadata: reading, footers, row-group statistics, writing."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from ..errors import MetadataError, NoMetadataError, TerravaneError
from ..functions import columns as columns_
from ..metadata import KEY, GeoMetadata
from . import footers, storage

CODECS = ("uncompressed", "snappy", "gzip", "brotli", "zstd", "lz4")
WRITER = "terravane_geoparquet"


def codec(name: str) -> str:
    if name.lower() not in CODECS:
        raise TerravaneError(f"invalid compression codec {name}")
    return "none" if name.lower() == "uncompressed" else name.lower()


def file_metadata(path: str) -> GeoMetadata:
    """Of a file, or of a folder's first file."""
    return GeoMetadata.of_footer(footers.pairs(path))


def metadata_of(df: DataFrame) -> GeoMetadata | None:
    """The metadata that a frame's geometry columns carry, without entries of columns that it lacks."""
    for f in df.schema.fields:
        if KEY in (f.metadata or {}):
            return GeoMetadata.parse(f.metadata[KEY]).only(df.columns)
    return None


def with_metadata(df: DataFrame, metadata: GeoMetadata) -> DataFrame:
    """Geometry columns carry the document; it survives select and where."""
    text = metadata.to_json()
    for name in metadata.columns:
        if name in df.columns:
            df = df.withMetadata(name, {**(df.schema[name].metadata or {}), KEY: text})
    return df


def read(spark: SparkSession, path: str, columns: list[str] | None = None, row_groups: list[int] | None = None, batch_rows: int | None = None) -> DataFrame:
    """A table with geometry metadata. Columns come in file order; unknown names are ignored, and the
    primary geometry must be among them. Empty lists mean all; `row_groups` are numbers within each
    file. `batch_rows` bounds the rows that the scan decodes at a time, for wide rows (a setting of
    the session). An http(s) file is read by ranges, a row group a task.
    """
    metadata = file_metadata(path)
    if batch_rows:
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(batch_rows))
    if columns and metadata.primary_column not in columns:
        raise TerravaneError(f'columns must include the primary geometry column "{metadata.primary_column}"')
    if storage.is_http(path):
        return with_metadata(_ranged(spark, path, columns, row_groups), metadata)
    df = spark.read.parquet(storage.readable(path))
    if row_groups:
        df = of_row_groups(df, footers.row_groups(spark, path).where(F.col("row_group").isin(row_groups)))
    if columns:
        df = df.select(*[_quoted(c) for c in df.columns if c in columns])
    return with_metadata(df, metadata)


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def _ranged(spark: SparkSession, url: str, columns: list[str] | None, row_groups: list[int] | None) -> DataFrame:
    file = storage.open_parquet(url)
    names = [n for n in file.schema_arrow.names if not columns or n in columns]
    schema = from_arrow_schema(pa.schema([file.schema_arrow.field(n) for n in names]))
    groups = [i for i in range(file.metadata.num_row_groups) if not row_groups or i in row_groups]

    def run(batches: Iterator[pa.RecordBatch]):
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield from storage.open_parquet(url).read_row_group(i, columns=names).select(names).cast(arrow).to_batches(max_chunksize=10_000)

    return spark.createDataFrame([(i,) for i in groups], "i int").repartition(max(1, len(groups))).mapInArrow(run, schema)


def of_row_groups(df: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of a scan that lie in the row groups (file, row_group, first, rows), as footers.row_groups
    gives them: a join by the file's whole address and the row's number in it."""
    chosen = groups.select(footers.file_key(F.col("file")).alias("_file"), F.col("first").alias("_first"), (F.col("first") + F.col("rows")).alias("_end"))
    numbered = df.select("*", footers.file_key(F.col("_metadata.file_path")).alias("_own"), F.col("_metadata.row_index").alias("_at"))
    within = (F.col("_own") == F.col("_file")) & (F.col("_at") >= F.col("_first")) & (F.col("_at") < F.col("_end"))
    return numbered.join(chosen, within, "left_semi").select(*[_quoted(c) for c in df.columns])


def row_group_stats(spark: SparkSession, path: str, leaf: str | None = None) -> DataFrame:
    """(file, row_group, first, rows, column, min, max) of numeric columns, from footers read by tasks.

    `leaf` is a dotted path, such as bbox.xmin. min and max are null where the file has none."""

    def stats(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = []
            for file in batch.column(0).to_pylist():
                meta, at = storage.open_parquet(storage.address(file)).metadata, 0
                for i in range(meta.num_row_groups):
                    group = meta.row_group(i)
                    for k in range(group.num_columns):
                        c = group.column(k)
                        if c.physical_type not in ("DOUBLE", "FLOAT", "INT32", "INT64") or (leaf and c.path_in_schema != leaf):
                            continue
                        s = c.statistics
                        known = s is not None and s.has_min_max
                        low, high = (float(s.min_raw), float(s.max_raw)) if known else (None, None)
                        rows.append((file, i, at, group.num_rows, c.path_in_schema, low, high))
                    at += group.num_rows
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["file", "row_group", "first", "rows", "column", "min", "max"])

    return footers.each_file(spark, path).mapInArrow(stats, "file string, row_group int, first long, rows long, column string, min double, max double")


class GeoParquetSource(DataSource):
    """A sink that puts the `geo` key in every file's footer. Options: path, geo, compression,
    codecs (column=codec, comma-separated), row_group_length, single_file."""

    @classmethod
    def name(cls) -> str:
        return WRITER

    def writer(self, schema, overwrite: bool):
        return _Writer(dict(self.options), overwrite, to_arrow_schema(schema))


class _Part(WriterCommitMessage):
    def __init__(self, name: str, rows: int):
        self.name, self.rows = name, rows


class _Writer(DataSourceArrowWriter):
    """Tasks write into a folder of the job's own; commit moves their files into place, so that a
    task that failed or ran twice leaves nothing behind."""

    def __init__(self, options: dict, overwrite: bool, schema: pa.Schema):
        self.options, self.overwrite, self.schema = options, overwrite, schema
        self.path = options["path"].rstrip("/")
        self.job = uuid.uuid4().hex
        self.single = options.get("single_file", "false").lower() == "true"
        _, at = storage.store(self.path)
        self.folder = f"{os.path.dirname(at) if self.single else at}/_temporary-{self.job}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{self.job}.parquet"
        return _Part(*self._file(name, batches))

    def _file(self, name: str, batches: Iterator[pa.RecordBatch], even_empty: bool = False) -> tuple[str, int]:
        """Writes the rows in groups of the length asked for; no rows, no file, unless `even_empty`."""
        first = next(batches, None)
        if first is None and not even_empty:
            return "", 0
        where, _ = storage.store(self.path)
        where.create_dir(self.folder, recursive=True)
        size = int(self.options.get("row_group_length") or 0) or 1 << 20
        compression: str | dict = codec(self.options.get("compression") or "zstd")
        schema = (first.schema if first is not None else self.schema).remove_metadata()
        for name in filter(None, (self.options.get("required") or "").split(",")):
            schema = schema.set(schema.get_field_index(name), schema.field(name).with_nullable(False))
        if self.options.get("codecs"):
            own = dict(x.split("=", 1) for x in self.options["codecs"].split(","))
            compression = {c: codec(own.get(c, "zstd")) for c in _leaves(schema)}
        held, kept, rows, batch = [], 0, 0, first
        with where.open_output_stream(f"{self.folder}/{name}") as sink, pq.ParquetWriter(sink, schema, compression=compression) as out:
            while batch is not None:
                held.append(batch)
                kept, rows = kept + len(batch), rows + len(batch)
                while kept >= size:
                    table = pa.Table.from_batches(held)
                    out.write_table(table.slice(0, size).cast(schema), row_group_size=size)
                    rest = table.slice(size)
                    held, kept = rest.to_batches(), len(rest)
                batch = next(batches, None)
            if kept:
                out.write_table(pa.Table.from_batches(held).cast(schema), row_group_size=size)
            if self.options.get("geo"):
                out.add_key_value_metadata({KEY: self.options["geo"]})
        return name, rows

    def commit(self, messages) -> None:
        where, at = storage.store(self.path)
        parts = sorted(m.name for m in messages if m and m.name)
        parts = parts or [self._file(f"part-00000-{self.job}.parquet", iter(()), even_empty=True)[0]]
        if self.single:
            if len(parts) != 1:
                raise TerravaneError(f"expected one file, got {len(parts)}")
            if where.get_file_info(at).type == fs.FileType.Directory:
                where.delete_dir(at)
            where.move(f"{self.folder}/{parts[0]}", at)
        else:
            if self.overwrite:
                for f in where.get_file_info(fs.FileSelector(at, allow_not_found=True)):
                    if f.path.rstrip("/") != self.folder:
                        where.delete_dir(f.path) if f.type == fs.FileType.Directory else where.delete_file(f.path)
            for name in parts:
                where.move(f"{self.folder}/{name}", f"{at}/{name}")
            where.open_output_stream(f"{at}/_SUCCESS").close()
        self.abort(messages)

    def abort(self, messages) -> None:
        where, _ = storage.store(self.path)
        if where.get_file_info(self.folder).type == fs.FileType.Directory:
            where.delete_dir(self.folder)


def _leaves(schema: pa.Schema) -> list[str]:
    probe = pa.BufferOutputStream()
    pq.write_table(schema.empty_table(), probe)
    parquet = pq.ParquetFile(pa.BufferReader(probe.getvalue())).schema
    return [parquet.column(i).path for i in range(len(parquet))]


def column_codecs(path: str) -> dict[str, str]:
    """Codec of each leaf in the first row group, to keep it on a rewrite."""
    meta = storage.open_parquet(path).metadata
    if not meta.num_row_groups:
        return {}
    group = meta.row_group(0)
    return {group.column(i).path_in_schema: group.column(i).compression.lower() for i in range(group.num_columns)}


def write(df: DataFrame, path: str, metadata: GeoMetadata | None = None, compression: str = "zstd", codecs: dict[str, str] | None = None, row_group_length: int = 0, single_file: bool = False, mode: str = "overwrite", required: list[str] | None = None, encoding: str | None = None, plain: bool = False) -> None:
    """Writes a folder of files, or one file, each with the metadata of `df` or that given.

    Files are written by the tasks that have the rows. `single_file` deals all rows to one task:
    for exports of a bounded size. A null in a `required` geometry column is an error. `encoding`
    WKB or WKT writes geometry columns so. `plain` leaves the metadata out.
    """
    codec(compression)
    metadata = (metadata or metadata_of(df) or GeoMetadata.default()).clone()
    for name in required or []:
        if name not in df.columns:
            raise TerravaneError(f'missing required geometry column "{name}"')
        missing = F.raise_error(F.lit(f'unexpected null in required geometry column "{name}"')).cast(df.schema[name].dataType)
        df = df.withColumn(name, F.when(F.col(_quoted(name)).isNull(), missing).otherwise(F.col(_quoted(name))))
    if encoding:
        df = _encoded(df, metadata, encoding)
    spark = df.sparkSession
    spark.dataSource.register(GeoParquetSource)
    options = {"path": path, "geo": "" if plain else metadata.to_json(), "compression": compression, "row_group_length": str(row_group_length or 0), "single_file": str(single_file).lower(), "required": ",".join(required or [])}
    if codecs:
        options["codecs"] = ",".join(f"{k}={v}" for k, v in codecs.items())
    where, at = storage.store(path)
    if not single_file and mode == "overwrite" and where.get_file_info(at).type == fs.FileType.File:
        where.delete_file(at)  # a folder takes a file's place
    if single_file:
        df = df.coalesce(1)
    df.write.format(WRITER).mode("overwrite" if single_file else mode).options(**options).save()


def _encoded(df: DataFrame, metadata: GeoMetadata, encoding: str) -> DataFrame:
    """Geometry columns in the encoding asked for; their entries say so."""
    if encoding not in ("WKB", "WKT"):
        raise TerravaneError(f"unsupported geometry encoding: {encoding}")
    for name in [n for n in metadata.columns if n in df.columns]:
        text = isinstance(df.schema[name].dataType, T.StringType)
        if text and encoding == "WKB":
            df = df.withColumn(name, columns_.wkt_to_wkb(F.col(_quoted(name))))
        elif not text and encoding == "WKT":
            df = df.withColumn(name, columns_.wkb_to_wkt(F.col(_quoted(name))))
        metadata.column(name)["encoding"] = encoding
    return df


def require_metadata(path: str) -> GeoMetadata:
    try:
        return file_metadata(path)
    except NoMetadataError as e:
        raise MetadataError(f'missing "{KEY}" metadata key in {path}') from e
