"""GeoJSON to GeoParquet, GeoParquet to GeoJSON, Parquet to GeoParquet."""

from __future__ import annotations

import os
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..errors import NoMetadataError, TerravaneError
from ..functions import columns
from ..metadata import WKB, GeoMetadata, resolve
from ..sources import footers, geojson, geoparquet, schema, storage
from ..sources.storage import Format
from . import stats


def to_geoparquet(df: DataFrame, metadata: GeoMetadata | None = None, primary: str | None = None, compute_stats: bool = False) -> tuple[DataFrame, GeoMetadata]:
    """A table with every geometry in WKB, and its metadata.

    Columns of text among the geometries are read as WKT; their bounds and types are summed. Those
    of bytes stay as they are, and are only read if `compute_stats`.
    """
    metadata = resolve(metadata or geoparquet.metadata_of(df), df.columns, primary)
    text = [n for n in metadata.columns if n in df.columns and dict(df.dtypes)[n] == "string"]
    counted = [n for n in metadata.columns if n in df.columns and (compute_stats or n in text)]
    out = df.withColumns({n: columns.wkt_to_wkb(F.col(n)) for n in text}) if text else df
    for n in text:
        metadata.column(n)["encoding"] = WKB
    if counted:
        metadata = stats.with_stats(metadata, stats.geometry_stats(out.select(*counted), counted))
    return geoparquet.with_metadata(out, metadata), metadata


def convert(
    spark: SparkSession,
    source: str,
    target: str,
    source_format: str = "auto",
    target_format: str = "auto",
    min_features: int = geojson.MIN_FEATURES,
    max_features: int = geojson.MAX_FEATURES,
    primary: str | None = None,
    compression: str | None = None,
    row_group_length: int = 0,
    compute_stats: bool = False,
    keep_id: bool = False,
    keep_codecs: bool | None = None,
    single_file: bool = False,
) -> dict:
    """Converts a file or folder and says what was written: format, path, schema, geo, records.

    Writes a folder of files in parallel; single_file=True writes one file, for exports of a bounded
    size. Parquet input keeps each column's codec where no `compression` is given; else columns have
    that codec, or zstd. keep_codecs=True keeps those of known columns beside a `compression`.
    """
    taken, made = storage.parse_format(source_format), storage.parse_format(target_format)
    if taken is Format.AUTO:
        taken = storage.format_of(source)
    if made is Format.AUTO:
        made = storage.format_of(target)
    if taken is Format.UNKNOWN:
        raise TerravaneError(f"could not determine input format for {source}")
    if made is Format.UNKNOWN:
        raise TerravaneError(f"could not determine output format for {target}")
    if made is Format.PARQUET:
        made = Format.GEOPARQUET
    if not urlsplit(source).netloc and os.path.abspath(source) == os.path.abspath(target):
        raise TerravaneError("the output would replace the input")
    if made is Format.GEOJSON and taken is Format.GEOJSON:
        raise TerravaneError("GeoJSON input can only be converted to GeoParquet")
    codecs: dict[str, str] = {}
    if taken is Format.GEOJSON:
        df = geojson.read(spark, source, min_features, max_features, keep_id=keep_id)
        # read twice, for the statistics and to write: kept where memory or disk allows
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        out, metadata = to_geoparquet(geoparquet.with_metadata(df, GeoMetadata.default()), GeoMetadata.default(), primary, compute_stats=True)
    else:
        path = storage.readable(source)
        try:
            found = geoparquet.file_metadata(source)
        except NoMetadataError:
            if taken is Format.GEOPARQUET:
                raise
            found = None
        df = spark.read.parquet(path)
        if made is Format.GEOJSON:
            metadata = resolve(found, df.columns, primary)
            geojson.write(geoparquet.with_metadata(df, metadata), target, metadata, single_file, "id" if keep_id and "id" in df.columns else None)
            return {"format": "geojson", "path": target, "schema": df.schema.jsonValue(), "geo": metadata.raw, "records": df.count()}
        out, metadata = to_geoparquet(geoparquet.with_metadata(df, found) if found else df, found, primary, compute_stats)
        codecs = geoparquet.column_codecs(path) if keep_codecs or (keep_codecs is None and not compression) else {}
    geoparquet.write(out, target, metadata, compression or "zstd", codecs, row_group_length, single_file)
    df.unpersist()
    file = storage.open_parquet(target)
    records = footers.totals(spark, target)[0]
    return {"format": "geoparquet", "path": target, "schema": schema.message(file.schema), "geo": metadata.raw, "records": records}
