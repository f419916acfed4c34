"""A Parquet rewrite column by column: declared, so that one pass reads, changes and writes."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import NoMetadataError, TerravaneError
from ..metadata import GeoMetadata
from ..sources import geoparquet, storage


def text_to_number(c: Column) -> Column:
    """Text as a double; text that is no number fails, null stays."""
    return c.cast("double")


def transformed(df: DataFrame, columns: Mapping[str, Callable[[Column], Column]] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """`df` with columns changed. `schema` names the outcome: as many fields as there are columns, by
    place; a column whose type then differs is an error, as nothing is cast in silence."""
    unknown = sorted(set(columns or {}) - set(df.columns))
    if unknown:
        raise TerravaneError(f"no columns named {', '.join(unknown)}")
    if schema is not None and len(schema.fields) != len(df.columns):
        raise TerravaneError(f"unexpected number of fields in the output schema, got {len(schema.fields)}, expected {len(df.columns)}")
    names = [f.name for f in schema.fields] if schema else df.columns
    change = columns or {}
    out = df.select(*[(change[c](F.col(f"`{c}`")) if c in change else F.col(f"`{c}`")).alias(n) for c, n in zip(df.columns, names)])
    for made, wanted in zip(out.schema.fields, schema.fields if schema else ()):
        if made.dataType != wanted.dataType:
            raise TerravaneError(f"transform generated an unexpected type for {made.name}, got {made.dataType.simpleString()}, expected {wanted.dataType.simpleString()}")
    return out


def transform(
    spark: SparkSession,
    source: str,
    target: str,
    columns: Mapping[str, Callable[[Column], Column]] | None = None,
    schema: T.StructType | None = None,
    compression: str | None = None,
    row_group_length: int = 0,
    metadata: Callable[[GeoMetadata | None], GeoMetadata | None] = lambda found: found,
    single_file: bool = False,
) -> None:
    """Rewrites the table at `source`. Where no `compression` is given, columns that keep their name
    keep the codec of the first row group. `metadata` makes the new document from the old one (None:
    there is none, and the files get none)."""
    try:
        found = geoparquet.file_metadata(source)
    except NoMetadataError:
        found = None
    out = transformed(spark.read.parquet(storage.readable(source)), columns, schema)
    codecs = {} if compression else geoparquet.column_codecs(source)
    geoparquet.write(out, target, metadata(found), compression or "zstd", codecs, row_group_length, single_file, plain=metadata(found) is None)
