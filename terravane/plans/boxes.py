"""Where a row's box comes from: a struct column that the scan can prune by, else the geometry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TerravaneError
from ..functions import bbox, columns
from ..metadata import GeoMetadata
from ..sources import geoparquet, storage

FIELDS = ("xmin", "ymin", "xmax", "ymax")


@dataclass(frozen=True)
class BboxColumn:
    """A box column by name, never by position; name is empty if there is none."""

    name: str
    fields: tuple[str, str, str, str]
    base: str


def bbox_column(schema: T.StructType, metadata: GeoMetadata) -> BboxColumn:
    """A struct named bbox, else the one that `covering` names."""
    base = metadata.primary_column
    covering = ((metadata.columns.get(base) or {}).get("covering") or {}).get("bbox") or {}
    paths = [covering.get(f) or covering.get(f.capitalize()) for f in FIELDS]
    fields = tuple(p[1] if p and len(p) > 1 else f for p, f in zip(paths, FIELDS))
    candidates = ["bbox"] + ([paths[0][0]] if paths[0] else [])
    for name in candidates:
        if name in schema.names and isinstance(schema[name].dataType, T.StructType):
            own = fields if all(f in schema[name].dataType.names for f in fields) else FIELDS
            if all(f in schema[name].dataType.names for f in own):
                return BboxColumn(name, own, base)
    return BboxColumn("", FIELDS, base)


def meets(df: DataFrame, metadata: GeoMetadata, box: bbox.Bbox, wrap: bool = False) -> Column:
    """Does a row's box meet the query box; null where it has none."""
    found = bbox_column(df.schema, metadata)
    if found.name:
        return bbox.intersects(F.col(found.name), box, found.fields, wrap)
    if found.base not in df.columns:
        raise TerravaneError(f'expected a geometry column named "{found.base}"')
    return bbox.intersects(columns.envelope(F.col(found.base)), box, FIELDS, wrap)


def row_group_boxes(spark: SparkSession, path: str, name: str = "bbox", fields: tuple[str, str, str, str] = FIELDS) -> DataFrame:
    """(file, row_group, first, rows, and low_ and high_ of xmin, ymin, xmax, ymax) from footers alone."""
    stats = geoparquet.row_group_stats(spark, path)
    of = lambda end, field: F.max(F.when(F.col("column") == f"{name}.{field}", F.col(end)))
    ends = [of(end, f).alias(f"{a}_{g}") for end, a in (("min", "low"), ("max", "high")) for f, g in zip(fields, FIELDS)]
    return stats.groupBy("file", "row_group", "first", "rows").agg(*ends)


def row_groups_meeting(spark: SparkSession, path: str, box: bbox.Bbox) -> DataFrame:
    """(file, row_group, first, rows) of the row groups that can hold a row whose box meets `box`.

    By the statistics of the box column, which the file must have. A group that may hold a box over
    the antimeridian, or has no statistics, stays. geoparquet.of_row_groups reads them.
    """
    found = bbox_column(spark.read.parquet(storage.readable(path)).schema, geoparquet.file_metadata(path))
    if not found.name:
        raise TerravaneError("there is no bbox column whose statistics could tell row groups apart")
    q, groups = box.shifted(), row_group_boxes(spark, path, found.name, found.fields)
    over = (F.col("high_xmin") > 0) & (F.col("low_xmax") < 0)
    meets_ = (F.col("high_ymax") >= q.ymin) & (F.col("low_ymin") <= q.ymax) & (F.col("high_xmax") >= q.xmin) & ((F.col("low_xmin") <= q.xmax) | over)
    return groups.where(F.coalesce(meets_, F.lit(True))).select("file", "row_group", "first", "rows")


def extract_row_groups(spark: SparkSession, path: str, box: bbox.Bbox) -> DataFrame:
    """Rows of the groups that `row_groups_meeting` keeps, with the file's metadata."""
    df = spark.read.parquet(storage.readable(path))
    return geoparquet.with_metadata(geoparquet.of_row_groups(df, row_groups_meeting(spark, path, box)), geoparquet.file_metadata(path))
