"""Bounds and types of geometry columns: one pass of partial and final sums for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns
from ..metadata import GeoMetadata


def bounds(box: Column) -> list[Column]:
    return [F.min(box.xmin).alias("xmin"), F.min(box.ymin).alias("ymin"), F.max(box.xmax).alias("xmax"), F.max(box.ymax).alias("ymax")]


def types(geometry: Column) -> Column:
    """Distinct type names, sorted. At most as many as there are types."""
    return F.array_sort(F.collect_set(columns.geometry_type(geometry)))


def geometry_stats(df: DataFrame, names: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., column, xmin, ymin, xmax, ymax, types) of WKB or WKT columns.

    Nulls and empty geometries count for no bounds; a column without any has null bounds.
    """
    by = by or []
    text = {n for n, t in df.dtypes if t == "string"}
    # text is parsed once: a projection of its own, which Spark doesn't fold into the next
    parsed = df.select(*by, *[(columns.wkt_to_wkb(F.col(n)) if n in text else F.col(n)).alias(f"_wkb_{n}") for n in names])
    staged = parsed.select("*", *[columns.envelope(F.col(f"_wkb_{n}")).alias(f"_box_{n}") for n in names])
    sums = [c.alias(f"_{k}_{n}") for n in names for k, c in zip(("x0", "y0", "x1", "y1", "types"), [*bounds(F.col(f"_box_{n}")), types(F.col(f"_wkb_{n}"))])]
    one = staged.groupBy(*by).agg(*sums) if by else staged.agg(*sums)
    row = lambda n: F.struct(F.lit(n).alias("column"), *[F.col(f"_{k}_{n}").alias(a) for k, a in zip(("x0", "y0", "x1", "y1", "types"), ("xmin", "ymin", "xmax", "ymax", "types"))])
    return one.select(*by, F.inline(F.array(*[row(n) for n in names])))


def with_stats(metadata: GeoMetadata, stats: DataFrame) -> GeoMetadata:
    """The metadata with each column's bbox and geometry_types. Bounds that don't exist are left out."""
    out = metadata.clone()
    for r in stats.collect():  # a row for each geometry column
        column = out.column(r["column"])
        column["geometry_types"] = list(r.types)
        column.pop("bbox", None)
        if r.xmin is not None:
            column["bbox"] = [r.xmin, r.ymin, r.xmax, r.ymax]
    return out
