"""Column projection and box filter, both pushed down to the scan where they can be."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..errors import TerravaneError
from ..functions.bbox import Bbox
from ..metadata import GeoMetadata
from ..plans import boxes
from ..sources import geoparquet


def keep_columns(names: list[str], keep: list[str]) -> list[str]:
    """In the order of the file; unknown names are ignored."""
    return [n for n in names if n in keep]


def drop_columns(names: list[str], drop: list[str]) -> list[str]:
    return [n for n in names if n not in drop]


def extract(df: DataFrame, bbox: Bbox | str | None = None, keep: list[str] | None = None, drop: list[str] | None = None, metadata: GeoMetadata | None = None, wrap: bool = False) -> DataFrame:
    """Rows whose box meets `bbox` (edges included), with the columns kept or not dropped.

    The filter comes first, so the box may come from a column that isn't kept. The primary geometry
    must be. Rows without a box never meet one.
    """
    metadata = metadata or geoparquet.metadata_of(df) or GeoMetadata.default()
    if keep and drop:
        raise TerravaneError("please pass either columns to keep or columns to drop, not both")
    names = keep_columns(df.columns, keep) if keep else drop_columns(df.columns, drop or [])
    if (keep or drop) and metadata.primary_column not in names:
        raise TerravaneError(f'columns must include the primary geometry column "{metadata.primary_column}"')
    box = Bbox.parse(bbox) if isinstance(bbox, str) else bbox
    out = df.where(boxes.meets(df, metadata, box, wrap)) if box else df
    return geoparquet.with_metadata(out.select(*[f"`{n}`" for n in names]), metadata.only(names))
