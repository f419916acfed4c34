"""The box filter and projection over a folder that grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.bbox import Bbox
from ..operators.extract import extract
from ..sources import geoparquet


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """New files of a folder of GeoParquet; schema and metadata are those of the files there now."""
    metadata = geoparquet.file_metadata(path)
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return geoparquet.with_metadata(stream, metadata)


def extract_stream(spark: SparkSession, path: str, bbox: Bbox | str | None = None, keep: list[str] | None = None, drop: list[str] | None = None) -> DataFrame:
    return extract(read_stream(spark, path), bbox, keep, drop)
