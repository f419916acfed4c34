"""Shared plumbing: inputs, the scratch folder all executors see, row keys, Arrow batches."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Text bytes that one vectorised step holds at a time (a longer single text is its own step).
CHUNK_BYTES = 600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one only where none is set, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="terravane-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


class Scratch:
    """Tables written under the shared folder to cut lineage: a lost executor costs a re-read.

    `drop()` removes those no longer needed; what a returned DataFrame reads stays.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/terravane/{what}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        free_shuffles(self.spark)
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(self.path(name))
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete a query's shuffle files as it ends, not when the driver collects garbage."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def small(rows: int) -> dict[str, str]:
    """Settings that bound what an Arrow batch of whole texts takes of an executor's memory."""
    return {_ROWS: str(rows), _BYTES: str(4 << 20)}


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Those settings for the session, for what a caller runs later: a stricter one stays."""
    if not 0 < int(spark.conf.get(_ROWS)) <= rows:
        spark.conf.set(_ROWS, str(rows))
    spark.conf.set(_BYTES, small(rows)[_BYTES])


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings within a block, and as they were behind it."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def with_row_key(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs (doc_id, text, ...) with a first column _rid that orders rows as doc_id does.

    Where doc_id has no null and no repetition, it is the key itself. Else rows are ranked by
    (doc_id, nulls first; text's hash) and equal rows share a key: a row stated twice is one
    document, and each statement of it gets the same result.
    """
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long")).drop("_rid")
    if not has_odd_keys(docs):
        return docs.select(F.col("doc_id").alias("_rid"), "*")
    mine = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    ranked = global_index(mine.select("doc_id", "h").distinct(), ["doc_id", "h"], scratch, "_rid")
    a, b = mine.alias("a"), ranked.alias("b")
    joined = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.h") == F.col("b.h")))
    return joined.select("b._rid", "a.row.*")


def has_odd_keys(docs: DataFrame) -> bool:
    """Is a doc_id null or stated twice."""
    return bool(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").limit(1).count())


def global_index(df: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """Adds a gapless 0-based index in the given order, from per-partition counts.

    Range partitions are ranked each on their own; the only rows that meet in one task are the
    per-partition totals.
    """
    parted = scratch.keep(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), f"{name}_parts")
    totals = parted.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_part", "_base")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parted.withColumn("_own", own).join(F.broadcast(bases), "_part").withColumn(name, F.col("_base") + F.col("_own") - 1).drop("_part", "_own", "_base")


def text_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column and its int64 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets and len(column) else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, of one row at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)
