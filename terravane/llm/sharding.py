"""Sharding [native]: contiguous shards of near equal bytes.

Rows are range-partitioned by doc_id; sizes are summed per partition, the totals of partitions
(one row each) become global prefix sums, and every row's place in the byte order follows from its
partition's base and a running sum within the partition. Cuts lie at equal targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch


def shard(docs: DataFrame, shards: int = 8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): law `bytes`.

    A row's size is its text's UTF-8 bytes plus 1 (null text: 1). In order of key (nulls first,
    ties by size, checksum and place in the input) the row whose middle byte lies in the i-th of
    `shards` equal stretches goes to shard i, so shards differ by about one row's size. Repeated
    rows each count and keep their own slot; a third of all rows with one key still spread over
    partitions, as the place in the input is part of the order. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "shard")
    body = F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))
    slim = docs.select(F.col(key).alias("doc_id"), (F.octet_length(body) + F.lit(1)).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    order = ["doc_id", "size", "text_crc32", "_place"]
    dealt = slim.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(*order)
    # written once, so that a partition's number means the same rows in every later step
    parts = scratch.keep(dealt.withColumn("_part", F.spark_partition_id()), "parts")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    bases = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_byte_base"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_row_base"),
        F.sum("_bytes").over(Window.partitionBy()).alias("_total"),
    )
    own = Window.partitionBy("_part").orderBy(*order)
    placed = (
        parts.withColumn("_upto", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_nth", F.row_number().over(own))
        .join(F.broadcast(bases), "_part")  # a row for each range partition
        .withColumn("_twice_middle", 2 * (F.col("_byte_base") + F.col("_upto")) - F.col("size"))
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.col("_twice_middle") * shards / (2 * F.col("_total")))).cast("int"))
        .withColumn("_index", F.col("_row_base") + F.col("_nth") - 1)
    )
    # where each shard begins: at most one row for each shard and partition is aggregated
    first = placed.groupBy("shard").agg(F.min("_index").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_index") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
