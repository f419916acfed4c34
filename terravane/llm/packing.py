"""Best-fit packing [method: length-histogram planning].

Only the histogram of piece lengths reaches the driver (at most `capacity` rows). Best-fit
decreasing runs over its counts: bins alike in what is left are one entry with a count. The plan
is a list of slot runs for each length; pieces take slots by joining on their rank within length.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe, common

#: Ranks that share a join key, so that no length is one hot key.
BLOCK = 1024


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slot runs (length, first_rank, n_ranks, first_bin, offset, per_bin).

    Lengths fall from the longest; each item goes to the open bin with the least room that still
    takes it, as best-fit decreasing does item by item. The rank r of a length's run lies in bin
    first_bin + (r - first_rank) // per_bin, at offset + length * ((r - first_rank) % per_bin).
    Entries depend on the capacity and not on the number of items.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # what is left -> [(first bin, bins)]
    sizes: list[int] = []  # keys of room, ascending
    out, bins = [], 0

    def open_(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in room:
                bisect.insort(sizes, left)
                room[left] = []
            room[left].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                left = sizes[at]
                first, n = room[left].pop()
                if not room[left]:
                    del room[left], sizes[at]
            else:
                left, first, n = capacity, bins, -(-todo // (capacity // length))
                bins += n
            each = left // length
            full, rest = min(n, todo // each), 0
            if full < n and full * each < todo:
                rest = todo - full * each  # the last bin of this run takes fewer
            taken = full * each + rest
            used = full + bool(rest)
            out.append((length, rank, taken, first, capacity - left, each))
            open_(left - each * length, first, full)
            if rest:
                open_(left - rest * length, first + full, 1)
            open_(left, first + used, n - used)
            rank, todo = rank + taken, todo - taken
    return out


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, _part, _nth[, ids]): documents cut at `capacity`
    tokens; _nth counts pieces of one length within their task from 0."""
    common.small_batches(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "_part", "_nth"] + ["ids"] * keep_ids

    def run(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for rows, ids, off in bpe.encoded(batches, vocabulary):
            ids = np.insert(ids, off[1:], end_id)
            off = off + np.arange(len(off))
            size = np.diff(off)
            number = -(-size // capacity)
            doc = np.repeat(np.arange(len(size)), number)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
            start = piece * capacity
            length = np.minimum(capacity, size[doc] - start)
            bounds = np.append(off[doc] + start, off[-1])
            order = np.argsort(length, kind="stable")
            sorted_ = length[order]
            head = np.append(True, sorted_[1:] != sorted_[:-1]) if len(sorted_) else np.zeros(0, bool)
            nth = np.empty(len(doc), np.int64)
            at = np.arange(len(doc))
            nth[order] = at - np.maximum.accumulate(np.where(head, at, 0)) + seen[sorted_] if len(doc) else at
            seen += np.bincount(length, minlength=capacity + 1)
            cols = [rows.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(bpe.crc32s(ids, bounds)), pa.array(np.full(len(doc), part, np.int32)), pa.array(nth)]
            if keep_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, _part int, _nth long" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = 4096, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of every piece.

    A document is its text's ids (null: none) and end_id; only those over `capacity` are cut, into
    pieces of that length and a last one. Each row is packed on its own: repeated rows and null
    doc_ids take slots like any other. An empty table gives no rows. Within a sequence pieces lie
    gapless from 0.
    """
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "pack")
    cut = scratch.keep(pieces(docs, vocabulary, end_id, capacity, keep_ids), "pieces")
    # ranks within length: counts of each (length, task) summed over the tasks before
    own = cut.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = own.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("length", "_part", "_base")
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = spark.createDataFrame(
        plan(histogram, capacity) or [(1, 0, 0, 0, 0, 1)], "length long, _first long, _ranks long, _bin long, _at long, _each long"
    ).where("_ranks > 0")
    last = F.col("_first") + F.col("_ranks") - 1
    slots = runs.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_first") / BLOCK), F.floor(last / BLOCK))))
    ranked = cut.join(bases, ["length", "_part"]).withColumn("_rank", F.col("_base") + F.col("_nth")).withColumn("_block", F.floor(F.col("_rank") / BLOCK))
    placed = ranked.join(slots, ["length", "_block"]).where((F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_ranks")))
    nth = F.col("_rank") - F.col("_first")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_bin") + F.floor(nth / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_at") + F.col("length") * (nth % F.col("_each"))).cast("long").alias("offset"),
        *["ids"] * keep_ids,
    )
