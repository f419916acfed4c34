"""Token-ID files: flat unsigned integers plus 64-bit document offsets, memory-mapped.

A part is `NAME.ids` (uint16 where the vocabulary fits, else uint32, little-endian) and `NAME.off`
(int64: each document's start in the part, and the end). A manifest row tells each part's first
document and token; these bases are prefix sums of the parts' totals.
"""

from __future__ import annotations

import contextlib
import uuid
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, common

#: Tokens that the reader holds at a time; a longer document is its own step.
STEP_TOKENS = 1 << 20
PART = "_part int, documents long, tokens long, name string, bits int"


def _store(root: str):
    """(file system, folder) of a URL; a plain path or file: is local."""
    from pyarrow import fs

    at = urlsplit(root)
    return (fs.LocalFileSystem(), at.path) if at.scheme in ("", "file") else fs.FileSystem.from_uri(root)


def write(docs: DataFrame, root: str, vocabulary: str, end_id: int | None) -> DataFrame:
    """Writes documents in ascending doc_id order (nulls first, ties by the
    text's hash and the place in the input) and returns the
    manifest (_part, documents, tokens, name, bits, document_base, token_base).

    Null text: empty, so that only the end id is written. Each attempt of a task writes files of
    its own name; the manifest, written last, tells which count, so a lost executor or a repeated
    task leaves no double rows.
    """
    common.small_batches(docs.sparkSession)
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["doc_id", "_hash", "_place"]
    ordered = keys.withColumn("_hash", F.xxhash64("text")).withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        store, folder = _store(root)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        small = bpe.encoder(vocabulary).merges.size <= 1 << 16 and (end_id or 0) < 1 << 16
        kind = np.dtype("<u2" if small else "<u4")
        offsets, documents, tokens = [np.zeros(1, np.int64)], 0, 0
        store.create_dir(folder, recursive=True)
        ids_of_docs = []
        with contextlib.ExitStack() as files:
            out = None
            for rows, ids, off in bpe.encoded(batches, vocabulary):
                out = out or files.enter_context(store.open_output_stream(f"{folder}/{name}.ids"))
                if end_id is not None:
                    ids = np.insert(ids, off[1:], end_id)
                    off = off + np.arange(len(off))
                out.write(np.ascontiguousarray(ids, kind).data)
                offsets.append(tokens + off[1:])
                ids_of_docs.append(rows.column(0))
                documents, tokens = documents + len(off) - 1, tokens + len(ids)
        if documents:
            with store.open_output_stream(f"{folder}/{name}.off") as out:
                out.write(np.ascontiguousarray(np.concatenate(offsets), "<i8").data)
            nulls = sum(x.null_count for x in ids_of_docs)
            with store.open_output_stream(f"{folder}/{name}.key") as out:  # doc_ids, nulls first
                out.write(np.ascontiguousarray(np.concatenate([[nulls], *(np.asarray(x.drop_null()) for x in ids_of_docs)]), "<i8").data)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([documents]), pa.array([tokens]), pa.array([name]), pa.array([kind.itemsize * 8], pa.int32())], [x.split()[0] for x in PART.split(", ")])

    spark = docs.sparkSession
    ordered.mapInArrow(run, PART).write.parquet(f"{root}/manifest")
    return manifest(spark, root)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """A row for each part, with the bases that its documents and tokens start from."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = spark.read.schema(PART).parquet(f"{root}/manifest")
    return parts.withColumns({f"{x}_base": F.coalesce(F.sum(f"{x}s").over(before), F.lit(0)) for x in ("document", "token")})


def _open(store, path: str, kind: str) -> np.ndarray:
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with store.open_input_file(path) as f:  # no mapping there
        return np.frombuffer(f.read(), kind)


def read(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone."""
    parts = manifest(spark, root)
    spread = parts.select("_part", "name", "bits", "token_base").repartition(max(1, spark.sparkContext.defaultParallelism * 2), "_part")

    def run(batches):
        store, folder = _store(root)
        for batch in batches:
            for _, name, bits, base in zip(*(c.to_pylist() for c in batch.columns)):
                off, key = (np.asarray(_open(store, f"{folder}/{name}.{x}", "<i8")) for x in ("off", "key"))
                docs = pa.concat_arrays([pa.nulls(int(key[0]), pa.int64()), pa.array(key[1:])])
                ids = _open(store, f"{folder}/{name}.ids", f"<u{bits // 8}") if off[-1] else np.zeros(0, np.uint16)
                for a, b in common.chunks(off, STEP_TOKENS):
                    own = np.asarray(ids[off[a] : off[b]])
                    crc = bpe.crc32s(own, off[a : b + 1] - off[a])
                    yield pa.RecordBatch.from_arrays([docs.slice(a, b - a), pa.array(base + off[a:b]), pa.array(np.diff(off[a : b + 1])), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
