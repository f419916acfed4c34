"""Substring dedup [method: de Bruijn compaction]: see debruijn.py for the graph."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, debruijn, repeats, superkmers

WINDOW, GRAM = 20, 8


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row.

    Words are [^\\x20\\x09-\\x0D]+. Each word covered by a window whose words also start earlier
    goes: in a smaller doc_id, or earlier in the same document; judged on the input. Null text: no
    words. Null doc_ids come first. Rows with one doc_id and different texts count as documents in
    order of the text's hash; equal rows are one document, and each gets its result.
    """
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]

    def run(batches):
        for batch in batches:
            for a, b, raw, part, words, gone, own, start, end in _steps(batch, window):
                removed, shas = [], []
                for i in range(b - a):
                    flags = gone[own[i] : own[i + 1]]
                    if not flags.any():
                        kept = b" ".join(raw[part[i] : part[i + 1]].split())  # bytes.split cuts at the same six blanks
                    else:
                        kept = b" ".join(raw[x:y] for x, y in zip(start[own[i] : own[i + 1]][~flags].tolist(), end[own[i] : own[i + 1]][~flags].tolist()))
                    removed.append(int(flags.sum()))
                    shas.append(hashlib.sha256(kept).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(words)), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], names)

    return _with_spans(docs.select("doc_id", "text"), window).select("doc_id", "text", "_spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut(docs: DataFrame, window: int = WINDOW, text: str = "text", chars: str = "n_chars") -> DataFrame:
    """The rows and columns of `docs`, repeated words cut from `text` (see dedup).

    A removed run goes with the blanks behind it; what stands between kept words stays. A text that
    loses nothing is unchanged, null included; `chars`, if there, is the length of a changed text.
    """
    # the input's columns take names of their own, so that none clashes with those made here
    own_names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rest = [c for c in docs.columns if c not in ("doc_id", text)]
    plain = docs.select("doc_id", F.col(_quoted(text)).alias("text"), *[F.col(_quoted(c)).alias(own_names[c]) for c in rest])
    with_spans = _with_spans(plain, window)
    names = [c for c in with_spans.columns if c not in ("_rid", "_spans")]
    n_chars = own_names.get(chars)

    def run(batches):
        for batch in batches:
            for a, b, raw, part, _, gone, own, start, end in _steps(batch, window):
                rows = batch.slice(a, b - a)
                texts, sizes = rows.column(1).to_pylist(), rows.column(names.index(n_chars)).to_pylist() if n_chars else None
                for i in range(b - a):
                    flags = gone[own[i] : own[i + 1]]
                    if not flags.any():
                        continue
                    edge = np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))
                    s = np.append(start[own[i] : own[i + 1]], part[i + 1])
                    left, at = [], part[i]
                    for x, y in zip(s[np.flatnonzero(edge == 1)].tolist(), s[np.flatnonzero(edge == -1)].tolist()):
                        left.append(raw[at:x])
                        at = y
                    texts[i] = b"".join([*left, raw[at : part[i + 1]]]).decode()
                    if sizes is not None:
                        sizes[i] = len(texts[i])
                cols = [rows.column(0), pa.array(texts, rows.column(1).type), *(rows.column(k) for k in range(2, len(names)))]
                if sizes is not None:
                    cols[names.index(n_chars)] = pa.array(sizes, rows.column(names.index(n_chars)).type)
                yield pa.RecordBatch.from_arrays(cols, names)

    out = with_spans.select(*names, "_spans")
    schema = T.StructType([out.schema[n] for n in names])
    made = out.mapInArrow(run, schema)
    return made.select(*[F.col({"doc_id": "doc_id", text: "text"}.get(c, own_names[c])).alias(c) for c in docs.columns])


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def _with_spans(docs: DataFrame, window: int) -> DataFrame:
    """docs (doc_id, text, ...) with _rid and _spans."""
    scratch = common.Scratch(docs.sparkSession, "substring-dedup")
    common.small_batches(docs.sparkSession)
    keyed = common.with_row_key(docs, scratch)
    gram = min(GRAM, max(1, window // 2)) if window <= 254 else window - 254 + 1
    spans = repeats.spans_of(debruijn.repeated_paths(keyed.select("_rid", F.coalesce("text", F.lit("")).alias("text")), scratch, window, gram))
    none = F.array().cast("array<struct<first:int,count:int>>")
    return keyed.join(spans, "_rid", "left").withColumn("_spans", F.coalesce("_spans", none))


def _steps(batch: pa.RecordBatch, window: int):
    """Texts (column 1) in steps: rows, their bytes, and flags of removed words (last column)."""
    data, off = common.text_view(batch.column(1))
    for a, b in common.chunks(off):
        part = off[a : b + 1] - off[a]
        text = data[off[a] : off[b]]
        start, end, _, words = superkmers.word_symbols(text, part)
        gone, own = repeats.removed(batch.column(batch.num_columns - 1).slice(a, b - a), np.diff(words), window)
        yield a, b, text.tobytes(), part, words, gone, own, start, end
