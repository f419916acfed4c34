"""Large FeatureCollections in ranges of whole features, which tasks parse on their own.

Tasks count the marks of each block twice, as if it began outside a string and within one. Blocks put
together tell which is so, and how deep each begins. A feature belongs to the block that holds the
last comma before it; a range begins at a block's first such comma and ends at the next one's.
"""

from __future__ import annotations

import codecs
import json
import os
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage

#: Bytes of a block; files that aren't longer are parsed by one task each.
SPLIT = 4 << 20
_READ = 1 << 16
_PACKED = (".gz", ".bz2", ".deflate", ".lz4", ".lzo", ".snappy", ".xz", ".zst")
_STEPS = np.zeros(256, np.int8)
_STEPS[[*b"[{"]], _STEPS[[*b"]}"]] = 1, -1
_MARK = _STEPS != 0
_MARK[ord(",")] = True


class Range(NamedTuple):
    """Where features of a file are; `begin` and `end` are a block's. whole: the file is one range.
    first: the features begin at `begin`. last: they end within the block. cut: they don't end in
    the file. (deep, quoted) is the state at `begin`, (deep_after, quoted_after) that at `end`."""

    file: str
    begin: int = 0
    end: int = 0
    whole: bool = True
    first: bool = False
    last: bool = False
    cut: bool = False
    deep: int = 0
    quoted: bool = False
    deep_after: int = 0
    quoted_after: bool = False


def _quotes(data: np.ndarray, escaped: bool) -> tuple[np.ndarray, bool]:
    """Quotes that no backslash escapes, and whether the byte after the data is escaped."""
    quotes, back = np.flatnonzero(data == ord('"')), np.flatnonzero(data == ord("\\"))
    if not len(data):
        return quotes, escaped
    if escaped and not (len(back) and back[0] == 0):
        quotes = quotes[quotes > 0]
    if not len(back):
        return quotes, False
    apart = np.diff(back) > 1
    begins, ends = back[np.concatenate([[True], apart])], back[np.concatenate([apart, [True]])] + 1
    odd = (ends - begins + (escaped & (begins == 0))) % 2 == 1
    return quotes[~np.isin(quotes, ends[odd])], bool(odd[-1] and ends[-1] == len(data))


def _marks(data: np.ndarray, quotes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of brackets, braces and commas, and whether an odd number of quotes stands before each."""
    at = np.flatnonzero(_MARK[data])
    return at, np.searchsorted(quotes, at) % 2 == 1


def _escaped(source, at: int) -> bool:
    """Whether an odd number of backslashes stands just before a place."""
    n, step = 0, 64
    while at > 0:
        begin = max(0, at - step)
        source.seek(begin)
        got = source.read(at - begin)
        left = len(got.rstrip(b"\\"))
        n += len(got) - left
        if left:
            break
        at, step = begin, 2 * step
    return n % 2 == 1


def _count(data: np.ndarray, escaped: bool) -> tuple[bool, list[int]]:
    """Whether the data has an odd number of quotes, and how deep it goes by its end and at least, if
    it begins outside a string and if it begins within one."""
    quotes, _ = _quotes(data, escaped)
    at, within = _marks(data, quotes)
    steps, out = _STEPS[data[at]].astype(np.int64), []
    for inside in (False, True):
        deep = np.cumsum(steps[within == inside])
        out += [int(deep[-1]), min(0, int(deep.min()))] if len(deep) else [0, 0]
    return len(quotes) % 2 == 1, out


def _find(source, at: int, limit: int | None, deep: int, quoted: bool, commas: bool) -> tuple[int, bytes] | None:
    """The first place from `at` on, before `limit`, that ends the features or, if `commas`, parts two."""
    escaped, step = _escaped(source, at), _READ
    while limit is None or at < limit:
        source.seek(at)
        raw = source.read(step if limit is None else min(step, limit - at))
        if not raw:
            return None
        data = np.frombuffer(raw, np.uint8)
        quotes, escaped = _quotes(data, escaped)
        marks, within = _marks(data, quotes)
        marks = marks[within == quoted]
        after = deep + np.cumsum(_STEPS[data[marks]].astype(np.int64))
        found = np.flatnonzero((after < 2) | ((after == 2) & (data[marks] == ord(",")) & commas))
        if len(found):
            place = int(marks[found[0]])
            return at + place, raw[place : place + 1]
        deep, quoted, at, step = int(after[-1]) if len(after) else deep, quoted ^ (len(quotes) % 2 == 1), at + len(raw), min(2 * step, 1 << 20)
    return None


def _part(r: Range) -> tuple[bytes, bool]:
    """The bytes of a range's features, with commas, and whether a comma or a bracket follows."""
    where, at = storage.store(r.file)
    with where.open_input_file(at) as source:
        if r.whole:
            return source.read(), True
        begin = r.begin
        if not r.first:
            found = _find(source, begin, r.end, r.deep, r.quoted, True)
            if found is None or found[1] != b",":
                return b"", not r.cut
            begin = found[0]
        if r.last:
            found = _find(source, begin, None, 2, False, False)
        else:
            found = None if r.cut else _find(source, r.end, None, r.deep_after, r.quoted_after, True)
        source.seek(begin)
        return (source.read() if found is None else source.read(found[0] - begin)), found is not None and found[1] != b"}"


def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bool, bool]]:
    """(text, whole, ended) of each range: a whole file's, or that of features of a collection and
    whether they end as they should."""
    for batch in batches:
        for row in batch.to_pylist():
            raw, ended = _part(r := Range(**row))
            yield raw.decode(), r.whole, ended


def files(spark: SparkSession, path: str) -> list[tuple[str, int]] | None:
    """(file, bytes) of the files at `path`, the longest first as Spark's scans take them; None if none
    is longer than a block, or if only Spark can open or unpack them."""
    listing = spark.read.format("binaryFile").load(path).select("path", "length")
    if not listing.where(F.col("length") > SPLIT).limit(1).count():
        return None
    found = [(r.path[5:] if r.path.startswith("file:") else r.path, r.length) for r in listing.collect()]
    if any(os.path.splitext(f)[1] in _PACKED for f, _ in found):
        return None
    try:
        where, at = storage.store(found[0][0])
        known = where.get_file_info(at).size == found[0][1]
    except Exception:  # noqa: BLE001 - a store that Arrow has no driver or no credentials for
        return None
    return sorted(found, key=lambda f: -f[1]) if known else None


def _begin(raw: bytes, head: Callable[[str], int | None]) -> int:
    """Where in a file's first block its features begin; -1 if nowhere."""
    try:
        text = codecs.getincrementaldecoder("utf-8")().decode(raw)
    except UnicodeDecodeError:
        return -1
    place = head(text)
    return -1 if place is None else len(text[:place].encode())


def _block(file: str, at: int, size: int, head: Callable[[str], int | None]) -> tuple[int, bool, str]:
    """Where a block begins, without what stands before a collection's features, and its counts."""
    where, name = storage.store(file)
    with where.open_input_file(name) as source:
        source.seek(at)
        raw = source.read(size)
        begin = at or _begin(raw, head)
        if begin < 0:
            return begin, False, ""
        odd, counts = _count(np.frombuffer(raw, np.uint8)[begin - at :], at > 0 and _escaped(source, at))
    return begin, odd, json.dumps(counts)


def ranges(spark: SparkSession, found: list[tuple[str, int]], head: Callable[[str], int | None]) -> list[Range]:
    """All files in ranges. `head` gives the place in a text where a collection's features begin;
    files that have none within their first block are one range."""
    size = SPLIT
    blocks = [(i, f, at) for i, (f, n) in enumerate(found) if n > size for at in range(0, n, size)]

    def count(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i, file, at in zip(*(c.to_pylist() for c in batch.columns)):
                begin, odd, counts = _block(file, at, size, head)
                yield pa.RecordBatch.from_pylist([{"i": i, "at": at, "begin": begin, "odd": odd, "counts": counts}])

    rows = spark.createDataFrame(_spread(spark, blocks), "i long, file string, at long").mapInArrow(count, "i long, at long, begin long, odd boolean, counts string").collect()
    counted: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r.i, r.at)):
        counted.setdefault(r.i, []).append(r)
    return [r for i, (f, n) in enumerate(found) for r in (_file_ranges(f, n, size, counted[i]) if i in counted else [Range(f)])]


def _file_ranges(file: str, length: int, size: int, rows: list) -> list[Range]:
    if rows[0].begin < 0:
        return [Range(file)]
    out, deep, quoted, last = [], 2, False, False
    for r in rows:
        by, least = json.loads(r.counts)[2 * quoted : 2 * quoted + 2]
        last, after = deep + least < 2, (deep + by, quoted ^ r.odd)
        out.append(Range(file, r.begin, min(length, r.at + size), False, not r.at, last, False, deep, quoted, *after))
        if last:
            return out
        deep, quoted = after
    return [*out[:-1], out[-1]._replace(cut=True)]


def frame(spark: SparkSession, found: list[Range]) -> DataFrame:
    return spark.createDataFrame(_spread(spark, found), "file string, begin long, end long, whole boolean, first boolean, last boolean, cut boolean, deep long, quoted boolean, deep_after long, quoted_after boolean")


def _spread(spark: SparkSession, rows: list) -> RDD:
    """Rows in order, over at most 1000 tasks."""
    return spark.sparkContext.parallelize(rows, max(1, min(len(rows), 1000)))
