"""What both substring operators need to find windows that also start earlier, over whole corpora.

Windows leave their texts in runs that share a minimizer (superkmers.py), as (anchor, context). Runs
whose anchor occurs once hold no repeat. Equal runs are joined to their first occurrence; what
else an anchor's windows share, each operator finds by its own method. An occurrence is (_rid,
first, count, lead_rid, lead_first): `count` windows from `first` on, equal to those of the lead.

Hashes only propose. Occurrences are put together to long spans, and each is compared with its lead
at their places in the texts by a cryptographic digest; should one differ, all is done anew with
other hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, superkmers
from .bpe import gather

#: Sets of hashes that are tried. A second is only ever needed if two of 128 bits collide.
SEEDS = 8


def sequence(data: np.ndarray, offsets: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bytes, or a symbol for each word, and each text's offsets in them."""
    if not words:
        return data, offsets
    _, _, symbols, off = superkmers.word_symbols(data, offsets)
    return symbols, off


def within_texts(got: superkmers.Runs) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Which runs are the first of their kind in their text; and the others, put together to stretches
    (text, first, count, back) that repeat what lies `back` places before, as lines stated many
    times do."""
    n = len(got.text)
    place = np.arange(n)
    order = np.lexsort((place, got.context, got.anchor, got.text))
    again = np.zeros(n, bool)
    again[1:] = np.all([v[order][1:] == v[order][:-1] for v in (got.text, got.anchor, got.context)], axis=0) if n else False
    later, earlier = order[again], order[np.flatnonzero(again) - 1]
    back = np.zeros(n, np.int64)
    back[later] = got.first[later] - got.first[earlier]
    at = np.flatnonzero(back)
    on = (at[1:] == at[:-1] + 1) & (got.text[at[1:]] == got.text[at[:-1]]) & (back[at[1:]] == back[at[:-1]])
    head = np.flatnonzero(np.append(True, ~on)) if len(at) else at
    ends = np.append(0, np.cumsum(got.count[at]))
    total = ends[np.append(head[1:], len(at))] - ends[head] if len(at) else at
    return back == 0, (got.text[at[head]], got.first[at[head]], total, back[at[head]])


def shared_runs(docs: DataFrame, scratch: common.Scratch, words: bool, window: int, gram: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(anchor, context, _rid, first, count) of the runs whose anchor occurs more than once, each kind
    once for each text; and the occurrences of those that stand earlier in their own text."""
    names = ["anchor", "context", "_rid", "first", "count", "back"]

    def run(batches):
        for batch in batches:
            data, offsets = common.text_view(batch.column(1))
            rid = np.asarray(batch.column(0))
            for a, b in common.chunks(offsets):
                part = offsets[a : b + 1]
                got = superkmers.runs(*sequence(data[part[0] : part[-1]], part - part[0], words), window, gram, seed)
                fresh, (text, first, count, back) = within_texts(got)
                none = np.zeros(len(text), np.int64)
                columns = zip((got.anchor, got.context, got.text, got.first, got.count, np.zeros(len(fresh), np.int64)), (none, none, text, first, count, back))
                anchor, context, of, first, count, back = (np.concatenate([x[fresh], y]) for x, y in columns)
                cols = anchor, context, rid[a:b][of], first.astype(np.int32), count.astype(np.int32), back.astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

    schema = "anchor long, context long, _rid long, first int, count int, back int"
    every = scratch.keep(docs.select("_rid", "text").mapInArrow(run, schema), f"runs-{seed}")
    own = every.where("back > 0").select("_rid", "first", "count", F.col("_rid").alias("lead_rid"), (F.col("first") - F.col("back")).alias("lead_first"))
    own = scratch.keep(own, f"own-{seed}")
    every = every.where("back = 0").drop("back")
    # written before it is joined: only between two plain exchanges can a hot key's rows be split
    shared = scratch.keep(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), f"shared-{seed}")
    runs = scratch.keep(every.join(shared, "anchor"), f"shared_runs-{seed}")
    scratch.drop(f"runs-{seed}", f"shared-{seed}")
    return runs, own


def joined_to_first(rows: DataFrame, key: list[str], scratch: common.Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """(key..., lead, n, count) of each different key, its lead being the first in order of (_rid,
    first), and the occurrences of all other rows. A key's rows meet in sums and in a join."""
    lead = F.min(F.struct("_rid", "first"))
    different = scratch.keep(rows.groupBy(*key).agg(lead.alias("lead"), F.count(F.lit(1)).alias("n"), F.max("count").alias("count")), f"{name}-leads")
    again = different.where("n > 1").select(*key, "lead")
    later = rows.join(again, key).where("NOT (_rid = lead._rid AND first = lead.first)")
    return different, later.select("_rid", "first", "count", F.col("lead._rid").alias("lead_rid"), F.col("lead.first").alias("lead_first"))


def asked(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(_rid, text, _wanted): texts with all rows of `wanted` (_rid, ...) for them. Those differ, so a
    text that many others share passages with has one for each different passage, not for each text."""
    lists = wanted.groupBy("_rid").agg(F.collect_list(F.struct(*[c for c in wanted.columns if c != "_rid"])).alias("_wanted"))
    return docs.select("_rid", "text").join(lists, "_rid")


def steps(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.StructArray]]:
    """Of rows (_rid, text, list): bytes, offsets, _rid, and the lists' items with their texts' numbers."""
    data, offsets = common.text_view(batch.column(1))
    lists = batch.column(2)
    begin = np.asarray(lists.offsets, np.int64)
    rids = np.asarray(batch.column(0))
    for a, b in common.chunks(offsets):
        part = offsets[a : b + 1]
        doc = np.repeat(np.arange(b - a), np.diff(begin[a : b + 1]))
        yield data[part[0] : part[-1]], part - part[0], rids[a:b], doc, lists.values.slice(begin[a], begin[b] - begin[a])


def window_hashes(found: DataFrame, words: bool, window: int, seed: int) -> DataFrame:
    """(h1, h2, _rid, first, count): each window by itself, by two independent hashes."""
    names = ["h1", "h2", "_rid", "first", "count"]

    def run(batches):
        for batch in batches:
            for text, part, rid, doc, items in steps(batch):
                symbols, off = sequence(text, part, words)
                first, count = (np.asarray(items.field(k), np.int64) for k in ("first", "count"))
                places = np.arange(len(symbols) + 1)
                at = gather(places, off[doc] + first, count)
                h1, h2 = (superkmers.textvec.hash_spans(symbols, at, at + window, s).view(np.int64) for s in (2 * seed, 2 * seed + 1))
                own = gather(places, first, count)
                cols = [pa.array(h1), pa.array(h2), pa.array(np.repeat(rid[doc], count)), pa.array(own.astype(np.int32)), pa.array(np.ones(len(at), np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names)

    return found.mapInArrow(run, "h1 long, h2 long, _rid long, first int, count int")


def compacted(occurrences: DataFrame) -> DataFrame:
    """Occurrences put together where one goes on behind another both in its text and in the lead's."""
    rows = occurrences.withColumn("shift", F.col("lead_first") - F.col("first"))
    line = Window.partitionBy("_rid", "lead_rid", "shift").orderBy("first")  # within one text
    end = F.max(F.col("first") + F.col("count")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("fresh", F.when(F.col("first") <= end, 0).otherwise(1))
    rows = rows.withColumn("span", F.sum("fresh").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    begin = F.min("first")
    spans = rows.groupBy("_rid", "lead_rid", "shift", "span").agg(begin.alias("first"), (F.max(F.col("first") + F.col("count")) - begin).cast("int").alias("count"))
    return spans.select("_rid", "first", "count", "lead_rid", (F.col("first") + F.col("shift")).cast("int").alias("lead_first"))


def _digests(found: DataFrame, words: bool, window: int) -> DataFrame:
    """(_rid, first, count, d1, d2): 128-bit digests of what so many windows cover."""
    names = ["_rid", "first", "count", "d1", "d2"]

    def run(batches):
        for batch in batches:
            for text, part, rid, doc, items in steps(batch):
                first, count = (np.asarray(items.field(k), np.int64) for k in ("first", "count"))
                if words:  # each word with a blank behind it
                    start, end, _, off = superkmers.word_symbols(text, part)
                    size = end - start
                    place = np.append(0, np.cumsum(size + 1))
                    spread = np.full(place[-1], 0x20, np.uint8)
                    spread[gather(np.arange(len(spread)), place[:-1], size)] = gather(text, start, size)
                    flat = spread.tobytes()
                else:
                    off, place, flat = part, np.arange(len(text) + 1), text.tobytes()
                x, y = place[off[doc] + first], place[off[doc] + first + count + window - 1]
                made = b"".join(hashlib.blake2b(flat[a:b], digest_size=16).digest() for a, b in zip(x.tolist(), y.tolist()))
                d = np.frombuffer(made, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(rid[doc]), items.field("first"), items.field("count"), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())], names)

    return found.mapInArrow(run, "_rid long, first int, count int, d1 long, d2 long")


def _all_equal(docs: DataFrame, spans: DataFrame, scratch: common.Scratch, words: bool, window: int, name: str) -> bool:
    """Does every span hold what its lead holds, in the texts themselves."""
    leads = spans.select(F.col("lead_rid").alias("_rid"), F.col("lead_first").alias("first"), "count")
    wanted = spans.select("_rid", "first", "count").unionByName(leads).distinct()
    digests = scratch.keep(_digests(asked(docs, wanted), words, window), name)
    lead = digests.select(F.col("_rid").alias("lead_rid"), F.col("first").alias("lead_first"), "count", F.col("d1").alias("e1"), F.col("d2").alias("e2"))
    both = spans.join(digests, ["_rid", "first", "count"]).join(lead, ["lead_rid", "lead_first", "count"])
    wrong = both.where("d1 <> e1 OR d2 <> e2").limit(1).count()
    scratch.drop(name)
    return not wrong


def repeated_spans(docs: DataFrame, scratch: common.Scratch, words: bool, window: int, find: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """(_rid, first, count, lead_rid, lead_first): long spans of windows that also start earlier, in
    order of (_rid, start), each verified. `docs` has _rid and text; find(docs, seed) gives the
    occurrences by hashes of that seed. Every such window is in a span."""
    docs = docs.select("_rid", "text")
    if docs.groupBy("_rid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        docs = docs.dropDuplicates(["_rid"])
    for seed in range(SEEDS):
        spans = scratch.keep(compacted(find(docs, seed)), f"spans-{seed}")
        if _all_equal(docs, spans, scratch, words, window, f"digests-{seed}"):
            return spans
    raise RuntimeError("hashes of every seed collide")


def spans_of(spans: DataFrame) -> DataFrame:
    """(_rid, _spans): each document's spans; as long as the document at most."""
    return spans.groupBy("_rid").agg(F.collect_list(F.struct("first", "count")).alias("_spans"))


def removed(spans: pa.ListArray, lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Flags of covered positions of all rows, flat, and the rows' offsets."""
    off = np.append(0, np.cumsum(lengths))
    begin = np.asarray(spans.offsets, np.int64)
    first, count = (np.asarray(spans.values.field(k), np.int64) for k in ("first", "count"))
    first, count = first[begin[0] : begin[-1]], count[begin[0] : begin[-1]]
    row = np.repeat(np.arange(len(lengths)), np.diff(begin))
    step = np.zeros(int(off[-1]) + 1, np.int64)
    np.add.at(step, off[row] + first, 1)
    np.add.at(step, off[row] + first + count + window - 1, -1)
    return np.cumsum(step[:-1]) > 0, off
