"""Suffix-array dedup [method: threshold-bounded interval expansion on a Burrows-Wheeler transform].

Strings that share a minimizer meet in a block; there bwt.py sorts their suffixes and expands
intervals to the threshold. Strings that occur again as wholes are joined to their first occurrence
and stand in a block once (repeats.py). Before its suffixes are sorted, a string is cut to what it can
share with another one of its minimizer, and what is then the same as another is left out likewise.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bwt, common, repeats, superkmers, textvec
from .bpe import gather

WINDOW, GRAM = 100, 36
#: Different strings of one minimizer that a block takes together; those of a minimizer with more
#: can't be one task's work, and meet window by window in a sum and a join.
GROUP = 4096
#: Bytes in a block, about.
BLOCK = 700_000


def _bodies(found: DataFrame, window: int) -> DataFrame:
    """(anchor, _rid, first, body): strings at their source coordinates."""

    def run(batches):
        for batch in batches:
            for text, part, rid, doc, items in repeats.steps(batch):
                first, count = (np.asarray(items.field(k), np.int64) for k in ("first", "count"))
                size = count + window - 1
                flat = gather(text, part[doc] + first, size)
                body = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
                yield pa.RecordBatch.from_arrays([items.field("anchor"), pa.array(rid[doc]), items.field("first"), body], ["anchor", "_rid", "first", "body"])

    return found.mapInArrow(run, "anchor long, _rid long, first int, body binary")


def _longest_shared(words: np.ndarray, limit: np.ndarray, group: np.ndarray) -> np.ndarray:
    """How many bytes each row shares, from the first on, with another row of its group at most.

    words: a row's bytes from the first on, eight in a word, the first one highest; limit: how many
    bytes it has. Rows that share most are neighbours in order, as of equal words the shorter row
    comes first: so no row that only its end makes equal stands between two that share more.
    """
    valid = np.clip(limit - 8 * np.arange(len(words))[:, None], 0, 8)
    words = words & ~textvec._MASK[8 - valid]
    order = np.lexsort((limit, *words[::-1], group))
    out = np.zeros(len(limit), np.int64)
    same, shared = group[order[1:]] == group[order[:-1]], np.zeros(max(len(limit) - 1, 0), np.int64)
    live = same.copy()
    for row in words:
        differ = row[order[1:]] ^ row[order[:-1]]
        for bits in range(56, -8, -8):
            live &= differ >> np.uint64(bits) == 0
            shared += live
    shared = np.minimum(shared, np.minimum(limit[order[1:]], limit[order[:-1]])) * same
    out[order[1:]] = shared
    out[order[:-1]] = np.maximum(out[order[:-1]], shared)
    return out


def trimmed(anchor: np.ndarray, data: np.ndarray, off: np.ndarray, window: int, gram: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end, in `data`, of the part of each string that holds all windows it may share with
    another string of its anchor; shorter than a window if there are none.

    Equal windows have their anchor at one distance. So what two strings share around it bounds the
    windows that they share.
    """
    at = superkmers.anchors_at(anchor, data, off, window, gram, seed)
    left, right = at - off[:-1], off[1:] - at - gram
    padded = np.concatenate([np.zeros(8, np.uint8), data, np.zeros(8, np.uint8)])
    view = textvec.blocks(padded)
    far = int(max(left.max(initial=0), right.max(initial=0)))
    steps = np.arange(0, far, 8)[:, None]
    before = view[np.maximum(at - steps, 0)]  # of the eight bytes before a place the nearest is highest
    behind = view[np.minimum(at + gram + steps + 8, len(view) - 1)].byteswap()
    return at - _longest_shared(before, left, anchor), at + gram + _longest_shared(behind, right, anchor)


def _suffix_blocks(strings: DataFrame, window: int, gram: int, seed: int) -> DataFrame:
    """Occurrences (_rid, first, count, lead_rid, lead_first) of windows within a minimizer's strings."""

    def solve(parts: list[pa.RecordBatch]):
        table = pa.Table.from_batches(parts).combine_chunks()
        anchor, rid, first = (np.asarray(table.column(k).combine_chunks()) for k in (0, 1, 2))
        data, off = common.text_view(table.column(3))
        begin, end = trimmed(anchor, data, off, window, gram, seed)
        left = np.flatnonzero(end - begin >= window)
        anchor, rid, first, begin, size = anchor[left], rid[left], first[left] + begin[left] - off[left], begin[left], (end - begin)[left]
        # what is left of two strings may be the same: the earliest stands for all
        content = textvec.hash_spans(data, begin, begin + size, seed)
        order = np.lexsort((first, rid, content, anchor))
        head = np.append(True, (content[order][1:] != content[order][:-1]) | (anchor[order][1:] != anchor[order][:-1]))[: len(order)]
        lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
        again, of = order[~head], lead[~head]
        if len(again):
            cols = rid[again], first[again].astype(np.int32), (size[again] - window + 1).astype(np.int32), rid[of], first[of].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["_rid", "first", "count", "lead_rid", "lead_first"])
        different = np.sort(order[head])
        # one string that is left of its anchor shares nothing more
        _, own, strings = np.unique(anchor[different], return_inverse=True, return_counts=True)
        different = different[strings[own] > 1]
        if not len(different):
            return
        rid, first, size = rid[different], first[different], size[different]
        data, off = gather(data, begin[different], size), np.append(0, np.cumsum(size))
        starts, class_ = bwt.repeat_classes(data, off, window)
        string = np.searchsorted(off, starts, "right") - 1
        at = first[string] + starts - off[string]
        # equal windows have equal anchors, so classes need no anchor; the earliest member leads
        order = np.lexsort((at, rid[string], class_))
        head = np.append(True, class_[order][1:] != class_[order][:-1]) if len(order) else np.zeros(0, bool)
        lead = np.empty(len(order), np.int64)
        lead[order] = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))] if len(order) else order
        from_, to = rid[string][lead], at[lead]
        hit = np.flatnonzero((rid[string] != from_) | (at != to))
        if len(hit):
            on = (hit[1:] == hit[:-1] + 1) & (string[hit[1:]] == string[hit[:-1]]) & (from_[hit[1:]] == from_[hit[:-1]]) & (to[hit[1:]] == to[hit[:-1]] + 1)
            fresh = np.append(True, ~on)
            begin = hit[fresh]
            count = np.diff(np.append(np.flatnonzero(fresh), len(hit)))
            cols = rid[string[begin]], at[begin].astype(np.int32), count.astype(np.int32), from_[begin], to[begin].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["_rid", "first", "count", "lead_rid", "lead_first"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            # whole anchors only: what may still continue stays for the next block
            anchor = np.asarray(batch.column(0))
            cut = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])) if len(anchor) else []
            ends = common.text_view(batch.column(3))[1]
            at = 0
            for c in cut:
                joins = c == 0 and held and held[-1].column(0)[len(held[-1]) - 1].as_py() == anchor[0]
                if not joins and size + ends[c] - ends[at] >= BLOCK:
                    if c > at:
                        held.append(batch.slice(at, c - at))
                    yield from solve(held)
                    held, size, at = [], 0, c
            if at < len(anchor):
                held.append(batch.slice(at))
                size += int(ends[-1] - ends[at])
        if held:
            yield from solve(held)

    grouped = strings.select("anchor", "_rid", "first", "body").repartition("anchor").sortWithinPartitions("anchor")
    return grouped.mapInArrow(run, "_rid long, first int, count int, lead_rid long, lead_first int")


def repeated_strings(docs: DataFrame, scratch: common.Scratch, window: int, gram: int, group: int = GROUP) -> DataFrame:
    """Verified spans (_rid, first, count, lead_rid, lead_first) of `window`-byte strings that also
    start earlier."""

    def find(docs: DataFrame, seed: int) -> DataFrame:
        runs, own = repeats.shared_runs(docs, scratch, False, window, gram, seed)
        different, later = repeats.joined_to_first(runs, ["anchor", "context"], scratch, f"strings-{seed}")
        later = scratch.keep(later, f"later-{seed}")
        scratch.drop(f"shared_runs-{seed}")
        several = scratch.keep(different.groupBy("anchor").agg(F.count(F.lit(1)).alias("strings")).where("strings > 1"), f"several-{seed}")
        wanted = different.join(several, "anchor").select("anchor", "strings", "lead._rid", F.col("lead.first").alias("first"), "count")
        few = wanted.where(F.col("strings") <= group).select("_rid", "anchor", "first", "count")
        bodies = scratch.keep(_bodies(repeats.asked(docs, few), window), f"bodies-{seed}")
        out = later.unionByName(own).unionByName(_suffix_blocks(bodies, window, gram, seed))
        if not several.where(F.col("strings") > group).isEmpty():
            many = wanted.where(F.col("strings") > group).select("_rid", "first", "count")
            windows = scratch.keep(repeats.window_hashes(repeats.asked(docs, many), False, window, seed), f"windows-{seed}")
            out = out.unionByName(repeats.joined_to_first(windows, ["h1", "h2"], scratch, f"windows-{seed}")[1])
        return out

    return repeats.repeated_spans(docs, scratch, False, window, find)


def dedup(docs: DataFrame, window: int = WINDOW, keep_bytes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of each row.

    Each byte covered by a `window`-byte string that also starts earlier goes: in a smaller doc_id,
    or earlier in the same document. Strings lie within one document and are judged on the input.
    Null text: empty. Null doc_ids come first. Rows with one doc_id and different texts count as
    documents in order of the text's hash; equal rows are one document, and each gets its result.
    """
    scratch = common.Scratch(docs.sparkSession, "suffix-dedup")
    common.small_batches(docs.sparkSession)
    keyed = common.with_row_key(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), scratch)
    gram = min(GRAM, max(1, window // 2)) if window <= 254 else window - 254 + 1
    spans = repeats.spans_of(repeated_strings(keyed, scratch, window, gram))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_bytes

    def run(batches):
        for batch in batches:
            data, off = common.text_view(batch.column(1))
            for a, b in common.chunks(off):
                part = off[a : b + 1]
                gone, own = repeats.removed(batch.column(2).slice(a, b - a), np.diff(part), window)
                text = data[part[0] : part[-1]]
                cols: list[list] = [[], [], [], []]
                for i in range(b - a):
                    flags = gone[own[i] : own[i + 1]]
                    kept = text[own[i] : own[i + 1]][~flags].tobytes()
                    begins = int(np.count_nonzero(flags[1:] & ~flags[:-1])) + int(len(flags) and flags[0])
                    for c, v in zip(cols, (int(flags.sum()), begins, hashlib.sha256(kept).hexdigest(), kept)):
                        c.append(v)
                out = [batch.column(0).slice(a, b - a), pa.array(np.diff(part)), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())]
                yield pa.RecordBatch.from_arrays(out + [pa.array(cols[3], pa.binary())] * keep_bytes, names)

    none = F.array().cast("array<struct<first:int,count:int>>")
    joined = keyed.join(spans, "_rid", "left").select("doc_id", "text", F.coalesce("_spans", none).alias("_spans"))
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes)
