"""MinHash near-dedup [method: DartMinHash].

Darts fall with unit density on each element's (weight, rank) plane, at places that its hash
decides. A set's region is, for each of its elements, up to the element's weight and up to a rank
that leaves it about k ln k + 2k darts in all. Each dart belongs to one of k coordinates, which
keeps its earliest (least rank). Two sets agree in a coordinate with the probability of their
weighted Jaccard similarity.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, superkmers, textvec
from .bpe import gather

SHINGLE, SIMILARITY = 5, 0.8
#: A pair at similarity 0.8 meets in no band with probability (1 - 0.8**6)**40 = 5e-6.
BANDS, ROWS = 40, 6
#: Orders that bands pick their groups' centres by: a family of copies has about so many.
CENTRES = 8
_FRACTION = 24  # bits of a rank behind the point
_NONE = np.uint64(2**64 - 1)
#: One bit of each coordinate, in four words.
BITS = ["b0", "b1", "b2", "b3"]
assert BANDS * ROWS <= 256


def _poisson() -> np.ndarray:
    p, total, out = np.exp(-1.0), 0.0, []
    for i in range(1, 22):
        total += p
        out.append(int(total * 2**53))
        p /= i
    return np.array(out, np.uint64)


_COUNT = _poisson()


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct shingles by hash, ascending, how often each occurs, and offsets.

    A text of fewer words, but one at least, has one shingle of all of them."""
    _, _, symbols, off = superkmers.word_symbols(data, offsets)
    words = np.diff(off)
    count = np.where(words == 0, 0, np.maximum(words - size + 1, 1))
    start = gather(np.arange(len(symbols) + 1), off[:-1], count)
    text = np.repeat(np.arange(len(words)), count)
    hashes = textvec.hash_spans(symbols, start, np.minimum(start + size, off[1:][text]))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    head = np.append(True, (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])) if len(text) else np.zeros(0, bool)
    at = np.flatnonzero(head)
    often = np.diff(np.append(at, len(text)))
    return hashes[at], often, np.searchsorted(text[at], np.arange(len(words) + 1))


def signatures(hashes: np.ndarray, weights: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """(sets, k) values of the earliest darts; _NONE in every coordinate of a set without weight."""
    sets = len(offsets) - 1
    out = np.full(sets * k, _NONE)
    owner = np.repeat(np.arange(sets), np.diff(offsets))
    norm = np.bincount(owner, weights, sets)
    todo = np.flatnonzero(norm > 0)
    darts = k * (np.log(k) + 2)
    low, high = np.zeros(sets, np.int64), np.zeros(sets, np.int64)
    while len(todo):
        high[todo] = np.ceil(darts / norm[todo] * (1 << _FRACTION)).astype(np.int64)
        begin, end = offsets[todo], offsets[todo + 1]
        element = gather(np.arange(len(hashes)), begin, end - begin)
        # a step takes elements whose cells number about 150,000
        rank_cells = (high[owner[element]] - 1 >> _FRACTION) + 1
        cells = np.ceil(weights[element]).astype(np.int64) * rank_cells
        cuts = np.append(0, np.cumsum(cells))
        at = 0
        while at < len(element):
            to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + 150_000, "right")) - 1)
            _throw(hashes, weights, owner, element[at:to], cells[at:to], rank_cells[at:to], low, high, k, out)
            at = to
        open_ = (out.reshape(sets, k)[todo] == _NONE).any(axis=1)
        todo, darts = todo[open_], darts * 2
    return out.reshape(sets, k)


def _throw(hashes, weights, owner, element, cells, rank_cells, low, high, k, out) -> None:
    e = np.repeat(element, cells)
    nth = np.arange(len(e)) - np.repeat(np.cumsum(cells) - cells, cells)
    across = np.repeat(rank_cells, cells)
    floor, rank = nth // across, nth % across
    seed = textvec.mix(hashes[e] + textvec.mix((floor.astype(np.uint64) << np.uint64(32)) + rank.astype(np.uint64) + np.uint64(1)))
    luck = seed >> np.uint64(11)
    set_, limit = owner[e], high[owner[e]]
    whole = bool((weights[element] % 1 == 0).all())  # then every dart of a cell lies below the weight
    for j, least in enumerate(_COUNT):
        more = luck >= least
        if not more.any():
            break
        if not more.all():
            seed, luck, set_, limit, rank = seed[more], luck[more], set_[more], limit[more], rank[more]
            if not whole:
                e, floor = e[more], floor[more]
        dart = textvec.mix(seed + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        place = (rank.astype(np.uint64) << np.uint64(_FRACTION)) | (dart & np.uint64((1 << _FRACTION) - 1))
        inside = place.astype(np.int64) < limit
        other = textvec.mix(dart)
        if not whole:
            inside &= floor + (other >> np.uint64(40)).astype(np.float64) / 2**24 < weights[e]
        coordinate = ((other & np.uint64(0xFFFFFFFF)) * np.uint64(k)) >> np.uint64(32)
        slot = set_ * k + coordinate.astype(np.int64)
        value = (place << np.uint64(28)) | (dart >> np.uint64(36))
        np.minimum.at(out, slot[inside], value[inside])


def sketches(docs: DataFrame, counts: bool = True, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(_rid, doc_id, text_hash, size, d1, d2, bands, b0 to b3): the total weight of the shingles
    (their number, if not `counts`), a 128-bit digest of the word sequence, a hash for each band and
    a bit for each coordinate. A text without words has no bands, and its own key for a digest."""
    names = ["_rid", "doc_id", "text_hash", "size", "d1", "d2", "bands", *BITS]

    def run(batches):
        factors = textvec.mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            data, off = common.text_view(batch.column(3))
            for a, b in common.chunks(off):
                part = off[a : b + 1] - off[a]
                text = data[off[a] : off[b]]
                hashes, often, own = shingles(text, part)
                raw = text.tobytes()
                digests = b"".join(hashlib.blake2b(b" ".join(raw[x:y].split()), digest_size=16).digest() for x, y in zip(part[:-1], part[1:]))
                d = np.frombuffer(digests, np.int64).reshape(-1, 2).copy()
                some = np.diff(own) > 0
                d[~some] = np.stack([np.asarray(batch.column(0))[a:b][~some], np.full(int((~some).sum()), -1)], axis=1)
                weight = often.astype(float) if counts else np.ones(len(hashes))
                sig = signatures(hashes, weight, own, bands * rows).reshape(b - a, bands, rows)
                key = textvec.mix((textvec.mix(sig) * factors).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))
                size = np.diff(np.append(0, np.cumsum(often))[own]) if counts else np.diff(own)
                ends = np.append(0, np.cumsum(np.where(some, bands, 0)))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(key[some].reshape(-1).view(np.int64)))
                bits = np.zeros((b - a, 4 * 64), np.uint8)
                bits[:, : bands * rows] = (textvec.mix(sig) & np.uint64(1)).reshape(b - a, -1)
                words = np.packbits(bits, axis=1).view(np.int64)
                cols = [*(batch.column(k).slice(a, b - a) for k in range(3)), pa.array(size), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), lists, *(pa.array(words[:, i].copy()) for i in range(4))]
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select("_rid", "doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "_rid long, doc_id long, text_hash long, size long, d1 long, d2 long, bands array<long>, b0 long, b1 long, b2 long, b3 long")


def exact_shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `shingles`, but with numbers that are equal only where the words are, to the byte.

    Words and shingles are grouped by hash and each is compared with the first of its group; should
    one differ, all are numbered by sorting instead.
    """
    start, end, symbols, off = superkmers.word_symbols(data, offsets)
    _, first, word = np.unique(symbols, return_index=True, return_inverse=True)
    length = end - start
    lead = first[word]
    equal = length == length[lead]
    equal[equal] = textvec.same_spans(data, start[equal], data, start[lead[equal]], length[equal])
    if not equal.all():
        raw = data.tobytes()
        numbers: dict[bytes, int] = {}
        word = np.array([numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(start.tolist(), end.tolist())], np.int64)
    words = np.diff(off)
    count = np.where(words == 0, 0, np.maximum(words - size + 1, 1))
    at = gather(np.arange(len(word) + 1), off[:-1], count)
    text = np.repeat(np.arange(len(words)), count)
    stop = np.minimum(at + size, off[1:][text])
    padded = np.append(word + 1, np.zeros(size, np.int64))
    columns = [np.where(at + j < stop, padded[np.minimum(at + j, len(word))], 0) for j in range(size)]
    hashes = np.zeros(len(at), np.uint64)
    for column in columns:
        hashes = textvec.mix(hashes * np.uint64(3) + column.astype(np.uint64))
    _, first, shingle = np.unique(hashes, return_index=True, return_inverse=True)
    if any((c != c[first[shingle]]).any() for c in columns):
        shingle = np.unique(np.stack(columns, axis=1), axis=0, return_inverse=True)[1].reshape(-1)
    key = text * np.int64(max(len(hashes), 1)) + shingle
    each, often = np.unique(key, return_counts=True)
    return each % max(len(hashes), 1), often, np.searchsorted(each // max(len(hashes), 1), np.arange(len(words) + 1))


def similarity_of(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], counts: bool) -> float:
    """Jaccard similarity of two ascending item lists with counts."""
    if len(x[0]) > len(y[0]):
        x, y = y, x
    at = np.searchsorted(y[0], x[0])
    at[at == len(y[0])] = 0
    both = y[0][at] == x[0] if len(y[0]) else np.zeros(len(x[0]), bool)
    if not counts:
        shared = int(both.sum())
        return shared / max(1, len(x[0]) + len(y[0]) - shared)
    shared = int(np.minimum(x[1][both], y[1][at[both]]).sum())
    return shared / max(1, int(x[1].sum()) + int(y[1].sum()) - shared)


def _likely(similarity: float, coordinates: int):
    """Condition on two rows (..., size, bits; named with x or y before) that a similar pair meets.

    A pair at the similarity s differs in a coordinate's bit with probability (1 - s) / 2; pairs
    that differ in six deviations more than that are left out, as is a size ratio below s.
    """
    p = (1 - similarity) / 2
    most = int(coordinates * p + 6 * np.sqrt(coordinates * p * (1 - p)))
    apart = sum((F.bit_count(F.col(f"x{b}").bitwiseXOR(F.col(f"y{b}"))) for b in BITS[1:]), F.bit_count(F.col("xb0").bitwiseXOR(F.col("yb0"))))
    return (F.least("xsize", "ysize") >= F.greatest("xsize", "ysize") * F.lit(similarity - 1e-9)) & (apart <= most)


def _likely_pairs(pairs: DataFrame, sketch: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) that sizes and bits leave likely."""
    side = {s: sketch.select(F.col("_rid").alias(k), *[F.col(c).alias(f"{s}{c}") for c in ("size", *BITS)]) for s, k in (("x", "a"), ("y", "b"))}
    return pairs.join(side["x"], "a").join(side["y"], "b").where(_likely(similarity, BANDS * ROWS)).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, counts: bool, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose texts have the similarity, word for word."""

    def run(batches):
        for batch in batches:
            a, b = (np.asarray(batch.column(k)) for k in (0, 1))
            size = np.add(*(np.asarray(pa.compute.binary_length(batch.column(k)), np.int64) for k in (2, 3)))
            for i, j in common.chunks(np.append(0, np.cumsum(size))):
                # a text that stands in several of a step's pairs is split once
                ids, first = np.unique(np.concatenate([a[i:j], b[i:j]]), return_index=True)
                both = pa.concat_arrays([batch.column(k).slice(i, j - i) for k in (2, 3)]).take(pa.array(first))
                item, often, own = exact_shingles(*common.text_view(both))
                sets = [(item[p:q], often[p:q]) for p, q in zip(own[:-1], own[1:])]
                x, y = np.searchsorted(ids, a[i:j]), np.searchsorted(ids, b[i:j])
                close = pa.array([similarity_of(sets[p], sets[q], counts) >= least for p, q in zip(x, y)], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).filter(close), batch.column(1).slice(i, j - i).filter(close)], ["a", "b"])

    left = texts.select(F.col("_rid").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("_rid").alias("b"), F.col("text").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _items(rest: DataFrame, counts: bool) -> DataFrame:
    """(token, _rid, root, size) of each shingle of rows (_rid, root, size, text); of a shingle that
    a text holds n times, n tokens if `counts`."""
    names = ["token", "_rid", "root", "size"]

    def run(batches):
        for batch in batches:
            data, off = common.text_view(batch.column(3))
            for a, b in common.chunks(off):
                part = off[a : b + 1]
                hashes, often, own = shingles(data[part[0] : part[-1]], part - part[0])
                each = np.diff(own)
                if counts:
                    nth = np.arange(int(often.sum())) - np.repeat(np.cumsum(often) - often, often)
                    token = textvec.mix(np.repeat(hashes, often) + nth.astype(np.uint64))
                    each = np.diff(np.append(0, np.cumsum(often))[own])
                else:
                    token = hashes
                cols = [pa.array(token.view(np.int64)), *(pa.array(np.repeat(np.asarray(batch.column(k))[a:b], each)) for k in range(3))]
                yield pa.RecordBatch.from_arrays(cols, names)

    return rest.select("_rid", "root", "size", "text").mapInArrow(run, "token long, _rid long, root long, size long")


def _crossing(rest: DataFrame, similarity: float, counts: bool, scratch: common.Scratch) -> DataFrame:
    """Likely pairs (a, b) of rows (_rid, root, size, text, b0 to b3) with different roots, among them
    all that have the similarity: a prefix-filter join.

    A row's tokens stand in one global order: first those that no row of another root holds, which
    nobody can share with it, then from the rarest to the most frequent. Two rows with weights x and
    y are similar only if they share s (x + y) / (1 + s), so the first token they share stands so
    early that as much is left from there on in both. That leaves rare tokens to meet in; of a
    token's rows, those of its commonest root meet only the others.
    """
    items = scratch.keep(_items(rest, counts), "items")
    shared = items.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("token", "n")
    shared = scratch.keep(shared, "shared")
    own = Window.partitionBy("_rid")
    known = items.join(shared, "token").select("_rid", "root", "size", "token", "n")
    # tokens of a row, no more than its text is long
    before = F.col("size") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("n", "token")) - 1
    prefix = known.withColumn("before", before).where(F.col("before") <= F.col("size") * (1 - similarity) + 1e-6).select("token", "_rid", "root", "size", "before")
    prefix = scratch.keep(prefix, "prefix")
    scratch.drop("items", "shared")
    roots = prefix.groupBy("token", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("token").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("roots"))
    roots = scratch.keep(roots.where("roots > 1").select("token", "main"), "token_roots")
    bits = rest.select("_rid", *BITS)
    several = scratch.keep(prefix.join(roots, "token").join(bits, "_rid"), "several")
    own = ["_rid", "root", "size", "before", *BITS]
    x = several.where("root <> main").select("token", *[F.col(c).alias(f"x{c}") for c in own])
    y = several.select("token", "main", *[F.col(c).alias(f"y{c}") for c in own])
    left = F.least(F.col("xsize") - F.col("xbefore"), F.col("ysize") - F.col("ybefore"))
    enough = left >= (F.col("xsize") + F.col("ysize")) * F.lit(similarity / (1 + similarity)) - 1e-6
    once = (F.col("x_rid") < F.col("y_rid")) | (F.col("yroot") == F.col("main"))
    pairs = x.join(y, "token").where((F.col("xroot") != F.col("yroot")) & once & enough & _likely(similarity, BANDS * ROWS))
    return pairs.select(F.least("x_rid", "y_rid").alias("a"), F.greatest("x_rid", "y_rid").alias("b")).distinct()


def components(links: DataFrame, scratch: common.Scratch, name: str) -> DataFrame:
    """(node, root): each linked node's smallest connected node, by large and small stars.

    A star step sums each node's least neighbour and joins it back; nothing gathers a node's
    neighbours. Every round is written, so that lineage stays short.
    """
    edges = scratch.keep(links.where("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct(), f"{name}-0")
    step, before = 0, None
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written before it is joined, so that a hot node's edges can be split
        least = scratch.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-least-{step}")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        step += 1
        edges = scratch.keep(small.where("u <> v").distinct(), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, counts: bool = True) -> DataFrame:
    """(doc_id, text_hash, class_id, class_size, kept) of every row: classes linked by similar texts.

    Two texts are linked if the Jaccard similarity of their five-word shingles is at least
    `similarity`, each shingle weighing as often as it occurs (`counts`; else once). A class is all
    that links connect. text_hash is xxhash64 of the text (null: empty). class_id is its smallest
    doc_id (nulls first), and that row is kept. Words are [^\\x20\\x09-\\x0D]+, unchanged; fewer
    than five words are one shingle. A text without words, or null, is like no other and is kept.
    Rows with equal doc_id and text are one document stated again: the class counts each, and each
    says whether it is kept. An empty table gives no rows; other columns aren't read.

    Texts of equal words meet by digest, and one of each goes on. Candidates share a band. In each
    band's group all compare with one member, the first in one of eight orders by hash, so that a
    family of copies has about eight centres. Groups of two are then done. Rows of larger groups that still lie in
    several components are joined by rare shingles (see _crossing), which finds every pair that is
    left. Every link is checked on the words themselves.
    """
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "minhash")
    # rows that hold two whole texts are read a few at a time
    with common.settings(spark, {**common.small(500), "spark.sql.parquet.columnarReaderBatchSize": "256"}):
        keyed = common.with_row_key(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), scratch)
        sketch = scratch.keep(sketches(keyed, counts), "sketches")
        same = sketch.groupBy("d1", "d2").agg(F.min(F.struct("_rid", "doc_id")).alias("rep"), F.count(F.lit(1)).alias("n"))
        same = scratch.keep(same.select("d1", "d2", F.col("rep._rid").alias("rep"), F.col("rep.doc_id").alias("rep_doc"), "n"), "same")
        reps = sketch.where("size > 0").join(same.select(F.col("rep").alias("_rid")), "_rid", "left_semi").dropDuplicates(["_rid"])
        reps = scratch.keep(reps.select("_rid", "size", "bands", *BITS), "reps")
        dealt = reps.select(F.posexplode("bands").alias("band", "key"), "_rid", "size")
        centre = F.min_by(F.struct("_rid", "size"), F.xxhash64("_rid", F.col("band") % CENTRES))
        groups = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("m"), centre.alias("c")).where("m > 1")
        # written before it is joined, so that a hot band's rows can be split
        groups = scratch.keep(groups.select("key", "m", F.col("c._rid").alias("x"), F.col("c.size").alias("xsize")), "groups")
        near = (F.col("x") != F.col("_rid")) & (F.least("size", "xsize") >= F.greatest("size", "xsize") * F.lit(similarity - 1e-9))
        star = dealt.join(groups, "key").where(near).select(F.least("x", "_rid").alias("a"), F.greatest("x", "_rid").alias("b")).distinct()
        star = scratch.keep(star, "star")
        wide = scratch.keep(groups.where("m > 2").select("key"), "wide")
        met = star.select(F.col("a").alias("_rid")).union(star.select(F.col("b").alias("_rid"))).union(dealt.join(wide, "key", "left_semi").select("_rid"))
        texts = scratch.keep(keyed.join(met.distinct(), "_rid", "left_semi").dropDuplicates(["_rid"]), "texts")
        links = scratch.keep(_verified(_likely_pairs(star, reps, similarity), texts, counts, similarity), "links-1")
        roots = components(links, scratch, "roots-1")

        placed = reps.join(roots.withColumnRenamed("node", "_rid"), "_rid", "left").withColumn("root", F.coalesce("root", "_rid"))
        placed = scratch.keep(placed, "placed")
        members = placed.select(F.explode("bands").alias("key"), "_rid", "root")
        split = members.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("m > 2 AND r0 <> r1")
        split = scratch.keep(split.select("key"), "split")
        rest = scratch.keep(members.join(split, "key", "left_semi").select("_rid").distinct(), "rest")
        if not rest.isEmpty():
            whole = placed.drop("bands").join(rest, "_rid", "left_semi").join(texts, "_rid")
            tried = scratch.keep(_crossing(whole, similarity, counts, scratch), "crossing")
            new = scratch.keep(_verified(tried, texts, counts, similarity), "links-2")
            if not new.isEmpty():
                roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(new), scratch, "roots-2")
        scratch.drop("texts", "placed", "prefix", "several", "star", "groups", "wide")

        classes = same.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("_class", F.coalesce("root", "rep"))
        classes = scratch.keep(classes.select("d1", "d2", "rep", "rep_doc", "n", "_class"), "classes")
        sizes = classes.groupBy("_class").agg(F.sum("n").alias("class_size"), F.min_by("rep_doc", "rep").alias("class_id"))
        named = scratch.keep(classes.join(scratch.keep(sizes, "sizes"), "_class").select("d1", "d2", "_class", "class_size", "class_id"), "named")
        scratch.drop("classes", "sizes")
    return sketch.select("_rid", "doc_id", "text_hash", "d1", "d2").join(named, ["d1", "d2"]).select("doc_id", "text_hash", "class_id", "class_size", (F.col("_rid") == F.col("_class")).alias("kept"))
