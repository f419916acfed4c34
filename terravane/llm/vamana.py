"""Approximate nearest neighbours [method: robust-pruned directed graph].

Distinct unit vectors are dealt by hash to shards of bounded size. In each, points enter a graph in
batches: a greedy search from the middle proposes neighbours, pruning with relaxed distance keeps
diverse edges, and edges go both ways under a degree bound. Queries travel in blocks to every shard,
which stays where it is, and search it with a beam; what they reach is scored anew on the original
vectors in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

DEGREE, BEAM, RELAX = 32, 64, 1.2
SEARCH_BEAM = 160
SHARD_ROWS, BLOCK_ROWS = 8000, 1000
#: Blocks of queries that one task takes to a shard; more queries make more tasks, each with its copy.
TASK_BLOCKS = 64


class Graph:
    """A directed graph over rows of unit vectors; -1 fills unused edges."""

    def __init__(self, points: np.ndarray, edges: np.ndarray | None = None, entry: int = 0):
        self.points = np.asarray(points, np.float32)
        n = len(points)
        self.edges = np.full((n, DEGREE), -1, np.int32) if edges is None else edges
        self.entry = entry

    @classmethod
    def build(cls, points: np.ndarray, rounds: int = 2) -> Graph:
        """Inserts all points, twice: the second time edges are chosen in a complete graph."""
        graph = cls(points)
        n = len(points)
        if n == 0:
            return graph
        middle = graph.points.mean(axis=0)
        graph.entry = int(np.argmax(graph.points @ middle))
        order = np.random.default_rng(n).permutation(n)
        order = np.concatenate([[graph.entry], order[order != graph.entry]])
        for turn in range(rounds):
            at, step = (1, 1) if turn == 0 else (0, 256)
            while at < n:
                graph._insert(order[at : at + step], RELAX if turn == rounds - 1 else 1.0)
                at += step
                step = min(256, max(step, at))
        return graph

    def _insert(self, batch: np.ndarray, relax: float) -> None:
        near, _ = self.search(self.points[batch], BEAM)
        self.edges[batch] = self._prune(batch, np.concatenate([near, self.edges[batch]], axis=1), relax)
        source = np.repeat(batch, DEGREE)
        target = self.edges[batch].reshape(-1)
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        # nodes with many new edges take them in several steps of the same width
        nth = np.arange(len(target)) - np.repeat(first, count)
        for lap in range(int(nth.max(initial=-1)) // DEGREE + 1):
            now = nth // DEGREE == lap
            rows = np.searchsorted(nodes, target[now])
            own = np.unique(rows)
            wide = np.full((len(own), 2 * DEGREE), -1, np.int32)
            wide[:, :DEGREE] = self.edges[nodes[own]]
            wide[np.searchsorted(own, rows), DEGREE + nth[now] % DEGREE] = source[now]
            self.edges[nodes[own]] = self._prune(nodes[own], wide, relax)

    def _prune(self, of: np.ndarray, candidates: np.ndarray, relax: float) -> np.ndarray:
        """Keeps the nearest, drops what it is nearer to than `of` is (times relax), and so on."""
        out = np.full((len(of), DEGREE), -1, np.int32)
        for at in range(0, len(of), 128):
            p, c = of[at : at + 128], np.sort(candidates[at : at + 128], axis=1)
            alive = (c >= 0) & (c != p[:, None])
            alive[:, 1:] &= c[:, 1:] != c[:, :-1]
            x = self.points[c]
            apart = np.where(alive, 2 - 2 * np.einsum("bcd,bd->bc", x, self.points[p]), np.inf)
            order = np.argsort(apart, axis=1, kind="stable")
            c, x, apart = (np.take_along_axis(v, order if v.ndim == 2 else order[:, :, None], 1) for v in (c, x, apart))
            alive = np.isfinite(apart)
            between = 2 - 2 * (x @ x.transpose(0, 2, 1))
            rows = np.arange(len(p))
            for k in range(DEGREE):
                pick = alive.argmax(axis=1)
                some = alive[rows, pick]
                if not some.any():
                    break
                out[at + rows[some], k] = c[rows[some], pick[some]]
                alive &= relax * between[rows, pick] > apart
                alive[rows, pick] = False
        return out

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, distances) of the `beam` nearest points reached, nearest first; -1 and inf fill."""
        n, q = len(self.points), len(queries)
        queries = np.asarray(queries, np.float32)
        ids = np.full((q, beam), -1, np.int32)
        apart = np.full((q, beam), np.inf, np.float32)
        if not n or not q:
            return ids, apart
        seen = np.zeros((q, n), bool)
        seen[:, self.entry] = True
        ids[:, 0], apart[:, 0] = self.entry, 2 - 2 * (queries @ self.points[self.entry])
        open_ = np.zeros((q, beam), bool)
        open_[:, 0] = True
        live = np.arange(q)
        while len(live):
            # each query takes its two nearest unexpanded points
            o = open_[live]
            first = o.argmax(axis=1)
            rows = np.arange(len(live))
            o[rows, first] = False
            second = o.argmax(axis=1)
            two = o[rows, second]
            o[rows, second] = False
            open_[live] = o
            new = np.concatenate([self.edges[ids[live, first]], np.where(two[:, None], self.edges[ids[live, second]], -1)], axis=1)
            fresh = (new >= 0) & ~seen[live[:, None], np.maximum(new, 0)]
            seen[np.repeat(live, new.shape[1])[fresh.reshape(-1)], new[fresh]] = True
            new = np.sort(np.where(fresh, new, -1), axis=1)
            fresh = new >= 0
            fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
            far = np.full(new.shape, np.inf, np.float32)
            row = np.repeat(rows, new.shape[1])[fresh.reshape(-1)]
            far[fresh] = 2 - 2 * np.einsum("nd,nd->n", self.points[new[fresh]], queries[live[row]])
            all_ids = np.concatenate([ids[live], new], axis=1)
            all_apart = np.concatenate([apart[live], far], axis=1)
            all_open = np.concatenate([open_[live], fresh], axis=1)
            best = np.argsort(all_apart, axis=1, kind="stable")[:, :beam]
            ids[live], apart[live] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_apart, best, 1)
            open_[live] = np.take_along_axis(all_open, best, 1) & np.isfinite(apart[live])
            live = live[open_[live].any(axis=1)]
        ids[~np.isfinite(apart)] = -1
        return ids, apart


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v array<double>): rows with a key whose vector has a component other than 0, and none
    that is null or not finite. A key stated more than once stands once, with its least vector."""
    inf = F.lit(float("inf"))
    v = F.col("v")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < inf)) & F.exists(v, lambda x: x != 0))
    if rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    return rows


def index(rows: DataFrame, k: int, scratch: common.Scratch, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row for each shard: (dim, shard, n, vectors binary, ids array<array<long>>, edges binary,
    entry). `rows` (id, v) are as `usable` gives them: no nulls, no zero vectors. Of rows with one
    vector the k + 1 smallest ids are kept, as more can't be among a query's k nearest; all other rows
    are indexed whole. No rows, no shards. A task builds a shard."""
    least = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    distinct = rows.withColumn("_r", least).where(F.col("_r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    distinct = scratch.keep(distinct.withColumn("dim", F.size("v")), "vectors")
    n = distinct.count()
    shards = max(1, -(-n // shard_rows))
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))
    schema = "dim int, shard int, n int, vectors binary, ids array<array<long>>, edges binary, entry int"

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dim, shard = (x.as_py() for x in key)
        flat = np.asarray(table.column("v").combine_chunks().flatten(), np.float64).reshape(-1, dim)
        graph = Graph.build(_unit(flat))
        ids = table.column("ids").to_pylist()
        cols = [pa.array([dim], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(flat)], pa.int32()), pa.array([flat.tobytes()], pa.binary()), pa.array([ids], pa.list_(pa.list_(pa.int64()))), pa.array([graph.edges.tobytes()], pa.binary()), pa.array([graph.entry], pa.int32())]
        return pa.Table.from_arrays(cols, names=["dim", "shard", "n", "vectors", "ids", "edges", "entry"])

    # a stated number of partitions, which isn't coalesced: few tasks get two shards
    spread = dealt.repartition(2 * shards, "dim", "shard")
    return scratch.keep(spread.groupBy("dim", "shard").applyInArrow(build, schema), "index")


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares stay in range
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def search(indexed: DataFrame, queries: DataFrame, k: int, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, a query's own id left out.

    Queries (id, v), as `usable` gives them, lie in blocks by hash of their id; every block goes to
    every shard of its dimension. Queries are the small side: shards move once. No queries or no
    shards give no rows.
    """
    n, shards = queries.count(), (indexed.agg(F.max("shard").alias("s")).first().s or 0) + 1
    blocks = max(1, -(-n // BLOCK_ROWS))
    copies = -(-blocks // TASK_BLOCKS)
    packed = queries.withColumn("dim", F.size("v")).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    packed = packed.groupBy("dim", "block").agg(F.collect_list(F.struct("id", "v")).alias("queries"))  # about BLOCK_ROWS
    sent = packed.withColumn("copy", F.col("block") % copies).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    held = indexed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    at, tasks = ["dim", "shard", "copy"], 2 * shards * copies
    meets = held.repartition(tasks, *at).hint("merge").join(sent.repartition(tasks, *at), at)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                dim, own = row["dim"], row["ids"]
                vectors = np.frombuffer(row["vectors"]).reshape(-1, dim)
                graph = Graph(_unit(vectors), np.frombuffer(row["edges"], np.int32).reshape(-1, DEGREE), row["entry"])
                asked = np.array([q["v"] for q in row["queries"]], np.float64)
                near, _ = graph.search(_unit(asked), max(beam, k + 1))
                out: list[tuple] = []
                for q, v, reached in zip(row["queries"], asked, near):
                    reached = reached[reached >= 0]
                    score = cosines(vectors[reached], v)
                    best = sorted((-s, i) for at, s in zip(reached, score) for i in own[at] if i != q["id"])[:k]
                    out += [(q["id"], i, -s) for s, i in best]
                cols = list(zip(*out)) if out else [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    common.small_batches(queries.sparkSession)
    found = meets.select("dim", "vectors", "ids", "edges", "entry", "queries").mapInArrow(run, "query_id long, vec_id long, score double")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosine of each row with the query, in double precision and one order of summation."""
    a = vectors / np.abs(vectors).max(axis=1, keepdims=True, initial=1e-300)
    b = query / np.abs(query).max()
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum()))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, key: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose key is divisible by `every`, the k nearest of
    all other rows found, by cosine, nearest first, ties to the smaller key; all others if fewer.

    Vectors that are null, zero or hold a null or a number that isn't finite take no part, nor do
    rows without a key. Vectors of different lengths don't compare. A key stated more than once
    stands once. An empty table gives no rows.
    """
    scratch = common.Scratch(vectors.sparkSession, "vamana")
    rows = usable(vectors, key, vector)
    indexed = index(rows, k, scratch, shard_rows)
    return search(indexed, rows.where(F.col("id") % every == 0), k)
