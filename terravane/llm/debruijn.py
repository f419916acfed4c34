"""Repeated windows of words by a compacted de Bruijn graph.

A window of k words is an edge between the nodes of its first and its last k - 1 words.

1. Edges leave a text as paths: neighbours that share a minimizer stay in one row (superkmers.py).
   Equal edges share it, so paths whose minimizer occurs once hold no repeated edge and go. Cycles,
   where a text goes through a path again, are taken out on the spot.
2. Where all paths through a minimizer are one, none of their nodes branches: the path is
   compact as it stands and is joined as a whole to its first occurrence, and so is every path of a
   branching minimizer that occurs again.
3. Of branching minimizers, one occurrence of each different path is cut to its edges, and each
   edge is joined to its own first occurrence.
4. Paths and edges that go on both in their text and in the first one's compact to long spans, which
   are verified at their source coordinates (repeats.py).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, repeats


def repeated_paths(docs: DataFrame, scratch: common.Scratch, window: int, gram: int) -> DataFrame:
    """Verified spans (_rid, first, count, lead_rid, lead_first) of edges that also start earlier."""

    def find(docs: DataFrame, seed: int) -> DataFrame:
        paths, cycles = repeats.shared_runs(docs, scratch, True, window, gram, seed)
        different, later = repeats.joined_to_first(paths, ["anchor", "context"], scratch, f"paths-{seed}")
        later = scratch.keep(later, f"later_paths-{seed}")
        scratch.drop(f"shared_runs-{seed}")
        branching = scratch.keep(different.groupBy("anchor").agg(F.count(F.lit(1)).alias("paths")).where("paths > 1").select("anchor"), f"branching-{seed}")
        at_branches = different.join(branching, "anchor").select("lead._rid", F.col("lead.first").alias("first"), "count")
        edges = scratch.keep(repeats.window_hashes(repeats.asked(docs, at_branches), True, window, seed), f"edges-{seed}")
        _, again = repeats.joined_to_first(edges, ["h1", "h2"], scratch, f"edges-{seed}")
        return later.unionByName(again).unionByName(cycles)

    return repeats.repeated_spans(docs, scratch, True, window, find)
