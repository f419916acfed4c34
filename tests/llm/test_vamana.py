import numpy as np
import pytest

from terravane.llm import queries, vamana


def brute(rows, every, k):
    rows = {i: np.array(v, float) for i, v in rows}
    out = {}
    for q, v in rows.items():
        if q % every == 0:
            ids = sorted((-vamana.cosines(w[None], v)[0], i) for i, w in rows.items() if i != q and len(w) == len(v))
            out[q] = [(i, -s) for s, i in ids[:k]]
    return out


def test_recall_on_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    got = {}
    for r in queries.op6_vamana(spark, "/root/testdata/sf0.1").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    want = brute(rows, 50, 5)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 5 * len(want)


def test_recall_on_a_larger_table(spark):
    """Clusters of different density in 24 dimensions, several shards of the usual size."""
    rng = np.random.default_rng(8)
    n = 20_000
    middle = rng.normal(size=(60, 24)) * 2
    v = (middle[rng.integers(0, 60, n)] + rng.normal(size=(n, 24)) * rng.choice([0.1, 0.5, 1.0], (n, 1))).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for r in vamana.nearest(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    unit = vamana._unit(v.astype(np.float64))
    near = unit[::50] @ unit.T
    near[np.arange(len(near)), np.arange(0, n, 50)] = -2
    want = np.argsort(-near, axis=1)[:, :5]
    assert sum(len(got[50 * i] & set(w.tolist())) for i, w in enumerate(want)) >= 0.95 * want.size


@pytest.mark.parametrize("shard_rows", [4000, 20])
def test_edges_of_the_input(spark, shard_rows):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)]
    rows += [(100 + i, [1.0] * 8) for i in range(40)]  # a third alike
    odd = [(200, None), (201, [0.0] * 8), (202, [float("nan")] * 8), (203, [None] * 8), (None, [1.0] * 8), (204, []), (206, [float("inf")] * 8)]
    short = [(205, [1.0, 2.0]), (300, [2.0, 1.0])]
    twice = rows[:3]
    df = spark.createDataFrame(rows + odd + short + twice, "vec_id long, embedding array<float>").selectExpr("*", "1 AS rank", "2 AS shard", "3 AS v")
    stated = [(r.vec_id, r.embedding) for r in spark.createDataFrame(rows + short, "vec_id long, embedding array<float>").collect()]
    got = {}
    for r in vamana.nearest(df, 5, shard_rows=shard_rows).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(stated, 5, 5)
    assert got.keys() == want.keys()
    assert [i for i, _ in got[100]] == [101, 102, 103, 104, 105] and got[205] == want[205]
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vamana.nearest(none).count() == 0
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert vamana.nearest(one).count() == 0
