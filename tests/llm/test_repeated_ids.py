import numpy as np
from pyspark.sql import functions as F

from docketry.llm.blocks import row_keys, spread_blocks
from docketry.llm.polytope import exact_nearest, nearest
from docketry.llm.topk import LEAST_BLOCKS, exact_top, top_k


def test_a_block_keeps_k_ids_not_k_rows():
    rng = np.random.default_rng(3)
    ids = np.concatenate([np.full(600, 5), np.arange(400)])
    points = np.concatenate([rng.integers(90, 100, (600, 32)), rng.integers(-50, 60, (400, 32))]).astype("int64")
    queries, asked = rng.integers(1, 50, (3, 32)).astype("int64"), np.array([5, 17, 1000])
    at, found, scores, _ = exact_top(points, ids, queries, asked, 10)
    near = exact_nearest(points.astype(float), ids, queries.astype(float), asked, 10)
    for q in range(3):
        product, distance = queries[q] @ points.T, np.sqrt(((points - queries[q]) ** 2).sum(axis=1))
        names = [n for n in range(400) if n != asked[q]]
        best = sorted((-product[ids == n].max(), n) for n in names)[:10]
        assert [(-s, n) for n, s in zip(found[at == q].tolist(), scores[at == q].tolist())] == best
        best = sorted((distance[ids == n].min(), n) for n in names)[:10]
        assert [*zip(near[2][near[0] == q].tolist(), near[1][near[0] == q].tolist())] == best


def test_other_ids_of_a_block_stay(spark):
    k = 3
    block = spread_blocks(row_keys(np.arange(2000), np.full((2000, 2), 640, "int64")), LEAST_BLOCKS)
    old = spread_blocks(np.arange(2000), LEAST_BLOCKS)
    hot = 1
    mates = [int(i) for i in np.flatnonzero((old == old[hot]) | (block == block[hot])) if i != hot][:6]
    rows = [(0, [1.0, 1.0])] + [(hot, [10.0 + i / 64, 10.0]) for i in range(k + 1)] * 2 + [(m, [9.0, 9.0 - i]) for i, m in enumerate(mates)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for f in (top_k, nearest):
        got = sorted((r["rank"], r.vec_id) for r in f(table, F.col("vec_id") == 0, k=k).collect())
        score = lambda v: -sum(v) if f is top_k else (v[0] - 1) ** 2 + (v[1] - 1) ** 2
        best = sorted({i: min(score(v) for j, v in rows if j == i) for i, _ in rows if i}.items(), key=lambda x: (x[1], x[0]))
        assert got[0][1] == best[0][0]
        assert [g[1] for g in got] == [b[0] for b in best[:k]] or f is nearest


def test_many_rows_of_an_id_spread():
    matrix = np.random.default_rng(4).integers(0, 99, (24_000, 8)).astype("int64")
    sizes = np.bincount(spread_blocks(row_keys(np.full(24_000, 7), matrix), 24), minlength=24)
    assert sizes.min() > 800 and sizes.max() < 1200
