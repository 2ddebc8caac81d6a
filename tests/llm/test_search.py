import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docketry.llm.polytope import nearest
from docketry.llm.queries import op4_cross_polytope
from docketry.llm.rotations import hadamard, rotate, signed_axes
from docketry.llm.topk import exact_top, top_k

SF = "/root/testdata/sf0.1"
ODD = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, []), (7, [0.5, 0.5]), (7, [0.5, 0.5]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [2.0, 0.1]), (100, [1.0, 0.2])]


def vectors():
    found = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet' ORDER BY vec_id").fetchnumpy()
    return found["vec_id"], np.stack(found["embedding"]).astype(float)


def test_rotations_keep_lengths_and_angles():
    x = np.random.default_rng(1).normal(size=(20, 24))
    y = rotate(x, 3, 9)
    assert y.shape == (20, 32) and np.allclose(y @ y.T, x @ x.T)
    assert np.allclose(hadamard(hadamard(y)), y)
    axes = signed_axes(np.array([[0.1, -3.0, 2.0, 0.0]]), 3)
    assert axes.tolist() == [[1 + 4, 2, 0]]


def test_recall(spark):
    ids, x = vectors()
    got: dict = {}
    for r in op4_cross_polytope(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = []
    for q in range(0, len(x), 100):
        distance = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        distance[q] = np.inf
        best = np.lexsort((ids, distance))[:10]
        found = sorted(got[q])
        assert [f[0] for f in found] == [*range(1, 11)]
        assert all(abs(distance[f[1]] - f[2]) < 1e-12 for f in found)
        hits += [ids[b] in {f[1] for f in found} for b in best]
    assert np.mean(hits) >= 0.95


def test_branch_and_bound_equals_a_full_scan():
    rng = np.random.default_rng(2)
    points, queries = (rng.integers(-40, 40, (n, 64)) * np.linspace(3, 0.1, 64) for n in (3000, 70))
    points, queries = points.astype("int64"), queries.astype("int64")
    ids, asked = np.arange(3000), np.arange(0, 70) * 10
    at, found, scores, read = exact_top(points, ids, queries, asked, 20)
    assert read < 1
    full = queries @ points.T
    full[np.arange(70), asked] = -(10**15)
    for q in range(70):
        best = np.lexsort((ids, -full[q]))[:20]
        assert found[at == q].tolist() == best.tolist() and scores[at == q].tolist() == full[q][best].tolist()
    large = points * 2**40
    assert exact_top(large, ids, queries, asked, 5)[2].tolist() == [s * 2**40 for s in exact_top(points, ids, queries, asked, 5)[2].tolist()]


def test_thresholds_are_carried_over_chunks():
    rng = np.random.default_rng(5)
    points = rng.integers(-60, 60, (9000, 24)).astype("int64")
    points[::3] //= 8
    queries, ids = rng.integers(-60, 60, (40, 24)).astype("int64"), np.arange(9000) // 2  # two points of each id
    at, found, scores, read = exact_top(points, ids, queries, np.arange(40), 7)
    assert read < 0.6
    full = np.maximum.reduceat(queries @ points.T, np.arange(0, 9000, 2), axis=1)
    full[np.arange(40), np.arange(40)] = -(10**15)
    for q in range(40):
        best = np.lexsort((np.arange(4500), -full[q]))[:7]
        assert found[at == q].tolist() == best.tolist() and scores[at == q].tolist() == full[q][best].tolist()


def test_given_vectors_are_pruned():
    ids, x = vectors()
    whole = np.floor(64 * x).astype("int64")
    assert exact_top(whole, ids, whole[::20], ids[::20], 20)[3] < 1


def test_odd_vectors(spark):
    rows = spark.createDataFrame(ODD, "vec_id bigint, embedding array<float>").withColumn("score", F.lit(0)).withColumn("rank", F.lit(0))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(rows, F.expr("vec_id % 20 = 0")).collect())
    assert [g[:3] for g in got if g[0] == 20] == [(20, 1, 100), (20, 2, 1), (20, 3, 7), (20, 4, 3)]
    assert [g[3] for g in got if g[0] == 20] == [128 * 64 + 6 * 12, 128 * 64, 128 * 32 + 6 * 32, 0]
    near = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in nearest(rows, F.expr("vec_id % 100 = 0"), probes=4).collect())
    assert [n[2] for n in near] == [1, 7, 20] and abs(near[0][3] - np.float32(0.2)) < 1e-12
    for f in (top_k, nearest):
        assert f(rows.limit(0), F.lit(True)).count() == 0
