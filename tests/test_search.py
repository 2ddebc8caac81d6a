import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from docketry import BatchEmbedder, ExactFilter, HashingEmbedder, RecordFilter
from docketry.functions import filters as P
from docketry.functions.vectors import cosine, cosine_to, words_of
from docketry.operators import search as S
from docketry.operators import stats
from docketry.operators.cells import build_cells, search_cells
from docketry.operators.changes import delete, latest, update, upsert
from docketry.operators.neighbours import all_neighbours, similar_all
from docketry.operators.weights import embed_tfidf


def points(spark, n=300, dim=8, seed=3, copies=0):
    """Random vectors; the first `copies` points are all the same one."""
    m = np.random.default_rng(seed).normal(size=(n, dim)).astype("float32")
    m[:copies] = m[0]
    rows = [(f"{i:04d}", f"D{i}", "f" + str(i % 3), m[i].tolist()) for i in range(n)]
    frame = spark.createDataFrame(rows, "point_id string, patent_id string, technology_field string, vector array<float>")
    return frame.repartition(5), m.astype("float64")


def exact(m, q, limit, min_score=0.0, able=None):
    scale = np.linalg.norm(m, axis=1) * np.linalg.norm(q)
    score = np.round(m @ q / np.where(scale > 0, scale, 1), 9)
    order = sorted(range(len(m)), key=lambda i: (-score[i], i))
    return [f"{i:04d}" for i in order if score[i] >= min_score and (able is None or able(i))][:limit]


def ids(frame):
    return [r.point_id for r in frame.orderBy("rank").collect()]


@pytest.mark.parametrize("copies", [0, 120])
def test_search_equals_brute_force(spark, copies):
    frame, m = points(spark, copies=copies)
    assert ids(S.search(frame, m[7], 40)) == exact(m, m[7], 40)
    found = S.search(frame, m[7], 10, where=F.col("technology_field") == "f1", min_score=0.2, query="x")
    assert ids(found) == exact(m, m[7], 10, 0.2, lambda i: i % 3 == 1)
    assert [r["rank"] for r in found.orderBy("rank").collect()] == list(range(1, found.count() + 1))


def test_scores(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [-1.0, 0.0]), (3, [1.0]), (4, None), (5, [1.0, None]), (6, [2.0, 2.0])]
    frame = spark.createDataFrame(rows, "i int, v array<float>").repartition(1).sortWithinPartitions("i")
    want = [1.0, 0.0, -1.0, None, None, None, round(0.5**0.5, 9)]
    assert [r.s for r in frame.select("i", cosine_to(F.col("v"), [1.0, 0.0]).alias("s")).orderBy("i").collect()] == want
    fixed = F.array(F.lit(1.0), F.lit(0.0))
    plain = [r.s for r in frame.filter("i <> 5").select("i", cosine(F.col("v"), fixed).alias("s")).orderBy("i").collect()]
    assert plain == [1.0, 0.0, -1.0, None, None, round(0.5**0.5, 9)]
    found = S.search(frame.withColumn("point_id", F.col("i").cast("string")).withColumnRenamed("v", "vector"), [1.0, 0.0])
    assert ids(found) == ["0", "6", "1"]  # the negative score is dropped at the default of 0


def test_similar(spark):
    frame, m = points(spark)
    found = S.similar(frame, "D5", 4, min_score=-1.0).orderBy("rank").collect()
    assert [r.point_id for r in found] == exact(m, m[5], 5, -1.0)[1:]
    assert [r["rank"] for r in found] == [2, 3, 4, 5]
    assert {r.reference_patent_id for r in found} == {"D5"}
    assert S.similar(frame, "nobody").count() == 0


@pytest.mark.parametrize("limit", [1, 7, 500])
def test_batch_equals_single(spark, limit):
    frame, m = points(spark, copies=100)
    asked = [(str(i), m[i].tolist(), None if i % 2 else "f2") for i in range(20)]
    queries = spark.createDataFrame(asked, "query_id string, vector array<float>, technology_field string")
    by_matrix = S.search_batch(frame, queries, limit)
    by_blocks = S.search_batch(frame, queries, limit, matrix_bytes=1)
    for found in (by_matrix, by_blocks):
        got = {}
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.point_id)
        for i, (q, _, field) in enumerate(asked):
            assert got[q] == exact(m, m[i], limit, 0.0, None if field is None else lambda j: j % 3 == 2)


@pytest.mark.parametrize("cells", [1, 6, 40])
def test_neighbours_of_all_equal_single_searches(spark, cells):
    """Tight groups, a zero vector, ties; many small matrices and parts. Pairs of cells are left out."""
    centres = np.random.default_rng(2).normal(size=(6, 8)) * 5
    m = np.vstack([c + np.random.default_rng(i).normal(size=(40, 8)) * 0.2 for i, c in enumerate(centres)]).astype("float32")
    m[0], m[7] = 0, m[9]
    rows = [(f"{i:04d}", f"D{i // 2}", m[i].tolist()) for i in range(len(m))] + [("none", "D0", None)]
    frame = spark.createDataFrame(rows, "point_id string, patent_id string, vector array<float>").repartition(3)
    found = all_neighbours(frame, 4, 0.1, cells=cells, matrix_bytes=8 * 8 * 7, part_bytes=8 * 8 * 15)
    got = {}
    for r in found.found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.point_id)
    for i in range(len(m)):
        assert got.get(f"{i:04d}", []) == exact(m.astype("float64"), m[i].astype("float64"), 4, 0.1), i
    assert 0 <= found.skipped <= found.pairs and found.skipped >= {1: 0, 6: 0.1, 40: 0.5}[cells] * found.pairs


def test_no_points_have_no_neighbours(spark):
    frame = spark.createDataFrame([("a", "D", None), ("b", "D", [])], "point_id string, patent_id string, vector array<float>")
    assert similar_all(frame).count() == 0


def test_batch_without_queries(spark):
    frame, _ = points(spark, n=5)
    assert S.search_batch(frame, spark.createDataFrame([], "query_id string, vector array<float>")).count() == 0


def test_cells(spark, tmp_path):
    centres = np.random.default_rng(1).normal(size=(6, 8)) * 5
    m = np.vstack([c + np.random.default_rng(i).normal(size=(50, 8)) * 0.2 for i, c in enumerate(centres)]).astype("float32")
    m[0] = 0
    rows = [(f"{i:04d}", f"D{i}", m[i].tolist()) for i in range(len(m))]
    frame = spark.createDataFrame(rows, "point_id string, patent_id string, vector array<float>").repartition(4)
    path = str(tmp_path / "cells")
    build_cells(frame, path, 6, 8)
    for q in (m[3], m[120], -m[60], m[0], np.ones(8)):
        whole = [tuple(r) for r in S.search(frame, q.tolist(), 20).select("point_id", "rank").orderBy("rank").collect()]
        found = search_cells(spark, path, q.tolist(), 20)
        assert [tuple(r) for r in found.select("point_id", "rank").orderBy("rank").collect()] == whole
    near = search_cells(spark, path, m[120].tolist(), 20)
    read = near._jdf.queryExecution().executedPlan().toString()
    assert "cell" in read.split("PartitionFilters:")[1][:200]
    # Points lie in tight groups, so one cell holds all of the nearest ones.
    recall = set(ids(search_cells(spark, path, m[120].tolist(), 20, nprobe=1))) & set(ids(near))
    assert len(recall) == 20


def test_hashing_embedder(spark):
    e = HashingEmbedder(16)
    texts = ["The cat, the CAT é", "", None, "x1 y_z"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.v for r in frame.select("i", e.column(F.col("t")).alias("v")).orderBy("i").collect()]
    assert got == e.encode([t or "" for t in texts]).tolist()
    assert [sum(v) for v in got] == [5.0, 0.0, 0.0, 3.0]


def test_batch_embedder(spark):
    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    e = BatchEmbedder(load, 2)
    frame = spark.createDataFrame([("ab",), (None,)], "t string")
    assert [r.v for r in frame.select(e.column(F.col("t")).alias("v")).collect()] == [[2.0, 1.0], [0.0, 1.0]]
    assert e.encode(["abc"]).tolist() == [[3.0, 1.0]]


def test_tfidf(spark):
    frame = spark.createDataFrame([("a", [2.0, 0.0, 1.0]), ("b", [1.0, 3.0, 0.0])], "k string, vector array<float>")
    got = {r.k: r.vector for r in embed_tfidf(frame).collect()}
    assert got["a"] == pytest.approx([0.0, 0.0, 1.0]) and got["b"] == pytest.approx([0.0, 1.0, 0.0])


RECORDS = [
    ("1", "Physics", ["Acme", "Beta"], ["Ann"], "US", "2020-05-01", ["G06N3/00"], "Granted"),
    ("2", "Metaphysics", ["Acme"], ["Bob"], "EP", "", ["G06F1/00", "H04L9/00"], "Pending"),
]


@pytest.mark.parametrize(
    ("predicate", "found"),
    [
        (ExactFilter(), "12"),
        (ExactFilter(technology_field="Physics"), "1"),
        (ExactFilter(technology_field="physics"), ""),
        (ExactFilter(assignees=["Acme", "Beta"]), "1"),
        (RecordFilter(assignees=["acme", "beta"]), "12"),
        (ExactFilter(countries=["US", "EP"]), ""),
        (RecordFilter(countries=["US", "EP"]), "12"),
        (ExactFilter(status=["Granted", "Pending"]), ""),
        (ExactFilter(date_range=("2020-05-01", "2020-05-01")), "1"),
        (ExactFilter(date_range=(None, None)), "12"),
        (RecordFilter(date_range=(None, "2030-01-01")), "1"),
        (ExactFilter(classification_codes=["H04L9/00", "G06F1/00"]), "2"),
        (RecordFilter(technology_fields=["PHYSICS"]), "12"),
        (RecordFilter(inventors=["AN", "x"]), "1"),
        (RecordFilter(classification_codes=["g06"]), ""),
        (RecordFilter(classification_codes=["04L"]), "2"),
        (RecordFilter(min_score=0.9), "12"),
    ],
)
def test_filters(spark, predicate, found):
    frame = spark.createDataFrame(
        RECORDS, "id string, technology_field string, assignees array<string>, inventors array<string>, country string, "
        "filing_date string, classification_codes array<string>, status string",
    )
    assert "".join(r.id for r in frame.filter(predicate.to_column()).orderBy("id").collect()) == found


def test_empty_filter():
    assert RecordFilter().is_empty() and not RecordFilter(min_score=0.1).is_empty()
    assert not RecordFilter(status=["x"]).is_empty()


def test_filed_before_and_after(spark):
    frame = spark.createDataFrame([("",), ("2020-01-01",)], "filing_date string")
    assert frame.filter(P.filed_after("2020-01-01")).count() == 1
    assert frame.filter(P.filed_before("2030-01-01")).count() == 1


def test_facets_of_a_heavy_key(spark):
    frame = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("technology_field"),
        F.lit("US").alias("country"),
        F.when(F.col("id") % 2 == 0, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array().cast("array<string>")).alias("assignees"),
        F.concat((F.col("id") % 13 + 2000).cast("string"), F.lit("-01-01")).alias("filing_date"),
    )
    got = {}
    for r in stats.facets(frame).collect():
        got.setdefault(r.facet, {})[r.key] = r["count"]
    assert got["technology_field"]["hot"] == 1000 and len(got["technology_field"]) == 10
    assert got["assignee"] == {"A": 1500}
    assert sorted(got["filing_year"]) == [str(y) for y in range(2003, 2013)]
    maps = {r.facet: r.counts for r in stats.facet_map(frame).collect()}
    assert maps["country"] == {"US": 3000}


def test_changes(spark):
    old = spark.createDataFrame([("p1", "A", "x"), ("p2", "A", "y"), ("p3", "B", "z")], "point_id string, patent_id string, v string")
    new = spark.createDataFrame([("p1", "A", "late", 2), ("p1", "A", "early", 1), ("p9", "C", "new", 3)], "point_id string, patent_id string, v string, seq long")

    def rows(f):
        return sorted((r.point_id, r.v) for r in f.collect())

    assert rows(upsert(old, new)) == [("p1", "late"), ("p2", "y"), ("p3", "z"), ("p9", "new")]
    assert rows(update(old, new)) == [("p1", "late"), ("p3", "z"), ("p9", "new")]
    gone = spark.createDataFrame([("A",)], "patent_id string")
    assert rows(delete(old, gone)) == [("p3", "z")]
    assert rows(delete(old, gone, first_only=True)) == [("p2", "y"), ("p3", "z")]


def test_heavy_key_is_folded_before_the_shuffle(spark):
    plan = latest(spark.range(10).selectExpr("id % 2 AS k", "id"), "k", [F.desc("id")])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange hashpartitioning") < plan.index("Partial")


def test_batch_of_mixed_sizes(spark):
    points_ = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0, 0.0])], "point_id string, vector array<float>")
    queries = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [1.0, 0.0, 0.0])], "query_id string, vector array<float>")
    assert sorted((r.query_id, r.point_id) for r in S.search_batch(points_, queries).collect()) == [("x", "a"), ("y", "b")]
    with pytest.raises(ValueError):
        S.search_batch(points_, spark.createDataFrame([("z", None)], queries.schema))


@pytest.mark.parametrize("floor", [-1.0, 0.0, 0.9])
def test_only_pairs_that_may_reach_the_floor_are_scored(monkeypatch, floor):
    rng = np.random.default_rng(1)
    m, q = rng.normal(size=(2000, 16)).astype("float32").astype("float64"), rng.normal(size=(30, 16))
    m[5], m[6], m[7:9] = 0, q[0].astype("float32"), m[9]
    names = [f"{i:04d}" for i in range(len(m))]
    scored = []
    of_all = S._Best._scores
    monkeypatch.setattr(S._Best, "_scores", lambda self, matrix, r, q: (scored.append(len(r)), of_all(self, matrix, r, q))[1])
    best = S._Best([str(i) for i in range(30)], q, [None] * 30, 4, np.full(30, floor))
    best.add(pa.array(names), pa.array(m.tolist(), pa.list_(pa.float32())), pa.nulls(len(m), pa.string()))
    got = {}
    for r in best.batch().to_pylist():
        got.setdefault(int(r["query_id"]), []).append(r["point_id"])
    assert all(got.get(i, []) == exact(m, q[i], 4, floor) for i in range(30))
    assert floor < 0.9 or sum(scored) < 100


def test_words_are_counted_by_slices(monkeypatch):
    texts, sizes, embedder = pa.array(["a b " * (1 << 20), None, "b " * (1 << 20), "c"]), [], HashingEmbedder(8)
    count = HashingEmbedder._count
    monkeypatch.setattr(HashingEmbedder, "_count", lambda self, some: (sizes.append(len(some)), count(self, some))[1])
    found = embedder._by_slices(texts)
    assert sizes == [2, 2] and (found == count(embedder, texts)).all() and found.dtype == "float32"


@pytest.mark.parametrize("part_bytes", [200, 64 << 20])
def test_only_hits_of_a_batch_are_shuffled(spark, monkeypatch, part_bytes):
    """In one pass, and with the root of 96 parts first; in three rounds."""
    monkeypatch.setattr(S, "ROUND_BYTES", 1000)
    frame, m = points(spark, copies=30)
    queries = spark.createDataFrame([(str(i), m[i].tolist()) for i in range(40)], "query_id string, vector array<float>")
    found = S.search_batch(frame, queries, 7, matrix_bytes=8 * 8 * 15, part_bytes=part_bytes)
    assert "matrix" not in found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.point_id)
    assert all(got[str(i)] == exact(m, m[i], 7) for i in range(40))


def test_no_block_of_neighbours_is_moved_to_others(spark):
    frame, _ = points(spark, n=200)
    found = all_neighbours(frame, 5, 0.1, cells=3, matrix_bytes=8 * 8 * 20).found
    assert "matrix" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.columns == ["query_id", "point_id", S.SCORE, "rank"]


def test_first_rows_give_floors():
    """Without a floor not every pair is scored."""
    rng, scored = np.random.default_rng(4), []
    m, q = rng.normal(size=(5000, 16)), rng.normal(size=(50, 16))
    best = S._Best([str(i) for i in range(50)], q, [None] * 50, 3, np.full(50, -1.0))
    of_all = best._scores
    best._scores = lambda matrix, r, q: (scored.append(len(r)), of_all(matrix, r, q))[1]
    m = m.astype("float32")
    best.add(pa.array([f"{i:04d}" for i in range(5000)]), pa.array(m.tolist(), pa.list_(pa.float32())), pa.nulls(5000, pa.string()))
    got = {}
    for r in best.batch().to_pylist():
        got.setdefault(int(r["query_id"]), []).append(r["point_id"])
    assert all(got[i] == exact(m.astype("float64"), q[i], 3, -1.0) for i in range(50))
    assert sum(scored) < 5000 * 50 / 10


def test_hits_seen_elsewhere_leave_less_room():
    """Of ties with a hit seen elsewhere the smallest ids are kept; a null id comes first."""
    m = np.array([[1.0, 0.0], [1.0, 0.1], [1.0, 0.1], [1.0, 0.1], [0.0, 1.0], [np.inf, 0.0]], "float32")
    tie = float(np.round(1 / np.hypot(1, np.float32(0.1).astype("float64")), 9))
    kept = {}
    for name, seen in {"none": [-np.inf] * 3, "one": [1.0, tie, -np.inf], "all": [1.0, 1.0, 1.0]}.items():
        best = S._Best(["q"], np.array([[1.0, 0.0]]), None, 3, np.full(1, -1.0), np.array([seen]))
        best.meet(pa.array(["z", "c", None, "b", "a", "x"]), m, None)
        kept[name] = [r["point_id"] for r in best.batch().to_pylist()]
    assert kept == {"none": ["z", None, "b"], "one": ["z", None], "all": ["z"]}


def test_vectors_of_points_are_computed_once(spark, monkeypatch):
    plans = {}
    of_all = S.saved
    monkeypatch.setattr(S, "saved", lambda frame, purpose: (plans.setdefault(purpose, frame._jdf.queryExecution().executedPlan().toString()), of_all(frame, purpose))[1])
    texts = spark.createDataFrame([("a", "x y"), ("b", "y z"), ("c", None)], "point_id string, text string")
    embedded = texts.withColumn("vector", HashingEmbedder(8).column(F.col("text")))
    found = S.search_batch(embedded, embedded.select(F.col("point_id").alias("query_id"), "vector"), 1)
    assert sorted(r.query_id for r in found.collect()) == ["a", "b", "c"]
    assert plans["points"].count("ArrowEvalPython") == 1


def test_words_are_found_on_bytes(monkeypatch):
    pool = [*map(chr, range(0x250)), "ß", "İ", "ก", "्", "中", "٣", "Ⅷ", "²", "\U0001d400", "\U0001f600", " ", "́"]
    rng = np.random.default_rng(0)
    texts = [None, "", "..", *("".join(rng.choice(pool, rng.integers(0, 40))) for _ in range(500)), "", "end"]
    split = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(pa.array(texts), "")), r"[^\p{L}\p{N}]+").to_pylist()
    want = [(i, w) for i, words in enumerate(split) for w in words if w]
    monkeypatch.setattr(pc, "split_pattern_regex", None)
    for start in (0, 1, 200):
        some = pa.array(texts).slice(start)
        row, words = words_of(pc.utf8_lower(pc.fill_null(some, "")))
        assert list(zip((row + start).tolist(), words.to_pylist())) == [x for x in want if x[0] >= start]
        assert (words_of(some.fill_null("").slice(1))[0] >= 0).all()
    count = HashingEmbedder(16)._count(pa.array(texts))
    assert count.sum() == len(want) and count.dtype == "float32"
    assert HashingEmbedder(4)._count(pa.array([], pa.string())).shape == (0, 4)
