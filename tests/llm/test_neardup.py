import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docketry.llm import neardup
from docketry.llm.components import components
from docketry.llm.queries import op5_chosen_path

SF = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """component id of each row, by all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    group = [*range(len(rows))]

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common) and sets[j]:
                group[find(i)] = find(j)
    least: dict = {}
    for i, (name, _) in enumerate(rows):
        least[find(i)] = min(name, least.get(find(i), name))
    return {(name, text): (len(sets[i]), least[find(i)]) for i, (name, text) in enumerate(rows)}


def check(spark, rows, found):
    want = brute(rows)
    texts = dict(rows)
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_shingles, r.component_id) == want[r.doc_id, texts[r.doc_id]], r
        assert r.kept == (r.doc_id == r.component_id)


def family(count, seed=4):
    """Copies of one text with few to many edits, most linked with few others only, and texts that share a passage."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(120)]
    passage = " ".join(f"p{i}" for i in range(60))
    rows = []
    for i in range(count):
        words = base.copy()
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(len(words))] = f"x{rng.random()}"
        rows.append((i, " ".join(words)))
    rows += [(count + i, passage + " " + " ".join(f"u{rng.random()}" for _ in range(80))) for i in range(count)]
    return rows


def test_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, docs, op5_chosen_path(spark, SF).collect())


@pytest.mark.parametrize("small", [512, 4])
def test_families(spark, monkeypatch, small):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 16)
    rows = family(60)
    check(spark, rows, neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())


def test_edges(spark):
    long = " ".join(f"l{i}" for i in range(50_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (5, "A  b"), (None, "a b"), (6, "a c"), (7, long), (8, long + " z"), (None, "q")]
    frame = spark.createDataFrame([(*r, 1, b"k") for r in rows], "doc_id bigint, text string, component_id int, key binary")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(frame).collect()), key=str)
    assert got == sorted([
        (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (5, 1, 4, False), (None, 1, 4, False),
        (6, 1, 6, True), (7, 49_996, 7, True), (8, 49_997, 7, False), (None, 1, None, True),
    ], key=str)
    assert neardup.near_duplicates(frame.limit(0)).count() == 0


def test_shingles_and_branches():
    (_, _, code, ends), = neardup.shingles(pa.array(["a b c d e f a b c d e", "", "x y"]))
    assert np.diff([0, *ends]).tolist() == [6, 0, 1]
    places = neardup._picked(np.arange(1, 500, dtype="uint64"))
    assert all(len({*row}) == neardup.BRANCHES for row in places.tolist()) and places.max() < neardup.PLACES


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (None, 3), (200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frame = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, frame, SF).collect(), docs.schema)
        assert after.columns == docs.columns
        assert after.join(frame, "doc_id", "left_anti").count() == 0
        assert 0.5 * frame.count() < after.count() <= frame.count()
        frame = after
    packed = corpus_pipeline.STAGES[-1][1](spark, frame, SF)
    assert packed.select("doc_id").distinct().count() == frame.count()
    whole = corpus_pipeline.run(spark, SF)
    assert whole.columns == packed.columns and whole.count() == packed.count()


def test_one_row_of_a_group_stays_whatever_its_ids(spark):
    words = [f"word{i}" for i in range(60)]
    near = [" ".join(words[:50 + k]) for k in range(4)]
    rows = [(5, near[0]), (5, near[1]), (None, near[2]), (None, near[3]), (5, near[0]), (5, "quite another text of its own"), (None, "and one more without an id"),
            (3, None), (3, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id bigint, text string, component_id string, ROW string").repartition(3)
    stay = corpus_pipeline.near_dedup(spark, docs, SF)
    assert stay.columns == docs.columns
    left = sorted(((r.doc_id, r.text) for r in stay.collect()), key=str)
    assert sum(t in near for _, t in left) == 1 and next(i for i, t in left if t in near) == 5
    assert sorted((x for x in left if x[1] not in near), key=str) == sorted((x for x in rows if x[1] not in near), key=str)
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), SF).count() == 0


def test_pipeline_on_odd_documents(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "the cat and the dog", "en", "s", 5), (2, "the cat and the dog", "en", "s", 5), (3, "!!", None, None, 2)]
    for frame in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        found = {name: stage(spark, frame, SF) for name, stage in corpus_pipeline.STAGES}
        counts = {name: f.count() for name, f in found.items()}
        if frame.isEmpty():
            assert set(counts.values()) == {0}
        else:
            assert counts["toxicity"] == 5 and counts["language"] == 2 and counts["near_dedup"] == 4
