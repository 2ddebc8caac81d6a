"""JSON documents cut into records in blocks of any size, against Python's json module."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.errors import PySparkException

from docketry.sources import elements, splits
from docketry.sources.load import read_json
from tests.test_splits import small_blocks  # noqa: F401

WRAPPERS = ("patents", "data", "results")
TEXTS = st.text(alphabet='a"\\{}[],: é\n', max_size=12)
VALUES = st.recursive(TEXTS | st.integers() | st.none(), lambda v: st.lists(v, max_size=3) | st.dictionaries(TEXTS, v, max_size=3), max_leaves=8)


def found(spark, path):
    """Records in order, each with its file."""
    stored = elements.records(spark, str(path), WRAPPERS).orderBy("source_file", "block_start", "row").collect()
    return [(r.source_file.rsplit("/", 1)[1], json.loads(r.value)) for r in stored]


def want(document):
    if isinstance(document, list):
        return document
    return next((document[w] for w in WRAPPERS if isinstance(document.get(w), list) and document[w]), [document])


@given(VALUES, st.booleans())
def test_depths(value, spaced):
    data = np.frombuffer(json.dumps(value, indent=1 if spaced else None, ensure_ascii=False).encode(), np.uint8)
    outside, deep = elements.depths(data, False, 0)
    assert deep[-1] == 0 and (len(deep) < 2 or not isinstance(value, list | dict) or (deep[:-1] > 0).all())
    inside, _ = elements.depths(data, True, 0)
    assert (inside == ~outside).all()


def made(rng):
    text = lambda: "".join(rng.choice(['a', '"', "\\", "{", "}", "[", "]", ",", "é", "\n", '\\"', "plain words "]) for _ in range(rng.randint(0, 30)))
    return rng.choice([
        lambda: {"patent_id": text(), "title": text(), "claims": [text(), text()]},
        lambda: {"patent_id": text(), "more": {"deep": [{}, {"x": [text()]}]}},
        lambda: {}, lambda: [], lambda: [[text()], {}], lambda: text(), lambda: 5, lambda: None,
    ])()


@pytest.mark.parametrize("seed", range(4))
def test_records_in_any_blocks(spark, tmp_path, small_blocks, seed):  # noqa: F811
    rng = random.Random(seed)
    many = lambda n: [made(rng) for _ in range(n)]
    documents = {
        "a.json": many(40),
        "b.json": {"first": many(3), "patents": [], "data": many(30), "results": many(5)},
        "c.json": {"patent_id": "one }{", "claims": many(20), "patents": 5, "data": {"patents": many(2)}},
        "d.json": [], "e.json": {}, "f.json": [{}], "g.json": {"results": [{"patent_id": "}"}], "data": [ ]},
        "h.json": [[], [[]]],
    }
    for name, document in documents.items():
        text = json.dumps(document, indent=rng.choice([None, 0, 2]), ensure_ascii=rng.random() < 0.5)
        (tmp_path / name).write_bytes((rng.choice(["", " \n"]) + text + rng.choice(["", "\n", "  \r\n "])).encode(rng.choice(["utf-8", "utf-8-sig"])))
    assert found(spark, tmp_path) == [(n, e) for n, d in documents.items() for e in want(d)]


@pytest.mark.parametrize("body", [
    "", "[1,]", "[1,,2]", "[,1]", "[1] 2", "[1][2]", "[{}", '[{"a": "x}', "{", '{"a": 1}}', '{"a": 1} {"b": 2}', "[1}", "{]", "5", '"[]"', "  ", "]", "[1]]",
    '{"data": [1, 2}', '{"data": [1], "x"}', '[{"a": 1} {"b": 2}]', '[1 2]', '{"a": 1}, {"b": 2}', '{"a": 1}][{"b": 2}', '{"data": [{}] "x": 1}',
])
def test_broken_documents_fail_the_job(spark, tmp_path, body):
    (tmp_path / "a.json").write_text(body)
    if not body:
        assert read_json(spark, str(tmp_path)).records.count() == 0
        return
    with pytest.raises(PySparkException):
        read_json(spark, str(tmp_path)).rejects.collect()


def test_one_line_in_many_tasks(spark, tmp_path, small_blocks):  # noqa: F811
    rows = [{"patent_id": f"P{i % 90}", "title": f"t{i}", "abstract": "}" * (i % 70)} for i in range(100)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    cut = elements.records(spark, str(tmp_path), WRAPPERS)
    assert cut.rdd.getNumPartitions() > 20
    records = read_json(spark, str(tmp_path)).records
    assert [r.title for r in records.orderBy("seq").collect()] == [r["title"] for r in rows]


def test_elements_of_any_kind(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"data": [null, 5, "x", [], {"patent_id": "P1", "title": "t"}, {}]}')
    records, rejects = read_json(spark, str(tmp_path))
    assert [r.patent_id for r in records.collect()] == ["P1"]
    assert sorted(r.reject_reason for r in rejects.collect()) == ["not an object"] * 4 + ["required:patent_id"]


def test_a_batch_is_taken_by_slices():
    n, size = 40, 100_000
    batch = pa.RecordBatch.from_pydict({
        "value": [b'{"a": "' + b"x" * size + b'"'] * n, splits.SOURCE: ["f"] * n, splits.START: pa.array([0] * n, pa.int64()),
    })
    found = list(splits.runs(iter([batch])))
    assert {name for name, _ in found} == {("f", 0)} and sum(len(x) for _, x in found) == n
    assert max(x.column("value").nbytes for _, x in found) < 2 << 20 and len(found) > 3
