"""CSV files cut at any line, against Python's csv module."""

import csv
import io
import random

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from docketry.sources import splits
from docketry.sources.load import read_csv, read_directory
from docketry.sources.scan import csv_scans
from docketry.sources.splits import ends_inside


@pytest.fixture
def small_blocks(spark):
    """Files are cut every 100 bytes."""
    conf = {"spark.sql.files.maxPartitionBytes": "100", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@given(st.lists(st.text(alphabet='a",\n', max_size=6), min_size=1, max_size=5))
def test_lines_of_written_cells(cells):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerow(cells)
    inside = False
    lines = out.getvalue().removesuffix("\n").split("\n")
    for at, line in enumerate(lines):
        inside = ends_inside(line, inside)
        assert inside == (at < len(lines) - 1)


def test_a_quote_within_an_unquoted_cell_opens_nothing():
    assert not ends_inside('5" pipe,x', False) and ends_inside('5" pipe,"x', False)
    assert not ends_inside('x,"a""b",', False) and ends_inside('"a"",b', False) and not ends_inside('b",c', True)


def made_rows(n, seed):
    rng = random.Random(seed)
    cell = lambda: rng.choice(["", "plain", 'say ""', "two\nlines", "a\n\n\n,b", '"', "\n", "é" * 30, "x\n" * rng.randint(1, 60), 'in" side'])
    return [[f"P{i}", f"t{i} " + cell(), cell(), cell()] for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_rows_in_any_blocks(spark, tmp_path, small_blocks, seed):
    rows = made_rows(150, seed)
    for name, part in (("b.csv", rows[:70]), ("a.csv", rows[70:])):
        with open(tmp_path / name, "w", newline="") as f:
            writer = csv.writer(f, lineterminator="\n")
            writer.writerows([["patent_id", "title", "abstract", "description"], *part])
    found = csv_scans(spark, str(tmp_path))
    assert len(found) == 1 and found[0].rdd.getNumPartitions() > 4
    got = [list(r)[:4] for r in found[0].orderBy("seq").collect()]
    assert got == rows[70:] + rows[:70]
    assert {r.reject_reason for r in found[0].collect()} == {None}


def test_odd_files(spark, tmp_path, small_blocks):
    head = "patent_id,title\n"
    (tmp_path / "a.csv").write_text("﻿patent_id,title\r\nP1,\"x\ny\"\r\n\r\nP2,z\r\n")
    (tmp_path / "b.csv").write_text(head + "P3,\"never closed " + "w\n" * 300)
    (tmp_path / "c.csv").write_text(head)
    (tmp_path / "d.csv").write_text("")
    (tmp_path / "e.csv").write_text(head + "P4,no line break at the end")
    (tmp_path / "f.csv").write_text(head + "P5,5\" pipe\nP6,\"a\" b\nP7,long,row\nP8")
    (frame,) = csv_scans(spark, str(tmp_path))
    rows = {r.patent_id: r for r in frame.collect()}
    assert sorted(rows) == [f"P{i}" for i in (1, 2, 4, 5, 6, 7, 8)] or sorted(rows) == [f"P{i}" for i in range(1, 9)]
    assert (rows["P1"].title, rows["P2"].title, rows["P4"].title, rows["P5"].title) == ("x\ny", "z", "no line break at the end", '5" pipe')
    assert {k for k, r in rows.items() if r.reject_reason} >= {"P7"} and rows["P8"].title == ""


def test_no_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    found = read_csv(spark, str(tmp_path))
    assert found.records.count() == 0 and found.rejects.count() == 0


def test_the_last_file_wins_over_all_headers_and_formats(spark, tmp_path):
    (tmp_path / "b.csv").write_text("patent_id,title,status\nP1,from b,x\n")
    (tmp_path / "a.csv").write_text("title,patent_id\nfrom a,P1\n")
    (tmp_path / "c.json").write_text('[{"patent_id": "P1", "title": "from c"}, {"patent_id": "P1", "title": "from c again"}]')
    records = read_directory(spark, str(tmp_path)).records
    assert [r.title for r in records.orderBy("seq").collect()] == ["from a", "from b", "from c", "from c again"]


def test_blocks_that_changed_between_the_readings_fail(spark, tmp_path):
    (tmp_path / "a.csv").write_text("patent_id,title\n" + "P1,\"x\ny\"\n" * 200)
    (layout,) = splits.layouts(spark, str(tmp_path))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "90")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        with pytest.raises(Exception, match="cut into other blocks"):
            splits.rows(spark, layout).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_options_of_a_directory(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("patent_id,title\nP1,Möbel\n".encode("latin-1"))
    (tmp_path / "b.json").write_text('{"patent_id": "P2", "title": "x"}\n{"patent_id": "P3", "title": "y"}\n')
    (tmp_path / "c.xml").write_text("<r><patent><patent-id>P4</patent-id><title>t</title></patent></r>")
    options = {"csv": {"encoding": "iso-8859-1"}, "json": {"lines": True}, "xml": {"row_tag": "patent"}}
    found = read_directory(spark, str(tmp_path), options=options).records
    assert sorted(r.title for r in found.filter("patent_id < 'P4'").collect()) == ["Mo bel", "x", "y"]
    with pytest.raises(ValueError, match="no reader"):
        read_directory(spark, str(tmp_path), options={"xlsx": {}})


def test_files_of_two_headers_are_cut_by_themselves(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_text("patent_id,title\n" + "".join(f'A{i},"t\n{i}"\n' for i in range(90)))
    (tmp_path / "b.csv").write_text("title,patent_id\n" + "".join(f'"t\n{i}",B{i}\n' for i in range(9)))
    got = sorted(r.patent_id for r in read_csv(spark, str(tmp_path)).records.collect())
    assert got == sorted([f"A{i}" for i in range(90)] + [f"B{i}" for i in range(9)])


def test_cells_are_taken_apart_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text("patent_id,title,status\nP1,t\nP2,t,x,y\n,t,x\n")
    found = read_csv(spark, str(tmp_path))
    assert found.records._jdf.queryExecution().optimizedPlan().toString().count("from_csv") == 1
    assert [(r.patent_id, r.status) for r in found.records.collect()] == [("P1", "")]
    assert sorted(r.reject_reason for r in found.rejects.collect()) == ["required:patent_id", "width"]


def test_long_rows_are_handed_on_by_bytes():
    values = ["id,title", *(f"{i}," + "x" * 200_000 for i in range(40))]
    lines = pa.RecordBatch.from_pydict({
        "value": values, splits.SOURCE: ["a"] * len(values), splits.START: [0] * len(values), "name": [1] * len(values),
    })
    found = list(splits._put_together(iter([lines]), lambda name: 0))
    assert max(f.nbytes for f in found) < 3 << 20
    assert [v for f in found for v in f.column("value").to_pylist()] == values[1:]
