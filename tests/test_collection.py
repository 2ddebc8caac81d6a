import pytest
from pyspark.sql import functions as F

from docketry import Collection, ExactFilter, HashingEmbedder
from docketry.plans.collection import first_points
from docketry.plans.queries import all_queries
from docketry.plans.tables import write_xml
from docketry.sources.load import read_csv, read_json, read_xml
from docketry.sources.sample import sample_records
from docketry.sources.write import write_csv
from docketry.streaming.loads import stream_raw, stream_records, stream_rejects, upsert_directory_stream, upsert_stream, write_records


@pytest.fixture
def kept(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"), HashingEmbedder(256))
    c.upsert(sample_records(spark, 40))
    return c


def state(c):
    return sorted((r.patent_id, r.title, r.status) for r in c.points().collect())


def test_empty(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "none"))
    assert c.total() == 0 and c.search("x").count() == 0 and c.lookup("x").count() == 0


def test_upsert_twice_is_once(spark, kept):
    once = state(kept)
    assert kept.upsert(sample_records(spark, 40)) == 40
    assert state(kept) == once and len(once) == 40


def test_changed_title(spark, kept):
    renamed = sample_records(spark, 1).withColumn("title", F.lit("Other"))
    kept.upsert(renamed)
    assert kept.total() == 41
    kept.update(renamed)
    assert kept.total() == 40
    assert kept.lookup("US10000000").first().title == "Other"


def test_later_row_wins(spark, kept):
    twice = sample_records(spark, 1).withColumn("status", F.explode(F.array(F.lit("first"), F.lit("last"))))
    kept.upsert(twice.withColumn("seq", F.when(F.col("status") == "last", 2).otherwise(1)))
    assert kept.lookup("US10000000").first().status == "last"


def test_delete(spark, kept):
    kept.upsert(sample_records(spark, 2).withColumn("title", F.lit("Other")))
    assert kept.delete(["US10000000"], first_only=True) == 1
    assert kept.total() == 41
    assert kept.delete(["US10000000", "US10000001", "none"]) == 3
    assert kept.total() == 38
    kept.upsert(sample_records(spark, 1))
    assert kept.total() == 39
    assert kept.delete(["none"]) == 0


def test_compact_and_clear(spark, kept):
    kept.update(sample_records(spark, 5).withColumn("status", F.lit("Allowed")))
    kept.delete(["US10000007"])
    before = state(kept)
    kept.compact(3)
    assert state(kept) == before and len(before) == 39
    head = kept._head()
    assert not head.changes and not head.gone
    kept.clear()
    assert kept.total() == 0
    kept.upsert(sample_records(spark, 3))
    assert kept.total() == 3


def test_vacuum(spark, kept, tmp_path):
    kept.compact()
    kept.upsert(sample_records(spark, 5).withColumn("title", F.lit("Other")))
    before = state(kept)
    kept.compact()
    assert kept.vacuum(keep_versions=2) == 1  # the first change
    assert kept.vacuum() == 2 and kept.vacuum() == 0
    assert state(kept) == before
    assert Collection(spark, str(tmp_path / "none")).vacuum() == 0


def test_changes_are_read_in_one_scan(spark, kept):
    for i in range(3):
        kept.upsert(sample_records(spark, 1).withColumn("title", F.lit(f"Title {i}")))
    plan = kept.points()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 2
    assert kept.total() == 43


def test_failed_commit_is_not_seen(spark, kept):
    before = state(kept)
    with pytest.raises(Exception):
        kept.upsert(sample_records(spark, 5).withColumn("title", F.raise_error(F.lit("no")).cast("string")))
    assert state(kept) == before


@pytest.mark.parametrize("compact", [False, True])
def test_search(spark, kept, compact):
    if compact:
        kept.compact(4)
    found = kept.search("advanced quantum computing system", 4).orderBy("rank").collect()
    assert [r["rank"] for r in found] == [1, 2, 3, 4]
    assert {r.technology_field for r in found} == {"Quantum Computing"}
    whole = kept.search("advanced quantum computing system", 2000).orderBy("rank").limit(4).collect()
    assert [(r.point_id, r.similarity_score) for r in whole] == [(r.point_id, r.similarity_score) for r in found]
    some = kept.search("robot", 50, ExactFilter(assignees=["TechCorp Industries"])).collect()
    assert len(some) == 4 and all("TechCorp Industries" in r.assignees for r in some)
    hits = kept.search_batch([("a", "quantum", None), ("b", "quantum", "Robotics")], 3)
    assert hits.groupBy("query_id").count().orderBy("query_id").collect() == [("a", 3), ("b", 3)]
    assert kept.similar("US10000003", 3, 0.1).count() == 3


def test_fetch_by_key_reaches_the_scan(spark, kept):
    kept.compact(4)
    plan = kept.search("quantum", 25)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan or "PushedFilters: [IsNotNull(point_id), Or(" in plan or "In(point_id" in plan
    narrow = kept.search("quantum", 5)._jdf.queryExecution().executedPlan().toString()
    assert "In(point_id" in narrow


def test_stats_and_export(spark, kept, tmp_path):
    assert {(r.key, r["count"]) for r in kept.stats().filter("facet = 'country'").collect()} == {("US", 40)}
    kept.export(str(tmp_path / "j"), "json", 7)
    first = sorted(r.point_id for r in kept.points().select("point_id").collect())[:7]
    want = sorted(r.patent_id for r in kept.points().filter(F.col("point_id").isin(first)).collect())
    assert sorted(r.patent_id for r in spark.read.json(str(tmp_path / "j")).collect()) == want
    for n in (1, 7, 39, 40, 99):
        cut = first_points(kept.points(), n)
        assert sorted(r.point_id for r in cut.collect()) == sorted(r.point_id for r in first_points(kept.points(), n).collect())


def test_export_by_range_takes_the_first_of_all(spark, tmp_path):
    n = 400
    spark.range(n).selectExpr("id AS doc_id", "concat('t', id) AS text", "'en' AS lang", "'s' AS source").write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(3).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic").write.parquet(str(tmp_path / "labels.parquet"))
    both = [sorted(r.point_id for r in all_queries()[q](spark, str(tmp_path)).collect()) for q in ("export_limit_by_range", "export_limit")]
    assert len(both[0]) == 300 and both[0] == both[1] and both[0][0][0] in "0123"


@pytest.mark.parametrize("limit,ids", [(2, 2), (5, 5), (6, 5), (8, 5)])
def test_points_without_an_id_are_the_last_of_the_first(spark, limit, ids):
    points = spark.createDataFrame([(f"{i}0000{i}", i) for i in range(5)] + [(None, 5), (None, 6), (None, 7)], "point_id string, n int")
    found = [r.point_id for r in first_points(points, limit).collect()]
    assert len(found) == limit and sorted(x for x in found if x) == [f"{i}0000{i}" for i in range(ids)]


def test_xml_stream(spark, tmp_path):
    source = sample_records(spark, 12).withColumn("claims", F.array(F.lit("One claim that is long enough"))).repartition(3)
    write_xml(source, str(tmp_path / "in"))
    found = stream_records(spark, str(tmp_path / "in"), "xml", max_files=1)
    write_records(found, str(tmp_path / "out"), str(tmp_path / "p")).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert stored.select("patent_id").distinct().count() == 12
    assert stored.select("claims").distinct().collect() == [(["One claim that is long enough"],)]


def test_stream(spark, tmp_path):
    records = sample_records(spark, 60).repartition(6)
    write_csv(records, str(tmp_path / "in"))
    found = stream_records(spark, str(tmp_path / "in"), max_files=2)
    write_records(found, str(tmp_path / "out"), str(tmp_path / "p1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60

    c = Collection(spark, str(tmp_path / "c"), HashingEmbedder(8))
    raw = stream_raw(spark, str(tmp_path / "in"), max_files=2)
    upsert_stream(raw, c, str(tmp_path / "p2"), "s", compact_every=2).awaitTermination()
    assert c.total() == 60
    version = c._head().version
    # The same batches again, as after a lost checkpoint: all are known already.
    upsert_stream(raw, c, str(tmp_path / "p3"), "s", compact_every=1000).awaitTermination()
    assert c._head().version == version and c.total() == 60


WIDE = "patent_id,title,inventors\nP1,One,Ann|Bob\nP2,Two,Cy,extra\n,None,\n"
LINES = """{"patent_id": "P1", "title": "One", "inventors": "Ann|Bob"}
{"patent_id": "P2", "title": "Two", "colour": "red"}
[5]
"""
ELEMENTS = "<patents><patent><publication-reference><document-id><doc-number>7</doc-number></document-id></publication-reference></patent></patents>"


@pytest.mark.parametrize("format,body", [("csv", WIDE), ("json", LINES), ("xml", ELEMENTS)])
def test_stream_reads_as_batch(spark, tmp_path, format, body):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / f"a.{format}").write_text(body)
    batch = {"csv": read_csv, "json": lambda s, p: read_json(s, p, lines=True), "xml": read_xml}[format](spark, str(folder))
    header = {"columns": ["patent_id", "title", "inventors"]} if format == "csv" else {}
    c = Collection(spark, str(tmp_path / "c"), HashingEmbedder(64))
    raw = stream_raw(spark, str(folder), format, **header)
    upsert_stream(raw, c, str(tmp_path / "p"), "s", rejects=str(tmp_path / "r")).awaitTermination()
    columns = ["patent_id", "title", "inventors"]
    assert sorted(map(tuple, c.points().select(*columns).collect())) == sorted(map(tuple, batch.records.select(*columns).collect()))
    assert c.total() == 1
    told = sorted(r.reject_reason for r in spark.read.parquet(str(tmp_path / "r")).collect())
    assert told == sorted(r.reject_reason for r in batch.rejects.collect())
    found = stream_rejects(spark, str(folder), format, **header)
    write_records(found, str(tmp_path / "r2"), str(tmp_path / "p2")).awaitTermination()
    assert sorted(r.reject_reason for r in spark.read.schema(found.schema).parquet(str(tmp_path / "r2")).collect()) == told


def test_directory_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("patent_id,title\nP1,t\nP2,t\n")
    (folder / "b.CSV").write_text("status,title,patent_id\nGranted,t,P1\n,,P3\n")
    (folder / "c.json").write_text('{"data": [{"patent_id": "P4", "title": "t"}, 5]}')
    (folder / "d.pdf").write_text("x")
    c = Collection(spark, str(tmp_path / "c"), HashingEmbedder(8))
    run = lambda: upsert_directory_stream(spark, str(folder), c, str(tmp_path / "p"), "s", rejects=str(tmp_path / "r")).awaitTermination()
    run()
    got = {r.patent_id: r.status for r in c.points().collect()}
    assert got.keys() == {"P1", "P2", "P4"} and got["P1"] == "Granted"
    assert sorted(r.reject_reason for r in spark.read.parquet(str(tmp_path / "r")).collect()) == ["not an object", "required:title", "unsupported:pdf"]
    (folder / "e.csv").write_text("title,patent_id\nt,P5\n")
    run()
    assert {r.patent_id for r in c.points().collect()} == {"P1", "P2", "P4", "P5"}


def test_compact_moves_whole_rows_once(spark, kept, monkeypatch):
    once = "shufflepartitionidpassthrough"
    assert kept._folded(3)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    kept.compact(3)
    kept.upsert(sample_records(spark, 5).withColumn("status", F.lit("Allowed")))
    kept.delete(["US10000007"])
    plan = kept._folded(3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(once) == 1 and "SortMergeJoin" not in plan
    before = state(kept)
    files = kept._folded(3).select("point_id", F.spark_partition_id().alias("at")).collect()
    assert len({(r.at, int(r.point_id[:4], 16) * 3 // 16**4) for r in files}) == 3
    # More ids taken out than are broadcast, and points put often.
    monkeypatch.setattr("docketry.plans.collection.FEW_GONE", 0)
    monkeypatch.setattr("docketry.plans.collection.MANY", 1)
    kept.compact(3)
    assert state(kept) == before and len(before) == 39
    for s in ("first", "last"):
        kept.upsert(sample_records(spark, 2).withColumn("status", F.lit(s)))
    kept.compact(3)
    assert [r.status for r in kept.points().orderBy("patent_id").limit(2).collect()] == ["last", "last"] and kept.total() == 39


def test_points_without_an_id_outlive_a_compaction_as_before(spark, kept):
    for s in ("first", "last"):
        kept.upsert(sample_records(spark, 1).withColumns({"title": F.lit(None).cast("string"), "status": F.lit(s)}))
        kept.compact(3)
    assert sorted(r.status for r in kept.points().filter("point_id IS NULL").collect()) == ["first", "last"] and kept.total() == 42


@pytest.mark.parametrize("format", ["csv", "xml"])
def test_arriving_files_are_cut(spark, tmp_path, format):
    source = sample_records(spark, 40).withColumn("abstract", F.lit("one\n\"two\"\n" + "x" * 500)).coalesce(1)
    (write_csv if format == "csv" else write_xml)(source, str(tmp_path / "in"))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        raw = stream_raw(spark, str(tmp_path / "in"), format)
        paths = [str(p) for p in (tmp_path / "in").glob("part-*")]
        rows = raw.read(spark, paths)
        assert len(paths) == 1 and rows.schema.names == raw.schema.names and rows.select(F.spark_partition_id()).distinct().count() > 4
        out, found = str(tmp_path / "out"), stream_records(spark, str(tmp_path / "in"), format)
        for progress in ("p", "p", "q"):
            # A stream that goes on finds nothing new; one from the beginning adds its own rows.
            write_records(found, out, str(tmp_path / progress)).awaitTermination()
        stored = spark.read.parquet(out)
        assert stored.columns == found.schema.names and stored.count() == 80 and stored.select("patent_id").distinct().count() == 40
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_a_batch_that_runs_again_replaces_its_files(spark, tmp_path):
    write_csv(sample_records(spark, 6), str(tmp_path / "in"))
    found = stream_records(spark, str(tmp_path / "in"))
    write_records(found, str(tmp_path / "out"), str(tmp_path / "p")).awaitTermination()
    for commit in (tmp_path / "p" / "commits").iterdir():
        commit.unlink()
    write_records(found, str(tmp_path / "out"), str(tmp_path / "p")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_csv_stream_of_another_header_fails(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("patent_id,name\nP1,One\n")
    with pytest.raises(Exception, match="header"):
        write_records(stream_records(spark, str(tmp_path / "in"), columns=["patent_id", "title"]), str(tmp_path / "out"), str(tmp_path / "p")).awaitTermination()


def test_json_stream_moves_no_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text(LINES)
    found = stream_records(spark, str(tmp_path), "json")
    assert "Repartition" not in found._jdf.queryExecution().analyzed().toString()
