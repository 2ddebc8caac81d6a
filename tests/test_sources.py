import json

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from docketry.operators.normalize import normalize
from docketry.schema import RECORD_FIELDS
from docketry.sources import markup, scan
from docketry.sources.load import read_csv, read_directory, read_json, read_xml
from docketry.sources.markup import extract_html, extract_xml
from docketry.sources.profile import file_profile, quality_report
from docketry.sources.sample import sample_records
from docketry.sources.scan import scan_csv
from docketry.sources.write import write_csv, write_json
from docketry.streaming import loads


def put(folder, **files):
    for name, body in files.items():
        (folder / name.replace("__", ".")).write_text(body, encoding="utf-8")
    return str(folder)


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


CSV = '''patent_id,title,abstract,claims,classification_codes
P1,"A, quoted ""title""","two
lines",A claim that is long enough|short|Another claim that is long,G06N3/00|H04L9/00
P2,Blank abstract,,,
,No id,x,,
P3,,no title,,
P4,short row
P5,long row,x,,,extra
'''


def test_csv(spark, tmp_path):
    records, rejects = read_csv(spark, put(tmp_path, a__csv=CSV))
    assert rows(records, "patent_id", "title", "abstract", "technology_field", F.size("claims")) == [
        ("P1", "A, quoted title", "two lines", "Physics", 2),
        ("P2", "Blank abstract", "", "Unknown", 0),
        ("P4", "short row", "", "Unknown", 0),
    ]
    assert rows(rejects, "reject_reason") == [("required:patent_id",), ("required:title",), ("width",)]


def test_strict_csv(spark, tmp_path):
    records, rejects = read_csv(spark, put(tmp_path, a__csv=CSV), strict=True)
    assert [r[0] for r in rows(records, "patent_id")] == ["P1", "P2"]
    assert rejects.count() == 4


def test_csv_unknown_column(spark, tmp_path):
    path = put(tmp_path, a__csv="patent_id,title,colour\nP1,t,red\n")
    records, rejects = read_csv(spark, path)
    assert (records.count(), rows(rejects, "reject_reason")) == (0, [("unknown:colour",)])
    assert read_csv(spark, path, on_unknown="ignore").records.count() == 1


def test_csv_files_with_other_headers(spark, tmp_path):
    path = put(
        tmp_path, a__csv="patent_id,title\nP1,t\n", b__CSV="title,patent_id,country\nu,P2,FR\n",
        c__csv="patent_id,title\nP3,v\n", d__csv="patent_id,title,colour\nP4,w,red\n",
    )
    for records, rejects in (read_csv(spark, path), read_directory(spark, path)):
        assert rows(records, "patent_id", "title", "country") == [("P1", "t", "US"), ("P2", "u", "FR"), ("P3", "v", "US")]
        assert rows(rejects, "reject_reason") == [("unknown:colour",)]
    got = {r.file_name: (r.records, r.columns) for r in file_profile(spark, path).collect()}
    assert got == {
        "a.csv": (1, ["patent_id", "title"]), "b.CSV": (1, ["title", "patent_id", "country"]),
        "c.csv": (1, ["patent_id", "title"]), "d.csv": (1, ["patent_id", "title", "colour"]),
    }


@pytest.mark.parametrize("encoding", ["ISO-8859-1", "UTF-16", "utf-8"])
def test_encodings(spark, tmp_path, encoding):
    name = "Über été"  # ids stay as read, while texts are cleaned
    record = json.dumps({"patent_id": name, "title": "t"}, ensure_ascii=False)
    (tmp_path / "a.json").write_bytes(f"[{record}]".encode(encoding))
    found = read_json(spark, str(tmp_path / "a.json"), encoding=encoding).records
    assert rows(found, "patent_id") == [(name,)]
    (tmp_path / "a.xml").write_bytes(document(name).encode(encoding))
    assert rows(read_xml(spark, str(tmp_path / "a.xml"), encoding=encoding).records, "patent_id") == [(name,)]
    (tmp_path / "b.xml").write_bytes(f'<?xml version="1.0" encoding="{encoding}"?>{document(name)}'.encode(encoding))
    assert rows(read_xml(spark, str(tmp_path / "b.xml")).records, "patent_id") == [(name,)]
    if encoding != "UTF-16":  # lines of UTF-16 cannot be told apart by one byte
        (tmp_path / "l.json").write_bytes(f"{record}\n\n{record.replace('Über', 'Aber')}\n".encode(encoding))
        found = read_json(spark, str(tmp_path / "l.json"), encoding=encoding, lines=True).records
        assert rows(found, "patent_id") == [("Aber été",), (name,)]


def test_cut_xml_is_utf8(spark, tmp_path):
    with pytest.raises(ValueError, match="UTF-8"):
        read_xml(spark, str(tmp_path), row_tag="patent-document", encoding="ISO-8859-1")


def test_last_of_equal_rows_is_known(spark, tmp_path):
    body = "patent_id,title,status\n" + "".join(f"P1,t,s{i}\n" for i in range(50))
    found = read_csv(spark, put(tmp_path, a__csv=body)).records
    assert found.agg(F.max_by("status", "seq")).first()[0] == "s49"


@pytest.mark.parametrize(
    ("body", "ids"),
    [
        ('[{"patent_id": "P1", "title": "t"}, 5, {"patent_id": "P2", "title": "u", "abstract": null}]', ["P1", "P2"]),
        ('{"patents": [{"patent_id": "P1", "title": "t"}], "data": [{"patent_id": "P2", "title": "t"}]}', ["P1"]),
        ('{"patents": [], "data": [{"patent_id": "P2", "title": "t"}]}', ["P2"]),
        ('{"results": [{"patent_id": "P3", "title": "t"}]}', ["P3"]),
        ('{"patent_id": "P4",\n "title": "t"}', ["P4"]),
        ('{"patent_id": "P5", "title": "t", "colour": "red"}', []),
        ("[]", []),
    ],
)
def test_json_shapes(spark, tmp_path, body, ids):
    found = read_json(spark, put(tmp_path, a__json=body)).records
    assert [r[0] for r in rows(found, "patent_id")] == ids


def test_json_lists_and_rejects(spark, tmp_path):
    body = json.dumps([
        {"patent_id": 1, "title": "t", "claims": "A first long claim|A second long claim", "inventors": ["A", "B"], "assignees": 3},
        {"patent_id": "P2", "title": ""},
        {"patent_id": " ", "title": "x"},
        "text",
    ])
    records, rejects = read_json(spark, put(tmp_path, a__json=body))
    r = records.first()
    assert (r.patent_id, r.claims, r.inventors, r.assignees, r.country) == (
        "1", ["A first long claim", "A second long claim"], ["A", "B"], [], "US",
    )
    assert rows(rejects, "reject_reason") == [("not an object",), ("required:patent_id",), ("required:title",)]


def test_broken_json_fails_the_job(spark, tmp_path):
    path = put(tmp_path, a__json='[{"patent_id": ')
    with pytest.raises(PySparkException):
        read_json(spark, path).records.collect()


def document(number, tag="patent-document"):
    return f"""<{tag}><publication-reference><document-id><country>EP</country><doc-number>{number}</doc-number>
<date>20200131</date></document-id></publication-reference>
<application-reference><document-id><date>190203</date></document-id></application-reference>
<invention-title>Lead <b>bold</b> tail</invention-title><abstract><p>An &amp; abstract</p><p> more</p></abstract>
<inventors><inventor><name>Ann One</name></inventor>
<inventor><addressbook><name/><first-name>Bo</first-name><last-name>Two</last-name></addressbook></inventor>
<inventor><first-name>No</first-name><last-name>Name</last-name></inventor></inventors>
<assignees><assignee><orgname>Acme Inc.</orgname></assignee><assignee><name>Solo</name></assignee></assignees>
<claims><claim>1. A device with a very long description.</claim><claim>2. The device of claim 1, but longer.</claim></claims>
<classification-ipc><main-classification> H04L9/00 </main-classification></classification-ipc></{tag}>"""


def test_xml_fields(spark):
    frame = spark.createDataFrame([(document("7"),), ("<a/>",), ("<broken",), (None,)], "xml string")
    found = extract_xml(frame).collect()
    r = found[0]
    assert (r.patent_id, r.title, r.abstract, r.country) == ("7", "Lead", "An abstract more", "EP")
    assert (r.filing_date, r.publication_date) == ("2019-02-03", "2020-01-31")
    assert (r.inventors, r.assignees) == (["Ann One", "Bo Two"], ["Acme Incorporated", "Solo"])
    # "claim 1," has no dot and does not split.
    assert r.claims == ["A device with a very long description.", "The device of claim 1, but longer."]
    assert (r.classification_codes, r.technology_field, r.status) == (["H04L9/00"], "Electricity", "Published")
    assert [x.reject_reason for x in found] == [None, "required:patent_id", "malformed XML", "malformed XML"]


@pytest.mark.parametrize(
    ("body", "ids"),
    [
        ("<?xml version='1.0'?><all>" + document("1") + document("2") + "</all>", ["1", "2"]),
        ("<all>" + document("1", "patent") + document("2", "patent") + "</all>", ["1", "2"]),
        (document("3", "grant"), ["3"]),
        ("".join("<?xml version='1.0'?>\n" + document(n, "grant") + "\n" for n in "45"), ["4", "5"]),
    ],
)
def test_xml_files(spark, tmp_path, body, ids):
    assert [r[0] for r in rows(read_xml(spark, put(tmp_path, a__xml=body)).records, "patent_id")] == ids


def test_xml_cut_while_reading(spark, tmp_path):
    body = "<all>" + "\n".join(document(str(n)) for n in range(30)) + "</all>"
    found = read_xml(spark, put(tmp_path, a__xml=body), row_tag="patent-document").records
    assert found.select("patent_id").distinct().count() == 30


def test_html(spark):
    page = """<html><head><title>Head &amp; title</title></head><body><h1>Later</h1><p>US1234567B2</p>
    <p>Inventors: <b>Ann</b> One, Dr.Bo</p><p>Applicant: Acme Inc.; Other</p>
    <section class="x ABSTRACT"><p>The <i>abstract<br>text</p></section><div class="detail"><div>inner</div> outer</div>
    <div class="claims">1. A claim that is certainly long enough. 2. Another claim that is long enough</div></body></html>"""
    frame = spark.createDataFrame([(page,), ("<p>Baby: none</p> Patent No. 55",), ("",)], "html string")
    a, b, c = extract_html(frame).collect()
    assert (a.patent_id, a.title, a.abstract, a.description) == ("US1234567B2", "Head title", "The abstracttext", "inner outer")
    assert (a.inventors, a.assignees) == (["Ann One", "Bo"], ["Acme Incorporated", "Other"])
    assert a.claims == ["A claim that is certainly long enough.", "Another claim that is long enough"]
    assert (b.patent_id, b.title, b.inventors) == ("55", "", [])
    assert (c.patent_id, c.claims) == ("UNKNOWN", [])


def test_directory(spark, tmp_path):
    path = put(
        tmp_path, a__csv="patent_id,title\nP1,t\n", b__JSON='[{"patent_id": "P2", "title": "t"}]', c__xml=document("3"), d__pdf="x"
    )
    records, rejects = read_directory(spark, path)
    assert [r[0] for r in rows(records, "patent_id")] == ["3", "P1", "P2"]
    assert rows(rejects, "reject_reason") == [("unsupported:pdf",)]
    assert [r[0] for r in rows(read_directory(spark, path, "*.csv").records, "patent_id")] == ["P1"]
    assert read_directory(spark, path, "*.pdf").records.count() == 0


def test_profile(spark, tmp_path):
    path = put(tmp_path, a__csv=CSV, b__json='{"data": [{}, {}, {}]}', c__txt="x")
    got = {r.file_name: (r.supported, r.records, r.columns) for r in file_profile(spark, path).collect()}
    assert got == {
        "a.csv": (True, 6, ["patent_id", "title", "abstract", "claims", "classification_codes"]),
        "b.json": (True, 3, None),
        "c.txt": (False, None, None),
    }


def test_quality(spark, tmp_path):
    found = quality_report(scan_csv(spark, put(tmp_path, a__csv="patent_id,abstract\nP1,a\nP1,b\n,c\n")))
    assert ("error", "missing required column", "title", 3) in rows(found, "*")
    assert ("warning", "duplicate id", "patent_id", 1) in rows(found, "*")
    assert ("warning", "missing value", "patent_id", 1) in rows(found, "*")
    assert rows(quality_report(spark.createDataFrame([], "patent_id string, title string")), "severity", "check")[0] == ("error", "no rows")


def test_sample_records(spark):
    r = sample_records(spark, 50).orderBy("patent_id").collect()
    assert len(r) == 50 and list(r[0].asDict()) == list(RECORD_FIELDS)
    assert (r[0].status, r[1].status, r[13].filing_date) == ("Granted", "Published", "2022-02-14")
    assert r[11].inventors == ["Dr. Louis Garcia", "Dr. Alice Johnson"]
    assert "blockchain technology" in r[1].abstract


def test_round_trips(spark, tmp_path):
    records = sample_records(spark, 30)
    write_csv(records, str(tmp_path / "c"))
    write_json(records, str(tmp_path / "j"))
    want = rows(records, "patent_id", "claims", "inventors", "legal_status")
    back = normalize(scan_csv(spark, str(tmp_path / "c")), keep=("source_file", "seq"))
    assert rows(back, "patent_id", "claims", "inventors", "legal_status") == want
    assert rows(spark.read.schema(records.schema).json(str(tmp_path / "j")), "patent_id", "claims", "inventors", "legal_status") == want


@pytest.mark.parametrize("read,layout", [(markup._xml_parts, markup._XML_PARTS), (markup._html_parts, markup._HTML_PARTS)])
def test_markup_of_a_batch_is_read_by_slices(read, layout):
    texts = pa.array([f"<p>{'x' * (3 << 20)}{i}</p>" for i in range(3)] + [None])
    parts = list(markup._parts(iter([texts]), read, layout))
    assert len(parts) == 3 and sum(map(len, parts)) == 4
    assert all(x[n] == y[n] for x, y in zip((r for p in parts for r in p.to_pylist()), map(read, texts.to_pylist())) for n in y)


def test_xml_files_are_cut_where_that_gives_what_whole_files_do(spark, tmp_path):
    pad = f"<p>{'x' * 300}</p>"
    many = lambda tag, opening="": "".join(f"<{tag}{opening}>{n}é</{tag}>{pad}" for n in range(6))
    bodies = {
        "cut": ["<?xml version='1.0'?>\n<all>" + many("patent-document") + "</all>", "<all>" + many("patent-document", "\n a='1'") + "<patent-document>" + pad],
        "none": ["\n<patent-documents>" + many("patent", " a='1'") + "</patent-documents>", "<?xml version='1.0'?><a/><?xml version='1.0'?><b/>", "<a/>"],
        "odd": [
            "<all>" + many("patent-document") + "<patent-document>" + pad + many("patent-document") + "</all>",
            "<!-- <patent-document> -->" + many("patent-document"), "</patent-document>" + many("patent-document"),
            "<patent-document>" + pad + "<patent-document>", "<?xml version='1.0' encoding='ISO-8859-1'?>" + many("patent-document"),
        ],
    }
    for kind, texts in bodies.items():
        for i, body in enumerate(texts):
            (tmp_path / f"{kind}{i}.xml").write_bytes(body.encode("ISO-8859-1" if "ISO" in body else "utf-8"))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        told = {r.source_file.rsplit("/", 1)[-1][:-5]: r.kind for r in scan._xml_kinds(spark.read, str(tmp_path), "patent-document").collect()}
        assert told == {kind: kind for kind in bodies}
        found = sorted((r.source_file, r.xml) for r in scan.scan_xml(spark, str(tmp_path)).collect())
        assert found == sorted((r.source_file, r.xml) for r in scan.whole_xml(spark.read, str(tmp_path)).collect())
        parts = scan.scan_xml(spark, str(tmp_path / "cut0.xml")).select(F.spark_partition_id()).distinct().count()
        assert len(found) > 40 and parts > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_xml_elements_are_cut_out_once(spark, tmp_path):
    folder = put(tmp_path, a__xml="<all><patent-document>1</patent-document><patent-document>2</patent-document></all>")
    for tag in (None, "patent-document"):
        found = read_xml(spark, folder, row_tag=tag).records
        assert found._jdf.queryExecution().optimizedPlan().toString().count(".*") == 1
    assert rows(scan.scan_xml(spark, folder), "xml") == [(f"<patent-document>{i}</patent-document>",) for i in (1, 2)]


def test_a_stream_parses_json_lines_once(spark, tmp_path):
    raw = scan.json_lines(spark.read, put(tmp_path, a__json='{"patent_id": "P1", "title": "t"}\n[5\n\n{"patent_id": "P2"}\n'), ordered=False)
    found = loads._records(raw)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
    assert rows(found, "patent_id", "title") == [("P1", "t")]
    assert sorted(r.reject_reason for r in loads._rejects(raw).collect()) == ["not an object", "required:title"]
