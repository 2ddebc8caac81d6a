import tracemalloc

import pyarrow as pa

from docketry.sources import validate
from docketry.sources.validate import validate_files


def verdicts(spark, folder):
    return {r.file_name: (r.is_valid, r.errors, r.warnings, r.records) for r in validate_files(spark, str(folder)).collect()}


def test_csv(spark, tmp_path):
    whole = "patent_id,title,abstract,inventors,assignees,filing_date\n"
    (tmp_path / "good.csv").write_text(whole + 'P1,t,"a\nb",,,\nP2,t,,,,\n')
    (tmp_path / "ids.csv").write_text(whole + "P1,t,,,,\nP1,u,,,,\n,v,,,,\n")
    (tmp_path / "few.csv").write_text("title,abstract\nx,y\n")
    (tmp_path / "wide.csv").write_text("patent_id,title\nP1,t,u\n")
    (tmp_path / "empty.csv").write_text("patent_id,title\n")
    (tmp_path / "x.pdf").write_text("x")
    got = verdicts(spark, tmp_path)
    assert got["good.csv"] == (True, [], [], 2)
    assert got["ids.csv"] == (True, [], ["missing patent ids", "duplicate patent ids"], 3)
    assert got["few.csv"][:2] == (False, ["missing required columns: patent_id"])
    assert got["wide.csv"][:2] == (False, ["rows longer than the header"])
    assert got["empty.csv"][:2] == (False, ["no rows"])
    assert got["x.pdf"][:2] == (False, ["unsupported format: pdf"])


def test_json(spark, tmp_path):
    bodies = {
        "list": '[{"patent_id": "a", "title": "b"}, 5]', "wrapped": '{"patents": [], "data": [{"patent_id": "a", "title": "b"}]}',
        "bare": '{"patent_id": "a", "title": null}', "one": '{"results": {"patent_id": "a"}}', "empty": " []", "broken": '[{"patent_id": ', "scalar": "5",
        "texts": '["a"]', "lacks": '[{"abstract": ""}]',
    }
    for name, body in bodies.items():
        (tmp_path / f"{name}.json").write_text(body)
    got = {k.split(".")[0]: (v[0], *v[1], v[3]) for k, v in verdicts(spark, tmp_path).items()}
    assert got == {
        "list": (True, 2), "wrapped": (True, 1), "bare": (True, 1), "one": (False, "missing fields: title", 1), "empty": (False, "empty list", 0),
        "broken": (False, "invalid JSON", None), "scalar": (False, "neither a list nor an object", None), "texts": (False, "records must be objects", 1),
        "lacks": (False, "missing fields: patent_id, title", 1),
    }


def test_xml(spark, tmp_path):
    (tmp_path / "good.xml").write_text('<?xml version="1.0" encoding="UTF-8"?>\n<r><patent/><patent-document>x</patent-document></r>')
    (tmp_path / "latin.XML").write_bytes('<?xml version="1.0" encoding="ISO-8859-1"?><patent>ö</patent>'.encode("latin-1"))
    (tmp_path / "other.rdf").write_text("<r/>")
    (tmp_path / "broken.xml").write_text("<patent><r></patent>")
    got = verdicts(spark, tmp_path)
    assert got["good.xml"] == (True, [], [], 2) and got["latin.XML"] == (True, [], [], 1)
    assert got["other.rdf"] == (True, [], ["no patent elements"], 0)
    assert not got["broken.xml"][0] and got["broken.xml"][1][0].startswith("invalid XML")


def test_no_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.csv").write_text("patent_id,title\n")
    assert validate_files(spark, f"{tmp_path}/sub").collect()[0].errors == ["no rows"]


def test_xml_is_checked_without_a_tree():
    text = "<r>" + "<a>x</a>" * 400_000 + "</r>"
    documents = pa.array([text, text[:-4], "", None, "<r>&nbsp;</r>"])
    tracemalloc.start()
    found = validate._xml_error(documents).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[0] is None and found[1] == "invalid XML: ParseError 3 in line 1" == found[2] == found[3]
    assert found[4] == "invalid XML: ParseError 11 in line 1"
    assert peak < len(text)
