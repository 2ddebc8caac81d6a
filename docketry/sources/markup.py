"""Records out of XML and HTML texts.

The Python part only walks the markup, once per record, and hands back raw strings;
all cleaning and splitting happens in Spark expressions.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from docketry.batches import slices
from docketry.functions import classify, text
from docketry.operators.normalize import REASON
from docketry.schema import (
    DEFAULT_COUNTRY,
    DEFAULT_STATUS,
    RECORD_FIELDS,
    RECORD_SCHEMA,
    UNKNOWN_FIELD,
)

_XML_TEXT = ("doc_number", "title", "abstract", "description", "claims", "filed", "published", "country")
_XML_LIST = ("inventors", "assignees", "codes")
_XML_PARTS = T.StructType(
    [T.StructField(n, T.StringType()) for n in _XML_TEXT]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in _XML_LIST]
    + [T.StructField("parsed", T.BooleanType())]
)
_PUBLICATION = ".//publication-reference/document-id"


def _direct(root: ET.Element, path: str) -> str | None:
    return root.findtext(path)


def _whole(root: ET.Element, path: str) -> str | None:
    node = root.find(path)
    return None if node is None else "".join(node.itertext()) + (node.tail or "")


def _inventor(node: ET.Element) -> str | None:
    name = node.find(".//name")
    if name is None:
        return None
    if name.text and name.text.strip():
        return name.text
    parts = [node.findtext(".//first-name"), node.findtext(".//last-name")]
    return " ".join(parts) if all(parts) else None


def _assignee(node: ET.Element) -> str | None:
    organisation = node.find(".//orgname")
    return node.findtext(".//name") if organisation is None else organisation.text


def _xml_parts(xml: str | None) -> dict:
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return {"parsed": False}
    codes = [x.text.strip() for x in root.findall(".//classification-ipc/main-classification") if x.text]
    inventors = [_inventor(x) for x in root.findall(".//inventors/inventor")]
    assignees = [_assignee(x) for x in root.findall(".//assignees/assignee")]
    return {
        "parsed": True,
        "doc_number": _direct(root, f"{_PUBLICATION}/doc-number"),
        "title": _direct(root, ".//invention-title"),
        "abstract": _whole(root, ".//abstract"),
        "description": _whole(root, ".//detailed-description"),
        "claims": _whole(root, ".//claims"),
        "filed": _direct(root, ".//application-reference/document-id/date"),
        "published": _direct(root, f"{_PUBLICATION}/date"),
        "country": _direct(root, f"{_PUBLICATION}/country"),
        "inventors": [x for x in inventors if x],
        "assignees": [x for x in assignees if x],
        "codes": codes,
    }


def _parts(batches: Iterator[pa.Array], read: Callable[[str | None], dict], layout: T.StructType) -> Iterator[pa.Array]:
    """What `read` finds in each text, handed on slice by slice."""
    kind = to_arrow_type(layout)
    for texts in batches:
        for start, stop in slices(texts):
            yield pa.array(map(read, texts.slice(start, stop - start).to_pylist()), kind)


@F.arrow_udf(_XML_PARTS)
def _xml_udf(xml: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return _parts(xml, _xml_parts, _XML_PARTS)


def _record(fields: dict[str, Column]) -> list[Column]:
    """Given fields under their names, the rest at their defaults, in record order."""
    empty = F.array().cast("array<string>")
    out = []
    for field in RECORD_SCHEMA:
        value = fields.get(field.name)
        if value is None:
            value = empty if isinstance(field.dataType, T.ArrayType) else F.lit(None).cast("string")
        out.append(value.alias(field.name))
    return out


def extract_xml(frame: DataFrame, xml: str = "xml", keep: tuple[str, ...] = ()) -> DataFrame:
    """Records of a frame with one XML document per row, with `reject_reason`."""
    p = frame.select(*keep, _xml_udf(F.col(xml)).alias("p"))
    part = {n: F.col(f"p.{n}") for n in _XML_PARTS.names}
    number = F.coalesce(part["doc_number"], F.lit(""))
    country = F.nullif(part["country"], F.lit(""))
    fields = {
        "patent_id": number,
        "patent_number": number,
        "title": text.clean_text(part["title"]),
        "abstract": text.clean_text(part["abstract"]),
        "description": text.clean_text(part["description"]),
        "claims": text.extract_claims(part["claims"]),
        "inventors": F.filter(text.clean_each(part["inventors"]), lambda x: x != ""),
        "assignees": F.filter(text.clean_each(part["assignees"]), lambda x: x != ""),
        "filing_date": text.format_date(part["filed"]),
        "publication_date": text.format_date(part["published"]),
        "classification_codes": part["codes"],
        "technology_field": classify.classify_ipc(part["codes"]),
        "country": F.coalesce(text.strip(country), F.lit(DEFAULT_COUNTRY)),
        "status": F.lit(DEFAULT_STATUS),
    }
    reason = F.when(~part["parsed"], "malformed XML").when(number == "", "required:patent_id")
    return p.select(*_record(fields), reason.alias(REASON), *keep)


# --- HTML ------------------------------------------------------------------

_BLOCKS = {
    "abstract": re.compile(r"abstract", re.I),
    "description": re.compile(r"description|detail", re.I),
    "claims": re.compile(r"claims?", re.I),
}
_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_SILENT = frozenset(("script", "style", "template"))
_BREAKING = frozenset(
    "address article aside blockquote body br dd div dl dt footer form h1 h2 h3 h4 h5 h6 head "
    "header hr html li main nav ol p pre section table td th title tr ul".split()
)
_HTML_PARTS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("title", *_BLOCKS, "plain")]
)


class _Page(HTMLParser):
    """Collects the text of the first title, of each first matching block, and of the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.found: dict[str, list[str]] = {}
        # Name of a part still being read, with the depth of the tag that opened it.
        self.reading: dict[str, int] = {}
        self.plain: list[str] = []

    def _begin(self, part: str) -> None:
        if part not in self.found:
            self.found[part] = []
            self.reading[part] = len(self.open)

    def handle_starttag(self, tag, attrs):
        if tag in _BREAKING:
            self.plain.append("\n")
        if tag in ("h1", "title"):
            self._begin("title")
        if tag in ("div", "section"):
            classes = dict(attrs).get("class") or ""
            for part, pattern in _BLOCKS.items():
                if pattern.search(classes):
                    self._begin(part)
        if tag not in _VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in _BREAKING:
            self.plain.append("\n")
        if tag in self.open:
            while self.open.pop() != tag:
                pass
            self._end_from(len(self.open))

    def _end_from(self, depth: int) -> None:
        self.reading = {p: d for p, d in self.reading.items() if d < depth}

    def handle_data(self, data):
        if self.open and self.open[-1] in _SILENT:
            return
        self.plain.append(data)
        for part in self.reading:
            self.found[part].append(data)


def _html_parts(html: str | None) -> dict:
    page = _Page()
    page.feed(html or "")
    page.close()
    parts = {name: "".join(pieces) for name, pieces in page.found.items()}
    return parts | {"plain": "".join(page.plain)}


@F.arrow_udf(_HTML_PARTS)
def _html_udf(html: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return _parts(html, _html_parts, _HTML_PARTS)


# The shapes a publication number may take, tried in this order.
ID_PATTERNS = (
    (r"(?i)US\d{7,}[A-Z]?\d*", 0),
    (r"(?i)Patent\s+No\.?\s*(\d+)", 1),
    (r"(?i)Publication\s+No\.?\s*(US\d+)", 1),
)
INVENTOR_PATTERNS = (r"(?i)\bInventors?:\s*([^,\n]+(?:,[^,\n]+)*)", r"(?i)\bBy:\s*([^,\n]+(?:,[^,\n]+)*)")
ASSIGNEE_PATTERNS = (r"(?i)\bAssignees?:\s*([^\n]+)", r"(?i)\bApplicants?:\s*([^\n]+)")
NO_NUMBER = "UNKNOWN"


def _first_match(c: Column, patterns: tuple[tuple[str, int], ...]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, group), F.lit("")) for p, group in patterns])


def extract_html(frame: DataFrame, html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """Records of a frame with one page per row."""
    p = frame.select(*keep, F.col(html).alias("_html"), _html_udf(F.col(html)).alias("p"))
    part = {n: F.col(f"p.{n}") for n in _HTML_PARTS.names}
    number = F.coalesce(_first_match(F.col("_html"), ID_PATTERNS), F.lit(NO_NUMBER))
    people = _first_match(part["plain"], tuple((x, 1) for x in INVENTOR_PATTERNS))
    owners = _first_match(part["plain"], tuple((x, 1) for x in ASSIGNEE_PATTERNS))
    fields = {
        "patent_id": number,
        "patent_number": number,
        "title": text.clean_text(part["title"]),
        "abstract": text.clean_text(part["abstract"]),
        "description": text.clean_text(part["description"]),
        "claims": text.extract_claims(part["claims"]),
        "inventors": text.extract_inventors(people),
        "assignees": text.extract_assignees(owners),
        "filing_date": F.lit(""),
        "publication_date": F.lit(""),
        "technology_field": F.lit(UNKNOWN_FIELD),
        "country": F.lit(DEFAULT_COUNTRY),
        "status": F.lit(DEFAULT_STATUS),
    }
    return p.select(*_record(fields), *keep).select(*RECORD_FIELDS, *keep)
