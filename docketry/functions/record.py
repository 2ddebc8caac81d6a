"""Texts and keys derived from one record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.schema import RECORD_FIELDS, RECORD_SCHEMA

TEXT_CLAIMS = 3
TEXT_DESCRIPTION = 1000
TEXT_INVENTORS = 3
TEXT_ASSIGNEES = 2
PREVIEW = 200


def _labelled(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), value)


def _body(field_label: str) -> list[Column]:
    return [
        _labelled("Title", F.col("title")),
        _labelled("Abstract", F.col("abstract")),
        _labelled(field_label, F.col("technology_field")),
        _labelled("Claims", F.concat_ws(" ", F.slice("claims", 1, TEXT_CLAIMS))),
        _labelled("Description", F.substring("description", 1, TEXT_DESCRIPTION)),
    ]


def _people(label: str, names: str, most: int) -> Column:
    return F.when(F.size(names) > 0, _labelled(label, F.concat_ws(", ", F.slice(names, 1, most))))


def combined_text() -> Column:
    """The text a record is embedded by."""
    return F.concat_ws(
        " ",
        *_body("Technology Field"),
        _people("Inventors", "inventors", TEXT_INVENTORS),
        _people("Assignees", "assignees", TEXT_ASSIGNEES),
    )


def searchable_text() -> Column:
    return F.concat_ws(" ", *_body("Technology"))


def metadata_text() -> Column:
    return F.concat_ws(
        " ",
        _labelled("Inventors", F.concat_ws(", ", "inventors")),
        _labelled("Assignees", F.concat_ws(", ", "assignees")),
        _labelled("Classification", F.concat_ws(", ", "classification_codes")),
        _labelled("Country", F.col("country")),
        _labelled("Status", F.col("status")),
    )


def main_classification() -> Column:
    return F.get("classification_codes", F.lit(0))


def ipc_section() -> Column:
    return F.nullif(F.substring(main_classification(), 1, 1), F.lit(""))


def point_id() -> Column:
    """Key of a record in a collection; a changed title is another key."""
    return F.md5(F.concat(F.col("patent_id"), F.lit("_"), F.col("title")))


def to_json() -> Column:
    """The whole record as one JSON text; absent values are written as null."""
    return F.to_json(F.struct(*RECORD_FIELDS), {"ignoreNullFields": "false"})


def from_json(c: Column) -> Column:
    return F.from_json(c, RECORD_SCHEMA)


def abstract_preview() -> Column:
    return F.when(
        F.length("abstract") > PREVIEW,
        F.concat(F.substring("abstract", 1, PREVIEW), F.lit("...")),
    ).otherwise(F.col("abstract"))
