"""Raw columns to records: defaults, list cells, trimming, required fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.functions import classify, record, text
from docketry.schema import (
    DEFAULT_COUNTRY,
    DEFAULT_STATUS,
    LIST_FIELDS,
    OPTIONAL_FIELDS,
    RECORD_FIELDS,
    TEXT_FIELDS,
    UNKNOWN_FIELD,
)

REASON = "reject_reason"
MIN_CLAIM = 10

_DEFAULTS = {
    "technology_field": UNKNOWN_FIELD,
    "country": DEFAULT_COUNTRY,
    "status": DEFAULT_STATUS,
}


def _text_field(raw: DataFrame, name: str) -> Column:
    default = F.lit(_DEFAULTS.get(name, ""))
    if name == "patent_number":
        default = F.coalesce(F.col("patent_id").cast("string"), F.lit(""))
    if name not in raw.columns:
        return text.strip(default)
    return text.strip(F.coalesce(F.col(name).cast("string"), default))


def _list_field(raw: DataFrame, name: str) -> Column:
    empty = F.array().cast("array<string>")
    if name not in raw.columns:
        return empty
    kind = raw.schema[name].dataType
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.col(name).cast("array<string>"), empty)
    return text.split_list(F.col(name).cast("string"))


def normalize(raw: DataFrame, on_unknown: str = "reject", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every raw row as a record with a `reject_reason`, null where the record is good.

    A raw frame that already carries `reject_reason` (from its reader) keeps it.
    `on_unknown` says whether a column outside the record layout spoils its rows, as a
    reader of fixed fields has it, or is left out (`ignore`). `keep` names columns that
    pass through.
    """
    if on_unknown not in ("reject", "ignore"):
        raise ValueError("on_unknown is 'reject' or 'ignore'")
    known = {*RECORD_FIELDS, REASON, *keep}
    unknown = [c for c in raw.columns if c not in known]

    def absent(name: str) -> Column:
        if name not in raw.columns:
            return F.lit(True)
        return F.coalesce(F.col(name).cast("string"), F.lit("")) == ""

    reason = F.col(REASON) if REASON in raw.columns else F.lit(None).cast("string")
    reason = F.coalesce(
        reason,
        F.when(absent("patent_id"), "required:patent_id"),
        F.when(absent("title"), "required:title"),
        # A blank id passes the first test and fails once it is trimmed.
        F.when(text.strip(F.col("patent_id").cast("string")) == "", "required:patent_id")
        if "patent_id" in raw.columns
        else F.lit(None).cast("string"),
        F.lit("unknown:" + ",".join(unknown)) if unknown and on_unknown == "reject" else F.lit(None),
    )
    if "patent_id" not in raw.columns:
        raw = raw.withColumn("patent_id", F.lit(None).cast("string"))

    fields = {name: _text_field(raw, name) for name in TEXT_FIELDS}
    fields |= {name: _list_field(raw, name) for name in LIST_FIELDS}
    fields |= {
        name: F.col(name).cast("string") if name in raw.columns else F.lit(None).cast("string")
        for name in OPTIONAL_FIELDS
    }
    rows = raw.select(
        *[fields[name].alias(name) for name in RECORD_FIELDS],
        reason.alias(REASON),
        *[F.col(c) for c in keep],
    )
    return rows.withColumn(
        "technology_field",
        F.when(
            F.col("technology_field") == UNKNOWN_FIELD,
            classify.classify_ipc(F.col("classification_codes")),
        ).otherwise(F.col("technology_field")),
    )


def accepted(normalized: DataFrame) -> DataFrame:
    return normalized.filter(F.col(REASON).isNull()).drop(REASON)


def rejected(normalized: DataFrame) -> DataFrame:
    return normalized.filter(F.col(REASON).isNotNull())


def enhance(records: DataFrame) -> DataFrame:
    """Settle the technology field, then clean the texts and claims.

    The field is read off the texts as they came in, so it is settled first.
    """
    content = classify.classified_content(F.col("title"), F.col("abstract"), F.col("claims"))
    field = classify.resolve_field(F.col("technology_field"), F.col("classification_codes"), content)
    claims = F.filter(text.clean_each(F.col("claims")), lambda x: F.length(x) > MIN_CLAIM)
    return records.withColumns({
        "technology_field": field,
        "title": text.clean_text(F.col("title")),
        "abstract": text.clean_text(F.col("abstract")),
        "description": text.clean_text(F.col("description")),
        "claims": claims,
    })


def embed(records: DataFrame, embedder) -> DataFrame:
    """Records with their point id and the vector of their combined text."""
    return records.withColumn("point_id", record.point_id()).withColumn(
        "vector", embedder.column(record.combined_text())
    )
