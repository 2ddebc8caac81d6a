"""Deterministic sample records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.schema import (
    DEFAULT_COUNTRY,
    RECORD_FIELDS,
    SAMPLE_ABSTRACT,
    SAMPLE_CLAIMS,
    SAMPLE_CODES,
    SAMPLE_COMPANIES,
    SAMPLE_DESCRIPTION,
    SAMPLE_FIELDS,
    SAMPLE_INVENTORS,
)

FIRST_NUMBER = 10_000_000
FIRST_APPLICATION = 16_000_000


def _pick(values, i: Column) -> Column:
    literals = [F.array(*map(F.lit, v)) if isinstance(v, tuple) else F.lit(v) for v in values]
    return F.element_at(F.array(*literals), (i % len(values) + 1).cast("int"))


def sample_record(i: Column) -> list[Column]:
    """The record numbered `i`, from 0."""
    field = _pick(SAMPLE_FIELDS, i)

    def fill(template: str) -> Column:
        return F.replace(F.lit(template), F.lit("{field}"), F.lower(field))

    month_day = F.concat(
        F.lit("-"), F.lpad((i % 12 + 1).cast("string"), 2, "0"),
        F.lit("-"), F.lpad((i % 28 + 1).cast("string"), 2, "0"),
    )
    number = F.concat(F.lit("US"), (i + FIRST_NUMBER).cast("string"))
    values = {
        "patent_id": number,
        "patent_number": number,
        "title": F.concat(F.lit("Advanced "), field, F.lit(" System and Method "), (i + 1).cast("string")),
        "abstract": fill(SAMPLE_ABSTRACT),
        "description": fill(SAMPLE_DESCRIPTION),
        "claims": F.array(*[fill(c) for c in SAMPLE_CLAIMS]),
        "inventors": F.array(_pick(SAMPLE_INVENTORS, i), _pick(SAMPLE_INVENTORS, i + 1)),
        "assignees": F.array(_pick(SAMPLE_COMPANIES, i)),
        "filing_date": F.concat((F.lit(2023) - i % 4).cast("string"), month_day),
        "publication_date": F.concat((F.lit(2024) - i % 4).cast("string"), month_day),
        "classification_codes": _pick(SAMPLE_CODES, i),
        "technology_field": field,
        "country": F.lit(DEFAULT_COUNTRY),
        "status": F.when(i % 5 == 0, "Granted").otherwise("Published"),
        "application_number": F.concat(F.lit("US"), (i + FIRST_APPLICATION).cast("string")),
        "legal_status": F.lit("Active"),
        "citations": F.array().cast("array<string>"),
        "cited_by": F.array().cast("array<string>"),
    }
    return [values.get(c, F.lit(None).cast("string")).alias(c) for c in RECORD_FIELDS]


def sample_records(spark: SparkSession, n: int = 50) -> DataFrame:
    return spark.range(n).select(*sample_record(F.col("id")))
