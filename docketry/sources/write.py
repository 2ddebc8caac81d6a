"""Records to files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.schema import LIST_FIELDS, RECORD_FIELDS


def write_csv(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One `|`-joined cell per list, so that reading the file gives the lists back."""
    flat = records.select(*[
        F.concat_ws("|", c).alias(c) if c in LIST_FIELDS else F.col(c) for c in RECORD_FIELDS
    ])
    flat.write.mode(mode).csv(
        path,
        header=True,
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def write_json(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One record per line."""
    records.select(*RECORD_FIELDS).write.mode(mode).json(path, ignoreNullFields=False)


def write_parquet(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    records.select(*RECORD_FIELDS).write.mode(mode).parquet(path)


WRITERS = {"csv": write_csv, "json": write_json, "parquet": write_parquet}
