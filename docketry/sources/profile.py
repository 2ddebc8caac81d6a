"""What is in a folder of files, and how good the rows are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators.normalize import REASON
from docketry.schema import RECOMMENDED_FIELDS, REQUIRED_FIELDS
from docketry.sources.load import SUPPORTED, any_case, list_files
from docketry.sources.scan import ORDER, SOURCE, csv_scans, json_elements


def file_profile(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """One row per file: name, size, suffix, supported or not, columns, record count.

    Records are counted for CSV and JSON, and columns are named for CSV.
    """
    files = list_files(spark, path, pattern)
    suffixes = {r.suffix for r in files.select("suffix").filter(F.col("suffix").isin("csv", "json")).distinct().collect()}
    counts = None
    for suffix in sorted(suffixes):
        at = f"{path}/*.{any_case(suffix)}"
        if suffix == "csv":
            part = None
            for rows in csv_scans(spark, at, glob=pattern):
                names = [c for c in rows.columns if c not in (SOURCE, ORDER, REASON)]
                columns = F.array(*[F.lit(c) for c in names])
                counted = rows.groupBy(SOURCE).agg(F.count("*").alias("records")).withColumn("columns", columns)
                part = counted if part is None else part.unionByName(counted)
        else:
            stored = spark.read.option("pathGlobFilter", pattern).text(at, wholetext=True)
            size = F.size(json_elements(F.col("value"), strict=False))
            part = stored.select(
                F.col("_metadata.file_path").alias(SOURCE),
                F.when(size >= 0, size).cast("bigint").alias("records"),
                F.lit(None).cast("array<string>").alias("columns"),
            )
        if part is not None:
            counts = part if counts is None else counts.unionByName(part)
    if counts is None:
        counts = spark.createDataFrame([], f"{SOURCE} string, records bigint, columns array<string>")
    return files.join(counts, SOURCE, "left").select(
        "file_name", "file_size", "suffix", F.col("suffix").isin(*SUPPORTED).alias("supported"),
        "records", "columns",
    )


def quality_report(raw: DataFrame) -> DataFrame:
    """Findings over all rows: severity, check, detail, and the rows concerned."""
    have = [c for c in REQUIRED_FIELDS if c in raw.columns]
    blank = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) == "" for c in have}
    patent_id = F.col("patent_id") if "patent_id" in have else F.lit(None).cast("string")
    # Counted per id first, so that a heavy id is folded before it is shuffled.
    per_id = raw.groupBy(patent_id.alias("id")).agg(
        F.count("*").alias("n"),
        *[F.count_if(condition).alias(f"blank_{c}") for c, condition in blank.items()],
    )
    totals = per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(F.coalesce("id", F.lit("")) != "", F.col("n") - 1)), F.lit(0)).alias("duplicates"),
        *[F.coalesce(F.sum(f"blank_{c}"), F.lit(0)).alias(f"blank_{c}") for c in have],
    )

    def finding(severity: str, check: str, detail: str, n):
        return F.struct(
            F.lit(severity).alias("severity"), F.lit(check).alias("check"),
            F.lit(detail).alias("detail"), n.cast("bigint").alias("n"),
        )

    findings = [
        finding("error", "missing required column", c, F.col("n")) for c in REQUIRED_FIELDS if c not in have
    ]
    recommended = [c for c in RECOMMENDED_FIELDS if c not in raw.columns]
    findings += [finding("warning", "missing recommended column", c, F.col("n")) for c in recommended]
    if recommended:
        findings.append(finding("suggestion", "add columns", ",".join(recommended), F.col("n")))
    kept = F.filter(
        F.array(
            finding("warning", "duplicate id", "patent_id", F.col("duplicates")),
            *[finding("warning", "missing value", c, F.col(f"blank_{c}")) for c in have],
        ),
        lambda x: x["n"] > 0,
    )
    empty = F.when(F.col("n") == 0, F.array(finding("error", "no rows", "", F.col("n"))))
    everything = F.concat(
        *([F.array(*findings)] if findings else []), kept, F.coalesce(empty, F.slice(kept, 1, 0))
    )
    return totals.select(F.inline(everything))
