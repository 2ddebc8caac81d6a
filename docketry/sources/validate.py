"""What is wrong with the files of a folder, file by file."""

from __future__ import annotations

from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators.normalize import REASON
from docketry.schema import RECOMMENDED_FIELDS, REQUIRED_FIELDS
from docketry.sources.load import SUPPORTED, any_case, list_files
from docketry.sources.scan import SOURCE, csv_scans, declared_texts

WRAPPERS = ("patents", "data", "results")
FOUND = f"{SOURCE} string, errors array<string>, warnings array<string>, suggestions array<string>, records bigint"


def _some(*findings: Column) -> Column:
    """The findings that are not null, as a list."""
    return F.filter(F.array(*findings, F.lit(None).cast("string")), lambda x: x.isNotNull())


def csv_findings(spark: SparkSession, path: str, glob: str) -> list[DataFrame]:
    """Columns from the header of a file, the rest over all its rows."""
    parts = []
    for raw in csv_scans(spark, path, glob=glob):
        missing = [c for c in REQUIRED_FIELDS if c not in raw.columns]
        advised = [c for c in RECOMMENDED_FIELDS if c not in raw.columns]
        patent_id = F.col("patent_id") if "patent_id" in raw.columns else F.lit(None).cast("string")
        # Counted per file and id first, so that a heavy id is folded before it is shuffled.
        per_id = raw.groupBy(SOURCE, patent_id.alias("id")).agg(F.count("*").alias("n"), F.count(REASON).alias("wide"))
        per_file = per_id.groupBy(SOURCE).agg(
            F.sum("n").alias("records"),
            F.sum("wide").alias("wide"),
            F.coalesce(F.sum(F.when(F.col("id") == "", F.col("n"))), F.lit(0)).alias("blank"),
            F.coalesce(F.sum(F.when(F.col("id") != "", F.col("n") - 1)), F.lit(0)).alias("again"),
        )
        parts.append(per_file.select(
            SOURCE,
            _some(
                F.lit("missing required columns: " + ", ".join(missing)) if missing else F.lit(None),
                F.when(F.col("wide") > 0, "rows longer than the header"),
            ).alias("errors"),
            _some(
                F.lit("missing recommended columns: " + ", ".join(advised)) if advised else F.lit(None),
                F.when(F.col("blank") > 0, "missing patent ids"),
                F.when(F.col("again") > 0, "duplicate patent ids"),
            ).alias("warnings"),
            _some(F.lit("add columns for better search results") if advised else F.lit(None)).alias("suggestions"),
            "records",
        ))
    return parts


def _items(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def json_findings(value: Column) -> tuple[Column, Column]:
    """The error of a JSON document, null if it has none, and how many records it holds.

    Records are the elements of a list; or those of the first list or object that is not empty
    under a wrapper key; or the document itself. The first one stands for all.
    """
    v = F.try_parse_json(value)
    fields = F.try_variant_get(v, "$", "map<string,variant>")
    listed = _items(v)
    under = [F.coalesce(F.when(F.size(_items(v, f"$.{w}")) > 0, _items(v, f"$.{w}")),
                        F.when(F.size(F.map_keys(F.try_variant_get(v, f"$.{w}", "map<string,variant>"))) > 0,
                               F.array(F.try_variant_get(v, f"$.{w}", "variant")))) for w in WRAPPERS]
    records = F.when(listed.isNotNull(), listed).when(fields.isNotNull(), F.coalesce(*under, F.array(v)))
    keys = F.map_keys(F.try_variant_get(F.get(records, F.lit(0)), "$", "map<string,variant>"))
    missing = F.array(*[F.when(~F.array_contains(keys, c), c) for c in REQUIRED_FIELDS])
    missing = F.array_join(F.filter(missing, lambda x: x.isNotNull()), ", ")
    error = (
        F.when(v.isNull(), "invalid JSON")
        .when(listed.isNotNull() & (F.size(listed) == 0), "empty list")
        .when(records.isNull(), "neither a list nor an object")
        .when(keys.isNull(), "records must be objects")
        .when(missing != "", F.concat(F.lit("missing fields: "), missing))
    )
    return error, F.size(records).cast("bigint")


def json_files(spark: SparkSession, path: str, glob: str) -> list[DataFrame]:
    """Whole files; one of more than 2 GB fails."""
    stored = declared_texts(spark.read.option("pathGlobFilter", glob), path)
    error, records = json_findings(F.col("value"))
    none = F.array().cast("array<string>")
    told = stored.select(SOURCE, error.alias("error"), records.alias("records"))
    return [told.select(SOURCE, _some(F.col("error")).alias("errors"), none.alias("warnings"), none.alias("suggestions"), F.when(F.col("records") >= 0, F.col("records")).alias("records"))]


#: Bytes of XML given to the parser at once.
_FED = 1 << 20


class _Nothing:
    """What a parser builds where only its errors count."""

    def close(self) -> None:
        return None


def _xml_error(documents: pa.Array) -> pa.Array:
    """Why a text is no well-formed XML document; null if it is. A text is fed to the parser in
    pieces and no tree is built, so that nothing of its own size is made."""
    out = []
    for document in documents:
        parser = ElementTree.XMLParser(target=_Nothing(), encoding="utf-8")
        text = memoryview(document.as_buffer() if document.is_valid else b"")
        try:
            for at in range(0, len(text), _FED):
                parser.feed(text[at : at + _FED])
            parser.close()
            out.append(None)
        except ElementTree.ParseError as e:
            out.append(f"invalid XML: {ElementTree.ParseError.__name__} {e.code} in line {e.position[0]}")
        except ValueError as e:  # a declared encoding where the text is decoded already
            out.append(f"invalid XML: {e}")
    return pa.array(out, pa.string())


def xml_files(spark: SparkSession, path: str, glob: str) -> list[DataFrame]:
    stored = declared_texts(spark.read.option("pathGlobFilter", glob), path, xml=True)
    # The text is decoded, so a declaration in its head says nothing more.
    body = F.regexp_replace("value", r"^\x{FEFF}?\s*<\?xml[^>]*\?>", "")
    elements = F.regexp_count(F.lower("value"), F.lit(r"<patent(-document)?[\s/>]"))
    told = stored.select(SOURCE, F.arrow_udf(_xml_error, "string")(body).alias("error"), F.contains(F.lower("value"), F.lit("<patent")).alias("named"), elements.cast("bigint").alias("records"))
    none = F.array().cast("array<string>")
    return [told.select(
        SOURCE, _some(F.col("error")).alias("errors"),
        _some(F.when(~F.col("named") & F.col("error").isNull(), "no patent elements")).alias("warnings"),
        none.alias("suggestions"), "records",
    )]


_CHECKS = {"csv": csv_findings, "json": json_files, "xml": xml_files}


def validate_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """One row for each file directly below a folder: source_file, file_name, format, is_valid,
    errors, warnings, suggestions, records.

    A file is valid if it has no error. CSV: required and recommended columns, over-long rows,
    blank and repeated ids, of all rows. JSON: that it parses, its structure, the fields of the
    first record. XML: that it is well-formed, whether it names patents. Files of other suffixes
    and CSV files without a row below their header are in error. Files
    without a byte are not listed by Spark and get no row. `records` is null where nothing can be counted.
    """
    files = list_files(spark, path, pattern)
    suffixes = {r.suffix for r in files.filter(F.col("suffix").isin(*SUPPORTED)).select("suffix").distinct().collect()}
    found = spark.createDataFrame([], FOUND)
    for suffix in sorted(suffixes):
        for part in _CHECKS[SUPPORTED[suffix]](spark, f"{path}/*.{any_case(suffix)}", pattern):
            found = found.unionByName(part)
    joined = files.join(found, SOURCE, "left")
    unread = F.when(~F.col("suffix").isin(*SUPPORTED), F.concat(F.lit("unsupported format: "), "suffix")).otherwise(
        F.when(F.col("suffix") == "csv", "no rows")
    )
    errors = F.coalesce("errors", _some(unread))
    none = F.array().cast("array<string>")
    return joined.select(
        SOURCE, "file_name", F.col("suffix").alias("format"), (F.size(errors) == 0).alias("is_valid"), errors.alias("errors"),
        F.coalesce("warnings", none).alias("warnings"), F.coalesce("suggestions", none).alias("suggestions"), "records",
    )
