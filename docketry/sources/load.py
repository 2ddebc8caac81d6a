"""Files to records: the readers a caller uses."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators.normalize import REASON, accepted, enhance, normalize, rejected
from docketry.schema import RECORD_FIELDS
from docketry.session import spread
from docketry.sources.markup import extract_xml
from docketry.sources.scan import ORDER, ORDER_TYPE, SOURCE, csv_scans, scan_json, scan_xml

SUPPORTED = {"csv": "csv", "json": "json", "xml": "xml", "rdf": "xml"}


class Loaded(NamedTuple):
    """Records ready for a collection, with `seq` in reading order, and the rows set aside
    with `reject_reason`."""

    records: DataFrame
    rejects: DataFrame


def _loaded(raw: DataFrame, on_unknown: str) -> Loaded:
    normalized = normalize(raw, on_unknown, keep=(SOURCE, ORDER))
    return Loaded(enhance(accepted(normalized).drop(SOURCE)), rejected(normalized))


def read_csv(
    spark: SparkSession, path: str | list[str], on_unknown: str = "reject", multi_line: bool = True, **options
) -> Loaded:
    """Files of different headers are read by header, each by its own; no files give no rows."""
    parts = [_loaded(raw, on_unknown) for raw in csv_scans(spark, path, multi_line=multi_line, **options)]
    return _together(parts) if parts else nothing_loaded(spark)


def _together(parts: list[Loaded]) -> Loaded:
    return Loaded(*(reduce(DataFrame.unionByName, side) for side in zip(*parts)))


def nothing_loaded(spark: SparkSession) -> Loaded:
    nothing = spark.createDataFrame([], ", ".join([*(f"{c} string" for c in RECORD_FIELDS), f"{SOURCE} string", f"{ORDER} {ORDER_TYPE}"]))
    return _loaded(nothing, "reject")


def read_json(
    spark: SparkSession, path: str | list[str], on_unknown: str = "reject", lines: bool = False, **options
) -> Loaded:
    raw = scan_json(spark, path, lines=lines, on_unknown=on_unknown, **options)
    return _loaded(raw if lines else spread(raw), on_unknown)


def read_xml(spark: SparkSession, path: str | list[str], row_tag: str | None = None, **options) -> Loaded:
    """XML fields are cleaned as they are extracted and get no further treatment."""
    found = extract_xml(scan_xml(spark, path, row_tag=row_tag, **options), keep=(SOURCE, ORDER))
    return Loaded(accepted(found).drop(SOURCE), rejected(found))


_READERS = {"csv": read_csv, "json": read_json, "xml": read_xml}


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Names, sizes and suffixes of the files directly below a folder, unread."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    name = F.col("_metadata.file_name")
    return listed.select(
        F.col("_metadata.file_path").alias(SOURCE),
        name.alias("file_name"),
        F.col("_metadata.file_size").alias("file_size"),
        F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("suffix"),
    )


def any_case(suffix: str) -> str:
    return "".join(f"[{c}{c.upper()}]" for c in suffix)


def read_directory(
    spark: SparkSession, path: str, pattern: str = "*", on_unknown: str = "reject", options: dict[str, dict] | None = None
) -> Loaded:
    """Every supported file of a folder by its suffix; other files become rejects.

    `options` has for "csv", "json" and "xml" those of the reader (`encoding`, `lines`, `row_tag`
    and so on). The place of a record (`seq`) goes by file name over all formats.
    """
    files = list_files(spark, path, pattern)
    known = F.col("suffix").isin(*SUPPORTED)
    suffixes = {r.suffix for r in files.filter(known).select("suffix").distinct().collect()}
    places = {s: f"{path}/*.{any_case(s)}" for s in suffixes}
    unsupported = files.filter(~known).select(SOURCE, F.concat(F.lit("unsupported:"), "suffix").alias(REASON))
    return _by_suffix(spark, places, unsupported, on_unknown, options, pattern)


def read_files(
    spark: SparkSession, paths: list[str], on_unknown: str = "reject", options: dict[str, dict] | None = None
) -> Loaded:
    """As read_directory, of the files that are named."""
    places: dict[str, list[str]] = {}
    for path in paths:
        name = path.rsplit("/", 1)[-1]
        places.setdefault(name.rsplit(".", 1)[-1].lower() if "." in name else "", []).append(path)
    others = [(path, f"unsupported:{s}") for s in places if s not in SUPPORTED for path in places[s]]
    unsupported = spark.createDataFrame(others, f"{SOURCE} string, {REASON} string")
    return _by_suffix(spark, {s: p for s, p in places.items() if s in SUPPORTED}, unsupported, on_unknown, options, "*")


def _by_suffix(
    spark: SparkSession, places: dict[str, str | list[str]], unsupported: DataFrame, on_unknown: str, options: dict[str, dict] | None, pattern: str
) -> Loaded:
    if unknown := (options or {}).keys() - _READERS.keys():
        raise ValueError(f"no reader for {sorted(unknown)}")
    parts = []
    for suffix, path in sorted(places.items()):
        reader = _READERS[SUPPORTED[suffix]]
        chosen = {"glob": pattern} | ({} if reader is read_xml else {"on_unknown": on_unknown}) | (options or {}).get(SUPPORTED[suffix], {})
        parts.append(reader(spark, path, **chosen))
    if not parts:
        return Loaded(nothing_loaded(spark).records, unsupported)
    records, rejects = _together([Loaded(p.records, p.rejects.select(SOURCE, REASON)) for p in parts])
    return Loaded(records, rejects.unionByName(unsupported))
