"""Files to raw frames: one row per stored record, before any defaults.

A raw frame has record columns (all of the file's own columns for CSV), `source_file`,
`seq` in reading order, and `reject_reason` where the reader found the row unusable.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.functions import text
from docketry.operators.normalize import REASON
from docketry.schema import LIST_FIELDS, RECORD_FIELDS
from docketry.session import saved, spread
from docketry.sources import elements, splits
from docketry.sources.splits import SOURCE, START

# Place of a row among those read, so that the last of two equal records is known: by file
# name, by the block of the file that a task read, by the row in it.
ORDER = "seq"
ORDER_TYPE = "struct<file: string, start: bigint, row: bigint>"
ROW = "block_row"
_BAD_ROW = "_bad_row"
_WRAPPERS = ("patents", "data", "results")
XML_ROW_TAGS = ("patent-document", "patent")


def _file() -> Column:
    return F.col("_metadata.file_path").alias(SOURCE)


def _block() -> Column:
    return F.col("_metadata.file_block_start").alias(START)


def in_order(raw: DataFrame) -> DataFrame:
    """With the place of each row. Numbers of rows grow within a block, whatever its task."""
    start = F.col(START) if START in raw.columns else F.lit(0).cast("long")
    row = F.col(ROW) if ROW in raw.columns else F.monotonically_increasing_id()
    place = F.struct(F.col(SOURCE).alias("file"), start.alias("start"), row.alias("row"))
    return raw.withColumn(ORDER, place).drop(START, ROW)


def _once(c: Column) -> Column:
    """The value, computed once for each row. Spark copies what makes a column into each filter on
    it, where a text would be parsed again for every use, but not past rows that are exploded."""
    return F.explode(F.array(c))


def _is_utf8(encoding: str) -> bool:
    return encoding.lower().replace("_", "-") in ("utf-8", "utf8")


def _declared(content: Column) -> Column:
    """The encoding that an XML file names in its first line or by a UTF-16 mark, else null."""
    head = F.decode(F.substring(content, 1, 200), "ISO-8859-1")
    named = F.upper(F.regexp_extract(head, r"""^\s*<\?xml[^>]*?encoding\s*=\s*["']([\w.-]+)["']""", 1))
    marked = F.hex(F.substring(content, 1, 2)).isin("FEFF", "FFFE")
    return F.when(marked, "UTF-16").otherwise(F.nullif(named, F.lit("")))


_BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def _whole_texts(reader, path: str | list[str], encoding: str, declared=None) -> DataFrame:
    """Each file as one text `value`. Bytes that are wrong in the encoding fail the job."""
    charset = F.lit(encoding.upper().replace("_", "-").replace("UTF8", "UTF-8"))
    stored = reader.schema(_BINARY).format("binaryFile").load(path)
    if declared is not None:
        charset = F.coalesce(declared(F.col("content")), charset)
    return stored.select(F.call_function("decode", "content", charset).alias("value"), _file())


def declared_texts(reader, path: str | list[str], xml: bool = False) -> DataFrame:
    """Each file as one text `value`, UTF-8 unless an XML file names another encoding; bytes
    that are wrong become replacement characters."""
    stored = reader.schema(_BINARY).format("binaryFile").load(path)
    charset = F.coalesce(_declared(F.col("content")), F.lit("UTF-8")) if xml else F.lit("UTF-8")
    lossy = F.decode("content", "UTF-8") if not xml else F.call_function("decode", "content", charset)
    return stored.select(lossy.alias("value"), _file())


def csv_scans(
    spark: SparkSession,
    path: str | list[str],
    encoding: str = "utf-8",
    strict: bool = False,
    multi_line: bool = True,
    glob: str = "*",
) -> list[DataFrame]:
    """A frame for each header of the CSV files below `path`; blank cells become empty text.

    A row longer than the header is set aside; `strict` sets shorter rows aside too. Files in
    UTF-8 are cut by Spark, also where cells hold line breaks (`multi_line`); those in another
    encoding that hold line breaks are read by one task each.
    """
    if multi_line and _is_utf8(encoding):
        found = []
        for layout in splits.layouts(spark, path, glob):
            stored = splits.rows(spark, layout, glob).withColumnRenamed("row", ROW)
            found.append(in_order(_cells(stored, layout.columns, strict)))
        return found
    reader = spark.read.options(encoding=encoding, multiLine=str(multi_line).lower(), pathGlobFilter=glob, **CSV_OPTIONS)
    found = []
    for paths in _by_header(spark, path, encoding, glob):
        found.append(in_order(csv_rows(reader, paths, reader.csv(paths).columns, strict)))
    return found


def _by_header(spark: SparkSession, path: str | list[str], encoding: str, glob: str) -> list[str | list[str]]:
    """The paths to read together: all of `path` where its CSV files have one header."""
    stored = spark.read.options(pathGlobFilter=glob, encoding=encoding, sep="\x01", quote="").schema("value string").csv(path)
    first = stored.select("value", _file(), _block(), F.monotonically_increasing_id().alias(ROW))
    heads = first.filter(F.col(START) == 0).groupBy(SOURCE).agg(F.min_by("value", ROW).alias("header"))
    headers = [r.header for r in heads.select("header").distinct().orderBy("header").collect()]
    if len(headers) < 2:
        return [path] if headers else []
    return [[r[0] for r in heads.filter(F.col("header") == h).select(SOURCE).orderBy(SOURCE).collect()] for h in headers]


def scan_csv(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """CSV files of one header (see csv_scans); files of several fail."""
    found = csv_scans(spark, path, **options)
    if len(found) != 1:
        raise ValueError(f"{len(found)} headers below {path}; read_csv takes files of several")
    return found[0]


def _cells(stored: DataFrame, columns: list[str], strict: bool) -> DataFrame:
    """Columns of the text of each row."""
    names = [f"c{i} string" for i in range(len(columns))]
    options = {"escape": '"', "multiLine": "true", "columnNameOfCorruptRecord": _BAD_ROW, "maxCharsPerColumn": "-1"}
    # A long row fills the spare column.
    cells = stored.select("*", _once(F.from_csv("value", ", ".join([*names, "more string"]), options)).alias("cells"))
    wrong = F.col("cells.more").isNotNull()
    if strict:
        exact = F.from_csv("value", ", ".join([*names, f"{_BAD_ROW} string"]), options)
        wrong = wrong | exact[_BAD_ROW].isNotNull()
    return cells.select(
        *[F.coalesce(F.col(f"cells.c{i}"), F.lit("")).alias(c) for i, c in enumerate(columns)],
        F.when(wrong, "width").alias(REASON),
        SOURCE, START, ROW,
    )


CSV_OPTIONS = {
    "header": "true",
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def csv_rows(reader, path: str | list[str], columns: list[str], strict: bool = False) -> DataFrame:
    """The rows that a batch or stream reader finds in files of this header."""
    layout = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = (
        reader.option("enforceSchema", "false")
        .option("columnPruning", "false")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _BAD_ROW)
        .schema(T.StructType([*layout.fields, T.StructField(_BAD_ROW, T.StringType())]))
        .csv(path)
    )
    if strict:
        wrong_width = F.col(_BAD_ROW).isNotNull()
    else:
        # Read the few odd rows again with one spare column: a long row fills it.
        spare = ", ".join(f"c{i} string" for i in range(len(columns) + 1))
        again = F.from_csv(_BAD_ROW, spare, {"escape": '"', "multiLine": "true"})
        wrong_width = again[f"c{len(columns)}"].isNotNull()
    return rows.select(
        *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns],
        F.when(wrong_width, "width").alias(REASON),
        _file(),
        _block(),
    )


def _variant_list(v: Column, name: str) -> Column:
    path = f"$.{name}"
    as_text = F.when(
        F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING",
        text.split_list(F.try_variant_get(v, path, "string")),
    )
    return F.coalesce(
        F.try_variant_get(v, path, "array<string>"), as_text, F.array().cast("array<string>")
    )


def json_elements(value: Column, strict: bool = True) -> Column:
    """The records of one JSON document, as an array of variants.

    A top-level list; or the first non-empty list under a wrapper key; or the document
    itself as the one record. `strict` fails the job on a text that is none of these.
    """
    wrapped = F.from_json(value, ", ".join(f"{w} array<variant>" for w in _WRAPPERS))
    single = F.when(
        F.from_json(value, "map<string,variant>").isNotNull(), F.array(F.try_parse_json(value))
    )
    found = F.coalesce(
        F.from_json(value, "array<variant>"),
        *[F.when(F.size(wrapped[w]) > 0, wrapped[w]) for w in _WRAPPERS],
        single,
    )
    if strict:
        return F.coalesce(found, F.raise_error(F.lit("not a JSON list or object")))
    return found


def _fields(found: DataFrame, on_unknown: str, ordered: bool = True) -> DataFrame:
    """Record columns of a frame of variants `v`; a stream's rows have no order yet."""
    v = F.col("v")
    keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    unknown = F.array_sort(F.array_except(keys, F.array(*[F.lit(c) for c in RECORD_FIELDS])))
    reason = F.when(keys.isNull(), "not an object")
    if on_unknown == "reject":
        reason = reason.when(F.size(unknown) > 0, F.concat(F.lit("unknown:"), F.concat_ws(",", unknown)))
    return (in_order(found) if ordered else found).select(
        *[
            _variant_list(v, c).alias(c)
            if c in LIST_FIELDS
            else F.try_variant_get(v, f"$.{c}", "string").alias(c)
            for c in RECORD_FIELDS
        ],
        reason.alias(REASON),
        SOURCE,
        *([ORDER] if ordered else []),
    )


def json_lines(reader, path: str | list[str], on_unknown: str = "reject", ordered: bool = True) -> DataFrame:
    """The records that a batch or stream reader finds in UTF-8 files of a record per line."""
    stored = reader.text(path).filter(F.trim("value") != "")
    return _fields(stored.select(_once(F.try_parse_json("value")).alias("v"), _file(), _block()), on_unknown, ordered)


def json_records(documents: DataFrame, on_unknown: str = "reject", strict: bool = True) -> DataFrame:
    """The raw frame of a frame with one JSON document per row in `value`."""
    found = F.explode(json_elements(F.col("value"), strict))
    return _fields(documents.select(found.alias("v"), SOURCE), on_unknown)


def scan_json(
    spark: SparkSession,
    path: str | list[str],
    encoding: str = "utf-8",
    lines: bool = False,
    on_unknown: str = "reject",
    glob: str = "*",
) -> DataFrame:
    """JSON documents, or one record per line with `lines`.

    Spark cuts documents in UTF-8 into their records; those in another encoding are read by
    one task each. A document that is no JSON fails the job, unless the session ignores corrupt
    files; as that takes a document as a whole, such a session reads each by one task, too.
    """
    reader = spark.read.option("pathGlobFilter", glob)
    if lines and _is_utf8(encoding):
        return json_lines(reader, path, on_unknown)
    if lines:
        # The text reader knows UTF-8 only, the JSON reader any encoding.
        stored = reader.options(encoding=encoding, lineSep="\n", singleVariantColumn="v").json(path)
        return _fields(stored.select("v", _file(), _block()), on_unknown)
    spark_skips = spark.conf.get("spark.sql.files.ignoreCorruptFiles", "false") == "true"
    if _is_utf8(encoding) and not spark_skips:
        stored = elements.records(spark, path, _WRAPPERS, glob).withColumnRenamed("row", ROW)
        # In brackets, so that text behind a value is found.
        one = F.get(F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<variant>"), F.lit(0))
        parsed = F.coalesce(one, F.when(F.col("value").isNotNull(), F.raise_error(F.lit("not a JSON list or object"))))
        return _fields(stored.select(parsed.alias("v"), SOURCE, START, ROW), on_unknown)
    return json_records(_whole_texts(reader, path, encoding), on_unknown, strict=not spark_skips)


def _tagged(value: Column, tag: str) -> Column:
    return F.regexp_extract_all(value, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>"), F.lit(0))


def cut_xml(reader, path: str | list[str], row_tag: str) -> DataFrame:
    """The elements of a name, found by a batch or stream reader that ends its lines at
    their closing tag."""
    closing = f"</{row_tag}>"
    opening = rf"(?s)<{row_tag}(?:\s[^>]*)?>.*"
    body = F.regexp_extract(F.concat("value", F.lit(closing)), opening, 0)
    pieces = reader.option("lineSep", closing).text(path)
    return pieces.select(_once(body).alias("xml"), _file(), _block()).filter(F.col("xml") != "")


def scan_xml(
    spark: SparkSession,
    path: str | list[str],
    encoding: str = "utf-8",
    row_tag: str | None = None,
    glob: str = "*",
) -> DataFrame:
    """The XML text of each record in a column `xml`.

    Without `row_tag` each file is looked at as a whole: its `patent-document` elements,
    else its `patent` elements, else each document it holds. Spark cuts files in UTF-8 whose
    elements follow each other; one task each reads files of other encodings, of neither element,
    or with an element that is not closed before the next one begins. With `row_tag` all files are
    cut at that closing tag, unseen; such files must be in UTF-8. For whole files the encoding
    that their first line names goes before `encoding`.
    """
    if row_tag:
        if not _is_utf8(encoding):
            raise ValueError("files cut at a row_tag must be in UTF-8; read others whole")
        return in_order(cut_xml(spark.read.option("pathGlobFilter", glob), path, row_tag))
    return reduce(DataFrame.unionByName, _xml_parts(spark, path, encoding, glob))


def whole_xml(reader, path: str | list[str], encoding: str = "utf-8") -> DataFrame:
    """The record elements of whole files, each file read by one task."""
    value = F.col("value")
    documents = F.when(
        F.contains(value, F.lit("<?xml")),
        F.filter(F.split(value, r"(?=<\?xml)"), lambda x: F.startswith(x, F.lit("<?xml"))),
    ).otherwise(F.array(value))
    found = documents
    for tag in reversed(XML_ROW_TAGS):
        tagged = _tagged(value, tag)
        found = F.when(F.size(tagged) > 0, tagged).otherwise(found)
    stored = _whole_texts(reader, path, encoding, _declared)
    return stored.select(F.explode(found).alias("xml"), SOURCE)


def _from_openings(reader, path: str | list[str], tag: str) -> DataFrame:
    """The text behind each `<tag` up to the next one; before these what a file begins with."""
    return reader.option("lineSep", f"<{tag}").text(path)


def _xml_kinds(reader, path: str | list[str], tag: str) -> DataFrame:
    """For each file whether no element of the name begins in it (`none`), or each ends before the
    next one begins (`cut`; the last may lack its end), or neither can be said (`odd`)."""
    value = F.col("value")
    begins = F.substring(value, 1, 1).rlike(r"[\s>]")
    ends = F.when(begins, value.rlike(rf"(?s)^(?:\s[^>]*)?>.*?</{tag}\s*>")).otherwise(False)
    place = F.struct(START, ROW)
    told = _from_openings(reader, path, tag).select(
        _file(), _block(), F.monotonically_increasing_id().alias(ROW), F.is_valid_utf8(value).alias("valid"),
        begins.alias("begins"), ends.alias("ends"), F.contains(value, F.lit(f"</{tag}")).alias("closing"),
        F.when(F.col("_metadata.file_block_start") == 0, F.substring(value.cast("binary"), 1, 200)).alias("head"),
    ).groupBy(SOURCE).agg(
        F.min_by(F.struct("begins", "closing", "head"), place).alias("first"),
        F.max_by(F.col("begins") & ~F.col("ends"), place).alias("last_is_open"),
        F.count_if("begins").alias("begins"), F.count_if("ends").alias("ends"), F.bool_and("valid").alias("valid"),
    )
    n = F.col("begins") - F.col("first.begins").cast("int")
    unclosed = n - F.col("ends")
    plain = F.coalesce(_declared(F.col("first.head")), F.lit("UTF-8")).isin("UTF-8", "UTF8") & F.col("valid")
    return told.select(SOURCE, F.when(~plain, "odd").when(n == 0, "none").when(
        ~F.col("first.closing") & (F.col("ends") > 0) & ((unclosed == 0) | ((unclosed == 1) & F.col("last_is_open"))), "cut"
    ).otherwise("odd").alias("kind"))


def _xml_parts(spark: SparkSession, path: str | list[str], encoding: str, glob: str) -> list[DataFrame]:
    """What `whole_xml` finds, cut by Spark in the files where that gives the same elements. A
    first reading tells these files; names are fetched only where files differ."""
    reader = spark.read.option("pathGlobFilter", glob)
    parts, whole, left = [], [], path
    for tag in XML_ROW_TAGS if _is_utf8(encoding) else ():
        told = saved(_xml_kinds(spark.read.option("pathGlobFilter", glob), left, tag), "xml-files")
        kinds = {r.kind for r in told.select("kind").distinct().collect()}
        files = {k: left if len(kinds) == 1 else [r[0] for r in told.filter(F.col("kind") == k).select(SOURCE).orderBy(SOURCE).collect()] for k in kinds}
        if "cut" in files:
            pieces = _from_openings(spark.read.option("pathGlobFilter", glob), files["cut"], tag)
            element = F.regexp_extract(F.concat(F.lit(f"<{tag}"), "value"), rf"(?s)^<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>", 0)
            parts.append(in_order(pieces.select(_once(element).alias("xml"), _file(), _block()).filter(F.col("xml") != "")))
        if "odd" in files:
            whole.append(files["odd"])
        left = files.get("none", None if kinds else left)
        if left is None:
            break
    if left is not None:
        whole.append(left)
    # The elements of a whole file come out of one task.
    return parts + [spread(in_order(whole_xml(reader, files, encoding))) for files in whole]
