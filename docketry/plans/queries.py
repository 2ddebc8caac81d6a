"""The registered queries: each runs one operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import classify, record, text
from docketry.functions import filters as P
from docketry.functions.vectors import HashingEmbedder, cosine
from docketry.operators import changes, neighbours, stats
from docketry.operators import search as S
from docketry.operators.cells import build_cells, search_cells
from docketry.operators.normalize import accepted, embed, enhance, normalize
from docketry.operators.weights import embed_tfidf
from docketry.plans.collection import Collection, first_points
from docketry.plans.tables import (
    EMBEDDING_DIM,
    csv_folder,
    hashed_points,
    mixed_folder,
    plain_records,
    records,
    spread_records,
    stored_points,
    table,
    texts,
    write_xml,
    xml_layout,
)
from docketry.schema import LIST_FIELDS, RECORD_FIELDS, RECORD_SCHEMA, SAVED_QUERIES
from docketry.session import fresh_folder, saved, spread_if_narrow
from docketry.sources import validate
from docketry.sources.load import read_csv, read_directory, read_json, read_xml
from docketry.sources.markup import extract_html, extract_xml
from docketry.sources.profile import file_profile, quality_report
from docketry.sources.sample import sample_record
from docketry.sources.scan import ORDER, SOURCE, json_records, scan_csv
from docketry.sources.write import write_csv, write_json
from docketry.streaming import loads
from docketry.streaming.loads import stream_raw, stream_records, upsert_stream, write_records

Query = Callable[[SparkSession, str], DataFrame]

# Query texts of the search queries; the oracle uses the same ones.
ENGLISH = "the of and with that for in on are to"
FRENCH = "les des que de la le une dans elle"
SEARCH_FIELD = "Physics"
PREVIEW_LIMIT = 20
SIMILAR_TO = "D0"
CELLS = 16
EXPORTED = 300

_REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    """Register under the function's name; a final `_` only keeps it from an import."""
    _REGISTRY[f.__name__.rstrip("_")] = f
    return f


def all_queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def _flat(frame: DataFrame, *columns: str) -> DataFrame:
    """Lists as one text each."""
    return frame.select(*[
        F.concat_ws("|", c).alias(c) if c in LIST_FIELDS else F.col(c) for c in columns or frame.columns
    ])


_MAIN = ("patent_id", "title", "abstract", "description", "claims", "inventors", "assignees",
         "filing_date", "classification_codes", "technology_field", "country", "status")


# --- sources ---------------------------------------------------------------


@query
def src_csv(spark, sf):
    return _flat(read_csv(spark, csv_folder(spark, sf)).records, *_MAIN)


@query
def src_json_lines(spark, sf):
    path = fresh_folder(spark, "json")
    write_json(plain_records(spark, sf), path)
    return _flat(read_json(spark, path, lines=True).records, *_MAIN)


@query
def src_json(spark, sf):
    """Every record inside a document of its own, in one of the accepted shapes."""
    source = spread_records(spark, sf).withColumn("technology_field", F.lit("Unknown"))
    one = F.to_json(F.struct(*RECORD_FIELDS))
    shapes = [
        F.concat(F.lit("["), one, F.lit(', 5, "text"]')),
        F.concat(F.lit('{"patents": ['), one, F.lit("]}")),
        F.concat(F.lit('{"patents": [], "data": ['), one, F.lit("]}")),
        F.concat(F.lit('{"results": ['), one, F.lit("]}")),
        one,
    ]
    shape = F.element_at(F.array(*shapes), (F.col("doc_id") % len(shapes) + 1).cast("int"))
    raw = json_records(source.select(shape.alias("value"), F.lit("").alias(SOURCE)))
    return _flat(enhance(accepted(normalize(raw, keep=(SOURCE, ORDER)))), *_MAIN)


@query
def src_json_array(spark, sf):
    """All records in one list in one file, cut into its elements."""
    path = fresh_folder(spark, "json")
    one = plain_records(spark, sf).select(F.concat(F.to_json(F.struct(*RECORD_FIELDS)), F.lit(",")).alias("value"))

    def bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"value": ["["]})
        yield from batches
        yield pa.RecordBatch.from_pydict({"value": ["{}]"]})

    # One file takes one task, which only copies what all cores have made.
    lines = saved(one, "lines").coalesce(1).mapInArrow(bracketed, "value string")
    lines.write.option("lineSep", " ").text(path)
    return _flat(read_json(spark, path, glob="*").records, *_MAIN)


@query
def src_xml(spark, sf):
    path = fresh_folder(spark, "xml")
    write_xml(spread_records(spark, sf), path)
    found = read_xml(spark, path, row_tag="patent-document").records
    return _flat(found, "patent_id", "title", "filing_date", "publication_date", "country", "technology_field")


@query
def xml_fields(spark, sf):
    layout = xml_layout(spread_records(spark, sf))
    xml = layout.select(F.to_xml(F.struct(*layout.columns), {"rowTag": "patent-document"}).alias("xml"))
    return _flat(
        accepted(extract_xml(xml)),
        "patent_id", "title", "abstract", "description", "claims", "inventors", "assignees",
        "filing_date", "publication_date", "classification_codes", "technology_field", "country", "status",
    )


@query
def html_fields(spark, sf):
    pages = spread_if_narrow(table(spark, sf, "pages"))
    return extract_html(pages, keep=("page_id",)).select("page_id", "title", "patent_id")


@query
def html_blocks(spark, sf):
    """Every document as a page of its own with marked sections."""
    def escaped(c) -> Column:
        return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    numbered = F.concat_ws("<br>", F.transform("claims", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), escaped(x))))
    html = F.concat(
        F.lit("<html><head><title>"), escaped(F.col("title")), F.lit("</title></head><body><h1>not this</h1><p>Inventors: "),
        F.concat_ws(", ", "inventors"), F.lit("</p><p>Assignee: "), F.concat_ws("; ", "assignees"),
        F.lit("</p><p>Patent No. "), (F.col("doc_id") + 1000).cast("string"),
        F.lit('</p><div class="main Abstract-box"><p>'), escaped(F.col("abstract")),
        F.lit('</div><section class="details">'), escaped(F.col("description")),
        F.lit('</section><div class="abstract">not this</div><div class="claims">'), numbered, F.lit("</div></body></html>"),
    )
    pages = spread_records(spark, sf).select("doc_id", html.alias("html"))
    found = extract_html(pages, keep=("doc_id",))
    return _flat(found, "doc_id", "patent_id", "title", "abstract", "description", "claims", "inventors", "assignees")


@query
def src_directory(spark, sf):
    found = read_directory(spark, mixed_folder(spark, sf)).records
    return found.select("patent_id", "title", "abstract", "technology_field", "country", "status")


@query
def src_csv_strict(spark, sf):
    """Toxic documents as rows with a cell too many, Spanish ones with a cell too few."""
    path = fresh_folder(spark, "strict")
    title = F.concat(F.lit('"'), F.replace("title", F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(
        ",", "patent_id", title, "country",
        F.when(F.col("country") != "ES", ""),
        F.when((F.col("toxic") == 1) & (F.col("country") != "ES"), "extra"),
    )
    # One column whose name and values are whole lines, so rows may differ in width.
    records(spark, sf).select(line.alias("patent_id,title,country,status")).write.csv(
        path, header=True, sep="\x01", quote="", escapeQuotes=False,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    rows = accepted(normalize(scan_csv(spark, path, strict=True), keep=(SOURCE, ORDER)))
    return rows.select("patent_id", "title", "country", "status")


@query
def src_csv_split(spark, sf):
    """All documents in one CSV file, with their line breaks, which Spark cuts where it likes."""
    path = fresh_folder(spark, "csv")
    # One file takes one task, which only copies what all cores have made.
    write_csv(saved(records(spark, sf), "rows").coalesce(1), path)
    return scan_csv(spark, path).select("patent_id", "title", "abstract", "status")


def _headers_folder(spark, sf) -> str:
    """Files of two headers and a JSON file, in which a later file writes labelled records again."""
    path = fresh_folder(spark, "headers")
    source = records(spark, sf)
    again = source.filter(F.col("quality").isNotNull())
    for name, frame in (
        ("a", source.select("patent_id", "title", "country")),
        ("b", again.select(F.lit("b").alias("status"), "title", "patent_id")),
    ):
        frame.coalesce(1).write.csv(f"{path}/{name}", header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    third = again.filter(F.col("quality") == 1).select("patent_id", "title", F.lit("c").alias("status"))
    third.coalesce(1).write.json(f"{path}/c")
    return path


@query
def src_directory_mixed(spark, sf):
    """Files of two headers and a JSON file, in which a later file writes labelled records again."""
    path = _headers_folder(spark, sf)
    parts = [read_csv(spark, [f"{path}/a", f"{path}/b"]).records, read_json(spark, f"{path}/c", lines=True).records]
    places = parts[0].unionByName(parts[1])
    return changes.latest(places, "patent_id", [F.desc("seq")]).select("patent_id", "title", "status")


def _one_file_each(lines: DataFrame, ends: list[tuple[str, str, str]], path: str) -> str:
    """Lines (kind, value) as a file for each kind, between its first and its last line."""
    spark = lines.sparkSession
    kinds = spark.createDataFrame(ends, "kind string, first string, last string")
    first = kinds.select("kind", F.lit(0).alias("at"), F.col("first").alias("value"))
    last = kinds.select("kind", F.lit(2).alias("at"), F.col("last").alias("value")).filter("value <> ''")
    whole = lines.select("kind", F.lit(1).alias("at"), "value").unionByName(first).unionByName(last)
    whole.repartition("kind").sortWithinPartitions("kind", "at").select("kind", "value").write.partitionBy("kind").text(path)
    return path


def _verdicts(spark, folder: str, checks) -> DataFrame:
    found = reduce(DataFrame.unionByName, checks(spark, f"{folder}/kind=*/*", "*"))
    return found.select(
        F.regexp_extract(SOURCE, r"kind=([^/]*)/", 1).alias("kind"), (F.size("errors") == 0).alias("is_valid"),
        F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"), "records",
    )


@query
def validate_csv(spark, sf):
    """A file for each language: Spanish rows with a cell too many, some French ones without
    an id, all German ones with the same."""
    patent_id = F.when((F.col("country") == "FR") & (F.col("doc_id") % 2 == 0), "").when(F.col("country") == "DE", "D").otherwise(F.col("patent_id"))
    title = F.concat(F.lit('"'), F.replace("title", F.lit('"'), F.lit('""')), F.lit('\n"'))
    line = F.concat_ws(",", patent_id, title, "country", F.when(F.col("country") == "ES", "more"))
    lines = records(spark, sf).select(F.col("country").alias("kind"), line.alias("value"))
    ends = [(k, "patent_id,title,country", "") for k in ("EN", "FR", "DE", "ES")]
    return _verdicts(spark, _one_file_each(lines, ends, fresh_folder(spark, "validate")), validate.csv_findings)


@query
def validate_json(spark, sf):
    """A file for each language: a list, one under a wrapper key, one that is cut short, one without titles."""
    one = F.when(F.col("country") == "ES", F.to_json(F.struct("patent_id"))).otherwise(F.to_json(F.struct("patent_id", "title")))
    lines = records(spark, sf).select(F.col("country").alias("kind"), F.concat(one, F.lit(",")).alias("value"))
    ends = [("EN", "[", "5]"), ("FR", '{"patents": [], "results": [', '"x"]}'), ("DE", "[", ""), ("ES", "[", "5]")]
    return _verdicts(spark, _one_file_each(lines, ends, fresh_folder(spark, "validate")), validate.json_files)


@query
def validate_xml(spark, sf):
    """A file for each language: two of patents, one of other elements, one that is not closed."""
    one = F.to_xml(F.struct("country", "title"), {"rowTag": "patent-document"})
    one = F.when(F.col("country") == "FR", F.replace(one, F.lit("patent-document"), F.lit("other"))).otherwise(one)
    lines = records(spark, sf).select(F.col("country").alias("kind"), one.alias("value"))
    ends = [(k, "<all>", "" if k == "DE" else "</all>") for k in ("EN", "FR", "DE", "ES")]
    found = _verdicts(spark, _one_file_each(lines, ends, fresh_folder(spark, "validate")), validate.xml_files)
    return found.withColumn("errors", F.substring("errors", 1, 11))


@query
def file_profile_(spark, sf):
    files = file_profile(spark, mixed_folder(spark, sf))
    return files.groupBy("suffix", "supported").agg(F.sum("records").alias("records"))


def _turns(spark, sf) -> DataFrame:
    turns = table(spark, sf, "conversations")
    return turns.select(
        F.when(F.col("turn") < 6, F.concat(F.lit("C"), F.col("conv_id").cast("string"))).alias("patent_id"),
        F.when(F.col("role") != "system", F.col("text")).alias("title"),
        F.col("role").alias("status"),
    )


@query
def quality_report_(spark, sf):
    return quality_report(_turns(spark, sf))


@query
def sample_records(spark, sf):
    return _flat(table(spark, sf, "documents").select(*sample_record(F.col("doc_id"))), *_MAIN, "application_number")


# --- sinks and changes -----------------------------------------------------


@query
def roundtrip_csv(spark, sf):
    path = fresh_folder(spark, "csv")
    write_csv(records(spark, sf), path)
    return _flat(accepted(normalize(scan_csv(spark, path), keep=(SOURCE, ORDER))), *_MAIN)


@query
def roundtrip_json(spark, sf):
    path = fresh_folder(spark, "json")
    write_json(records(spark, sf), path)
    return _flat(spark.read.schema(RECORD_SCHEMA).json(path), *_MAIN)


def _keyed(spark, sf) -> DataFrame:
    return records(spark, sf).withColumn("point_id", record.point_id())


@query
def export_limit(spark, sf):
    return first_points(_keyed(spark, sf), EXPORTED).select("point_id", "patent_id", "title")


@query
def export_limit_by_range(spark, sf):
    """The first of all points, cut by ranges of the point id."""
    return first_points(_keyed(spark, sf), EXPORTED).select("point_id", "patent_id", "title")


def _arrivals(spark, sf) -> DataFrame:
    """Labelled documents come in again, twice; granted ones under another title."""
    labelled = records(spark, sf).filter(F.col("quality").isNotNull())
    title = F.when(F.col("quality") == 1, F.concat("title", F.lit(" (granted)"))).otherwise(F.col("title"))
    again = labelled.withColumns({
        "title": title,
        "status": F.explode(F.array(F.lit("Pending"), F.lit("Allowed"))),
    })
    seq = F.col("doc_id") * 2 + (F.col("status") == "Allowed").cast("int")
    return again.select("patent_id", "title", "status", record.point_id().alias("point_id"), seq.alias("seq"))


def _current(spark, sf) -> DataFrame:
    return _keyed(spark, sf).select("patent_id", "title", "status", "point_id")


@query
def upsert_latest(spark, sf):
    return changes.upsert(_current(spark, sf), _arrivals(spark, sf))


@query
def update_by_id(spark, sf):
    return changes.update(_current(spark, sf), _arrivals(spark, sf))


def _toxic(spark, sf) -> DataFrame:
    return records(spark, sf).filter(F.col("toxic") == 1).select("patent_id")


@query
def delete_by_id(spark, sf):
    return changes.delete(_current(spark, sf), _toxic(spark, sf))


@query
def collection_changes(spark, sf):
    """Index, add a second version of the labelled records, delete the toxic ones."""
    kept = Collection(spark, fresh_folder(spark, "collection"), HashingEmbedder(EMBEDDING_DIM))
    source = spread_records(spark, sf)
    kept.upsert(source.select(*RECORD_FIELDS))
    kept.compact()
    labelled = source.filter(F.col("quality").isNotNull()).select(*RECORD_FIELDS)
    kept.upsert(labelled.withColumn("title", F.concat("title", F.lit(" (again)"))))
    kept.update(labelled.filter(F.col("status") == "Published").withColumn("status", F.lit("Allowed")))
    kept.delete(_toxic(spark, sf))
    return kept.points().select("patent_id", "title", "status", "point_id")


# --- projections -----------------------------------------------------------


@query
def normalize_records(spark, sf):
    """Cells with padding, a list as text, and values left out."""
    d = table(spark, sf, "documents")
    raw = d.select(
        F.when(F.col("lang") != "es", F.concat(F.lit(" D"), F.col("doc_id").cast("string"), F.lit("\t"))).alias("patent_id"),
        F.concat(F.lit("\n "), F.split_part("text", F.lit("\n"), F.lit(1)), F.lit("  ")).alias("title"),
        F.col("text").alias("abstract"),
        F.concat(F.col("source"), F.lit(" | | "), F.col("lang"), F.lit("|")).alias("assignees"),
        F.when(F.col("doc_id") % 2 == 0, "g06N3/00|A61B5/00").alias("classification_codes"),
        F.when(F.col("lang") == "en", "EP").alias("country"),
    )
    return _flat(accepted(normalize(raw)), *_MAIN, "patent_number")


@query
def load_counts(spark, sf):
    return stats.load_counts(normalize(_turns(spark, sf)))


@query
def enhance_records(spark, sf):
    return _flat(enhance(plain_records(spark, sf)), *_MAIN)


@query
def json_roundtrip(spark, sf):
    stored = records(spark, sf).select(record.to_json().alias("json"))
    back = stored.select(record.from_json(F.col("json")).alias("r")).select("r.*")
    return _flat(back, *_MAIN)


@query
def combined_text(spark, sf):
    return records(spark, sf).select("patent_id", record.combined_text().alias("content"))


@query
def searchable_text(spark, sf):
    return records(spark, sf).select("patent_id", record.searchable_text().alias("content"))


@query
def metadata_text(spark, sf):
    return records(spark, sf).select("patent_id", record.metadata_text().alias("content"))


@query
def ipc_section(spark, sf):
    return records(spark, sf).select(
        "patent_id", record.main_classification().alias("main_code"), record.ipc_section().alias("section")
    )


@query
def point_id(spark, sf):
    return records(spark, sf).select("patent_id", record.point_id().alias("point_id"))


# --- filters ---------------------------------------------------------------


def _filtered(spark, sf, predicate: Column) -> DataFrame:
    return _flat(
        records(spark, sf).filter(predicate),
        "patent_id", "technology_field", "assignees", "inventors", "country", "filing_date",
        "classification_codes", "status",
    )


EXACT = {
    "filter_field_eq": P.ExactFilter(technology_field="Physics"),
    "filter_assignees_all": P.ExactFilter(assignees=["src0", "src3"]),
    "filter_inventors_all": P.ExactFilter(inventors=["Inventor 3", "Inventor 4"]),
    "filter_country": P.ExactFilter(countries=["FR"]),
    "filter_status": P.ExactFilter(status=["Granted"]),
    "filter_date_range": P.ExactFilter(date_range=("2020-06-01", "2021-12-31")),
    "filter_codes_all": P.ExactFilter(classification_codes=["G06N3/00"]),
}
MATCH = {
    "match_field_any": P.RecordFilter(technology_fields=["PHYS", "metall"]),
    "match_assignee_any": P.RecordFilter(assignees=["SRC1", "src0"]),
    "match_inventor_any": P.RecordFilter(inventors=["inventor 1"]),
    "match_country_in": P.RecordFilter(countries=["FR", "DE"]),
    "match_date_range": P.RecordFilter(date_range=(None, "2021-12-31")),
    "match_code_any": P.RecordFilter(classification_codes=["06N", "Z1/"]),
    "match_status_in": P.RecordFilter(status=["Granted", "Pending"]),
    "match_all_filters": P.RecordFilter(
        technology_fields=["physics", "electricity", "human"], assignees=["src1"], inventors=["Inventor 1", "Inventor 2"],
        countries=["EN", "FR"], date_range=("2020-03-01", "2023-12-31"), classification_codes=["00"],
        status=["Granted", "Pending"],
    ),
}


def _filter_query(predicate: P.ExactFilter | P.RecordFilter) -> Query:
    return lambda spark, sf: _filtered(spark, sf, predicate.to_column())


_REGISTRY.update({name: _filter_query(f) for name, f in (EXACT | MATCH).items()})


@query
def filter_min_score(spark, sf):
    vector = HashingEmbedder().encode([ENGLISH])[0]
    return _scored(S.score(hashed_points(spark, sf), vector, min_score=0.4), "patent_id")


@query
def lookup_by_id(spark, sf):
    return _flat(S.lookup(stored_points(spark, sf), SIMILAR_TO), "patent_id", "point_id", "title", "assignees")


# --- search ----------------------------------------------------------------


def _scored(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.select(*columns, F.col(S.SCORE).alias("score"))


@query
def search_vectors(spark, sf):
    """Nearest embeddings to the first one, among one label."""
    vectors = table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("point_id"), F.col("embedding").alias("vector"), "label"
    )
    first = vectors.filter(F.col("point_id") == "0").first()
    return _scored(S.search(vectors, first.vector, where=F.col("label") == first.label), "point_id", "label", "rank")


def _entries(frame: DataFrame, key: str, weight: Callable[[Column], Column]) -> DataFrame:
    """The non-zero entries of the vectors in `v`.

    An outer inline, since a plain one makes Spark filter on the vectors first, and so
    compute them twice.
    """
    pairs = F.transform("v", lambda x, i: F.struct(i.alias("dim"), weight(x).alias("weight"), (x > 0).alias("used")))
    used = F.filter(pairs, lambda p: p["used"])
    return frame.select(key, F.inline_outer(used)).filter("used").drop("used")


@query
def embed_hash(spark, sf):
    """Words of the whole documents, as the non-zero entries of their vectors."""
    d = texts(spark, sf)
    vectors = d.select("doc_id", HashingEmbedder().column(F.col("text")).alias("v"))
    return _entries(vectors, "doc_id", lambda x: x.cast("int"))


@query
def embed_tfidf_(spark, sf):
    points = hashed_points(spark, sf).select("patent_id", "vector")
    return _entries(
        embed_tfidf(points).withColumnRenamed("vector", "v"), "patent_id", lambda x: F.round(x.cast("double"), 4)
    )


@query
def cosine_pairs(spark, sf):
    """Each embedding with the one numbered after it."""
    e = table(spark, sf, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    both = e.join(after, "vec_id")
    return both.select("vec_id", cosine(F.col("embedding"), F.col("other")).alias("score"))


SEARCH_FILTER = P.ExactFilter(technology_field=SEARCH_FIELD, countries=["EN"], date_range=("2020-02-01", None))


@query
def search_filtered(spark, sf):
    vector = HashingEmbedder().encode([ENGLISH])[0]
    found = S.search(hashed_points(spark, sf), vector, where=SEARCH_FILTER.to_column(), query=ENGLISH)
    return _scored(found, "patent_id", "technology_field", "search_query", "rank")


@query
def search_semantic(spark, sf):
    vector = HashingEmbedder().encode([FRENCH])[0]
    found = S.semantic_search(hashed_points(spark, sf), vector, limit=25, min_score=0.2, query=FRENCH)
    return _scored(found, "patent_id", "country", "search_query", "rank")


@query
def similar_records(spark, sf):
    found = S.similar(stored_points(spark, sf), SIMILAR_TO, limit=10, min_score=0.2)
    return _scored(found, "patent_id", "reference_patent_id", "rank")


@query
def similar_all(spark, sf):
    """What is similar to every record, over pairs of cells."""
    points = stored_points(spark, sf).select("point_id", "patent_id", "vector")
    found = neighbours.similar_all(points, limit=5, min_score=0.2, cells=CELLS)
    return _scored(found, "reference_patent_id", "patent_id", "rank")


@query
def search_conversations(spark, sf):
    """Every turn of every conversation against all documents."""
    turns = table(spark, sf, "conversations")
    name = F.concat_ws("-", "conv_id", "turn")
    queries = turns.select(name.alias("query_id"), HashingEmbedder(EMBEDDING_DIM).column(F.col("text")).alias("vector"))
    points = embed(spread_records(spark, sf).select(*RECORD_FIELDS), HashingEmbedder(EMBEDDING_DIM))
    return _scored(S.search_batch(points, queries, limit=3), "query_id", "point_id", "rank")


def _benchmark_queries(spark, sf) -> DataFrame:
    b = table(spark, sf, "benchmark")
    return b.select(F.col("item_id").cast("string").alias("query_id"), HashingEmbedder().column(F.col("text")).alias("vector"))


@query
def search_batch(spark, sf):
    """Every benchmark passage against all documents."""
    hits = S.search_batch(hashed_points(spark, sf), _benchmark_queries(spark, sf), limit=5)
    return _scored(hits, "query_id", "point_id", "rank")


@query
def search_batch_blocks(spark, sf):
    """The same as too many queries for one task would be run."""
    points, queries = hashed_points(spark, sf), _benchmark_queries(spark, sf)
    hits = S.search_batch(points, queries, limit=5, matrix_bytes=8 * EMBEDDING_DIM * 150)
    return _scored(hits, "query_id", "point_id", "rank")


@query
def search_saved(spark, sf):
    """The saved queries, each within its technology field."""
    points = embed(enhance(plain_records(spark, sf)), HashingEmbedder())
    hits = S.search_batch(points, S.text_queries(spark, SAVED_QUERIES, HashingEmbedder()), limit=10)
    return _scored(hits, "query_id", "point_id", "rank")


@query
def search_ivf(spark, sf):
    """The nearest points by the cell index, which must be those of a full scan."""
    points = stored_points(spark, sf).select("point_id", "patent_id", "vector")
    path = fresh_folder(spark, "cells")
    build_cells(points, path, CELLS, EMBEDDING_DIM)
    vector = points.filter(F.col("patent_id") == SIMILAR_TO).first().vector
    return _scored(search_cells(spark, path, vector), "patent_id", "rank")


@query
def result_preview(spark, sf):
    vector = HashingEmbedder().encode([ENGLISH])[0]
    return S.preview(S.search(hashed_points(spark, sf), vector, limit=PREVIEW_LIMIT))


# --- counts ----------------------------------------------------------------


@query
def stats_fields(spark, sf):
    return stats.facet(records(spark, sf), "technology_field")


@query
def stats_countries(spark, sf):
    return stats.facet(records(spark, sf), "country")


@query
def stats_assignees(spark, sf):
    return stats.facet(records(spark, sf), "assignee")


@query
def stats_years(spark, sf):
    return stats.facet(records(spark, sf), "filing_year")


@query
def stats_total(spark, sf):
    return stats.total(records(spark, sf))


@query
def stats_all(spark, sf):
    return stats.facets(records(spark, sf))


@query
def stats_vector_size(spark, sf):
    return stats.vector_info(stored_points(spark, sf))


@query
def classify_ipc(spark, sf):
    return records(spark, sf).select("patent_id", classify.classify_ipc(F.col("classification_codes")).alias("field"))


@query
def country_names(spark, sf):
    return stats.country_names(records(spark, sf).select("patent_id", "country"))


# --- text ------------------------------------------------------------------


def _texts(spark, sf) -> DataFrame:
    """All documents and all pages."""
    d = texts(spark, sf).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    p = spread_if_narrow(table(spark, sf, "pages")).select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("html").alias("text"))
    return d.unionByName(p)


def _text_query(f: Callable[[Column], Column]) -> Query:
    return lambda spark, sf: _texts(spark, sf).select("id", f(F.col("text")).alias("result"))


_REGISTRY.update({
    "clean_text": _text_query(text.clean_text),
    "strip_tags": _text_query(text.strip_tags),
    "expand_abbrev": _text_query(text.expand_abbreviations),
    "normalize_ws": _text_query(text.normalize_whitespace),
})


@query
def extract_claims(spark, sf):
    """Documents with their lines numbered as claims."""
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x, F.lit(" [2] (3)")))
    d = texts(spark, sf).select("doc_id", F.concat_ws(" ", numbered).alias("section"))
    return d.select("doc_id", F.concat_ws("|", text.extract_claims(F.col("section"))).alias("claims"))


@query
def extract_inventors(spark, sf):
    names = F.concat(F.lit("Dr."), "source", F.lit("; "), "lang", F.lit(" PhD | Mr. "), "source", F.lit(" Inc., ;Jr.x"))
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.concat_ws("|", text.extract_inventors(names)).alias("names"))


@query
def extract_inventors_json(spark, sf):
    given = F.concat(
        F.lit('[{"name": "Prof.'), "source", F.lit('"}, "'), "lang", F.lit(' MD", {"name": "", "full_name": "'),
        "lang", F.lit(' x"}, 7, {"inventor_name": "'), "source", F.lit('"}, {"other": "y"}]'),
    )
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.concat_ws("|", text.extract_inventors_variant(F.parse_json(given))).alias("names"))


@query
def extract_assignees(spark, sf):
    names = F.concat("source", F.lit(" Corp.,"), "lang", F.lit(" Inc.| <b>"), "source", F.lit("</b> & Sons; ;Dr. "), "lang")
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.concat_ws("|", text.extract_assignees(names)).alias("names"))


@query
def extract_codes(spark, sf):
    codes = F.concat(F.lit("g06n"), F.col("doc_id").cast("string"), F.lit("/00; ab,"), "source", F.lit(" | x|a1"))
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.concat_ws("|", text.extract_classification_codes(codes)).alias("codes"))


@query
def format_date(spark, sf):
    """Order dates in the several shapes a date comes in."""
    o = table(spark, sf, "orders")
    day = F.col("o_orderdate").cast("date").cast("string")
    compact = F.replace(day, F.lit("-"), F.lit(""))
    shapes = F.array(day, compact, F.substring(compact, 3, 6), F.concat(F.lit("on "), F.replace(day, F.lit("-"), F.lit("."))), F.substring(day, 1, 8))
    given = F.element_at(shapes, (F.col("o_orderkey") % 5 + 1).cast("int"))
    return o.select("o_orderkey", text.format_date(given).alias("date"))


def _content(spark, sf) -> DataFrame:
    r = spread_records(spark, sf)
    content = classify.classified_content(F.col("title"), F.col("abstract"), F.col("claims"))
    return r.select("patent_id", "technology_field", "classification_codes", content.alias("content"))


@query
def classify_content(spark, sf):
    return _content(spark, sf).select("patent_id", classify.classify_content(F.col("content")).alias("field"))


@query
def resolve_field(spark, sf):
    given = F.when(F.col("patent_id").endswith("0"), "Optics").otherwise("Unknown")
    field = classify.resolve_field(given, F.col("classification_codes"), F.col("content"))
    return _content(spark, sf).select("patent_id", field.alias("field"))


# --- streams and whole loads -----------------------------------------------


@query
def clear_collection(spark, sf):
    """All records, cleared, then the good ones."""
    kept = Collection(spark, fresh_folder(spark, "collection"), HashingEmbedder(EMBEDDING_DIM))
    source = spread_records(spark, sf)
    kept.upsert(source.select(*RECORD_FIELDS))
    kept.clear()
    kept.upsert(source.filter("quality = 1").select(*RECORD_FIELDS))
    return kept.points().select("point_id", "patent_id", "title")


@query
def vacuum_collection(spark, sf):
    """All records, those of one label again under another status, without older folders."""
    kept = Collection(spark, fresh_folder(spark, "collection"), HashingEmbedder(EMBEDDING_DIM))
    source = spread_records(spark, sf)
    kept.upsert(source.select(*RECORD_FIELDS))
    kept.compact()
    kept.upsert(source.filter("quality = 1").select(*RECORD_FIELDS).withColumn("status", F.lit("Allowed")))
    kept.compact()
    kept.vacuum()
    return kept.points().select("point_id", "patent_id", "title", "status")


@query
def stream_load(spark, sf):
    checkpoint, out = fresh_folder(spark, "progress"), fresh_folder(spark, "streamed")
    arriving = stream_records(spark, csv_folder(spark, sf))
    write_records(arriving, out, checkpoint).awaitTermination()
    return _flat(spark.read.schema(RECORD_SCHEMA).parquet(out), *_MAIN)


@query
def stream_json(spark, sf):
    path, checkpoint, out = (fresh_folder(spark, x) for x in ("json", "progress", "streamed"))
    write_json(plain_records(spark, sf), path)
    write_records(stream_records(spark, path, "json"), out, checkpoint).awaitTermination()
    return _flat(spark.read.schema(RECORD_SCHEMA).parquet(out), *_MAIN)


@query
def stream_xml(spark, sf):
    path, checkpoint, out = (fresh_folder(spark, x) for x in ("xml", "progress", "streamed"))
    write_xml(spread_records(spark, sf), path)
    write_records(stream_records(spark, path, "xml"), out, checkpoint).awaitTermination()
    found = spark.read.schema(RECORD_SCHEMA).parquet(out)
    return _flat(found, "patent_id", "title", "filing_date", "publication_date", "country", "technology_field")


@query
def stream_rejects(spark, sf):
    """Records with an unknown key or without a title, told by the stream."""
    path, checkpoint, out = (fresh_folder(spark, x) for x in ("json", "progress", "rejected"))
    source = spread_records(spark, sf).withColumn("title", F.when(F.col("toxic") == 1, "").otherwise(F.col("title")))
    extra = F.when(F.col("quality") == 0, "x").alias("extra")
    source.select(F.to_json(F.struct(*RECORD_FIELDS, extra)).alias("value")).write.text(path)
    found = loads.stream_rejects(spark, path, "json")
    write_records(found, out, checkpoint).awaitTermination()
    return spark.read.schema(found.schema).parquet(out).groupBy("reject_reason").agg(F.count("*").alias("rows"))


@query
def stream_upsert(spark, sf):
    kept = Collection(spark, fresh_folder(spark, "collection"), HashingEmbedder(EMBEDDING_DIM))
    arriving = stream_raw(spark, csv_folder(spark, sf))
    upsert_stream(arriving, kept, fresh_folder(spark, "progress"), "load").awaitTermination()
    return kept.points().select("point_id", "patent_id", "title", "technology_field")


@query
def stream_directory(spark, sf):
    """The files of src_directory_mixed, as a stream."""
    kept = Collection(spark, fresh_folder(spark, "collection"), HashingEmbedder(EMBEDDING_DIM))
    folder, progress = f"{_headers_folder(spark, sf)}/*", fresh_folder(spark, "progress")
    loads.upsert_directory_stream(spark, folder, kept, progress, "files", options={"json": {"lines": True}}).awaitTermination()
    return kept.points().select("patent_id", "title", "status")


@query
def batch_index(spark, sf):
    """CSV files to a collection, then a search in it."""
    kept = Collection(spark, fresh_folder(spark, "collection"))
    kept.upsert(read_csv(spark, csv_folder(spark, sf)).records)
    kept.compact()
    return _scored(kept.search(ENGLISH, limit=30), "point_id", "patent_id", "title", "rank")
