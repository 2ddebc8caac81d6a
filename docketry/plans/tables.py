"""The given tables as records, points and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import classify, record, text
from docketry.functions.vectors import HashingEmbedder
from docketry.operators.normalize import embed
from docketry.schema import OPTIONAL_FIELDS, RECORD_FIELDS
from docketry.session import fresh_folder, spread_if_narrow
from docketry.sources.write import write_csv

# One code per remainder of the document number; the last has no mapped section.
CODES = (
    "A61B5/00", "B25J9/00", "C12N15/00", "D21H11/00", "E04B1/00", "F03D1/00", "G06N3/00",
    "H04L9/00", "X99Z1/00",
)
INVENTOR_COUNT = 12
EMBEDDING_DIM = 64


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """`documents` for work on its texts: one large row group would make one task."""
    return spread_if_narrow(table(spark, sf, "documents"))


def records(spark: SparkSession, sf: str, documents: DataFrame | None = None) -> DataFrame:
    """`documents` (with `labels`) as records, numbered by `doc_id`.

    The technology field is the one of the classification code.
    """
    d = (documents or table(spark, sf, "documents")).join(table(spark, sf, "labels"), "doc_id", "left")
    n = F.col("doc_id")
    lines = F.filter(F.split("text", "\n"), lambda x, i: i > 0)
    claims = F.filter(F.transform(lines, text.strip), lambda x: x != "")
    day = F.date_add(F.lit("2020-01-01").cast("date"), (n % 1461).cast("int"))
    names = [F.concat(F.lit("Inventor "), ((n + k) % INVENTOR_COUNT).cast("string")) for k in (0, 1)]
    code = F.array(F.element_at(F.array(*map(F.lit, CODES)), (n % len(CODES) + 1).cast("int")))
    status = F.when(F.col("quality") == 1, "Granted").when(F.col("quality") == 0, "Published").otherwise("Pending")
    empty = F.array().cast("array<string>")
    fields: dict[str, Column] = {
        "patent_id": F.concat(F.lit("D"), n.cast("string")),
        "patent_number": F.concat(F.lit("D"), n.cast("string")),
        "title": F.split_part("text", F.lit("\n"), F.lit(1)),
        "abstract": F.col("text"),
        "description": F.col("text"),
        "claims": claims,
        "inventors": F.array(*names),
        "assignees": F.when(n % 3 == 0, F.array("source", F.lit("src0"))).otherwise(F.array("source")),
        "filing_date": F.when(n % 50 == 49, "").otherwise(day.cast("string")),
        "publication_date": F.lit(""),
        "classification_codes": code,
        "technology_field": classify.classify_ipc(code),
        "country": F.upper("lang"),
        "status": status,
        "citations": empty,
        "cited_by": empty,
    }
    fields |= {c: F.lit(None).cast("string") for c in OPTIONAL_FIELDS}
    return d.select("doc_id", *[fields[c].alias(c) for c in RECORD_FIELDS], "quality", "toxic")


def spread_records(spark: SparkSession, sf: str) -> DataFrame:
    """The records, dealt over all cores while a row still holds its text once."""
    return records(spark, sf, texts(spark, sf))


def plain_records(spark: SparkSession, sf: str) -> DataFrame:
    """As records, with the field still to be settled."""
    return spread_records(spark, sf).select(*RECORD_FIELDS).withColumn("technology_field", F.lit("Unknown"))


def hashed_points(spark: SparkSession, sf: str) -> DataFrame:
    """All records with the vector of their own text."""
    return embed(spread_records(spark, sf).select(*RECORD_FIELDS), HashingEmbedder())


def stored_points(spark: SparkSession, sf: str) -> DataFrame:
    """All records, each with a vector of `embeddings`: of those there are fewer, which are
    given out in turn."""
    vectors = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    found = records(spark, sf).join(vectors, F.col("doc_id") % F.lit(vectors.count()) == F.col("vec_id"))
    return found.select(*RECORD_FIELDS, record.point_id().alias("point_id"), "vector")


def csv_folder(spark: SparkSession, sf: str) -> str:
    path = fresh_folder(spark, "csv")
    write_csv(records(spark, sf).withColumn("technology_field", F.lit("Unknown")), path)
    return path


def xml_layout(source: DataFrame) -> DataFrame:
    """Records as the nested elements of a published document."""
    def document(*parts: Column) -> Column:
        return F.struct(F.struct(*parts).alias("document-id"))

    numbered = F.transform("claims", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    compact = F.regexp_replace("filing_date", "-", "")
    return source.select(
        document(
            F.col("country").alias("country"), F.col("patent_id").alias("doc-number"), compact.alias("date")
        ).alias("publication-reference"),
        document(compact.alias("date")).alias("application-reference"),
        F.struct(F.get("classification_codes", F.lit(0)).alias("main-classification")).alias("classification-ipc"),
        F.col("title").alias("invention-title"),
        "abstract",
        F.struct(F.transform("inventors", lambda x: F.struct(x.alias("name"))).alias("inventor")).alias("inventors"),
        F.struct(F.transform("assignees", lambda x: F.struct(x.alias("orgname"))).alias("assignee")).alias("assignees"),
        F.concat_ws("\n", numbered).alias("claims"),
        F.col("description").alias("detailed-description"),
    )


def write_xml(source: DataFrame, path: str, mode: str = "errorifexists") -> None:
    xml_layout(source).write.mode(mode).format("xml").options(rootTag="patents", rowTag="patent-document").save(path)


def mixed_folder(spark: SparkSession, sf: str) -> str:
    """Labelled documents as CSV, the others as XML, and text files no reader takes."""
    path = fresh_folder(spark, "mixed")
    source = records(spark, sf).withColumn("technology_field", F.lit("Unknown"))
    write_csv(source.filter(F.col("quality").isNotNull()), path, "append")
    write_xml(source.filter(F.col("quality").isNull()), path, "append")
    source.select("title").write.mode("append").text(path)
    return path
