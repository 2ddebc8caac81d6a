"""From raw documents to packed training sequences, in four stages.

Each stage reads all that its predecessor kept. Between stages the documents are written
as Parquet below the shared folder, so a lost executor costs a stage at most.

Rejected are documents scored toxic (0.5 or more), documents without a letter or whose
language is not told apart (best share below LEAST_SHARE), and of each group of near
duplicates all but the smallest doc_id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import langid
from docketry.llm import toxicity as toxic
from docketry.llm.components import saved
from docketry.llm.neardup import near_duplicates
from docketry.llm.packing import pack
from docketry.session import fresh_folder

LEAST_SHARE = 0.3
TOKENIZER = "word_bpe_49k.json"

#: The stages are models, hashes and token ids, which SQL cannot express.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic; null and empty texts stay."""
    model = toxic.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(toxic.toxicity_column(F.col("text"), model, docs).getField("predicted") == 0)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; null texts and texts without a letter go."""
    found = langid.language_column(F.col("text"), langid.fit(docs), docs)
    return docs.filter((found.getField("lang_pred") != langid.UNKNOWN) & (found.getField("score") >= LEAST_SHARE))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id; nulls go last.

    Rows are documents of their own, whatever their ids: they are numbered as they are written
    to the shared folder, and one row of each group stays, also among rows of one id, null ids
    and repeated rows. Texts without a word are like no other, so all of them stay.
    """
    number = "row"
    while number.lower() in {c.lower() for c in docs.columns}:
        number += "_"
    numbered = saved(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    groups = near_duplicates(numbered.select(F.col(number).alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    ids = numbered.select(F.col(number).alias("row"), "doc_id").join(groups, "row")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    kept = ids.groupBy("component_id").agg(first.alias("first")).select(F.col("first.row").alias(number))
    return numbered.join(kept, number, "left_semi").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their token ids (see pack)."""
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("toxicity", toxicity), ("language", language), ("near_dedup", near_dedup), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = fresh_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
