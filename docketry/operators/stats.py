"""Counts over a collection, and lookups by code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.operators.normalize import REASON
from docketry.schema import COUNTRY_NAMES, DISTANCE_METRIC, INDEXED_FIELDS, UNKNOWN_FIELD

TOP = 10
FILING_YEAR = "filing_year"


def first_assignee() -> Column:
    return F.get("assignees", F.lit(0))


def filing_year() -> Column:
    return F.when(F.length("filing_date") >= 4, F.substring("filing_date", 1, 4))


def _known(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(UNKNOWN_FIELD))


FACETS = {
    "technology_field": lambda: _known("technology_field"),
    "country": lambda: _known("country"),
    "assignee": first_assignee,
    FILING_YEAR: filing_year,
}


def facet(points: DataFrame, name: str, top: int = TOP) -> DataFrame:
    """key, count of one facet: the largest counts, or the latest years."""
    counts = points.select(FACETS[name]().alias("key")).dropna().groupBy("key").count()
    order = [F.desc("key")] if name == FILING_YEAR else [F.desc("count"), F.asc("key")]
    return counts.orderBy(*order).limit(top)


def facets(points: DataFrame, top: int = TOP) -> DataFrame:
    """All facets in one pass: facet, key, count.

    Counts fold per (facet, key) before the shuffle, and each task passes on at most
    `top` keys of a facet to the ranking.
    """
    pairs = F.array(*[
        F.struct(F.lit(name).alias("facet"), key().alias("key")) for name, key in FACETS.items()
    ])
    counts = points.select(F.inline(pairs)).dropna().groupBy("facet", "key").count()
    by_facet = Window.partitionBy("facet").orderBy(
        F.when(F.col("facet") == FILING_YEAR, F.col("key")).desc_nulls_last(),
        F.desc("count"),
        F.asc("key"),
    )
    ranked = counts.withColumn("place", F.row_number().over(by_facet))
    return ranked.filter(F.col("place") <= top).drop("place")


def facet_map(points: DataFrame, top: int = TOP) -> DataFrame:
    """One row per facet with its counts as a map."""
    entries = F.map_from_entries(F.collect_list(F.struct("key", "count")))
    return facets(points, top).groupBy("facet").agg(entries.alias("counts"))


def total(points: DataFrame) -> DataFrame:
    return points.agg(F.count("*").alias("total"))


def vector_info(points: DataFrame) -> DataFrame:
    """One row per vector size in use, with the metric and the indexed fields."""
    return points.groupBy(F.size("vector").alias("vector_size")).agg(F.count("*").alias("points")).select(
        "vector_size", "points",
        F.lit(DISTANCE_METRIC).alias("distance_metric"),
        F.lit(",".join(INDEXED_FIELDS)).alias("indexed_fields"),
    )


def load_counts(normalized: DataFrame) -> DataFrame:
    """Rows accepted, and rows set aside per reason."""
    outcome = F.coalesce(F.col(REASON), F.lit("accepted"))
    return normalized.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("rows"))


def country_names(records: DataFrame) -> DataFrame:
    """Records with the name of their country, null for a code without one.

    The table has thirty fixed rows, so it goes to every task.
    """
    names = records.sparkSession.createDataFrame(list(COUNTRY_NAMES.items()), "country string, country_name string")
    return records.join(F.broadcast(names), "country", "left")
