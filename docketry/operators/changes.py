"""Upsert, update and delete as plain frame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(rows: DataFrame, key: str | list[str], order: list[Column]) -> DataFrame:
    """The last row per key, or per several columns.

    Spark drops all but the first row of each key in every task before it shuffles, so
    a key with very many rows costs no more than the others.
    """
    ranked = rows.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.filter(F.col("_place") == 1).drop("_place")


def _last_first(order: str) -> list[Column]:
    return [F.desc(order)]


def upsert(existing: DataFrame, incoming: DataFrame, order: str = "seq") -> DataFrame:
    """Rows of `incoming` replace those with the same point id, the last one of each."""
    new = latest(incoming, "point_id", _last_first(order)).drop(order)
    return existing.join(new.select("point_id"), "point_id", "left_anti").unionByName(new)


def delete(existing: DataFrame, ids: DataFrame, first_only: bool = False) -> DataFrame:
    """Without the points whose patent id is in `ids` (a frame with `patent_id`).

    `first_only` takes away one point of each id, the one with the smallest point id.
    """
    if not first_only:
        return existing.join(ids.select("patent_id"), "patent_id", "left_anti")
    hit = existing.join(ids.select("patent_id"), "patent_id", "left_semi")
    first = hit.groupBy("patent_id").agg(F.min("point_id").alias("point_id"))
    return existing.join(first.select("point_id"), "point_id", "left_anti")


def update(existing: DataFrame, incoming: DataFrame, order: str = "seq") -> DataFrame:
    """Delete by patent id, then add: a changed title leaves no second point behind."""
    new = latest(incoming, "patent_id", _last_first(order)).drop(order)
    return delete(existing, new).unionByName(new)
