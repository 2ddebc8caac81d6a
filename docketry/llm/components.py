"""Connected components of a link table, by rounds of joins on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.session import saved


def _smallest(neighbours: DataFrame) -> DataFrame:
    """(v, u) rows with the smallest of u and its neighbours; summed per task before the shuffle."""
    return neighbours.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b), root being its component's smallest node.

    Rounds of large star and small star: each node's larger neighbours, then its smaller
    ones, are tied to its smallest neighbour, until nothing changes. A node with very many
    links is never gathered: minima are aggregated, and joined back. Nodes may be of any
    ordered type. Links to oneself and nulls are ignored; no links give no rows.
    """
    edges = saved(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter(F.col("u") != F.col("v")).distinct(),
        "edges",
    )
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_smallest(both), "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter(F.col("u") != F.col("v")).distinct()
        # Now u is the larger end; its smaller neighbours and itself go to the smallest.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = saved(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now["n"], now["h"]) == mark:
            break
        mark = (now["n"], now["h"])
    # Stars: every larger end has its root; a root is its own.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
