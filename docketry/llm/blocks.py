"""Meeting of a stated query set with all rows, block by block.

Points and queries that share a key are dealt into blocks of bounded size; each pair of a
point block and a query block is one group of a cogrouped call. A point is copied once per
query block of its key and a query once per point block, so a hot key is spread over many
groups and none grows with the data. What is moved is pairs / block rows; what is computed
is pairs, so at any size the moving is a small share.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GROUP = ["key", "point_block", "query_block"]


def vectors(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Rows that are vectors (not null, not empty, all components finite) and their values as doubles."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)
    flat = pc.cast(values.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(values)), sizes)
    bad = np.bincount(row[~np.isfinite(flat)], minlength=len(values)) > 0
    rows = np.flatnonzero((sizes > 0) & ~bad)
    return rows, pc.cast(values, pa.list_(pa.float64())).take(pa.array(rows))


def by_length(rows: np.ndarray, values: pa.Array):
    """(length, positions among `rows`, matrix) for each length that occurs."""
    sizes = pc.list_value_length(values).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        here = np.flatnonzero(sizes == size)
        yield int(size), here, values.take(pa.array(here)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def spread_blocks(ids: np.ndarray, blocks: int | np.ndarray) -> np.ndarray:
    """The block of each id or row key: a mixed hash, so that evenly spaced ones spread too."""
    mixed = (ids.astype("uint64") ^ (ids.astype("uint64") >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(33)) % np.asarray(blocks).astype("uint64")).astype("int64")


def row_keys(ids: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """What spread_blocks deals rows by: id and components, so that many rows of one id spread too."""
    bits = np.ascontiguousarray(matrix).view("uint64")
    factors = np.random.default_rng(1).integers(0, 2**63, matrix.shape[1]).astype("uint64") * np.uint64(2) + np.uint64(1)
    mixed = ids.astype("uint64") * np.uint64(0xD6E8FEB86659FD93)
    for at in range(matrix.shape[1]):
        mixed += (bits[:, at] ^ (bits[:, at] >> np.uint64(32))) * factors[at]
    return (mixed ^ (mixed >> np.uint64(32))).astype("int64")


def unlike(ids: np.ndarray, asked: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Positions of rows, each id, mark and vector once; equal rows count once in every result."""
    if len(np.unique(ids)) == len(ids):
        return np.arange(len(ids))
    bits = np.ascontiguousarray(np.column_stack([ids.astype("int64"), asked.astype("int64"), np.ascontiguousarray(matrix).view("int64")]))
    return np.sort(np.unique(bits.view(np.dtype((np.void, bits.shape[1] * 8))).reshape(-1), return_index=True)[1])


def first_of_each(row: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Positions at which a pair of a row and an id comes first."""
    if not len(row):
        return np.zeros(0, "int64")
    names, code = np.unique(ids, return_inverse=True)
    return np.sort(np.unique(row * len(names) + code, return_index=True)[1])


def meet(points: DataFrame, queries: DataFrame, compare: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """`compare` on each group; both sides have the GROUP columns."""
    return points.groupBy(*GROUP).cogroup(queries.groupBy(*GROUP)).applyInArrow(compare, schema)


def best_per_query(found: DataFrame, limit: int, largest: bool) -> DataFrame:
    """The `limit` best of each query's finds, a vector once, ties to the smaller id."""
    score = F.max("score") if largest else F.min("score")
    once = found.groupBy("query_id", "vec_id").agg(score.alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score") if largest else F.asc("score"), "vec_id")
    return (
        once.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= limit)
        .select("query_id", "rank", "vec_id", "score")
    )
