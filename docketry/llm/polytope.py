"""Approximate nearest neighbours by cross-polytope hashing.

A vector's direction is rotated at random (sign flips and Hadamard transforms, a rotation
per table) and hashed to the signed axis nearest to it. A query probes its nearest axes in
every table; all points of the probed buckets are its candidates and are ranked by exact
distance on the original vectors. Tables, probes and the measured recall are parameters
and figures of README.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.blocks import best_per_query, by_length, first_of_each, meet, row_keys, unlike, vectors
from docketry.llm.rotations import rotate, signed_axes
from docketry.session import saved

TABLES, PROBES, SEED = 14, 10, 7
POINT_ROWS, QUERY_ROWS = 4096, 1024
SCHEMA = "query_id bigint, vec_id bigint, score double"
HASHED = "vec_id bigint, asked boolean, key bigint, rank int, spread bigint, data binary"


def hash_rows(batch: pa.RecordBatch, tables: int, probes: int, seed: int, with_data: bool) -> Iterator[pa.RecordBatch]:
    """A row per table for each vector (rank 0), and for a query the further axes it probes."""
    kept, values = vectors(batch.column(1))
    ids = batch.column(0).to_numpy(zero_copy_only=False).astype("int64")[kept]
    asked = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)[kept]
    for size, here, matrix in by_length(kept, values):
        length = np.sqrt((matrix**2).sum(axis=1))
        here, matrix, length = here[length > 0], matrix[length > 0], length[length > 0]
        once = unlike(ids[here], asked[here], matrix)
        here, matrix, length = here[once], matrix[once], length[once]
        spread = row_keys(ids[here], matrix)
        raw = matrix.astype("<f8").tobytes()
        data = pa.array([raw[i * size * 8:(i + 1) * size * 8] if with_data else None for i in range(len(here))], pa.binary())
        for table in range(tables):
            axes = signed_axes(rotate(matrix / length[:, None], table, seed), probes)
            for rank in range(axes.shape[1]):
                row = np.arange(len(here)) if rank == 0 else np.flatnonzero(asked[here])
                if len(row):
                    yield pa.RecordBatch.from_pydict({
                        "vec_id": ids[here][row],
                        "asked": pa.array(asked[here][row]),
                        "key": (np.int64(size) * tables + table << 20) + axes[row, rank],
                        "rank": np.full(len(row), rank, "int32"),
                        "spread": spread[row],
                        "data": data.take(pa.array(row)),
                    })


def nearest(
    embeddings: DataFrame,
    is_query: Column,
    k: int = 10,
    tables: int = TABLES,
    probes: int = PROBES,
    seed: int = SEED,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest candidates by Euclidean distance.

    All rows are indexed; queries are those whose `is_query` holds; a row of the query's own
    id is no candidate. Ties go to the smaller id, a repeated id counts once per query, with
    its least distance. Null, empty or zero vectors, those with null or non-finite
    components and rows without an id take no part; vectors of different lengths never meet.
    Fewer candidates give fewer rows, no rows give no rows, other columns are left out.

    A bucket of any size is ranked whole: it is dealt into blocks (see blocks.py). Points of
    buckets that no query probes are not moved.
    """
    rows = embeddings.select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asked")
    ).filter("vec_id IS NOT NULL")

    def hashed(with_data: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch), 4096):
                    yield from hash_rows(batch.slice(at, 4096), tables, probes, seed, with_data)

        return rows.mapInArrow(run, HASHED)

    # A row per probed bucket, written so that Spark knows its size before it joins.
    counted = hashed(False).groupBy("key").agg(F.count_if(F.col("rank") == 0).alias("points"), F.count_if(F.col("asked")).alias("askers"))
    blocks = lambda rows, most: F.ceil(F.col(rows) / most).cast("bigint")
    buckets = saved(
        counted.filter("points > 0 AND askers > 0").select("key", blocks("points", POINT_ROWS).alias("point_blocks"), blocks("askers", QUERY_ROWS).alias("query_blocks")),
        "buckets",
    )

    def dealt(side: str, own: str, other: str, seed: int) -> DataFrame:
        """Rows of a side with their own block, a copy for every block of the other side."""
        rows = hashed(True).filter(side).join(buckets, "key")
        copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"{other}s") - 1))
        mine = F.pmod(F.xxhash64("spread", F.lit(seed)), F.col(f"{own}s"))
        return rows.select("vec_id", "key", mine.alias(own), copies.alias(other), "data")

    points = dealt("rank = 0", "point_block", "query_block", 0)
    queries = dealt("asked", "query_block", "point_block", 1)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            none = pa.array([], pa.int64())
            return pa.table({"query_id": none, "vec_id": none, "score": pa.array([], pa.float64())})
        p, q = (np.frombuffer(b"".join(t.column("data").to_pylist()), "<f8").reshape(len(t), -1) for t in (left, right))
        at, ids, scores = exact_nearest(p, left.column("vec_id").to_numpy(), q, right.column("vec_id").to_numpy(), k)
        return pa.table({"query_id": right.column("vec_id").to_numpy()[at], "vec_id": ids, "score": scores})

    return best_per_query(meet(points, queries, compare, SCHEMA), k, largest=False)


def exact_nearest(points: np.ndarray, point_ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int):
    """(position of the query, id, distance) of each query's k nearest ids but its own; of
    several points of an id the nearest counts."""
    out = ([], [], [])
    repeated = len(np.unique(point_ids)) < len(point_ids)
    if repeated:
        # Points of an id lie side by side, so that distances fold to ids before the cut to k.
        sort = np.argsort(point_ids, kind="stable")
        points, point_ids = points[sort], point_ids[sort]
    starts = np.flatnonzero(np.r_[True, point_ids[1:] != point_ids[:-1]])
    norms = (points**2).sum(axis=1)
    for start in range(0, len(queries), 64):
        q = queries[start:start + 64]
        rough = (q**2).sum(axis=1)[:, None] + norms[None, :] - 2 * q @ points.T
        valid = query_ids[start:start + 64, None] != point_ids[None, :]
        rough = np.where(valid, rough, np.inf)
        if len(starts) > k:
            least = np.minimum.reduceat(rough, starts, axis=1) if repeated else rough
            last = np.partition(least, k - 1, axis=1)[:, k - 1, None]
            # The expanded form is off by rounding; all that may belong is measured exactly.
            valid &= rough <= last + 1e-9 * (1 + norms.max() + (q**2).sum(axis=1)[:, None])
        row, at = np.nonzero(valid)
        distance = np.zeros(len(row))
        for part in range(0, len(row), 16_384):
            here = np.s_[part:part + 16_384]
            distance[here] = np.sqrt(((points[at[here]] - q[row[here]]) ** 2).sum(axis=1))
        order = np.lexsort((point_ids[at], distance, row))
        row, at, distance = row[order], at[order], distance[order]
        if repeated:
            once = first_of_each(row, point_ids[at])
            row, at, distance = row[once], at[once], distance[once]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        for held, part in zip(out, (row[first] + start, point_ids[at[first]], distance[first])):
            held.append(part)
    return tuple(np.concatenate(x) for x in out)
