"""Exact top-k by inner product, as columnar branch-and-bound.

Vectors are whole numbers, floor(scale * component). In a block of points the vectors lie
dimension by dimension, the longest first, and meet the queries chunk by chunk. Partial
scores are summed over blocks of dimensions, those with most spread first. What the
dimensions left can still add is at most the product of the lengths of both rests
(Cauchy-Schwarz), so a point whose partial score plus that bound is below a query's running
k-th best, carried from chunk to chunk, cannot enter; each query's survivors are compacted
before the next dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.blocks import best_per_query, by_length, first_of_each, meet, row_keys, spread_blocks, unlike, vectors

SCALE = 64
#: Most rows of a block of points and of queries; at least this many blocks of points, so that
#: small inputs use several executors too.
POINT_ROWS, QUERY_ROWS, LEAST_BLOCKS = 65_536, 16_384, 8
#: Bytes of a block's vectors, whatever their length; an Arrow column takes 2**31.
BLOCK_BYTES = 1 << 28
DIMENSIONS = 8
QUERIES_AT_ONCE = 32
#: Points that meet the queries at once: few at first, so that there soon is a k-th best.
FIRST_CHUNK, CHUNK = 128, 4096
#: Pairs are multiplied as a matrix while more than this share of them stays.
DENSE_SHARE, PAIRS = 0.25, 65_536
SCHEMA = "query_id bigint, vec_id bigint, score bigint"


def exact_top(
    points: np.ndarray, point_ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(position of the query, id, score) of each query's k best points, and the share of
    components that were read. Points with the query's own id are left out; of several
    points of an id the best counts."""
    # Sums below 2**53 are exact in doubles, which multiply fast.
    kind = "float64" if _safe(points, queries) else "int64"
    spread = np.argsort(-points.astype("float64").var(axis=0), kind="stable")
    longest = np.argsort(-(points.astype("float64") ** 2).sum(axis=1), kind="stable")
    points, point_ids = points[longest], point_ids[longest]
    columns = np.ascontiguousarray(points[:, spread].T.astype(kind))
    asked = queries[:, spread].astype(kind)
    cuts = [*range(0, len(columns), DIMENSIONS)]
    rest = lambda m, axis: np.stack([np.sqrt((np.delete(m, np.s_[:c], axis).astype("float64") ** 2).sum(axis)) for c in [*cuts, len(columns)]])
    point_rest, query_rest = rest(columns, 0), rest(asked, 1)
    chunks = [0]
    while chunks[-1] < len(point_ids):
        chunks.append(min(len(point_ids), chunks[-1] + min(CHUNK, max(FIRST_CHUNK, chunks[-1]))))
    read, out = 0, ([], [], [])
    for start in range(0, len(asked), QUERIES_AT_ONCE):
        here = np.s_[start:start + QUERIES_AT_ONCE]
        best = Best(len(asked[here]), k)
        for low, high in zip(chunks[:-1], chunks[1:]):
            # Points come by falling length, so what is out of reach here is so for good.
            if not reach(query_rest[0, here], point_rest[0, low], best.least).any():
                break
            part = np.s_[low:high]
            row, at, score, some = survivors(columns[:, part], point_rest[:, part], asked[here], query_rest[:, here], best.least, cuts)
            read += some
            names = point_ids[low:high][at]
            valid = query_ids[here][row] != names
            best.add(row[valid], names[valid], score[valid].astype("int64"))
        for parts, found in zip(out, (best.row + start, best.ids, best.scores)):
            parts.append(found)
    total = max(1, len(point_ids) * len(columns) * len(asked))
    return *(np.concatenate(x) if x else np.zeros(0, "int64") for x in out), read / total


class Best:
    """The k best ids of each of a few queries so far, and the score that a further one must reach."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.least = k, np.full(queries, -np.inf)
        self.row, self.ids, self.scores = (np.zeros(0, "int64") for _ in range(3))

    def add(self, row: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        row, ids, scores = (np.concatenate(x) for x in ((self.row, row), (self.ids, ids), (self.scores, scores)))
        order = np.lexsort((ids, -scores, row))
        row, ids, scores = row[order], ids[order], scores[order]
        once = first_of_each(row, ids)
        row, ids, scores = row[once], ids[once], scores[once]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.k
        self.row, self.ids, self.scores = row[kept], ids[kept], scores[kept]
        last = place == self.k - 1
        self.least[row[last]] = scores[last]


def reach(query: np.ndarray, point: np.ndarray, least: np.ndarray, score: np.ndarray | float = 0.0) -> np.ndarray:
    """Whether a partial score can still come to `least`; the slack covers rounding of the lengths."""
    return score + query * point * (1 + 1e-9) + 1e-6 >= least


def survivors(
    columns: np.ndarray, point_rest: np.ndarray, asked: np.ndarray, query_rest: np.ndarray, least: np.ndarray, cuts: list[int]
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, point, score) of all pairs that reach their query's `least`, and the number of components read.

    Pairs that stay many are multiplied as a matrix; few are compacted, each query's its own.
    """
    useful = reach(query_rest[0][:, None], point_rest[0][None, :], least[:, None])
    score = np.zeros(useful.shape, columns.dtype)
    row = at = values = None
    read = 0
    for c, cut in enumerate(cuts):
        block, part = columns[cut:cut + DIMENSIONS], asked[:, cut:cut + DIMENSIONS]
        if row is None and useful.sum() > DENSE_SHARE * useful.size:
            score += part @ block
            read += useful.size * len(block)
            useful &= reach(query_rest[c + 1][:, None], point_rest[c + 1][None, :], least[:, None], score)
            continue
        if row is None:
            row, at = np.nonzero(useful)
            values = score[row, at]
        for low in range(0, len(row), PAIRS):
            some = np.s_[low:low + PAIRS]
            values[some] += (part[row[some]] * block[:, at[some]].T).sum(axis=1)
        read += len(row) * len(block)
        kept = reach(query_rest[c + 1][row], point_rest[c + 1][at], least[row], values)
        row, at, values = row[kept], at[kept], values[kept]
    if row is None:
        row, at = np.nonzero(useful)
        values = score[row, at]
    return row, at, values, read


def _safe(a: np.ndarray, b: np.ndarray) -> bool:
    largest = [float(np.abs(x.astype("float64")).max(initial=0)) for x in (a, b)]
    return largest[0] * largest[1] * max(1, a.shape[1]) < 2**53


def top_k(embeddings: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each query.

    All rows whose `is_query` holds against all rows but those of the same id. Ties go to
    the smaller id; fewer candidates give fewer rows. Null or empty vectors and those with
    null or non-finite components take no part, nor do rows with a null id; a vector meets
    those of its own length only. A repeated id counts once per query, with its best score.
    Whole numbers beyond 2**62 either way become that bound, as no long score could hold their
    products; scores beyond 64 bits wrap, as long sums do. Other columns are left out; no rows give
    no rows.
    """
    rows = embeddings.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    rows = rows.filter("vec_id IS NOT NULL")
    counts = rows.agg(F.count("*").alias("n"), F.count_if(F.col("asked")).alias("asked"), F.max(F.size("vector")).alias("size")).first()
    most = max(1, BLOCK_BYTES // (8 * max(1, counts["size"] or 1)))
    point_blocks = max(LEAST_BLOCKS, -(-counts["n"] // min(POINT_ROWS, most)))
    query_blocks = max(1, -(-counts["asked"] // min(QUERY_ROWS, most)))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, values = vectors(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype("int64")[kept]
            asked = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)[kept]
            for size, here, matrix in by_length(kept, values):
                numbers = np.floor(SCALE * matrix).clip(-(2.0**62), 2.0**62).astype("<i8")
                once = unlike(ids[here], asked[here], numbers)
                here, numbers = here[once], numbers[once]
                raw, spread = numbers.tobytes(), row_keys(ids[here], numbers)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": ids[here],
                    "key": np.full(len(here), size, "int64"),
                    "asked": pa.array(asked[here]),
                    "point_block": spread_blocks(spread, point_blocks),
                    "query_block": spread_blocks(~spread, query_blocks),
                    "data": pa.array([raw[i * size * 8:(i + 1) * size * 8] for i in range(len(here))], pa.binary()),
                })

    known = rows.mapInArrow(whole, "vec_id bigint, key bigint, asked boolean, point_block bigint, query_block bigint, data binary")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    points = known.select("vec_id", "key", "point_block", every(query_blocks).alias("query_block"), "data")
    queries = known.filter("asked").select("vec_id", "key", every(point_blocks).alias("point_block"), "query_block", "data")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            empty = pa.array([], pa.int64())
            return pa.table({"query_id": empty, "vec_id": empty, "score": empty})
        size = left.column("key")[0].as_py()
        p, q = (np.frombuffer(b"".join(t.column("data").to_pylist()), "<i8").reshape(-1, size) for t in (left, right))
        point_ids, query_ids = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        at, ids, scores, _ = exact_top(p, point_ids, q, query_ids, k)
        return pa.table({"query_id": query_ids[at], "vec_id": ids, "score": scores})

    return best_per_query(meet(points, queries, compare, SCHEMA), k, largest=True)
