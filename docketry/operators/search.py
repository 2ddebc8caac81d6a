"""Filtered top-k cosine search, more-like-this, and many queries at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docketry.batches import give_back
from docketry.functions.record import abstract_preview
from docketry.functions.vectors import cosine_pairs, cosine_to, to_matrix, unit_rows
from docketry.session import fresh_folder, saved

SCORE = "similarity_score"
LIMIT = 10
SEMANTIC_MIN_SCORE = 0.5
SIMILAR_LIMIT = 5
# Bytes, in double precision, of one query matrix, of a block of points and of a part of them.
QUERY_MATRIX_BYTES = 4 << 20
POINT_BLOCK_BYTES = 8 << 20
PART_BYTES = 64 << 20
# Bytes of the query matrices that are broadcast at one time.
ROUND_BYTES = 32 << 20
# Parts in which the hits of one query are merged before they meet.
MERGE_PARTS = 32
# Scores held in memory at one time, products made at one time, and rows whose best is looked at.
_CELLS_AT_ONCE, _PRODUCTS, _GROUP = 4_000_000, 1 << 20, 32
# Pairs scored at one time, about, and rows that give the first floors.
_HITS_AT_ONCE, _FIRST_ROWS = 1 << 16, 256
# Bytes of vectors of single pairs scored at one time.
_PAIR_BYTES = 8 << 20
_ANY, _OTHER = -1, -2


def _order() -> list[Column]:
    return [F.desc(SCORE), F.asc("point_id")]


def score(points: DataFrame, vector: Sequence[float], where: Column | None = None, min_score: float = 0.0) -> DataFrame:
    """Points that pass the filter, with their cosine to `vector`, at `min_score` or above.

    The filter runs first, so only its rows are scored.
    """
    if where is not None:
        points = points.filter(where)
    scored = points.withColumn(SCORE, cosine_to(F.col("vector"), vector))
    return scored.filter(F.col(SCORE) >= min_score)


def top(scored: DataFrame, limit: int) -> DataFrame:
    """The best `limit` rows with their rank from 1; ties go by point id."""
    best = scored.orderBy(*_order()).limit(limit)
    # One task ranks the few rows that are left.
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*_order())))


def search(
    points: DataFrame,
    vector: Sequence[float],
    limit: int = LIMIT,
    where: Column | None = None,
    min_score: float = 0.0,
    query: str | None = None,
) -> DataFrame:
    found = top(score(points, vector, where, min_score), limit).drop("vector")
    return found if query is None else found.withColumn("search_query", F.lit(query))


def semantic_search(points: DataFrame, vector: Sequence[float], limit: int = LIMIT, min_score: float = SEMANTIC_MIN_SCORE, query: str | None = None) -> DataFrame:
    return search(points, vector, limit, min_score=min_score, query=query)


def lookup(points: DataFrame, patent_id: str) -> DataFrame:
    """The point with this id, or none; the smallest point id where there are several."""
    return points.filter(F.col("patent_id") == patent_id).orderBy("point_id").limit(1)


def similar(points: DataFrame, patent_id: str, limit: int = SIMILAR_LIMIT, min_score: float = SEMANTIC_MIN_SCORE) -> DataFrame:
    """Points nearest to one point, that one left out; empty when the id is unknown.

    Ranks are given before the point itself is dropped, so they usually start at 2.
    """
    reference = lookup(points, patent_id).select("vector").first()
    if reference is None:
        points, vector = points.filter(F.lit(False)), [0.0]
    else:
        vector = reference.vector
    ranked = top(score(points, vector, min_score=min_score), limit + 1)
    others = ranked.filter(F.col("patent_id") != patent_id).orderBy("rank").limit(limit)
    return others.drop("vector").withColumn("reference_patent_id", F.lit(patent_id))


def preview(results: DataFrame) -> DataFrame:
    """Search results in the short form shown to a reader."""
    return results.select(
        "rank", "title", "patent_id",
        F.format_string("%.3f", F.col(SCORE)).alias("score"),
        "technology_field",
        F.concat_ws(", ", "assignees").alias("assignees"),
        "filing_date",
        abstract_preview().alias("abstract"),
    )


# --- many queries ----------------------------------------------------------

_HITS = T.StructType([
    T.StructField("query_id", T.StringType()),
    T.StructField("point_id", T.StringType()),
    T.StructField(SCORE, T.DoubleType()),
    T.StructField("block", T.LongType()),
    T.StructField("at", T.IntegerType()),
])
_NO_HITS = pa.schema([("query_id", pa.string()), ("point_id", pa.string()), (SCORE, pa.float64()), ("block", pa.int64()), ("at", pa.int32())])


class _Best:
    """The best rows per query over the batches seen so far.

    `seen` has for each query the scores of hits found elsewhere, best first, and -inf where
    there are fewer than `limit`: rows with `limit` better ones, these included, are dropped.
    """

    def __init__(self, ids: Sequence[str] | pa.Array, matrix: np.ndarray, fields: Sequence[str | None] | None, limit: int, floors: np.ndarray, seen: np.ndarray | None = None):
        self.ids = ids if isinstance(ids, pa.Array) else pa.array(ids, pa.string())
        self.matrix, self.limit = matrix, limit
        fields = fields or [None] * len(self.ids)
        self.codes = {f: i for i, f in enumerate(sorted({f for f in fields if f is not None}))}
        self.wanted = np.array([self.codes.get(f, _ANY) if f is not None else _ANY for f in fields], dtype="int64")
        # A row must reach this score to be among the best of a query.
        self.floor = np.array(floors, "float64")
        self.held = [(np.empty(0, "int64"), np.empty(0), np.empty(0, dtype=object), np.empty(0, bool))]
        if seen is not None:
            self.floor = np.maximum(self.floor, seen[:, -1])
            q, k = np.nonzero(np.isfinite(seen))
            self.held = [(q, seen[q, k], np.full(len(q), None, dtype=object), np.ones(len(q), bool))]
        # Single precision tells which pairs may reach it: a product of unit vectors is off by
        # at most about their size times the unit of rounding, 6e-8.
        self.unit = np.ascontiguousarray(unit_rows(matrix.astype("float64")).astype("float32").T)
        self.slack = 1e-6 + 2.4e-7 * matrix.shape[1]
        self.bar = np.maximum(self.floor - self.slack, -2).astype("float32")
        self.waiting, self.begun = 0, False

    def add(self, points: pa.Array, vectors: pa.Array, fields: pa.Array | None) -> None:
        matrix, rows = to_matrix(vectors, self.matrix.shape[1])
        self.meet(points.take(pa.array(rows)), matrix, fields if fields is None else fields.take(pa.array(rows)))

    def meet(self, points: pa.Array, matrix: np.ndarray, fields: pa.Array | None) -> None:
        """Take in rows; those without a direction (infinite values) are left out."""
        unit, row_code = unit_rows(matrix.astype("float64")).astype("float32"), None
        whole = np.flatnonzero(np.isfinite(unit).all(axis=1))
        unit = unit if len(whole) == len(unit) else unit[whole]
        if self.codes:
            names = [None] * len(points) if fields is None else fields.to_pylist()
            row_code = np.array([self.codes.get(f, _OTHER) for f in names], dtype="int64")[whole]
        most, pending, found = max(_HITS_AT_ONCE, 4 * len(self.ids)), [], 0

        def products(part: slice, out: np.ndarray | None = None) -> np.ndarray:
            product = np.matmul(unit[part], self.unit, out=out)
            if row_code is not None:
                product[(self.wanted != _ANY) & (row_code[part, None] != self.wanted)] = -np.inf
            return product

        if not self.begun:
            # What `limit` of the first rows reach by single precision is a floor from the start.
            first = min(len(unit), max(_FIRST_ROWS, 4 * self.limit), _CELLS_AT_ONCE // max(len(self.ids), 1))
            if first >= self.limit:
                reached = np.partition(products(slice(0, first)), first - self.limit, axis=0)[first - self.limit]
                self.bar, self.begun = np.maximum(self.bar, reached - np.float32(2 * self.slack)), True
        step, even = _GROUP * max(1, _PRODUCTS // (_GROUP * max(len(self.ids), 1))), len(unit) // _GROUP * _GROUP
        cuts, out = [*range(0, even, step), even, len(unit)], np.empty((min(step, len(unit)), len(self.ids)), "float32")
        for start, stop in zip(cuts, cuts[1:]):
            if start == stop:
                continue
            # The best of each group of rows shows which groups a query has to look at.
            grouped = products(slice(start, stop), out[: stop - start]).reshape(-1, min(_GROUP, stop - start), len(self.ids))
            group, q = np.nonzero(grouped.max(axis=1) >= self.bar)
            for low in range(0, len(q), _CELLS_AT_ONCE // _GROUP):
                some, asked = group[low : low + _CELLS_AT_ONCE // _GROUP], q[low : low + _CELLS_AT_ONCE // _GROUP]
                which, place = np.nonzero(grouped[some, :, asked] >= self.bar[asked, None])
                pending.append((start + some[which] * grouped.shape[1] + place, asked[which]))
                found += len(which)
                if found > most:
                    self._settle(points, matrix, whole, pending)
                    pending, found = [], 0
        self._settle(points, matrix, whole, pending)

    def _settle(self, points: pa.Array, matrix: np.ndarray, whole: np.ndarray, pending: list) -> None:
        """Score the pairs that may reach their floor, and hold those that do."""
        if not pending:
            return
        r, q = (np.concatenate(x) for x in zip(*pending))
        r = whole[r]
        scores = self._scores(matrix, r, q)
        reached = scores >= self.floor[q]
        r, q = r[reached], q[reached]
        names = np.empty(len(r), dtype=object)
        names[:] = points.take(pa.array(r)).to_pylist()
        self.held.append((q, scores[reached], names, np.zeros(len(r), bool)))
        self.waiting += len(r)
        if self.waiting > max(_HITS_AT_ONCE, 2 * len(self.ids)):
            self._keep_best()

    def _scores(self, matrix: np.ndarray, r: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The scores of the pairs (r, q)."""
        scores, step = np.empty(len(r)), max(1, _PAIR_BYTES // (8 * matrix.shape[1]))
        for start in range(0, len(r), step):
            some = slice(start, start + step)
            scores[some] = cosine_pairs(matrix[r[some]].astype("float64"), self.matrix[q[some]].astype("float64"))
        return scores

    def _keep_best(self) -> None:
        q, score, point, seen = (np.concatenate(x) for x in zip(*self.held))
        # Of equal scores those seen elsewhere come last, since their ids are not known here.
        order = np.lexsort((seen, -score, q))
        q, score, point, seen = q[order], score[order], point[order], seen[order]
        same = (q[1:] == q[:-1]) & (score[1:] == score[:-1]) & ~seen[1:]
        tied = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
        if len(tied):
            ranks = {x: i for i, x in enumerate(sorted(set(point[tied]), key=lambda x: (x is not None, x or "")))}
            by_id = np.array([ranks[x] for x in point[tied]])
            within = tied[np.lexsort((by_id, -score[tied], q[tied]))]
            point[tied] = point[within]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.limit - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], score[last])
        self.bar = np.maximum(self.bar, (self.floor - self.slack).astype("float32"))
        kept = place < self.limit
        self.held = [(q[kept], score[kept], point[kept], seen[kept])]
        self.waiting = 0

    def batch(self, block: int | None = None) -> pa.RecordBatch:
        self._keep_best()
        q, score, point, seen = (x[~self.held[0][3]] for x in self.held[0])
        columns = [self.ids.take(pa.array(q)), pa.array(point, pa.string()), pa.array(score, pa.float64()), pa.array([block] * len(q), pa.int64()), pa.array(q, pa.int32())]
        return pa.record_batch(columns, schema=_NO_HITS)


_BLOCK = "cell bigint, dim int, ids array<string>, matrix binary, fields array<string>"


def _with_field(frame: DataFrame) -> Column:
    return F.col("technology_field") if "technology_field" in frame.columns else F.lit(None).cast("string")


def packed(rows: DataFrame, kind: str, block_bytes: int) -> DataFrame:
    """Rows (id, vector, technology_field, cell) as blocks: their ids, their vectors as one matrix
    of `kind`, and their fields, null if all are. A block has vectors of one size and cell,
    `block_bytes` at most in double precision; vectors that are null or empty share one of size 0.

    Rows of a partition are packed as they come, so those of a cell should follow each other.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[pa.RecordBatch]] = {}
        cell = None

        def blocks(dim: int, whole: bool) -> Iterator[pa.RecordBatch]:
            table, step = pa.Table.from_batches(waiting.pop(dim)).combine_chunks(), max(1, block_bytes // (8 * max(dim, 1)))
            for start in range(0, len(table), step):
                some = table.slice(start, step)
                if len(some) < step and not whole:
                    waiting[dim] = some.to_batches()
                    break
                values = pc.cast(some.column("vector").combine_chunks().flatten(), pa.float64()).to_numpy(zero_copy_only=False)
                fields = some.column("technology_field")
                yield pa.record_batch([
                    pa.array([cell], pa.int64()), pa.array([dim], pa.int32()),
                    pa.array([some.column("id").to_pylist()], pa.list_(pa.string())),
                    pa.array([values.astype(kind).tobytes()], pa.binary()),
                    pa.array([None if fields.null_count == len(fields) else fields.to_pylist()], pa.list_(pa.string())),
                ], names=["cell", "dim", "ids", "matrix", "fields"])

        for batch in batches:
            cells = batch.column("cell").to_numpy()
            cuts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else []
            for start, stop in zip(cuts, [*cuts[1:], len(cells)]):
                if cells[start] != cell:
                    for dim in [*waiting]:
                        yield from blocks(dim, True)
                    cell = int(cells[start])
                run = batch.slice(start, stop - start)
                sizes = pc.fill_null(pc.list_value_length(run.column("vector")), 0)
                for dim in pc.unique(sizes).to_pylist():
                    # A copy, so that what waits does not hold its whole batch.
                    waiting.setdefault(dim, []).append(run.filter(pc.equal(sizes, dim)))
                    if sum(map(len, waiting[dim])) * 8 * max(dim, 1) >= block_bytes:
                        yield from blocks(dim, False)
                if sum(dim * len(x) for dim, held in waiting.items() for x in held) * 8 > 4 * block_bytes:
                    for dim in [*waiting]:
                        yield from blocks(dim, True)
        for dim in [*waiting]:
            yield from blocks(dim, True)

    return rows.select("id", "vector", "technology_field", "cell").mapInArrow(pack, _BLOCK).withColumn("block", F.monotonically_increasing_id())


def meet(points: DataFrame, asked: DataFrame, limit: int, min_score: float, kind: str = "float64", where: Column | None = None) -> DataFrame:
    """The best `limit` points for each query of `asked`, for each partition of `points`; saved.

    Both are saved blocks (`packed`), `points` in single precision, `asked` of `kind` and with
    `seen` where hits are known (`with_seen`). Blocks of about ROUND_BYTES are asked in a round: they are
    broadcast, and every task takes the points of a partition as they come. No vector is shuffled.
    `where` says on `asked` and the columns of `points`, named with `to_` in front, which blocks meet.
    """
    other = points.select([F.col(c).alias(f"to_{c}") for c in ("cell", "dim", "ids", "matrix", "fields")])
    asked = asked if "seen" in asked.columns else asked.withColumn("seen", F.lit(None).cast("binary"))
    met = F.col("dim") == F.col("to_dim") if where is None else (F.col("dim") == F.col("to_dim")) & where

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Best] = {}
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                block, dim = row["block"].as_py(), row["dim"].as_py()
                if block not in held:
                    ids = pa.array(row["ids"].as_py(), pa.string())
                    matrix = np.array(np.frombuffer(row["matrix"].as_buffer(), kind)).reshape(len(ids), dim)
                    seen = np.frombuffer(row["seen"].as_py()).reshape(-1, limit) if row["seen"].is_valid else None
                    if seen is not None:
                        seen = np.vstack([seen, np.full((len(ids) - len(seen), limit), -np.inf)])
                    held[block] = _Best(ids, matrix, row["fields"].as_py(), limit, np.full(len(ids), min_score), seen)
                vectors = np.frombuffer(row["to_matrix"].as_buffer(), "float32").reshape(-1, dim)
                held[block].meet(row["to_ids"].values, vectors, row["to_fields"].values if row["to_fields"].is_valid else None)
        while held:
            block, best = held.popitem()
            yield best.batch(block)
        give_back()

    columns = ["block", "dim", "ids", "matrix", "fields", "seen", "to_ids", "to_matrix", "to_fields"]
    size = asked.agg(F.coalesce(F.sum(F.length("matrix")), F.lit(0)).alias("n")).first()["n"]
    rounds, folder = max(1, -(-size // ROUND_BYTES)), fresh_folder(points.sparkSession, "met")
    for i in range(rounds):
        some = asked.filter(F.pmod(F.xxhash64("block"), F.lit(rounds)) == i)
        other.join(F.broadcast(some), met).select(columns).mapInArrow(scan, _HITS).write.mode("append").parquet(folder)
    return points.sparkSession.read.schema(_HITS).parquet(folder)


def with_seen(asked: DataFrame, hits: DataFrame, limit: int) -> DataFrame:
    """Saved blocks with the scores of these hits, which a further point must be among."""
    def line_up(table: pa.Table) -> pa.Table:
        at, score = table.column("at").to_numpy(), table.column(SCORE).to_numpy()
        order = np.lexsort((-score, at))
        at, score = at[order], score[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        seen = np.full((at[-1] + 1, limit), -np.inf)
        seen[at[place < limit], place[place < limit]] = score[place < limit]
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int64()), "seen": pa.array([seen.tobytes()], pa.binary())})

    seen = hits.select("block", "at", SCORE).groupBy("block").applyInArrow(line_up, "block bigint, seen binary")
    return asked.join(seen, "block", "left")


def best_hits(hits: DataFrame, limit: int, partitions: int) -> DataFrame:
    """The best `limit` hits of each query with their rank; one with hits from very many
    partitions is cut down by parts first."""
    if partitions > MERGE_PARTS:
        part = Window.partitionBy("query_id", F.pmod(F.xxhash64("point_id"), F.lit(MERGE_PARTS))).orderBy(*_order())
        hits = hits.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= limit).drop("rank")
    per_query = Window.partitionBy("query_id").orderBy(*_order())
    return hits.withColumn("rank", F.row_number().over(per_query)).filter(F.col("rank") <= limit)


def search_batch(
    points: DataFrame,
    queries: DataFrame,
    limit: int = LIMIT,
    min_score: float = 0.0,
    matrix_bytes: int = QUERY_MATRIX_BYTES,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """The best `limit` points of each query: query_id, point_id, score, rank.

    `queries` has `query_id`, unlike in all rows, `vector` and, optionally, `technology_field`:
    only points of that field are searched, all of them where it is null. A query meets the
    points whose vectors have its own size; one without a vector fails the search.

    Points and queries are written to the shared folder once, vectors computed and packed to
    blocks, queries to matrices of `matrix_bytes`; some matrices at a time meet all points, and
    only hits are shuffled. Of more than MERGE_PARTS parts of `part_bytes` the root of
    their number is met first: a point elsewhere must be better than the hits found there.
    """
    one = F.lit(0).cast("bigint").alias("cell")
    asked = saved(packed(queries.select(
        F.col("query_id").cast("string").alias("id"), F.col("vector").cast("array<double>").alias("vector"), _with_field(queries).alias("technology_field"), one,
    ), "float64", matrix_bytes), "queries")
    if not asked.filter(F.col("dim") < 1).isEmpty():
        raise ValueError("every query needs a vector")
    usable = points.select(F.col("point_id").alias("id"), F.col("vector").cast("array<float>").alias("vector"), _with_field(points).alias("technology_field"), one)
    # Those without a vector are left out as blocks: a filter on vectors would be moved below what computes them, and so
    # compute them twice.
    stored = saved(packed(usable, "float32", min(POINT_BLOCK_BYTES, part_bytes)).filter("dim > 0"), "points")
    size = stored.agg(F.coalesce(F.sum(F.length("matrix")), F.lit(0)).alias("n")).first()["n"]
    parts, partitions = -(-2 * size // part_bytes), stored.rdd.getNumPartitions()
    found = ["query_id", "point_id", SCORE]
    if parts <= MERGE_PARTS:
        return best_hits(meet(stored, asked, limit, min_score).select(found), limit, partitions)
    part = F.pmod(F.xxhash64("block"), F.lit(parts))
    seeds = int(np.ceil(np.sqrt(parts)))
    first = saved(best_hits(meet(stored.filter(part < seeds), asked, limit, min_score), limit, partitions), "hits")
    again = saved(with_seen(asked, first, limit), "asked")
    rest = meet(stored.filter(part >= seeds), again, limit, min_score)
    return best_hits(first.select(found).unionByName(rest.select(found)), limit, partitions)


def text_queries(spark: SparkSession, queries: Sequence[tuple[str, str, str | None]], embedder) -> DataFrame:
    """A query frame out of (id, text, technology field or None)."""
    vectors = embedder.encode([q[1] for q in queries])
    rows = [(*q, v.tolist()) for q, v in zip(queries, vectors)]
    return spark.createDataFrame(
        rows, "query_id string, search_query string, technology_field string, vector array<float>"
    )
