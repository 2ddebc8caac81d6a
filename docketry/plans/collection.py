"""A named set of points kept as Parquet.

Below the collection's path:

* `base/<version>-<id>`     a full snapshot, one row per point, laid out by point id
* `changes/<version>-<id>`  what one later commit put in; `gone/...` the patent ids it took out
* `commits`                 one JSON row per commit, naming the folders that make up the state

A commit becomes visible with its row in `commits`, which Spark writes last and as a
whole; folders of a failed commit are never named and so never read. One writer at a
time is assumed. Reading merges the snapshot with the changes since; `compact` folds
them into a new snapshot, so a stream of small upserts never rewrites the whole set.
`vacuum` removes the folders that only older commits name.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.functions.filters import ExactFilter, RecordFilter, any_of
from docketry.functions.vectors import VECTOR, HashingEmbedder
from docketry.operators import search as S
from docketry.operators import stats
from docketry.operators.changes import latest
from docketry.operators.normalize import embed
from docketry.schema import RECORD_SCHEMA
from docketry.session import saved
from docketry.sources.write import WRITERS

POINT_SCHEMA = T.StructType(
    [*RECORD_SCHEMA.fields, T.StructField("point_id", T.StringType()), T.StructField("vector", VECTOR)]
)
POINT_FIELDS = tuple(POINT_SCHEMA.names)
# The place at which a row was given: by file, by block of the file, by row.
_PLACE = T.StructType([T.StructField("file", T.StringType()), T.StructField("start", T.LongType()), T.StructField("row", T.LongType())])
_ORDERED = T.StructType([*POINT_SCHEMA.fields, T.StructField("seq", _PLACE)])

_COMMIT_SCHEMA = (
    "version long, base string, changes array<struct<version:long,folder:string>>, "
    "gone array<struct<version:long,folder:string>>, batch string"
)
# Searches for up to this many points fetch the other columns by point id afterwards.
FETCH_BY_KEY = 1000
_PREFIX = 4
# A compaction folds the rows of points put more often than this before it deals them out, and
# broadcasts up to this many ids taken out; with more it moves rows twice.
MANY = 1000
FEW_GONE = 100_000
_SHORT_LIST = 10


def _part(partitions: int) -> Column:
    """Even ranges of the point id, which is a uniform hash."""
    prefix = F.conv(F.substring("point_id", 1, _PREFIX), 16, 10).cast("int")
    return F.floor(prefix * F.lit(partitions) / F.lit(16**_PREFIX)).cast("int")


def _by_prefix(points: DataFrame, partitions: int) -> DataFrame:
    """Sorted files over even ranges of the point id."""
    return points.repartitionById(partitions, _part(partitions)).sortWithinPartitions("point_id")


def _alive(state: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the points that were put before their patent id was taken out."""
    dead = (F.col("patent_id") == F.col("_id")) & (F.col("_version") < F.col("_gone"))
    return state.join(gone, dead, "left_anti")


def _id_in(ids: list[str]) -> Column:
    """In several short lists, as only those are compared value by value with the
    statistics of a Parquet row group."""
    chunks = [ids[i : i + _SHORT_LIST] for i in range(0, len(ids), _SHORT_LIST)]
    return any_of([F.col("point_id").isin(c) for c in chunks]) if chunks else F.lit(False)


class Collection:
    def __init__(self, spark: SparkSession, path: str, embedder=None):
        self.spark = spark
        self.path = path.rstrip("/")
        self.embedder = embedder or HashingEmbedder()

    # --- state ---

    def _commits(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(_COMMIT_SCHEMA).json(f"{self.path}/commits")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def _head(self):
        commits = self._commits()
        return None if commits is None else commits.orderBy(F.desc("version")).limit(1).first()

    def _commit(self, base: str | None, changes: list, gone: list, version: int, batch: str | None = None) -> None:
        row = (version, base, [tuple(c) for c in changes], [tuple(g) for g in gone], batch)
        self.spark.createDataFrame([row], _COMMIT_SCHEMA).coalesce(1).write.mode("append").json(f"{self.path}/commits")

    def _next(self):
        head = self._head()
        if head is None:
            return None, [], [], 1
        return head.base, head.changes, head.gone, head.version + 1

    def _fresh(self, kind: str, version: int) -> str:
        return f"{kind}/{version}-{uuid.uuid4().hex}"

    def _read(self, folder: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")

    def _read_versions(self, parts: list, schema: T.StructType) -> DataFrame:
        """The rows of several commits in one scan, with the `_version` that their folder names."""
        stored = self.spark.read.schema(schema).parquet(*[f"{self.path}/{p.folder}" for p in parts])
        version = F.regexp_extract(F.col("_metadata.file_path"), r"/(\d+)-[0-9a-f]{32}/[^/]*$", 1)
        return stored.withColumn("_version", version.cast("long"))

    def points(self) -> DataFrame:
        """The current points."""
        head = self._head()
        empty = self.spark.createDataFrame([], POINT_SCHEMA)
        if head is None:
            return empty
        base = self._read(head.base, POINT_SCHEMA) if head.base else empty
        if not head.changes and not head.gone:
            return base
        state = base.withColumn("_version", F.lit(0).cast("long"))
        if head.changes:
            puts = self._read_versions(head.changes, _ORDERED)
            puts = latest(puts, "point_id", [F.desc("_version"), F.desc("seq")]).drop("seq")
            state = state.join(puts.select("point_id"), "point_id", "left_anti").unionByName(puts)
        if head.gone:
            state = _alive(state, self._gone(head))
        return state.select(*POINT_FIELDS)

    def _gone(self, head) -> DataFrame:
        """Patent ids taken out, with the last commit that did."""
        gone = self._read_versions(head.gone, T.StructType([T.StructField("patent_id", T.StringType())]))
        return gone.groupBy(F.col("patent_id").alias("_id")).agg(F.max("_version").alias("_gone"))

    # --- writes ---

    def _ordered(self, records: DataFrame) -> DataFrame:
        """Points of the records with the order in which they were given."""
        order = F.col("seq") if "seq" in records.columns else F.monotonically_increasing_id()
        if "seq" not in records.columns or not isinstance(records.schema["seq"].dataType, T.StructType):
            order = F.struct(F.lit(""), F.lit(0), order)
        points = embed(records.withColumn("seq", order.cast(_PLACE)), self.embedder)
        return points.select(*POINT_FIELDS, "seq")

    def upsert(self, records: DataFrame, batch: str | None = None) -> int:
        """Add records, replacing points of the same id; returns how many were given.

        `seq` in the records says which of two equal points came last, else their order.
        """
        base, changes, gone, version = self._next()
        folder = self._fresh("changes", version)
        self._ordered(records).write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
        self._commit(base, [*changes, (version, folder)], gone, version, batch)
        return self._read(folder, _ORDERED).count()

    def delete(self, ids: DataFrame | Sequence[str], first_only: bool = False) -> int:
        """Take out the points of these patent ids; returns how many there were.

        `first_only` takes out only the point with the smallest point id of each.
        """
        if not isinstance(ids, DataFrame):
            ids = self.spark.createDataFrame([(i,) for i in ids], "patent_id string")
        base, changes, gone, version = self._next()
        folder = self._fresh("gone", version)
        ids.select("patent_id").distinct().write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
        ids = self.spark.read.parquet(f"{self.path}/{folder}")
        hit = self.points().join(ids, "patent_id", "left_semi")
        if not first_only:
            n = hit.count()
            self._commit(base, changes, [*gone, (version, folder)], version)
            return n
        # The others of these ids are put back in the same commit.
        first = latest(hit, "patent_id", [F.asc("point_id")]).select("point_id")
        n = first.count()
        rest = hit.join(first, "point_id", "left_anti").select(*POINT_FIELDS, F.lit(None).cast(_PLACE).alias("seq"))
        kept = self._fresh("changes", version)
        rest.write.option("compression", "zstd").parquet(f"{self.path}/{kept}")
        self._commit(base, [*changes, (version, kept)], [*gone, (version, folder)], version)
        return n

    def update(self, records: DataFrame) -> int:
        """Delete by patent id, then add; one point per patent id is left."""
        base, changes, gone, version = self._next()
        put, out = self._fresh("changes", version), self._fresh("gone", version)
        points = latest(self._ordered(records), "patent_id", [F.desc("seq")])
        points.write.option("compression", "zstd").parquet(f"{self.path}/{put}")
        written = self._read(put, _ORDERED)
        written.select("patent_id").write.option("compression", "zstd").parquet(f"{self.path}/{out}")
        self._commit(base, [*changes, (version, put)], [*gone, (version, out)], version)
        return written.count()

    def compact(self, partitions: int | None = None) -> None:
        """Fold all changes into a new snapshot."""
        _, _, _, version = self._next()
        partitions = partitions or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        folder = self._fresh("base", version)
        self._folded(partitions).write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
        self._commit(folder, [], [], version)

    def _folded(self, partitions: int) -> DataFrame:
        """The current points in the layout of a snapshot.

        The snapshot and all changes are dealt to its ranges, where the last row of each point is
        known, so that whole rows are moved once. Many rows of one point are folded before.
        """
        head = self._head()
        if head is None or not head.changes:
            return _by_prefix(self.points(), partitions)
        gone = self._gone(head).limit(FEW_GONE + 1) if head.gone else None
        if gone is not None and gone.count() > FEW_GONE:
            return _by_prefix(self.points(), partitions)
        state = self._without_repeats(self._read_versions(head.changes, _ORDERED)).withColumn("_own", F.lit(None).cast("long"))
        if head.base:
            # Points without an id replace none of the snapshot.
            own = F.when(F.col("point_id").isNull(), F.monotonically_increasing_id())
            base = self._read(head.base, POINT_SCHEMA).withColumns({"_version": F.lit(0).cast("long"), "seq": F.lit(None).cast(_PLACE), "_own": own})
            state = state.unionByName(base)
        dealt = state.withColumn("_part", F.coalesce(_part(partitions), F.lit(0))).repartitionById(partitions, "_part")
        state = latest(dealt, ["_part", "point_id", "_own"], [F.desc("_version"), F.desc("seq")])
        if gone is not None:
            state = _alive(state, F.broadcast(gone))
        return state.sortWithinPartitions("point_id").select(*POINT_FIELDS)

    def _without_repeats(self, puts: DataFrame) -> DataFrame:
        """Of points put more than MANY times the last row only; others may be left with several.
        Only ids are moved to find these points, and there are few by nature."""
        many = puts.filter("point_id IS NOT NULL").groupBy("point_id").count().filter(F.col("count") > MANY).select("point_id")
        many = saved(many, "many")
        if many.isEmpty():
            return puts
        last = latest(puts.join(many, "point_id", "left_semi"), "point_id", [F.desc("_version"), F.desc("seq")])
        return puts.join(many, "point_id", "left_anti").unionByName(last.select(*puts.columns))

    def clear(self) -> None:
        _, _, _, version = self._next()
        self._commit(None, [], [], version)

    def vacuum(self, keep_versions: int = 1) -> int:
        """Remove the folders that none of the last `keep_versions` commits names, those of
        failed commits too; returns how many. Nobody may be writing or reading older versions."""
        commits = self._commits()
        if commits is None:
            return 0
        named = set()
        for row in commits.orderBy(F.desc("version")).limit(keep_versions).collect():
            named |= {row.base, *(p.folder for p in [*row.changes, *row.gone])}
        removed = 0
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for kind in ("base", "changes", "gone"):
            folder = hadoop.Path(f"{self.path}/{kind}")
            files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for found in files.listStatus(folder) if files.exists(folder) else []:
                if f"{kind}/{found.getPath().getName()}" not in named:
                    removed += files.delete(found.getPath(), True)
        return removed

    def has_batch(self, batch: str) -> bool:
        commits = self._commits()
        return commits is not None and not commits.filter(F.col("batch") == batch).isEmpty()

    # --- reads ---

    def _vector(self, query: str) -> list[float]:
        return self.embedder.encode([query])[0].tolist()

    def search(
        self,
        query: str,
        limit: int = S.LIMIT,
        filters: ExactFilter | RecordFilter | Column | None = None,
        min_score: float = 0.0,
        columns: Sequence[str] = RECORD_SCHEMA.names,
    ) -> DataFrame:
        """The best points for a text.

        For the usual small limit only vectors and filtered columns are scanned; the
        other columns of the few hits are then read by point id, which skips all files
        and row groups of the snapshot that hold none of them.
        """
        where = filters.to_column() if isinstance(filters, (ExactFilter, RecordFilter)) else filters
        if isinstance(filters, RecordFilter):
            min_score = max(min_score, filters.min_score)
        points = self.points()
        vector = self._vector(query)
        if limit > FETCH_BY_KEY:
            found = S.search(points, vector, limit, where, min_score, query)
            return found.select(*columns, "point_id", S.SCORE, "search_query", "rank").orderBy("rank")
        hits = S.search(points, vector, limit, where, min_score).select("point_id", S.SCORE, "rank").collect()
        best = self.spark.createDataFrame(hits, f"point_id string, {S.SCORE} double, rank int")
        rows = points.filter(_id_in(sorted(h.point_id for h in hits)))
        return rows.join(F.broadcast(best), "point_id").select(
            *columns, "point_id", S.SCORE, F.lit(query).alias("search_query"), "rank"
        ).orderBy("rank")

    def semantic_search(self, query: str, limit: int = S.LIMIT, min_score: float = S.SEMANTIC_MIN_SCORE) -> DataFrame:
        return self.search(query, limit, min_score=min_score)

    def search_batch(self, queries: Sequence[tuple[str, str, str | None]], limit: int = S.LIMIT, min_score: float = 0.0) -> DataFrame:
        """Many (id, text, technology field or None) queries in one pass."""
        return S.search_batch(self.points(), S.text_queries(self.spark, queries, self.embedder), limit, min_score)

    def similar(self, patent_id: str, limit: int = S.SIMILAR_LIMIT, min_score: float = S.SEMANTIC_MIN_SCORE) -> DataFrame:
        return S.similar(self.points(), patent_id, limit, min_score)

    def lookup(self, patent_id: str) -> DataFrame:
        return S.lookup(self.points(), patent_id).select(*RECORD_SCHEMA.names)

    def stats(self, top: int = stats.TOP) -> DataFrame:
        return stats.facets(self.points(), top)

    def total(self) -> int:
        return self.points().count()

    def export(self, path: str, format: str = "json", limit: int | None = None) -> None:
        """Write the records, the first `limit` by point id if given."""
        WRITERS[format](first_points(self.points(), limit), path)


def first_points(points: DataFrame, limit: int | None = None) -> DataFrame:
    """All points, or the first `limit` of them, by point id and without vectors.

    A limit of any size is cut without gathering it in one task: points are counted per
    leading digits of their id, whole ranges below the cut are kept, and only of the range
    that the cut falls into are the first points taken. Points without an id are the last.
    """
    points = points.drop("vector")
    if limit is not None:
        prefix = F.substring("point_id", 1, _PREFIX)
        # At most 16 ** 4 ranges, as ids are hexadecimal.
        counts = points.groupBy(prefix.alias("prefix")).count().orderBy(F.asc_nulls_last("prefix")).collect()
        taken, cut = 0, None
        for c in counts:
            if taken + c["count"] > limit:
                cut = c
                break
            taken += c["count"]
        if cut is not None:
            whole = points.filter(prefix.isNotNull() if cut.prefix is None else prefix < cut.prefix)
            edge = points.filter(prefix.eqNullSafe(F.lit(cut.prefix))).orderBy("point_id")
            points = whole.unionByName(edge.limit(limit - taken))
    return points.orderBy("point_id")
