"""Folders of arriving files as streams: into a table, or into a collection."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from docketry.operators.normalize import REASON, accepted, enhance, normalize, rejected
from docketry.plans.collection import Collection
from docketry.schema import LIST_FIELDS, RECORD_FIELDS
from docketry.sources.load import read_files
from docketry.sources.markup import extract_xml
from docketry.sources.scan import ORDER, ORDER_TYPE, SOURCE, START, csv_scans, cut_xml, in_order, json_lines, scan_xml

_TYPED = T.StructType([
    T.StructField(c, T.ArrayType(T.StringType()) if c in LIST_FIELDS else T.StringType()) for c in RECORD_FIELDS
])


class Arriving(NamedTuple):
    """Rows of arriving files that a micro-batch finds by its files: a stream of their names, how
    their rows are read, and the layout of the rows. The batch readers let Spark cut such files,
    which takes more than one reading; a plain stream has one task for each file."""

    files: DataFrame
    read: Callable[[SparkSession, list[str]], DataFrame]
    schema: T.StructType

    def rows(self, batch: DataFrame) -> DataFrame:
        """Of a micro-batch of names."""
        return self.read(batch.sparkSession, sorted(r.path for r in batch.collect()))

    def then(self, step: Callable[[DataFrame], DataFrame]) -> Arriving:
        nothing = self.files.sparkSession.createDataFrame([], self.schema)
        return Arriving(self.files, lambda spark, paths: step(self.read(spark, paths)), step(nothing).schema)


Stream = DataFrame | Arriving


def _names(spark: SparkSession, path: str, max_files: int) -> DataFrame:
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    arriving = spark.readStream.schema(schema).format("binaryFile").option("maxFilesPerTrigger", max_files).load(path)
    return arriving.select("path")


def _layout(*texts: str) -> T.StructType:
    place = T.StructType.fromDDL(f"{ORDER} {ORDER_TYPE}")
    return T.StructType([*(T.StructField(c, T.StringType()) for c in texts), *place.fields])


def _csv_files(columns: list[str], schema: T.StructType) -> Callable[[SparkSession, list[str]], DataFrame]:
    names = [c.lower() for c in columns]

    def read(spark: SparkSession, paths: list[str]) -> DataFrame:
        parts = csv_scans(spark, paths)
        for found in parts:
            if [c.lower() for c in found.columns[:-3]] != names:
                raise ValueError(f"a CSV file has the header {found.columns[:-3]}, the stream {columns}")
        parts = [found.toDF(*schema.names) for found in parts]
        return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)

    return read


def stream_raw(
    spark: SparkSession,
    path: str,
    format: str = "csv",
    max_files: int = 1000,
    columns: list[str] | None = None,
    row_tag: str | None = None,
) -> Stream:
    """Rows of a folder that files keep arriving in, found as the batch readers do: csv,
    json (a record per line), xml (whole files, or cut at `row_tag`) or parquet.

    `columns` gives the header of the CSV files when it is not the whole record layout.
    `max_files` bounds one micro-batch. CSV and whole XML files are read within the
    micro-batches, by their names (see Arriving); the others are plain streams.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", max_files)
    if format == "csv":
        columns = columns or list(RECORD_FIELDS)
        schema = _layout(*columns, REASON, SOURCE)
        return Arriving(_names(spark, path, max_files), _csv_files(columns, schema), schema)
    if format == "json":
        return json_lines(reader, path, ordered=False)
    if format == "parquet":
        stored = reader.schema(_TYPED).format(format).load(path)
        return stored.select("*", F.col("_metadata.file_path").alias(SOURCE))
    if format == "xml" and row_tag:
        return cut_xml(reader, path, row_tag)
    if format == "xml":
        return Arriving(_names(spark, path, max_files), scan_xml, _layout("xml", SOURCE))
    raise ValueError("format is csv, json, xml or parquet")


def _then(stream: Stream, step: Callable[[DataFrame], DataFrame]) -> Stream:
    return stream.then(step) if isinstance(stream, Arriving) else step(stream)


def _checked(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Normal rows with a `reject_reason`, by the steps of the batch readers."""
    raw = raw.drop(START, *({ORDER} - {*keep}))
    keep = (*(c for c in (SOURCE,) if c in raw.columns), *keep)
    return extract_xml(raw, keep=keep) if "xml" in raw.columns else normalize(raw, keep=keep)


def _records(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The records among the rows; what is not cleaned as it is extracted is cleaned here."""
    found = accepted(_checked(raw, keep)).drop(SOURCE)
    return found if "xml" in raw.columns else enhance(found)


def _rejects(raw: DataFrame) -> DataFrame:
    return rejected(_checked(raw)).select(SOURCE, REASON)


def stream_records(spark: SparkSession, path: str, format: str = "csv", **options) -> Stream:
    """The records of such a folder, as a stream; `options` are those of `stream_raw`."""
    return _then(stream_raw(spark, path, format, **options), _records)


def stream_rejects(spark: SparkSession, path: str, format: str = "csv", **options) -> Stream:
    """The rows of such a folder that are no records, with their file and `reject_reason`, as
    a stream of its own, with its own checkpoint."""
    return _then(stream_raw(spark, path, format, **options), _rejects)


def write_records(records: Stream, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a stream of records to a Parquet table, each exactly once.

    Files of a micro-batch of `Arriving` rows are written aside and then moved into the table
    under names of that checkpoint and batch; those of a batch that runs again are replaced.
    """
    if not isinstance(records, Arriving):
        writer = records.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    label = hashlib.md5(checkpoint.encode()).hexdigest()

    def apply(batch: DataFrame, batch_id: int) -> None:
        aside = f"{path}/_written/{label}-{batch_id}"
        records.rows(batch).write.mode("overwrite").parquet(aside)
        _move(batch.sparkSession, aside, path, f"part-{label}-{batch_id}-")

    writer = records.files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _move(spark: SparkSession, source: str, target: str, prefix: str) -> None:
    """Data files into another folder of the same store under a prefix, whose files they replace."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(target)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(hadoop.Path(folder, "_spark_metadata")):
        raise ValueError(f"{target} is the table of another kind of stream, whose readers see only its own files")
    for found in files.listStatus(folder):
        if found.getPath().getName().startswith(prefix):
            files.delete(found.getPath(), False)
    for found in files.listStatus(hadoop.Path(source)):
        name = found.getPath().getName()
        if name.startswith("part-") and not files.rename(found.getPath(), hadoop.Path(folder, prefix + name.removeprefix("part-"))):
            raise OSError(f"{found.getPath()} could not be moved to {target}")
    files.delete(hadoop.Path(source), True)


def upsert_stream(
    raw: Stream,
    collection: Collection,
    checkpoint: str,
    name: str,
    available_now: bool = True,
    compact_every: int = 100,
    rejects: str | None = None,
) -> StreamingQuery:
    """Feed a raw stream into a collection, micro-batch by micro-batch.

    A micro-batch that is run again after a failure finds its own commit under the
    stream's `name` and is left out. A later row of a batch wins over an earlier one, and
    a later batch over an earlier one. The changes are folded into the snapshot after
    every `compact_every` batches, which bounds what a reader has to merge. Rows that are no
    records are kept as Parquet below `rejects` if given, a folder per micro-batch, written
    anew if that runs again.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        label = f"{name}/{batch_id}"
        given = raw.rows(batch) if isinstance(raw, Arriving) else in_order(batch)
        if rejects:
            _rejects(given).write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")
        if not collection.has_batch(label):
            collection.upsert(_records(given, keep=(ORDER,)), batch=label)
        if (batch_id + 1) % compact_every == 0:
            collection.compact()

    stream = raw.files if isinstance(raw, Arriving) else raw
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def upsert_directory_stream(
    spark: SparkSession,
    path: str,
    collection: Collection,
    checkpoint: str,
    name: str,
    available_now: bool = True,
    compact_every: int = 100,
    rejects: str | None = None,
    max_files: int = 1000,
    options: dict[str, dict] | None = None,
) -> StreamingQuery:
    """Feed a folder where files of any supported format and header arrive into a collection.

    The stream is of file names, at most `max_files` in a micro-batch, which is read as
    `read_files` does with its `options`: each file by its suffix and its own header, later
    files of a batch over earlier ones by name. For the rest see upsert_stream; files of other
    formats are among the `rejects`.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        label = f"{name}/{batch_id}"
        found = read_files(batch.sparkSession, sorted(r.path for r in batch.collect()), options=options)
        if rejects:
            found.rejects.write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")
        if not collection.has_batch(label):
            collection.upsert(found.records, batch=label)
        if (batch_id + 1) % compact_every == 0:
            collection.compact()

    writer = _names(spark, path, max_files).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
