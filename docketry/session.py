"""Where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Where the setting is unset, a session in one process sets its own, once.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if not folder and spark.conf.get("spark.master", "").split("[")[0] == "local":
        folder = tempfile.mkdtemp(prefix="docketry-")
        spark.conf.set(CHECKPOINT_CONF, folder)
    if folder:
        return folder.rstrip("/")
    raise ValueError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark)}/docketry/{purpose}-{uuid.uuid4().hex}"


def saved(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame written to the shared folder and read again: it is computed once, and a lost
    executor costs no more than reading it again."""
    folder = fresh_folder(frame.sparkSession, purpose)
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def spread(frame: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal rows evenly, over the session's shuffle partitions unless told otherwise.

    For rows that come out of few tasks, as those of one unsplittable file, before work
    that costs much more per row than moving it.
    """
    return frame.repartition(partitions or int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def spread_if_narrow(scan: DataFrame) -> DataFrame:
    """Spread a plain table scan of fewer partitions than the session has cores over them.

    Only for scans: their partitions are known without running anything, while those of
    a frame with joins are not.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return spread(scan, cores) if scan.rdd.getNumPartitions() < cores else scan
