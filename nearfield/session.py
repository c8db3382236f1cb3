"""Session helpers: checkpoint folder, size checks, partition counts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

MB = 1 << 20

#: Largest table (bytes, as Catalyst estimates it) that may be sent whole to every executor.
BROADCAST_LIMIT = 64 * MB
#: Target size of one shuffle partition written by an explicit repartition.
PARTITION_BYTES = 64 * MB


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can write to, as named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a temporary folder; on a cluster a
    machine-local path would be lost with the machine, so the setting is required.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="nearfield-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts the lineage and survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, name: str) -> str:
    """A folder in the shared folder that nothing has been written to."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of ``new_path`` that no table is read from any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once as a parquet table in the shared folder and read it back.

    Unlike a checkpoint the table keeps column pruning, filter pushdown and a size estimate,
    so it is the form used for tables that many later jobs read (graphs, codes).
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, table: str, buckets: int) -> DataFrame:
    """Save a base or graph table bucketed and sorted by id, so that later joins on id read it in
    place whatever the size of the other side, and id filters skip row groups."""
    df.write.bucketBy(buckets, "id").sortBy("id").saveAsTable(table)
    return df.sparkSession.table(table)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df`` (file sizes for scans, worst case when unknown)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits_broadcast(*dfs: DataFrame, limit: int = BROADCAST_LIMIT) -> bool:
    return all(plan_bytes(df) <= limit for df in dfs)


def partitions_for(spark: SparkSession, rows: int, row_bytes: int, min_rows: int = 64) -> int:
    """Partition count for an explicit repartition: enough for every core when there is work
    for it, more when the data would otherwise exceed ``PARTITION_BYTES`` per partition."""
    cores = spark.sparkContext.defaultParallelism
    by_work = min(cores, -(-rows // min_rows))
    by_size = -(-rows * row_bytes // PARTITION_BYTES)
    return max(1, by_work, by_size)
