"""What the text operators share: input columns, shared tables, packed integer arrays."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import MB, shared_dir, written

__all__ = ["MB", "bucket_count", "documents", "joined", "pack", "row_key", "squeezed", "squeezed_strings", "text_bytes", "unpack", "unused",
           "widened", "widened_strings", "written", "written_buckets"]


def documents(df: DataFrame, *extra: Column | str) -> DataFrame:
    """``doc_id`` and ``text`` with null text as the empty string, and nothing else of ``df``."""
    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra,
    )


def row_key() -> Column:
    """A hash of id and text, which rows that agree in both share."""
    return F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit("")))


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts; sizes shards and buckets, never decides a result."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def bucket_count(docs: DataFrame, size: int, each: int) -> int:
    """Buckets for ``size`` bytes of text; no fewer than shuffle partitions, else joins would not read them in place."""
    return max(1, size // each, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def written_buckets(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` to the shared folder hashed into ``buckets`` files sets by ``key``.

    A later join on ``key`` reads the table in place, so wide rows are not shuffled.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    (
        df.write.format("parquet").option("compression", "zstd")
        .option("path", f"{shared_dir(spark).rstrip('/')}/{table}")
        .bucketBy(buckets, key).saveAsTable(table)
    )
    return spark.table(table)


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers as four byte planes, which compress well when values are small."""
    return np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def squeezed(values: np.ndarray) -> bytes:
    """Non-negative integers below 2^32 as a zstd frame, so that rows of a table stay small on the JVM side."""
    import zstandard

    return zstandard.compress(pack(values), 1)


def widened(data: bytes) -> np.ndarray:
    import zstandard

    return unpack(zstandard.decompress(data))


def joined(strings: pa.Array, separator: str) -> str:
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(strings)], pa.int64()), strings), separator)[0].as_py()


def squeezed_strings(strings: pa.Array) -> bytes:
    """Strings without line ends as a zstd frame."""
    import zstandard

    return zstandard.compress(f"{len(strings)}\n{joined(strings, chr(10))}".encode(), 1)


def widened_strings(data: bytes) -> pa.Array:
    import zstandard

    count, *strings = zstandard.decompress(data).decode().split("\n")
    return pa.array(strings[: int(count)], pa.string())
