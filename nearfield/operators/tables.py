"""Preparing base and query tables: row positions, splits, filter attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint


def assign_ids(df: DataFrame, *order: str, name: str = "id") -> DataFrame:
    """Dense ids 0..n-1 in the order of the given columns, without sorting in one task.

    Rows are range-partitioned and sorted, each gets its position inside its partition, and the
    partitions' row counts (one row each) give the offsets. The sorted rows are checkpointed,
    since a second run of the range sampling could draw other borders.
    """
    placed = (
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    placed = checkpoint(placed).withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part").agg(F.count("*").alias("n"))
        .select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    )
    at = F.col("_at") - F.shiftleft(F.col("_part"), 33)
    return (
        placed.join(offsets, "_part")
        .withColumn(name, (at + F.col("_offset")).cast("long"))
        .drop("_at", "_part", "_offset")
    )


def round_robin(values: int, id: str = "id") -> Column:
    """Attribute 1..values by position. Ids are dense positions, so no window is needed."""
    return (F.pmod(F.col(id), F.lit(values)) + 1).cast("int")


def hashed(values: int, id: str = "q") -> Column:
    """Pseudo-random attribute 1..values, the same on every run."""
    return (F.pmod(F.xxhash64(id), F.lit(values)) + 1).cast("int")


def with_attribute(df: DataFrame, attributes: DataFrame, id: str = "id") -> DataFrame:
    """Set the attribute column from another table by id (UPDATE ... FROM); rows without a match
    keep null."""
    return df.drop("a1").join(attributes.select(id, "a1"), id, "left")


def split(df: DataFrame, share: float, key: str, salt: str = "") -> DataFrame:
    """Add ``part`` = 'test' for about ``share`` of the rows and 'train' for the others, decided
    by a hash of the key so that the split is stable and needs no shuffle."""
    digest = F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(salt))), 1, 8)
    point = F.conv(digest, 16, 10).cast("double") / F.lit(float(1 << 32))
    return df.withColumn("part", F.when(point < share, "test").otherwise("train"))
