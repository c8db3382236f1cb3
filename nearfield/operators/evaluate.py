"""Recall of search results against a ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall(result: DataFrame, truth: DataFrame, k: int, r: int | None = None) -> DataFrame:
    """Share of the first ``k`` true neighbours found among the first ``r`` results (``r = k`` by
    default) -> (queries, hits, recall). Queries are matched by id and counted from the truth."""
    near = truth.where(F.col("rank") <= k).select("q", "id").distinct()
    got = result.where(F.col("rank") <= (r or k)).select("q", "id", F.lit(1).alias("hit")).distinct()
    return (
        near.join(got, ["q", "id"], "left")
        .groupBy("q").agg(F.count("hit").alias("hits"))
        .agg(F.count("*").alias("queries"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))
        .withColumn("recall", F.col("hits") / (F.lit(k) * F.col("queries")))
    )
