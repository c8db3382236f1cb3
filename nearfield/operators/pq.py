"""Product quantisation: distance table, symmetric distance and search on codes.

A distance table has m x ksub^2 entries, whatever the data; its size is checked before it is
broadcast.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import l2sq, matrix
from .beam import Beam, search
from .blocks import PQTable
from .codebook import (
    check_size,
    codebook_arrays,
    encode,
    even_bounds,
    initial_codebook,
    train,
    train_step,
)
from .knn import exact_knn

__all__ = [
    "codebook_arrays", "encode", "even_bounds", "initial_codebook", "lut", "lut_array", "pq_knn",
    "pq_search", "register_distance", "train", "train_step",
]


def lut(codebook: DataFrame) -> DataFrame:
    """Squared distances between the centroids of one subspace -> (m, c1, c2, d2)."""
    a = codebook.select("m", F.col("c").alias("c1"), F.col("centroid").alias("x"))
    b = codebook.select("m", F.col("c").alias("c2"), F.col("centroid").alias("y"))
    return a.join(b, "m").select("m", "c1", "c2", l2sq("x", "y").alias("d2"))


def lut_array(table: DataFrame) -> np.ndarray:
    """The distance table on the driver as [m][ksub][ksub]."""
    m, k, n = table.agg(F.max("m") + 1, F.max("c1") + 1, F.count("*")).first()
    check_size(n)
    t = table.select("m", "c1", "c2", "d2").toArrow()
    out = np.zeros((m, k, k))
    out[tuple(t[c].to_numpy() for c in ("m", "c1", "c2"))] = t["d2"].to_numpy()
    return out


def register_distance(spark, table: np.ndarray, name: str | None = None) -> str:
    """Register the symmetric distance of two code arrays for SQL text; returns its name."""
    check_size(table.size)
    name = name or f"pq_distance_{uuid.uuid4().hex[:8]}"
    shared = spark.sparkContext.broadcast(table)

    @F.arrow_udf("double")
    def pq_distance(a: pa.Array, b: pa.Array) -> pa.Array:
        if len(a) == 0:
            return pa.array([], pa.float64())
        return pa.array(PQTable(shared.value).exact(matrix(a, np.int64), matrix(b, np.int64)))

    spark.udf.register(name, pq_distance)
    return name


def pq_knn(codes: DataFrame, queries: DataFrame, table: np.ndarray, k: int, **kw) -> DataFrame:
    """Exhaustive search by symmetric code distance."""
    check_size(table.size)
    return exact_knn(codes, queries, k, metric=PQTable(table), dtype=np.int64, **kw)


def pq_search(
    codes: DataFrame, graph: DataFrame, queries: DataFrame, entry: int, table: np.ndarray,
    l: int, w: int = 16, t: int = 5, ties: bool = True, **kw,
) -> DataFrame:
    """Two-phase beam search on codes; cuts by RANK unless ``ties`` is off. Returns the lists."""
    name = register_distance(codes.sparkSession, table)
    beam = Beam(l, w, t, ties=ties)
    return search(codes, graph, queries, entry, beam, score=f"{name}(b.data, s.qv)",
                  metric=PQTable(table), dtype=np.int64, **kw)
