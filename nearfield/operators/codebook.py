"""Codebooks: a table (m, c, centroid) of ksub x dim numbers in all, whatever the data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import matrix
from ..session import BROADCAST_LIMIT
from .blocks import BLOCK_CELLS


def even_bounds(dim: int, m: int) -> list[int]:
    """Borders of ``m`` equal subspaces."""
    if dim % m:
        raise ValueError(f"{dim} dimensions do not split into {m} equal subspaces")
    return list(range(0, dim + 1, dim // m))


def check_size(numbers: int) -> None:
    if numbers * 8 > BROADCAST_LIMIT * 4:
        raise ValueError("codebook or distance table too large to broadcast")


def initial_codebook(
    base: DataFrame, bounds: list[int], ksub: int, salt: str = ""
) -> DataFrame:
    """``ksub`` vectors sampled by hash of their id, cut into subspaces -> (m, c, centroid)."""
    digest = F.md5(F.concat(F.col("id").cast("string"), F.lit(salt)))
    # The least digests first, from the ids alone: every task passes on at most ksub of them, and no
    # vector moves that is not chosen.
    chosen = [r["id"] for r in base.select("id", digest.alias("digest")).orderBy("digest", "id").limit(ksub).collect()]
    sample = base.where(F.col("id").isin(chosen)).select("id", "data").collect()
    sample.sort(key=lambda r: r["id"])
    rows = [
        (m, c, [float(x) for x in r["data"][s:e]])
        for c, r in enumerate(sample)
        for m, (s, e) in enumerate(zip(bounds, bounds[1:]))
    ]
    return base.sparkSession.createDataFrame(rows, "m int, c int, centroid array<double>")


def codebook_arrays(codebook: DataFrame) -> list[np.ndarray]:
    """The codebook on the driver: one [ksub][dsub] array per subspace."""
    check_size(codebook.agg(F.coalesce(F.sum(F.size("centroid")), F.lit(0))).first()[0])
    rows = sorted(codebook.collect(), key=lambda r: (r["m"], r["c"]))
    out: list[list] = []
    for r in rows:
        if r["m"] == len(out):
            out.append([])
        out[r["m"]].append(r["centroid"])
    return [np.array(a, float) for a in out]


def nearest_codes(x: np.ndarray, book: list[np.ndarray], bounds: list[int]) -> np.ndarray:
    """Code of every row in every subspace; the smaller code wins a tie."""
    codes = np.empty((len(x), len(book)), np.int32)
    for m, cent in enumerate(book):
        sub = x[:, bounds[m] : bounds[m + 1]]
        step = max(1, BLOCK_CELLS // max(1, cent.size))
        for r in range(0, len(x), step):
            diff = sub[r : r + step, None, :] - cent[None, :, :]
            codes[r : r + step, m] = np.einsum("ijk,ijk->ij", diff, diff).argmin(axis=1)
    return codes


def train_step(base: DataFrame, codebook: DataFrame, bounds: list[int]) -> DataFrame:
    """One Lloyd step. Every task reduces its rows to sums per (subspace, code), so the shuffle
    carries tasks x codebook numbers and never a vector. An empty cell keeps its centroid."""
    book = codebook_arrays(codebook)
    shared = base.sparkSession.sparkContext.broadcast(book)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cents = shared.value
        total = [np.zeros_like(c) for c in cents]
        count = [np.zeros(len(c), np.int64) for c in cents]
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("data"))
            codes = nearest_codes(x, cents, bounds)
            for m in range(len(cents)):
                np.add.at(total[m], codes[:, m], x[:, bounds[m] : bounds[m + 1]])
                count[m] += np.bincount(codes[:, m], minlength=len(cents[m]))
        for m in range(len(cents)):
            used = np.nonzero(count[m])[0]
            width = cents[m].shape[1]
            cells = len(used) * width
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(cells, m, np.int32)),
                    pa.array(np.repeat(used, width).astype(np.int32)),
                    pa.array(np.repeat(count[m][used], width)),
                    pa.array(np.tile(np.arange(width, dtype=np.int32), len(used))),
                    pa.array(total[m][used].reshape(-1)),
                ],
                ["m", "c", "n", "pos", "s"],
            )

    # each task emits at most one codebook of sums, which the exchange adds up before and after it
    parts = base.select("data").mapInArrow(sums, "m int, c int, n long, pos int, s double")
    moved = (
        parts.groupBy("m", "c", "pos").agg((F.sum("s") / F.sum("n")).alias("v"))
        .groupBy("m", "c").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("p"))
        .select("m", "c", F.transform("p", lambda x: x["v"]).alias("moved"))
    )
    return codebook.join(moved, ["m", "c"], "left").select(
        "m", "c", F.coalesce("moved", "centroid").alias("centroid")
    )


def train(base: DataFrame, m: int, ksub: int, steps: int, dim: int) -> tuple[DataFrame, list[int]]:
    """Codebook by k-means per subspace -> (codebook, bounds)."""
    bounds = even_bounds(dim, m)
    book = initial_codebook(base, bounds, ksub)
    spark = base.sparkSession
    for _ in range(steps):
        # the codebook is small and of fixed size: hold its rows, drop the plan that made them
        rows = train_step(base, book, bounds).collect()
        book = spark.createDataFrame(rows, book.schema)
    return book, bounds


def encode(
    df: DataFrame, codebook: DataFrame, bounds: list[int], vec: str = "data",
    mean: list[float] | None = None,
) -> DataFrame:
    """Replace the vector column by its codes (array<int>). ``mean`` is subtracted first, which is
    how codebooks trained on centred data are applied; ``bounds`` may cut unequal subspaces."""
    book = codebook_arrays(codebook)
    if [c.shape[1] for c in book] != [e - s for s, e in zip(bounds, bounds[1:])]:
        raise ValueError("centroid lengths do not match the bounds")
    shared = df.sparkSession.sparkContext.broadcast((book, None if mean is None else np.array(mean)))

    @F.arrow_udf("array<int>")
    def codes_of(v: pa.Array) -> pa.Array:
        cents, centre = shared.value
        if len(v) == 0:
            return pa.array([], pa.list_(pa.int32()))
        x = matrix(v)
        if centre is not None:
            x = x - centre
        codes = nearest_codes(x, cents, bounds)
        offsets = np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes.reshape(-1)))

    return df.withColumn(vec, codes_of(vec))
