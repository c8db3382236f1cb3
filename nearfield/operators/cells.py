"""Cells on two levels: coarse centroids, and fine ones inside each coarse cell.

Coarse centroids are fitted on a bounded sample on the driver; the fine ones of a coarse cell on a
bounded sample of its rows, in a task of their own. Every row of a table is placed, so the work and
the memory per row stay the same whatever the number of rows. Cells serve two ends: graph building
(rows in overlapping cells) and an index for approximate top k (a table of cells, probed by the
nearest cells of each query).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import matrix
from ..session import BROADCAST_LIMIT, shared_dir, written
from .blocks import BLOCK_CELLS, L2
from .knn import BLOCK_BYTES, BLOCK_ROWS, _block_plan, exact_knn, rank_nearest

#: Rows that the coarse centroids, and those of one coarse cell per fine centroid, are fitted on (about).
SAMPLE_ROWS, FINE_ROWS = 20_000, 64
#: Most coarse centroids; they are broadcast. The fine ones are joined.
MOST_COARSE = 4096
#: Rows of a coarse cell placed by one task; more are dealt out by a hash of the id.
GROUP_ROWS = 50_000
#: Up to this many probes a query travels once for each probed cell, beyond once for each block of rows.
MOST_PROBES = 64


@dataclass(frozen=True)
class Cells:
    """``coarse`` centroids, and ``fine (c1, c2, centroid)`` with c2 below ``width``; cell = c1 * width + c2."""

    coarse: np.ndarray
    fine: DataFrame
    width: int


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)[None, :], 0)


def nearest(x: np.ndarray, centroids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and squared distances of each row's ``n`` nearest centroids, nearest first."""
    n = min(n, len(centroids))
    picks, dists = np.empty((len(x), n), np.int64), np.empty((len(x), n))
    step = max(1, BLOCK_CELLS // max(1, len(centroids)))
    for at in range(0, len(x), step):
        d = distances(x[at: at + step], centroids)
        order = np.argsort(d, axis=1, kind="stable")[:, :n]
        picks[at: at + step], dists[at: at + step] = order, np.take_along_axis(d, order, 1)
    return picks, dists


def kmeans(x: np.ndarray, k: int, steps: int = 8, seed: int = 0) -> np.ndarray:
    """Lloyd's centroids from ``k`` distinct rows (fewer if there are fewer); an empty one stays."""
    distinct = np.unique(x, axis=0)
    found = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]].astype(float)
    for _ in range(steps if len(found) > 1 else 0):
        at = nearest(x, found, 1)[0][:, 0]
        n = np.bincount(at, minlength=len(found))
        total = np.zeros_like(found)
        np.add.at(total, at, x)
        found = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], found)
    return found


def share(base: DataFrame, rows: int, salt: int) -> DataFrame:
    """About ``rows`` rows chosen by a hash of the id; nothing of the others is moved."""
    count = base.count()
    if count <= rows:
        return base
    return base.where(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 30)) < int(rows / count * (1 << 30)))


def _with_coarse(rows: DataFrame, coarse: np.ndarray, n: int) -> DataFrame:
    """``id, data, c1``: each row once for each of its ``n`` nearest coarse cells."""
    shared = rows.sparkSession.sparkContext.broadcast(coarse)  # at most MOST_COARSE rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                picks = nearest(matrix(batch.column("data")), shared.value, n)[0]
                take = pa.array(np.repeat(np.arange(len(picks)), picks.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(take), batch.column("data").take(take), pa.array(picks.ravel().astype(np.int32))],
                    ["id", "data", "c1"])

    return rows.select("id", "data").mapInArrow(run, "id long, data array<float>, c1 int")


def fit(base: DataFrame, cells: int, seed: int = 0) -> Cells:
    """About ``cells`` cells for the vectors of ``base (id, data)``."""
    base = base.where("data IS NOT NULL").select("id", F.col("data").cast("array<float>").alias("data"))
    k1 = int(min(MOST_COARSE, max(1, np.ceil(np.sqrt(cells)))))
    width = -(-cells // k1)
    sample = share(base, max(SAMPLE_ROWS, 16 * k1), seed).orderBy("id").toArrow()  # bounded by the two numbers
    if sample.num_rows == 0:
        raise ValueError("no vectors")
    coarse = kmeans(matrix(sample["data"]), k1, seed=seed)
    placed = _with_coarse(share(base, 2 * FINE_ROWS * cells, seed + 1), coarse, 1)
    turn = Window.partitionBy("c1").orderBy(F.xxhash64("id", F.lit(seed)), "id")
    bounded = placed.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= FINE_ROWS * width)

    def inside(rows: pa.Table) -> pa.Table:
        found = kmeans(matrix(rows["data"]), width, seed=seed).astype(np.float32)
        return pa.table({
            "c1": pa.array(np.full(len(found), rows["c1"][0].as_py(), np.int32)), "c2": pa.array(np.arange(len(found), dtype=np.int32)),
            "centroid": pa.array(list(found), pa.list_(pa.float32()))})

    fine = bounded.drop("turn").groupBy("c1").applyInArrow(inside, "c1 int, c2 int, centroid array<float>")
    # A coarse cell without sampled rows is one cell around its own centroid.
    own = [(c, 0, [float(v) for v in row]) for c, row in enumerate(coarse)]
    own = base.sparkSession.createDataFrame(own, "c1 int, c2 int, centroid array<float>")
    fine = written(fine, "fine")
    return Cells(coarse, written(fine.unionByName(own.join(fine, "c1", "left_anti")), "cells"), width)


def place(rows: DataFrame, cells: Cells, keep: int = 1, reach: int = 1) -> DataFrame:
    """``id, cell``: the ``keep`` nearest cells of every row among those of its ``reach`` nearest coarse cells.

    A coarse cell that holds very many rows is dealt out over several groups by a hash of the id.
    """
    rows = rows.where("data IS NOT NULL").select("id", F.col("data").cast("array<float>").alias("data"))
    near = written(_with_coarse(rows, cells.coarse, reach), "placed")
    parts = near.groupBy("c1").agg(F.ceil(F.count("*") / GROUP_ROWS).alias("parts"))  # a row per coarse cell
    left = near.join(F.broadcast(parts), "c1").withColumn("part", F.pmod(F.xxhash64("id"), "parts")).drop("parts")
    right = cells.fine.join(F.broadcast(parts), "c1").select("c1", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "c2", "centroid")
    width = cells.width

    def inside(vectors: pa.Table, centroids: pa.Table) -> pa.Table:
        if vectors.num_rows == 0:
            return pa.table({"id": pa.array([], pa.int64()), "cell": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())})
        c1, c2 = centroids["c1"][0].as_py(), centroids["c2"].to_numpy()
        order = np.argsort(c2)
        picks, dists = nearest(matrix(vectors["data"]), matrix(centroids["centroid"])[order], keep)
        return pa.table({
            "id": vectors["id"].combine_chunks().take(pa.array(np.repeat(np.arange(len(picks)), picks.shape[1]))),
            "cell": pa.array(c1 * width + c2[order][picks.ravel()].astype(np.int64)), "dist": pa.array(dists.ravel())})

    found = left.groupBy("c1", "part").cogroup(right.groupBy("c1", "part")).applyInArrow(inside, "id long, cell long, dist double")
    if reach > 1:
        turn = Window.partitionBy("id").orderBy("dist", "cell")
        found = found.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= keep)
    return found.select("id", "cell")


@dataclass(frozen=True)
class CellIndex:
    """Every row of a base table, stored by coarse cell and sorted by cell."""

    cells: Cells
    path: str
    schema: str

    def table(self, spark) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.path)


def build(base: DataFrame, cells: int, seed: int = 0) -> CellIndex:
    """Store ``base`` by cell: a folder per coarse cell, rows in order of their cell. Rows are dealt out by
    (cell, hash of the id), so a cell with a third of all rows fills many files and not one task."""
    index = fit(base, cells, seed)
    base = base.where("data IS NOT NULL")
    rows = base.join(place(base, index), "id").withColumn("c1", F.floor(F.col("cell") / index.width).cast("int"))
    path = f"{shared_dir(base.sparkSession).rstrip('/')}/cell-index-{uuid.uuid4().hex}"
    mixed = F.xxhash64("id")
    rows.repartitionByRange("c1", "cell", mixed).sortWithinPartitions("c1", "cell").write.partitionBy("c1").parquet(path)
    return CellIndex(index, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema))


def search(index: CellIndex, queries: DataFrame, k: int, nprobe: int = 8) -> DataFrame:
    """Approximate top k ``(q, rank, id, dist)``: exact distances to the rows of each query's ``nprobe``
    nearest cells. Of few probes, only folders of probed coarse cells are read; no row is in two cells, so
    none is met twice. Many probes reach every folder, so there queries and rows meet in blocks, where a
    query's distance to its ``nprobe``-th cell decides; with all cells probed the search is exact."""
    spark = queries.sparkSession
    queries = queries.select("q", "qv").where("qv IS NOT NULL")
    count = index.cells.fine.count()
    if nprobe >= count:
        return exact_knn(index.table(spark).select("id", "data"), queries, k)
    if nprobe > MOST_PROBES and 4 * count * index.cells.coarse.shape[1] <= BROADCAST_LIMIT:
        return _search_blocks(index, queries, k, nprobe)
    points = queries.select(F.col("q").alias("id"), F.col("qv").alias("data"))
    probes = written(place(points, index.cells, nprobe, min(nprobe, len(index.cells.coarse))).withColumnRenamed("id", "q"), "probes")
    folders = [r.c1 for r in probes.select(F.floor(F.col("cell") / index.cells.width).cast("int").alias("c1")).distinct().collect()]  # at most MOST_COARSE
    rows = index.table(spark).where(F.col("c1").isin(folders)).select("id", "data", "cell")
    return exact_knn(rows, queries.join(probes, "q"), k, "cell", broadcast_bytes=0)


def _search_blocks(index: CellIndex, queries: DataFrame, k: int, nprobe: int) -> DataFrame:
    """One row per query says which cells it probes: the distance ``cut`` of the farthest of them. All
    centroids are broadcast; their size was checked."""
    spark = queries.sparkSession
    fine = index.cells.fine.select((F.col("c1").cast("long") * index.cells.width + F.col("c2")).alias("cell"), "centroid").orderBy("cell").toArrow()
    numbers, centroids = fine["cell"].to_numpy(), matrix(fine["centroid"])
    slack = 1e-12 * (centroids * centroids).sum(1).max()
    shared = spark.sparkContext.broadcast((numbers, centroids))
    step = max(1, BLOCK_CELLS // len(numbers))

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q, all_cells = matrix(batch.column("qv")).astype(float), shared.value[1]
                cut = np.concatenate([
                    np.partition(distances(q[at: at + step], all_cells), nprobe - 1, axis=1)[:, nprobe - 1] for at in range(0, len(q), step)])
                # the same distance may come out otherwise in the last digits beside other centroids
                cut += slack + 1e-12 * (q * q).sum(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cut)], names=[*batch.schema.names, "cut"])

    kind = queries.schema["qv"].dataType.simpleString()
    asking = written(queries.repartition("q").mapInArrow(cuts, f"q {queries.schema['q'].dataType.simpleString()}, qv {kind}, cut double"), "cuts")

    def allowed(left: pa.Table, right: pa.Table):
        q, cut = matrix(left["qv"]).astype(float), left["cut"].to_numpy()
        there, at = np.unique(right["cell"].to_numpy(), return_inverse=True)
        near = shared.value[1][np.searchsorted(shared.value[0], there)]
        return lambda rows: (distances(q[rows], near) <= cut[rows, None])[:, at]

    rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * centroids.shape[1])))
    table = index.table(spark).where("data IS NOT NULL")
    return rank_nearest(_block_plan(table, asking, k, None, L2(), np.float64, rows, (["cut"], ["cell"]), allowed), k)
