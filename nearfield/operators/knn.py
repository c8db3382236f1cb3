"""Exact k nearest neighbours: base(id, data[, a]) x queries(q, qv[, a]) -> (q, rank, id, dist).

The work is queries x base distances, whatever the plan; what matters is that pairs are never
emitted. Each task keeps the k best per query and only those travel:

* few queries (a checked size) are broadcast and the base is scanned in place, no shuffle of it;
* larger query sets are cut, like the base, into hash blocks of bounded size; every pair of blocks
  is one co-group. Blocks are cut by id within an attribute value, so neither copies of a vector
  nor one value holding a third of the rows makes a large group. There are at least a few pairs
  per core, so that the work does not lie in as few tasks as the base has files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import l2, matrix
from ..session import MB
from .blocks import L2, TopK

OUT = "q long, id long, dist double"
#: Rows x dim x 8 bytes of one block in the block join.
BLOCK_BYTES = 32 << 20
#: The same for queries that are broadcast: every task of the scan holds all of them with their k rows.
SCAN_BYTES = 2 * MB
#: Most rows of a block or of broadcast queries, however short the vectors are.
BLOCK_ROWS, SCAN_ROWS = 1 << 16, 4096
#: Smallest block that is cut for the sake of more tasks, and pairs of blocks per core.
LEAST_ROWS, PAIRS_PER_CORE = 4096, 2


def rank_nearest(scored: DataFrame, k: int) -> DataFrame:
    """Cut (q, id, dist) to the k nearest per query (partial and final group limit)."""
    nearest = Window.partitionBy("q").orderBy("dist", "id")
    return (
        scored.withColumn("rank", F.row_number().over(nearest))
        .where(F.col("rank") <= k)
        .select("q", "rank", "id", "dist")
    )


def _ints(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _attr_groups(values) -> dict:
    """Positions by attribute value; nulls match nothing, as in an equi-join."""
    arr = np.array(values.to_pylist(), dtype=object)
    out: dict = {}
    for pos, v in enumerate(arr):
        if v is not None:
            out.setdefault(v, []).append(pos)
    return {v: np.array(p) for v, p in out.items()}


def _batch(top: TopK) -> pa.RecordBatch:
    q, i, d = top.rows()
    return pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(d)], ["q", "id", "dist"])


def _scan_plan(base, queries, k, on, metric, dtype) -> DataFrame:
    """Broadcast queries (their size was checked by the caller), scan the base once."""
    spark = base.sparkSession
    table = queries.toArrow()
    q_ids = _ints(table["q"])
    q_mat = matrix(table["qv"], dtype)
    q_rows = _attr_groups(table[on]) if on else None
    shared = spark.sparkContext.broadcast((q_ids, q_mat, q_rows))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, mat, rows = shared.value
        top = TopK(metric, ids, mat, k)
        for b in batches:
            if not b.num_rows:
                continue
            bid, vec = _ints(b.column("id")), matrix(b.column("data"), dtype)
            if rows is None:
                top.add(bid, vec)
            else:
                for v, pos in _attr_groups(b.column(on)).items():
                    if v in rows:
                        top.add(bid[pos], vec[pos], rows[v])
        yield _batch(top)

    cols = ["id", "data"] + ([on] if on else [])
    return base.select(cols).mapInArrow(scan, OUT)


def _block_plan(base, queries, k, on, metric, dtype, block_rows, more=((), ()), allowed=None) -> DataFrame:
    """Pairs of hash blocks; per attribute value the grid is just as fine as its rows need.

    ``more`` names further columns of queries and base, from which ``allowed(left, right)`` of a pair
    of blocks makes what ``TopK.add`` takes to leave pairs of rows out."""
    key: Column = F.col(on) if on else F.lit(0)
    b = base.select("id", "data", key.alias("a"), *more[1]).where("a is not null")
    q = queries.select("q", "qv", key.alias("a"), *more[0]).where("a is not null")
    if on:
        grid = (
            q.groupBy("a").agg(F.ceil(F.count("*") / block_rows).alias("gq"))
            .join(b.groupBy("a").agg(F.ceil(F.count("*") / block_rows).alias("gb")), "a")
        )
        b, q = b.join(grid, "a"), q.join(grid, "a")
    else:  # one grid for all: two numbers, not a join without a key
        nq, nb = q.count(), b.count()
        tasks = PAIRS_PER_CORE * base.sparkSession.sparkContext.defaultParallelism
        block_rows = min(block_rows, max(LEAST_ROWS, int((nq * nb / tasks) ** 0.5)))
        sides = [F.lit(max(1, -(-n // block_rows))).cast("long") for n in (nq, nb)]
        b, q = (side.withColumns(dict(zip(("gq", "gb"), sides, strict=True))) for side in (b, q))
    q_blocks = q.select(
        "a", F.pmod(F.xxhash64("q"), "gq").alias("i"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("gb") - 1)).alias("j"), "q", "qv", *more[0],
    )
    b_blocks = b.select(
        "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("gq") - 1)).alias("i"),
        F.pmod(F.xxhash64("id"), "gb").alias("j"), "id", "data", *more[1],
    )

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return pa.table({"q": pa.array([], pa.int64()), "id": pa.array([], pa.int64()),
                             "dist": pa.array([], pa.float64())})
        top = TopK(metric, _ints(left["q"]), matrix(left["qv"], dtype), k)
        top.add(_ints(right["id"]), matrix(right["data"], dtype), allowed=allowed and allowed(left, right))
        return pa.Table.from_batches([_batch(top)])

    keys = ["a", "i", "j"]
    return q_blocks.groupBy(*keys).cogroup(b_blocks.groupBy(*keys)).applyInArrow(pair, OUT)


def exact_knn(
    base: DataFrame,
    queries: DataFrame,
    k: int,
    on: str | None = None,
    *,
    metric=None,
    dtype=np.float64,
    broadcast_bytes: int = SCAN_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The k nearest base rows of every query, ties by id.

    ``on`` names an attribute both sides carry: only base rows with the query's value compete
    (filtered search, the exact answer of a hybrid query). Rows without a vector take no part;
    infinite distances and NaN come last.
    """
    metric = metric or L2()
    base, queries = base.where("data IS NOT NULL"), queries.where("qv IS NOT NULL")
    nq, dim = queries.agg(F.count("*"), F.max(F.size("qv"))).first()
    dim = max(1, dim or 1)
    if nq <= SCAN_ROWS and nq * dim * 8 <= broadcast_bytes:
        scored = _scan_plan(base, queries, k, on, metric, dtype)
    else:
        block_rows = max(1, min(BLOCK_ROWS, block_bytes // (8 * dim)))
        scored = _block_plan(base, queries, k, on, metric, dtype, block_rows)
    return rank_nearest(scored, k)


def knn_within(base: DataFrame, queries: DataFrame, k: int, on: str, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k nearest rows among those that share a value of ``on`` with the query, where both sides may
    have a row in several values: pairs that meet more than once count once."""
    base, queries = base.where("data IS NOT NULL"), queries.where("qv IS NOT NULL")
    dim = max(1, queries.agg(F.max(F.size("qv"))).first()[0] or 1)
    scored = _block_plan(base, queries, k, on, L2(), np.float64, max(1, block_bytes // (8 * dim)))
    return rank_nearest(scored.groupBy("q", "id").agg(F.min("dist").alias("dist")), k)


def knn_of_blocks(rows: DataFrame, k: int, on: str) -> DataFrame:
    """The k nearest rows of every row among those that share a value of ``on``, its own among them: as
    ``knn_within`` of the rows with themselves, but each moves once per value. The rows of a value must
    fit a block."""

    def inside(block: pa.Table) -> pa.Table:
        ids, vectors = _ints(block["id"]), matrix(block["data"], np.float64)
        top = TopK(L2(), ids, vectors, k)
        top.add(ids, vectors)
        return pa.Table.from_batches([_batch(top)])

    scored = rows.where("data IS NOT NULL").select(on, "id", "data").groupBy(on).applyInArrow(inside, OUT)
    return rank_nearest(scored.groupBy("q", "id").agg(F.min("dist").alias("dist")), k)


def filtered_knn(base: DataFrame, queries: DataFrame, k: int, on: str = "a1") -> DataFrame:
    """Pre-filter search: exact neighbours among the rows whose attribute equals the query's."""
    return exact_knn(base, queries, k, on)


def nearest_to(base: DataFrame, vector: list[float], k: int, where: Column | None = None) -> DataFrame:
    """One query vector given as a literal: ``ORDER BY distance LIMIT k`` with an optional filter
    that reaches the scan."""
    rows = base if where is None else base.where(where)
    target = F.lit([float(x) for x in vector])
    return (
        rows.select("id", l2("data", target).alias("dist")).orderBy("dist", "id").limit(k)
    )
