"""The beam search over tables that every task can hold whole: all steps of a query in one task.

Vectors, edges and attribute of a base table of a checked size are broadcast once. A task takes its queries
a few hundred at a time from the entry vertex to the last step and gives back what it found, so no step is
a job of its own and no list is ever moved. A mark per query and vertex keeps what was met: a candidate that
was cut from a list can never return. Steps, lists, cuts and ties are those of ``walk``, as are the distances.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import matrix
from ..session import BROADCAST_LIMIT
from .graph import to_edges
from .walk import OPEN, PICKED, SEEN, _distances, _dtype, _earlier

#: Query-vertex marks of the queries that go together, and numbers scored at a time: few, so that they stay in the cache.
MET_CELLS, SCORED_CELLS = 1 << 25, 1 << 16
#: Queries per task at least, and tasks per core.
TASK_QUERIES, TASKS_PER_CORE = 64, 4
#: Bytes of one edge on its way to the driver.
EDGE_BYTES = 16
#: Types of attributes whose values agree where they are equal in Python.
PLAIN = {"tinyint", "smallint", "int", "bigint", "string", "boolean"}


@dataclass(frozen=True)
class Table:
    """Vertices in order of their ids; the neighbours of ``v`` are ``ends[starts[v]:starts[v + 1]]``."""

    ids: np.ndarray
    vectors: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    code: np.ndarray
    codes: dict


@dataclass(frozen=True)
class Held:
    """A broadcast ``Table``, and what its rows are like."""

    shared: Broadcast
    count: int
    dim: int
    id_type: str
    on: str


def _plain(rows: DataFrame, id: str, vec: str) -> tuple[int, int] | None:
    """Rows and dimension, if ids are there and not repeated and vectors are whole and of one size."""
    holes = F.coalesce(F.exists(vec, lambda x: x.isNull()), F.lit(False))
    n, ids, least, dim, odd = rows.agg(
        F.count("*"), F.countDistinct(id), F.min(F.size(vec)), F.max(F.size(vec)), F.count_if(holes)).first()
    return (n, dim) if n and ids == n and least == dim and dim and not odd else None


def hold(base: DataFrame, graph: DataFrame, queries: DataFrame, on: str, limit: int = BROADCAST_LIMIT) -> Held | None:
    """``base (id, data, on)`` and ``graph`` for searches of ``queries (q, qv, on)``; None if they are larger
    than ``limit`` or odd (repeated or missing ids, vectors of mixed size, attributes of another type)."""
    kinds = [df.schema[on].dataType.simpleString() for df in (base, queries)]
    base, edges = base.where("data IS NOT NULL").select("id", "data", on), to_edges(graph).select("id", "neighbor").where("id IS NOT NULL AND neighbor IS NOT NULL")
    ids = {df.schema[c].dataType.simpleString() for df, c in ((base, "id"), (edges, "id"), (edges, "neighbor"))}
    if kinds[0] != kinds[1] or kinds[0] not in PLAIN or not ids <= {"int", "bigint"}:
        return None
    have = _plain(base, "id", "data")
    asking = have and _plain(queries.where("qv IS NOT NULL"), "q", "qv")
    if not asking or asking[1] != have[1]:
        return None
    kind = np.dtype(_dtype(base, "data"))
    if have[0] * have[1] * kind.itemsize + edges.count() * EDGE_BYTES > limit:
        return None
    rows, links = base.toArrow().combine_chunks(), edges.toArrow()
    names = rows["id"].to_numpy().astype(np.int64)
    order = np.argsort(names)
    names = names[order]
    ends = []
    for column in ("id", "neighbor"):
        value = links[column].to_numpy().astype(np.int64)
        at = np.minimum(np.searchsorted(names, value), len(names) - 1)
        ends.append(np.where(names[at] == value, at, -1))
    there = (ends[0] >= 0) & (ends[1] >= 0)
    start, end = ends[0][there], ends[1][there]
    values = rows[on].take(pa.array(order)).to_pylist()
    codes = {v: n for n, v in enumerate(dict.fromkeys(values)) if v is not None}
    table = Table(
        names, matrix(rows["data"], kind)[order], np.concatenate([[0], np.cumsum(np.bincount(start, minlength=len(names)))]),
        end[np.argsort(start, kind="stable")].astype(np.int32), np.array([codes.get(v, -1) for v in values], np.int64), codes)
    return Held(base.sparkSession.sparkContext.broadcast(table), *have, base.schema["id"].dataType.simpleString(), on)


def _score(table: Table, q: np.ndarray, metric, dtype, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    step = max(1, SCORED_CELLS // max(1, q.shape[1]))
    return np.concatenate([np.zeros(0), *(
        _distances(metric, q, table.vectors[at[n : n + step]].astype(dtype), row[n : n + step]) for n in range(0, len(row), step))])


def _by_place(row: np.ndarray, dist: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The order by list, distance and vertex; the vertex is looked at only if distances are equal somewhere."""
    order = np.lexsort((dist, row))
    r, d = row[order], dist[order]
    tied = (r[1:] == r[:-1]) & ~(d[1:] > d[:-1])  # or NaN
    return np.lexsort((at, dist, row)) if tied.any() else order


def _lists(table: Table, q: np.ndarray, entry: int, beam, metric, dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lists of the queries ``q`` at the end: query, vertex and distance of each entry, by place."""
    n, size = len(q), len(table.ids)
    row, at, mark = np.arange(n), np.full(n, entry), np.full(n, PICKED, np.int8)
    dist, met, done, step = _score(table, q, metric, dtype, row, at), np.zeros((n, size), bool), [], 1
    met[:, entry] = True
    while len(row):
        step += 1
        of, here = row[mark == PICKED], at[mark == PICKED]
        degree = table.starts[here + 1] - table.starts[here]
        place = np.arange(degree.sum()) + np.repeat(table.starts[here] - np.concatenate([[0], np.cumsum(degree)[:-1]]), degree)
        to, new = np.repeat(of, degree), table.ends[place].astype(np.int64)
        fresh = ~met[to, new]
        to, new = np.divmod(np.unique(to[fresh] * size + new[fresh]), size)
        met[to, new] = True
        mark[mark == PICKED] = SEEN
        worst, full = np.full(n, np.nan), np.bincount(row, minlength=n) >= beam.l  # NaN: the list is not full
        worst[full] = dist[np.searchsorted(row, np.flatnonzero(full), "right") - 1]
        far = _score(table, q, metric, dtype, to, new)
        near = ~(far > worst[to])
        row, at, dist = np.concatenate([row, to[near]]), np.concatenate([at, new[near]]), np.concatenate([dist, far[near]])
        mark = np.concatenate([mark, np.full(near.sum(), OPEN, np.int8)])
        order = _by_place(row, dist, at)
        row, at, dist, mark = row[order], at[order], dist[order], mark[order]
        keep = _earlier(row, dist, n, np.ones(len(row), bool), beam.ties) < beam.l
        row, at, dist, mark = row[keep], at[keep], dist[keep], mark[keep]
        mark[(mark == OPEN) & (_earlier(row, dist, n, mark == OPEN, beam.ties) < beam.width(step))] = PICKED
        going = (np.bincount(row[mark == PICKED], minlength=n) > 0)[row]
        done.append((row[~going], at[~going], dist[~going]))
        row, at, dist, mark = row[going], at[going], dist[going], mark[going]
    return tuple(map(np.concatenate, zip(*done, strict=True)))


def search(held: Held, queries: DataFrame, entry: int, beam, metric, dtype=np.float64) -> DataFrame:
    """``q, id, dist``: what a search of ``beam`` lists for every query and shares the query's attribute."""
    shared, on, count = held.shared, held.on, queries.where("qv IS NOT NULL").count()
    q_type = queries.schema["q"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        first, most = int(np.searchsorted(table.ids, entry)), max(1, MET_CELLS // len(table.ids))
        for whole in batches:
            for n in range(0, whole.num_rows, most):
                batch = whole.slice(n, most)
                asked = np.array([table.codes.get(v, -2) for v in batch.column(on).to_pylist()], np.int64)
                row, at, dist = _lists(table, matrix(batch.column("qv"), dtype), first, beam, metric, dtype)
                same = asked[row] == table.code[at]
                row, at, dist = row[same], at[same], dist[same]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("q").take(pa.array(row)), pa.array(table.ids[at]), pa.array(dist)], ["q", "id", "dist"])

    tasks = min(-(-count // TASK_QUERIES), TASKS_PER_CORE * queries.sparkSession.sparkContext.defaultParallelism)
    dealt = queries.select("q", "qv", on).where("qv IS NOT NULL").repartition(max(1, tasks), "q")
    found = dealt.mapInArrow(run, f"q {q_type}, id bigint, dist double")
    return found.select("q", F.col("id").cast(held.id_type).alias("id"), "dist")
