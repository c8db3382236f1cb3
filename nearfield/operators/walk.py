"""The beam search of very many queries over large tables: a row per query, and vertices that stay in place.

``vertices`` stores every vertex once with its neighbours and their vectors, hashed and sorted by id. A
step sends a query's vector to the vertices it expands, scores their neighbours there and sends back ids
and distances, so a vector moves once per expanded vertex and not once per scored pair. The candidate
list of a query is one row. Lists and the queries' vectors are stored hashed by query and stay in place
too, only answers move to them. Vertices that very
many queries expand in one round (the entry vertex, a hub, copies) are joined apart, through a few rows
whose size is known, so that they make no large task.

A round asks for the vertices to expand now and for those next in line, most of which are expanded later.
The answers of these wait beside the list until their turn comes, so a query takes as many steps in a
round as it has answers for. What waits changes nothing else: steps, lists, cuts and ties are those of
``beam``, as are the distances to the last bit.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.vector import matrix
from ..session import bucketed, new_path, partitions_for, removed, written
from .blocks import EXACT_CELLS
from .graph import is_edges

#: Neighbours in one row of the stored vertices: a hub has many rows.
PART = 16
#: A vertex that more than one in this many of a step's expansions ask for, in all tasks, is joined apart.
HOT_SHARE, HOT_LEAST = 4, 512
#: Queries whose lists are merged at a time.
MERGE_ROWS = 2048
#: Vertices a query asks for in a round, at least. More are asked for in vain more often than they save rounds.
AHEAD = 2
#: Marks of listed vertices: not asked for; its answers wait; expanded; to be expanded once the answers of
#: this round are here; to be expanded, answers here; asked for ahead.
OPEN, HELD, SEEN, PICKED, READY, AHEAD_OF_TURN = range(6)
#: Queries that are done leave the lists once they are one in this many.
FINISHED = 8
#: How the elements of a vector are packed.
PACKED = {"float": "<f4", "double": "<f8", "tinyint": "<i1", "smallint": "<i2", "int": "<i4", "bigint": "<i8"}


def _dtype(df: DataFrame, column: str) -> str:
    return PACKED.get(df.schema[column].dataType.elementType.simpleString(), "<f8")


def _packed(df: DataFrame, column: str) -> DataFrame:
    """``df`` with the vectors of ``column`` as bytes, which move faster than arrays."""
    kind, names = _dtype(df, column), df.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.ascontiguousarray(matrix(batch.column(column), np.dtype(kind)))
            ends = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * rows.itemsize)
            made = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows.tobytes())])
            yield pa.RecordBatch.from_arrays([made if n == column else batch.column(n) for n in names], names)

    schema = ", ".join(f"`{f.name}` {'binary' if f.name == column else f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(pack, schema)


def _unpacked(column: pa.Array, kind: str, dtype) -> np.ndarray:
    if not len(column):
        return np.empty((0, 0), dtype)
    sizes = pc.min_max(pc.binary_length(column))
    if sizes["min"] != sizes["max"]:
        raise ValueError("vectors of mixed dimension")
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(dtype)


@dataclass(frozen=True)
class Vertices:
    """``id, nbs, vecs``: neighbours that have a vector, and these; a stored table."""

    rows: DataFrame
    name: str
    buckets: int

    def drop(self) -> None:
        self.rows.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")


def vertices(base: DataFrame, graph: DataFrame) -> Vertices:
    """Store every vertex with its neighbours, written once for all steps."""
    spark = base.sparkSession
    with_part = F.pmod(F.xxhash64("neighbor"), F.ceil(F.col("degree") / PART)).alias("part")
    if is_edges(graph):
        degrees = graph.groupBy("id").agg(F.count("*").alias("degree"))
        edges = graph.select("id", "neighbor").join(degrees, "id")
    else:
        edges = graph.select("id", F.size("nbs").alias("degree"), F.explode("nbs").alias("neighbor"))
    ends = written(_packed(base.select(F.col("id").alias("neighbor"), "data"), "data"), "ends")
    pairs = edges.select("id", with_part, "neighbor").join(ends, "neighbor")
    rows = pairs.groupBy("id", "part").agg(F.collect_list(F.struct("neighbor", "data")).alias("n"))
    degree, size = edges.count(), base.agg(F.max(F.size("data"))).first()[0] or 0
    buckets = partitions_for(spark, degree, 2 * (4 * size + 24), min_rows=2048)
    name = f"vertices_{uuid.uuid4().hex}"
    stored = rows.select("id", F.col("n.neighbor").alias("nbs"), F.col("n.data").alias("vecs")).repartition(buckets, "id")
    return Vertices(bucketed(stored, name, buckets), name, buckets)


def _counts(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))


def _distances(metric, q: np.ndarray, b: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The distance of ``b[i]`` to ``q[row[i]]``, in slices of bounded size."""
    step = max(1, EXACT_CELLS // max(1, b.shape[1]))
    with np.errstate(invalid="ignore", over="ignore"):
        parts = [metric.exact(q[row[n : n + step]], b[n : n + step]) for n in range(0, len(row), step)]
    return metric.finish(np.concatenate([np.zeros(0), *parts]))


def _scoring(metric, q_kind: str, b_kind: str, dtype):
    """Rows (q, id, qv, worst, nbs, vecs) -> (q, of, ids, dists): neighbours of ``of`` that may still enter the list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = _counts(batch.column("nbs"))
            row = np.repeat(np.arange(len(sizes)), sizes)
            ids = batch.column("nbs").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(ids):
                continue
            q = _unpacked(batch.column("qv"), q_kind, dtype)
            dist = _distances(metric, q, _unpacked(batch.column("vecs").flatten(), b_kind, dtype), row)
            keep = ~(dist > batch.column("worst").to_numpy()[row])  # NaN: the list is not full
            sizes = np.bincount(row[keep], minlength=len(sizes))
            yield pa.RecordBatch.from_arrays(
                [batch.column("q"), batch.column("id").cast(pa.int64()), _lists(ids[keep], sizes), _lists(dist[keep], sizes)],
                ["q", "of", "ids", "dists"])

    return run


def _run_starts(row, dist) -> np.ndarray:
    """Where the run of equal distances begins that an entry belongs to (NaN equals NaN)."""
    fresh = np.ones(len(row), bool)
    same = (dist[1:] == dist[:-1]) | (np.isnan(dist[1:]) & np.isnan(dist[:-1]))
    fresh[1:] = (row[1:] != row[:-1]) | ~same
    return np.maximum.accumulate(np.where(fresh, np.arange(len(row)), 0))


def _earlier(row, dist, n: int, counted, ties: bool) -> np.ndarray:
    """How many of the ``counted`` entries of its list come before an entry; with ``ties``, before its run."""
    before = np.concatenate([[0], np.cumsum(counted)])[:-1]
    starts = np.searchsorted(row, np.arange(n))
    return (before[_run_starts(row, dist)] if ties else before) - before[starts[row]]


def _merged(l: int, width, ties: bool, n: int, row, ids, dist, mark, given) -> tuple:
    """Entries of ``n`` lists, in any order, without repeats, cut to ``l``, with those to expand next.

    ``given`` is 0 for entries that were listed before, 1 for others; ``width`` is how many to expand, by list."""
    order = np.lexsort((given, ids, dist, row))
    row, ids, dist, mark = row[order], ids[order], dist[order], mark[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (ids[1:] != ids[:-1])
    row, ids, dist, mark = row[first], ids[first], dist[first], mark[first]
    keep = _earlier(row, dist, n, np.ones(len(row), bool), ties) < l
    row, ids, dist, mark = row[keep], ids[keep], dist[keep], mark[keep]
    waiting = mark != SEEN
    return row, ids, dist, mark, waiting & (_earlier(row, dist, n, waiting, ties) < width[row])


def _advancing(beam):
    """Lists with the answers of a round -> lists after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, MERGE_ROWS):
                yield _advanced(whole.slice(at, MERGE_ROWS), beam)

    return run


def _answers(batch: pa.RecordBatch, column: str) -> tuple:
    """Answers in ``column`` -> list, vertex asked, neighbour and distance of each."""
    per_list, flat = _counts(batch.column(column)), batch.column(column).flatten()
    ids = flat.field("ids")
    owner = np.repeat(np.repeat(np.arange(len(per_list)), per_list), sizes := _counts(ids))
    of = np.repeat(flat.field("of").to_numpy(zero_copy_only=False).astype(np.int64), sizes)
    values = (x.flatten().to_numpy(zero_copy_only=False) for x in (ids, flat.field("dists")))
    return owner, of, *(x.astype(kind) for x, kind in zip(values, (np.int64, float), strict=True))


def _marks_of(row, ids, mark, of_row, of) -> np.ndarray:
    """Mark of the entry that each answer belongs to; SEEN where it is no longer listed."""
    names, at = np.unique(np.concatenate([ids, of]), return_inverse=True)
    key, asked = row * len(names) + at[: len(ids)], of_row * len(names) + at[len(ids):]
    order = np.argsort(key)
    place = np.searchsorted(key[order], asked)
    place = order[np.minimum(place, len(order) - 1)] if len(order) else place
    return np.where(key[place] == asked, mark[place], SEEN) if len(order) else np.full(len(of), SEEN)


def _advanced(batch: pa.RecordBatch, beam) -> pa.RecordBatch:
    """As many steps as the answers of each list reach; then what to ask for next."""
    n, l, ties = batch.num_rows, beam.l, beam.ties
    row = np.repeat(np.arange(n), _counts(batch.column("ids")))
    ids, dist, mark = (
        batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(kind)
        for c, kind in (("ids", np.int64), ("dists", float), ("mark", np.int8)))
    steps, visited = (batch.column(c).to_numpy().copy() for c in ("steps", "visited"))
    a_row, a_of, a_id, a_dist = map(np.concatenate, zip(_answers(batch, "held"), _answers(batch, "got"), strict=True))
    mark[mark == PICKED], mark[mark == AHEAD_OF_TURN] = READY, HELD
    while True:
        going = (np.bincount(row[mark == READY], minlength=n) > 0) & (np.bincount(row[mark == PICKED], minlength=n) == 0)
        if not going.any():
            break
        now = (_marks_of(row, ids, mark, a_row, a_of) == READY) & going[a_row]
        mine, new = going[row], now.sum()
        width = np.array([beam.width(x) for x in range(int(steps.max()) + 2)])[steps + 1]
        mark[mine & (mark == READY)] = SEEN
        row_, ids_, dist_, mark_, pick = _merged(
            l, width, ties, n,
            np.concatenate([row[mine], a_row[now]]), np.concatenate([ids[mine], a_id[now]]),
            np.concatenate([dist[mine], a_dist[now]]), np.concatenate([mark[mine], np.full(new, OPEN, np.int8)]),
            np.repeat([0, 1], [mine.sum(), new]))
        mark_[pick] = np.where(mark_[pick] == HELD, READY, PICKED)
        picks = np.bincount(row_[pick], minlength=n)
        steps, visited = steps + (picks > 0), visited + picks
        row, ids, dist, mark = (np.concatenate([x[~mine], y]) for x, y in ((row, row_), (ids, ids_), (dist, dist_), (mark, mark_)))
        a_row, a_of, a_id, a_dist = a_row[~now], a_of[~now], a_id[~now], a_dist[~now]
    order = np.argsort(row, kind="stable")  # each list is in order already
    row, ids, dist, mark = row[order], ids[order], dist[order], mark[order]
    due = np.bincount(row[mark == PICKED], minlength=n)
    free = (mark == OPEN) & (due > 0)[row]
    mark[free & (_earlier(row, dist, n, free, False) < (AHEAD - due)[row])] = AHEAD_OF_TURN
    ask = (mark == PICKED) | (mark == AHEAD_OF_TURN)
    sizes = np.bincount(row, minlength=n)
    worst = np.full(n, np.nan)
    full = sizes >= l
    worst[full] = dist[np.cumsum(sizes) - 1][full]
    wait = np.isin(_marks_of(row, ids, mark, a_row, a_of), (HELD, READY)) & ~(a_dist > worst[a_row])
    a_row, a_of, a_id, a_dist = a_row[wait], a_of[wait], a_id[wait], a_dist[wait]
    order = np.lexsort((a_of, a_row))
    a_row, a_of, a_id, a_dist = a_row[order], a_of[order], a_id[order], a_dist[order]
    first = np.flatnonzero(np.concatenate([[True], (a_row[1:] != a_row[:-1]) | (a_of[1:] != a_of[:-1])])[: len(a_row)])
    runs = np.diff(np.append(first, len(a_row)))
    held = pa.StructArray.from_arrays([pa.array(a_of[first]), _lists(a_id, runs), _lists(a_dist, runs)], ["of", "ids", "dists"])
    return pa.RecordBatch.from_arrays(
        [batch.column("q"), _lists(ids, sizes), _lists(dist, sizes), _lists(mark, sizes),
         _lists(ids[ask], np.bincount(row[ask], minlength=n)), pa.array(worst), pa.array(steps), pa.array(visited),
         pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(a_row[first], minlength=n))]), pa.int32()), held)], LIST)


LIST = ["q", "ids", "dists", "mark", "ask", "worst", "steps", "visited", "held"]
HELD_TYPE = pa.list_(pa.struct([("of", pa.int64()), ("ids", pa.list_(pa.int64())), ("dists", pa.list_(pa.float64()))]))
ANSWERS = "array<struct<of: bigint, ids: array<bigint>, dists: array<double>>>"


def _by_query(df: DataFrame, name: str, path: str) -> tuple[DataFrame, str]:
    """Store ``df`` in the folder ``path``, hashed by q into as many buckets as a join has partitions."""
    table = f"{name}_{uuid.uuid4().hex}"
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("path", path).bucketBy(buckets, "q").saveAsTable(table)
    return df.sparkSession.table(table), table


class _Lists:
    """The lists of a round, written to a folder that goes when the next ones are there."""

    def __init__(self, df: DataFrame):
        self.spark, seen = df.sparkSession, Observation()
        self.path = new_path(self.spark, "lists")
        counted = df.observe(
            seen, F.coalesce(F.sum(F.size("ask")), F.lit(0)).alias("asks"),
            F.count_if(F.size("ask") > 0).alias("active"), F.count("*").alias("rows"))
        self.rows, self.table = _by_query(counted, "lists", self.path)
        self.asks, self.active, self.count = (seen.get[c] for c in ("asks", "active", "rows"))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        removed(self.spark, self.path)


def search(at: Vertices, first: list, queries: DataFrame, base: DataFrame, entry: int, beam, metric, dtype) -> DataFrame:
    """Run to the end over the stored vertices ``at`` -> (q, id, dist, seen, ok, steps, visited).

    ``first`` is the vector of the entry vertex. ``queries`` have a vector each."""
    spark = queries.sparkSession
    q_kind, b_kind, q_type = _dtype(queries, "qv"), _dtype(base, "data"), queries.schema["q"].dataType.simpleString()
    schema = (f"q {q_type}, ids array<bigint>, dists array<double>, mark array<tinyint>, "
              f"ask array<bigint>, worst double, steps bigint, visited bigint, held {ANSWERS}")
    score = _scoring(metric, q_kind, b_kind, dtype)
    target = np.array([first]).astype(b_kind).astype(dtype)
    l = beam.l

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _unpacked(batch.column("qv"), q_kind, dtype)
            n = len(q)
            one, ids, picked = np.ones(n, np.int64), np.full(n, entry, np.int64), np.full(n, PICKED, np.int8)
            dist = _distances(metric, q, np.repeat(target, n, axis=0), np.arange(n))
            yield pa.RecordBatch.from_arrays(
                [batch.column("q"), _lists(ids, one), _lists(dist, one), _lists(picked, one), _lists(ids, one),
                 pa.array(np.where(l <= 1, dist, np.nan)), pa.array(one), pa.array(one), pa.array([[]] * n, HELD_TYPE)], LIST)

    def step(lists: _Lists, rows: DataFrame) -> _Lists:
        asked = rows.select("q", "worst", "ask").join(vectors.hint("merge"), "q").select("q", "qv", "worst", F.explode("ask").alias("id"))
        most, hot = max(HOT_LEAST, lists.asks // (HOT_SHARE * at.buckets)), []
        if lists.asks > most:
            hot = [r["id"] for r in rows.select(F.explode("ask").alias("id")).groupBy("id").count().where(F.col("count") > most).select("id").collect()]
        plain = asked.where(~F.col("id").isin(hot)) if hot else asked
        met = plain.join(at.rows.hint("merge"), "id").select("q", "id", "qv", "worst", "nbs", "vecs")
        if hot:  # At most HOT_SHARE x buckets vertices; written, so that their size is known.
            few = written(at.rows.where(F.col("id").isin(hot)), "hot")
            met = met.unionByName(asked.where(F.col("id").isin(hot)).join(few, "id").select(met.columns))
        answers = met.mapInArrow(score, f"q {q_type}, of bigint, ids array<bigint>, dists array<double>").where(F.size("ids") > 0)
        got = answers.groupBy("q").agg(F.collect_list(F.struct("of", "ids", "dists")).alias("got"))
        joined = rows.drop("worst", "ask").join(got.hint("merge"), "q", "left")
        return _Lists(joined.mapInArrow(_advancing(beam), schema))

    def finish(rows: DataFrame) -> None:
        rows.select("q", "ids", "dists", "mark", "steps", "visited").write.mode("append").parquet(done)

    done = new_path(spark, "done")
    parts, kept = int(spark.conf.get("spark.sql.shuffle.partitions")), new_path(spark, "vectors")
    vectors, table = _by_query(_packed(queries.select("q", "qv"), "qv").repartition(parts, "q"), "vectors", kept)
    lists = _Lists(vectors.mapInArrow(seeds, schema).repartition(parts, "q"))
    while lists.asks:
        rows = lists.rows
        if FINISHED * (lists.count - lists.active) >= lists.count:
            finish(rows.where(F.size("ask") == 0))
            rows = rows.where(F.size("ask") > 0)
        ahead = step(lists, rows)
        lists.drop()
        lists = ahead
    finish(lists.rows)
    lists.drop()
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    removed(spark, kept)
    entries = F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("dists").alias("dist"), F.col("mark").alias("mark")))
    return spark.read.parquet(done).select("q", "steps", "visited", entries).select(
        "q", F.col("id").cast(base.schema["id"].dataType).alias("id"), "dist", (F.col("mark") == SEEN).alias("seen"), F.lit(True).alias("ok"), "steps", "visited")
