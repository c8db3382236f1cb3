"""Best-first beam search over a graph table, all queries advancing together.

State is one table, a row per (query, candidate):

    q, id, dist     the candidate list, at most ``l`` rows per query
    seen            already expanded
    pick            to be expanded in the coming step
    ok              may appear in the result (an entry vertex may fail the filter)
    steps, visited  counters of the query

No visited set is kept beside it. A candidate that was cut from the list has ``l`` better ones
before it, and the list only improves, so it can never come back: the ``seen`` flag on the listed
rows is all the memory the search needs, and the state stays bounded by queries x l.

One step is: picked vertices join the graph, neighbours not yet listed join their vectors and their
query, the union with the list is ranked and cut to ``l``. Every step ends in a reliable
checkpoint; one row of counts returns to the driver. Small inputs take the step in one statement
with explicit partition counts (adaptive execution would merge them into one task). Many queries on
large ones go the way of ``walk``, where vectors do not move per scored pair; for few, and with an attribute, the graph and the vectors stay where they are, only the rows asked for move, and every exchange
keeps its map-side group limit and skew handling.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.vector import l2_sql, register_l2
from ..session import BROADCAST_LIMIT, MB, bucketed, checkpoint, fits_broadcast, partitions_for, written
from . import held, walk
from .blocks import L2
from .graph import is_edges, knn_graph, medoid, to_edges
from .knn import filtered_knn, rank_nearest

STATE = ["q", "id", "dist", "seen", "ok", "steps", "visited"]
#: Bytes of one state row in a shuffle, for partition counts.
ROW_BYTES = 64
#: Graph, base and queries up to this size each are broadcast in every step.
SMALL_LIMIT = 2 * MB
#: Bytes of one id in a broadcast hash relation.
ID_BYTES = 24
#: Up to this many ids become a literal IN filter on the scan.
LOOKUP_IDS = 256
#: More queries than this on tables that are not small go the way of ``walk``.
MANY_QUERIES = 256


@dataclass(frozen=True)
class Beam:
    """Search parameters. ``w`` vertices per query are expanded from step ``t`` on, one before.

    ``ties=True`` ranks with RANK instead of ROW_NUMBER: equal distances are all kept and all
    expanded. ``hops=2`` expands to neighbours of neighbours; ``include_one_hop`` adds the first
    hop to them. ``on`` names an attribute that a scored row must share with its query.
    """

    l: int
    w: int = 1
    t: int = 1
    ties: bool = False
    hops: int = 1
    include_one_hop: bool = False
    on: str | None = None

    def width(self, step: int) -> int:
        return self.w if step >= self.t else 1


def _hop_sql(src: str, edges: bool, hint: str = "") -> str:
    nxt = "g.neighbor" if edges else "explode(g.nbs)"
    return f"SELECT {hint} f.q, {nxt} AS id FROM {src} f JOIN {{graph}} g ON f.id = g.id"


def _expand_ctes(beam: Beam, edges: bool) -> list[str]:
    """Picked vertices -> ``reached(q, id)``, duplicates included; the graph fits a broadcast."""
    hint = "/*+ BROADCAST(g) */"
    ctes = [
        "frontier AS (SELECT q, id FROM {state} WHERE pick)",
        f"hop1 AS ({_hop_sql('frontier', edges, hint)})",
    ]
    if beam.hops == 1:
        return [*ctes, "reached AS (SELECT q, id FROM hop1)"]
    ctes += ["near AS (SELECT DISTINCT q, id FROM hop1)", f"hop2 AS ({_hop_sql('near', edges, hint)})"]
    also = " UNION ALL SELECT q, id FROM near" if beam.include_one_hop else ""
    return [*ctes, f"reached AS (SELECT q, id FROM hop2{also})"]


def _fresh_ctes(spread: str) -> list[str]:
    """``reached`` without duplicates and without what is listed already: one aggregation."""
    return [
        f"""met AS (SELECT {spread} q, id, known FROM (
            SELECT q, id, 0 AS known FROM reached UNION ALL SELECT q, id, 1 FROM {{state}}))""",
        "fresh AS (SELECT q, id FROM met GROUP BY q, id HAVING max(known) = 0)",
    ]


def _merge_ctes(beam: Beam, score: str, fresh: str, spread: str = "", hint: str = "") -> list[str]:
    """Score the fresh pairs (those that pass the filter) and add them to the list.

    With ``spread`` both sides of the union are partitioned by q in the same way: the union keeps
    that, and the ranking after it needs no further exchange."""
    same = f"WHERE b.{beam.on} = s.{beam.on}" if beam.on else ""
    # A query's counters travel with its new rows too, which may push all its old rows off the list.
    return [
        "counters AS (SELECT q, max(steps) AS steps, max(visited) AS visited FROM {state} GROUP BY q)",
        f"""scored AS (
            SELECT {hint} c.q, c.id, {score} AS dist, k.steps, k.visited
            FROM {fresh} c JOIN {{base}} b ON c.id = b.id JOIN {{queries}} s ON c.q = s.q
            JOIN counters k ON c.q = k.q {same})""",
        f"""merged AS (
            SELECT {spread} q, id, dist, seen OR pick AS seen, ok, steps, visited FROM {{state}}
            UNION ALL
            SELECT q, id, dist, false, true, steps, visited FROM scored)""",
    ]


def _rank_ctes(beam: Beam, source: str, width: int) -> list[str]:
    """Cut ``source`` to ``l`` rows per query and choose the vertices to expand next."""
    order = "PARTITION BY q ORDER BY dist, id"
    whole = f"{order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
    so_far = f"{order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    if beam.ties:
        cut = "rank() OVER (PARTITION BY q ORDER BY dist)"
        kept = "(SELECT *, rank() OVER (PARTITION BY q, seen ORDER BY dist) AS turn FROM kept)"
        turn = "turn"
        picks = f"count_if(NOT seen AND turn <= {width}) OVER ({whole})"
    else:
        cut, kept = f"row_number() OVER ({order})", "kept"
        turn = f"sum(if(seen, 0, 1)) OVER ({so_far})"
        picks = f"least({width}, sum(if(seen, 0, 1)) OVER ({whole}))"
    # the counters use the frame of the same window as the turn: one sort, two window passes
    return [
        f"ranked AS (SELECT *, {cut} AS place FROM {source})",
        f"kept AS (SELECT * FROM ranked WHERE place <= {beam.l})",
        f"""chosen AS (
            SELECT *, NOT seen AND {turn} <= {width} AS pick, {picks} AS picks,
                   max(steps) OVER ({whole}) AS steps0, max(visited) OVER ({whole}) AS visited0
            FROM {kept})""",
    ]


CLOSE = """
    SELECT q, id, dist, seen, ok, pick, picks > 0 AS active,
           steps0 + if(picks > 0, 1, 0) AS steps, visited0 + picks AS visited
    FROM chosen"""


def _with(ctes: list[str], select: str) -> str:
    return f"WITH {', '.join(ctes)} {select}"


def _seed_ctes(beam: Beam, score: str, spread: str) -> list[str]:
    """Every query starts with the entry vertex, scored whether or not it meets the filter."""
    ok = f"coalesce(b.{beam.on} = s.{beam.on}, false)" if beam.on else "true"
    return [
        f"""seeds AS (
            SELECT {spread} s.q AS q, b.id AS id, {score} AS dist, false AS seen, {ok} AS ok,
                   0L AS steps, 0L AS visited
            FROM {{start}})"""
    ]


def entry_row(base: DataFrame, entry: int):
    row = base.where(F.col("id") == entry).first()
    if row is None:
        raise ValueError(f"entry vertex {entry} is not in the base table")
    return row


def with_entry(queries: DataFrame, base: DataFrame, entry: int) -> DataFrame:
    """Every query ``s`` beside the entry vertex ``b``, fetched by key and carried as a literal:
    one vector through the driver, and no join without a key."""
    row = entry_row(base, entry)
    fields = []
    for f in base.schema.fields:
        value = row[f.name]
        value = list(value) if isinstance(value, list) else value
        fields.append(F.lit(value).cast(f.dataType).alias(f.name))
    return queries.select(F.struct(*queries.columns).alias("s"), F.struct(*fields).alias("b"))


def asked_rows(table: DataFrame, asked: DataFrame, rows: int) -> DataFrame:
    """The rows of a large table whose id occurs in ``asked``, which has ``rows`` rows.

    The table is never shuffled as a whole for this: a few ids become a literal filter that
    reaches the scan, more are broadcast to it, and only what matches travels on to the join. In
    the first steps, when every query stands at the same vertex, that is a handful of rows, which
    adaptive execution then broadcasts, so no task gets all queries. Past the size that may be
    broadcast the table itself is joined; written with ``bucketed`` it stays in place then too.
    """
    if rows <= LOOKUP_IDS:
        ids = [r["id"] for r in asked.select("id").distinct().collect()]
        return table.where(F.col("id").isin(ids))
    if rows * ID_BYTES <= BROADCAST_LIMIT:
        return table.join(F.broadcast(asked.select("id").distinct()), "id", "left_semi")
    return table


class _Run:
    """One search: the statements of a step, and the two ways to run them."""

    def __init__(self, base, graph, queries, beam: Beam, score: str, small: bool, parts: int):
        self.spark = base.sparkSession
        self.base, self.graph, self.queries = base, graph, queries
        self.beam, self.score, self.small = beam, score, small
        self.edges = is_edges(graph)
        self.spread = f"/*+ REPARTITION({parts}, q) */" if small else ""
        self.tagged = None
        if beam.on and not small:  # edges with the attribute of their end, so that others are left out before they move
            ends = base.select(F.col("id").alias("neighbor"), beam.on)
            self.tagged = written(to_edges(graph).join(ends, "neighbor").select("id", beam.on, "neighbor"), "tagged")

    def close(self, ctes: list[str], source: str, step: int, **inputs) -> tuple[DataFrame, dict]:
        """Rank and cut ``source``, checkpoint the new state, return it with its counts."""
        ranked = _rank_ctes(self.beam, source, self.beam.width(step))
        df = self.spark.sql(_with([*ctes, *ranked], CLOSE), **inputs)
        return _counted(
            df, "count_if(pick) AS picks", "count_if(active) AS active", "count(*) AS rows")

    def seed(self, entry: int) -> tuple[DataFrame, dict]:
        ctes = _seed_ctes(self.beam, self.score, self.spread)
        start = with_entry(self.queries, self.base, entry)
        return self.close(ctes, "seeds", 1, start=start)

    def step_small(self, state: DataFrame, picks: int, step: int) -> tuple[DataFrame, dict]:
        """Everything fits a broadcast: the whole step is one statement. Its two exchanges by q
        (of the list and of the neighbours) run side by side."""
        ctes = [
            *_expand_ctes(self.beam, self.edges), *_fresh_ctes(self.spread),
            *_merge_ctes(self.beam, self.score, "fresh", self.spread, "/*+ BROADCAST(b, s) */"),
        ]
        return self.close(ctes, "merged", step, state=state, graph=self.graph, base=self.base,
                          queries=self.queries)

    def hop(self, src: DataFrame, rows: int) -> DataFrame:
        """(q, id) -> neighbours (q, id)."""
        return self.spark.sql(_hop_sql("{src}", self.edges), src=src, graph=asked_rows(self.graph, src, rows))

    def last_hop(self, src: DataFrame, rows: int) -> DataFrame:
        """The same; with an attribute only neighbours that share the query's."""
        if self.tagged is None:
            return self.hop(src, rows)
        on = self.beam.on
        src = src.join(self.queries.select("q", on), "q")
        return src.join(asked_rows(self.tagged, src, rows), ["id", on]).select("q", F.col("neighbor").alias("id"))

    def step_large(self, state: DataFrame, picks: int, step: int) -> tuple[DataFrame, dict]:
        """Large tables: each join is preceded by the number of ids it asks for."""
        spark, beam = self.spark, self.beam
        frontier = state.where("pick").select("q", "id")
        if beam.hops == 2:
            near, m = _counted(self.hop(frontier, picks).distinct(), "count(*) AS rows")
            hop = self.last_hop(near, m["rows"])
            if beam.include_one_hop:
                hop = hop.unionByName(near)
        else:
            hop = self.last_hop(frontier, picks)
        fresh = spark.sql(
            _with(["reached AS (SELECT * FROM {hop})", *_fresh_ctes("")], "SELECT q, id FROM fresh"),
            hop=hop, state=state)
        fresh, m = _counted(fresh, "count(*) AS rows")
        base = asked_rows(self.base, fresh, m["rows"])
        return self.close(_merge_ctes(beam, self.score, "{fresh}"), "merged", step,
                          state=state, fresh=fresh, base=base, queries=self.queries)


def _counted(df: DataFrame, *metrics: str) -> tuple[DataFrame, dict]:
    """Checkpoint and read counts taken on the way, without a second pass."""
    seen = Observation()
    df = checkpoint(df.observe(seen, *[F.expr(m) for m in metrics]))
    return df, seen.get


def search(
    base: DataFrame,
    graph: DataFrame,
    queries: DataFrame,
    entry: int,
    beam: Beam,
    *,
    score: str | None = None,
    small: bool | None = None,
    metric=None,
    dtype=np.float64,
    at: walk.Vertices | None = None,
) -> DataFrame:
    """Run to the end and return the final candidate lists (columns ``STATE``).

    ``score`` is the distance as SQL text over ``b.data`` and ``s.qv`` (an expression or a
    registered function); Euclidean by default. ``metric`` is the same distance as a kernel of
    ``blocks``, on vectors of ``dtype``.

    ``small`` says that graph, base and queries all fit a broadcast; by default Catalyst's size
    estimates decide. More than ``MANY_QUERIES`` queries on tables that do not fit go the way of ``walk``, over
    the stored vertices ``at`` if they are given. Results do not depend on it: all forms of the distance
    add up in one order. Rows without a vector take no part.
    """
    spark = base.sparkSession
    base = base.select("id", "data", *([beam.on] if beam.on else [])).where("data IS NOT NULL")
    # every step reads the queries again: store them, so that a derived table is computed once
    queries = written(queries.select("q", "qv", *([beam.on] if beam.on else [])).where("qv IS NOT NULL"), "queries")
    if small is None:
        small = fits_broadcast(base, graph, queries, limit=SMALL_LIMIT)
    count = queries.count()
    metric = metric or (L2() if score is None else None)
    if not small and count > MANY_QUERIES and metric and beam.hops == 1 and not beam.on:
        first = entry_row(base, entry)["data"]
        stored = at or walk.vertices(base, graph)
        found = walk.search(stored, first, queries, base, entry, beam, metric, dtype)
        if at is None:
            stored.drop()
        return found
    if score is None:
        score = l2_sql("b.data", "s.qv") if small else f"{register_l2(spark)}(b.data, s.qv)"
    parts = partitions_for(spark, count * beam.l, ROW_BYTES, min_rows=256)
    run = _Run(base, graph, queries, beam, score, small, parts)
    advance = run.step_small if small else run.step_large

    step = 1
    state, m = run.seed(entry)
    finished: list[DataFrame] = []
    while m["picks"]:
        if 2 * m["active"] <= m["rows"]:
            # Most rows belong to queries that are done: set them aside. The rest at least halves
            # each time, so there are at most log2(queries) such parts.
            finished.append(state.where("NOT active").select(STATE))
            state = state.where("active")
        step += 1
        state, m = advance(state, m["picks"], step)
    out = state.select(STATE)
    for part in finished:
        out = out.unionByName(part)
    return out


def topk(state: DataFrame, k: int) -> DataFrame:
    """The k nearest listed rows per query that may be returned -> (q, rank, id, dist)."""
    return rank_nearest(state.where("ok").select("q", "id", "dist"), k)


def topk_lists(result: DataFrame) -> DataFrame:
    """(q, rank, id, dist) -> (q, ids), nearest first. At most k entries per list."""
    pairs = F.array_sort(F.collect_list(F.struct("rank", "id")))
    return result.groupBy("q").agg(F.transform(pairs, lambda p: p["id"]).alias("ids"))


def trace(state: DataFrame) -> DataFrame:
    """Productive steps and expanded vertices per query."""
    return state.groupBy("q").agg(F.max("steps").alias("steps"), F.max("visited").alias("visited"))


def beam_search(base, graph, queries, entry, l, k, **kw) -> DataFrame:
    """Greedy batched search: the one nearest unexpanded vertex per query and step."""
    return topk(search(base, graph, queries, entry, Beam(l), **kw), k)


def two_phase_search(base, graph, queries, entry, l, k, w=4, t=10, **kw) -> DataFrame:
    """Greedy up to step ``t``, then ``w`` vertices per query and step: far fewer steps."""
    return topk(search(base, graph, queries, entry, Beam(l, w, t), **kw), k)


def approx_knn(base, queries, k, r=32, l=100, w=4, t=5, graph=None, entry=None, **kw) -> DataFrame:
    """Approximate top k as an index would answer it: build graph and entry vertex unless they are
    given, then search. Build once with ``build_index`` when more than one call follows."""
    if graph is None or entry is None:
        graph, entry = build_index(base, r)
    return two_phase_search(base, graph, queries, entry, l, k, w, t, **kw)


def build_index(base: DataFrame, r: int, **kw) -> tuple[DataFrame, int]:
    """(graph table in the shared folder, entry vertex)."""
    return written(knn_graph(base, r, **kw), "graph"), medoid(base).first()["id"]


def hybrid_search(
    base, graph, queries, entry, l, k, on="a1", include_one_hop=False, w=1, t=1, fill=True, **kw
) -> DataFrame:
    """Attribute-filtered search that looks two hops ahead, so that matching vertices stay
    connected through non-matching ones.

    Matching vertices that lie further apart than that leave some queries with fewer than k although
    more rows match. Those queries are answered exactly from the rows of their attribute value;
    with ``fill=False`` they keep what the walk found."""
    beam = Beam(l, w, t, hops=2, include_one_hop=include_one_hop, on=on)
    hits = topk(search(base, graph, queries, entry, beam, **kw), k)
    if not fill:
        return hits
    hits = written(hits, "hits")
    short = written(_short(queries, hits, _due(base, k, on), on), "short")
    return hits.join(short.select("q"), "q", "left_anti").unionByName(_exactly(base, short, k, on))


def _due(base: DataFrame, k: int, on: str) -> DataFrame:
    """``(value, due)``: how many of k rows each attribute value has."""
    return written(base.where("data IS NOT NULL").groupBy(on).agg(F.least(F.count("*"), F.lit(k)).alias("due")), "due")


def _short(queries: DataFrame, hits: DataFrame, due: DataFrame, on: str) -> DataFrame:
    """The queries with fewer hits than are due to them."""
    got = hits.groupBy("q").agg(F.count("*").alias("got"))
    rows = queries.where("qv IS NOT NULL")
    return rows.join(due, on).join(got, "q", "left").where(F.coalesce("got", F.lit(0)) < F.col("due")).select(queries.columns)


def _exactly(base: DataFrame, queries: DataFrame, k: int, on: str) -> DataFrame:
    if queries.isEmpty():
        return queries.sparkSession.createDataFrame([], "q long, rank int, id long, dist double")
    return filtered_knn(base, queries, k, on)


def post_filter_search(
    base, graph, queries, entry, l, k, on="a1", w=4, t=10, widen=True, most=None, **kw
) -> DataFrame:
    """Unfiltered wide beam first, then the filter on what it found.

    Queries left with fewer than k, while more rows share their attribute, search again with twice
    the list (and twice the width), until it holds all that can be reached or would exceed ``most``
    (four times ``l`` by default): what is then still short is answered exactly from the rows of its
    attribute value. With ``widen=False`` there is one search, which may return fewer than k.

    Tables that every task can hold go the way of ``held``, unless ``small`` says how to search."""
    due = _due(base, k, on) if widen else None
    most = most or 4 * l
    parts = at = table = None
    small = kw.pop("small", None)
    metric = kw.get("metric") or (L2() if kw.get("score") is None else None)
    if small is None and metric:
        table = held.hold(base, graph, queries, on)
        if table:
            entry_row(base.where("data IS NOT NULL"), entry)
    small = fits_broadcast(base, graph, queries, limit=SMALL_LIMIT) if small is None else small
    if widen and not table and not small and queries.count() > MANY_QUERIES:
        at = walk.vertices(base.select("id", "data").where("data IS NOT NULL"), graph)  # once for all searches
    while True:
        if table:
            hits = held.search(table, queries, entry, Beam(l, w, t), metric, kw.get("dtype", np.float64))
        else:
            found = written(search(base, graph, queries, entry, Beam(l, w, t), at=at, small=small, **kw).select("q", "id", "dist"), "found")
            hits = (
                found.join(asked_rows(base.select("id", on), found, found.count()), "id")
                .join(queries.select("q", on), ["q", on]).select("q", "id", "dist")
            )
        if not widen:
            return rank_nearest(hits, k)
        hits = written(hits, "hits")
        queries = written(_short(queries, hits, due, on), "short")
        settled = hits.join(queries.select("q"), "q", "left_anti")
        parts = settled if parts is None else parts.unionByName(settled)
        l, w = 2 * l, 2 * w
        if l > most or queries.isEmpty():
            if at:
                at.drop()
            if table:
                table.shared.destroy()
            return rank_nearest(parts, k).unionByName(_exactly(base, queries, k, on))


@dataclass(frozen=True)
class Stored:
    """Base and graph written by ``store``."""

    base: DataFrame
    graph: DataFrame


def store(base: DataFrame, graph: DataFrame, name: str, buckets: int) -> Stored:
    """Write base and graph hashed into ``buckets`` by id and sorted by id, for searches of large tables.

    Every step then joins them where they lie: only the ids and pairs of the step move."""
    return Stored(bucketed(base, f"{name}_base", buckets), bucketed(graph, f"{name}_graph", buckets))


def drop_stored(spark, name: str) -> None:
    for table in (f"{name}_base", f"{name}_graph"):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
