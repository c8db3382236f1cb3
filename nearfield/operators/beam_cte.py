"""The beam search as one SQL statement: a recursive CTE whose rows carry the list as an array.

Meant for one or a few queries, as an interactive statement would be. Spark rejects aggregates and
windows over the recursive relation, so a step may only join and use array functions: the graph is
first given a payload, each vertex holding its neighbours with their vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import l2_sql
from ..session import written
from .beam import with_entry
from .graph import to_edges

#: Bytes of neighbours with their vectors that one row may hold: a hub of 500,000 neighbours of 64 numbers.
ROW_BYTES = 256 << 20


def neighbour_payload(base: DataFrame, graph: DataFrame) -> DataFrame:
    """(id, nb array<struct<id, v>>), written once. It repeats every vector per in-edge, so it
    suits tables that fit that many times over; the batched search does not need it. A vertex
    whose neighbours exceed what Spark can hold in one row is refused: search such graphs in batched form."""
    edges = to_edges(graph)
    degree = edges.groupBy("id").count().agg(F.max("count")).first()[0] or 0
    size = base.agg(F.max(F.size("data"))).first()[0] or 0
    if degree * (8 * size + 16) > ROW_BYTES:
        raise ValueError(f"a vertex has {degree} neighbours, more than {ROW_BYTES} bytes in one row")
    pairs = (
        edges
        .join(base.select(F.col("id").alias("neighbor"), "data"), "neighbor")
        .select("id", F.struct(F.col("neighbor").alias("id"), F.col("data").alias("v")).alias("n"))
        .groupBy("id").agg(F.collect_list("n").alias("nb"))
    )
    vertices = base.select("id").join(pairs, "id", "left")
    return written(vertices, "payload")


def beam_search_cte(
    payload: DataFrame, base: DataFrame, queries: DataFrame, entry: int, l: int,
    max_steps: int | None = None,
) -> DataFrame:
    """Every step's candidate list -> (q, step, rank, id, dist); step 0 holds the entry vertex.

    A vertex without neighbours stays in the walk (left join), so a dead end does not stop it. A step
    visits a vertex that was not visited, so by default there may be as many steps as vertices.
    """
    max_steps = max_steps or base.count() + 1
    dist = l2_sql("n.v", "s.qv")
    first = l2_sql("b.data", "s.qv")
    unseen = "filter(s.L, x -> NOT array_contains(s.V, x.id))"
    pick = f"get({unseen}, 0).id"
    scored = f"transform(coalesce(g.nb, array()), n -> struct({dist} AS dist, n.id AS id))"
    return base.sparkSession.sql(
        f"""
        WITH RECURSIVE walk(q, qv, step, L, V) MAX RECURSION LEVEL {int(max_steps)} AS (
            SELECT s.q, s.qv, 0, array(struct({first} AS dist, b.id AS id)),
                   cast(array() AS array<bigint>)
            FROM {{start}}
            UNION ALL
            SELECT s.q, s.qv, s.step + 1,
                   slice(array_sort(array_union(s.L, {scored})), 1, {int(l)}),
                   array_append(s.V, {pick})
            FROM walk s LEFT JOIN {{payload}} g ON g.id = {pick}
            WHERE exists(s.L, x -> NOT array_contains(s.V, x.id))
        )
        SELECT q, step, pos + 1 AS rank, col.id AS id, col.dist AS dist
        FROM (SELECT q, step, posexplode(L) FROM walk)""",
        payload=payload, start=with_entry(queries, base.select("id", "data"), entry),
    )


def last_step(steps: DataFrame, k: int) -> DataFrame:
    """The final list of every query, cut to k -> (q, rank, id, dist)."""
    ends = steps.groupBy("q").agg(F.max("step").alias("step"))
    return (
        steps.join(ends, ["q", "step"], "left_semi").where(F.col("rank") <= k)
        .select("q", F.col("rank").cast("int").alias("rank"), "id", "dist")
    )
