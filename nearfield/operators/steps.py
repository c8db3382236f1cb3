"""The relational steps a search is made of, each usable on its own.

``L(q, id, dist)`` is a candidate list per query, ``V(q, id)`` the visited pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import l2
from .graph import to_edges
from .knn import rank_nearest

KEY = ["q", "id"]


def unvisited(L: DataFrame, V: DataFrame) -> DataFrame:
    """Candidates not visited yet (NOT EXISTS: a row with a null in its key is never visited)."""
    return L.join(V.select(KEY), KEY, "left_anti")


def unvisited_not_in(L: DataFrame, V: DataFrame) -> DataFrame:
    """``(q, id) NOT IN (SELECT q, id FROM V)`` with SQL's rule for nulls, in equi-joins only.

    A row stays if it differs from every row of V for certain: in some column both are known and
    unequal. So a row of V that is null in both columns removes all; one that is null in one column
    removes all that agree in the other or are null there; and a row that is itself null in a column
    stays only if the other column agrees with no row of V and is null in none. With an empty V all
    rows stay. (As a row-pair predicate Spark plans this as a nested loop over both tables.)
    """
    q, at = KEY
    state = V.agg(
        F.count("*").alias("rows"), F.count_if(F.col(q).isNull() & F.col(at).isNull()).alias("open"),
        F.count_if(F.col(q).isNull()).alias(q), F.count_if(F.col(at).isNull()).alias(at)).first()
    if not state["rows"]:
        return L
    if state["open"]:
        return L.limit(0)
    whole = L.where(F.col(q).isNotNull() & F.col(at).isNotNull()).join(V.select(KEY), KEY, "left_anti")
    parts = []
    for known, other in ((q, at), (at, q)):
        if state[other]:  # rows of V that say nothing about the other column
            whole = whole.join(V.where(F.col(other).isNull()).select(known), known, "left_anti")
        if not state[known]:
            half = L.where(F.col(known).isNotNull() & F.col(other).isNull())
            parts.append(half.join(V.select(known), known, "left_anti"))
    for part in parts:
        whole = whole.unionByName(part)
    return whole.select(L.columns)


def unvisited_except(L: DataFrame, V: DataFrame) -> DataFrame:
    """Set difference of the (q, id) pairs."""
    return L.select(KEY).subtract(V.select(KEY))


def nearest_unvisited(rows: DataFrame) -> DataFrame:
    """Per query the rows at minimum distance, ties kept: one shuffle instead of a self-join."""
    least = F.min("dist").over(Window.partitionBy("q"))
    return rows.withColumn("least", least).where("dist = least").drop("least")


def argmin_group(rows: DataFrame) -> DataFrame:
    """Per query the single nearest row in (dist, id) order; combines map-side."""
    best = F.min(F.struct("dist", "id"))
    return rows.groupBy("q").agg(best.alias("b")).select("q", "b.id", "b.dist")


def argmin_overall(rows: DataFrame) -> DataFrame:
    """Rows whose distance equals the minimum over all rows (scalar subquery)."""
    return rows.sparkSession.sql(
        "SELECT q, id, dist FROM {rows} WHERE dist = (SELECT min(dist) FROM {rows})", rows=rows
    )


def expand_distinct(picked: DataFrame, graph: DataFrame) -> DataFrame:
    """Neighbours of the picked vertices, each (q, neighbor) once, before any of them is scored."""
    return picked.join(to_edges(graph), "id").select("q", "neighbor").distinct()


def new_neighbors_only(picked: DataFrame, graph: DataFrame, L: DataFrame) -> DataFrame:
    """Neighbours that are not in the candidate list yet."""
    reached = expand_distinct(picked, graph).withColumnRenamed("neighbor", "id")
    return reached.join(L.select(KEY), KEY, "left_anti")


def semi_neighbors(base: DataFrame, picked: DataFrame, graph: DataFrame) -> DataFrame:
    """Base rows that are a neighbour of any picked vertex (IN subquery)."""
    wanted = picked.join(to_edges(graph), "id").select(F.col("neighbor").alias("id"))
    return base.join(wanted, "id", "left_semi")


def score_candidates(pairs: DataFrame, base: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, id) -> (q, id, dist)."""
    return (
        pairs.join(base, "id").join(queries, "q")
        .select("q", "id", l2("data", "qv").alias("dist"))
    )


def merge(L: DataFrame, scored: DataFrame, l: int) -> DataFrame:
    """UNION (duplicates removed) of list and scored rows, cut to the ``l`` nearest per query."""
    both = L.select("q", "id", "dist").unionByName(scored.select("q", "id", "dist"))
    return rank_nearest(both.groupBy(KEY).agg(F.min("dist").alias("dist")), l).drop("rank")


def overflow(L: DataFrame, l: int) -> DataFrame:
    """What a cut to ``l`` removes: every row past the ``l`` nearest of its query."""
    place = F.row_number().over(Window.partitionBy("q").orderBy("dist", "id"))
    return L.withColumn("place", place).where(F.col("place") > l).drop("place")


def topk_rank_ties(rows: DataFrame, k: int) -> DataFrame:
    """Top k with RANK: rows tied at the cut all pass."""
    place = F.rank().over(Window.partitionBy("q").orderBy("dist"))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)


def unnest_zip(lists: DataFrame, *columns: str) -> DataFrame:
    """Unnest parallel arrays position by position: (q, pos, one value per column)."""
    zipped = F.posexplode(F.arrays_zip(*columns)).alias("pos", "z")
    return lists.select("q", zipped).select("q", "pos", *[f"z.{c}" for c in columns])
