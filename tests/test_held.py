"""Post-filter search over tables that a task holds whole, against the other forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import beam, graph, held
from nearfield.session import written

from test_search import brute, found, vectors

RNG = np.random.default_rng(6)


@pytest.fixture(scope="module")
def tables_(spark):
    """A third of the base are copies of one vector; a vector, an attribute and a query vector are missing."""
    x = RNG.normal(size=(240, 8)).astype("f4")
    x[::3] = x[0]
    a1 = np.where(np.arange(240) % 3 == 1, 7, RNG.integers(0, 5, 240))
    q = np.concatenate([RNG.normal(size=(70, 8)), x[:10]]).astype("f4")
    base = vectors(spark, x, a1).withColumn("data", F.when(F.col("id") != 4, F.col("data"))).withColumn("a1", F.when(F.col("id") != 8, F.col("a1")))
    queries = vectors(spark, q, np.where(np.arange(80) % 2 == 0, 7, RNG.integers(0, 5, 80)), "q", "qv")
    queries = queries.withColumn("qv", F.when(F.col("q") != 7, F.col("qv"))).withColumn("a1", F.when(F.col("q") != 9, F.col("a1")))
    return written(base, "base"), written(queries, "queries"), written(graph.knn_graph(base.where("id <> 4"), 6), "graph")


@pytest.mark.parametrize("links,l,w,widen", [("adjacency", 12, 4, True), ("edges", 30, 30, True), ("adjacency", 20, 3, False)])
def test_post_filter_agrees_with_the_steps(spark, tables_, links, l, w, widen, monkeypatch):
    base, queries, g = tables_
    g = g if links == "adjacency" else graph.to_edges(g)
    rows = lambda small: sorted(map(tuple, beam.post_filter_search(base, g, queries, 5, l, 4, w=w, t=3, widen=widen, small=small).collect()))
    want = rows(True)
    monkeypatch.setattr(held, "MET_CELLS", 240 * 7)
    monkeypatch.setattr(beam, "search", lambda *a, **kw: pytest.fail("a job per step"))
    assert rows(None) == want and len(want) > 100


def test_odd_tables_are_not_held(spark, tables_):
    base, queries, g = tables_
    assert held.hold(base, g, queries, "a1").count == 239
    assert held.hold(base, g, queries, "a1", limit=239 * 32) is None
    assert held.hold(base.unionByName(base), g, queries, "a1") is None
    assert held.hold(base, g, queries.unionByName(queries), "a1") is None
    assert held.hold(base, g, queries.withColumn("a1", F.col("a1").cast("double")), "a1") is None
    assert held.hold(base, g, queries.withColumn("qv", F.slice("qv", 1, 7)), "a1") is None
    with pytest.raises(ValueError, match="not in the base"):
        beam.post_filter_search(base, g, queries, 4, 12, 4)
