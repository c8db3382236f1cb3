"""Searches of many queries over large tables, against the plain search of ``test_search``."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import beam, graph, pq, walk
from nearfield.operators.beam import Beam, search, topk, trace
from nearfield.session import written

from test_search import brute, found, reference_walk, vectors

RNG = np.random.default_rng(5)


@pytest.fixture(scope="module")
def skewed():
    """A third of the base are copies of one vector."""
    x = RNG.normal(size=(240, 8)).astype("f4")
    x[::3] = x[0]
    a1 = np.where(np.arange(240) % 3 == 1, 7, RNG.integers(0, 5, 240))
    q = np.concatenate([RNG.normal(size=(20, 8)), x[:10]]).astype("f4")
    return x, a1, q, np.where(np.arange(30) % 2 == 0, 7, RNG.integers(0, 5, 30))


@pytest.fixture(scope="module")
def tables_(spark, skewed):
    x, a1, q, qa = skewed
    base, queries = vectors(spark, x, a1), vectors(spark, q, qa, "q", "qv")
    return base, queries, written(graph.knn_graph(base, 6), "graph")


@pytest.fixture(autouse=True)
def many(monkeypatch):
    monkeypatch.setattr(beam, "MANY_QUERIES", 0)


@pytest.mark.parametrize("case,form,hot,done", [
    (Beam(10, 4, 3), "edges", 1, 1),
    (Beam(8, 3, 2, ties=True), "adjacency", 512, 2),
    (Beam(3), "edges", 512, 100),
])
def test_search_follows_the_definition(tables_, skewed, case, form, hot, done, monkeypatch):
    base, queries, g = tables_
    x, _, q, _ = skewed
    monkeypatch.setattr(walk, "HOT_LEAST", hot)
    monkeypatch.setattr(walk, "FINISHED", done)
    nbs = {r["id"]: r["nbs"] for r in g.collect()}
    state = search(base, g if form == "adjacency" else graph.to_edges(g), queries, 5, case, small=False)
    got = {}
    for r in state.collect():
        got.setdefault(r["q"], []).append((round(r["dist"], 9), r["id"]))
    counts = {r["q"]: (r["steps"], r["visited"]) for r in trace(state).collect()}
    for j, v in enumerate(q):
        want, n_steps, n_seen = reference_walk(x, nbs, v, 5, case.l, case.w, case.t, case.ties)
        assert sorted(got[j]) == [(round(d, 9), i) for d, i in want]
        assert counts[j] == (n_steps, n_seen)


def test_forms_agree_to_the_last_bit(tables_):
    base, queries, g = tables_
    rows = lambda small: sorted(map(tuple, search(base, g, queries, 5, Beam(12, 4, 2), small=small).collect()))
    assert rows(False) == rows(True)


def test_a_hub_and_lost_vectors(spark):
    """A vertex with more neighbours than one row holds, neighbours without a vector or a row, null queries."""
    x = RNG.normal(size=(90, 4)).astype("f4")
    edges = spark.createDataFrame([(0, i) for i in range(1, 95)], "id long, neighbor long")
    base = vectors(spark, x).withColumn("data", F.when(F.col("id") != 3, F.col("data")))
    queries = vectors(spark, x[:40], None, "q", "qv").withColumn("qv", F.when(F.col("q") != 7, F.col("qv")))
    want = {r for r in brute(np.where(np.arange(90)[:, None] == 3, 1e9, x), x[:40], 6) if r[0] != 7}
    assert found(topk(search(base, edges, queries, 0, Beam(6), small=False), 6)) == want
    assert search(base, edges, queries.where("q > 1000"), 0, Beam(6), small=False).count() == 0
    with pytest.raises(ValueError, match="not in the base"):
        search(base, edges, queries, 3, Beam(6), small=False)


def test_codes(spark, tables_, skewed):
    base, queries, g = tables_
    book = pq.initial_codebook(base.where("id % 3 <> 0 OR id = 0"), [0, 3, 8], 5)
    table = pq.lut_array(pq.lut(book))
    coded = written(pq.encode(base.select("id", "data"), book, [0, 3, 8]), "codes")
    qcodes = written(pq.encode(queries.select("q", "qv"), book, [0, 3, 8], "qv"), "qcodes")
    rows = lambda small: found(topk(pq.pq_search(coded, g, qcodes, 5, table, 12, 4, 2, small=small), 9))
    assert rows(False) == rows(True)


def test_post_filter(tables_, skewed):
    base, queries, g = tables_
    x, a1, q, qa = skewed
    want = brute(x, q, 4, a1, qa)
    rows = lambda small: found(beam.post_filter_search(base, g, queries, 5, 12, 4, small=small))
    got = rows(False)
    assert got == rows(True) and len(got) == len(want)


def test_vertices_stay_in_place(spark, tables_, monkeypatch):
    """No exchange of a step carries neighbours' vectors, and what a search stores is gone after it."""
    base, queries, g = tables_
    plans, gone = [], []
    monkeypatch.setattr(walk, "removed", lambda s, path, f=walk.removed: (gone.append(path), f(s, path)))
    monkeypatch.setattr(walk, "_Lists", type("Seen", (walk._Lists,), {
        "__init__": lambda self, df, f=walk._Lists.__init__: (plans.append(df._jdf.queryExecution().executedPlan().toString()), f(self, df))[1]}))
    out = search(base, g, queries, 5, Beam(10, 4, 2), small=False)
    assert len(gone) >= 3 and out.count() == 300
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("vertices_")]
    steps = [p for p in plans if "vertices_" in p]
    assert steps
    for plan in steps:
        lines = plan.splitlines()
        at = next(n for n, line in enumerate(lines) if "vertices_" in line)
        assert "Exchange" not in "".join(lines[at - 3:at]), json.dumps(lines)


def test_answers_wait_for_their_turn(spark, tables_, monkeypatch):
    """A greedy search takes fewer rounds than steps, and no exchange of a round carries a query's list."""
    base, queries, g = tables_
    plans = []
    monkeypatch.setattr(walk, "_Lists", type("Seen", (walk._Lists,), {
        "__init__": lambda self, df, f=walk._Lists.__init__: (plans.append(df._jdf.queryExecution().executedPlan().toString()), f(self, df))[1]}))
    state = search(base, g, queries, 5, Beam(8), small=False)
    assert len(plans) < max(r["steps"] for r in trace(state).collect())
    rounds = [p for p in plans if "vertices_" in p]
    assert rounds and not [t.name for t in spark.catalog.listTables() if t.name.startswith(("lists_", "vectors_"))]
    for line in "\n".join(rounds).splitlines():
        assert not ("Exchange" in line and "hashpartitioning(q#" in line and "held#" in line), line
    for plan in rounds:
        lines = plan.splitlines()
        at = max(n for n, line in enumerate(lines) if "lists_" in line and "held" in line)
        above = next(n for n in range(at, 0, -1) if "Exchange" in lines[n] or "Join" in lines[n])
        assert "Join" in lines[above], plan
