"""Searches against brute force, against each other, and on awkward inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions.vector import check_dim, l2, l2_arrow, mean_vector, register_functions
from nearfield.operators import beam, beam_cte, evaluate, graph, knn, pq, steps, tables
from nearfield.operators.beam import Beam, search, topk, trace
from nearfield.session import bucketed, written

RNG = np.random.default_rng(11)


def vectors(spark, x, a1=None, id="id", vec="data"):
    rows = [(i, [float(v) for v in r], int(a1[i]) if a1 is not None else None) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, f"{id} long, {vec} array<float>, a1 int")


def brute(x, q, k, xa=None, qa=None):
    out = set()
    for j, v in enumerate(q):
        d = np.sqrt(((x.astype(float) - v.astype(float)) ** 2).sum(1))
        ids = [i for i in np.lexsort((np.arange(len(x)), d)) if xa is None or xa[i] == qa[j]]
        out |= {(j, r + 1, int(i), round(float(d[i]), 6)) for r, i in enumerate(ids[:k])}
    return out


def found(df):
    return {(r["q"], r["rank"], r["id"], round(r["dist"], 6)) for r in df.collect()}


@pytest.fixture(scope="module")
def skewed():
    """A third of the base are copies of one vector, and a third share one attribute value."""
    x = RNG.normal(size=(240, 8)).astype("f4")
    x[::3] = x[0]
    a1 = np.where(np.arange(240) % 3 == 1, 7, RNG.integers(0, 5, 240))
    q = np.concatenate([RNG.normal(size=(20, 8)), x[:10]]).astype("f4")
    qa = np.where(np.arange(30) % 2 == 0, 7, RNG.integers(0, 5, 30))
    return x, a1, q, qa


@pytest.fixture(scope="module")
def tables_(spark, skewed):
    x, a1, q, qa = skewed
    base, queries = vectors(spark, x, a1), vectors(spark, q, qa, "q", "qv")
    return base, queries, written(graph.knn_graph(base, 6), "graph")


@pytest.mark.parametrize("plan", [{}, {"broadcast_bytes": 0, "block_bytes": 8 * 8 * 50}])
def test_exact_knn_with_copies(tables_, skewed, plan):
    base, queries, _ = tables_
    x, a1, q, qa = skewed
    assert found(knn.exact_knn(base, queries, 12, **plan)) == brute(x, q, 12)
    assert found(knn.exact_knn(base, queries, 12, "a1", **plan)) == brute(x, q, 12, a1, qa)


def test_exact_knn_more_wanted_than_there_is(spark):
    base = vectors(spark, np.eye(3, dtype="f4"))
    queries = vectors(spark, np.eye(3, dtype="f4")[:1], None, "q", "qv")
    assert knn.exact_knn(base, queries, 10).count() == 3
    assert knn.exact_knn(base, queries.where("q > 5"), 10).count() == 0
    assert knn.exact_knn(base, queries.withColumn("a1", F.lit(99)), 10, "a1").count() == 0


def test_nearest_to_plans_as_top_k(tables_, skewed):
    base, _, _ = tables_
    x, _, q, _ = skewed
    df = knn.nearest_to(base, q[3].tolist(), 5, F.col("a1") == 7)
    assert "TakeOrderedAndProject" in df._jdf.queryExecution().executedPlan().toString()
    want = [i for i in np.lexsort((np.arange(240), np.linalg.norm(x.astype(float) - q[3], axis=1)))]
    assert [r["id"] for r in df.collect()] == [i for i in want if skewed[1][i] == 7][:5]


def test_arrow_distance_equals_sql_distance(spark, tables_):
    base, queries, _ = tables_
    pairs = base.join(queries, base["id"] == queries["q"])
    row = pairs.select(F.max(F.abs(l2("data", "qv") - l2_arrow("data", "qv"))).alias("d")).first()
    assert row["d"] < 1e-12
    register_functions(spark)
    got = spark.sql("SELECT l2(array(0D, 3D), array(4D, 0D)) AS a, l2sq(array(1D), array(3D)) AS b").first()
    assert (got["a"], got["b"]) == (5.0, 4.0)


def test_dimension_check(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "id long, data array<double>")
    assert df.select(check_dim("data", 2)).first()[0] == [1.0, 2.0]
    with pytest.raises(Exception, match="expected dimension 3"):
        df.select(check_dim("data", 3)).collect()


def reference_walk(x, nbs, v, entry, l, w=1, t=1, ties=False, ok=lambda i: True):
    """Plain best-first search with an explicit visited set."""
    d = lambda i: float(np.sqrt(((x[i].astype(float) - v.astype(float)) ** 2).sum()))
    lst, seen, step = [(d(entry), entry)], set(), 0
    while True:
        open_ = [e for e in lst if e[1] not in seen]
        if not open_:
            return lst, step, len(seen)
        step += 1
        width = w if step >= t else 1
        if ties:
            picks = [e for e in open_ if sum(o[0] < e[0] for o in open_) < width]
        else:
            picks = open_[:width]
        seen |= {e[1] for e in picks}
        new = {(d(n), n) for e in picks for n in nbs.get(e[1], []) if n < len(x) and ok(n)}
        lst = sorted(set(lst) | new)
        if ties:
            lst = [e for e in lst if sum(o[0] < e[0] for o in lst) < l]
        else:
            lst = lst[:l]


@pytest.mark.parametrize("case,form,small", [
    (Beam(10), "adjacency", False),
    (Beam(10, 4, 3), "adjacency", True),
    (Beam(10, 4, 3), "edges", False),
    (Beam(15, 3, 1), "edges", True),
    (Beam(8, 3, 2, ties=True), "adjacency", True),
    (Beam(8, 3, 2, ties=True), "adjacency", False),
    (Beam(3), "adjacency", True),  # new rows push all old rows off a list shorter than the degree
    (Beam(3), "edges", False),
])
def test_search_follows_the_definition(tables_, skewed, case, form, small):
    base, queries, g = tables_
    x, _, q, _ = skewed
    nbs = {r["id"]: r["nbs"] for r in g.collect()}
    state = search(base, g if form == "adjacency" else graph.to_edges(g), queries, 5, case, small=small)
    got = {}
    for r in state.collect():
        got.setdefault(r["q"], []).append((round(r["dist"], 9), r["id"]))
    counts = {r["q"]: (r["steps"], r["visited"]) for r in trace(state).collect()}
    for j, v in enumerate(q):
        want, n_steps, n_seen = reference_walk(x, nbs, v, 5, case.l, case.w, case.t, case.ties)
        assert sorted(got[j]) == [(round(d, 9), i) for d, i in want]
        assert counts[j] == (n_steps, n_seen)


@pytest.mark.parametrize("small,one_hop", [(True, False), (False, True)])
def test_hybrid_search_follows_the_definition(tables_, skewed, one_hop, small):
    base, queries, g = tables_
    x, a1, q, qa = skewed
    nbs = {r["id"]: r["nbs"] for r in g.collect()}
    two = {i: {n for m in ns for n in nbs[m]} | (set(ns) if one_hop else set()) for i, ns in nbs.items()}
    got = found(beam.hybrid_search(base, g, queries, 5, 10, 4, include_one_hop=one_hop, small=small))
    want = set()
    for j, v in enumerate(q):
        lst, _, _ = reference_walk(x, two, v, 5, 10, ok=lambda n: a1[n] == qa[j])
        keep = [e for e in lst if a1[e[1]] == qa[j]][:4]
        want |= {(j, r + 1, i, round(d, 6)) for r, (d, i) in enumerate(keep)}
    assert got == want


def test_saturated_search_is_exact(tables_, skewed):
    base, queries, g = tables_
    x, _, q, _ = skewed
    assert found(topk(search(base, g, queries, 0, Beam(240, 60, 2)), 10)) == brute(x, q, 10)


def test_recursive_form_equals_the_loop(tables_):
    base, queries, g = tables_
    few = queries.where("q >= 20")
    payload = beam_cte.neighbour_payload(base, g)
    walk = beam_cte.beam_search_cte(payload, base, few, 5, 10)
    assert found(beam_cte.last_step(walk, 5)) == found(beam.beam_search(base, g, few, 5, 10, 5))


def test_post_filter(tables_, skewed):
    base, queries, g = tables_
    x, a1, q, qa = skewed
    got = found(beam.post_filter_search(base, g, queries, 0, 240, 4, w=60, t=2))
    assert got == brute(x, q, 4, a1, qa)


def test_post_filter_widens_until_k_are_found(tables_, skewed):
    base, queries, g = tables_
    x, a1, q, qa = skewed
    got = found(beam.post_filter_search(base, g, queries, 0, 60, 4, w=60, t=2))
    want = brute(x, q, 4, a1, qa)
    assert {r[:2] for r in got} == {r[:2] for r in want}
    once = found(beam.post_filter_search(base, g, queries, 0, 60, 4, w=60, t=2, widen=False))
    assert len(once) < len(want)


@pytest.mark.parametrize("small", [True, False])
def test_awkward_graphs(spark, small):
    x = RNG.normal(size=(5, 4)).astype("f4")
    base, queries = vectors(spark, x), vectors(spark, x[:2], None, "q", "qv")
    # 1 is missing from the graph, 2 has no neighbours, 99 is not a base row
    g = spark.createDataFrame([(0, [1, 2, 99]), (2, []), (3, [4]), (4, [3])], "id long, nbs array<long>")
    got = topk(search(base, g, queries, 0, Beam(10), small=small), 10)
    assert {r["id"] for r in got.collect()} == {0, 1, 2}
    one = search(base.where("id = 3"), g, queries, 3, Beam(1), small=small)
    assert [r["id"] for r in topk(one, 5).where("q = 0").collect()] == [3]
    assert topk(search(base, g, queries.where("q > 7"), 0, Beam(3), small=small), 3).count() == 0
    with pytest.raises(ValueError, match="entry vertex"):
        search(base, g, queries, 77, Beam(3), small=small)


def test_many_asked_ids_use_the_broadcast_and_the_plain_join(tables_, monkeypatch):
    base, queries, g = tables_
    want = found(beam.two_phase_search(base, g, queries, 5, 12, 6, 4, 2, small=True))
    monkeypatch.setattr(beam, "LOOKUP_IDS", 0)
    assert found(beam.two_phase_search(base, g, queries, 5, 12, 6, 4, 2, small=False)) == want
    monkeypatch.setattr(beam, "BROADCAST_LIMIT", 0)
    assert found(beam.two_phase_search(base, g, queries, 5, 12, 6, 4, 2, small=False)) == want


def test_bucketed_tables_are_joined_in_place(spark, tables_):
    base, _, _ = tables_
    spark.sql("DROP TABLE IF EXISTS base_by_id")
    table = bucketed(base, "base_by_id", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = spark.range(50).repartition(4, "id")
        plan = table.join(asked, "id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan_side = plan[plan.index("SortMergeJoin"):].split("Scan parquet")[0]
    assert "Exchange" not in scan_side or scan_side.index("Exchange") > scan_side.index("Project")
    spark.sql("DROP TABLE base_by_id")


def test_hub_vertex_and_shared_entry(spark):
    """One vertex points at every other one, and every query starts there."""
    x = RNG.normal(size=(300, 4)).astype("f4")
    base, queries = vectors(spark, x), vectors(spark, x[:40], None, "q", "qv")
    edges = spark.createDataFrame([(0, i) for i in range(1, 300)] + [(i, 0) for i in range(1, 300)],
                                  "id long, neighbor long")
    for small in (True, False):
        assert found(topk(search(base, edges, queries, 0, Beam(6), small=small), 6)) == brute(x, x[:40], 6)


def test_graph_jobs(tables_, skewed):
    base, _, g = tables_
    x, _, _, _ = skewed
    nbs = {r["id"]: r["nbs"] for r in g.collect()}
    for i in range(240):
        d = np.sqrt(((x.astype(float) - x[i].astype(float)) ** 2).sum(1))
        near = [int(j) for j in np.lexsort((np.arange(240), d)) if j != i][:6]
        assert nbs[i] == sorted(set(near) | {(i + 1) % 240})
    assert graph.to_adjacency(graph.to_edges(g)).exceptAll(g).isEmpty()
    st = graph.graph_stats(g.unionByName(g.limit(1).selectExpr("-1L AS id", "array() AS nbs"))).first()
    assert (st["vertices"], st["no_out_edges"]) == (241, 1)
    assert st["edges"] == sum(len(v) for v in nbs.values())
    mean = x.astype(float).mean(0)
    assert np.allclose(mean_vector(base).first()["data"], mean)
    assert graph.medoid(base).first()["id"] == int(np.linalg.norm(x.astype(float) - mean, axis=1).argmin())


def test_two_hop_option(spark):
    g = spark.createDataFrame([(0, [1, 2]), (1, [3]), (2, [0])], "id long, nbs array<long>")
    nodes = spark.createDataFrame([(9, 0)], "q long, id long")
    assert {r["neighbor"] for r in graph.two_hop(nodes, g).collect()} == {3, 0}
    assert {r["neighbor"] for r in graph.two_hop(nodes, g, True).collect()} == {0, 1, 2, 3}


def test_forms_of_the_same_step_agree(tables_):
    base, queries, g = tables_
    L = knn.exact_knn(base, queries, 9).select("q", "id", "dist")
    V = L.where("id % 2 = 0").select("q", "id")
    a = steps.unvisited(L, V)
    assert a.select("q", "id").exceptAll(steps.unvisited_except(L, V)).isEmpty()
    nearest = steps.nearest_unvisited(a)
    ties = a.join(a.groupBy("q").agg(F.min("dist").alias("m")), "q").where("dist = m").drop("m")
    assert nearest.exceptAll(ties).isEmpty() and ties.exceptAll(nearest).isEmpty()
    best = steps.argmin_group(a)
    assert best.exceptAll(nearest).isEmpty() and best.count() == 30


def test_ids_split_and_attributes(spark):
    df = spark.createDataFrame([(i, (i * 37) % 101, i % 3 == 0) for i in range(101)],
                               "x long, y long, hot boolean")
    got = tables.assign_ids(df, "hot", "y").orderBy("hot", "y").collect()
    assert [r["id"] for r in got] == list(range(101))
    parts = tables.split(df, 0.3, "x")
    assert 10 < parts.where("part = 'test'").count() < 55
    assert parts.where("part = 'test'").exceptAll(tables.split(df, 0.3, "x").where("part = 'test'")).isEmpty()
    a = df.select(F.col("x").alias("id"), tables.hashed(24, "x").alias("a1"))
    assert {r["a1"] for r in a.collect()} <= set(range(1, 25))
    assert tables.with_attribute(df.withColumnRenamed("x", "id"), a.where("id < 50")).where("a1 is null").count() == 51


def test_recall(spark):
    truth = spark.createDataFrame([(0, r, r) for r in range(1, 5)] + [(1, r, r) for r in range(1, 5)],
                                  "q long, rank int, id long")
    result = spark.createDataFrame([(0, 1, 1), (0, 2, 9), (0, 3, 2)], "q long, rank int, id long")
    assert evaluate.recall(result, truth, 2).first()["recall"] == 0.25
    assert evaluate.recall(result, truth, 2, 3).first()["recall"] == 0.5
    assert evaluate.recall(result.limit(0), truth, 2).first()["recall"] == 0.0


def test_product_quantisation(spark, tables_, skewed):
    base, queries, g = tables_
    x, _, q, _ = skewed
    bounds = [0, 3, 8]
    book = pq.initial_codebook(base.where("id % 3 <> 0 OR id = 0"), bounds, 5)
    arrays = pq.codebook_arrays(book)
    assert [a.shape for a in arrays] == [(5, 3), (5, 5)]
    moved = pq.codebook_arrays(pq.train_step(base, book, bounds))
    codes = {r["id"]: r["data"] for r in pq.encode(base.select("id", "data"), book, bounds).collect()}
    for m in range(2):
        sub = x[:, bounds[m]:bounds[m + 1]].astype(float)
        want = ((sub[:, None] - arrays[m][None]) ** 2).sum(-1).argmin(1)
        assert [codes[i][m] for i in range(240)] == want.tolist()
        for c in range(5):
            centre = sub[want == c].mean(0) if (want == c).any() else arrays[m][c]
            assert np.allclose(moved[m][c], centre)
    table = pq.lut_array(pq.lut(book)) if bounds[1] * 2 == bounds[2] else None
    lut = np.stack([((a[:, None] - a[None]) ** 2).sum(-1) for a in arrays])
    assert np.allclose(pq.lut_array(pq.lut(book)), lut) and table is None
    coded = written(pq.encode(base.select("id", "data"), book, bounds), "codes")
    qcodes = written(pq.encode(queries.select("q", "qv"), book, bounds, "qv"), "qcodes")
    qc = {r["q"]: r["qv"] for r in qcodes.collect()}
    dist = lambda a, b: round(sum(lut[m][a[m], b[m]] for m in range(2)), 9)
    got = {(r["q"], r["id"], round(r["dist"], 6)) for r in pq.pq_knn(coded, qcodes, lut, 7).collect()}
    want = set()
    for j in range(30):
        order = sorted((dist(qc[j], codes[i]), i) for i in range(240))[:7]
        want |= {(j, i, round(d, 6)) for d, i in order}
    assert got == want
    for small in (True, False):
        near = topk(pq.pq_search(coded, g, qcodes, 0, lut, 240, 100, 2, small=small), 7)
        assert {(r["q"], r["id"], round(r["dist"], 6)) for r in near.collect()} == want
    bk, even = pq.train(base, 2, 4, 3, 8)
    assert even == [0, 4, 8] and bk.count() == 8


def test_linear_graph_building_finds_most_neighbours(spark):
    """Half of the rows are near copies of one vector, so one cell is hot and is cut into blocks."""
    x = RNG.normal(size=(600, 8)).astype("f4")
    x[::2] = x[0] + RNG.normal(scale=0.01, size=(300, 8)).astype("f4")
    base = vectors(spark, x)
    exact = graph.knn_edges(base, 8).select("id", "neighbor")
    first = graph.linear_edges(base, 8, 6, rounds=0, block_rows=100)
    assert first.groupBy("id").count().where("count > 8").isEmpty()
    better = written(graph.refine_edges(base, first, 8), "edges")
    share = [e.select("id", "neighbor").intersect(exact).count() / exact.count() for e in (first, better)]
    assert share[0] < share[1] and share[1] > 0.6
    row = better.join(base.select("id", F.col("data").alias("a")), "id").join(
        base.select(F.col("id").alias("neighbor"), F.col("data").alias("b")), "neighbor"
    ).select(F.max(F.abs(F.col("dist") - l2("a", "b"))).alias("d")).first()
    assert row["d"] < 1e-9
    capped = graph.with_reverse(exact.withColumn("dist", F.lit(1.0)), 10)
    assert capped.groupBy("id").count().agg(F.max("count")).first()[0] <= 10


def test_approximate_search_builds_its_own_index(tables_, skewed):
    base, queries, _ = tables_
    x, _, q, _ = skewed
    got = found(beam.approx_knn(base, queries, 10, r=8, l=240, w=60, t=2))
    assert got == brute(x, q, 10)


def test_permuted_vectors_tie_in_the_same_way(spark):
    """Equal values in another order: sums differ in the last bits, and every form must agree on them."""
    v = RNG.normal(size=64)
    x = np.array([RNG.permutation(v) for _ in range(40)], "f4")
    base, queries = vectors(spark, x), vectors(spark, np.zeros((1, 64), "f4"), None, "q", "qv")
    nbs = spark.createDataFrame([(i, [j for j in range(40) if j != i]) for i in range(40)], "id long, nbs array<long>")
    ranked = lambda df: [(r["id"], r["dist"]) for r in df.orderBy("rank").collect()]
    want = ranked(knn.exact_knn(base, queries, 10))
    assert ranked(knn.exact_knn(base, queries, 10, broadcast_bytes=0, block_bytes=8 * 64 * 7)) == want
    for small in (True, False):
        assert ranked(topk(search(base, nbs, queries, 0, Beam(10, 4, 2), small=small), 10)) == want


@pytest.mark.parametrize("plan", [{}, {"broadcast_bytes": 0, "block_bytes": 8 * 4 * 3}])
def test_exact_knn_with_bad_vectors(spark, plan):
    rows = [(0, [1.0] * 4), (1, [float("nan")] * 4), (2, [float("inf")] * 4), (3, None), (4, [0.5] * 4), (5, [float("nan")] * 4)]
    base = spark.createDataFrame(rows, "id long, data array<double>")
    queries = spark.createDataFrame([(0, [0.0] * 4), (1, None)], "q long, qv array<double>")
    got = knn.exact_knn(base, queries, 10, **plan).orderBy("rank").collect()
    assert [r["id"] for r in got] == [4, 0, 2, 1, 5]
    assert [r["id"] for r in knn.exact_knn(base, queries, 4, **plan).orderBy("rank").collect()] == [4, 0, 2, 1]
    pairs = base.select("id", l2_arrow("data", F.array(*[F.lit(0.0)] * 4)).alias("d"))
    assert {r["id"]: r["d"] for r in pairs.where("id IN (3, 4)").collect()} == {3: None, 4: 1.0}


def test_block_plan_has_no_join_without_a_key(tables_):
    base, queries, _ = tables_
    plan = knn.exact_knn(base, queries, 5, broadcast_bytes=0, block_bytes=8 * 8 * 50)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_many_queries_are_cut_into_many_pairs_of_blocks(spark, tables_, skewed, monkeypatch):
    """No task of a scan holds all queries; the blocks follow the cores, not the files of the base."""
    many = spark.range(knn.SCAN_ROWS + 1).select(F.col("id").alias("q"), F.array(F.lit(0.0), F.lit(1.0)).alias("qv"))
    few = spark.createDataFrame([(0, [0.0, 0.0])], "id long, data array<double>")
    assert "CoGroup" in knn.exact_knn(few, many, 1)._jdf.queryExecution().executedPlan().toString()
    base, queries, _ = tables_
    x, a1, q, qa = skewed
    monkeypatch.setattr(knn, "LEAST_ROWS", 16)
    monkeypatch.setattr(knn, "SCAN_ROWS", 0)
    assert found(knn.exact_knn(base, queries, 12)) == brute(x, q, 12)
    assert knn._block_plan(base, queries, 2, None, knn.L2(), float, 1 << 16).count() > 2 * len(q)
    assert found(knn.exact_knn(base, queries, 12, "a1")) == brute(x, q, 12, a1, qa)


def test_code_distances_by_product_or_lookup(monkeypatch):
    from nearfield.operators import blocks

    lut, q, b = RNG.random((3, 4, 4)).round(1), RNG.integers(0, 4, (30, 3)), RNG.integers(0, 4, (3000, 3))
    rows = []
    for entries in (512, 0):
        monkeypatch.setattr(blocks, "MOST_ENTRIES", entries)
        top = blocks.TopK(blocks.PQTable(lut), np.arange(30), q, 9)
        top.add(np.arange(3000), b)
        rows.append([c.tolist() for c in top.rows()])
    assert rows[0] == rows[1]


def test_hybrid_step_moves_only_matching_pairs(tables_, skewed, monkeypatch):
    """What the second hop reaches is filtered before it is deduplicated, written and joined with vectors."""
    base, queries, g = tables_
    x, a1, q, qa = skewed
    seen, counted = [], beam._counted
    monkeypatch.setattr(beam, "_counted", lambda df, *m: seen.append(counted(df, *m)) or seen[-1])
    beam.hybrid_search(base, g, queries, 5, 12, 6, fill=False, small=False)
    pairs = [df for df, _ in seen if df.columns == ["q", "id"]]
    fresh = [(r.q, r.id) for df in pairs[1::2] for r in df.collect()]
    assert fresh and all(a1[i] == qa[j] for j, i in fresh)
