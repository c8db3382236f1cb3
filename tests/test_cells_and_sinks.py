"""Cells and the index on them, stored tables, NOT IN with nulls, binary sinks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import beam, beam_cte, cells, evaluate, graph, knn, pq, steps
from nearfield.session import written
from nearfield.sources import vecs

RNG = np.random.default_rng(21)


def vectors(spark, x, id="id", vec="data"):
    return spark.createDataFrame([(i, None if r is None else [float(v) for v in r]) for i, r in enumerate(x)], f"{id} long, {vec} array<float>")


@pytest.fixture(scope="module")
def clustered():
    """Clusters, and a third of the rows copies of one vector."""
    centres = RNG.normal(size=(20, 8))
    x = (centres[RNG.integers(0, 20, 900)] + RNG.normal(scale=0.15, size=(900, 8))).astype("f4")
    x[::3] = x[0]
    return x


@pytest.fixture(scope="module")
def base(spark, clustered):
    return vectors(spark, clustered)


def brute(x, q, k):
    d = ((q[:, None, :].astype(float) - x[None].astype(float)) ** 2).sum(2)
    return {(j, int(i)) for j in range(len(q)) for i in np.lexsort((np.arange(len(x)), d[j]))[:k]}


def test_every_row_has_its_nearest_cell(spark, base, clustered, monkeypatch):
    monkeypatch.setattr(cells, "GROUP_ROWS", 50)  # the copies' coarse cell is dealt out
    index = cells.fit(base, 16)
    placed = {r.id: r.cell for r in cells.place(base, index, 1, len(index.coarse)).collect()}
    fine = [(r.c1 * index.width + r.c2, np.array(r.centroid)) for r in index.fine.collect()]
    assert sorted(placed) == list(range(900)) and len({c for c, _ in fine}) == len(fine)
    for i, cell in placed.items():
        d = {c: ((clustered[i].astype(float) - v) ** 2).sum() for c, v in fine}
        assert np.isclose(d[cell], min(d.values()), atol=1e-6)
    several = cells.place(base, index, 3, 3).groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("cell").alias("d"))
    assert several.where("n <> d OR n > 3").isEmpty() and several.count() == 900


def test_cell_index(spark, base, clustered):
    index = cells.build(base, 25)
    assert index.table(spark).count() == 900
    q = np.concatenate([clustered[1:200:2], RNG.normal(size=(20, 8))]).astype("f4")
    queries = vectors(spark, q, "q", "qv")
    truth = brute(clustered, q, 5)
    for nprobe, least in ((len(index.cells.coarse) * index.cells.width, 1.0), (6, 0.9)):
        got = cells.search(index, queries, 5, nprobe).collect()
        assert len({(r.q, r.id) for r in got}) == len(got) <= 5 * len(q)
        assert len({(r.q, r.id) for r in got} & truth) >= least * len(truth)
        assert all(abs(r.dist - np.linalg.norm(clustered[r.id].astype(float) - q[r.q].astype(float))) < 1e-9 for r in got)
    few = cells.search(index, queries.where("q = 0"), 5, 1)._jdf.queryExecution().executedPlan().toString()
    assert any("c1#" in part.split("]")[0] for part in few.split("PartitionFilters: [")[1:])


def test_many_probes_move_a_query_once_per_block(spark, base, clustered, monkeypatch):
    """The same rows as cell by cell, without a row per query and probed cell."""
    index = cells.build(base, 25)
    queries = vectors(spark, np.concatenate([clustered[1:200:4], RNG.normal(size=(20, 8))]).astype("f4"), "q", "qv")
    placed, place = [], cells.place
    monkeypatch.setattr(cells, "place", lambda *a: placed.append(a) or place(*a))
    rows = lambda df: {(r.q, r.rank, r.id, round(r.dist, 9)) for r in df.collect()}
    want = rows(cells.search(index, queries, 5, 6))
    exact = rows(knn.exact_knn(base, queries, 5))
    assert len(placed) == 1 and want != exact
    monkeypatch.setattr(cells, "MOST_PROBES", 2)
    assert rows(cells.search(index, queries, 5, 6)) == want
    assert rows(cells.search(index, queries, 5, 99)) == exact and len(placed) == 1


def test_index_of_odd_tables(spark):
    one = vectors(spark, [[1.0, 2.0], None])
    index = cells.build(one, 9)
    assert [(r.q, r.id) for r in cells.search(index, vectors(spark, [[0.0, 0.0], None], "q", "qv"), 3).collect()] == [(0, 0)]
    same = vectors(spark, [[1.0, 1.0]] * 40)
    assert cells.search(cells.build(same, 9), vectors(spark, [[0.0, 0.0]], "q", "qv"), 50, 99).count() == 40
    with pytest.raises(ValueError, match="no vectors"):
        cells.build(one.where("id > 5"), 4)


def test_linear_graph(spark, base):
    exact = graph.knn_edges(base, 6)
    edges = written(graph.linear_edges(base, 6, 25, block_rows=120), "edges")
    assert edges.groupBy("id").count().where("count <> 6").isEmpty()
    # Copies have more equally near neighbours than places, so distances are compared, not ids.
    want = exact.groupBy("id").agg(F.max("dist").alias("far"))
    assert edges.join(want, "id").where("dist <= far + 1e-9").count() >= 0.95 * edges.count()
    table = graph.knn_graph(base, 6, cells=25)
    assert table.count() == 900


def test_linear_graph_reaches_the_recall_asked_for(spark):
    """Vectors without structure, of which two rounds of descent find too few neighbours."""
    x = np.random.default_rng(5).normal(size=(3000, 48)).astype("f4")
    loose = written(vectors(spark, x), "loose")
    exact = written(graph.knn_edges(loose, 6).select("id", "neighbor"), "exact")
    share = lambda edges: edges.select("id", "neighbor").join(exact, ["id", "neighbor"], "left_semi").count() / exact.count()
    edges = written(graph.linear_edges(loose, 6, 93, recall=0.92), "edges")
    assert share(edges) >= 0.9 and edges.groupBy("id").count().where("count <> 6").isEmpty()
    assert abs(graph.found_share(loose, edges, 6) - share(edges)) < 0.03
    assert share(graph.linear_edges(loose, 6, 2, recall=1.1)) == 1


def test_cells_are_judged_before_rows_are_compared(spark, monkeypatch):
    """Rows of blocks are compared once, however often there are too few cells; the share of the edges is known before."""
    x = np.random.default_rng(6).normal(size=(1200, 16)).astype("f4")
    x[::40] = x[0]
    loose = written(vectors(spark, x).withColumn("data", F.when(F.col("id") != 9, F.col("data"))), "loose")
    made, shares = [], []
    monkeypatch.setattr(graph, "written", lambda df, name, f=graph.written: (made.append(name), f(df, name))[1])
    monkeypatch.setattr(graph, "met_share", lambda checked, placed, f=graph.met_share: (shares.append(f(checked, placed)), shares[-1])[1])
    edges = graph.linear_edges(loose, 6, 60, recall=0.9, overlap=1)
    assert made.count("edges") == 1 and made.count("blocks") == len(shares) > 1 and sorted(shares) == shares
    assert shares[-1] >= 0.9 > shares[-2] and graph.found_share(loose, edges, 6) == shares[-1]
    monkeypatch.setattr(graph, "BLOCK_BYTES", 0)  # blocks in a grid
    again = graph.linear_edges(loose, 6, 60, recall=0.9, overlap=1)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, edges.collect()))


def test_descent_tries_only_pairs_with_a_fresh_link(spark, base):
    edges = written(graph.knn_edges(base, 4).drop("rank"), "edges")
    settled = graph.refine_edges(base, edges.withColumn("fresh", F.lit(False)), 4)
    assert settled.where("fresh").isEmpty()


def test_stored_tables_are_not_shuffled(spark, base):
    """Above the scan of the stored base there is no exchange, whatever the step asks for."""
    table = written(graph.knn_graph(base, 4), "graph")
    beam.drop_stored(spark, "plan")
    at = beam.store(base, table, "plan", 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for stored, key in ((at.base, "data"), (at.graph, "nbs")):
            asked = spark.range(2000).select(F.pmod("id", F.lit(900)).alias("id"), F.col("id").alias("q"))
            plan = stored.join(asked, "id").select("q", "id", key)._jdf.queryExecution().executedPlan().toString().split("\n")
            depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
            scan = next(n for n, line in enumerate(plan) if "FileScan parquet" in line)
            above, level = [], depth(plan[scan])
            for line in reversed(plan[:scan]):
                if depth(line) < level:
                    above.append(line)
                    level = depth(line)
            assert not any("Exchange" in line for line in above) and "Bucketed: true" in plan[scan]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    queries = base.select(F.col("id").alias("q"), F.col("data").alias("qv")).where("q % 50 = 0")
    want = {tuple(r) for r in beam.two_phase_search(base, table, queries, 3, 12, 5, 4, 2, small=True).collect()}
    assert {tuple(r) for r in beam.two_phase_search(at.base, at.graph, queries, 3, 12, 5, 4, 2, small=False).collect()} == want
    beam.drop_stored(spark, "plan")


@pytest.mark.parametrize("listed", [[], [(1, 2)], [(1, None)], [(None, 2)], [(1, None), (None, 2), (3, 3)], [(None, None)], [(2, 2), (3, None)]])
def test_not_in_follows_the_rule_for_nulls(spark, listed):
    import duckdb

    rows = [(a, b) for a in (1, 2, 3, None) for b in (1, 2, 3, None)]
    L = spark.createDataFrame([(*r, float(n)) for n, r in enumerate(rows)], "q long, id long, dist double")
    V = spark.createDataFrame(listed, "q long, id long")
    con = duckdb.connect()
    con.execute("CREATE TABLE l(q BIGINT, id BIGINT, dist DOUBLE); CREATE TABLE v(q BIGINT, id BIGINT)")
    con.executemany("INSERT INTO l VALUES (?, ?, ?)", [(*r, float(n)) for n, r in enumerate(rows)])
    if listed:
        con.executemany("INSERT INTO v VALUES (?, ?)", listed)
    # the definition, row by row: differ in a known column from every listed row
    want = con.execute("""SELECT * FROM l WHERE NOT EXISTS (
        SELECT 1 FROM v WHERE coalesce(l.q = v.q, true) AND coalesce(l.id = v.id, true)) ORDER BY dist""").fetchall()
    got = steps.unvisited_not_in(L, V)
    assert [tuple(r) for r in got.orderBy("dist").collect()] == want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_hybrid_answers_are_whole(spark, base, clustered):
    tagged = base.withColumn("a1", F.pmod(F.xxhash64("id"), F.lit(30)))
    queries = tagged.where("id < 60").select(F.col("id").alias("q"), F.col("data").alias("qv"), "a1")
    table = written(graph.knn_graph(base, 4), "graph")
    due = tagged.groupBy("a1").agg(F.least(F.count("*"), F.lit(12)).alias("due"))
    got = written(beam.hybrid_search(tagged, table, queries, 0, 15, 12), "hybrid")
    counts = queries.join(due, "a1").join(got.groupBy("q").count(), "q", "left")
    assert counts.where("coalesce(count, 0) <> due").isEmpty()
    truth = knn.filtered_knn(tagged, queries, 12)
    assert evaluate.recall(got, truth, 12).first().recall <= 1
    assert got.count() > beam.hybrid_search(tagged, table, queries, 0, 15, 12, fill=False).count()


def test_recursive_form_with_a_hub_and_many_steps(spark):
    """A vertex with 5,000 neighbours in one row, and a path longer than Spark's default of 100 rounds."""
    hub = spark.range(5001).select("id", F.array(F.col("id").cast("float"), F.lit(0.0).cast("float")).alias("data"))
    star = spark.range(1, 5001).select(F.lit(0).cast("long").alias("id"), F.col("id").alias("neighbor"))
    query = spark.createDataFrame([(0, [4000.0, 0.0])], "q long, qv array<float>")
    walk = beam_cte.beam_search_cte(beam_cte.neighbour_payload(hub, star), hub, query, 0, 5)
    assert {r.id for r in beam_cte.last_step(walk, 5).collect()} == {3998, 3999, 4000, 4001, 4002}
    path = hub.where("id < 130")
    chain = spark.range(129).select("id", (F.col("id") + 1).alias("neighbor"))
    walk = beam_cte.beam_search_cte(beam_cte.neighbour_payload(path, chain), path, query, 0, 1)
    assert [r.id for r in beam_cte.last_step(walk, 1).collect()] == [129]


@pytest.mark.parametrize(("kind", "dtype"), [("fvecs", "float32"), ("bvecs", "uint8"), ("ivecs", "int32"), ("codes", "uint8"), ("fbin", "float32"), ("flat", "float64")])
def test_folders_of_parts(spark, folder, kind, dtype):
    """Ids go on from part to part, ranges cross parts, empty tasks leave no part."""
    x = RNG.integers(0, 255, (300, 7))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, data array<float>").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    vecs.write_vecs(df, f"{folder}/out", kind, dtype)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    import os

    parts = [f for f in os.listdir(f"{folder}/out") if f[0] not in "._"]
    assert len(parts) > 1 and sorted(f for f in os.listdir(f"{folder}/out") if f[0] == "_") == ["_SUCCESS"]
    options = {"dtype": dtype, "width": 7} if kind in ("fbin", "flat") else {}
    got = {r.id: list(r.data) for r in vecs.read_vecs(spark, f"{folder}/out", kind, partition_bytes=200, **options).collect()}
    assert got == {i: r.tolist() for i, r in enumerate(x)}
    some = vecs.read_vecs(spark, f"{folder}/out", kind, line_offset=20, record_count=211, **options)
    assert sorted(r.id for r in some.collect()) == list(range(20, 231))
    with pytest.raises(Exception, match="files already"):
        vecs.write_vecs(df, f"{folder}/out", kind, dtype)
    vecs.write_vecs(df.where("id < 10"), f"{folder}/out", kind, dtype, overwrite=True)
    assert vecs.read_vecs(spark, f"{folder}/out", kind, **options).count() == 10
    vecs.write_vecs(df.limit(0), f"{folder}/none", kind, dtype)
    assert vecs.read_vecs(spark, f"{folder}/none", kind, **options).count() == 0


def test_bad_vectors_are_not_written(spark, folder):
    for n, rows in enumerate(([(0, [1.0]), (1, [1.0, 2.0])], [(0, [1.0]), (1, None)], [(0, [1.0, None])])):
        df = spark.createDataFrame(rows, "id long, data array<float>").coalesce(1)
        with pytest.raises(Exception, match="mixed dimension"):
            vecs.write_vecs(df, f"{folder}/bad{n}")
        import os

        assert not os.path.exists(f"{folder}/bad{n}/_temporary") and not os.path.exists(f"{folder}/bad{n}/_SUCCESS")


def test_paths_behind_a_mount(spark, folder):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.vecs.link./in", f"file://{folder}")
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "id long, data array<float>")
    vecs.write_vecs(df, "viewfs://vecs/in/out")
    assert {r.id: r.data for r in vecs.read_vecs(spark, "viewfs://vecs/in/out").collect()} == {0: [1.0, 2.0], 1: [3.0, 4.0]}


def test_pivots_and_flat_tables(spark, folder):
    book = [RNG.random((16, n)) for n in (3, 5, 2)]
    mean = RNG.random(10).tolist()
    vecs.write_pivots(spark, f"{folder}/pivots.bin", book, [0, 3, 8, 10], mean)
    got, bounds, centre = vecs.read_pivots(spark, f"{folder}/pivots.bin")
    assert bounds == [0, 3, 8, 10] and np.allclose(centre, mean)
    assert all(np.allclose(a, b) for a, b in zip(pq.codebook_arrays(got), book, strict=True))
    with pytest.raises(ValueError, match="overlap"):
        vecs.write_pivots(spark, f"{folder}/tight.bin", book, [0, 3, 8, 10], mean, (0, 20, 2000))
    lut = pq.lut(got)
    vecs.write_table(lut, f"{folder}/lut")
    flat = np.concatenate([np.fromfile(p, "<f4") for p in vecs._files(f"{folder}/lut")])
    assert np.allclose(flat.reshape(3, 16, 16), pq.lut_array(lut), atol=1e-6)
    assert np.allclose(pq.lut_array(vecs.read_table(spark, f"{folder}/lut", 16)), pq.lut_array(lut), atol=1e-6)
