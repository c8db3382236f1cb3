"""Binary and text readers: round trips over several partitions, and rejected files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.sources import text
from nearfield.sources.vecs import neighbour_lists, read_vecs

RNG = np.random.default_rng(5)


def write_vecs(path, rows, item):
    with open(path, "wb") as f:
        for r in rows:
            f.write(np.int32(len(r)).tobytes() + np.asarray(r, item).tobytes())


@pytest.mark.parametrize("kind,item", [("fvecs", "<f4"), ("bvecs", "u1"), ("ivecs", "<i4")])
def test_vecs_round_trip(spark, folder, kind, item):
    rows = RNG.integers(0, 255, (101, 12)).astype(item)
    path = f"{folder}/x.{kind}"
    write_vecs(path, rows, item)
    df = read_vecs(spark, path, kind, partition_bytes=700)
    assert df.rdd.getNumPartitions() > 1
    got = {r["id"]: r["data"] for r in df.collect()}
    assert sorted(got) == list(range(101))
    assert all(list(map(float, got[i])) == rows[i].astype(float).tolist() for i in range(101))


def test_record_range_keeps_file_positions(spark, folder):
    rows = RNG.random((50, 4)).astype("<f4")
    write_vecs(f"{folder}/x.fvecs", rows, "<f4")
    df = read_vecs(spark, f"{folder}/x.fvecs", line_offset=20, record_count=7, partition_bytes=50)
    assert sorted(r["id"] for r in df.collect()) == list(range(20, 27))


def test_mixed_dimensions_are_rejected(spark, folder):
    path = f"{folder}/x.fvecs"
    write_vecs(path, [[1.0] * 4, [1.0] * 6, [1.0] * 4, [1.0] * 2], "<f4")
    with pytest.raises(Exception, match="mixed dimension"):
        read_vecs(spark, path).collect()


def test_ivecs_ground_truth(spark, folder):
    rows = RNG.integers(0, 1000, (9, 5)).astype("<i4")
    write_vecs(f"{folder}/t.ivecs", rows, "<i4")
    got = neighbour_lists(read_vecs(spark, f"{folder}/t.ivecs", "ivecs"), 3).collect()
    assert {(r["q"], r["rank"], r["id"]) for r in got} == {
        (q, k + 1, int(rows[q, k])) for q in range(9) for k in range(3)}


@pytest.mark.parametrize("with_dist", [True, False])
def test_truth_file(spark, folder, with_dist):
    ids = RNG.integers(0, 1000, (40, 6)).astype("<u4")
    dist = RNG.random((40, 6)).astype("<f4")
    path = f"{folder}/t.bin"
    with open(path, "wb") as f:
        f.write(np.array(ids.shape, "<i4").tobytes() + ids.tobytes())
        if with_dist:
            f.write(dist.tobytes())
    got = read_vecs(spark, path, "truth", partition_bytes=100).collect()
    assert len(got) == 240
    for r in got:
        assert r["id"] == ids[r["q"], r["rank"] - 1]
        assert r["dist"] == (pytest.approx(dist[r["q"], r["rank"] - 1]) if with_dist else None)


def test_truth_file_of_wrong_size(spark, folder):
    with open(f"{folder}/t.bin", "wb") as f:
        f.write(np.array([10, 6], "<i4").tobytes() + b"\0" * 17)
    with pytest.raises(Exception, match="does not fit"):
        read_vecs(spark, f"{folder}/t.bin", "truth").collect()


def test_codes_and_blocks_at_an_offset(spark, folder):
    codes = RNG.integers(0, 256, (33, 8)).astype("u1")
    with open(f"{folder}/c.bin", "wb") as f:
        f.write(np.array(codes.shape, "<u4").tobytes() + codes.tobytes())
    got = {r["id"]: r["data"] for r in read_vecs(spark, f"{folder}/c.bin", "codes", partition_bytes=64).collect()}
    assert [got[i] for i in range(33)] == codes.tolist()

    block = RNG.random((16, 5)).astype("<f4")
    bounds = np.array([[0], [2], [5]], "<u4")
    with open(f"{folder}/p.bin", "wb") as f:
        f.write(b"\1" * 4096 + np.array(block.shape, "<u4").tobytes() + block.tobytes())
        second = f.tell()
        f.write(np.array(bounds.shape, "<u4").tobytes() + bounds.tobytes())
    first = read_vecs(spark, f"{folder}/p.bin", "fbin", offset=4096).orderBy("id").collect()
    assert np.allclose([r["data"] for r in first], block)
    ints = read_vecs(spark, f"{folder}/p.bin", "fbin", offset=second, dtype="uint32").orderBy("id")
    assert [r["data"] for r in ints.collect()] == bounds.tolist()


def test_adjacency_round_trip_and_brace_form(spark, folder):
    graph = spark.createDataFrame([(0, [1, 2]), (1, [0]), (2, [])], "id long, nbs array<long>")
    text.write_adjacency(graph, f"{folder}/g")
    assert {(r["id"], tuple(r["nbs"])) for r in text.read_adjacency(spark, f"{folder}/g").collect()} == {
        (0, (1, 2)), (1, (0,)), (2, ())}
    with open(f"{folder}/brace.csv", "w") as f:
        f.write('id,neighbor\n0,"{1,2}"\n1,"{0}"\n')
    assert {(r["id"], tuple(r["nbs"])) for r in text.read_adjacency(spark, f"{folder}/brace.csv").collect()} == {
        (0, (1, 2)), (1, (0,))}


def test_edges_vectors_codes_and_dotted_text(spark, folder):
    with open(f"{folder}/e.csv", "w") as f:
        f.write("id,neighbor\n0,1\n1,2\n")
    assert text.read_edges(spark, f"{folder}/e.csv").count() == 2
    df = spark.createDataFrame([(0, [1.5, -2.0]), (1, [0.25, 3.0])], "id long, data array<float>")
    text.write_vectors(df, f"{folder}/v")
    assert sorted(text.read_vectors(spark, f"{folder}/v").collect()) == sorted(df.collect())
    codes = spark.createDataFrame([(0, [3, 250]), (1, [7, 0])], "id long, data array<int>")
    text.write_vectors(codes, f"{folder}/c")
    assert sorted(text.read_vectors(spark, f"{folder}/c", "int").collect()) == sorted(codes.collect())
    dotted = df.select("id", F.array(F.lit(1), F.lit(-4)).alias("data"), F.lit(3).alias("a1"))
    text.write_dotted(dotted, f"{folder}/d")
    assert [(r["data"], r["a1"]) for r in text.read_dotted(spark, f"{folder}/d").collect()] == [([1.0, -4.0], 3)] * 2


def test_bulk_stream_separator(spark, folder):
    with open(f"{folder}/b.txt", "w") as f:
        f.write("0|[1,2]\n1|[3,4]\n")
    got = text.read_vectors(spark, f"{folder}/b.txt", sep="|", header=False).orderBy("id").collect()
    assert [r["data"] for r in got] == [[1.0, 2.0], [3.0, 4.0]]
