"""Binary vector files as a Spark data source: ``spark.read.format("vecs")``.

All layouts have fixed-width records after their header, so a file is cut into byte ranges that
tasks read on their own, and a row's id is its position: offset / record length.

``kind``   layout
fvecs      repeated int32 dim, dim x float32                      -> id, data
bvecs      repeated int32 dim, dim x uint8                        -> id, data
ivecs      repeated int32 dim, dim x int32 (neighbour lists)      -> id, data
truth      int32 n, int32 k, n*k uint32 ids [, n*k float32]       -> q, rank, id, dist
codes      uint32 n, uint32 m, n*m uint8                          -> id, data
fbin       at byte ``offset``: uint32 n, uint32 dim, n*dim values of ``dtype`` -> id, data
flat       n*``width`` values of ``dtype``, no header             -> id, data

Options: ``kind``, ``offset``, ``dtype`` (float32, uint32, int32, float64, uint8), ``width``, ``line_offset`` and
``record_count`` to read a range of records, ``partition_bytes`` (default 64 MB).

A path may be a folder: its files are read in order of their names, and ids go on from file to file.
``write_vecs`` writes such folders, one part per task. Paths of any scheme that Hadoop resolves to a
filesystem that Arrow knows can be read and written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

VECTORS = "id long, data array<float>"
INTEGERS = "id long, data array<int>"
LISTS = "id long, data array<long>"
DOUBLES = "id long, data array<double>"
TRUTH = "q long, rank int, id long, dist double"
BATCH_BYTES = 8 << 20

_ITEM = {"fvecs": "<f4", "bvecs": "u1", "ivecs": "<i4"}
_DTYPES = {"float32": "<f4", "uint32": "<u4", "int32": "<i4", "float64": "<f8", "uint8": "u1"}


def _filesystem(path: str):
    """The Arrow filesystem of a path (local, HDFS, object stores), and the path in it."""
    if "://" in path or path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path


def _open(path: str):
    """Random-access file."""
    fs, inner = _filesystem(path)
    return fs.open_input_file(inner)


def _files(path: str) -> list[str]:
    """The path itself, or the files of a folder in order of their names, without hidden ones."""
    fs, inner = _filesystem(path)
    if fs.get_file_info(inner).type != pyarrow.fs.FileType.Directory:
        return [path]
    found = fs.get_file_info(pyarrow.fs.FileSelector(inner))
    return [f"{path.rstrip('/')}/{f.base_name}" for f in sorted(found, key=lambda f: f.base_name) if f.is_file and f.base_name[0] not in "._"]


def resolved(spark: SparkSession, path: str) -> str:
    """The path behind a mount or another indirection of Hadoop (``viewfs://`` and the like). Of a path that
    does not exist yet the folder above is resolved."""
    if "://" not in path:
        return path
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at):
        return fs.resolvePath(at).toString()
    above = at.getParent()
    return f"{resolved(spark, above.toString()) if above else ''}/{at.getName()}"


class Layout:
    """Where the records of a file lie: ``count`` rows of ``width`` items from byte ``start``."""

    def __init__(self, path: str, kind: str, offset: int = 0, dtype: str = "float32", width: int = 0):
        self.kind, self.path = kind, path
        with _open(path) as f:
            size = f.size()
            if kind in _ITEM:
                self.item = np.dtype(_ITEM[kind])
                self.start, self.lead = 0, 4
                self.width = int(np.frombuffer(f.read_at(4, 0), "<i4")[0]) if size else 0
                self.length = 4 + self.width * self.item.itemsize
                if self.width < 0 or size % self.length:
                    raise ValueError(f"{path}: vectors of mixed dimension or a cut-off file")
                self.count = size // self.length
                return
            if kind == "flat":
                self.item, self.start, self.lead, self.width = np.dtype(_DTYPES[dtype]), offset, 0, width
                self.length = width * self.item.itemsize
                if width < 1 or (size - offset) % self.length:
                    raise ValueError(f"{path}: {size - offset} bytes are no rows of {width} values")
                self.count = (size - offset) // self.length
                return
            at = offset if kind == "fbin" else 0
            n, width = (int(x) for x in np.frombuffer(f.read_at(8, at), "<u4"))
            self.count, self.width, self.start, self.lead = n, width, at + 8, 0
            if kind == "truth":
                self.item = np.dtype("<u4")
                ids = 4 * n * width
                if size not in (8 + ids, 8 + 2 * ids):
                    raise ValueError(f"{path}: size {size} does not fit {n} x {width} neighbours")
                self.dists = 8 + ids if size == 8 + 2 * ids else None
            elif kind == "codes":
                self.item = np.dtype("u1")
                if size != 8 + n * width:
                    raise ValueError(f"{path}: size {size} does not fit {n} x {width} codes")
            elif kind == "fbin":
                self.item = np.dtype(_DTYPES[dtype])
                if size < self.start + n * width * self.item.itemsize:
                    raise ValueError(f"{path}: block of {n} x {width} exceeds the file")
            else:
                raise ValueError(f"unknown kind {kind!r}")
            self.length = width * self.item.itemsize

    def read(self, f, first: int, rows: int) -> np.ndarray:
        raw = f.read_at(rows * self.length, self.start + first * self.length)
        if not self.lead:
            return np.frombuffer(raw, self.item).reshape(rows, self.width)
        table = np.frombuffer(raw, np.uint8).reshape(rows, self.length)
        dims = np.ascontiguousarray(table[:, :4]).view("<i4")
        if (dims != self.width).any():
            raise ValueError("vectors of mixed dimension")
        return np.ascontiguousarray(table[:, 4:]).view(self.item)


class Range(InputPartition):
    """Rows ``first`` to ``first + rows`` of a file whose first row has the id ``base``."""

    def __init__(self, layout: Layout, base: int, first: int, rows: int):
        self.layout, self.base, self.first, self.rows = layout, base, first, rows


class VecsReader(DataSourceReader):
    def __init__(self, options, value_type: str):
        self.value_type = value_type
        self.layouts = [
            Layout(path, options.get("kind", "fvecs"), int(options.get("offset", 0)), options.get("dtype", "float32"), int(options.get("width", 0)))
            for path in _files(options["path"])]
        total = sum(lay.count for lay in self.layouts)
        if len({lay.width for lay in self.layouts if lay.count}) > 1:
            raise ValueError(f"{options['path']}: files of mixed dimension")
        self.first = int(options.get("line_offset", 0))
        wanted = int(options.get("record_count", -1))
        left = max(0, total - self.first)
        self.rows = left if wanted < 0 else min(left, wanted)
        self.partition_bytes = int(options.get("partition_bytes", 64 << 20))

    def partitions(self) -> list[InputPartition]:
        out, base, end = [], 0, self.first + self.rows
        for lay in self.layouts:
            step = max(1, self.partition_bytes // max(1, lay.length))
            lo, hi = max(self.first, base), min(end, base + lay.count)
            out += [Range(lay, base, at - base, min(step, hi - at)) for at in range(lo, hi, step)]
            base += lay.count
        return out or [Range(None, 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        lay = partition.layout
        if lay is None:
            return
        step = max(1, BATCH_BYTES // max(1, lay.length))
        end = partition.first + partition.rows
        with _open(lay.path) as f:
            for at in range(partition.first, end, step):
                n = min(step, end - at)
                make = self._truth if lay.kind == "truth" else self._vectors
                yield make(lay, f, partition.base, at, n)

    def _vectors(self, lay: Layout, f, base: int, at: int, n: int) -> pa.RecordBatch:
        values = lay.read(f, at, n).reshape(-1).astype(self.value_type)
        offsets = np.arange(0, n * lay.width + 1, max(1, lay.width), dtype=np.int32)
        data = pa.ListArray.from_arrays(pa.array(offsets[: n + 1]), pa.array(values))
        return pa.RecordBatch.from_arrays([pa.array(np.arange(base + at, base + at + n)), data], ["id", "data"])

    def _truth(self, lay: Layout, f, base: int, at: int, n: int) -> pa.RecordBatch:
        k = lay.width
        ids = lay.read(f, at, n).reshape(-1).astype(np.int64)
        if lay.dists is None:
            dist = pa.nulls(n * k, pa.float64())
        else:
            raw = f.read_at(4 * n * k, lay.dists + 4 * at * k)
            dist = pa.array(np.frombuffer(raw, "<f4").astype(np.float64))
        q = np.repeat(np.arange(base + at, base + at + n), k)
        rank = np.tile(np.arange(1, k + 1, dtype=np.int32), n)
        return pa.RecordBatch.from_arrays(
            [pa.array(q), pa.array(rank), pa.array(ids), dist], ["q", "rank", "id", "dist"])


class Part(WriterCommitMessage):
    """A part written by a task: where, its final name, rows and their width."""

    def __init__(self, temporary: str, name: str, rows: int, width: int):
        self.temporary, self.name, self.rows, self.width = temporary, name, rows, width


class VecsWriter(DataSourceArrowWriter):
    """One part per task, in a hidden folder until all are there; the commit moves them to their places.

    A part that begins with its number of rows is held by its task until it is complete.
    """

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.kind, self.dtype = options.get("kind", "fvecs"), options.get("dtype", "float32")
        if self.kind not in (*_ITEM, "truth", "codes", "fbin", "flat"):
            raise ValueError(f"unknown kind {self.kind!r}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        task = TaskContext.get()
        fs, folder = _filesystem(self.path)
        name = f"part-{task.partitionId():05d}.{self.kind}"
        temporary = f"{folder}/_temporary/{name}.{task.taskAttemptId()}"
        fs.create_dir(f"{folder}/_temporary", recursive=True)
        item = np.dtype({"codes": "u1", "truth": "<u4"}.get(self.kind) or _ITEM.get(self.kind) or _DTYPES[self.dtype])
        headed = self.kind in ("truth", "codes", "fbin")
        width, rows, held, more = -1, 0, [], []
        with fs.open_output_stream(temporary) as out:
            for batch in iterator:
                if not len(batch):
                    continue
                data = batch.column("data")
                sizes = set(pa.compute.list_value_length(data).to_pylist())
                if len(sizes) > 1 or None in sizes or data.flatten().null_count or width not in (-1, *sizes):
                    raise ValueError("vectors of mixed dimension, or without a value")
                width, rows = sizes.pop(), rows + len(batch)
                values = np.ascontiguousarray(data.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(item))
                if self.kind in _ITEM:
                    lead = np.full((len(values), 1), width, "<i4")
                    out.write(np.concatenate([lead.view(np.uint8), values.view(np.uint8).reshape(len(values), -1)], 1).tobytes())
                elif headed:
                    held.append(values.tobytes())
                else:
                    out.write(values.tobytes())
                if self.kind == "truth" and "dist" in batch.schema.names:
                    more.append(batch.column("dist").flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes())
            if headed:
                out.write(np.array([rows, max(width, 0)], "<u4").tobytes() + b"".join(held + more))
        return Part(temporary, name, rows, width)

    def commit(self, messages: list[Part | None]) -> None:
        fs, folder = _filesystem(self.path)
        parts = [m for m in messages if m is not None and m.rows]
        if len({m.width for m in parts}) > 1:
            raise ValueError("vectors of mixed dimension")
        old = fs.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True))
        old = [f.path for f in old if f.is_file and f.base_name[0] not in "._"]
        if old and not self.overwrite:
            raise ValueError(f"{self.path} has files already")
        for path in old:
            fs.delete_file(path)
        for m in parts:
            fs.move(m.temporary, f"{folder}/{m.name}")
        self._sweep(fs, folder)
        with fs.open_output_stream(f"{folder}/_SUCCESS"):
            pass

    def abort(self, messages: list[Part | None]) -> None:
        fs, folder = _filesystem(self.path)
        self._sweep(fs, folder)

    def _sweep(self, fs, folder: str) -> None:
        if fs.get_file_info(f"{folder}/_temporary").type == pyarrow.fs.FileType.Directory:
            fs.delete_dir(f"{folder}/_temporary")


class VecsDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vecs"

    def schema(self) -> str:
        kind = self.options.get("kind", "fvecs")
        if kind == "truth":
            return TRUTH
        if kind == "codes":
            return INTEGERS
        if kind == "flat" and self.options.get("dtype") == "float64":
            return DOUBLES
        if kind == "ivecs" or (kind == "fbin" and "int" in self.options.get("dtype", "")):
            return LISTS
        return VECTORS

    def reader(self, schema) -> VecsReader:
        kinds = {VECTORS: "float32", DOUBLES: "float64", INTEGERS: "int32", LISTS: "int64", TRUTH: "int64"}
        return VecsReader(self.options, kinds[self.schema()])

    def writer(self, schema, overwrite: bool) -> VecsWriter:
        return VecsWriter(self.options, overwrite)


def read_vecs(spark: SparkSession, path: str, kind: str = "fvecs", **options) -> DataFrame:
    """Read a binary vector file; see the module text for kinds and options."""
    spark.dataSource.register(VecsDataSource)
    reader = spark.read.format("vecs").option("kind", kind)
    for key, value in options.items():
        reader = reader.option(key, str(value))
    return reader.load(resolved(spark, path))


def write_vecs(df: DataFrame, path: str, kind: str = "fvecs", dtype: str = "float32", overwrite: bool = False) -> None:
    """Write ``(id, data)``, for ``kind="truth"`` ``(q, rank, id[, dist])``, as a folder of binary files.

    Rows are dealt out by ranges of their id and sorted, so their positions follow the ids; ids that
    are dense from 0 come back as they were. All vectors must have the same length and no nulls.
    """
    spark = df.sparkSession
    spark.dataSource.register(VecsDataSource)
    if kind == "truth":
        fields = ["rank", "id", *(["dist"] if "dist" in df.columns else [])]
        lists = df.groupBy("q").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("near"))  # k entries per query
        df = lists.select(F.col("q").alias("id"), F.col("near.id").alias("data"), *([F.col("near.dist").alias("dist")] if "dist" in fields else []))
    else:
        df = df.select("id", "data")
    rows = df.repartitionByRange("id").sortWithinPartitions("id")
    mode = "overwrite" if overwrite else "append"
    rows.write.format("vecs").option("kind", kind).option("dtype", dtype).mode(mode).save(resolved(spark, path))


#: Where the three blocks of a pivots file begin: centroids, mean, borders of the subspaces.
PIVOT_BLOCKS = (4096, 987144, 990992)


def read_pivots(spark: SparkSession, path: str, blocks: tuple[int, int, int] = PIVOT_BLOCKS) -> tuple[DataFrame, list[int], list[float]]:
    """A codebook ``(m, c, centroid)``, the borders of its subspaces and the mean to subtract, from a file
    that holds whole centroids, the mean and the borders in blocks at three places."""
    whole, centre, cut = (
        read_vecs(spark, path, "fbin", offset=at, dtype=kind) for at, kind in zip(blocks, ("float32", "float32", "uint32"), strict=True))
    mean = [float(x) for r in centre.orderBy("id").collect() for x in r["data"]]
    bounds = [int(x) for r in cut.orderBy("id").collect() for x in r["data"]]
    parts = F.array(*[F.struct(F.lit(m).alias("m"), F.slice("data", s + 1, e - s).cast("array<double>").alias("centroid"))
                      for m, (s, e) in enumerate(zip(bounds, bounds[1:]))])
    return whole.select(F.col("id").cast("int").alias("c"), F.inline(parts)).select("m", "c", "centroid"), bounds, mean


def write_pivots(spark: SparkSession, path: str, book: list[np.ndarray], bounds: list[int], mean: list[float], blocks: tuple[int, int, int] = PIVOT_BLOCKS) -> None:
    """The same file, from a codebook of one array (centroids x length) per subspace."""
    parts = [(np.concatenate(book, 1), "<f4"), (np.array(mean)[:, None], "<f4"), (np.array(bounds)[:, None], "<u4")]
    data = bytearray()
    for at, (values, kind) in zip(blocks, parts, strict=True):
        if len(data) > at:
            raise ValueError("blocks overlap")
        data += bytes(at - len(data)) + np.array(values.shape, "<u4").tobytes() + values.astype(kind).tobytes()
    fs, inner = _filesystem(resolved(spark, path))
    with fs.open_output_stream(inner) as out:
        out.write(bytes(data))


def write_table(lut: DataFrame, path: str, dtype: str = "float32") -> None:
    """A distance table ``(m, c1, c2, d2)`` as a flat array without a header, in order of m, c1, c2."""
    size = lut.agg(F.max("c1") + 1).first()[0]
    rows = lut.groupBy("m", "c1").agg(F.array_sort(F.collect_list(F.struct("c2", "d2"))).alias("row"))
    write_vecs(rows.select((F.col("m").cast("long") * size + F.col("c1")).alias("id"), F.col("row.d2").alias("data")), path, "flat", dtype)


def read_table(spark: SparkSession, path: str, size: int, dtype: str = "float32") -> DataFrame:
    """A flat distance table of ``size`` codes per subspace -> ``(m, c1, c2, d2)``."""
    rows = read_vecs(spark, path, "flat", dtype=dtype, width=size)
    return rows.select(
        F.floor(F.col("id") / size).cast("int").alias("m"), F.pmod("id", F.lit(size)).cast("int").alias("c1"),
        F.posexplode("data").alias("c2", "d2"))


def neighbour_lists(df: DataFrame, k: int) -> DataFrame:
    """Rows of an ivecs file as ground truth (q, rank, id), the first ``k`` of each."""
    first = F.slice("data", 1, k)
    return df.select(F.col("id").alias("q"), F.posexplode(first).alias("pos", "id")).select(
        "q", (F.col("pos") + 1).alias("rank"), "id")
