"""Near-duplicate documents by SimHash and a generalised pigeonhole search.

Fingerprint bits that vary together form a partition. Two fingerprints within ``radius`` bits must,
for any thresholds ``t_i >= -1`` that add up to ``radius - partitions + 1``, be within ``t_i`` bits
in at least one partition ``i``. Every distinct fingerprint gets its own thresholds: those for which
dynamic programming over the partitions finds the fewest estimated candidates. It probes an index
of all fingerprints by partition value, and candidates are verified.

A fingerprint that expects many candidates under every choice lies in a crowd of near copies. For
an even radius such fingerprints are linked through all points within ``radius / 2`` bits instead:
two of them share such a point if and only if they are within the radius. That is exact, and linear
where pairs would be quadratic.

For an odd radius no such point lies in the middle. There the bits are cut into ``radius + 3`` blocks, of
which two fingerprints within the radius agree in at least three. Every fingerprint is dealt out under
each choice of three blocks, and the tasks compare what agrees in all of them. A bucket gives no more
links than it has fingerprints, and no pair of it becomes a row. Of buckets too large for that only
fingerprints outside the main component are compared again, in a grid.

Near copies may differ in more bits than the radius. ``representatives`` therefore also joins groups whose
texts agree in a band of MinHash values of their shingles, before it compares texts. There are as many bands
as it takes to miss a pair with no more than a chance of ``MISSED``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, row_key, unused, written
from .components import components

BITS = 64
#: Estimated candidates from which a fingerprint counts as part of a crowd.
CROWD = 256
#: Cost of one index probe in candidates.
PROBE = 0.2
#: Fingerprints of a bucket that are compared with each other in one go, for an odd radius.
BUCKET = 2048
#: Rows of whole buckets compared at a time.
BUCKET_ROWS = 1 << 17
#: MinHash values of a band, and the chance that a pair of just the similarity asked for agrees in no band.
BAND_ROWS, MISSED = 5, 1e-11
#: Shingles hashed at a time, so that their hashes stay in the cache.
SHINGLE_ROWS = 512



def fingerprint(text: str, width: int = 3, seed: int = 42, damped: bool = False) -> int:
    """SimHash of the word shingles: bit set where over half of the shingle hashes have it set.

    Every occurrence counts, or with ``damped`` a shingle of ``n`` occurrences counts ``1 + log2 n``
    times, so that common words don't decide the fingerprints of long texts.
    """
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate([[0], stop[:-1] + 1])
    last = min(width, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], seed) for a, b in zip(start.tolist(), stop[last:].tolist())]  # noqa: B905
    hashes, weights = np.array(hashes, "<u8"), None
    if damped:
        hashes, n = np.unique(hashes, return_counts=True)
        weights = 1 + np.log2(n)
    votes = np.zeros(BITS)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at: at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(0, dtype=np.int64) if weights is None else weights[at: at + (1 << 16)] @ bits
    total = len(hashes) if weights is None else weights.sum()
    return int(np.packbits(votes * 2 > total, bitorder="little").view("<u8")[0])


def _fingerprints(width: int, seed: int, damped: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, width, seed, damped) for t in batch.column("text").to_pylist()], np.uint64)
            others = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, others), pa.array(fp.view(np.int64))], names=[*others, "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, damped: bool = False, text_key: bool = False) -> DataFrame:
    """``doc_id, row_key, fp`` (the fingerprint's bits as a long) of every row; null text is empty.

    With ``text_key`` also a hash of the text alone."""
    rows = documents(docs, row_key().alias("row_key"))
    if text_key:
        rows = rows.withColumn("text_key", F.xxhash64("text"))
    schema = "doc_id long, " + "".join(f"{c} long, " for c in rows.columns[2:]) + "fp long"
    return rows.mapInArrow(_fingerprints(width, seed, damped), schema)


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((BITS, BITS), np.int64)
    for batch in batches:
        x = _bits(batch.column("fp").to_numpy()).astype(np.float32)
        total += (x.T @ x).astype(np.int64)
    yield pa.RecordBatch.from_pydict({"cell": np.arange(BITS * BITS), "n": total.ravel()})


def correlated_partitions(moments: np.ndarray, n: int, parts: int) -> tuple[list[list[int]], np.ndarray]:
    """Bits grouped greedily by absolute correlation into ``parts`` partitions, and each bit's share of ones."""
    share = np.diag(moments) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    link = np.abs(moments / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(link, 0)
    free, out = list(range(BITS)), []
    for k in range(parts):
        size = -(-len(free) // (parts - k))
        group = [max(free, key=lambda b: link[b, free].sum())]
        while len(group) < size:
            group.append(max((b for b in free if b not in group), key=lambda b: link[b, group].sum()))
        free = [b for b in free if b not in group]
        out.append(sorted(group))
    return out, share


def _value(bits: list[int]) -> Column:
    """The value of a partition: its bits of ``fp``, put side by side."""
    out = F.lit(0).cast("long")
    for place, bit in enumerate(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.col("fp"), bit).bitwiseAND(F.lit(1)), place))
    return out


def allocate(cost: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds per row and partition that minimise the summed cost, by dynamic programming.

    ``cost[row, partition, t + 1]`` is the cost of threshold ``t``, from -1 (not probed) to the
    radius. The thresholds of a row add up to ``radius - partitions + 1``.
    """
    rows, parts, choices = cost.shape
    budget = radius + 1  # the thresholds plus one add up to this
    best = np.full((rows, budget + 1), np.inf)
    best[:, 0] = 0
    chosen = np.zeros((rows, parts, budget + 1), np.int8)
    for i in range(parts):
        fresh = np.full_like(best, np.inf)
        for used in range(budget + 1):
            for c in range(min(choices - 1, used) + 1):
                value = best[:, used - c] + cost[:, i, c]
                better = value < fresh[:, used]
                fresh[better, used] = value[better]
                chosen[better, i, used] = c
        best = fresh
    picks, left = np.zeros((rows, parts), np.int8), np.full(rows, budget)
    for i in reversed(range(parts)):
        picks[:, i] = chosen[np.arange(rows), i, left]
        left = left - picks[:, i]
    return picks - 1, best[:, budget]


def _flips(bits: int, distance: int) -> np.ndarray:
    """All patterns of exactly ``distance`` ones within ``bits`` places."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(bits), distance)], np.uint64).view(np.int64)


def _probes(groups: list[list[int]], share: np.ndarray, total: int, radius: int, crowd: float):
    """Rows ``(part, value, fp)`` for every index probe; a fingerprint of a crowd gives one row with part -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = [[_flips(len(g), t) for t in range(radius + 1)] for g in groups]
        p = np.clip(share, 1e-6, 1 - 1e-6)
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            bits = _bits(fp)
            cost = np.zeros((len(fp), len(groups), radius + 2))
            for i, g in enumerate(groups):
                mine = bits[:, g]
                here = np.where(mine, p[g], 1 - p[g])
                odds = (1 - here) / here
                # Distance 0 is counted in the index; beyond, bits count as independent. The sums over
                # all choices of 1, 2, ... flipped bits are elementary symmetric polynomials.
                shells = np.zeros((len(fp), radius + 1))
                shells[:, 0] = 1
                for b in range(len(g)):
                    for t in range(radius, 0, -1):
                        shells[:, t] += shells[:, t - 1] * odds[:, b]
                expected = total * np.exp(np.log(here).sum(1))[:, None] * shells
                expected[:, 0] = batch.column(f"n{i}").to_numpy()
                probes = np.array([len(x) for x in flips[i]], float)
                cost[:, i, 1:] = np.cumsum(expected + PROBE * probes, 1)
            picks, least = allocate(cost, radius)
            dense = least > crowd
            out = [(np.full(dense.sum(), -1), np.zeros(dense.sum(), np.int64), fp[dense])]
            for i, g in enumerate(groups):
                value = (bits[:, g].astype(np.int64) << np.arange(len(g))).sum(1)
                for t in range(radius + 1):
                    rows = np.flatnonzero((picks[:, i] >= t) & ~dense)
                    near = value[rows, None] ^ flips[i][t][None, :]
                    out.append((np.full(near.size, i), near.ravel(), np.repeat(fp[rows], near.shape[1])))
            part, value, who = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_pydict({"part": part, "value": value, "fp": who})

    return run


def _within(a: str, b: str, radius: int) -> Column:
    return (F.col(a) != F.col(b)) & (F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius)


def _shared_points(fps: DataFrame, bits: int) -> DataFrame:
    """Links ``(a, b)`` with the components of all pairs of ``fps (fp)`` within twice ``bits``."""
    masks = [0] + [int(x) for t in range(1, bits + 1) for x in _flips(BITS, t)]
    points = fps.select("fp", F.explode(F.array(*map(F.lit, masks))).alias("mask"))
    # A point has at most len(masks) fingerprints around it.
    return (
        points.groupBy(F.col("fp").bitwiseXOR(F.col("mask")).alias("point")).agg(F.collect_list("fp").alias("near"))
        .where(F.size("near") > 1).select(F.array_min("near").alias("a"), F.explode("near").alias("b"))
        .where("a <> b").distinct()
    )


def _agreeing(radius: int) -> list[int]:
    """Masks of three blocks of bits each; any two fingerprints within the radius agree under at least one."""
    blocks = [[int(b) for b in g] for g in np.array_split(np.arange(BITS), radius + 3)]
    masks = [sum(1 << b for g in kept for b in g) for kept in combinations(blocks, 3)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))  # of a negative number it would count the bits of its absolute value


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root``, the least place of each place's component, with the components of ``a`` and ``b`` made one."""
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while not np.array_equal(above := root[root], root):
            root = above


def _bucket_roots(key: np.ndarray, fp: np.ndarray, radius: int) -> np.ndarray:
    """For rows sorted by key the first row of its component, by pairs of one key within the radius."""
    root, at, found, many = np.arange(len(key)), np.arange(len(key)), [], 0
    for lag in range(1, len(key)):
        at = at[: np.searchsorted(at, len(key) - lag)]
        at = at[key[at] == key[at + lag]]
        if not len(at):
            break
        ask = at[root[at] != root[at + lag]]
        ask = ask[_differing(fp[ask], fp[ask + lag]) <= radius]
        found.append((ask, ask + lag))
        many += len(ask)
        if many > len(key):
            root, found, many = _joined(root, *(np.concatenate(x) for x in zip(*found, strict=True))), [], 0
    return _joined(root, *(np.concatenate(x) for x in zip(*found, strict=True))) if found else root


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str], limit: float) -> Iterator[tuple[bool, list[np.ndarray]]]:
    """Rows sorted by the first of ``columns``: whole runs of equal values, many at a time, and apart from
    these (with True) the rows of runs longer than ``limit``, in any number of parts."""
    held, size, large = [], 0, None
    for batch in batches:
        rows = [batch.column(c).to_numpy() for c in columns]
        if large is not None:
            n = int(np.searchsorted(rows[0], large, "right"))
            if n:
                yield True, [r[:n] for r in rows]
            rows = [r[n:] for r in rows]
        if not len(rows[0]):
            continue
        large = None
        held.append(rows)
        size += len(rows[0])
        if size < BUCKET_ROWS:
            continue
        rows = [np.concatenate(r) for r in zip(*held, strict=True)]
        last = int(np.searchsorted(rows[0], rows[0][-1]))
        yield from _parted([r[:last] for r in rows], limit)
        rest = [r[last:] for r in rows]
        if len(rest[0]) > limit:
            large = rest[0][0]
            yield True, rest
            held, size = [], 0
        else:
            held, size = [rest], len(rest[0])
    if held:
        yield from _parted([np.concatenate(r) for r in zip(*held, strict=True)], limit)


def _parted(rows: list[np.ndarray], limit: float) -> Iterator[tuple[bool, list[np.ndarray]]]:
    _, place, count = np.unique(rows[0], return_inverse=True, return_counts=True)
    large = count[place] > limit
    for which in (False, True):
        if (large == which).any():
            yield which, [r[large == which] for r in rows]


def _bucket_links(radius: int, limit: float):
    """Rows (key, fp) sorted by both -> links (a, b); of buckets over the limit their rows, without b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for large, (key, fp) in _runs(batches, ["key", "fp"], limit):
            if large:
                a, b = fp, pa.nulls(len(fp), pa.int64())
            else:
                root = _bucket_roots(key, fp, radius)
                linked = np.flatnonzero(root != np.arange(len(fp)))
                key, a, b = key[linked], fp[root[linked]], fp[linked]
            yield pa.RecordBatch.from_pydict({"a": a, "b": b, "key": key})

    return run


def _cell_links(radius: int):
    """Rows (cell, mine, fp, root) sorted by cell -> links (a, b) of roots: those of rows that are ``mine``
    with others of the cell, if within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (cell, mine, fp, root) in _runs(batches, ["cell", "mine", "fp", "root"], float("inf")):
            ends = np.flatnonzero(np.append(cell[1:] != cell[:-1], True)) + 1
            for start, end in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
                own = mine[start:end] == 1
                f, r = fp[start:end], root[start:end]
                ask, ask_root, f, r = f[own], r[own], f[~own], r[~own]
                for n in range(0, len(ask), 256):
                    near = _differing(ask[n : n + 256, None], f) <= radius
                    i, j = np.nonzero(near & (ask_root[n : n + 256, None] != r))
                    links = np.unique(np.stack([ask_root[n + i], r[j]], 1), axis=0)
                    yield pa.RecordBatch.from_pydict({"a": links[:, 0], "b": links[:, 1]})

    return run


def _odd_links(distinct: DataFrame, radius: int, limit: float) -> DataFrame:
    """Links ``(a, b)`` with the components of all pairs of ``distinct (fp)`` within the radius."""
    keys = distinct.select("fp", F.explode(F.array(*[
        F.xxhash64(F.lit(n), F.col("fp").bitwiseAND(F.lit(m))) for n, m in enumerate(_agreeing(radius))])).alias("key"))
    met = written(
        keys.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
        .mapInArrow(_bucket_links(radius, limit), "a long, b long, key long"), "bucket_links")
    links = met.where("b IS NOT NULL").select("a", "b").distinct()
    members = met.where("b IS NULL").select("key", F.col("a").alias("fp"))
    if members.isEmpty():
        return links
    least = members.groupBy("key").agg(F.min("fp").alias("a"))
    stars = members.withColumnRenamed("fp", "b").join(least, "key").where(_within("a", "b", radius)).select("a", "b")
    links = written(links.unionByName(stars).distinct(), "crowd_links")
    rooted = written(
        members.join(components(links).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "crowd_roots")
    # Of a pair in different components at least one is outside the main component of a key they share.
    main = (
        rooted.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key")
        .agg(F.count("*").alias("kinds"), F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("n")).where("kinds > 1")
        .select("key", F.col("main.root").alias("main"), F.ceil(F.col("n") / limit).alias("high"), F.ceil((F.col("n") - F.col("main.n")) / limit).alias("wide"))
    )
    apart = rooted.join(main, "key")
    place = lambda n: F.pmod(F.xxhash64("fp"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked = apart.select("key", F.lit(0).alias("mine"), "fp", "root", place(F.col("high")).alias("i"), every("wide").alias("j"))
    asking = apart.where("root <> main").select("key", F.lit(1).alias("mine"), "fp", "root", every("high").alias("i"), place(F.col("wide")).alias("j"))
    cells = asked.unionByName(asking).select(F.xxhash64("key", "i", "j").alias("cell"), "mine", "fp", "root")
    missing = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_cell_links(radius), "a long, b long")
    return links.unionByName(missing.distinct())


def near_links(distinct: DataFrame, radius: int = 2, parts: int | None = None, crowd: float | None = None) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``fp``, with the same components as all pairs
    within ``radius`` bits. For an even radius every pair within the radius is a link outside crowds.

    ``parts`` partitions serve an even radius. ``crowd`` is the number of candidates, or for an odd
    radius the size of a bucket, from which the ways for crowds are taken."""
    if radius % 2:
        return _odd_links(distinct, radius, max(1, BUCKET if crowd is None else crowd))
    crowd = CROWD if crowd is None else crowd
    parts = parts or radius + 1
    total = distinct.count()
    sums = (
        distinct.mapInArrow(_moments, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # BITS x BITS rows
    )
    moments = np.zeros(BITS * BITS, np.int64)
    moments[sums["cell"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    groups, share = correlated_partitions(moments.reshape(BITS, BITS), total, parts)

    values = F.array(*[F.struct(F.lit(i).cast("long").alias("part"), _value(g).alias("value")) for i, g in enumerate(groups)])
    index = distinct.select("fp", F.inline(values))
    sizes = index.groupBy("part", "value").agg(F.count("*").alias("n"))
    counted = index.join(sizes, ["part", "value"]).groupBy("fp").agg(
        *[F.sum(F.when(F.col("part") == i, F.col("n"))).alias(f"n{i}") for i in range(parts)])

    probes = written(
        counted.mapInArrow(_probes(groups, share, total, radius, crowd), "part long, value long, fp long"), "probes")
    found = (
        probes.where("part >= 0").withColumnRenamed("fp", "a").join(index.withColumnRenamed("fp", "b"), ["part", "value"])
        .where(_within("a", "b", radius)).select("a", "b")
    )
    return found.unionByName(_shared_points(probes.where("part = -1").select("fp"), radius // 2))


def _grouped(rows: DataFrame, radius: int) -> DataFrame:
    """``rows (doc_id, row_key, fp)`` with ``root``, the least fingerprint of the component, and ``component_id``."""
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct_fingerprints")
    of = components(near_links(distinct.select("fp"), radius))
    rooted = distinct.join(of.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(rooted.select("fp", "root").join(ids, "root"), "fp")


def near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    Documents are linked when their fingerprints differ in at most ``radius`` bits; the component id
    is the smallest document id reachable. Null and empty texts and texts without words have
    fingerprint zero and are linked like any other. Repeated rows and null ids give one row each; a
    component of null ids alone has a null id. An empty table gives no rows; further columns are ignored.
    """
    return _grouped(written(fingerprints(docs, width, seed), "fingerprints"), radius).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _shingle_set(text: Column, width: int) -> Column:
    """Distinct hashes of the runs of ``width`` lower-case words; shorter texts are one run."""
    words = F.filter(F.split(F.lower(text), r"[ \t-\r]+"), lambda w: w != "")
    return F.transform(F.array(words), lambda w: F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(w) - (width - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, F.lit(width))))))[0]


def shingles(text: str, width: int) -> np.ndarray:
    """Distinct hashes of the runs of ``width`` words of a lower-case text, as many as ``_shingle_set`` has."""
    import xxhash

    words = text.encode().split()
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    runs, mixed = max(1, len(words) - width + 1), min(width, len(words))
    out = np.full(runs, mixed, np.uint64)
    for k in range(mixed):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + each[k : k + runs])
    return np.unique(out)


def band_count(similarity: float) -> int:
    return int(np.ceil(np.log(MISSED) / np.log1p(-min(similarity, 1 - 1e-9) ** BAND_ROWS)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def _bands(width: int, bands: int):
    """Rows (text, text_key) -> (token, text_key): a hash of each band of MinHash values, of every text of a batch once."""
    factors = np.random.default_rng(42).integers(0, 1 << 32, bands * BAND_ROWS, dtype=np.uint32) | np.uint32(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, first = np.unique(batch.column("text_key").to_numpy(), return_index=True)
            least = np.full((len(keys), len(factors)), 0xFFFFFFFF, np.uint32)
            for n, at in enumerate(first.tolist()):
                s = (shingles(batch.column("text")[at].as_py(), width) >> np.uint64(32)).astype(np.uint32)
                for i in range(0, len(s), SHINGLE_ROWS):
                    np.minimum(least[n], (s[i : i + SHINGLE_ROWS, None] * factors).min(0), out=least[n])
            token = np.repeat(np.arange(bands, dtype=np.uint64)[None, :], len(keys), axis=0)
            for k in range(BAND_ROWS):
                token = _mixed(token * np.uint64(0x9E3779B97F4A7C15) + least[:, k::BAND_ROWS])
            yield pa.RecordBatch.from_pydict({"token": token.ravel().view(np.int64), "text_key": np.repeat(keys, bands)})

    return run


def _starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, text_key) sorted by both -> links (a, b) between the first text of a token and each other."""
    last = None
    for batch in batches:
        token, key = batch.column("token").to_numpy(), batch.column("text_key").to_numpy()
        if not len(token):
            continue
        starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        heads = key[starts]
        if last and last[0] == token[0]:
            heads[0] = last[1]
        head = np.repeat(heads, np.diff(np.append(starts, len(token))))
        last = token[-1], head[-1]
        links = np.unique(np.stack([head, key], 1)[head != key], axis=0)
        yield pa.RecordBatch.from_pydict({"a": links[:, 0], "b": links[:, 1]})


def shingle_links(docs: DataFrame, similarity: float, width: int) -> DataFrame:
    """Links ``(a, b)`` of keys of texts: texts whose shingles have a Jaccard similarity of at least
    ``similarity`` are in one component, whatever their fingerprints. Others may be too."""
    text, bands = F.coalesce(F.col("text"), F.lit("")), band_count(similarity)
    texts = docs.select(F.xxhash64(text).alias("text_key"), F.lower(text).alias("text"))
    keys = texts.mapInArrow(_bands(width, bands), "token long, text_key long")
    links = keys.repartition("token").sortWithinPartitions("token", "text_key").mapInArrow(_starred, "a long, b long")
    return written(links.distinct(), "shingle_links")


def _joined_groups(keyed: DataFrame, links: DataFrame) -> DataFrame:
    """``keyed (root, text_key, ...)`` with one root for all groups that ``links`` of text keys connect."""
    groups = keyed.select("text_key", "root").distinct()
    end = lambda c: groups.select(F.col("text_key").alias(c), F.col("root").alias(f"root_{c}"))
    met = links.join(end("a"), "a").join(end("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    whole = components(met).select(F.col("node").alias("root"), F.col("root").alias("whole"))
    return keyed.join(whole, "root", "left").withColumn("root", F.coalesce("whole", "root")).drop("whole")


def _prefixes(texts: DataFrame, similarity: float) -> DataFrame:
    """``root, rank, n, token, keys``: the shingles that near copies cannot all differ in.

    A near copy shares at least ``similarity`` of the ``n`` shingles, so in any common order of the
    shingles it shares one of the first ``n - similarity n + 1``. Rare ones come first, and those that
    one text of the group has alone need no row. ``keys`` is the number of rows of the text. A token
    is the hash of root and shingle: equal hashes of different ones only add comparisons.
    """
    sized = texts.select("root", "rank", F.col("rank.row_key").alias("row_key"), F.size("set").alias("n"))
    tokens = texts.select(F.col("rank.row_key").alias("row_key"), F.explode(F.transform("set", lambda h: F.xxhash64("root", h))).alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("texts")).where("texts > 1")
    listed = tokens.join(shared, "token").groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("texts", "token"))).alias("shared"))
    length = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1 - (F.col("n") - F.size("shared"))
    first = listed.join(sized, "row_key").select("root", "rank", "n", F.slice("shared", 1, F.greatest(length, F.lit(0)).cast("int"))["token"].alias("first"))
    return first.select("root", "rank", "n", F.size("first").alias("keys"), F.explode("first").alias("token"))


def _copies(texts: DataFrame, similarity: float) -> DataFrame:
    """``root, rank`` of those ``texts (root, rank, set)`` that go because a near copy of less rank stays.

    In each round the texts that share a key are compared with the ``width`` least of it. A text that
    is among these under all its keys, and near no lesser one, stays, and its near copies go. The
    least of a root always stays, so every round decides some. A round that decides less than half
    doubles the width. The outcome is that of taking the least of what is left, one after the other.
    """
    left = written(_prefixes(texts, similarity), "group_keys")
    sets = written(texts.join(left.select("root", "rank").distinct(), ["root", "rank"], "left_semi").select("root", "rank", "set"), "group_sets")
    other = sets.withColumnsRenamed({"rank": "head", "set": "head_set"})
    gone = left.select("root", "rank").limit(0)
    width, open_keys = 1, left.count()
    while open_keys:
        place = F.row_number().over(Window.partitionBy("root", "token").orderBy("rank"))
        heads = written(left.withColumn("place", place).where(F.col("place") <= width), "group_heads")
        whole = heads.groupBy("root", "rank").agg(F.count("*").alias("n"), F.first("keys").alias("keys")).where("n = keys").select("root", "rank")
        # Written, so that its size is known: a round of few pairs leaves the sets where they lie.
        pairs = written(
            left.select("root", "token", "rank", "n").join(heads.select("root", "token", F.col("rank").alias("head"), F.col("n").alias("m")), ["root", "token"])
            .where((F.col("head") < F.col("rank")) & (F.least("n", "m") >= similarity * F.greatest("n", "m") - 1e-9)).select("root", "rank", "head").distinct(),
            "group_pairs")
        asked = other.join(pairs.select("root", "head").distinct(), ["root", "head"], "left_semi")
        common = F.size(F.array_intersect("set", "head_set"))
        near = written(
            sets.join(pairs, ["root", "rank"]).join(asked, ["root", "head"])
            .where(common >= similarity * (F.size("set") + F.size("head_set") - common)).select("root", "rank", "head"), "group_near")
        stays = written(whole.join(near.select("root", "rank").distinct(), ["root", "rank"], "left_anti"), "group_stays")
        goes = near.join(stays.withColumnRenamed("rank", "head"), ["root", "head"], "left_semi").select("root", "rank").distinct()
        gone, before = written(gone.unionByName(goes), "group_gone"), open_keys
        left = written(left.join(stays.unionByName(gone), ["root", "rank"], "left_anti"), "group_rest")
        open_keys = left.count()
        if 2 * open_keys > before:
            width *= 2
    return gone


def representatives(docs: DataFrame, similarity: float = 0.8, width: int = 5, radius: int = 5) -> DataFrame:
    """``docs``, with all their columns, without the near copies of documents that stay.

    Groups are components of damped single-word fingerprints within ``radius`` bits, joined where texts agree
    in a band of MinHash values, so that near copies of any fingerprints are in one group. In each the smallest id stays, and members whose shingles of ``width`` words have a Jaccard similarity of at
    least ``similarity`` with it go. Members that differ more choose the smallest of themselves, and so
    on to the end. So a document goes only if a near copy of it stays, and no two near copies stay.

    Null and empty texts are copies of each other. Of rows that agree in id and text any one stays;
    of equal ids with different texts the smaller row key comes first, null ids come last.
    """
    rows = written(fingerprints(docs, 1, damped=True, text_key=True), "fingerprints")
    grouped = _grouped(rows, radius)
    keyed = written(grouped.select("root", "text_key", "row_key", "doc_id").distinct(), "group_members")
    keyed = written(_joined_groups(keyed, shingle_links(docs, similarity, width)), "joined_members")
    several = keyed.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root")
    # Exact copies first: one member per text, so a group of copies costs one comparison, and only
    # the texts of these members move.
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    alike = keyed.join(several, "root").groupBy("root", "text_key").agg(F.min(rank).alias("rank"))
    texts = (
        docs.select(row_key().alias("row_key"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
        .join(alike.select("root", "rank", F.col("rank.row_key").alias("row_key")), "row_key").dropDuplicates(["row_key"])
    )
    left = written(texts.select("root", "rank", _shingle_set(F.col("text"), width).alias("set")), "group_texts")
    single = keyed.join(several, "root", "left_anti").select("doc_id", "row_key")
    chosen = left.select("root", "rank").join(_copies(left, similarity), ["root", "rank"], "left_anti")
    single = single.unionByName(chosen.select("rank.doc_id", "rank.row_key"))
    own_id, own_key, again = unused(docs, "chosen_id"), unused(docs, "chosen_key"), unused(docs, "chosen_again")
    repeated = rows.groupBy("row_key").agg(F.count("*").alias("n")).where("n > 1").select("row_key", F.lit(True).alias(again))
    staying = single.join(repeated, "row_key", "left").select(
        F.col("doc_id").alias(own_id), F.col("row_key").alias(own_key), F.coalesce(F.col(again), F.lit(False)).alias(again))
    staying = written(staying, "group_staying")
    found = docs.join(staying, row_key() == F.col(own_key)).where(F.col("doc_id").eqNullSafe(F.col(own_id)))
    # Only rows that the table holds several times move once more.
    once, several_times = found.where(~F.col(again)), found.where(F.col(again)).dropDuplicates([own_key])
    return once.unionByName(several_times).select(*docs.columns)
