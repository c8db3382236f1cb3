"""Alignment of two tokenizers: where their tokens end together, and which ids end together how often.

Texts are cut into units at every single space between two characters that are not white space; no
token of either vocabulary reaches over such a place, so a unit is encoded and aligned once per block
of documents, and a document is the sequence of its units.

Counting is external. Each block sorts its records (pair of ids, document, times) and spills them
as zstd runs, one for each radix of the B id. A k-way heap merge adds up the pairs of a radix, first of
groups of runs, then of what these gave. Pairs come in order of their B id, so the highest count of a B
id is known as soon as its pairs have passed. A last pass streams the runs of a group against the
counts and sends each document what its links contribute.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import documents, squeezed, widened, written

#: Text per block; its distinct units are held with their tokens.
BLOCK_BYTES = 4 << 20
#: Parts of the B ids, and runs of a radix that are merged at once.
RADIXES, FAN_IN = 16, 64
#: Bits of an A id in a pair; ids of both sides are below two to this power.
ID_BITS = 24

_RUNS = (
    "block long, radix int, pairs long, keys binary, totals binary, spread binary, docs binary, times binary, "
    "doc int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
)
_COUNTS = "radix int, grp long, pairs long, keys binary, totals binary, best binary"


def _byte_level() -> dict[str, int]:
    """Byte of each character of a byte-level entry: printable bytes stand for themselves, the others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


BYTE_OF = _byte_level()


def squeezed_long(values: np.ndarray) -> bytes:
    """Non-negative integers below 2^63, as their steps if they ascend."""
    import zstandard

    steps = np.diff(values, prepend=0)
    return zstandard.compress(np.ascontiguousarray(steps, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def widened_long(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i8").ravel())


class Aligner:
    """Encodes and aligns units of text: A is a byte-level tokenizer file, B a sentencepiece model.

    ``ranks`` optionally names A's vocabulary as a rank file, which encodes faster.
    """

    #: A single space between characters that are white space for no library.
    cut = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str, model: str, ranks: str | None):
        import sentencepiece
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        self.a = lambda text: tok.encode(text, add_special_tokens=False).ids
        self.a_bytes = {n: bytes(BYTE_OF[c] for c in entry) for entry, n in tok.get_vocab(with_added_tokens=False).items() if set(entry) <= set(BYTE_OF)}
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.a = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        b = sentencepiece.SentencePieceProcessor(model_file=model)
        self.b = lambda texts: b.encode(texts, num_threads=1)
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if b.is_byte(n) else p.replace("▁", " ").encode()
            for n, p in ((n, b.id_to_piece(n)) for n in range(b.get_piece_size()))]
        top = max(self.a_bytes) + 1
        self.a_size, self.b_size = np.zeros(top, np.int64), np.array([len(p) for p in self.b_bytes])
        for n, entry in self.a_bytes.items():
            self.a_size[n] = len(entry)
        self.b_from = 2 * top
        self.labels = pa.array([f"{n}{sign}" for n in range(top) for sign in ",|"] + [f"{n}{sign}" for n in range(len(self.b_bytes)) for sign in ",;"])

    def align(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Aligns a space and each unit: numbers of A tokens, B tokens and groups per unit; whether the
        tokens' bytes are the unit's; pairs (a, b) that end together, unit by unit; and each unit's groups
        as text, with a semicolon behind every group. A unit that is spelled otherwise has no tokens."""
        spelled = [f" {u}".encode() for u in units]
        left, right = [self.a(f" {u}") for u in units], self.b(units)
        good = np.ones(len(units), bool)
        whole = b"".join(spelled)
        for side, table in ((left, self.a_bytes), (right, self.b_bytes)):
            joined = b"".join([table[n] for ids in side for n in ids])
            sizes = [sum([len(table[n]) for n in ids]) for ids in side] if joined != whole else None
            if sizes is not None:
                at = 0
                for k, size in enumerate(sizes):
                    good[k] &= joined[at: at + size] == spelled[k]
                    at += size
        if not good.all():
            left, right = ([ids if ok else [] for ids, ok in zip(side, good, strict=True)] for side in (left, right))
        n_a, n_b = (np.array([len(ids) for ids in side], np.int64) for side in (left, right))
        a, b = (np.array([n for ids in side for n in ids], np.int64) for side in (left, right))
        # Every unit has the same bytes on both sides, so one running offset serves all.
        _, last_a, last_b = np.intersect1d(np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]), assume_unique=True, return_indices=True)
        groups = np.bincount(np.repeat(np.arange(len(units)), n_a)[last_a], minlength=len(units))
        # In the text the A ids of a group come first, then its B ids, each with the sign that follows it.
        group_a, group_b = (np.searchsorted(last, np.arange(len(x))) for last, x in ((last_a, a), (last_b, b)))
        text = np.empty(len(a) + len(b), np.int64)
        text[np.arange(len(a)) + np.append(0, last_b + 1)[group_a]] = a * 2 + (np.arange(len(a)) == last_a[group_a])
        text[np.arange(len(b)) + last_a[group_b] + 1] = self.b_from + b * 2 + (np.arange(len(b)) == last_b[group_b])
        bounds = pa.array(np.cumsum(np.append(0, n_a + n_b)), pa.int32())
        named = pc.binary_join(pa.ListArray.from_arrays(bounds, self.labels.take(pa.array(text))), "").to_pylist()
        return np.stack([n_a, n_b, groups], 1), good, np.stack([a[last_a], b[last_b]], 1), named


def _spill(aligner: Aligner, block: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """A block's digests and its runs: records of each radix in order of (b, a, document)."""
    index: dict[str, int] = {}
    ids = []
    for text in (t for chunk in rows.column("text").chunks for t in chunk.to_pylist()):
        ids.append(np.array([index.setdefault(u, len(index)) for u in aligner.cut.split(text)] if text else [], np.int64))
    sizes, good, links, named = aligner.align(list(index))
    index.clear()
    ids = [i if good[i].all() else i[:0] for i in ids]
    sha = [hashlib.sha256("".join([named[k] for k in i.tolist()])[:-1].encode()).hexdigest() if len(i) else "" for i in ids]
    per_doc = np.array([sizes[i].sum(0) for i in ids], np.int64).reshape(-1, 3)
    counts = np.array([len(i) for i in ids], np.int64)
    empty = lambda kind: pa.nulls(len(ids), kind)
    yield pa.RecordBatch.from_arrays([
        pa.array(np.full(len(ids), block)), pa.array(np.full(len(ids), -1, np.int32)), empty(pa.int64()), *[empty(pa.binary())] * 5,
        pa.array(np.arange(len(ids), dtype=np.int32)), rows.column("doc_id").combine_chunks(),
        *[pa.array(per_doc[:, k]) for k in (0, 1, 2, 2)], pa.array(sha, pa.string())], names=[c.split()[0] for c in _RUNS.split(", ")])

    per_pair, step, freq = blocks.frequencies(np.concatenate([*ids, np.zeros(0, np.int64)]), counts, len(sizes))
    doc, unit = blocks.tokens_from_steps(per_pair, step)
    if not len(links):
        return
    radix = links[:, 1] % RADIXES
    keys, place = np.unique((radix << (2 * ID_BITS)) | (links[:, 1] << ID_BITS) | links[:, 0], return_inverse=True)
    first = np.cumsum(sizes[:, 2]) - sizes[:, 2]
    each = sizes[unit, 2]
    within = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    pair = place[np.repeat(first[unit], each) + within]
    record, at = np.unique(pair * len(ids) + np.repeat(doc, each), return_inverse=True)
    times = np.zeros(len(record), np.int64)
    np.add.at(times, at, np.repeat(freq, each))
    pair, doc = np.divmod(record, len(ids))
    # Only pairs of documents that count; units of others leave keys without a record.
    used, spread = np.unique(pair, return_counts=True)
    keys, totals = keys[used], np.add.reduceat(times, np.cumsum(spread) - spread) if len(used) else times
    owner = keys >> (2 * ID_BITS)
    out = []
    for r in np.unique(owner).tolist():
        lo, hi = np.searchsorted(owner, [r, r + 1])
        start, stop = spread[:lo].sum(), spread[:hi].sum()
        out.append({
            "block": block, "radix": r, "pairs": int(hi - lo), "keys": squeezed_long(keys[lo:hi]), "totals": squeezed_long(totals[lo:hi]),
            "spread": squeezed(spread[lo:hi]), "docs": squeezed(doc[start:stop]), "times": squeezed(times[start:stop])})
    names = list(out[0]) if out else []
    schema = pa.schema([("block", pa.int64()), ("radix", pa.int32()), ("pairs", pa.int64()), *[(c, pa.binary()) for c in ("keys", "totals", "spread", "docs", "times")]])
    filled = pa.Table.from_pylist(out, schema) if names else schema.empty_table()
    rest = [("doc", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
    for name, kind in rest:
        filled = filled.append_column(name, pa.nulls(len(filled), kind))
    yield from filled.to_batches()


def _encode(path: str, model: str, ranks: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path, model, ranks)
        for block, rows in blocks.runs(batches, BLOCK_BYTES):
            yield from _spill(aligner, block, rows)

    return run


def _stream(keys: bytes, totals: bytes, step: int = 1 << 14) -> Iterator[tuple[int, int]]:
    k, n = widened_long(keys), widened_long(totals)
    for at in range(0, len(k), step):
        yield from zip(k[at: at + step].tolist(), n[at: at + step].tolist(), strict=True)


def _merge(table: pa.Table) -> pa.Table:
    """Counts of the pairs of all runs of a radix and group, in one run; whether each has its B id's highest.

    Pairs of one B id follow each other, so only those are held until the highest is known.
    """
    key, total, best, held = [], [], [], 0
    last, top, from_b = -1, 0, -1

    def close():
        nonlocal held, top
        best.extend([int(n == top) for n in total[held:]])
        held, top = len(total), 0

    columns = [table.column(c).to_pylist() for c in ("keys", "totals")]
    for k, n in heapq.merge(*(_stream(*run) for run in zip(*columns, strict=True))):
        if k == last:
            total[-1] += n
        else:
            if k >> ID_BITS != from_b:
                close()
                from_b = k >> ID_BITS
            key.append(k)
            total.append(n)
            last = k
        top = max(top, total[-1])
    close()
    return pa.table({
        "radix": table.column("radix")[:1], "grp": table.column("grp")[:1], "pairs": pa.array([len(key)], pa.int64()),
        "keys": pa.array([squeezed_long(np.array(key, np.int64))], pa.binary()),
        "totals": pa.array([squeezed_long(np.array(total, np.int64))], pa.binary()),
        "best": pa.array([squeezed(np.array(best, np.int64))], pa.binary())})


def _contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a radix and group in order: first the counts of the radix, then the runs."""
    known = total = best = None
    for batch in batches:
        for row in range(len(batch)):
            get = lambda name: batch.column(name)[row].as_py()  # noqa: B023, E731
            if get("block") < 0:
                known, total, best = widened_long(get("keys")), widened_long(get("totals")), widened(get("best"))
                continue
            at = np.searchsorted(known, widened_long(get("keys")))
            spread, doc, times = widened(get("spread")), widened(get("docs")), widened(get("times"))
            at = np.repeat(at, spread)
            sums = np.zeros((doc.max() + 1, 2), np.int64)
            np.add.at(sums, doc, np.stack([times * best[at], times * total[at]], 1))
            hit = np.unique(doc)
            yield pa.RecordBatch.from_pydict({
                "block": pa.array(np.full(len(hit), get("block"))), "doc": pa.array(hit.astype(np.int32)),
                "n_best": pa.array(sums[hit, 0]), "count_sum": pa.array(sums[hit, 1])})


def aligned(docs: DataFrame, path: str, model: str, ranks: str | None = None) -> DataFrame:
    """How the tokens of two tokenizers meet in every whole text, and how common its links are.

    Returns ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``: tokens of A
    (of a space and the text) and of B, groups between the places where both end, links (pairs of
    tokens that end together), links whose count in all texts is the highest of their B id (ties
    included), the sum of the links' counts, and the hash of the groups' ids.

    Texts that are null, empty, or not spelled by B's pieces have no tokens: zeros and an empty
    string. Special strings are plain text. Repeated rows and null ids give one row each and count
    each time; an empty table gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    table = written(documents(docs).mapInArrow(_encode(path, model, ranks), _RUNS), "alignment_runs")
    digests = table.where("radix < 0").select("block", "doc", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    runs = table.where("radix >= 0")
    most = runs.groupBy("radix").count().agg(F.max("count")).first()[0] or 0
    groups = first = max(1, -(-most // FAN_IN))
    grp = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).alias("grp")
    counts = runs.select("radix", grp(groups), "keys", "totals").withColumn("best", F.lit(None).cast("binary"))
    level = counts.groupBy("radix", "grp").applyInArrow(_merge, _COUNTS)
    while groups > 1:
        groups = -(-groups // FAN_IN)
        level = written(level, "alignment_counts").withColumn("grp", F.pmod("grp", F.lit(groups)))
        level = level.groupBy("radix", "grp").applyInArrow(_merge, _COUNTS)
    level = written(level, "alignment_counts")

    asked = runs.select("radix", grp(first), "block", "keys", "totals", F.lit(None).cast("binary").alias("best"), "spread", "docs", "times")
    nothing = [F.lit(None).cast("binary").alias(c) for c in ("spread", "docs", "times")]
    known = level.select("radix", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(first - 1).cast("long"))).alias("grp"), F.lit(-1).cast("long").alias("block"), "keys", "totals", "best", *nothing)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), first * RADIXES // 8)
    given = (
        known.unionByName(asked).repartition(parts, "radix", "grp").sortWithinPartitions("radix", "grp", "block")
        .mapInArrow(_contribute, "block long, doc int, n_best long, count_sum long")
        .groupBy("block", "doc").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return digests.join(given, ["block", "doc"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
