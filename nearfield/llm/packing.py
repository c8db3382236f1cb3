"""Harmonic packing of documents into sequences of a fixed capacity.

A piece of length ``n`` belongs to class ``k = capacity // n``, and a bin of class ``k`` takes
exactly ``k`` of its pieces, so bins are filled by counting alone, in independent groups. Documents
are cut at whole fractions of the capacity, which leaves no gap in their bins; only the short last
piece of a document falls strictly inside a class. What is left over in a group (fewer than ``k``
pieces) goes on to a coarser grouping; the at most ``k - 1`` pieces per class left in the end are
placed together, longest first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, written

#: Pieces per independently filled group, and groups that hand their rest to the same next group.
GROUP_ROWS, FAN_IN = 50_000, 64


def cut_points(n: int, capacity: int, finest: int = 16) -> list[int]:
    """Lengths of the pieces of a document of ``n`` tokens: whole sequences, then ever smaller whole
    fractions of the capacity while more than ``capacity / finest`` remains, then the rest."""
    lengths = [capacity] * (n // capacity)
    rest = n % capacity
    while rest > capacity // finest:
        lengths.append(capacity // -(-capacity // rest))
        rest -= lengths[-1]
    return lengths + [rest] * (rest > 0)


class Encoder:
    """Token ids as the tokenizer file gives them. Texts without its special strings go through
    the merge ranks of the same vocabulary, which is faster."""

    def __init__(self, path: str, ranks: str | None):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            return self.tok.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def _cut(path: str, ranks: str | None, capacity: int, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path, ranks)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.array([*encode(text), end], "<u4")
                start = 0
                for n in cut_points(len(ids), capacity):
                    piece = ids[start: start + n]
                    row = (doc_id, start, n, zlib.crc32(piece.tobytes()), len(ids), piece if with_ids else None)
                    for column, value in zip(out.values(), row, strict=True):
                        column.append(value)
                    start += n
            types = [pa.int64()] * 5 + [pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    return run


def pieces(docs: DataFrame, path: str, ranks: str | None = None, capacity: int = 2048, end: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: ``doc_id, start, length, ids_crc32, doc_tokens, ids``.

    ``ranks`` optionally names the same vocabulary as a rank file. ``ids`` is null unless asked for.
    """
    return documents(docs).mapInArrow(
        _cut(path, ranks, capacity, end, with_ids),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>")


def _first_fit(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "uid"], ascending=[False, True])
        room, first, bins, offsets = np.zeros(0, np.int64), [], [], []
        for length, uid in zip(rows["length"], rows["uid"], strict=True):
            fits = np.flatnonzero(room >= length)
            if not len(fits):
                room, fits = np.append(room, capacity), [len(room)]
                first.append(uid)
            bins.append(first[fits[0]])
            offsets.append(capacity - room[fits[0]])
            room[fits[0]] -= length
        return rows.assign(sequence_id=bins, offset=offsets)[["uid", "sequence_id", "offset"]]

    return run


def harmonic(sized: DataFrame, capacity: int) -> DataFrame:
    """``uid, sequence_id, offset`` for rows ``uid, length`` (unique; 1 to ``capacity``)."""
    own = sized.where(F.col("length") * 2 > capacity).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = sized.where(F.col("length") * 2 <= capacity).withColumn("k", F.floor(F.lit(capacity) / F.col("length")))
    groups, placed = -(-rest.count() // GROUP_ROWS), own
    while groups:
        group = Window.partitionBy("k", "group")
        inside = Window.partitionBy("k", "group", "bin").orderBy("uid")
        ranked = (
            rest.withColumn("group", F.pmod(F.xxhash64("uid"), F.lit(groups)))
            .withColumn("rank", F.row_number().over(group.orderBy("uid")) - 1)
            .withColumn("n", F.count("*").over(group))
            .withColumn("bin", F.floor(F.col("rank") / F.col("k")))
            .withColumn("full", (F.col("bin") + 1) * F.col("k") <= F.col("n"))
        )
        ranked = written(ranked.select(
            "uid", "length", "k", "full",
            F.min("uid").over(Window.partitionBy("k", "group", "bin")).alias("sequence_id"),
            F.coalesce(F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset")), "bins")
        placed = placed.unionByName(ranked.where("full").select("uid", "sequence_id", "offset"))
        rest = ranked.where("NOT full").select("uid", "length", "k")
        groups = -(-groups // FAN_IN) if groups > 1 else 0
    # At most k - 1 pieces of each of the few classes are left here, whatever the input.
    last = rest.select("uid", "length", F.lit(0).alias("all")).groupBy("all").applyInPandas(_first_fit(capacity), "uid long, sequence_id long, offset long")
    return placed.unionByName(last)


def packed(docs: DataFrame, path: str, ranks: str | None = None, capacity: int = 2048, end: int = 1, with_ids: bool = False) -> DataFrame:
    """Every document's tokens and its end token, placed in sequences of ``capacity`` tokens.

    Returns the columns of ``pieces`` (``ids`` only if asked for) with ``sequence_id`` and
    ``offset``. A null or empty text consists of its end token. Repeated rows and null ids are
    packed row by row; an empty table gives no rows; further columns are ignored.
    """
    rows = written(pieces(docs, path, ranks, capacity, end, with_ids).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    placed = harmonic(rows.select("uid", "length"), capacity)
    out = rows if with_ids else rows.drop("ids")
    return out.join(placed, "uid").drop("uid")
