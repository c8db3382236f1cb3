"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Items are partitioned by their number of word shingles. An item is contained at threshold ``t`` if
at least ``ceil(t n)`` of its ``n`` shingles occur in a document, so of any ``n - ceil(t n) + 1`` of
them at least one occurs. Its sketch is that many shingles with the smallest hashes; one length per
size partition serves all its items. A document that holds any sketch shingle of an item is a
candidate, however long it is, and none is missed: shingles of documents meet sketches alone. Then the
texts of candidates are read again, and how many of the item's shingles they hold is counted exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, row_key, unused, written

WIDTH = 5


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(array: str, width: int) -> Column:
    """The 64-bit hash of each run of ``width`` words. A false match of a whole item would take
    equal hashes of different shingles for most of its shingles at once."""
    return F.when(F.size(array) >= width, F.transform(
        F.sequence(F.lit(1), F.size(array) - (width - 1)), lambda i: F.xxhash64(F.slice(array, i, F.lit(width)))))


def item_shingles(items: DataFrame, threshold: float) -> DataFrame:
    """``item_id, item_key, width, n, h, sketch``: an item's distinct shingles, and which form its sketch.

    Items of fewer than ``WIDTH`` words are one shingle of all their words; items without words have none.
    Items of equal id and different texts are different items, with different keys.
    """
    parts = items.select("item_id", F.xxhash64("item_id", "text").alias("item_key"), words(F.col("text")).alias("w")).where(F.size("w") > 0).dropDuplicates(["item_key"])
    rows = None
    for width in range(1, WIDTH + 1):
        fits = F.size("w") == width if width < WIDTH else F.size("w") >= width
        part = parts.where(fits).select("item_id", "item_key", F.lit(width).alias("width"), F.array_distinct(_shingles("w", width)).alias("s"))
        rows = part if rows is None else rows.unionByName(part)
    largest = F.pow(F.lit(2.0), F.floor(F.log2(F.size("s"))) + 1) - 1  # of the size partition
    length = F.least(F.size("s"), (largest - F.ceil(F.lit(threshold) * largest) + 1).cast("int"))
    return (
        rows.withColumn("s", F.array_sort("s")).withColumn("length", length)
        .select("item_id", "item_key", "width", F.size("s").alias("n"), "length", F.posexplode("s").alias("pos", "h"))
        .select("item_id", "item_key", "width", "n", "h", (F.col("pos") < F.col("length")).alias("sketch"))
    )


def _held(rows: DataFrame, widths: list[int]) -> DataFrame:
    """``doc_key, width, h``: the shingles of texts, of all widths asked for, in one reading."""
    of_width = lambda n: F.transform(
        F.coalesce(_shingles("w", n), F.array().cast("array<long>")), lambda h: F.struct(F.lit(n).alias("width"), h.alias("h")))
    return rows.select("doc_key", F.inline(F.concat(*map(of_width, widths))))


def contained(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``doc_id, text_hash, item_id, shared, n_shingles, containment`` for every contained pair.

    Null and empty texts and items contain nothing and are contained in nothing. Rows that agree in
    id and text count once, of documents as of items; null ids stay; items that share an id and differ
    in text are separate. Empty tables give no rows; further columns are ignored.
    """
    asked = written(item_shingles(items.select("item_id", "text"), threshold), "benchmark_shingles")
    widths = sorted(r.width for r in asked.select("width").distinct().collect()) or [WIDTH]  # at most WIDTH values
    rows = documents(docs, row_key().alias("doc_key")).select("doc_id", "doc_key", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    probed = _held(rows, widths).join(asked.where("sketch").select("item_key", "width", "h"), ["width", "h"])
    candidates = written(probed.select("doc_key", "item_key").distinct(), "candidates")
    texts = rows.join(candidates.select("doc_key").distinct(), "doc_key", "left_semi")
    hits = _held(texts, widths).join(asked.select("item_key", "width", "h"), ["width", "h"]).select("doc_key", "item_key", "h").distinct()
    counted = hits.join(candidates, ["doc_key", "item_key"], "left_semi").groupBy("doc_key", "item_key").agg(F.count("*").alias("shared"))
    verified = counted.join(asked.select("item_key", "item_id", "n").distinct(), "item_key").where(F.col("shared") >= F.ceil(F.lit(threshold) * F.col("n")))
    return verified.join(texts.select("doc_key", "doc_id", "text_hash").distinct(), "doc_key").select(
        "doc_id", "text_hash", "item_id", "shared", F.col("n").alias("n_shingles"), (F.col("shared") / F.col("n")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs``, with all their columns, that contain no item."""
    own_id, own_hash = unused(docs, "leak_id"), unused(docs, "leak_hash")
    leaks = contained(docs, items, threshold).select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash)).distinct()
    text = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return docs.join(leaks, F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (text == F.col(own_hash)), "left_anti")
