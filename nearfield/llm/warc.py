"""Merkle fixity audit of WARC replicas.

Records are hashed where they lie: file, offset, length. The digests of a range of ``SPAN`` bytes
make a leaf, ``FANOUT`` neighbouring ranges make a node, up to ``LEVELS`` levels. The audit compares
the top nodes of two replicas and goes down only below nodes that differ, to the records in the end.
A lost record leaves its offset empty and shifts nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SPAN, FANOUT, LEVELS = 64 << 10, 16, 4
#: Records per file when records are laid out.
FILE_RECORDS = 4096


def record(url: Column, body: Column) -> Column:
    """One WARC resource record; nulls are empty."""
    url, body = F.coalesce(url, F.lit("")), F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def layout(pages: DataFrame) -> DataFrame:
    """``file, offset, length, page_id, payload``: pages as records of files, in id order.

    Pages without id are dealt to 64 files with negative numbers; equal ids follow in url and text
    order. Repeated rows are records of their own.
    """
    rows = pages.select("page_id", F.col("url").alias("url"), record(F.col("url"), F.col("html")).alias("payload"))
    spare = -1 - F.pmod(F.xxhash64("payload"), F.lit(64))
    rows = rows.withColumn("file", F.coalesce(F.floor(F.col("page_id") / FILE_RECORDS), spare)).withColumn("length", F.octet_length("payload").cast("long"))
    before = Window.partitionBy("file").orderBy("page_id", "payload").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("file", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"), "length", "page_id", "payload")


def manifest(records: DataFrame) -> DataFrame:
    """``file, offset, length, digest``: what the tree is built from."""
    return records.select("file", "offset", "length", F.sha2("payload", 256).alias("digest"))


def tree(manifest: DataFrame) -> DataFrame:
    """``file, level, range, digest`` of all nodes; level 0 holds ranges of ``SPAN`` bytes."""
    entry = F.struct("offset", "length", "digest")
    level = (
        manifest.groupBy("file", F.floor(F.col("offset") / SPAN).alias("range"))
        .agg(F.sha2(F.to_json(F.array_sort(F.collect_list(entry))), 256).alias("digest"))
    )
    out = level.withColumn("level", F.lit(0))
    for n in range(1, LEVELS + 1):
        level = (
            level.groupBy("file", F.floor(F.col("range") / FANOUT).alias("range"))
            .agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("range").alias("child"), "digest")))), 256).alias("digest"))
        )
        out = out.unionByName(level.withColumn("level", F.lit(n)))
    return out.select("file", "level", "range", "digest")


def _differing(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer comparison: keys and both sides' values where any differs."""
    named = lambda df, side: df.select(*keys, *[F.col(v).alias(f"{v}_{side}") for v in values])
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"{v}_a").eqNullSafe(F.col(f"{v}_b"))
    return named(a, "a").join(named(b, "b"), keys, "full_outer").where(~same)


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records in which two replicas differ: ``file, offset, kind, length_a, length_b, digest_a, digest_b``.

    ``a`` and ``b`` are manifests with unique ``(file, offset)``. The kind is ``missing`` (not in
    ``b``), ``extra`` (not in ``a``) or ``corrupt``; the absent side has length 0 and an empty digest. Equal or empty replicas give no rows.
    """
    sides = [written(x, "manifest") for x in (a, b)]
    trees = [written(tree(x), "merkle") for x in sides]
    bad = _differing(*[t.where(F.col("level") == LEVELS) for t in trees], ["file", "range"], ["digest"]).select("file", "range")
    for n in reversed(range(LEVELS)):
        above = bad.withColumnRenamed("range", "parent")
        below = [
            t.where(F.col("level") == n).withColumn("parent", F.floor(F.col("range") / FANOUT))
            .join(above, ["file", "parent"], "left_semi") for t in trees]
        bad = written(_differing(*below, ["file", "range"], ["digest"]).select("file", "range"), "differing")
    records = [x.withColumn("range", F.floor(F.col("offset") / SPAN)).join(bad, ["file", "range"], "left_semi") for x in sides]
    kind = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").otherwise("corrupt")
    none = {"length_a": 0, "length_b": 0, "digest_a": "", "digest_b": ""}
    return _differing(*records, ["file", "offset"], ["length", "digest"]).select(
        "file", "offset", kind.alias("kind"), *[F.coalesce(c, F.lit(v)).alias(c) for c, v in none.items()])
