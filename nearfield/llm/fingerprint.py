"""SimHash fingerprints of documents in DataFrame operations alone.

Terms are words, each occurrence weighted by the square of its length in code points (up to
``MAX_LENGTH``), so that short function words, which all texts share, weigh little. A term adds its weight to the votes
of every set bit of its hash; a bit of the fingerprint is set where the votes exceed half of all
weight. Three bits share a long while votes are added up: ``(hash >>> j) & LANES`` holds the bits
``j``, ``j + 22`` and ``j + 44`` in lanes of 22 bits, so 22 sums count all 64 bits.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, text_bytes, written

BITS, LANE, MAX_LENGTH = 64, 22, 31
LANES = 1 | 1 << LANE | 1 << 2 * LANE
#: Terms summed in one row of lanes: 2^10 terms of weight 31^2 fit the shortest lane, of 20 bits.
CHUNK = 1 << 10
#: Other fingerprints that share a key of the block tables by chance, and rows of a key in one cell of its grid.
STRANGERS, CROWD = 16, 4096
#: Parts of the rows that share a fingerprint.
SALTS = 16
#: Text per bucket of the order by id.
BUCKET_BYTES = 16 << 20


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits; empty strings among them weigh nothing."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def votes_to_fingerprint(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and the fingerprint ``fp`` (a long) of each row's text; ``keys`` identify the rows."""
    each = rows.select(*keys, F.posexplode_outer(terms(F.col(text))).alias("pos", "term"))
    length = F.least(F.length("term"), F.lit(MAX_LENGTH)).cast("long")
    h, weight = F.xxhash64("term"), length * length
    lanes = [F.sum(weight * F.shiftrightunsigned(h, j).bitwiseAND(F.lit(LANES))).alias(f"v{j}") for j in range(LANE)]
    chunks = each.groupBy(*keys, F.floor(F.col("pos") / CHUNK).alias("chunk")).agg(*lanes, F.sum(weight).alias("weight"))
    lane = lambda b: F.shiftrightunsigned(F.col(f"v{b % LANE}"), LANE * (b // LANE)).bitwiseAND(F.lit((1 << LANE) - 1))
    totals = chunks.groupBy(*keys).agg(*[F.sum(lane(b)).alias(f"b{b}") for b in range(BITS)], F.sum("weight").alias("weight"))
    fp = F.lit(0).cast("long")
    for b in range(BITS):
        fp = fp.bitwiseOR(F.when(F.col(f"b{b}") * 2 > F.col("weight"), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return totals.select(*keys, fp.alias("fp"))


def likeness(a: Column | str, b: Column | str) -> Column:
    """Share of equal bits, 0 to 1."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def _choices(radius: int, blocks: int) -> list[int]:
    """Bit masks of the tables: every choice of ``blocks - radius`` of the blocks."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(blocks)]
    signed = lambda x: x - (1 << BITS) if x >> (BITS - 1) else x
    return [signed(sum(masks[i] for i in c)) for c in combinations(range(blocks), blocks - radius)]


def block_count(size: int, radius: int) -> int:
    """Blocks with which a key of the tables meets at most ``STRANGERS`` of ``size`` random fingerprints; 7 more than the radius at most."""
    fits = (b for b in range(radius + 2, radius + 8) if size >> BITS * (b - radius) // b <= STRANGERS)
    return next(fits, radius + 7)


def within(asked: DataFrame, fingerprints: DataFrame, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """``q`` and the rows of ``fingerprints`` whose ``fp`` lies within ``radius`` bits of it, equal ones included.

    Permuted block tables: the bits fall into ``blocks`` blocks (default ``radius + 2``), and for
    every choice of ``blocks - radius`` of them there is a table keyed by those blocks. Two
    fingerprints within the radius agree on at least one choice, and are found by the first table on
    whose key they agree, so no pair is emitted twice. Keys that many fingerprints share, as near
    copies do, are cut into a grid of ``CROWD`` asked by ``CROWD`` found ones. ``asked`` holds
    distinct ``q`` and ``fingerprints`` distinct ``fp``; rows where they are null take no part.
    """
    choices = _choices(radius, blocks or radius + 2)
    keyed = lambda df, c: df.where(F.col(c).isNotNull()).select("*", F.inline(F.array(*[
        F.struct(F.lit(i).alias("choice"), F.col(c).bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(choices)])))
    asked, found = keyed(asked.select("q"), "q"), keyed(fingerprints, "fp")
    size = lambda df, name: df.groupBy("choice", "key").agg(F.ceil(F.count("*") / CROWD).alias(name))
    crowds = written(size(asked, "of_q").join(size(found, "of_fp"), ["choice", "key"]).where("of_q > 1 OR of_fp > 1"), "crowds")
    cut = lambda df, mine, others, c, name, other: df.join(crowds, ["choice", "key"], "left").select(
        *df.columns, F.pmod(F.xxhash64(c), F.coalesce(mine, F.lit(1))).alias(name),
        F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(others, F.lit(1)) - 1)).alias(other))
    left, right = cut(asked, "of_q", "of_fp", "q", "row", "column"), cut(found, "of_fp", "of_q", "fp", "column", "row")
    differ = F.col("q").bitwiseXOR(F.col("fp"))
    first = F.lit(len(choices))
    for i, m in reversed(list(enumerate(choices))):
        first = F.when(differ.bitwiseAND(F.lit(m)) == 0, i).otherwise(first)
    return (
        left.join(right, ["choice", "key", "row", "column"])
        .where((F.bit_count(differ) <= radius) & (F.col("choice") == first))
        .select("q", *fingerprints.columns)
    )


def neighbours(fingerprints: DataFrame, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """All pairs ``(a, b)``, ``a < b``, of distinct fingerprints ``fp`` within ``radius`` bits, each once."""
    each = fingerprints.select("fp").distinct()
    return within(each.select(F.col("fp").alias("q")), each, radius, blocks).where("q < fp").select(F.col("q").alias("a"), F.col("fp").alias("b"))


def near_counts(rows: DataFrame, asked: Column, radius: int = 3) -> DataFrame:
    """``rows`` with ``n_near``: how many other rows have a fingerprint ``fp`` within ``radius`` bits.

    Rows for which ``asked`` is not true have null there; all rows are searched. Each fingerprint is
    searched once, with the number of rows that have it.
    """
    rows = rows.withColumn("asked", F.coalesce(asked, F.lit(False)))
    counts = written(rows.groupBy("fp").agg(F.count("*").alias("rows"), F.max("asked").alias("asked")), "counts")
    found = within(counts.where("asked").select(F.col("fp").alias("q")), counts.select("fp", "rows"), radius, block_count(counts.count(), radius))
    near = found.groupBy(F.col("q").alias("fp")).agg((F.sum("rows") - 1).alias("n_near"))
    # Copies of one text share a fingerprint, so answers are met under several salts.
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))
    answered = rows.where("asked").withColumn("salt", salt).join(
        near.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["fp", "salt"])
    others = rows.where("NOT asked").withColumn("n_near", F.lit(None).cast("long"))
    return others.drop("asked").unionByName(answered.drop("asked", "salt"))


def _in_id_order(rows: DataFrame) -> DataFrame:
    """Rows with ``bucket``, ``n`` (place in descending id order) and ``ghost``.

    Buckets are ranges of ids. The row with which the next bucket begins is also put, as a ghost, at
    the end of its predecessor, so every row finds its successor in its own bucket.
    """
    count = max(1, text_bytes(rows) // BUCKET_BYTES)
    cuts = F.percentile_approx("doc_id", F.array(*[F.lit((i + 1) / count) for i in range(count)]), 100 * count)
    bounds = sorted(set(rows.agg(cuts).first()[0] or []))  # at most one id per bucket
    ids = F.array(*map(F.lit, bounds)).cast("array<long>")
    bucket = F.coalesce(F.size(F.filter(ids, lambda b: b < F.col("doc_id"))), F.lit(0)) if bounds else F.lit(0)
    place = lambda b, ghost: F.struct(b.cast("int").alias("bucket"), F.lit(ghost).alias("ghost"))
    after = F.pmod(bucket + 1, F.lit(max(len(bounds), 1)))
    begins = F.coalesce(F.array_contains(ids, F.col("doc_id")), F.lit(False)) if bounds else F.lit(False)
    rows = rows.withColumn("bucket", F.when(begins, F.array(place(bucket, 0), place(after, 1))).otherwise(F.array(place(bucket, 0))))
    order = Window.partitionBy("bucket").orderBy("ghost", F.desc_nulls_last("doc_id"), "text")
    return rows.select("doc_id", "text", F.inline("bucket")).withColumn("n", F.row_number().over(order))


def _next(column: str, *order: Column | str) -> Column:
    """The value in the following row of the bucket, from the last row the first."""
    w = Window.partitionBy("bucket").orderBy(*order)
    return F.coalesce(F.lead(column).over(w), F.first(column).over(w))


def edited_fingerprints(docs: DataFrame, asked: str = "doc_id % 50 = 0", radius: int = 3) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose second half comes from the next document.

    The next document is the one with the next lower id (after the last the first; null ids come
    last, equal ids in text order). Null text is empty; texts without words have fingerprint zero.
    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, n_near``, one row per row. ``n_near`` is the number of other rows within ``radius``
    bits, searched for the rows for which ``asked`` is true and null elsewhere. Further columns are
    ignored; an empty table gives no rows.
    """
    placed = _in_id_order(documents(docs)).withColumn("next", _next("text", "n"))
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next"), F.lit(1), half))
    placed = placed.select("bucket", "n", "ghost", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    versions = placed.select(
        "bucket", "n", "ghost", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        F.posexplode(F.array("text", "edited")).alias("version", "body"))
    keys = ["bucket", "n", "ghost", "doc_id", "n_chars", "edited_sha256"]
    both = votes_to_fingerprint(versions, [*keys, "version"], "body").groupBy(*keys).agg(
        F.max(F.when(F.col("version") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("version") == 1, F.col("fp"))).alias("edited_fp"))
    text = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    done = both.withColumn("next_fp", _next("fp", "n")).where("ghost = 0").drop("bucket", "n", "ghost")
    return near_counts(written(done, "fingerprints"), F.expr(asked), radius).select(
        "doc_id", "n_chars", "edited_sha256", text("fp").alias("fingerprint"), text("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"), "n_near")
