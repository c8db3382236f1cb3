"""Perplexity filter: an interpolated modified Kneser-Ney model of trusted text.

The model reads symbols: the characters of a word, its end, and before every word one gap symbol
(after a sentence, inside one, or before a repetition of the word just read). A word's symbols are
predicted from up to ``ORDER - 1`` symbols back to the gap, so texts of shouted, decorated or
repeated words are as improbable as texts of unknown ones.

Blocks of documents ask for each distinct n-gram once. Counts, contexts and answers are joined by
n-gram, so the model is nowhere held whole, and each block adds up its documents.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import bucket_count, documents, joined, row_key, squeezed, squeezed_strings, text_bytes, unused, widened, widened_strings, written, written_buckets

ORDER = 5
BEGIN, END = "\x02", "\x03"
GAPS = (".", " ", "=")
BUCKET_BYTES = 24 << 20
#: Text per block, whose distinct units are held as symbols.
BLOCK_BYTES = 6 << 20
#: Answers are sent as whole steps of this size of a log10 probability.
STEP = 1e-7

_BLOCK = (
    "block long, doc_id array<long>, lang array<string>, row_key array<long>, per_doc binary, step binary, freq binary, "
    "units binary"
)


def units_of(texts: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Units (gap symbol and word) of a block: number per occurrence, strings, count per document."""
    tokens, counts = blocks.words_of(texts, lower=False)
    ids, words = blocks.encode(tokens)
    first = np.zeros(len(ids) + 1, bool)
    first[np.cumsum(counts) - counts] = True
    first = first[:-1]
    previous = np.roll(ids, 1)
    ends = pc.match_substring_regex(words, r"[.!?:]$").to_numpy(zero_copy_only=False)
    gap = np.where(first, 0, np.where(previous == ids, 2, np.where(ends[previous] if len(words) else False, 0, 1)))
    both = ids * 3 + gap
    local, at = _numbered(both)
    distinct = both[at]
    units = pc.binary_join_element_wise(pa.array(GAPS).take(pa.array(distinct % 3)), words.take(pa.array(distinct // 3)), "")
    return local, units, counts


def grams_of(units: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """N-grams that predict each symbol of each unit: owner unit and gram number, and the distinct grams.

    Grams are numbered as they first appear, an order that depends on the units alone.
    """
    framed = pc.binary_join_element_wise(BEGIN, units, END, "")
    sizes = pc.utf8_length(framed).to_numpy(zero_copy_only=False).astype(np.int64)
    whole = joined(framed, "")
    del framed
    points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
    used = np.zeros(sys.maxunicode + 1, bool)
    used[points] = True
    codes = np.cumsum(used)[points]  # from 1; zero stands before a unit's first symbol
    base = int(used.sum()) + 1
    del points, used
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(codes), dtype=np.int32) - np.repeat(starts.astype(np.int32), sizes)
    packed, power, earlier = codes.copy(), 1, np.empty_like(codes)
    for back in range(1, ORDER):
        power *= base
        if power > 2**62 // base:  # many symbols: number the shorter grams first
            packed, first = _numbered(packed)
            packed, power = packed.astype(np.int64), len(first)
        earlier[:back] = 0
        np.multiply(codes[: max(len(codes) - back, 0)], power, out=earlier[back:])
        earlier *= place >= back
        packed += earlier
    del codes, earlier
    asked = place > 0
    packed = packed[asked]
    ids, first = _numbered(packed)
    del packed
    ends = np.flatnonzero(asked)[first]
    begins = ends - np.minimum(place[ends], ORDER - 1)
    del asked, place
    grams = [whole[i: j + 1] for i, j in zip(begins.tolist(), ends.tolist(), strict=True)]
    return np.repeat(np.arange(len(sizes), dtype=np.int32), np.maximum(sizes - 1, 0)), ids, pa.array(grams, pa.string())


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each value in order of first appearance, and where each distinct value first stands."""
    ids = pa.array(values).dictionary_encode().indices.to_numpy()
    first = np.empty(int(ids.max(initial=-1)) + 1, np.int64)
    first[ids[::-1]] = np.arange(len(ids), dtype=np.int32)[::-1]  # of equal places the last assignment counts
    return ids, first


def _make_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, rows in blocks.runs(batches, BLOCK_BYTES):
        local, units, counts = units_of(rows.column("text"))
        per_doc, step, freq = blocks.frequencies(local, counts, len(units))
        yield blocks.one_row(
            block=block, doc_id=rows.column("doc_id"), lang=rows.column("lang"), row_key=rows.column("row_key"),
            per_doc=squeezed(per_doc), step=squeezed(step), freq=squeezed(freq), units=squeezed_strings(units))
        del rows, local, units, per_doc, step, freq
        blocks.release()


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct grams of each block with their numbers."""
    for batch in batches:
        for row in range(len(batch)):
            grams = grams_of(widened_strings(batch.column("units")[row].as_py()))[2]
            size = len(grams)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, batch.column("block")[row].as_py())), pa.array(np.arange(size, dtype=np.int32)), grams],
                names=["block", "pos", "gram"])
            del grams
            blocks.release()


def _count_trusted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-gram counts of a block's trusted documents."""
    for batch in batches:
        for row in range(len(batch)):
            get = lambda name: batch.column(name)[row]
            per_doc, units = widened(get("per_doc").as_py()), widened_strings(get("units").as_py())
            trusted = np.zeros(len(per_doc))
            trusted[get("trusted").values.to_numpy()] = 1
            owner, unit = blocks.tokens_from_steps(per_doc, widened(get("step").as_py()))
            weight = np.bincount(unit, trusted[owner] * widened(get("freq").as_py()), len(units))
            used = np.flatnonzero(weight)
            owner, ids, grams = grams_of(units.take(pa.array(used)))
            count = np.bincount(ids, weight[used][owner], len(grams)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([grams, pa.array(count)], names=["gram", "n"])
            blocks.release()


def _score_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(len(batch)):
            get = lambda name: batch.column(name)[row]
            ids, units = get("doc_id").values, widened_strings(get("units").as_py())
            unit_of, gram, grams = grams_of(units)
            logp = np.zeros(len(grams))
            del grams
            if get("answers").is_valid:
                answer = get("answers").values.to_numpy()
                logp[answer >> 32] = -STEP * (answer & 0xFFFFFFFF)
            per_unit = np.bincount(unit_of, logp[gram], len(units))
            symbols = np.bincount(unit_of, minlength=len(units))
            del unit_of, gram
            owner, unit = blocks.tokens_from_steps(widened(get("per_doc").as_py()), widened(get("step").as_py()))
            freq = widened(get("freq").as_py())
            yield pa.RecordBatch.from_arrays([
                ids, get("lang").values, get("row_key").values, pa.array(blocks.per_document(owner, freq * per_unit[unit], len(ids))),
                pa.array(blocks.per_document(owner, freq * symbols[unit], len(ids)).astype(np.int64)),
            ], names=["doc_id", "lang", "row_key", "logp", "n_symbols"])
            blocks.release()


def kneser_ney(counts: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """The model from raw counts ``(gram, n)`` of full-history n-grams.

    Returns ``(gram, alpha)``, the discounted share of a gram in its context; ``(context, gamma)``,
    the weight its context gives to the next shorter one; and the uniform probability below all.
    """
    size = F.length("gram")
    level = written(counts.groupBy("gram").agg(F.sum("n").alias("n")), "gram_counts")
    levels = [level]
    # Below the longest grams a count is the number of distinct symbols seen on the left. Grams that
    # start a word have none, and keep their own counts.
    for k in range(ORDER - 1, 0, -1):
        above = levels[-1].where(size == k + 1)
        continued = above.groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n"))
        levels.append(continued.unionByName(level.where(size == k)) if k > 1 else continued)
    adjusted = levels[0].where(size == ORDER)
    for lower in levels[1:]:
        adjusted = adjusted.unionByName(lower)
    adjusted = written(adjusted.select(
        "gram", "n", size.alias("k"), F.expr("substring(gram, 1, length(gram) - 1)").alias("context")), "gram_levels")
    seen = adjusted.groupBy("k").agg(*[F.sum(F.when(F.col("n") == i, 1).otherwise(0)).alias(f"n{i}") for i in (1, 2, 3, 4)])
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    # Without grams of a count the estimate is undefined, and half the count is taken off.
    estimate = lambda i: i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}"))
    cut = seen.select("k", *[
        F.when(estimate(i).isNull(), 0.5 * i).otherwise(F.least(F.greatest(estimate(i), F.lit(0.1 * i)), F.lit(0.9 * i))).alias(f"d{i}")
        for i in (1, 2, 3)])
    rows = adjusted.join(F.broadcast(cut), "k")  # ORDER rows
    discount = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    rows = rows.withColumn("d", discount)
    contexts = rows.groupBy("context", "k").agg(
        F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("gamma"))
    alpha = rows.join(contexts, ["context", "k"]).select("gram", ((F.col("n") - F.col("d")) / F.col("total")).alias("alpha"))
    symbols = adjusted.where("k = 1").count()
    return written(alpha, "alphas"), written(contexts.select("context", "k", "gamma"), "gammas"), 1.0 / (symbols + 1)


def probabilities(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """``(gram, p)``: probability of the last symbol of every asked distinct gram, and of its suffixes.

    Suffixes are shared by many grams, so the interpolation goes up level by level over distinct ones.
    """
    alpha, gamma, floor = kneser_ney(counts)
    asked = written(grams, "asked_grams").withColumn("k", F.length("gram"))
    needed = {ORDER: asked.where(F.col("k") == ORDER).select("gram")}
    for k in range(ORDER - 1, 0, -1):
        suffixes = needed[k + 1].select(F.expr("substring(gram, 2)").alias("gram"))
        needed[k] = suffixes.unionByName(asked.where(F.col("k") == k).select("gram")).distinct()
    out, below = None, None
    for k in range(1, ORDER + 1):
        rows = needed[k].join(alpha, "gram", "left").withColumn("context", F.lit("") if k == 1 else F.expr(f"substring(gram, 1, {k - 1})"))
        rows = rows.join(gamma.where(F.col("k") == k).drop("k"), "context", "left")
        lower = F.lit(floor)
        if below is not None:
            rows = rows.withColumn("suffix", F.expr("substring(gram, 2)")).join(
                below.select(F.col("gram").alias("suffix"), F.col("p").alias("lower")), "suffix")
            lower = F.col("lower")
        p = F.coalesce("alpha", F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * lower
        below = written(rows.select("gram", p.alias("p")), f"p{k}")
        out = below if out is None else out.unionByName(below)
    return out


def perplexities(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """``doc_id, lang, row_key, n_symbols, perplexity`` of every row of ``docs``; the model learns from the
    documents whose id is in ``trusted``. Perplexity is null for texts without words."""
    rows = documents(docs, "lang", row_key().alias("row_key"))
    buckets = bucket_count(rows, text_bytes(rows), BUCKET_BYTES)
    table = written_buckets(rows.mapInArrow(_make_blocks, _BLOCK), "quality_blocks", "block", buckets)
    marks = (
        table.select("block", F.posexplode("doc_id").alias("pos", "doc_id"))
        .join(trusted.select("doc_id").distinct(), "doc_id", "left_semi")
        .groupBy("block").agg(F.collect_list("pos").alias("trusted"))
    )
    counts = table.drop("doc_id", "lang", "row_key").join(marks, "block").mapInArrow(_count_trusted, "gram string, n long")
    asked = table.select("block", "units").mapInArrow(_ask, "block long, pos int, gram string").repartition(buckets, "gram")
    asked = written_buckets(asked, "quality_asked", "gram", buckets)  # made once, read twice where it lies
    known = probabilities(asked.groupBy("gram").agg(F.lit(1).alias("_")).drop("_"), counts)
    coded = F.shiftleft(F.col("pos").cast("long"), 32) + F.round(-F.log10("p") / STEP).cast("long")
    answers = asked.join(known, "gram").groupBy("block").agg(F.collect_list(coded).alias("answers"))
    scored = table.join(answers, "block", "left").mapInArrow(
        _score_blocks, "doc_id long, lang string, row_key long, logp double, n_symbols long")
    return scored.select("doc_id", "lang", "row_key", "n_symbols",
                         F.pow(F.lit(10.0), F.try_divide(-F.col("logp"), F.col("n_symbols"))).alias("perplexity"))


def quality(docs: DataFrame, labels: DataFrame, tail: float = 0.01, fence: float = 0.5, fold: int = 5) -> DataFrame:
    """Keep documents whose perplexity fits their language's quantiles of trusted text.

    Trusted are the documents with label ``quality = 1`` and none of 0. One in ``fold`` of them, by a
    hash of the id, sets the quantiles and the model learns from the others, so that the quantiles are
    those of unseen text. The limits lie beyond the quantiles ``tail`` and ``1 - tail`` of the log
    perplexity by ``fence`` times their distance from the median, as languages may have few trusted texts.

    Languages without held-out trusted documents (also null) use the limits of all; without any
    trusted document only texts without words are rejected. Null and empty texts have a null
    perplexity and are rejected. Repeated rows give one row each; further columns are ignored.
    """
    trusted = (
        labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("quality")).where("quality = 1")
        .select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(fold)) == 0).alias("held_out"))
    )
    scored = written(perplexities(docs, trusted.where("NOT held_out")), "perplexities")
    good = scored.join(trusted.where("held_out"), "doc_id", "left_semi").where("perplexity IS NOT NULL")
    cuts = F.percentile_approx(F.ln("perplexity"), F.array(*map(F.lit, (tail, 0.5, 1 - tail))), 10_000)
    limits = lambda q: F.array(q[0] - fence * (q[1] - q[0]), q[2] + fence * (q[2] - q[1]))
    by_lang = good.groupBy(F.col("lang").alias("of")).agg(limits(cuts).alias("limits"))
    overall = good.agg(limits(cuts).alias("all_limits"))
    limit = F.coalesce("limits", "all_limits")
    return (
        scored.join(by_lang, F.col("lang").eqNullSafe(F.col("of")), "left")
        .crossJoin(F.broadcast(overall))  # one row
        .select(
            "doc_id", "lang", "row_key", "n_symbols", "perplexity", F.exp(limit[0]).alias("lower"), F.exp(limit[1]).alias("upper"))
        .withColumn("keep", F.col("perplexity").isNotNull()
                    & F.coalesce(F.col("perplexity").between(F.col("lower"), F.col("upper")), F.lit(True)))
    )


def kept(docs: DataFrame, labels: DataFrame, **options: float) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``quality`` keeps."""
    key = unused(docs, "good_key")
    good = quality(docs, labels, **options).where("keep").select(F.col("row_key").alias(key)).distinct()
    return docs.join(good, row_key() == F.col(key), "left_semi")
