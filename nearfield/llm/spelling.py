"""Spelling variants of words: pairs within one edit, found by pivotal grams.

Bigrams are ordered by how many words hold them, rarest first. A word's prefix is its three first
bigrams in that order (and those tied with the third); its pivots are two bigrams of the prefix that
do not overlap, chosen by dynamic programming so that as few words as possible share them. One edit
destroys at most one pivot. Of two words within one edit, the one whose prefix ends earlier in the
order therefore has a pivot that lies in the other's prefix, at a place that its length decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of a word after lower-casing; 90 of them, so there are at most 8,100 bigrams.
RUN = "[a-z\\u00C0-\\u00FF]+"
#: Where a pivot of a word of length n at place p stands in a word one edit away: (length, place) less (n, p).
SHIFTS = ((0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1))

_GRAMS = "word string, last int, pivot boolean, gram int, length int, place int"


def words(docs: DataFrame, least: int = 6, often: int = 5, slip: int = 199) -> DataFrame:
    """``(word, n)``: words of at least ``least`` letters that occur ``often`` times.

    A run of letters counts lower-cased (A to Z only). If ``slip`` divides the CRC-32 of
    ``<doc_id>:<run>``, the letter at that number modulo the run's length is left out; a null id
    reads as the empty string. Counts are added up before the shuffle, so no word is a hot key.
    """
    runs = documents(docs).select(
        F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("prefix"),
        F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"),
    ).where(F.length("run") >= least)
    slipped = F.expr(f"CASE WHEN h % {slip} = 0 THEN concat(substring(run, 1, CAST(h % length(run) AS INT)), "
                     "substring(run, CAST(h % length(run) AS INT) + 2)) ELSE run END")
    return (
        runs.withColumn("h", F.crc32(F.concat("prefix", "run"))).select(slipped.alias("word"))
        .where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)
    )


def pivots_of(prefix: list[tuple[int, int]], cost: list[int]) -> list[tuple[int, int]]:
    """Two bigrams ``(rank, place)`` of ``prefix`` that do not overlap, of least total cost.

    Dynamic programming over places: the cheapest single bigram that ends before each place, and the
    cheapest pair that ends there. Three places always contain two that do not overlap.
    """
    by_place = sorted(prefix, key=lambda g: g[1])
    one, best, done, until = None, None, 0, 0
    for gram in by_place:
        while by_place[until][1] <= gram[1] - 2:  # all that end before this one begins
            if one is None or cost[by_place[until][0]] < cost[one[0]]:
                one = by_place[until]
            until += 1
        if one is not None and (best is None or cost[one[0]] + cost[gram[0]] < done):
            best, done = [one, gram], cost[one[0]] + cost[gram[0]]
    return best


def _choose(rank: dict[str, int], cost: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("word", "last", "pivot", "gram", "length", "place")}
            for word in batch.column("word").to_pylist():
                grams = sorted((rank[word[i: i + 2]], i) for i in range(len(word) - 1))
                last = grams[2][0]
                prefix = [g for g in grams if g[0] <= last]
                rows = [(False, g, len(word), i) for g, i in prefix]
                rows += [(True, g, len(word) + n, i + p) for g, i in pivots_of(prefix, cost) for n, p in SHIFTS if i + p >= 0]
                for row in rows:
                    for column, value in zip(out.values(), (word, last, *row), strict=True):
                        column.append(value)
            types = [pa.string(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    return run


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """Pairs ``(word, other)``, both ways round, of distinct words exactly one edit apart.

    ``vocabulary`` has distinct words of at least four letters of ``RUN``.
    """
    grams = vocabulary.select("word", F.explode(F.expr("array_distinct(transform(sequence(1, length(word) - 1), i -> substring(word, i, 2)))")).alias("gram"))
    order = grams.groupBy("gram").count().collect()  # at most 8,100 rows, whatever the input
    order = sorted((r["count"], r["gram"]) for r in order)
    rank = {gram: k for k, (_, gram) in enumerate(order)}
    chosen = written(vocabulary.select("word").mapInArrow(_choose(rank, [n for n, _ in order]), _GRAMS), "pivots")
    index = chosen.where("pivot").select("gram", "length", "place", "word", "last")
    probes = chosen.where("NOT pivot").select("gram", "length", "place", F.col("word").alias("other"), F.col("last").alias("other_last"))
    met = (
        index.join(probes, ["gram", "length", "place"])
        .where((F.col("last") <= F.col("other_last")) & (F.levenshtein("word", "other", 1) == 1))
        .select(F.least("word", "other").alias("a"), F.greatest("word", "other").alias("b")).distinct()
    )
    pairs = written(met, "near_words")
    return pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other")))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` from ``(word, form)``: the last form reached. Chains halve in each round, and have
    no circles, as every form is more frequent than its word."""
    state = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        state = written(state.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if state.where("moved").isEmpty():
            return state.drop("moved")
        state = state.drop("moved")


def variants(docs: DataFrame, least: int = 6, often: int = 5, slip: int = 199, times: int = 5) -> DataFrame:
    """Groups of spelling variants among the words of all whole texts.

    Returns per word: ``word, form, root, n, n_near, form_n``. Near are words that differ by exactly
    one letter inserted, deleted or replaced. The form is the near word of largest ``n`` (ties: the
    smallest in code-point order) if that is at least ``times`` the word's own, else null; the root is
    the last form, or the word itself.

    Null and empty texts have no words; repeated rows count each time; an empty table gives no rows;
    further columns of ``docs`` are ignored.
    """
    vocabulary = written(words(docs, least, often, slip), "words")
    pairs = near_pairs(vocabulary).join(vocabulary.withColumnsRenamed({"word": "other", "n": "other_n"}), "other")
    near = pairs.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("top"))
    table = vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("top.less") >= times * F.col("n"), F.struct(F.col("top.form").alias("form"), (-F.col("top.less")).alias("n"))).alias("to"))
    table = written(table.select("word", "n", "n_near", F.col("to.form").alias("form"), F.col("to.n").alias("form_n")), "variants")
    last = roots(table.where("form IS NOT NULL").select("word", "form"))
    return table.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
