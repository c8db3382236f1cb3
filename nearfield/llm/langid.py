"""Language identification: averaged embeddings of hashed subwords under a linear softmax.

Subwords are runs of one to four characters inside a word with its bounds; each is hashed into one of
``BUCKETS`` embeddings. A text is the mean of its subwords' embeddings. As the softmax is linear, the
trained model folds into one row of scores per bucket, and a text's scores are the mean of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents

BITS, DIM, ORDERS = 15, 16, 4
BUCKETS = 1 << BITS
#: Characters handled at once; longer texts are read in overlapping stretches, to their end.
STRETCH = 1 << 18

_letters = np.full(0x110000, -1, np.int8)  # filled as characters are met


def is_letter(codes: np.ndarray) -> np.ndarray:
    kinds = _letters[codes]
    if (kinds < 0).any():
        fresh = np.unique(codes[kinds < 0])
        _letters[fresh] = [chr(c).isalpha() for c in fresh.tolist()]
        kinds = _letters[codes]
    return kinds > 0


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def subwords(codes: np.ndarray) -> Iterator[np.ndarray]:
    """For each order the bucket of the subword that starts at each place, or ``BUCKETS`` where none does.

    All that is not a letter is one bound; a subword of three or four has no bound inside.
    """
    letter = is_letter(codes)
    size = len(codes)
    symbols = np.append(np.where(letter, codes, 0).astype(np.uint32), np.zeros(ORDERS, np.uint32))
    letters = np.append(letter, np.zeros(ORDERS, bool))
    mixed, real = np.zeros(size, np.uint32), letter
    for n in range(1, ORDERS + 1):
        mixed = (mixed + symbols[n - 1: n - 1 + size] + np.uint32(n)) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        if n == 2:
            real = letter | letters[1: 1 + size]
        if n == 3:
            real = letters[1: 1 + size]
        if n > 3:
            real = real & letters[n - 2: n - 2 + size]
        yield np.where(real, mixed >> np.uint32(32 - BITS), BUCKETS).astype(np.int32)


def _stretches(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Characters of several texts, where each text starts, and its number; long texts come in parts.

    Places before the start of the next text belong to a text, those after the last start to none.
    """
    held, owners, size = [], [], 0
    for owner, text in enumerate(texts):
        framed = f" {text.lower()} "
        if len(framed) > STRETCH:
            for at in range(0, len(framed), STRETCH):
                part = code_points(framed[at: at + STRETCH + ORDERS - 1])
                yield part, np.array([0, min(STRETCH, len(part))]), np.array([owner])
            continue
        held.append(framed)
        owners.append(owner)
        size += len(framed)
        if size > STRETCH:
            yield code_points("".join(held)), np.cumsum([0, *map(len, held)]), np.array(owners)
            held, owners, size = [], [], 0
    if held:
        yield code_points("".join(held)), np.cumsum([0, *map(len, held)]), np.array(owners)


def sums(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum of the rows of ``table`` over each text's subwords, their number, and whether it has a letter.

    ``table`` has a last row of zeros for places without a subword.
    """
    total, count, lettered = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts)), np.zeros(len(texts), bool)
    for codes, starts, owners in _stretches(texts):
        end = starts[-1]
        for n, buckets in enumerate(subwords(codes), 1):
            buckets = buckets[:end]
            found = np.add.reduceat((buckets < BUCKETS).astype(np.int64), starts[:-1])
            total[owners] += np.add.reduceat(table[buckets], starts[:-1], axis=0)
            count[owners] += found
            if n == 1:
                lettered[owners] |= found > 0
    return total, count, lettered


@dataclass
class Model:
    """Scores per bucket (the last row is zero), languages in order, temperature and least accepted score."""

    table: np.ndarray
    bias: np.ndarray
    languages: list[str]
    temperature: float = 1.0
    threshold: float = 0.0

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the softmax, and whether a text has a letter."""
        total, count, lettered = sums(texts, self.table)
        return total / np.maximum(count, 1)[:, None] + self.bias, lettered

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        return softmax(scores / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[str], labels: np.ndarray, languages: list[str], epochs: int = 3, least: int = 1500, rate: float = 0.5, batch: int = 16, seed: int = 1) -> Model:
    """Stochastic gradient descent on the cross-entropy, each language weighing alike, with a rate that falls to zero.

    Every example is seen ``epochs`` times, or more often if that makes fewer than ``least`` steps."""
    rng = np.random.default_rng(seed)
    embed = np.append(rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)), np.zeros((1, DIM)), 0)
    out, bias, k = np.zeros((DIM, len(languages))), np.zeros(len(languages)), len(languages)
    bags = []
    for text in texts:
        found = np.concatenate(list(subwords(code_points(f" {text.lower()} "))))
        bags.append(found[found < BUCKETS])
    use = [n for n, bag in enumerate(bags) if len(bag)]
    weight = len(use) / (k * np.maximum(np.bincount(labels[use], minlength=k), 1)) if use else np.ones(k)
    per_epoch = max(1, -(-len(use) // batch))
    epochs, step = max(epochs, -(-least // per_epoch)) if use else 0, 0
    steps = epochs * per_epoch
    for _ in range(epochs):
        order = rng.permutation(use)
        for at in range(0, len(order), batch):
            rows = order[at: at + batch]
            sizes = np.array([len(bags[n]) for n in rows])
            flat = np.concatenate([bags[n] for n in rows])
            hidden = np.add.reduceat(embed[flat], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
            wrong = softmax(hidden @ out + bias)
            wrong[np.arange(len(rows)), labels[rows]] -= 1
            wrong *= weight[labels[rows]][:, None]
            now = rate * (1 - step / steps)
            back = -now * (wrong @ out.T) / sizes[:, None]
            np.add.at(embed, flat, np.repeat(back, sizes, axis=0))
            out -= now * hidden.T @ wrong
            bias -= now * wrong.sum(0)
            step += 1
    table = embed @ out
    table[-1] = 0
    return Model(table, bias, languages)


def calibrate(model: Model, scores: np.ndarray, labels: np.ndarray, target: float) -> Model:
    """Set the temperature of least log loss on unseen texts, and the least score above which the share
    of right answers among accepted ones is at least ``target``."""
    if not len(labels):
        return model
    tried = np.geomspace(0.01, 100, 161)
    loss = [-np.log(np.maximum(softmax(scores / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in tried]
    model.temperature = float(tried[int(np.argmin(loss))])
    p = model.probabilities(scores)
    best = np.argsort(-p.max(1), kind="stable")
    right = (p.argmax(1) == labels)[best]
    enough = np.flatnonzero(np.cumsum(right) >= target * np.arange(1, len(right) + 1))
    model.threshold = float(p.max(1)[best[enough[-1]]]) if len(enough) else 1.0
    return model


def _pieces(count: int, longest: int):
    """Training pieces of each document: ``count`` stretches of whole characters, spread over the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, piece = [], []
            for name, text, key in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "key")), strict=True):
                rng = np.random.default_rng(key & 0xFFFFFFFF)
                for _ in range(count):
                    size = int(rng.integers(20, longest + 1))
                    at = int(rng.integers(0, max(1, len(text) - size + 1)))
                    lang.append(name)
                    piece.append(text[at: at + size])
            yield pa.RecordBatch.from_pydict({"lang": pa.array(lang, pa.string()), "piece": pa.array(piece, pa.string())})

    return run


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, _ = model.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"lang": batch.column("lang"), "scores": pa.array(list(scores), pa.list_(pa.float64()))})

    return run


def fit(docs: DataFrame, held: str, rows: int = 6000, languages: int = 200, pieces: int = 3, longest: int = 300, target: float = 0.99) -> Model | None:
    """A model of the languages of the rows where the SQL condition ``held`` on ``doc_id`` is not true.

    It learns from a bounded sample: about ``rows`` documents, the same number of each of the at most
    ``languages`` most frequent languages, chosen by a hash (rows that agree in id and text count once),
    and of each ``pieces`` pieces of at most ``longest`` characters. One document in five is not
    learned from but sets temperature and threshold, by its whole text. None without such rows.
    """
    seen = documents(docs, "lang").where(F.col("lang").isNotNull() & ~F.coalesce(F.expr(held), F.lit(False)) & (F.length("text") > 0))
    sizes = seen.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    if not sizes:
        return None
    share = F.lit(None).cast("double")
    for r in sizes:
        share = F.when(F.col("lang") == r.lang, F.lit(min(1.0, rows / len(sizes) / r.n))).otherwise(share)
    chosen = (
        seen.withColumn("key", F.xxhash64("doc_id", "text")).where(F.pmod("key", F.lit(1_000_003)) < share * 1_000_003)
        .dropDuplicates(["key"]).withColumn("unseen", F.pmod(F.xxhash64("key"), F.lit(5)) == 0)
    )
    names = sorted(r.lang for r in sizes)
    number = {name: k for k, name in enumerate(names)}
    found = chosen.where("NOT unseen").mapInArrow(_pieces(pieces, longest), "lang string, piece string").orderBy("lang", "piece").collect()
    model = train([r.piece for r in found], np.array([number[r.lang] for r in found], np.int64), names)
    found = chosen.where("unseen").mapInArrow(_score(model), "lang string, scores array<double>").collect()
    scores = np.array([r.scores for r in found]).reshape(len(found), len(names))
    return calibrate(model, scores, np.array([number[r.lang] for r in found], np.int64), target)


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                size = len(part)
                if model is None:
                    names, best, accepted = ["und"] * size, np.zeros(size), np.zeros(size, bool)
                else:
                    scores, lettered = model.scores(part.column("text").to_pylist())
                    p = model.probabilities(scores)
                    best = np.where(lettered, p.max(1), 0.0)
                    names = [model.languages[k] if ok else "und" for k, ok in zip(p.argmax(1), lettered, strict=True)]
                    accepted = lettered & (best >= model.threshold)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(best), pa.array(accepted)],
                    names=["doc_id", "held_out", "lang_pred", "score", "accepted"])

    return run


def identify(docs: DataFrame, held: str, **options: float) -> DataFrame:
    """Language of every whole text: ``doc_id, held_out, lang_pred, score, accepted``.

    Learns as ``fit`` does from rows with a language where ``held`` (a condition on ``doc_id``) is not
    true; null ids are not held out. The score is the calibrated probability of the language named,
    and ``accepted`` says whether it reaches the score above which answers on unseen texts were right
    often enough. A text that is null or has no letter, and every text if there is nothing to learn
    from, has language ``und``, score 0 and is not accepted. Repeated rows and null ids give one row
    each; further columns are ignored.
    """
    model = fit(docs, held, **options)
    rows = documents(docs).withColumn("held_out", F.coalesce(F.expr(held), F.lit(False)))
    return rows.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")
