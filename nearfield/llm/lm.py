"""Document scores under a bigram model mixed by deleted interpolation.

``p(w | v) = l2 * c(v w) / c(v) + l1 * c(w) / N + l0 / (V + 1)``; the weights depend on the
bucket ``floor(log2 c(v))`` of the context's frequency and come from expectation-maximisation. For
that, one part of the training documents is held out: its own counts are deleted from the
corpus counts, and the weights are those that make its tokens most probable.

Blocks of documents ask for each distinct word and bigram once. Requests carry the block's own
counts; a shard adds up all blocks' counts of its keys and answers each block in the order asked.
Keys are 64-bit hashes, so with n distinct n-grams about n / 2^64 of them share counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import bucket_count, documents, pack, text_bytes, unpack, written, written_buckets

#: Text per shard of the counts and per bucket of the block table.
SHARD_BYTES, BUCKET_BYTES = 8 << 20, 12 << 20
#: Text per block; its distinct bigrams are held several times over while they are sorted.
BLOCK_BYTES = 6 << 20
#: The end of a text and its beginning; no word contains white space.
END, BEGIN = "end of text", "beginning of text"
#: Buckets of context frequency; the last takes all above.
BUCKETS = 40
#: Mixture weights (bigram, unigram, uniform) that stand in for a bucket without held-out tokens.
PRIOR = np.array([0.3, 0.6, 0.1])

_BLOCK = "block long, doc_id array<long>, part array<int>, counts binary, tokens binary, hashes binary"
_ASKED = "shard int, block long, keys binary, n binary, held binary"
_ANSWER = "shard int, block long, n binary, held binary, types long, tokens long, held_tokens long"


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A well-mixed hash of two 64-bit hashes; order matters."""
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x7F4A7C15F39CC060))
    for shift in (29, 32):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def _pack_keys(keys: np.ndarray) -> bytes:
    steps = np.diff(keys, prepend=np.uint64(0))
    return np.ascontiguousarray(steps, "<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


class Block:
    """Tokens of a block and its n-gram keys, always in the same order."""

    def __init__(self, counts: np.ndarray, tokens: np.ndarray, hashes: np.ndarray):
        """``tokens`` are the words of all documents, each followed by its end (the last local number)."""
        self.docs = np.repeat(np.arange(len(counts)), counts)
        self.tokens, size = tokens, len(hashes)
        first = np.cumsum(counts) - counts
        context = np.roll(tokens, 1)
        context[first[counts > 0]] = size - 2
        self.context = context
        pairs, self.pair = np.unique(context * size + tokens, return_inverse=True)
        words = (_mix(hashes, hashes) & ~np.uint64(1)) | np.uint64(1)
        words[size - 2] &= ~np.uint64(1)  # the beginning is a context, not a token
        left, right = np.divmod(pairs, size)
        keys = np.concatenate([words, _mix(hashes[left], hashes[right]) & ~np.uint64(1)])
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.words = size

    def own(self, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Counts of the keys, each token weighing as its document does; ``starts``: of beginnings."""
        w = weight[self.docs]
        words = np.bincount(self.tokens, w, self.words)
        words[self.words - 2] = starts.sum()
        pairs = np.bincount(self.pair, w, len(self.keys) - self.words)
        return np.concatenate([words, pairs])[self.order].astype(np.int64)

    def counts_of(self, answer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of every token's bigram, context and word, from counts in key order."""
        back = np.empty(len(answer), np.int64)
        back[self.order] = answer
        return back[self.words + self.pair], back[self.context], back[self.tokens]

    @classmethod
    def of(cls, batch: pa.RecordBatch, row: int) -> Block:
        get = lambda name: batch.column(name)[row].as_py()
        return cls(unpack(get("counts")), unpack(get("tokens")), np.frombuffer(get("hashes"), "<u8"))


def _make_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for block, rows in blocks.runs(batches, BLOCK_BYTES):
        words, counts = blocks.words_of(rows.column("text"), lower=True)
        ids, distinct = blocks.encode(words)
        hashes = [xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()] + [xxhash.xxh3_64_intdigest(w) for w in (BEGIN, END)]
        tokens = np.insert(ids, np.cumsum(counts), len(hashes) - 1)
        yield blocks.one_row(
            block=block, doc_id=rows.column("doc_id"), part=rows.column("part"), counts=pack(counts + 1),
            tokens=pack(tokens), hashes=np.array(hashes, "<u8").tobytes())


def _ask(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                block, part = Block.of(batch, row), batch.column("part")[row].values.to_numpy()
                train, held = (part > 0).astype(float), (part == 2).astype(float)
                n, h = block.own(train, train), block.own(held, held)
                shard = ((block.keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
                cut = np.searchsorted(shard, np.arange(shards + 1))
                pieces = [slice(a, b) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array(np.arange(shards), pa.int32()), "block": [batch.column("block")[row].as_py()] * shards,
                    "keys": [_pack_keys(block.keys[s]) for s in pieces],
                    "n": [pack(n[s]) for s in pieces], "held": [pack(h[s]) for s in pieces]})

    return run


def _add_up(table: pa.Table) -> pa.Table:
    """One shard: corpus counts of its keys, returned to each block in the order it asked."""
    keys = [_unpack_keys(k) for k in table.column("keys").to_pylist()]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    sums = {c: np.bincount(place, np.concatenate([unpack(x) for x in table.column(c).to_pylist()]), len(distinct)).astype(np.int64)
            for c in ("n", "held")}
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    word, rest = (distinct & np.uint64(1)) == 1, [0] * (table.num_rows - 1)
    once = {"types": int((sums["n"][word] > 0).sum()), "tokens": int(sums["n"][word].sum()), "held_tokens": int(sums["held"][word].sum())}
    return pa.table({
        "shard": table.column("shard"), "block": table.column("block"),
        **{c: pa.array([pack(x) for x in np.split(v[place], cuts)], pa.binary()) for c, v in sums.items()},
        **{k: pa.array([v, *rest], pa.int64()) for k, v in once.items()}})


def _answer(batch: pa.RecordBatch, row: int, name: str) -> np.ndarray:
    parts = sorted(batch.column("answers")[row].as_py(), key=lambda x: x["shard"])
    return np.concatenate([unpack(x[name]) for x in parts])


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2 of its count), at most ``BUCKETS - 1``."""
    return np.minimum(np.frexp(context.astype(float))[1], BUCKETS - 1) * (context > 0)


def _level(p: np.ndarray) -> np.ndarray:
    """Probabilities in steps of a tenth of a decade, -1 for zero, to tabulate held-out tokens."""
    return np.where(p > 0, np.minimum(np.rint(-10 * np.log10(np.maximum(p, 1e-30))), 299), -1).astype(np.int64)


def _tabulate(train: int, held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                block = Block.of(batch, row)
                kept = _answer(batch, row, "n") - _answer(batch, row, "held")
                mine = (batch.column("part")[row].values.to_numpy() == 2)[block.docs]
                pair, context, word = (x[mine] for x in block.counts_of(kept))
                cell = (bucket(context) * 301 + _level(pair / np.maximum(context, 1)) + 1) * 301 + _level(word / max(train - held, 1)) + 1
                cells, n = np.unique(cell, return_counts=True)
                yield pa.RecordBatch.from_pydict({"cell": cells, "n": n})

    return run


def mixture_weights(cells: np.ndarray, n: np.ndarray, uniform: float, rounds: int = 200) -> np.ndarray:
    """Weights ``(BUCKETS, 3)`` by expectation-maximisation over tabulated held-out tokens."""
    share = lambda level: np.where(level > 0, 10.0 ** (-(level - 1) / 10), 0.0)
    rest, one = np.divmod(cells, 301)
    group, two = np.divmod(rest, 301)
    p = np.stack([share(two), share(one), np.full(len(cells), uniform)], 1)
    weights = np.tile(PRIOR, (BUCKETS, 1))
    for _ in range(rounds):
        joint = weights[group] * p
        expected = joint / joint.sum(1, keepdims=True) * n[:, None]
        total = np.stack([np.bincount(group, expected[:, k], BUCKETS) for k in range(3)], 1) + PRIOR
        weights = total / total.sum(1, keepdims=True)
    return weights


def _score(weights: np.ndarray, train: int, types: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                block, part = Block.of(batch, row), batch.column("part")[row].values.to_numpy()
                pair, context, word = block.counts_of(_answer(batch, row, "n"))
                w = weights[bucket(context)]
                p = w[:, 0] * (pair / np.maximum(context, 1)) + w[:, 1] * (word / max(train, 1)) + w[:, 2] / (types + 1)
                docs = len(part)
                each = lambda x: np.bincount(block.docs, x, docs)  # noqa: B023, E731
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id")[row].values, "held_out": part == 0,
                    "n_tokens": each(None), "n_known": each(word > 0).astype(np.int64),
                    "train_tokens": np.full(docs, train),
                    "base_score": each(np.log10((word + 1) / (train + types + 1))), "score": each(np.log10(p))})

    return run


def score(docs: DataFrame, train: str, deleted: str = "pmod(xxhash64(doc_id), 10) = 0") -> DataFrame:
    """Log10 probability of every whole text, learning from the rows where ``train`` holds.

    ``train`` is a SQL condition on ``doc_id``; where it is null, the row trains. ``deleted``
    chooses the training part held out for the mixture weights. Returns ``doc_id, held_out,
    n_tokens, n_known, train_tokens, base_score, score``; the base score is that of add-one unigrams.

    Null and empty texts consist of their end alone. Repeated rows and null ids give one row each
    and count each time. Without training rows all probabilities are uniform over the end alone.
    Further columns are ignored.
    """
    part = F.when(~F.coalesce(F.expr(train), F.lit(True)), 0).when(F.coalesce(F.expr(deleted), F.lit(False)), 2).otherwise(1)
    rows = documents(docs).withColumn("part", part)
    size = text_bytes(rows)
    buckets, shards = bucket_count(rows, size, BUCKET_BYTES), max(1, size // SHARD_BYTES)
    table = written_buckets(rows.mapInArrow(_make_blocks, _BLOCK), "lm_blocks", "block", buckets)
    asked = table.drop("doc_id").mapInArrow(_ask(shards), _ASKED)
    answers = written(asked.groupBy("shard").applyInArrow(_add_up, _ANSWER), "lm_counts")
    sums = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("types", "tokens", "held_tokens")]).first()
    joined = table.join(answers.groupBy("block").agg(F.collect_list(F.struct("shard", "n", "held")).alias("answers")), "block")
    cells = (
        joined.drop("doc_id").mapInArrow(_tabulate(sums.tokens, sums.held_tokens), "cell long, n long")
        .groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS x 301 x 301 rows
    )
    weights = mixture_weights(cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(float), 1.0 / (sums.types + 1))
    return joined.mapInArrow(
        _score(weights, sums.tokens, sums.types),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
