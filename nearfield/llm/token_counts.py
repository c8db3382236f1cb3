"""Token counts by distinct pre-token.

Documents are split into pre-tokens; a block of documents keeps ``(pre-token, frequency)`` per
document. The pieces of a pre-token are counted once for the whole corpus, the counts are joined
to the blocks' pre-tokens, and every document sums frequency times pieces. No ids are made.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import bucket_count, documents, squeezed, squeezed_strings, text_bytes, widened, widened_strings, written_buckets

#: Text per block, whose distinct pre-tokens are held as Python strings.
BLOCK_BYTES = 4 << 20
#: Text per bucket of the block table and per partition of the join.
BUCKET_BYTES = 24 << 20

# Characters on which this module's splitter and the tokenizer's own provably agree: ASCII and
# Latin letters that normalisation leaves alone. Other texts go through the tokenizer's splitter.
_LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-įı-ſ"
_PLAIN = re.compile(f"[\\t\\n\\r -~¡-©«¬®-±´¶-¸»¿×÷{_LETTERS}]*")
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s0-9{_LETTERS}]+")

_BLOCK = (
    "block long, doc_id array<long>, n_bytes array<long>, special array<long>, "
    "per_doc binary, step binary, freq binary, tokens binary"
)


class Splitter:
    """Pre-tokens of a text as the tokenizer in ``path`` makes them, and its special strings."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.split = self.tok.pre_tokenizer[0]  # the splitter before the byte-level step

    def __call__(self, text: str) -> tuple[list[str], int]:
        parts, found = [text], 0
        if self.special and "<|" in text:
            parts = self.special.split(text)
            found = len(parts) - 1
        out = []
        for part in parts:
            if _PLAIN.fullmatch(part):
                out += _PIECES.findall(part.lower())
            elif part:
                out += [p for p, _ in self.split.pre_tokenize_str(self.tok.normalizer.normalize_str(part))]
        return out, found


def piece_counter(path: str):
    """Counts the pieces of pre-tokens: the tokenizer's model without its text splitting."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    spec |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {
        "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}}
    tok = Tokenizer.from_str(json.dumps(spec))
    return lambda tokens: np.fromiter(
        (len(e) for e in tok.encode_batch(tokens, add_special_tokens=False)), np.int64, len(tokens))


def _split_blocks(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(path)
        for block, rows in blocks.runs(batches, BLOCK_BYTES):
            index: dict[str, int] = {}
            ids, special = [], []
            for text in (t.as_py() for c in rows.column("text").chunks for t in c):
                tokens, found = split(text)
                ids.append(np.array([index.setdefault(t, len(index)) for t in tokens], np.int32))
                special.append(found)
            tokens = pa.array(list(index), pa.string())
            per_doc, step, freq = blocks.frequencies(
                np.concatenate([*ids, np.zeros(0, np.int64)]), np.array([len(i) for i in ids]), len(tokens))
            del ids, index
            yield blocks.one_row(
                block=block, doc_id=rows.column("doc_id"), n_bytes=rows.column("n_bytes"), special=np.array(special, np.int64),
                per_doc=squeezed(per_doc), step=squeezed(step), freq=squeezed(freq), tokens=squeezed_strings(tokens))
            del rows, tokens, per_doc, step, freq
            blocks.release()

    return run


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct pre-tokens of each block with their numbers."""
    for batch in batches:
        for row in range(len(batch)):
            tokens = widened_strings(batch.column("tokens")[row].as_py())
            block = pa.array(np.full(len(tokens), batch.column("block")[row].as_py(), np.int64))
            yield pa.RecordBatch.from_arrays([block, pa.array(np.arange(len(tokens), dtype=np.int32)), tokens], names=["block", "pos", "token"])
            blocks.release()


def _count_pieces(path: str):
    """Pieces of sorted pre-tokens, each counted once: ``block`` and ``pos << 32 | pieces``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, last, pieces = piece_counter(path), None, 0
        for batch in batches:
            ids, tokens = blocks.encode(batch.column("token"))
            if len(tokens) == 0:
                continue
            names = tokens.to_pylist()
            fresh = count(names[1:] if names[0] == last else names)
            n = np.concatenate([[pieces], fresh]) if names[0] == last else fresh
            last, pieces = names[-1], n[-1]
            coded = (batch.column("pos").to_numpy().astype(np.int64) << 32) | n[ids]
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(coded)], names=["block", "coded"])
        blocks.release()

    return run


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(len(batch)):
            get = lambda name: batch.column(name)[row]
            coded = np.sort(get("pieces").values.to_numpy()) if get("pieces").is_valid else np.zeros(0, np.int64)
            pieces = coded & 0xFFFFFFFF
            owner, token = blocks.tokens_from_steps(widened(get("per_doc").as_py()), widened(get("step").as_py()))
            ids = get("doc_id").values
            n = blocks.per_document(owner, pieces[token] * widened(get("freq").as_py()), len(ids)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids, get("n_bytes").values, pa.array(n + get("special").values.to_numpy())],
                names=["doc_id", "n_bytes", "n_tokens"])
    blocks.release()


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """Tokens of every whole text under the tokenizer file ``path``: ``doc_id, n_bytes, n_tokens, over_limit``.

    Null text counts as empty (0 tokens). Special strings inside texts count as one token each, as
    the library does by default. Repeated rows and repeated or null ids give one row each; an empty
    table gives no rows; further columns of ``docs`` are ignored.
    """
    rows = documents(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    buckets = bucket_count(rows, text_bytes(rows), BUCKET_BYTES)
    table = written_buckets(rows.mapInArrow(_split_blocks(path), _BLOCK), "token_blocks", "block", buckets)

    asked = table.select("block", "tokens").mapInArrow(_ask, "block long, pos int, token string")
    counted = asked.repartition(buckets, "token").sortWithinPartitions("token").mapInArrow(_count_pieces(path), "block long, coded long")
    answers = counted.groupBy("block").agg(F.collect_list("coded").alias("pieces"))
    return (
        table.drop("tokens").join(answers, "block", "left")
        .mapInArrow(_sum_blocks, "doc_id long, n_bytes long, n_tokens long")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
