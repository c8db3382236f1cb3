"""Documents in blocks: each block keeps its distinct tokens once and its documents as numbers.

A block is a run of consecutive documents of one input partition, about ``BLOCK_BYTES`` of text.
What a model knows about a token is then asked for once per block and not once per occurrence,
which is what keeps the joins of the language models and token counts small.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

#: Text per block. Documents are never split; a larger document is a block of its own.
BLOCK_BYTES = 12 << 20


def release() -> None:
    """Give memory that a finished block has left back to the system, where its allocators can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def runs(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, pa.Table]]:
    """Group the documents of a partition into blocks ``(block id, rows)``."""
    part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
    for batch in batches:
        lengths = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(batch):
            done = lengths[start - 1] if start else 0
            stop = max(int(np.searchsorted(lengths, done + limit - size)), start + (not held))
            if stop > start:
                held.append(batch.slice(start, stop - start))
                size += int(lengths[stop - 1] - done)
            if stop < len(batch):
                yield (part << 32) + number, pa.Table.from_batches(held)
                number, held, size = number + 1, [], 0
                release()
            start = stop
    if held:
        yield (part << 32) + number, pa.Table.from_batches(held)


def words_of(texts: pa.ChunkedArray, lower: bool) -> tuple[pa.Array, np.ndarray]:
    """All words between ASCII white space, and how many each document has."""
    parts, counts = [], []
    for chunk in texts.chunks:
        rows = pc.ascii_split_whitespace(pc.ascii_lower(chunk) if lower else chunk)
        flat, owner = rows.flatten(), pc.list_parent_indices(rows).to_numpy()
        real = pc.greater(pc.binary_length(flat), 0)
        parts.append(flat.filter(real))
        counts.append(np.bincount(owner[real.to_numpy(zero_copy_only=False)], minlength=len(chunk)))
    return pa.chunked_array(parts, pa.string()), np.concatenate(counts)


def encode(tokens: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Local number of every token, and the distinct tokens in order of first appearance."""
    whole = pa.chunked_array([tokens]) if isinstance(tokens, pa.Array) else tokens
    chunks = whole.dictionary_encode().unify_dictionaries().chunks
    if not chunks:
        return np.zeros(0, np.int64), pa.array([], pa.string())
    ids = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in chunks])
    return ids.astype(np.int64), chunks[0].dictionary


def frequencies(ids: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``(document, token)`` pairs of a block: pairs per document, token steps, frequencies.

    Tokens of a document ascend; each is stored as the step from the one before.
    """
    owner = np.repeat(np.arange(len(counts)), counts)
    pairs, freq = np.unique(owner * max(size, 1) + ids, return_counts=True)
    owner, token = np.divmod(pairs, max(size, 1))
    per_doc = np.bincount(owner, minlength=len(counts))
    step = np.diff(token, prepend=0)
    starts = (np.cumsum(per_doc) - per_doc)[per_doc > 0]
    step[starts] = token[starts]
    return per_doc, step, freq


def tokens_from_steps(per_doc: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(document, token)`` of every pair that ``frequencies`` stored."""
    total = np.cumsum(step)
    first = (np.cumsum(per_doc) - per_doc)[per_doc > 0]
    base = total[first] - step[first]
    return np.repeat(np.arange(len(per_doc)), per_doc), total - np.repeat(base, per_doc[per_doc > 0])


def per_document(owner: np.ndarray, values: np.ndarray, documents: int) -> np.ndarray:
    return np.bincount(owner, weights=values, minlength=documents).astype(float)  # also without any pair


def one_row(**values) -> pa.RecordBatch:
    """A block as one row: arrays become list columns, the rest plain columns."""
    columns = []
    for value in values.values():
        if isinstance(value, np.ndarray):
            value = pa.array(value)
        if isinstance(value, pa.ChunkedArray):
            value = value.combine_chunks()
        if isinstance(value, pa.Array):
            value = pa.ListArray.from_arrays(pa.array([0, len(value)], pa.int32()), value)
            columns.append(value)
        else:
            columns.append(pa.array([value]))
    return pa.RecordBatch.from_arrays(columns, names=list(values))
