"""Numpy kernels for one block of queries against one block of base vectors."""

from __future__ import annotations

import numpy as np

from ..functions.vector import sum_squares

#: Cells (queries x base rows) of one distance matrix held in memory at a time: among copies all of
#: them are kept for the exact distance, in about ten arrays.
BLOCK_CELLS = 1 << 20
#: Base rows in one distance matrix: wide enough that the bookkeeping per query row is small.
BLOCK_WIDTH = 1 << 13
#: Base rows of the first one.
FIRST_WIDTH = 1 << 10
#: Squared norms below this cannot overflow in the matrix product.
LARGEST = 1e300
#: Entries per query (subspaces x codes) up to which code distances are a matrix product.
MOST_ENTRIES = 512
#: Numbers (pairs x dim) gathered at a time when preselected pairs are recomputed.
EXACT_CELLS = 1 << 21


class L2:
    """Euclidean metric. The matrix product only preselects; what is kept is recomputed in
    difference form and added up in the order of the SQL expression, so results are the same."""

    def rough(self, q: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        """Distances, per query a bound of their error, and whether there may be NaN among them: there
        only the exact form tells."""
        qn, bn = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", b, b)
        left = np.column_stack([-2.0 * q, qn, np.ones(len(q))])
        d = left @ np.column_stack([b, np.ones(len(b)), bn]).T
        odd = not qn.max(initial=0.0) + bn.max(initial=0.0) < LARGEST
        if odd:
            d[~np.isfinite(d)] = np.nan
            qn, bn = (np.where(np.isfinite(n), n, 0.0) for n in (qn, bn))
        most = qn + bn.max(initial=0.0)
        # rounding error bound of the expansion: a small multiple of dim * eps * norms
        return d, 8.0 * (q.shape[1] + 4) * np.finfo(float).eps * most, odd

    def exact(self, q: np.ndarray, b: np.ndarray) -> np.ndarray:
        return sum_squares(q - b)

    def finish(self, d: np.ndarray) -> np.ndarray:
        return np.sqrt(d)


class PQTable:
    """Symmetric product-quantised distance: one table lookup per subspace, then a sum.
    Rounded to 9 digits, because equal sums reached in another order must compare equal.

    For short tables all lookups of a block are one matrix product: the query's entries for every
    code beside each other, times ones at the codes of the base row."""

    def __init__(self, lut: np.ndarray):
        self.lut = lut  # [m][ksub][ksub]

    def rough(self, q: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        m, k = self.lut.shape[:2]
        if m * k <= MOST_ENTRIES:
            entries = np.concatenate([self.lut[i][q[:, i]] for i in range(m)], axis=1)
            ones = np.zeros((len(b), m * k))
            ones[np.arange(len(b))[:, None], b + k * np.arange(m)] = 1.0
            return entries @ ones.T, 1e-9 + 4.0 * m * k * np.finfo(float).eps * np.abs(entries).sum(1), False
        d = np.zeros((len(q), len(b)))
        for i in range(m):
            d += self.lut[i][q[:, i]][:, b[:, i]]
        return np.round(d, 9), np.zeros(len(q)), False

    def exact(self, q: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = np.zeros(len(q))
        for m in range(self.lut.shape[0]):
            d += self.lut[m][q[:, m], b[:, m]]
        return np.round(d, 9)

    def finish(self, d: np.ndarray) -> np.ndarray:
        return d


class TopK:
    """The k nearest base rows per query seen so far, in total order (distance, id).

    Infinite distances come after all finite ones and NaN after them, as in SQL."""

    def __init__(self, metric, q_ids: np.ndarray, q: np.ndarray, k: int):
        self.metric, self.q_ids, self.q, self.k = metric, q_ids, q, k
        self.dist = np.full((len(q), k), np.inf)
        self.ids = np.zeros((len(q), k), np.int64)
        self.held = np.zeros((len(q), k), bool)

    def add(self, ids: np.ndarray, vecs: np.ndarray, rows: np.ndarray | None = None, allowed=None) -> None:
        """Offer base rows to the queries at positions ``rows`` (all when None). ``allowed(rows)`` gives
        for some of the queries a truth value per base row: only such pairs count."""
        if rows is None:
            rows = np.arange(len(self.q))
        if not len(ids) or not len(rows):
            return
        # A narrow first part gives a bound, against which few rows of the wide ones are left.
        borders = [0, *range(min(FIRST_WIDTH, len(ids)), len(ids), BLOCK_WIDTH), len(ids)]
        height = max(1, BLOCK_CELLS // min(len(ids), BLOCK_WIDTH))
        for r in range(0, len(rows), height):
            some = rows[r : r + height]
            open_ = None if allowed is None else allowed(some)
            for c, end in zip(borders, borders[1:], strict=False):
                if end > c:
                    self._merge(some, ids[c:end], vecs[c:end], None if open_ is None else open_[:, c:end])

    def _merge(self, rows: np.ndarray, ids: np.ndarray, vecs: np.ndarray, open_: np.ndarray | None) -> None:
        with np.errstate(invalid="ignore", over="ignore"):
            rough, slack, odd = self.metric.rough(self.q[rows], vecs)
        if open_ is not None:
            rough[~open_] = np.inf
        kept = self.dist[rows]
        bound = np.where(np.isnan(kept[:, -1]), np.inf, kept[:, -1])
        near = rough <= (bound + slack)[:, None]
        if len(ids) > self.k and np.count_nonzero(near) > 4 * self.k * len(rows):
            # the k-th best of this block is a tighter bound than what was kept so far
            kth = np.partition(rough, self.k - 1, axis=1)[:, self.k - 1] + slack
            near = rough <= (np.fmin(bound, kth) + slack)[:, None]
        if odd:
            near |= np.isnan(rough)
        if open_ is not None:
            near &= open_
        r, c = np.divmod(np.flatnonzero(near), near.shape[1])
        if not len(r):
            return
        step = max(1, EXACT_CELLS // max(1, vecs.shape[1]))
        with np.errstate(invalid="ignore", over="ignore"):
            dist = np.concatenate([
                self.metric.exact(self.q[rows[r[n : n + step]]], vecs[c[n : n + step]]) for n in range(0, len(r), step)])
        old_r, old_c = np.nonzero(self.held[rows])
        row = np.concatenate([r, old_r])
        d = np.concatenate([dist, kept[old_r, old_c]])
        i = np.concatenate([ids[c], self.ids[rows[old_r], old_c]])
        order = np.lexsort((i, d, row))
        row, d, i = row[order], d[order], i[order]
        starts = np.searchsorted(row, np.arange(len(rows)))
        rank = np.arange(len(row)) - starts[row]
        keep = rank < self.k
        row, rank, d, i = row[keep], rank[keep], d[keep], i[keep]
        self.dist[rows[row], rank] = d
        self.ids[rows[row], rank] = i
        self.held[rows[row], rank] = True

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r, c = np.nonzero(self.held)
        return self.q_ids[r], self.ids[r, c], self.metric.finish(self.dist[r, c])
