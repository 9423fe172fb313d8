"""Exact cosines of blocks: matrix products in single precision tell which pairs may matter, and only these are worked out as the
definition says (float32 products summed in index order as float64).

A product differs from the exact score by a bounded error, so a pair is left out only where no error could bring it in.  Rows
that the bound doesn't cover (zero, not finite, very large or small) go the plain way with all others."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Queries and vectors of one matrix product, candidates that are worked out at once, and rows of pairs of one exact step.
QUERIES, VECTORS, CANDIDATES, PAIRS = 256, 4_096, 1 << 18, 1 << 14


def norms(x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += (x[:, d] * x[:, d]).astype(np.float64)
    return np.sqrt(total)


def cosines(q: np.ndarray, cols: np.ndarray, qn: np.ndarray, xn: np.ndarray, digits: int | None) -> np.ndarray:
    """Cosines of queries with vectors given by columns, one dimension after the other; -inf for NaN."""
    s = np.zeros((len(q), cols.shape[1]))
    for d in range(len(cols)):
        s += q[:, d : d + 1] * cols[d]
    return _scores(s, qn[:, None] * xn[None], digits)


def _scores(s: np.ndarray, m: np.ndarray, digits: int | None) -> np.ndarray:
    s = np.divide(s, m, out=np.zeros_like(s), where=m != 0)
    if digits is not None:
        s = np.round(s, digits)
    s[np.isnan(s)] = -np.inf
    return s


class Pairs:
    """Scores of queries q with vectors x, both float32 matrices."""

    def __init__(self, q: np.ndarray, x: np.ndarray, digits: int | None):
        if x.shape[1] != q.shape[1]:
            raise ValueError("vector dimensions differ")
        self.q, self.x, self.digits = q, x, digits
        self.qn, self.xn = norms(q), norms(x)
        plain = lambda v, n: np.isfinite(n) & (n >= 1e-9) & (np.abs(v).max(axis=1, initial=0) <= 1e9)
        own, their = plain(q, self.qn), plain(x, self.xn)
        self.plain_q, self.odd_q = np.flatnonzero(own), np.flatnonzero(~own)
        self.plain_x, self.odd_x = np.flatnonzero(their), np.flatnonzero(~their)
        unit = lambda v, n: (v.astype(np.float64) / n[:, None]).astype(np.float32)
        self._q, self._x = unit(q[self.plain_q], self.qn[self.plain_q]), unit(x[self.plain_x], self.xn[self.plain_x])
        #: what a product and a score can differ by, twice, and what rounding adds
        self.margin = 2 * (q.shape[1] + 10) * 2.0**-24 + (0.0 if digits is None else 1.01 * 10.0**-digits)

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Scores of the pairs (i, j)."""
        s = np.zeros(len(i))
        for at in range(0, len(i), PAIRS):
            a, b = i[at : at + PAIRS], j[at : at + PAIRS]
            products = self.q[a] * self.x[b]
            for d in range(products.shape[1]):
                s[at : at + PAIRS] += products[:, d]
        return _scores(s, self.qn[i] * self.xn[j], self.digits)

    def products(self) -> Iterator[tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]]:
        """(queries, tiles) of the plain rows; tiles are (vectors, products), vectors in ascending order."""
        for at in range(0, len(self.plain_q), QUERIES):
            q = self._q[at : at + QUERIES]
            yield self.plain_q[at : at + QUERIES], ((self.plain_x[k : k + VECTORS], q @ self._x[k : k + VECTORS].T) for k in range(0, len(self.plain_x), VECTORS))

    def others(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(queries, vectors, exact scores) of all pairs that products() leaves out."""
        every = np.arange(len(self.x))
        for rows, cols in ((self.odd_q, every), (self.plain_q, self.odd_x)):
            for k in range(0, len(cols), 16 * VECTORS):
                part = cols[k : k + 16 * VECTORS]
                x = np.ascontiguousarray(self.x[part].T)
                for at in range(0, len(rows), 64):
                    i = rows[at : at + 64]
                    yield i, part, cosines(self.q[i], x, self.qn[i], self.xn[part], self.digits)


def first(i: np.ndarray, j: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first of each i, by falling s, then j."""
    order = np.lexsort((j, -s, i))
    i, j, s = i[order], j[order], s[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep], s[keep]


def best(pairs: Pairs, k: int, threshold: float | None, count: Callable[[np.ndarray, np.ndarray], None] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of the k best vectors of each query, ordered by i, falling score and j; ties go to the smaller j.

    count: gets (queries, vectors, which pairs of them pass the threshold) piece by piece."""
    least = -np.inf if threshold is None else threshold
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for rows, tiles in pairs.products():
        top = np.full((len(rows), k), -np.inf, np.float32)
        floor = np.full(len(rows), least - pairs.margin)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def settle() -> None:
            i, j, s = (np.concatenate([h[n] for h in held]) for n in range(3))
            keep = s >= floor[i]
            i, j = i[keep], j[keep]
            exact = pairs.exact(rows[i], j)
            keep = (exact >= least) & (exact > -np.inf)
            got.append((i[keep], j[keep], exact[keep]))
            held.clear()
            got[:] = [first(*(np.concatenate([g[n] for g in got]) for n in range(3)), k)]

        for cols, s in tiles:
            if count is not None:
                _passing(pairs, rows, cols, s, least, count)
            if s.shape[1] > 4 * k and not held and not got:
                top = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k :]
                floor = np.maximum(floor, top.min(axis=1) - pairs.margin)
                fresh = False
            else:
                fresh = True
            at = np.flatnonzero(s >= floor.astype(np.float32)[:, None])
            if not len(at):
                continue
            i, j = np.divmod(at, s.shape[1])
            value = s.ravel()[at]
            held.append((i, cols[j], value))
            if fresh:
                a, _, v = first(i, j, value, k)
                some, start = np.unique(a, return_index=True)
                new = np.full((len(some), k), -np.inf, np.float32)
                new[np.searchsorted(some, a), np.arange(len(a)) - start[np.searchsorted(some, a)]] = v
                top[some] = np.partition(np.concatenate([top[some], new], axis=1), k, axis=1)[:, k:]
                floor[some] = np.maximum(floor[some], top[some].min(axis=1) - pairs.margin)
            if sum(len(h[0]) for h in held) > CANDIDATES:
                settle()
        if held:
            settle()
        out += [(rows[i], j, s) for i, j, s in got]
    for i, cols, s in pairs.others():
        if count is not None:
            count(i, cols, (s >= least) & (s > -np.inf))
        mark = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)]
        a, b = np.nonzero((s >= np.maximum(mark, least)[:, None]) & (s > -np.inf))
        a, b, s = first(a, b, s[a, b], k)
        out.append((i[a], cols[b], s))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return first(*(np.concatenate([o[n] for o in out]) for n in range(3)), k)


def _passing(pairs: Pairs, rows: np.ndarray, cols: np.ndarray, s: np.ndarray, least: float, count: Callable) -> None:
    """What of a tile passes the threshold: products far from it tell, the others are worked out."""
    passed = s >= np.float32(least + pairs.margin)
    i, j = np.nonzero((s >= np.float32(least - pairs.margin)) & ~passed)
    passed[i, j] = pairs.exact(rows[i], cols[j]) >= least
    count(rows, cols, passed)


def ones(mask: np.ndarray) -> np.ndarray:
    """How many of each row are set."""
    return np.bitwise_count(np.packbits(mask, axis=1)).sum(axis=1, dtype=np.int64)


def better(pairs: Pairs, marks: np.ndarray, before: np.ndarray) -> np.ndarray:
    """For each query the vectors that score more than its mark, or as much and stand at a place below *before*."""
    out = np.zeros(len(marks), np.int64)
    for rows, tiles in pairs.products():
        mark, upto = marks[rows], before[rows]
        low, high = (mark - pairs.margin).astype(np.float32)[:, None], (mark + pairs.margin).astype(np.float32)[:, None]
        for cols, s in tiles:
            sure = s > high
            i, j = np.divmod(np.flatnonzero((s >= low) & ~sure), s.shape[1])
            exact = pairs.exact(rows[i], cols[j])
            found = (exact > mark[i]) | ((exact == mark[i]) & (cols[j] < upto[i]))
            out[rows] += ones(sure) + np.bincount(i[found], minlength=len(rows))
    for i, cols, s in pairs.others():
        out[i] += ((s > marks[i][:, None]) | ((s == marks[i][:, None]) & (cols < before[i][:, None]))).sum(axis=1)
    return out
