"""Scans by matrix products against plain cosines; blocks whose number doesn't grow with the rows."""

import numpy as np
import pyarrow as pa
import pytest

from larkspur.operators import blocks, nearest, recall


def table(name, x, ids):
    return pa.table([pa.array(ids), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))], names=[name, "vec"])


def plain(q, x, digits=6):
    with np.errstate(all="ignore"):
        return nearest.cosines(q, np.ascontiguousarray(x.T), nearest.norms(q), nearest.norms(x), digits)


def spoiled(rng, n, d):
    """Vectors of which some are copies, multiples, zero, not finite, very large or very small."""
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[n // 2 : n // 2 + n // 8] = x[: n // 8]
    x[n // 4 : n // 4 + n // 8] = x[: n // 8] * np.float32(3)
    for k, v in enumerate((0, 0, np.nan, np.inf, 1e25, 1e-25, 1e30)):
        x[k * 5], x[k * 5 + 1, 0] = v, v
    return x


@pytest.mark.parametrize("repeated", [False, True])
@pytest.mark.parametrize("threshold", [None, 0.2])
def test_best_equals_plain_cosines(repeated, threshold):
    rng = np.random.default_rng(3)
    q, x = spoiled(rng, 300, 24), spoiled(rng, 9_000, 24)
    ids = rng.integers(0, 4_000, len(x)) if repeated else rng.permutation(len(x))
    tally: dict[str, int] = {}
    with np.errstate(all="ignore"):
        got = recall._best(table("query_id", q, np.arange(len(q))), table("atom_id", x, ids), 7, threshold, 6, "atom_id", tally)
    s, want, offered = plain(q, x), [], 0
    for k, row in enumerate(s):
        best: dict[int, float] = {}
        for a, v in zip(ids.tolist(), row.tolist(), strict=True):
            best[a] = max(v, best.get(a, -np.inf))
        passed = sorted((-v, a) for a, v in best.items() if v > -np.inf and (threshold is None or v >= threshold))
        offered += len(passed)
        want += [(k, a, -v) for v, a in passed[:7]]
    assert sorted(zip(*(got[c].to_pylist() for c in got.column_names), strict=True)) == sorted(want)
    assert tally == {"scanned": len(q) * len(x), "offered": offered}


def test_better_counts_equal_plain_cosines():
    rng = np.random.default_rng(4)
    q, x = spoiled(rng, 300, 24), spoiled(rng, 9_000, 24)
    s, at = plain(q, x), rng.integers(0, len(x), len(q))
    marks = s[np.arange(len(q)), at]
    with np.errstate(all="ignore"):
        got = nearest.better(nearest.Pairs(q, x, 6), marks, at)
    assert (got == ((s > marks[:, None]) | ((s == marks[:, None]) & (np.arange(len(x)) < at[:, None]))).sum(1)).all()


def test_ties_beyond_what_is_held_at_once(monkeypatch):
    monkeypatch.setattr(nearest, "CANDIDATES", 50)
    rng = np.random.default_rng(5)
    x = np.outer(rng.integers(1, 9, 9_000), np.array([1, 2, 2])).astype(np.float32)  # one direction: all scores are 1
    i, j, s = nearest.best(nearest.Pairs(x[:3], x, 6), 4, None)
    assert i.tolist() == [0] * 4 + [1] * 4 + [2] * 4 and j.tolist() == [0, 1, 2, 3] * 3 and (s == 1).all()


@pytest.mark.parametrize("rows", [10_000, 100_000, 600_000])
def test_what_is_sent_grows_no_faster_than_the_rows(rows):
    n, m = blocks.counts(rows, rows, 100, 150, 48)
    assert n + m <= 20 and n * m >= 40
    assert rows / n <= blocks.LEFT_MOST and rows / m <= blocks.RIGHT_MOST


def test_small_tables_keep_their_blocks():
    assert blocks.counts(10, 9, 2, 3, 48) == (5, 3) and blocks.counts(0, 5, 2, 3, 48) == (1, 2)
