"""Ends and cycles of links, against a walk."""

import random

import pytest

from larkspur.operators import graph


def walked(links):
    out = {}
    for i in links:
        seen, at = [], i
        while at is not None and at in links and at not in seen:
            seen.append(at)
            at = links[at]
        if at is not None and at in links:
            ring = seen[seen.index(at) :]
            out[i] = (None, None, min(ring), i in ring, len(ring))
        else:
            out[i] = (seen[-1], len(seen) - 1, None, False, None)
    return out


def chain(n, closed, base=0):
    return {base + k: base + (k + 1) % n if closed or k < n - 1 else None for k in range(n)}


@pytest.mark.parametrize(
    "links",
    [
        {},
        {1: 1},
        {1: 2, 2: 1, 3: 1, 4: 3, 5: None, 6: 5, 7: 99},
        chain(1000, True) | {5000: 17},
        chain(300, False) | chain(7, True, 1000),
        {k: random.Random(k).choice([None, *range(60)]) for k in range(60)},
    ],
)
def test_ends(spark, links):
    t = spark.createDataFrame(list(links.items()), "id long, up long")
    got = {r["id"]: tuple(r)[1:] for r in graph.ends(t).collect()}
    assert got == walked(links)
