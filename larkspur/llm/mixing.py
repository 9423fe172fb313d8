"""Mixing sources to target weights by balanced sampling (cube method).

A source that is to give r times its words takes floor(r) copies of each document; the fraction of r is every document's
inclusion probability for one copy more.  The flight phase of the cube method moves these probabilities through the null
space of the balancing equations (words and documents of the source), block by block, until only a few documents of each
block are undecided; those meet in larger blocks of the next round.  What is left at the end, three documents a source at
most, is the landing problem, solved by trying its subsets.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, saved, ship

#: Weights of sources by code point, repeating; share of all words; most copies of a source's words.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
WORD = r"[^\x20\x09-\x0D]+"
#: Undecided documents that one task balances at a time.
BLOCK = 2_000
#: Rows that one row of unrolled() makes at a time.
RUN = 100_000
_EPS = 1e-9


def sizes(docs: DataFrame, text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(per_source: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources ordered by code point, null last, take the weights in turn.  Targets share *share* of all words by weight and
    stop at *most* times their source's size; the excess is reshared by weight.  That fills sources in order of
    size per weight: all up to some place are full, the others share the rest in proportion.  Rows are sources, not
    documents, so the windows over all of them stay small.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    t = per_source.withColumn("w", w).withColumn("cap", F.col("source_size") * most)
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    every = Window.partitionBy()
    t = (
        t.withColumn("full", F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("open", F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(every) * share)
        # the level if just the sources before this one are full; true of the first source that it doesn't fill, less after
        .withColumn("level", (F.col("total") - F.coalesce("full", F.lit(0.0))) / F.col("open"))
        .withColumn("level", F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(every))
    )
    return t.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), "cap")).cast("double").alias("target"))


def flight(size: list[float], p: list[float], draw: random.Random) -> list[float]:
    """Move the probabilities of one block until three at most are fractions, keeping the sums of p and of p * size."""
    p = list(p)
    todo = iter([k for k in range(len(p)) if _EPS < p[k] < 1 - _EPS])
    at: list[int] = []
    while True:
        while len(at) < 3 and (k := next(todo, None)) is not None:
            at.append(k)
        if len(at) < 3:
            return p
        a, b, c = (size[k] for k in at)
        u = (b - c, c - a, a - b)
        if u == (0, 0, 0):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[k]) / x if x > 0 else p[k] / -x for k, x in zip(at, u, strict=True) if x)
        down = min(p[k] / x if x > 0 else (1 - p[k]) / -x for k, x in zip(at, u, strict=True) if x)
        step = up if draw.random() * (up + down) < down else -down
        for k, x in zip(at, u, strict=True):
            p[k] += step * x
            p[k] = 0.0 if p[k] < _EPS else 1.0 if p[k] > 1 - _EPS else p[k]
        at = [k for k in at if 0 < p[k] < 1]


def landing(size: list[float], p: list[float]) -> list[float]:
    """Decide the last fractions: the subset whose words come nearest to what is expected; of equals the first."""
    left = [k for k in range(len(p)) if 0 < p[k] < 1]
    want = sum(p[k] * size[k] for k in left)
    best = min(range(1 << len(left)), key=lambda m: (abs(want - sum(size[k] for j, k in enumerate(left) if m >> j & 1)), m))
    p = list(p)
    for j, k in enumerate(left):
        p[k] = float(best >> j & 1)
    return p


def decide(seed: str, last: bool, names: list[str]) -> Callable[[tuple, pa.Table], pa.Table]:
    """The flight of one block, with the landing in the last round; draws hang on seed, source and block."""

    def go(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("row", "ascending"), ("size", "ascending"), ("place", "ascending")])
        size = [float(x) for x in group["size"].to_pylist()]
        p = flight(size, group["p"].to_pylist(), random.Random(f"{seed}/{key[0].as_py()}/{key[1].as_py()}"))
        p = landing(size, p) if last else p
        return group.set_column(group.schema.names.index("p"), "p", pa.array(p, pa.float64())).select(names)

    return go


def unrolled(counts: DataFrame) -> DataFrame:
    """counts (n rows alike) as rows again, each with its place from 0, in runs of RUN so that no array grows with n."""
    runs = counts.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))))
    first = F.col("run") * RUN
    return runs.withColumn("place", F.explode(F.sequence(first, F.least(first + RUN, F.col("n")) - 1))).drop("n", "run")


def balanced(docs: DataFrame, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """docs (row long, place long, source, size long, p double) with p decided, 0 or 1.

    Rows are told apart by row and place, so a key of any number of rows is dealt to as many blocks as other rows.  Each round deals the undecided documents of a source to blocks by hash and lets three at most of each block go on, so
    a source with any part of all rows costs as many tasks as it has blocks, and rounds are few: their number grows with
    the logarithm of the rows, with *block* as base.
    """
    spark = docs.sparkSession
    ship(spark)
    schema = docs.schema
    names = docs.columns
    done: list[DataFrame] = []
    for turn in range(20):
        count = docs.where("p > 0 AND p < 1").groupBy("source").agg(F.count("*").alias("n"))
        last = not count.where(F.col("n") > block).limit(1).count()
        whole = docs.where("NOT (p > 0 AND p < 1)")
        part = docs.where("p > 0 AND p < 1").join(count.withColumnRenamed("source", "s").withColumn("blocks", F.ceil(F.col("n") / block)), F.col("source").eqNullSafe(F.col("s"))).withColumn("block", F.pmod(F.xxhash64("row", "place", F.lit(seed + turn)), F.col("blocks"))).select(*names, "block")

        moved = part.groupBy("source", "block").applyInArrow(decide(f"{seed}/{turn}", last, names), schema)
        docs = saved(whole.unionByName(moved), "mix")
        done.append(docs)
        if last:
            for d in done[:-1]:
                discard(d)
            return docs
    raise RuntimeError("flight did not end")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 0, block: int = BLOCK, key: str = "doc_id") -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of every row: how often the mix takes it.

    Null and empty texts have no words and may be taken or not; they count for nothing.  Rows with the same doc_id, or
    without one, are rows of their own: those alike in doc_id, source and size are counted and numbered, so that a hot doc_id
    is dealt to many blocks.  A source without words has target 0.  Reruns over the same rows agree: blocks and draws hang on
    doc_id, number and seed.  An empty table gives an empty result.
    """
    own = docs.select(F.col(key).alias("row"), "source", sizes(docs).alias("size"))
    own = saved(unrolled(own.groupBy("row", "source", "size").agg(F.count("*").alias("n"))), "mix-sizes")
    per_source = source_targets(own.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    per_source = saved(per_source.withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)), "mix-sources")
    held = per_source.withColumnRenamed("source", "s")
    with_p = own.join(held, F.col("source").eqNullSafe(F.col("s"))).select("row", "place", "source", "size", (F.col("ratio") - F.floor("ratio")).alias("p"))
    with_p = with_p.withColumn("p", F.when(F.col("p") < _EPS, 0.0).when(F.col("p") > 1 - _EPS, 1.0).otherwise(F.col("p")))
    chosen = balanced(with_p, seed, block)
    out = chosen.join(held, F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", (F.floor("ratio") + F.col("p")).cast("int"))
    return out.select(F.col("row").alias(key), "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")
