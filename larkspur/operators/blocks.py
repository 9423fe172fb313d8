"""Two tables that meet in blocks: every pair of blocks of a group is a task of its own, however large the group."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread(rows: DataFrame) -> DataFrame:
    """rows of a scan, dealt out anew if they stand in fewer partitions than there are cores: a small file with one row group
    would be one task.  Large tables have more splits than that and stay as they are."""
    plan = rows._jdf.queryExecution().executedPlan()
    if "Exchange" in plan.toString():
        return rows
    n = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(n) if plan.execute().getNumPartitions() < n else rows


#: Rows of a block at most, on the left and on the right, however many pairs of blocks that makes.
LEFT_MOST, RIGHT_MOST = 131_072, 262_144


def counts(left: int, right: int, left_block: int, right_block: int, pairs: int) -> tuple[int, int]:
    """Numbers of blocks on either side: blocks of at least left_block and right_block rows, and of more where they would be more
    than *pairs* pairs, up to LEFT_MOST and RIGHT_MOST.  So what is sent is a number of times the rows that doesn't grow
    with them until blocks are full.  The left side has about three blocks for each of the right."""
    n, m = max(1, -(-left // left_block)), max(1, -(-right // right_block))
    if n * m > pairs:
        m = min(m, max(1, round((pairs / 3) ** 0.5), -(-pairs // n)))
        n = min(n, max(1, -(-pairs // m)))
    return max(n, -(-left // LEFT_MOST)), max(m, -(-right // RIGHT_MOST))


def meet(left: DataFrame, right: DataFrame, group: Sequence[str], left_by: Column, right_by: Column, go: Callable[[pa.Table, pa.Table], pa.Table], schema: str, left_block: int, right_block: int) -> DataFrame:
    """go(left rows, right rows) for all pairs of blocks of a group that both sides have.

    Rows are dealt to about left_block and right_block rows a block by the hash of left_by and right_by; equal values share
    a block.  A row is sent once for each block of the other side, which bounds what a task holds.  Without a group these are
    the rows of a block at least: see counts()."""
    left, right = left.withColumn("_l", left_by), right.withColumn("_r", right_by)
    n = left.groupBy(*group).agg(F.ceil(F.count("*") / left_block).alias("_nl")).join(right.groupBy(*group).agg(F.ceil(F.count("*") / right_block).alias("_nr")), list(group)) if group else None
    if group:
        left, right = left.join(n, list(group)), right.join(n, list(group))
    else:
        sizes = dict(zip(("_nl", "_nr"), counts(left.count(), right.count(), left_block, right_block, max(48, 4 * left.sparkSession.sparkContext.defaultParallelism)), strict=True))
        left, right = (t.withColumns({k: F.lit(v).cast("long") for k, v in sizes.items()}) for t in (left, right))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    a = left.withColumn("_a", F.pmod(F.xxhash64("_l"), F.col("_nl"))).withColumn("_b", every("_nr")).drop("_nl", "_nr", "_l")
    b = right.withColumn("_b", F.pmod(F.xxhash64("_r"), F.col("_nr"))).withColumn("_a", every("_nl")).drop("_nl", "_nr", "_r")
    b = b.select(*(F.col(c).alias(f"r_{c}") for c in b.columns))  # both sides may come from one table
    by = [*group, "_a", "_b"]
    if not group:  # pairs are few and heavy: more partitions than pairs, so that few share one
        n_parts = 3 * sizes["_nl"] * sizes["_nr"]
        a, b = a.repartition(n_parts, "_a", "_b"), b.repartition(n_parts, "r__a", "r__b")

    def named(x: pa.Table, y: pa.Table) -> pa.Table:
        return go(x, y.rename_columns([c.removeprefix("r_") for c in y.column_names]))

    return a.groupBy(*by).cogroup(b.groupBy(*(f"r_{c}" for c in by))).applyInArrow(named, schema)
