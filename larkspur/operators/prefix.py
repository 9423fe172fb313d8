"""Running values over the ordered rows of a key, however many rows one key has.

A window puts a key into one task.  Here rows are cut into blocks along their order: the values of a block are worked out in
the block, those of whole blocks are carried forward over blocks, and both are put together.  A key with a third of all rows is
as many tasks as there are blocks; what goes by key alone is one row a block.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, about, blocks at most, and the estimated bytes below which rows aren't counted: they are one block.
BLOCK_ROWS, MAX_BLOCKS, SMALL = 250_000, 4_096, 32 << 20


@dataclass(frozen=True)
class Running:
    """One running value: kind 'sum', 'max', 'min' or 'last' (the last that isn't null) of a column, over the rows before and,
    if *inclusive*, the row itself."""

    name: str
    kind: str
    column: Column
    inclusive: bool = True

    def of(self, c: Column) -> Column:
        return {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda x: F.last(x, ignorenulls=True)}[self.kind](c)

    def both(self, carried: Column, own: Column) -> Column:
        if self.kind == "sum":
            return F.when(carried.isNull(), own).when(own.isNull(), carried).otherwise(carried + own)
        return F.coalesce(own, carried) if self.kind == "last" else {"max": F.greatest, "min": F.least}[self.kind](carried, own)


def bounds(rows: DataFrame, order: str, blocks: int | None = None) -> list:
    """Values of *order* that cut the rows into about equal blocks: quantiles, so one pass and a bounded number of values."""
    if blocks is None:
        if int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SMALL:
            return []
        blocks = min(MAX_BLOCKS, max(1, -(-rows.count() // BLOCK_ROWS)))
    if blocks == 1:
        return []
    cuts = rows.agg(F.percentile_approx(order, [k / blocks for k in range(1, blocks)], 10 * blocks)).first()[0]
    return sorted(set(cuts or []))


def block_of(order: str, cuts: list) -> Column:
    """The number of a row's block; equal values of *order* share one, nulls are in the first."""
    if not cuts:
        return F.lit(0)
    at = F.array(*(F.lit(c) for c in cuts))
    return F.coalesce(F.when(F.col(order).isNull(), 0).otherwise(F.size(F.filter(at, lambda c: c < F.col(order)))), F.lit(0))


def running(rows: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[Running], blocks: int | None = None) -> DataFrame:
    """rows with the running values as columns.

    order: columns, the first a number, date or timestamp, which cuts the blocks; ties of all of them have no defined order.  Null keys
    are a key of their own.  Where there are no rows before, an exclusive value is null.  A block's rows go by one
    window, so blocks are the unit of work: blocks rows a key are carried, never rows."""
    cuts = bounds(rows, order[0], blocks)
    t = rows.withColumn("_block", block_of(order[0], cuts))
    for v in values:
        t = t.withColumn(f"_v_{v.name}", v.column)
    if not cuts:
        w = Window.partitionBy(*by).orderBy(*order)
        own = {v.name: v.of(F.col(f"_v_{v.name}")).over(w.rowsBetween(Window.unboundedPreceding, 0 if v.inclusive else -1)) for v in values}
        return t.withColumns(own).drop("_block", *(f"_v_{v.name}" for v in values))
    # the last of a block needs its order; the others are plain aggregates
    place = F.struct(*order)
    ends = [F.max_by(F.col(f"_v_{v.name}"), F.when(F.col(f"_v_{v.name}").isNotNull(), place)).alias(f"_c_{v.name}") if v.kind == "last" else v.of(F.col(f"_v_{v.name}")).alias(f"_c_{v.name}") for v in values]
    over = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = t.groupBy(*by, "_block").agg(*ends)
    carried = carried.select(*(F.col(c).alias(f"_k_{c}") for c in by), F.col("_block").alias("_k_block"), *(v.of(F.col(f"_c_{v.name}")).over(over).alias(f"_c_{v.name}") for v in values))
    same = F.col("_block") == F.col("_k_block")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    w = Window.partitionBy(*by, "_block").orderBy(*order)
    own = {f"_v_{v.name}": v.of(F.col(f"_v_{v.name}")).over(w.rowsBetween(Window.unboundedPreceding, 0 if v.inclusive else -1)) for v in values}
    met = t.join(carried, same, "left").withColumns(own)
    met = met.withColumns({v.name: v.both(F.col(f"_c_{v.name}"), F.col(f"_v_{v.name}")) for v in values})
    return met.drop("_block", "_k_block", *(f"_k_{c}" for c in by), *(f"_{x}_{v.name}" for v in values for x in "vc"))
