"""Usage totals, price look-up as of a day, exact decimal cost, merged time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import Running, running

# Usage kinds in order.
KINDS = ["INPUT_TOKENS", "CACHED_INPUT_TOKENS", "OUTPUT_TOKENS", "REASONING_TOKENS", "REQUESTS", "TOOL_CALLS"]


def usage_totals(usage: DataFrame, *by: str) -> DataFrame:
    """usage (by, kind, value, provenance): reported and estimated sums, and counts of unknown; sums that overflow are an error.

    Zero and not measured differ: a kind without a counter adds to not_measured of its rows' number of stages."""
    v = F.col("value")
    return usage.groupBy(*by, "kind").agg(
        F.sum(F.when(F.col("provenance") == "REPORTED", v)).alias("reported"),
        F.sum(F.when(F.col("provenance") == "ESTIMATED", v)).alias("estimated"),
        F.count_if(F.col("provenance") == "UNKNOWN").alias("unknown"),
        F.count_if(F.col("provenance").isNull()).alias("not_measured"),
    )


def completed(stages: DataFrame, usage: DataFrame, *key: str, kinds: list[str] = KINDS) -> DataFrame:
    """Each stage with every kind; provenance is null where a kind was not measured."""
    every = stages.select(*key).distinct().withColumn("kind", F.explode(F.array(*map(F.lit, kinds))))
    return every.join(usage, [*key, "kind"], "left")


def asof_price(stages: DataFrame, prices: DataFrame, at: str, *by: str) -> DataFrame:
    """stages with match FOUND / AMBIGUOUS / NONE, price_id and effective_date: the greatest up to the UTC day of *at*.

    Both sides are laid on one time line for each provider and model, and the last price day seen is carried forward: one
    shuffle of the stages and a running window, no range join.  A hot provider is cut by the year of its days; each year
    begins with the price that the years before leave."""
    days = prices.groupBy(*by, "effective_date").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id"))
    price = F.struct(F.col("effective_date").alias("d"), "n", "id")
    kinds = {"_p": days.select(price.alias("p")).schema["p"].dataType, "_row": stages.select(F.struct("*").alias("r")).schema["r"].dataType}
    none = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    line = lambda t, day, side, p, row: t.select(*by, day.alias("_day"), F.year(day).alias("_y"), F.lit(side).alias("_side"), p, row)
    p = line(days, F.col("effective_date"), 0, price.alias("_p"), none("_row"))
    s = line(stages, F.to_date(at), 1, none("_p"), F.struct("*").alias("_row"))
    last = p.groupBy(*by, "_y").agg(F.max("_p").alias("_p")).withColumnRenamed("_y", "_py")
    years = s.select(*by, "_y").distinct()
    opening = years.join(last, list(by)).where("_py < _y").groupBy(*by, "_y").agg(F.max("_p").alias("_p"))
    opening = opening.select(*by, F.make_date("_y", F.lit(1), F.lit(1)).alias("_day"), "_y", F.lit(-1).alias("_side"), "_p", none("_row"))
    w = Window.partitionBy(*by, "_y").orderBy("_day", "_side").rowsBetween(Window.unboundedPreceding, 0)
    got = p.unionByName(s).unionByName(opening).withColumn("_m", F.last("_p", ignorenulls=True).over(w)).where("_side = 1")
    m = F.col("_m")
    match = F.when(m["n"].isNull(), "NONE").when(m["n"] > 1, "AMBIGUOUS").otherwise("FOUND")
    return got.select("_row.*", m["d"].alias("effective_date"), match.alias("match"), F.when(m["n"] == 1, m["id"]).alias("price_id"))


def line_cost(units: Column, price: Column, unit_size: int) -> Column:
    """units * price / unit_size as DECIMAL(38,18), half to even; unit_size a power of ten."""
    scale = len(str(unit_size)) - 1
    if unit_size != 10**scale:
        raise ValueError("unit_size must be a power of ten")
    k = max(scale, 1)
    exact = price.cast("decimal(14,6)") * F.lit(f"{10**-scale:.{k}f}").cast(f"decimal({k + 1},{k})") * units.cast("decimal(15,0)")  # 38 digits at most: nothing is cut
    return F.bround(exact, 18).cast("decimal(38,18)")


def report(cost: Column) -> Column:
    return F.bround(cost, 6).cast("decimal(38,6)")


def billable(usage: DataFrame, lines: DataFrame, *key: str) -> DataFrame:
    """usage joined to its price lines, less what is included in each kind; provenance ESTIMATED if any part is.

    A kind whose included kinds aren't all measured gives no line; a negative rest is INCONSISTENT_USAGE."""
    u = usage.select(*key, "kind", "value", "provenance")
    own = lines.select(*key, "kind", "price", "unit_size", "included_in")
    t = own.join(u, [*key, "kind"], "left")
    child = t.where("included_in IS NOT NULL").groupBy(*key, F.col("included_in").alias("kind")).agg(F.sum("value").alias("_inc"), F.bool_and(F.coalesce(F.col("provenance").isin("REPORTED", "ESTIMATED"), F.lit(False))).alias("_all"), F.bool_or(F.col("provenance") == "ESTIMATED").alias("_est"))
    t = t.join(child, [*key, "kind"], "left")
    rest = F.col("value") - F.coalesce("_inc", F.lit(0))
    state = (
        F.when(F.col("provenance").isNull(), "MISSING_USAGE")
        .when(F.col("provenance") == "UNKNOWN", "UNKNOWN_USAGE")
        .when(~F.coalesce("_all", F.lit(True)), "INCLUDED_UNMEASURED")
        .when(rest < 0, "INCONSISTENT_USAGE")
        .otherwise("BILLED")
    )
    t = t.withColumn("state", state)
    return t.select(*key, "kind", F.when(F.col("state") == "BILLED", rest).alias("billable"), F.when(F.coalesce("_est", F.lit(False)), "ESTIMATED").otherwise(F.col("provenance")).alias("provenance"), "state", "price", "unit_size")


def cost_to_outcome(costs: DataFrame, *by: str) -> DataFrame:
    """(by, currency, cost, availability): AVAILABLE if all parts are covered, PARTIAL if some are, else UNAVAILABLE."""
    g = costs.groupBy(*by, "currency").agg(F.sum("cost").alias("cost"), F.bool_and("covered").alias("_all"), F.bool_or("covered").alias("_any"))
    return g.select(*by, "currency", "cost", F.when(F.col("_all"), "AVAILABLE").when(F.col("_any"), "PARTIAL").otherwise("UNAVAILABLE").alias("availability"))


def acceptance_cutoff(outcome_seq: Column, finish_seq: Column, evidence_seqs: Column, complete: Column) -> Column:
    """The latest sequence that acceptance rests on; null unless complete."""
    return F.when(complete, F.greatest(outcome_seq, finish_seq, F.array_max(evidence_seqs)))


def time_totals(intervals: DataFrame, *by: str, start: str = "started_at", end: str = "ended_at") -> DataFrame:
    """(by, effort, wall, active) in seconds: summed, from first to last, and the union of intervals, where touching ones merge."""
    s, e = F.unix_micros(F.col(start).cast("timestamp")), F.unix_micros(F.col(end).cast("timestamp"))
    t = intervals.select(*by, s.alias("s"), e.alias("e"))
    t = running(t, by, ["s", "e"], [Running("before", "max", F.col("e"), False)])
    # an interval adds what lies beyond all earlier ones
    t = t.withColumn("added", F.greatest(F.lit(0), F.col("e") - F.greatest("s", F.coalesce("before", "s"))))
    return t.groupBy(*by).agg((F.sum(F.col("e") - F.col("s")) / 1e6).alias("effort"), ((F.max("e") - F.min("s")) / 1e6).alias("wall"), (F.sum("added") / 1e6).alias("active"))


def acyclic(edges: dict[str, str | None]) -> bool:
    """Does following included_in end from every kind?"""
    for k in edges:
        seen = set()
        while k is not None:
            if k in seen:
                return False
            seen.add(k)
            k = edges.get(k)
    return True
