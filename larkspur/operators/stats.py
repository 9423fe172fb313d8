"""Latency statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nearest_rank(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean, sample deviation, and nearest-rank p50, p95 (20 samples at least) and p99 (100 at least)."""
    at = lambda p, n: F.when(F.col("n") >= n, F.col(f"_p{p}")).alias(f"p{p}")
    g = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("stddev"), F.min(value).alias("min"), F.max(value).alias("max"), *(F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {value})").alias(f"_p{p}") for p in (50, 95, 99)))
    return g.select(*by, "n", "mean", "stddev", "min", "max", at(50, 1), at(95, 20), at(99, 100))


def scale_timing(rows: DataFrame, nanos: str, *by: str) -> DataFrame:
    """n, integer median (mean of the middles), p95 at index ceil(0.95 n) - 1, integer mean, queries a second."""
    g = rows.groupBy(*by).agg(F.count(nanos).alias("n"), F.floor(F.percentile(nanos, F.lit(0.5))).cast("long").alias("median"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {nanos})").cast("long").alias("p95"), F.floor(F.sum(nanos) / F.count(nanos)).cast("long").alias("mean"))
    return g.withColumn("qps", F.lit(1e9) / F.col("mean"))


def summary(rows: DataFrame, value: str, scanned: str, *by: str) -> DataFrame:
    """min, max, integer mean, and totals scanned."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.floor(F.sum(value) / F.count("*")).cast("long").alias("avg"), F.sum(scanned).alias("scanned"))
