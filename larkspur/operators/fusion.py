"""Two-modality retrieval: normalisation, fusion, missing modalities, disagreement, metadata filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-12


def min_max(scores: DataFrame, *by: str, score: str = "score") -> DataFrame:
    """Adds normalized, 0 to 1 within *by*; all 0 and status CONSTANT_NO_DISCRIMINATION where the scores are alike."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    t = scores.withColumn("_lo", lo).withColumn("_hi", hi)
    return t.withColumn("normalized", F.when(F.col("_hi") == F.col("_lo"), 0.0).otherwise((F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))).withColumn("status", F.when(F.col("_hi") == F.col("_lo"), "CONSTANT_NO_DISCRIMINATION").otherwise("MIN_MAX")).drop("_lo", "_hi")


def aligned(corpus: DataFrame, transcript: DataFrame, acoustic: DataFrame) -> DataFrame:
    """(query_id, sample_id, t, a, availability): every sample of the corpus for every query, with both normalized scores."""
    t = transcript.select("query_id", "sample_id", F.col("normalized").alias("t"))
    a = acoustic.select("query_id", "sample_id", F.col("normalized").alias("a"))
    both = t.join(a, ["query_id", "sample_id"], "full")
    out = corpus.join(both, ["query_id", "sample_id"], "left")
    has_t, has_a = F.col("t").isNotNull(), F.col("a").isNotNull()
    return out.withColumn("availability", F.when(has_t & has_a, "BOTH_AVAILABLE").when(has_t, "ACOUSTIC_FEATURE_MISSING").when(has_a, "TRANSCRIPT_MISSING").otherwise("BOTH_MISSING"))


def ranked(rows: DataFrame, *by: str, score: str = "score", item: str = "sample_id") -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), item)))


def fused(al: DataFrame, weights: Sequence[tuple[str, float, float]], partial: bool = False) -> DataFrame:
    """(profile, query_id, sample_id, score, rank): weighted sums where both scores exist; with *partial* a single score counts alone."""
    w = F.explode(F.array(*(F.struct(F.lit(n).alias("profile"), F.lit(x).alias("wt"), F.lit(y).alias("wa")) for n, x, y in weights))).alias("w")
    t = al.select("*", w).select("query_id", "sample_id", "w.profile", "availability", F.when(F.col("availability") == "BOTH_AVAILABLE", F.col("w.wt") * F.col("t") + F.col("w.wa") * F.col("a")).otherwise(F.coalesce("t", "a") if partial else F.lit(None).cast("double")).alias("score"))
    return ranked(t.where("score IS NOT NULL"), "profile", "query_id").select("profile", "query_id", "sample_id", "score", "rank")


def routes(al: DataFrame) -> DataFrame:
    """(query_id, route) under ABSTAIN_ON_PARTIAL: fuse complete queries, defer to a complete modality, else abstain."""
    s = al.where("availability <> 'BOTH_MISSING'").groupBy("query_id").agg(F.bool_and(F.col("availability") == "BOTH_AVAILABLE").alias("both"), F.bool_and(F.col("t").isNotNull()).alias("tc"), F.bool_and(F.col("a").isNotNull()).alias("ac"))
    q = al.select("query_id").distinct().join(s, "query_id", "left")
    return q.select("query_id", F.when(F.col("both"), "FUSED").when(F.col("tc"), "DEFERRED_TO_TRANSCRIPT").when(F.col("ac"), "DEFERRED_TO_ACOUSTIC").otherwise("ABSTAINED").alias("route"))


def missing_policy(al: DataFrame, policy: str, wt: float, wa: float) -> DataFrame:
    """(query_id, sample_id, score, rank, route) under BOTH_REQUIRED, AVAILABLE_MODALITY_ONLY or ABSTAIN_ON_PARTIAL."""
    if policy != "ABSTAIN_ON_PARTIAL":
        return fused(al, [(policy, wt, wa)], policy == "AVAILABLE_MODALITY_ONLY").select("query_id", "sample_id", "score", "rank", F.lit("FUSED").alias("route"))
    t = al.join(routes(al), "query_id")
    score = F.when(F.col("route") == "FUSED", wt * F.col("t") + wa * F.col("a")).when(F.col("route") == "DEFERRED_TO_TRANSCRIPT", F.col("t")).when(F.col("route") == "DEFERRED_TO_ACOUSTIC", F.col("a"))
    return ranked(t.withColumn("score", score).where("score IS NOT NULL"), "query_id").select("query_id", "sample_id", "score", "rank", "route")


def failed_filters(**wanted: tuple[Column, str | None]) -> Column:
    """Names of the filters that a row fails; a filter without a value passes all."""
    return F.array_compact(F.array(*(F.when(F.lit(v is not None) & ~F.coalesce(c == F.lit(v), F.lit(False)), F.lit(n)) for n, (c, v) in wanted.items())))


def outcome(before: Column, after: Column) -> Column:
    """WIN, MAINTAIN or REGRESS of a metric, within 1e-12."""
    return F.when(after - before > EPS, "WIN").when(before - after > EPS, "REGRESS").otherwise("MAINTAIN")


def modality_outcome(transcript_hit: Column, acoustic_hit: Column) -> Column:
    return F.when(transcript_hit & acoustic_hit, "BOTH_SUCCEED").when(transcript_hit, "TRANSCRIPT_ONLY").when(acoustic_hit, "ACOUSTIC_ONLY").otherwise("BOTH_FAIL")


# Modality outcome, then what the fused ranking makes of it where it hits and where it misses.
DISAGREEMENT = [
    ("BOTH_SUCCEED", "BOTH_SUCCEED_RETAINED", "LOST_BOTH_SUCCEED"),
    ("TRANSCRIPT_ONLY", "RECOVERED_ACOUSTIC_MISS", "LOST_TRANSCRIPT_WIN"),
    ("ACOUSTIC_ONLY", "RECOVERED_TRANSCRIPT_MISS", "LOST_ACOUSTIC_WIN"),
    ("BOTH_FAIL", "RECOVERED_BOTH_MISS", "BOTH_MISS_RETAINED"),
]


def disagreement(outcome: Column, hybrid_hit: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, hit, miss in DISAGREEMENT:
        out = F.when(outcome == name, F.when(hybrid_hit, hit).otherwise(miss)).otherwise(out)
    return out


def diagnostics(rank: DataFrame, *by: str, score: str = "score", item: str = "sample_id") -> DataFrame:
    """(by, results, min, mean, max, ties, top_gap) of a ranking's scores."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), item)
    t = rank.withColumn("_prev", F.lag(score).over(w)).withColumn("_r", F.row_number().over(w))
    return t.groupBy(*by).agg(F.count("*").alias("results"), F.min(score).alias("min_score"), F.avg(score).alias("mean_score"), F.max(score).alias("max_score"), F.count_if(F.col("_prev") == F.col(score)).alias("ties"), F.max(F.when(F.col("_r") == 2, F.col("_prev") - F.col(score))).alias("top_gap"))


def candidate_status(sample: Column, dims: Column, wanted: Column, failed: Column) -> Column:
    """What becomes of a stored vector: by rules in order.  failed: names of the filters that its sample fails."""
    return F.when(sample.isNull(), "ORPHAN_VECTOR").when(dims != wanted, "INCOMPATIBLE_DIMENSIONS").when(F.size(failed) > 0, "METADATA_FILTERED").otherwise("SCORED")


def retrieval_status(sample: Column, candidate: Column, rank: Column, k: int) -> Column:
    """What became of a relevant sample, from its candidate_status() (null without a vector) and its rank."""
    return F.when(sample.isNull(), "MISSING_SAMPLE").when(candidate.isNull(), "MISSING_VECTOR").when(candidate != "SCORED", candidate).when(rank <= k, "RETRIEVED_AT_K").otherwise("SCORED_BELOW_K")
