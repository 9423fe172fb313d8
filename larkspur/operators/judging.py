"""What judged rankings say: by partition and category, under old and new judgments, by speech group, and what was missed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .fusion import EPS, outcome
from .metrics import averages


def partitions(per: DataFrame, split: str = "split", category: str = "category") -> DataFrame:
    """(grouping, value, queries, answerable, averages over answerable queries, abstained, confounded, unjudged).

    per: metrics of each query with split, category, answerable, returned, confounders and unjudged (results of either kind).
    ALL, each split and each category, as grouping sets; metrics count answerable queries only, abstention the others."""
    names = [c for c in per.columns if c.startswith(("p_at_", "r_at_", "hit_at_")) or c == "rr"]
    sets = F.explode(F.array(*(F.struct(F.lit(g).alias("grouping"), v.alias("value")) for g, v in (("ALL", F.lit("")), ("split", F.col(split).cast("string")), ("category", F.col(category).cast("string"))))))
    t = per.withColumn("_g", sets).select("*", "_g.grouping", "_g.value")
    return t.groupBy("grouping", "value").agg(
        F.count("*").alias("queries"),
        F.count_if("answerable").alias("answerable"),
        *(F.avg(F.when(F.col("answerable"), F.col(c))).alias(f"avg_{c}" if c != "rr" else "mrr") for c in names),
        F.count_if(~F.col("answerable") & (F.col("returned") == 0)).alias("abstained"),
        F.sum("confounders").alias("confounders"),
        F.sum("unjudged").alias("unjudged"),
    )


def bounds(hits: DataFrame, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """(query_id, hit_at_k, upper_hit_at_k, rr, upper_rr) of hits (query_id, rank, judgment): as judged, and if every result
    without a judgment (U) were relevant."""
    sure, may = F.col("judgment").startswith("E"), F.col("judgment").startswith("E") | (F.col("judgment") == "U")
    cols = []
    for name, rel in (("", sure), ("upper_", may)):
        cols += [F.max(F.when(rel & (F.col("rank") <= k), 1).otherwise(0)).alias(f"{name}hit_at_{k}") for k in ks]
        cols.append(F.coalesce(1.0 / F.min(F.when(rel, F.col("rank"))), F.lit(0.0)).alias(f"{name}rr"))
    return hits.groupBy("query_id").agg(*cols)


def hubs(hits: DataFrame, queries: DataFrame, cuts: Sequence[int] = (1, 3, 10)) -> DataFrame:
    """(partition, cut, queries, zero_hit, occurrences, atoms, top1_no_answer) of hits (query_id, rank, atom_id) for queries
    (query_id, partition, answerable): how far few atoms fill the results of a partition."""
    grid = F.explode(F.array(*map(F.lit, cuts))).alias("cut")
    q = queries.select("query_id", "partition", "answerable", grid)
    h = hits.select("query_id", "rank", "atom_id")
    t = q.join(h, "query_id", "left").withColumn("_in", F.coalesce(F.col("rank") <= F.col("cut"), F.lit(False)))
    per = t.groupBy("partition", "cut", "query_id").agg(F.count_if("_in").alias("_n"), F.bool_or(F.col("_in") & (F.col("rank") == 1) & ~F.col("answerable")).alias("_top"))
    a = per.groupBy("partition", "cut").agg(F.count("*").alias("queries"), F.count_if(F.col("_n") == 0).alias("zero_hit"), F.sum("_n").alias("occurrences"), F.count_if("_top").alias("top1_no_answer"))
    b = t.where("_in").groupBy("partition", "cut").agg(F.count_distinct("atom_id").alias("atoms"))
    return a.join(b, ["partition", "cut"], "left").withColumn("atoms", F.coalesce("atoms", F.lit(0)))


def speech_metrics(per: DataFrame, *groups: str) -> DataFrame:
    """(grouping, value, queries, averages, mrr) overall and by each group column, for metrics of each speech query."""
    sets = F.explode(F.array(F.struct(F.lit("ALL").alias("grouping"), F.lit("").alias("value")), *(F.struct(F.lit(g).alias("grouping"), F.coalesce(F.col(g).cast("string"), F.lit("UNKNOWN")).alias("value")) for g in groups)))
    t = per.withColumn("_g", sets).select("*", "_g.grouping", "_g.value")
    return averages(t, "grouping", "value")


def hybrid_summary(rows: DataFrame, metric: str = "rr") -> DataFrame:
    """(profile, queries, mean, control, delta, wins, maintained, regressed, lost_hits, promising) of rows (profile, query_id,
    hybrid and control values of the metric, hybrid_hit, control_hit): promising gains on the whole and loses no hit."""
    o = outcome(F.col("control"), F.col("hybrid"))
    g = rows.groupBy("profile").agg(
        F.count("*").alias("queries"),
        F.avg("hybrid").alias("mean"),
        F.avg("control").alias("control"),
        F.count_if(o == "WIN").alias("wins"),
        F.count_if(o == "MAINTAIN").alias("maintained"),
        F.count_if(o == "REGRESS").alias("regressed"),
        F.count_if(F.col("control_hit") & ~F.col("hybrid_hit")).alias("lost_hits"),
    )
    return g.withColumn("delta", F.col("mean") - F.col("control")).withColumn("promising", (F.col("delta") > EPS) & (F.col("lost_hits") == 0))


def missed(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, label): relevant labels that aren't among the k best."""
    return relevant.select("query_id", "label").distinct().join(ranked.where(F.col("rank") <= k).select("query_id", "label").distinct(), ["query_id", "label"], "left_anti")


def full_rank(scored: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (query_id, label) with rank and score among all of scored (query_id, label, score), null where it has no score.

    A rank is the count of better ones, so no query's whole ranking has to be sorted in one task: candidates are counted
    against the query's wanted scores."""
    w = wanted.select("query_id", "label").join(scored.select("query_id", "label", "score"), ["query_id", "label"], "left")
    asked = w.where("score IS NOT NULL").groupBy("query_id").agg(F.collect_list(F.struct(F.col("score").alias("s"), F.col("label").alias("l"))).alias("_w"))
    better = F.explode(F.filter("_w", lambda x: (F.col("score") > x["s"]) | ((F.col("score") == x["s"]) & (F.col("label") < x["l"])))).alias("x")
    n = scored.select("query_id", "label", "score").join(asked, "query_id").select("query_id", better).groupBy("query_id", F.col("x.l").alias("label")).agg(F.count("*").alias("_n"))
    return w.join(n, ["query_id", "label"], "left").withColumn("rank", F.when(F.col("score").isNotNull(), F.coalesce("_n", F.lit(0)) + 1)).drop("_n")


def overlap(query: Column, atom: Column, lexicon: text.Lexicon = text.Lexicon()) -> Column:
    """Terms that a query and an atom share once both are normalised, in order."""
    return F.array_sort(F.array_intersect(text.normalized_tokens(query, lexicon), text.normalized_tokens(atom, lexicon)))


def strata(hits: DataFrame, hubs: DataFrame, sample: int, seed: str) -> DataFrame:
    """(query_id, key, stratum, rank) of unjudged hits to be judged, each once: of every query its best (TOP1), then what is
    left of its ranks to 3 (TOP3), of hub atoms the best remaining (HUB), and a seeded sample of the rest (SAMPLE)."""
    by = Window.partitionBy("query_id")
    best = F.row_number().over(by.orderBy("rank", "key"))
    t = hits.withColumn("_b", best).join(hubs.select("key").distinct().withColumn("_hub", F.lit(True)), "key", "left")
    t = t.withColumn("_s", F.when(F.col("_b") == 1, "TOP1").when(F.col("rank") <= 3, "TOP3"))
    hub = F.row_number().over(Window.partitionBy("query_id", F.col("_s").isNull() & F.coalesce("_hub", F.lit(False))).orderBy("rank", "key"))
    t = t.withColumn("_s", F.when(F.col("_s").isNull() & F.coalesce("_hub", F.lit(False)) & (hub == 1), "HUB").otherwise(F.col("_s")))
    drawn = F.row_number().over(Window.partitionBy("query_id", F.col("_s").isNull()).orderBy(F.sha2(F.concat_ws(":", F.lit(seed), F.col("query_id").cast("string"), F.col("key").cast("string")), 256)))
    t = t.withColumn("stratum", F.when(F.col("_s").isNull() & (drawn <= sample), "SAMPLE").otherwise(F.col("_s")))
    return t.where("stratum IS NOT NULL").select("query_id", "key", "stratum", "rank")


def feedback_plan(judgments: DataFrame, queries: DataFrame, delta: float = 0.5) -> DataFrame:
    """(query_id, key, signal, delta) from the judgments of DEV queries only: evidence is lifted, confounders are lowered, and a
    key that is both for one query is left alone."""
    dev = judgments.join(queries.where("split = 'DEV'").select("query_id"), "query_id", "left_semi")
    g = dev.groupBy("query_id", "key").agg(F.bool_or((F.col("role") == "EVIDENCE") & (F.col("grade") > 0)).alias("_e"), F.bool_or(F.col("role") == "CONFOUNDER").alias("_c")).where("_e <> _c")
    return g.select("query_id", "key", F.when(F.col("_e"), "POSITIVE").otherwise("NEGATIVE").alias("signal"), F.when(F.col("_e"), delta).otherwise(-delta).alias("delta"))


def effect(before: Column, after: Column, worse_elsewhere: Column) -> Column:
    """What an expansion did to a query: by its first relevant rank, and whether another relevant result fell."""
    far = F.lit(2147483647)
    b, a = F.coalesce(before, far), F.coalesce(after, far)
    return F.when(before.isNull() & after.isNull(), "NOT_SCORED").when((a < b) & worse_elsewhere, "MIXED").when(a < b, "IMPROVED").when((a > b) | worse_elsewhere, "REGRESSED").otherwise("UNCHANGED")


def ranking_shift(before: DataFrame, after: DataFrame, k: int) -> DataFrame:
    """(query_id, kept, entered, left, moved) of two rankings' k best: how a larger corpus or another index changes them."""
    b, a = (t.where(F.col("rank") <= k).select("query_id", "atom_id", F.col("rank").alias(n)) for t, n in ((before, "_b"), (after, "_a")))
    t = b.join(a, ["query_id", "atom_id"], "full")
    both = F.col("_b").isNotNull() & F.col("_a").isNotNull()
    return t.groupBy("query_id").agg(F.count_if(both).alias("kept"), F.count_if(F.col("_b").isNull()).alias("entered"), F.count_if(F.col("_a").isNull()).alias("left"), F.count_if(both & (F.col("_a") != F.col("_b"))).alias("moved"))
