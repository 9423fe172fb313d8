"""Retrieval metrics, comparison of rankings and classes of failure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-12


def judged(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """ranked (query_id, rank, label) with rel, 1 where (query_id, label) is relevant."""
    r = relevant.select("query_id", "label").distinct().withColumn("rel", F.lit(1))
    return ranked.join(r, ["query_id", "label"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def per_query(ranked: DataFrame, relevant: DataFrame, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """p_at_k, r_at_k, hit_at_k, rr, first_rank and n_relevant of every query that has relevant labels.

    Precision divides by k however few results there are and counts repeats; recall counts distinct labels."""
    n = relevant.select("query_id", "label").distinct().groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    return from_judged(judged(ranked, relevant), n, ks)


def from_judged(j: DataFrame, n: DataFrame, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """The same from j (query_id, rank, label, rel) and n (query_id, n_relevant)."""
    aggs = []
    for k in ks:
        top = (F.col("rank") <= k) & (F.col("rel") == 1)
        aggs += [F.count_if(top).alias(f"_p{k}"), F.count_distinct(F.when(top, F.col("label"))).alias(f"_r{k}")]
    g = j.groupBy("query_id").agg(*aggs, F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first_rank"), F.count("*").alias("n_returned"))
    out = n.join(g, "query_id", "left")
    cols: list[Column] = [F.col("query_id"), F.col("n_relevant"), F.coalesce("n_returned", F.lit(0)).alias("n_returned"), F.col("first_rank")]
    for k in ks:
        cols += [
            (F.coalesce(f"_p{k}", F.lit(0)) / F.lit(float(k))).alias(f"p_at_{k}"),
            (F.coalesce(f"_r{k}", F.lit(0)) / F.col("n_relevant")).alias(f"r_at_{k}"),
            F.when(F.coalesce(f"_p{k}", F.lit(0)) > 0, 1.0).otherwise(0.0).alias(f"hit_at_{k}"),
        ]
    cols.append(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("rr"))
    return out.select(*cols)


def averages(per: DataFrame, *by: str) -> DataFrame:
    names = [c for c in per.columns if c.startswith(("p_at_", "r_at_", "hit_at_"))]
    return per.groupBy(*by).agg(F.count("*").alias("queries"), *(F.avg(c).alias(f"avg_{c}") for c in names), F.avg("rr").alias("mrr"))


def ranking_change(before: DataFrame, after: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query_id, before_rank, after_rank, change): IMPROVED / DEGRADED / MAINTAINED by the first relevant rank."""
    return change_of_judged(judged(before, relevant), judged(after, relevant), relevant.select("query_id").distinct())


def change_of_judged(before: DataFrame, after: DataFrame, q: DataFrame) -> DataFrame:
    """The same from rankings with rel and the queries that count."""
    first = lambda r, n: r.groupBy("query_id").agg(F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias(n))
    t = q.join(first(before, "before_rank"), "query_id", "left").join(first(after, "after_rank"), "query_id", "left")
    far = F.lit(2147483647)
    b, a = F.coalesce("before_rank", far), F.coalesce("after_rank", far)
    return t.withColumn("change", F.when(a < b, "IMPROVED").when(a > b, "DEGRADED").otherwise("MAINTAINED"))


def aggregate_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: the change of mean reciprocal rank, Hit@1, Recall@3 and Recall@5; any that degrades decides."""
    names = ["mrr", "avg_hit_at_1", "avg_r_at_3", "avg_r_at_5"]
    t = before.select(*(F.col(n).alias(f"b_{n}") for n in names)).crossJoin(after.select(*(F.col(n).alias(f"a_{n}") for n in names)))
    diff = [F.col(f"a_{n}") - F.col(f"b_{n}") for n in names]
    worse, better = F.lit(False), F.lit(False)
    for d in diff:
        worse, better = worse | (d < -EPS), better | (d > EPS)
    return t.select(*(d.alias(f"delta_{n}") for d, n in zip(diff, names, strict=True)), F.when(worse, "DEGRADED").when(better, "IMPROVED").otherwise("MAINTAINED").alias("change"))


def failure_class(per: DataFrame, gap: Column, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """Adds failure (null where the query succeeds), by rules in order."""
    k = max(ks)
    hit1 = F.col("hit_at_1") if 1 in ks else F.when(F.col("first_rank") == 1, 1.0).otherwise(0.0)
    full = (F.col("n_relevant") <= 1) | (F.col(f"r_at_{k}") >= 1 - EPS)
    first = F.col("first_rank")
    rule = (
        F.when((hit1 >= 1 - EPS) & full, F.lit(None).cast("string"))
        .when((F.col(f"hit_at_{k}") < EPS) & gap, "POSSIBLE_DATASET_ALIAS_GAP")
        .when(F.col(f"hit_at_{k}") < EPS, "MISSING_EXPECTED_ATOM")
        .when((F.col("n_relevant") > 1) & (F.col(f"r_at_{k}") < 1 - EPS), "MULTI_RELEVANT_RECALL_GAP")
        .when(first == 2, "CONFUSABLE_ATOM_RANKED_HIGHER")
        .when(first >= 3, "EXPECTED_ATOM_PRESENT_BUT_LOW_RANK")
        .otherwise("POSSIBLE_ENCODER_LIMITATION")
    )
    return per.withColumn("failure", rule)


def grouped(per: DataFrame, *groups: str) -> DataFrame:
    """Averages over all queries and for each value of each group column (grouping sets), as (grouping, value, ...)."""
    own = averages(per.withColumn("grouping", F.lit("ALL")).withColumn("value", F.lit("")), "grouping", "value")
    exploded = per.withColumn("g", F.explode(F.array(*(F.struct(F.lit(g).alias("grouping"), F.col(g).cast("string").alias("value")) for g in groups)))).select("*", "g.grouping", "g.value")
    return own.unionByName(averages(exploded, "grouping", "value"))


def threshold_curve(best: DataFrame, grid: Sequence[float]) -> DataFrame:
    """best: (query_id, answerable, top_score, first_relevant_score).  Per threshold: negatives whose top hit passes, and
    answerable queries whose first relevant hit does."""
    g = F.explode(F.array(*map(F.lit, grid))).alias("threshold")
    t = best.select("*", g)
    return t.groupBy("threshold").agg(F.count_if(~F.col("answerable") & (F.col("top_score") >= F.col("threshold"))).alias("false_positives"), F.count_if(F.col("answerable") & (F.col("first_relevant_score") >= F.col("threshold"))).alias("kept"))


def label_transitions(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """(before, after, n): how judgments moved; unjudged is U."""
    b, a = before.select(*keys, F.col("label").alias("before")), after.select(*keys, F.col("label").alias("after"))
    return b.join(a, list(keys), "full").select(F.coalesce("before", F.lit("U")).alias("before"), F.coalesce("after", F.lit("U")).alias("after")).groupBy("before", "after").agg(F.count("*").alias("n"))


def judgment_label(hits: DataFrame, judgments: DataFrame, *keys: str) -> DataFrame:
    """Label of each hit by its strongest judgment: E and the greatest grade of evidence, C0 for a confounder, U for none."""
    j = judgments.groupBy(*keys).agg(F.max(F.when(F.col("role") == "EVIDENCE", F.col("grade"))).alias("grade"), F.bool_or(F.col("role") != "EVIDENCE").alias("confounder"))
    g = F.col("grade")
    return hits.join(j, list(keys), "left").withColumn("judgment", F.when(g > 0, F.concat(F.lit("E"), g.cast("string"))).when(F.col("confounder"), "C0").otherwise("U"))


def hub_concentration(hits: DataFrame, cuts: Sequence[int] = (1, 3, 10), atom: str = "atom_id") -> DataFrame:
    """(cut, occurrences, atoms, queries, top_atom_share) of the results within each cut."""
    t = hits.select("query_id", atom, F.explode(F.expr(f"filter(array({','.join(map(str, cuts))}), c -> c >= rank)")).alias("cut"))
    by = t.groupBy("cut", atom).agg(F.count("*").alias("n"))
    q = t.groupBy("cut").agg(F.count_distinct("query_id").alias("queries"))
    return by.groupBy("cut").agg(F.sum("n").alias("occurrences"), F.count("*").alias("atoms"), (F.max("n") / F.sum("n")).alias("top_atom_share")).join(q, "cut")


def jaccard(a: DataFrame, b: DataFrame, k: int, item: str = "atom_id") -> DataFrame:
    """(query_id, jaccard) of two rankings' k best; 1 where both are empty."""
    x = a.where(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set(item).alias("x"))
    y = b.where(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set(item).alias("y"))
    none = F.array().cast(dict(x.dtypes)["x"])
    t = x.join(y, "query_id", "full").select("query_id", F.coalesce("x", none).alias("x"), F.coalesce("y", none).alias("y"))
    union = F.size(F.array_union("x", "y"))
    return t.select("query_id", F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("x", "y")) / union).alias("jaccard"))


def stress_reason(first_rank: Column, best_score: Column, deepest: int, n_relevant: Column, found: Column) -> Column:
    """Why a stress query isn't resolved, by rules in order.  found: relevant ones within *deepest* and above zero."""
    return (
        F.when(first_rank.isNull(), "NOT_RETRIEVED")
        .when(best_score == 0, "ZERO_SIMILARITY_ONLY")
        .when(first_rank > deepest, "NOT_IN_TOP_K")
        .when(first_rank > 1, "OUTRANKED")
        .when(found < n_relevant, "PARTIAL_RECALL")
        .otherwise("RESOLVED")
    )


def key_transfer(expected_relevant: Column, key_matched: Column, moved: Column) -> Column:
    """Did feedback of one query reach another as it should?"""
    return F.when(~key_matched, "ISOLATED_NO_TRANSFER").when(expected_relevant, "INTENDED_TRANSFER").when(moved, "CONTAMINATION").otherwise("SHARED_KEY_NO_MOVEMENT")


def normalized_stress(equivalent: Column, key_matched: Column, moved: Column) -> Column:
    """Class of a stress pair under normalized keys; equivalent texts must share a key."""
    broken = F.raise_error(F.lit("equivalent stress pairs must share a key")).cast("string")
    return (
        F.when(equivalent & ~key_matched, broken)
        .when(equivalent, "SAFE_EQUIVALENT_SHARING")
        .when(~key_matched, "SAFE_ISOLATION")
        .when(moved, "CONTAMINATION")
        .otherwise("COLLISION_WITHOUT_MOVEMENT")
    )


def stress_decision(cases: DataFrame, *by: str) -> DataFrame:
    """One row, or one for each group, of cases (relationship, key_matched, moved): any distinct pair with one key is a risk; a pass needs every
    equivalent pair to share its key and one of them to move."""
    equal = F.col("relationship") == "EQUIVALENT"
    g = cases.groupBy(*by).agg(F.bool_or((F.col("relationship") == "DISTINCT") & F.col("key_matched")).alias("risk"), F.bool_and(~equal | F.col("key_matched")).alias("shared"), F.bool_or(equal & F.col("moved")).alias("moved"))
    return g.select(*by, F.when(F.col("risk"), "NORMALIZED_STRESS_RISK").when(F.col("shared") & F.col("moved"), "NORMALIZED_STRESS_PASS").otherwise("INCONCLUSIVE").alias("decision"))


def book_failure(ranked: DataFrame, judgments: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, failure) by rules in order.

    ranked (query_id, rank, key, ordinal), judgments (query_id, key, ordinal, grade, role), queries (query_id, answerable)."""
    ev = judgments.where("role = 'EVIDENCE' AND grade > 0").select("query_id", "key", "ordinal").distinct()
    conf = judgments.where("role = 'CONFOUNDER' OR grade = 0").select("query_id", "key").distinct().withColumn("_c", F.lit(True))
    near = ev.select("query_id", F.explode(F.array(F.col("ordinal") - 1, F.col("ordinal") + 1)).alias("ordinal")).distinct().withColumn("_n", F.lit(True))
    t = ranked.join(ev.select("query_id", "key").distinct().withColumn("_e", F.lit(True)), ["query_id", "key"], "left").join(conf, ["query_id", "key"], "left").join(near, ["query_id", "ordinal"], "left")
    at = lambda c: F.min(F.when(F.col(c), F.col("rank"))).alias(c)
    g = t.groupBy("query_id").agg(F.count("*").alias("n"), at("_e"), at("_c"), at("_n"), F.count_distinct(F.when(F.col("_e"), F.col("key"))).alias("found"))
    want = ev.groupBy("query_id").agg(F.count_distinct("key").alias("want"))
    q = queries.join(g, "query_id", "left").join(want, "query_id", "left")
    first = F.col("_e")
    rule = (
        F.when(~F.col("answerable") & F.coalesce(F.col("n") > 0, F.lit(False)), "FALSE_POSITIVE")
        .when(~F.col("answerable"), "ABSTAINED")
        .when(first.isNull(), "NO_RELEVANT_RESULT")
        .when(F.col("_c") < first, "DISTRACTOR")
        .when(F.col("_n") < first, "CHUNK_BOUNDARY_GAP")
        .when(first > 1, "WRONG_RANK")
        .when(F.col("found") == F.col("want"), "NONE")
        .otherwise("MULTI_EVIDENCE_GAP")
    )
    return q.select("query_id", rule.alias("failure"))


def stratified(rows: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """The n rows of each stratum that come first by SHA-256 of seed and key."""
    r = F.row_number().over(Window.partitionBy(stratum).orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), key))
    return rows.withColumn("pick", r).where(F.col("pick") <= n)


def baseline_check(metrics: DataFrame, expected: DataFrame) -> DataFrame:
    """metrics (name, value) against expected (name, mode EXACT or MINIMUM, expected, tolerance): ok per name."""
    v, e, t = F.col("value"), F.col("expected"), F.col("tolerance")
    ok = F.when(F.col("mode") == "EXACT", F.abs(v - e) <= t).otherwise(v >= e - t)
    return expected.join(metrics, "name", "left").withColumn("ok", F.coalesce(ok, F.lit(False)))
