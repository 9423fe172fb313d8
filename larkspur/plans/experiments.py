"""Experiment drivers: profiles, feedback arms, key strategies, sweeps and parity, as compositions of the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import metrics, recall


@dataclass(frozen=True)
class Profile:
    """How texts are encoded and queries keyed."""

    name: str
    lexicon: text.Lexicon | None = text.Lexicon()
    key: Callable[[Column], Column] | None = None


# The presets' names.
RAW = Profile("RAW", None)
LEXICAL_ENRICHED = Profile("LEXICAL_ENRICHED")
LEXICAL_ENRICHED_FEEDBACK = Profile("LEXICAL_ENRICHED_FEEDBACK", key=text.exact_key)
LEXICAL_FEEDBACK_KEY = Profile("LEXICAL_ENRICHED_LEXICAL_FEEDBACK_KEY", key=text.lexical_key)


def run_profiles(atoms: DataFrame, queries: DataFrame, relevant: DataFrame, profiles: Sequence[Profile], k: int = 10) -> DataFrame:
    """(profile, queries, averages, mrr) of each profile over the same atoms and judged queries; K = k, no threshold."""
    out = None
    for p in profiles:
        ranked = recall.recall(atoms, queries, k, None, p.lexicon, 6).withColumnRenamed("atom_id", "label")
        rows = metrics.averages(metrics.per_query(ranked, relevant)).withColumn("profile", F.lit(p.name))
        out = rows if out is None else out.unionByName(rows)
    return out


def feedback_arms(pool: DataFrame, arms: dict[str, DataFrame], relevant: DataFrame, k: int, threshold: float) -> DataFrame:
    """(arm, query_id, before_rank, after_rank, change) of each feedback log against none."""
    none = pool.where(F.col("score") >= threshold).withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, atom_id)")).where(F.col("rank") <= k)
    base = none.select("query_id", "rank", F.col("atom_id").alias("label"))
    out = None
    for name, log in arms.items():
        after = recall.rerank(pool, recall.adjustments(log), k, threshold).select("query_id", "rank", F.col("atom_id").alias("label"))
        rows = metrics.ranking_change(base, after, relevant).withColumn("arm", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def key_strategies(pairs: DataFrame) -> DataFrame:
    """pairs (id, seed, query): whether each key strategy gives both texts one key."""
    same = {"exact": text.exact_key, "normalized": text.normalized_key, "lexical": text.lexical_key}
    return pairs.select("id", *((f(F.col("seed")) == f(F.col("query"))).alias(f"{n}_match") for n, f in same.items()))


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two results has; none if they agree."""
    return a.exceptAll(b).withColumn("side", F.lit("LEFT")).unionByName(b.exceptAll(a).withColumn("side", F.lit("RIGHT")))


def sweep_findings(ranked: DataFrame, grid: Sequence[float], k: int) -> DataFrame:
    """(query_id, threshold, finding): thresholds whose retained results aren't a prefix of the ranking, or grow with the threshold."""
    t = ranked.where(F.col("rank") <= k).select("query_id", "rank", "score", F.explode(F.array(*map(F.lit, sorted(grid)))).alias("threshold"))
    g = t.groupBy("query_id", "threshold").agg(F.count_if(F.col("score") >= F.col("threshold")).alias("n"), F.max(F.when(F.col("score") >= F.col("threshold"), F.col("rank"))).alias("last"))
    more = F.expr("lag(n) OVER (PARTITION BY query_id ORDER BY threshold)")
    g = g.withColumn("before", more)
    finding = F.when(F.coalesce("last", F.lit(0)) != F.col("n"), "NOT_A_PREFIX").when(F.col("n") > F.col("before"), "NOT_MONOTONIC")
    return g.withColumn("finding", finding).where("finding IS NOT NULL").select("query_id", "threshold", "finding")


def term_contributions(atoms: DataFrame, key: str, content: Column, aliases: Column, first: int) -> DataFrame:
    """(key, source, term, weight, occurrences, total, place): what each term adds to an atom, the first *first* of each."""
    t = atoms.select(key, F.explode(text.weighted_atom(content, aliases)).alias("w")).select(key, "w.source", F.col("w.token").alias("term"), "w.weight")
    g = t.groupBy(key, "source", "term", "weight").agg(F.count("*").alias("occurrences"), F.sum("weight").alias("total"))
    place = F.expr(f"row_number() OVER (PARTITION BY {key} ORDER BY total DESC, source, term)")
    return g.withColumn("place", place).where(F.col("place") <= first)
