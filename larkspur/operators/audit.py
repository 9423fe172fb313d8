"""Integrity audits: findings as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def referential(left: DataFrame, right: DataFrame, key: str, left_finding: tuple[str, str], right_finding: tuple[str, str]) -> DataFrame:
    """(key, category, severity): keys of either side that the other lacks."""
    side = lambda a, b, f: a.join(b, key, "left_anti").select(key, F.lit(f[0]).alias("category"), F.lit(f[1]).alias("severity"))
    return side(left, right, left_finding).unionByName(side(right, left, right_finding))


def atom_findings(atoms: DataFrame) -> DataFrame:
    """(id, category, severity) of stored atoms: BLANK_CONTENT, ID_MISMATCH, DUPLICATE_ID."""
    from ..functions.ids import content_id

    own = atoms.select("id", F.array_compact(F.array(F.when(F.trim("content") == "", "BLANK_CONTENT"), F.when(F.col("id") != content_id(F.col("content")), "ID_MISMATCH"))).alias("c"))
    rows = own.select("id", F.explode("c").alias("category"))
    twice = atoms.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("DUPLICATE_ID").alias("category"))
    return rows.unionByName(twice).withColumn("severity", F.when(F.col("category") == "DUPLICATE_ID", "INFO").otherwise("ERROR"))


def vector_findings(vectors: DataFrame, dimensions: int) -> DataFrame:
    """(atom_id, category, severity) of vectors: DIMENSION_MISMATCH, NON_FINITE_COMPONENT, ZERO_VECTOR."""
    bad = F.exists("vec", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    c = F.when(F.size("vec") != dimensions, "DIMENSION_MISMATCH").when(bad, "NON_FINITE_COMPONENT").when(~F.exists("vec", lambda x: x != 0), "ZERO_VECTOR")
    return vectors.select("atom_id", c.alias("category")).where("category IS NOT NULL").withColumn("severity", F.when(F.col("category") == "ZERO_VECTOR", "WARNING").otherwise("ERROR"))


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity", "category").agg(F.count("*").alias("n"))


def feedback_findings(feedback: DataFrame) -> DataFrame:
    """(seq, category, severity) of feedback rows that are no valid events."""
    from ..sources.stores import valid_feedback

    return feedback.where(~F.coalesce(valid_feedback(), F.lit(False))).select("seq", F.lit("FEEDBACK_LOG_CORRUPT").alias("category"), F.lit("ERROR").alias("severity"))


def ledger_findings(ledger: DataFrame) -> DataFrame:
    """(scope, seq, event_id, category, severity) of all scopes: gaps and repeats of the sequence, event ids that come again with
    another payload, corrections of nothing and records of executions that never began."""
    from .ledger import sequence_findings

    order = sequence_findings(ledger, "scope").select("scope", "seq", "event_id", F.col("finding").alias("category"))
    first = ledger.groupBy("scope", "event_id").agg(F.min_by("payload", "seq").alias("_p"), F.min("seq").alias("_s"))
    again = ledger.join(first, ["scope", "event_id"]).where((F.col("seq") > F.col("_s")) & (F.col("payload") != F.col("_p"))).select("scope", "seq", "event_id", F.lit("CONFLICTING_DUPLICATE_EVENT").alias("category"))
    target = ledger.select("scope", F.col("event_id").alias("supersedes")).distinct()
    dangling = ledger.where("supersedes IS NOT NULL").join(target, ["scope", "supersedes"], "left_anti").select("scope", "seq", "event_id", F.lit("DANGLING_REFERENCE").alias("category"))
    begun = ledger.where("kind = 'EXECUTION_STARTED'").groupBy("scope", "execution").agg(F.min("seq").alias("_b"))
    early = ledger.where("kind <> 'EXECUTION_STARTED'").join(begun, ["scope", "execution"], "left").where(F.col("_b").isNull() | (F.col("seq") < F.col("_b"))).select("scope", "seq", "event_id", F.lit("INVALID_ORDER").alias("category"))
    return order.unionByName(again).unionByName(dangling).unionByName(early).withColumn("severity", F.lit("ERROR"))
