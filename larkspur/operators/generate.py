"""Deterministic corpora for scale runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replicas(rows: DataFrame, times: int, text: str = "text") -> DataFrame:
    """Each row *times* times; copies after the first are tagged in their text."""
    r = rows.withColumn("replica", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long"))))
    return r.withColumn(text, F.when(F.col("replica") == 0, F.col(text)).otherwise(F.concat(F.lit("[replica "), F.col("replica").cast("string"), F.lit("] "), F.col(text))))


def scale_corpus(spark: SparkSession, base: list[tuple[str, str]], n: int, seed: int = 42, confusable: float = 0.2) -> DataFrame:
    """(label, content) of n atoms: *base* first, then fillers, of which a fifth repeat words of a base atom.

    A row hangs on its number and the seed only, so a larger corpus begins with the smaller one."""
    words = F.array(*map(F.lit, ["harbor", "lantern", "meadow", "copper", "violet", "granite", "orchard", "signal", "timber", "cotton", "saddle", "marble"]))
    texts, labels = F.array(*(F.lit(c) for _, c in base)), F.array(*(F.lit(x) for x, _ in base))
    h = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 20))
    pick = lambda k: F.element_at(words, (h(k) % 12 + 1).cast("int"))
    like = F.element_at(texts, (h(9) % len(base) + 1).cast("int"))
    filler = F.concat_ws(" ", pick(1), pick(2), pick(3), F.col("id").cast("string"))
    content = F.when(F.col("id") < len(base), F.try_element_at(texts, (F.col("id") + 1).cast("int"))).when(h(8) < int(confusable * (1 << 20)), F.concat_ws(" ", F.substring_index(like, " ", 3), filler)).otherwise(filler)
    label = F.when(F.col("id") < len(base), F.try_element_at(labels, (F.col("id") + 1).cast("int"))).otherwise(F.concat(F.lit("filler_"), F.col("id").cast("string")))
    return spark.range(n).select(label.alias("label"), content.alias("content"))


def executions(spark: SparkSession, n: int, seed: int = 42, scopes: int = 3) -> DataFrame:
    """(scope, seq, event_id, kind, execution, attempt, ordinal, payload) of n executions of one attempt each; prefix-stable in n."""
    kinds = F.array(*(F.struct(F.lit(k).alias("pos"), F.lit(x).alias("kind")) for k, x in enumerate(["EXECUTION_STARTED", "ATTEMPT_STARTED", "STAGE_RECORDED", "ATTEMPT_FINISHED", "OUTCOME_RECORDED"])))
    t = spark.range(n).select("id", F.explode(kinds).alias("k"))
    scope = F.concat(F.lit("scope-"), (F.col("id") % scopes).cast("string"))
    attempt = F.when(F.col("k.pos").between(1, 3), F.concat(F.lit("a"), F.col("id").cast("string")))
    return t.select(scope.alias("scope"), (F.expr(f"id div {scopes}") * 5 + F.col("k.pos") + 1).alias("seq"), F.concat_ws("-", F.lit("e"), F.col("id").cast("string"), F.col("k.pos").cast("string")).alias("event_id"), F.col("k.kind").alias("kind"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("execution"), attempt.alias("attempt"), F.when(F.col("k.pos") == 1, 1).cast("int").alias("ordinal"), F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string"), F.col("k.kind")), 256).alias("payload"))
