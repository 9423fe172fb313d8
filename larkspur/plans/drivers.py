"""End-to-end drivers: latency sweeps, fusion sweeps, protected benchmarks, read-back and the whole flow of an execution."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, experience, fusion, generate, ledger, metrics, recall, stats
from ..operators.prefix import Running, running


def timed(run: Callable[[], DataFrame], repeats: int) -> tuple[int, list[int]]:
    """(rows, nanoseconds of each run) of a query whose result is counted where it is made."""
    rows, took = 0, []
    for _ in range(repeats):
        t = time.perf_counter_ns()
        rows = run().count()
        took.append(time.perf_counter_ns() - t)
    return rows, took


def latency_sweep(atoms: DataFrame, queries: DataFrame, sizes: Sequence[int], ks: Sequence[int], repeats: int = 3, content: str = "content") -> DataFrame:
    """(size, k, scanned, returned and the statistics of stats.scale_timing) for growing parts of a corpus.

    A part is the atoms of the smallest hashes, so a larger one holds the smaller."""
    spark = atoms.sparkSession
    out = []
    ordered = atoms.withColumn("_h", F.xxhash64(content)).orderBy("_h", content)
    for n in sizes:
        part = ordered.limit(n).drop("_h")
        scanned = part.count()
        for k in ks:
            rows, took = timed(lambda p=part, k=k: recall.recall(p, queries, k, None), repeats)
            out += [(n, k, scanned, rows, x) for x in took]
    t = spark.createDataFrame(out, "size long, k int, scanned long, returned long, nanos long")
    return stats.scale_timing(t, "nanos", "size", "k", "scanned", "returned")


def optimization_signal(sweep: DataFrame, slow_ms: float = 100.0) -> str:
    """What a sweep justifies: nothing yet, a bounded top K, or larger corpora first."""
    t = sweep.groupBy("size").agg(F.max("p95").alias("p95")).orderBy("size").collect()
    if len(t) < 2:
        return "INCONCLUSIVE_NEEDS_LARGER_SCALE"
    return "BOUNDED_EXACT_TOP_K_EXPERIMENT_JUSTIFIED" if t[-1]["p95"] > slow_ms * 1e6 else "OPTIMIZATION_NOT_YET_JUSTIFIED"


def fusion_sweep(corpus: DataFrame, transcript: DataFrame, acoustic: DataFrame, relevant: DataFrame, weights: Sequence[tuple[str, float, float]], splits: DataFrame | None = None) -> DataFrame:
    """(profile, split, queries, averages, mrr) of each weighting; splits (query_id, split), else all are DEV."""
    ranked = fusion.fused(fusion.aligned(corpus, transcript, acoustic), weights).withColumnRenamed("sample_id", "label")
    out = None
    for name, _, _ in weights:
        per = metrics.per_query(ranked.where(F.col("profile") == name), relevant).withColumn("profile", F.lit(name))
        per = per.join(splits, "query_id", "left") if splits is not None else per.withColumn("split", F.lit("DEV"))
        rows = metrics.averages(per, "profile", "split")
        out = rows if out is None else out.unionByName(rows)
    return out


def protected(measured: DataFrame, expected: DataFrame, shape: dict[str, int], wanted: dict[str, int]) -> DataFrame:
    """(name, ok): the shape of a benchmark exactly, its metrics as metrics.baseline_check() has it."""
    spark = measured.sparkSession
    rows = spark.createDataFrame([(k, shape.get(k) == v) for k, v in sorted(wanted.items())], "name string, ok boolean")
    return rows.unionByName(metrics.baseline_check(measured, expected).select("name", "ok"))


def readback(seeded: DataFrame, stored: DataFrame, key: str = "atom_id") -> DataFrame:
    """(key, finding) of what a store gives back for what was put in: MISSING, CHANGED or FOREIGN."""
    a, b = seeded.select(key, F.xxhash64("content").alias("_a")), stored.select(key, F.xxhash64("content").alias("_b"))
    t = a.join(b, key, "full")
    return t.select(key, F.when(F.col("_b").isNull(), "MISSING").when(F.col("_a").isNull(), "FOREIGN").when(F.col("_a") != F.col("_b"), "CHANGED").alias("finding")).where("finding IS NOT NULL")


def import_kind(findings: DataFrame, stored_before: int, seeded: int) -> str:
    """What a read-back shows of an import: CLEAN, REPEAT, RESUMED, FOREIGN or DAMAGED."""
    found = {r["finding"] for r in findings.select("finding").distinct().collect()}
    if found & {"CHANGED", "MISSING"}:
        return "DAMAGED"
    if "FOREIGN" in found:
        return "FOREIGN"
    return "CLEAN" if stored_before == 0 else "REPEAT" if stored_before == seeded else "RESUMED"


def worksheet(pairs: DataFrame, seed: str) -> DataFrame:
    """pairs (pair_id, ...) in a blind order: numbered by the hash of seed and pair, without rank, score or stratum."""
    order = F.sha2(F.concat_ws(":", F.lit(seed), F.col("pair_id").cast("string")), 256)
    t = pairs.drop("rank", "score", "stratum").withColumn("_o", order).withColumn("_n", F.conv(F.substring("_o", 1, 15), 16, 10).cast("long"))
    return running(t, [], ["_n", "_o"], [Running("line", "sum", F.lit(1))]).drop("_o", "_n")


def expansion_ab(atoms: DataFrame, queries: DataFrame, expanded: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, before_rank, after_rank, change) of queries as they are and expanded, over the same atoms."""
    side = lambda q: recall.recall(atoms, q, k, None, digits=6).withColumnRenamed("atom_id", "label")
    return metrics.ranking_change(side(queries), side(expanded), relevant)


def with_reported(pairs: DataFrame, judgments: DataFrame, billed: DataFrame) -> DataFrame:
    """pairs (left_ref, right_ref, ...) beside what others said of them: external judgments and billed amounts are reported, and
    change no verdict."""
    j = judgments.groupBy("left_ref", "right_ref").agg(F.array_sort(F.collect_set("judgment")).alias("external"))
    b = lambda side: billed.select(F.col("ref").alias(f"{side}_ref"), F.col("amount").alias(f"{side}_billed"))
    return pairs.join(j, ["left_ref", "right_ref"], "left").join(b("left"), "left_ref", "left").join(b("right"), "right_ref", "left")


def execution_flow(spark: SparkSession, n: int, seed: int = 42, page: int = 5) -> dict[str, bool]:
    """Record, replay, validate and export *n* synthetic executions twice: the gates that must hold."""
    gates: dict[str, bool] = {}
    digests = []
    for _ in range(2):
        events = generate.executions(spark, n, seed).withColumn("task", F.lit("t")).withColumn("supersedes", F.lit(None).cast("string"))
        events = events.withColumn("result", F.when(F.col("kind") == "ATTEMPT_FINISHED", "COMPLETED")).withColumn("outcome", F.when(F.col("kind") == "OUTCOME_RECORDED", "ACCEPTED"))
        views = experience.replay(events)
        gates["isolation"] = views.groupBy("execution").agg(F.count_distinct("scope").alias("s")).where("s > 1").count() == 0
        gates["success"] = views.where("outcome <> 'ACCEPTED' OR outcome IS NULL").count() == 0
        gates["replay"] = experience.verify_views(views, events).count() == 0
        gates["accounting"] = ledger.sequence_findings(events, "scope").count() == 0
        gates["validation"] = ledger.fold_validate(events).count() == 0
        one = events.where("scope = 'scope-0'")
        seen, cursor = 0, None
        while True:
            rows, cursor = experience.export_page(one, page, cursor)
            seen += rows.count()
            if cursor is None:
                break
        gates["export"] = seen == one.select("execution").distinct().count()
        digests.append(sorted(map(tuple, experience.digest(events, "scope").collect())))
    gates["determinism"] = digests[0] == digests[1]
    return gates


def scale_steps(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(step, key, text): 25, 50 and 100 per cent of the rows, in the order of the keys (a number or time), and 4 and 16 replicas
    of all.  Places are running counts in blocks, so that nothing is sorted as a whole."""
    n = rows.count()
    placed = running(rows, [], [key], [Running("_place", "sum", F.lit(1).cast("long"))])
    steps = F.array_compact(F.array(*(F.when(F.col("_place") <= -(-n * p // 100), F.lit(f"{p}%")) for p in (25, 50, 100))))
    parts = [placed.select(F.explode(steps).alias("step"), F.col(key), F.col(text))]
    parts += [generate.replicas(rows.select(key, text), m, text).select(F.lit(f"x{m}").alias("step"), F.col(key), F.col(text)) for m in (4, 16)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def integrity(atoms: DataFrame, vectors: DataFrame, feedback: DataFrame, dimensions: int) -> DataFrame:
    """(category, severity, n) over a store: findings of atoms, vectors, feedback and of what one side has and the other lacks."""
    refs = audit.referential(atoms.select(F.col("id").alias("atom_id")).distinct(), vectors.select("atom_id").distinct(), "atom_id", ("ATOM_WITHOUT_VECTOR", "ERROR"), ("VECTOR_WITHOUT_ATOM", "WARNING"))
    rows = audit.atom_findings(atoms).select("category", "severity").unionByName(audit.vector_findings(vectors, dimensions).select("category", "severity")).unionByName(refs.select("category", "severity"))
    rows = rows.unionByName(audit.feedback_findings(feedback).select("category", "severity"))
    return rows.groupBy("category", "severity").agg(F.count("*").alias("n"))
