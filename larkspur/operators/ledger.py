"""The append-only execution ledger: effective facts, cutoffs, paging, chains, views, acceptance, labels, validation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.snapshots import kept
from .prefix import Running, running

#: Bytes of a record's payload at most.
MAX_PAYLOAD = 1 << 20


def effective(ledger: DataFrame, *scope: str) -> DataFrame:
    """Rows that no row of their scope supersedes."""
    gone = ledger.where(F.col("supersedes").isNotNull()).select(*scope, F.col("supersedes").alias("event_id")).distinct()
    return ledger.join(gone, [*scope, "event_id"], "left_anti")


def latest(rows: DataFrame, value: str, *by: str, order: str = "seq") -> DataFrame:
    return rows.groupBy(*by).agg(F.max_by(value, order).alias(value))


def up_to_sequence(ledger: DataFrame, seq: int | Column) -> DataFrame:
    return ledger.where(F.col("seq") <= seq)


def recorded_prefix(ledger: DataFrame, at: Column, *scope: str) -> DataFrame:
    """The longest prefix of each scope recorded up to *at*: it stops at the first later event, whatever follows."""
    high = Running("_high", "max", F.col("recorded_at"))
    return running(ledger, scope, ["seq"], [high]).where(F.col("_high") <= at).drop("_high")


def sequence_findings(ledger: DataFrame, *scope: str) -> DataFrame:
    """Rows where the sequence doesn't follow the one before: SEQUENCE_GAP or DUPLICATE_SEQUENCE."""
    # in this order the one before is the highest before
    t = running(ledger, scope, ["seq", "event_id"], [Running("_before", "max", F.col("seq"), False)])
    return t.withColumn("step", F.col("seq") - F.col("_before")).where((F.col("step") != 1) & F.col("step").isNotNull()).select(*scope, "seq", "event_id", F.when(F.col("step") == 0, "DUPLICATE_SEQUENCE").otherwise("SEQUENCE_GAP").alias("finding"), "step")


def history_page(ledger: DataFrame, after: int, high: int, size: int) -> DataFrame:
    """Keyset page: a filter that reaches the scan, and the first *size* rows of it."""
    return ledger.where((F.col("seq") > after) & (F.col("seq") <= high)).orderBy("seq").limit(size)


def deduplicated(ledger: DataFrame, *scope: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the lowest sequence of each event id, and those ignored."""
    r = F.row_number().over(Window.partitionBy(*scope, "event_id").orderBy("seq"))
    t = ledger.withColumn("_r", r)
    return t.where("_r = 1").drop("_r"), t.where("_r > 1").drop("_r")


def revision_roots(ledger: DataFrame, rounds: int = 40) -> DataFrame:
    """(event_id, root_id, depth): chains of supersedes followed back by doubling, in about log2(longest chain) joins."""
    t = ledger.select("event_id", F.coalesce("supersedes", "event_id").alias("up"), F.when(F.col("supersedes").isNull(), 0).otherwise(1).alias("depth"))
    for _ in range(rounds):
        hop = t.select(F.col("event_id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"))
        new = t.join(hop, "up", "left").select("event_id", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), (F.coalesce("up2", "up") != F.col("up")).alias("moved"))
        new = kept(new, "revisions")
        more = new.where("moved").limit(1).count()
        t = new.drop("moved")
        if not more:
            return t.withColumnRenamed("up", "root_id")
    raise RuntimeError("revision chains do not end")


def attempts_view(facts: DataFrame, *by: str) -> DataFrame:
    """Attempts of each execution as an array in order of their effective ordinal.  facts has attempt, ordinal, result."""
    return facts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ordinal", "attempt", "result"))).alias("attempts"))


def acceptance(status: Column, origin: Column, result: Column, dims: Column) -> Column:
    """struct<status, reasons> of an execution.

    dims: array<struct<ordinal, dimension, state>> of the mandatory dimensions, state null without evidence.  Reasons come
    in order: the attempt's, the origin's, then dimensions by ordinal."""
    why = F.array_compact(
        F.concat(
            F.array(
                F.when(result.isNull(), "accepted attempt is not finished").when(result != "COMPLETED", F.concat(F.lit("accepted attempt is "), result)),
                F.when(origin == "IMPORTED_CLAIM", "outcome is an imported claim, not a validated outcome"),
            ),
            F.transform(F.array_sort(dims), lambda d: F.when(d["state"].isNull(), F.concat(d["dimension"], F.lit(": no applicable evidence"))).when(d["state"].isin("FAIL", "UNKNOWN"), F.concat(d["dimension"], F.lit(": "), d["state"]))),
        )
    )
    none = F.array().cast("array<string>")
    pending = status.isNull() | (status == "PENDING")
    reasons = F.when(pending, none).when(status != "ACCEPTED", F.array(F.concat(F.lit("outcome is "), status))).otherwise(why)
    name = F.when(pending, "PENDING").when(status != "ACCEPTED", "NOT_ACCEPTED").when(F.size(why) == 0, "VALIDATED_ACCEPTED").otherwise("ACCEPTED_UNVALIDATED")
    return F.struct(name.alias("status"), reasons.alias("reasons"))


def success_ordinal(samples: DataFrame, *group: str, start: str = "start_seq") -> DataFrame:
    """Place of each SUCCESS among those of its group, by start sequence; null for others.  A running count in blocks."""
    success = F.col("label") == "SUCCESS"
    t = running(samples, group, [start], [Running("success_ordinal", "sum", F.when(success, 1).otherwise(0))])
    return t.withColumn("success_ordinal", F.when(success, F.col("success_ordinal").cast("int")))


def sample_reasons(status: Column, outcome: Column, origin: Column, result: Column, gates: Column) -> Column:
    """Codes that keep an execution from being a labelled sample, in order.  gates: array<struct<ordinal, dimension, state>>."""
    accepted = status.isin("VALIDATED_ACCEPTED", "ACCEPTED_UNVALIDATED")
    gate = F.transform(F.array_sort(gates), lambda g: F.when(accepted & g["state"].isNull(), "GATE_MISSING").when(accepted & g["state"].isin("FAIL", "UNKNOWN"), F.concat(F.lit("GATE_"), g["state"])))
    return F.array_compact(
        F.concat(
            F.array(
                F.when(status == "PENDING", "OUTCOME_PENDING"),
                F.when((status == "NOT_ACCEPTED") & (outcome == "CANCELLED"), "OUTCOME_CANCELLED"),
                F.when((status != "PENDING") & (origin == "IMPORTED_CLAIM"), "OUTCOME_IMPORTED_CLAIM"),
                F.when(accepted & result.isNull(), "ACCEPTED_ATTEMPT_UNFINISHED").when(accepted & (result != "COMPLETED"), "ACCEPTED_ATTEMPT_NOT_COMPLETED"),
            ),
            gate,
        )
    )


def sample_label(status: Column, reasons: Column) -> Column:
    """SUCCESS, FAILURE or UNLABELED of an execution: any reason leaves it unlabelled."""
    return F.when(F.size(reasons) > 0, "UNLABELED").when(status == "NOT_ACCEPTED", "FAILURE").otherwise("SUCCESS")


def eligibility(**codes: Column) -> Column:
    """Names of the conditions that hold, in the order given."""
    return F.array_compact(F.array(*(F.when(c, n) for n, c in codes.items())))


def live_texts(finishes: DataFrame, ever: DataFrame, *scope: str) -> DataFrame:
    """(scope, atom_id, state): LIVE atoms are texts of effective finishes, RETIRED those once projected and no longer."""
    live = finishes.select(*scope, "atom_id").distinct().withColumn("_live", F.lit(True))
    return ever.select(*scope, "atom_id").distinct().join(live, [*scope, "atom_id"], "full").select(*scope, "atom_id", F.when(F.col("_live"), "LIVE").otherwise("RETIRED").alias("state"))


def verify_projection(derived: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows that only one side has, with the side; none if the projection holds."""
    return derived.exceptAll(stored).withColumn("only_in", F.lit("DERIVED")).unionByName(stored.exceptAll(derived).withColumn("only_in", F.lit("STORED")))


def projection_status(covered: Column, head: Column, compatible: Column) -> Column:
    return F.when(covered.isNull(), "MISSING").when(~compatible, "INCOMPATIBLE").when(covered < head, "STALE").otherwise("CURRENT")


def append_status(incoming: DataFrame, ledger: DataFrame) -> DataFrame:
    """incoming with status: IDEMPOTENT (same id and payload stored), CONFLICT (same id, other payload) or APPENDED."""
    own = ledger.select("scope", "event_id", F.sha2("payload", 256).alias("_stored"))
    t = incoming.join(own, ["scope", "event_id"], "left")
    return t.withColumn("status", F.when(F.col("_stored").isNull(), "APPENDED").when(F.col("_stored") == F.sha2("payload", 256), "IDEMPOTENT").otherwise("CONFLICT")).drop("_stored")


def correction_findings(ledger: DataFrame) -> DataFrame:
    """(event_id, finding) of corrections that don't hold: target missing, later revision exists, wrong number, kind or address."""
    old = ledger.select(F.col("scope"), F.col("event_id").alias("supersedes"), F.col("kind").alias("_kind"), F.col("revision").alias("_rev"), F.col("execution").alias("_exec"), F.col("attempt").alias("_att"), F.col("seq").alias("_seq"))
    n = ledger.where("supersedes IS NOT NULL").groupBy("scope", "supersedes").agg(F.min("seq").alias("_first"))
    t = ledger.where("supersedes IS NOT NULL").join(old, ["scope", "supersedes"], "left").join(n, ["scope", "supersedes"])
    finding = (
        F.when(F.col("_seq").isNull() | (F.col("_seq") >= F.col("seq")), "DANGLING_TARGET")
        .when(F.col("_first") < F.col("seq"), "NOT_LATEST_REVISION")
        .when(F.col("revision") != F.col("_rev") + 1, "WRONG_REVISION")
        .when(F.col("kind") != F.col("_kind"), "KIND_CHANGED")
        .when(~F.col("execution").eqNullSafe(F.col("_exec")) | ~F.col("attempt").eqNullSafe(F.col("_att")), "ADDRESS_CHANGED")
    )
    return t.withColumn("finding", finding).where("finding IS NOT NULL").select("scope", "seq", "event_id", "finding")


def fold_validate(ledger: DataFrame) -> DataFrame:
    """(scope, seq, event_id, violation) in strict order of each execution: duplicate ids, attempts that never began, ordinals
    used twice, work after an attempt's end, a start that isn't first.

    An event id is used once in a scope: a later row with it is a duplicate in whatever execution it stands.  All other state is
    that of one execution, so executions, not scopes, are the groups: none is larger than its own history."""
    first = F.min("seq").over(Window.partitionBy("scope", "event_id"))
    every = ledger.select("scope", "seq", "event_id", "kind", "execution", "attempt", "ordinal").withColumn("_first", first)
    twice = every.where("seq > _first").select("scope", "seq", "event_id", F.lit("DUPLICATE_EVENT").alias("violation"))

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable")
        seen, begun, ended, ordinals, started, out = set(), set(), set(), set(), False, []
        for r in pdf.itertuples(index=False):
            why = None
            if r.event_id in seen:
                why = "DUPLICATE_EVENT"
            elif r.kind == "EXECUTION_STARTED" and started:
                why = "EXECUTION_ALREADY_STARTED"
            elif r.kind != "EXECUTION_STARTED" and not started:
                why = "EXECUTION_NOT_STARTED"
            elif r.kind == "ATTEMPT_STARTED" and (r.attempt in begun or r.ordinal in ordinals):
                why = "ORDINAL_REUSED"
            elif r.kind in ("STAGE_RECORDED", "EVIDENCE_RECORDED", "ATTEMPT_FINISHED") and r.attempt not in begun:
                why = "DANGLING_ATTEMPT"
            elif r.kind in ("STAGE_RECORDED", "ATTEMPT_FINISHED") and r.attempt in ended:
                why = "ATTEMPT_FINISHED"
            if why:
                out.append((r.scope, r.seq, r.event_id, why))
                continue
            seen.add(r.event_id)
            started |= r.kind == "EXECUTION_STARTED"
            if r.kind == "ATTEMPT_STARTED":
                begun.add(r.attempt)
                ordinals.add(r.ordinal)
            if r.kind == "ATTEMPT_FINISHED":
                ended.add(r.attempt)
        return pd.DataFrame(out, columns=["scope", "seq", "event_id", "violation"])

    rest = every.where("seq = _first").drop("_first").groupBy("scope", "execution").applyInPandas(go, "scope string, seq long, event_id string, violation string")
    return twice.unionByName(rest)


def attempt_join(hits: DataFrame, samples: DataFrame, attempts: DataFrame, cutoff: Column) -> DataFrame:
    """hits (execution, attempt, event_id, seq) with status: BEYOND_CUTOFF, NO_SAMPLE, ATTEMPT_NOT_IN_SAMPLE, FINISH_MISMATCH, JOINED."""
    s = samples.select("execution").distinct().withColumn("_s", F.lit(1))
    a = attempts.select("execution", "attempt", F.col("finish_event").alias("_finish")).withColumn("_a", F.lit(1))
    t = hits.join(s, "execution", "left").join(a, ["execution", "attempt"], "left")
    return t.withColumn("status", F.when(F.col("seq") > cutoff, "BEYOND_CUTOFF").when(F.col("_s").isNull(), "NO_SAMPLE").when(F.col("_a").isNull(), "ATTEMPT_NOT_IN_SAMPLE").when(~F.col("_finish").eqNullSafe(F.col("event_id")), "FINISH_MISMATCH").otherwise("JOINED")).drop("_s", "_a", "_finish")


def parse_framed(lines: DataFrame, column: str = "value", keep: str | None = None) -> DataFrame:
    """Framed ledger lines 'MXL1 seq length sha256 payload' (tabs) as (seq, payload, finding); finding null where all holds."""
    p = F.split(column, "\t", 5)
    get = lambda k: F.get(p, F.lit(k))
    payload = get(4)
    finding = (
        F.when((F.size(p) != 5) | (get(0) != "MXL1") | ~get(1).rlike(r"^[1-9]\d{0,17}$"), "MALFORMED_RECORD")
        .when(F.octet_length(payload).cast("string") != get(2), "MALFORMED_RECORD")
        .when(F.octet_length(payload) > MAX_PAYLOAD, "OVERSIZED_RECORD")
        .when(F.sha2(payload, 256) != get(3), "DIGEST_MISMATCH")
    )
    return lines.select(*([keep] if keep else []), F.expr("try_cast(get(split(" + column + ", '\t', 5), 1) AS BIGINT)").alias("seq"), payload.alias("payload"), finding.alias("finding"))


def framed(seq: Column, payload: Column) -> Column:
    """The framed line of a payload."""
    return F.concat_ws("\t", F.lit("MXL1"), seq.cast("string"), F.octet_length(payload).cast("string"), F.sha2(payload, 256), payload)
