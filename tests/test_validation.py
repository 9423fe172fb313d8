"""Validation of ledgers in strict order, as a batch and as a stream that is stopped and started again."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import validation
from larkspur.streaming import validate as streamed

ROW = streamed.RECORD
BASE = dt.datetime(2024, 1, 1)


def record(seq, kind, execution="x", attempt=None, event_id=None, task="t", ordinal=None, previous=None, accepted=None, revision=1, supersedes=None, scope="s"):
    return (scope, seq, event_id or f"e{seq}", kind, execution, task, attempt, ordinal, previous, accepted, revision, supersedes, BASE + dt.timedelta(seconds=seq))


def found(spark, records):
    t = validation.validate(spark.createDataFrame(records, ROW))
    return {r["seq"]: r["violation"] for r in t.collect()}


GOOD = [
    record(1, "EXECUTION_STARTED"),
    record(2, "ATTEMPT_STARTED", attempt="a", ordinal=1),
    record(3, "STAGE_RECORDED", attempt="a"),
    record(4, "ATTEMPT_FINISHED", attempt="a"),
    record(5, "ATTEMPT_STARTED", attempt="b", ordinal=2, previous="a"),
    record(6, "OUTCOME_RECORDED", accepted="b"),
]


@pytest.mark.parametrize(
    "extra, why",
    [
        (record(7, "STAGE_RECORDED", attempt="b", event_id="e3"), "DUPLICATE_EVENT"),
        (record(7, "EXECUTION_STARTED"), "EXECUTION_ALREADY_STARTED"),
        (record(7, "STAGE_RECORDED", execution="y", attempt="a"), "EXECUTION_NOT_STARTED"),
        (record(7, "STAGE_RECORDED", attempt="b", task="u"), "TASK_DIFFERS"),
        (record(7, "ATTEMPT_STARTED", attempt="b", ordinal=9), "ATTEMPT_ALREADY_STARTED"),
        (record(7, "ATTEMPT_STARTED", attempt="c", ordinal=2), "ORDINAL_REUSED"),
        (record(7, "ATTEMPT_STARTED", attempt="c", ordinal=3, previous="nobody"), "DANGLING_PREVIOUS"),
        (record(7, "EVIDENCE_RECORDED", attempt="c"), "DANGLING_ATTEMPT"),
        (record(7, "ATTEMPT_FINISHED", attempt="a"), "ATTEMPT_FINISHED"),
        (record(7, "OUTCOME_RECORDED", accepted="nobody"), "DANGLING_ACCEPTED"),
        (record(7, "STAGE_RECORDED", attempt="a", revision=2, supersedes="nothing"), "DANGLING_TARGET"),
        (record(7, "STAGE_RECORDED", attempt="b", revision=2, supersedes="e3"), "ADDRESS_CHANGED"),
        (record(7, "STAGE_RECORDED", attempt="a", revision=3, supersedes="e3"), "WRONG_REVISION"),
        (record(7, "ATTEMPT_FINISHED", attempt="a", revision=2, supersedes="e3"), "KIND_CHANGED"),
        (record(7, "ATTEMPT_STARTED", attempt="a", ordinal=1, previous="a", revision=2, supersedes="e2"), "PREVIOUS_CYCLE"),
        (record(7, "ATTEMPT_STARTED", attempt="a", ordinal=1, previous="b", revision=2, supersedes="e2"), "PREVIOUS_CYCLE"),
        (record(7, "ATTEMPT_STARTED", attempt="a", ordinal=2, revision=2, supersedes="e2"), "ORDINAL_REUSED"),
    ],
)
def test_each_violation(spark, extra, why):
    assert found(spark, GOOD) == {}
    assert found(spark, [*GOOD, extra]) == {7: why}


def test_refused_records_leave_no_trace(spark):
    more = [
        record(7, "ATTEMPT_STARTED", attempt="c", ordinal=3, previous="nobody"),
        record(8, "STAGE_RECORDED", attempt="c"),  # c never began
        record(9, "ATTEMPT_STARTED", attempt="c", ordinal=3, event_id="e7"),  # nor was its id taken
        record(10, "STAGE_RECORDED", attempt="a", revision=2, supersedes="e3"),  # an ended attempt may be corrected
        record(11, "STAGE_RECORDED", attempt="a", revision=2, supersedes="e3"),
        record(12, "STAGE_RECORDED", attempt="a", revision=3, supersedes="e10"),
        record(13, "EXECUTION_STARTED", execution="y", event_id="e1"),  # another execution's id
        record(14, "EXECUTION_STARTED", execution="y"),
    ]
    assert found(spark, [*GOOD, *more]) == {7: "DANGLING_PREVIOUS", 8: "DANGLING_ATTEMPT", 11: "NOT_LATEST_REVISION", 13: "DUPLICATE_EVENT"}


def test_long_cycle_and_empty(spark):
    n = 200
    chain = [record(1, "EXECUTION_STARTED")] + [record(k + 2, "ATTEMPT_STARTED", attempt=f"a{k}", ordinal=k, previous=f"a{k - 1}" if k else None) for k in range(n)]
    closing = record(n + 2, "ATTEMPT_STARTED", attempt="a0", ordinal=0, previous=f"a{n - 1}", revision=2, supersedes="e2")
    assert found(spark, [*chain, closing]) == {n + 2: "PREVIOUS_CYCLE"}
    assert found(spark, []) == {}


def history(rng, executions, length):
    """Records of several executions, most of which stand."""
    out, seq = [], 0
    for _ in range(executions * length):
        seq += 1
        x = f"x{rng.randrange(executions)}"
        a = f"a{rng.randrange(4)}"
        kind = rng.choice(["EXECUTION_STARTED", "ATTEMPT_STARTED", "ATTEMPT_STARTED", "STAGE_RECORDED", "EVIDENCE_RECORDED", "ATTEMPT_FINISHED", "OUTCOME_RECORDED"])
        e = dict(execution=x, task="t" if rng.random() < 0.9 else "u", event_id=f"e{rng.randrange(seq) + 1}" if rng.random() < 0.05 else None)
        if kind in ("ATTEMPT_STARTED", "STAGE_RECORDED", "EVIDENCE_RECORDED", "ATTEMPT_FINISHED"):
            e["attempt"] = a
        if kind == "ATTEMPT_STARTED":
            e |= dict(ordinal=rng.randrange(6), previous=rng.choice([None, "a0", "a1", "a2", "a9"]))
        if kind == "OUTCOME_RECORDED":
            e["accepted"] = rng.choice([None, "a1", "a9"])
        own = [r for r in out if r[4] == x and r[3] == kind and r[6] == e.get("attempt")]
        if own and rng.random() < 0.3:
            e |= dict(supersedes=rng.choice(own)[2], revision=rng.choice([2, 2, 3]))
        out.append(record(seq, kind, **e))
    return out


def test_stream_equals_batch_over_a_restart(spark, tmp_path):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        records = history(random.Random(5), 5, 30)
        end = record(10_000, "EXECUTION_STARTED", execution="last")  # moves the watermark past all others
        want = {tuple(r) for r in validation.validate(spark.createDataFrame(records, ROW)).collect()}
        assert len({w[3] for w in want}) >= 10
        source, out = str(tmp_path / "in"), str(tmp_path / "out")
        cuts = [0, 40, 41, 100, len(records)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            part = records[a:b] + ([end] if b == len(records) else [])
            random.Random(i).shuffle(part)
            spark.createDataFrame(part, ROW).coalesce(1).write.mode("append").json(source)
            if i in (1, 3):  # the stream stops and goes on from its checkpoint
                stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).json(source)
                q = streamed.validated(stream, "1 second").writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(path=out, format="parquet")
                q.awaitTermination()
        got = [tuple(r) for r in spark.read.parquet(out).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
