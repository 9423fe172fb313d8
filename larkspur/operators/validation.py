"""Validation of ledger records in the strict order of their execution.

Whether a record may stand hangs on the records that stand before it: a refused one leaves no trace, so that what follows is
judged as if it had never come.  All of that state is an execution's own, but for event ids, which are used once in a scope.
`History` is that state; `validate()` folds a ledger with it, and `streaming.validate` keeps it from batch to batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

#: What is read of a record.  previous: the attempt that an attempt follows; accepted: the attempt that an outcome accepts.
COLUMNS = ["scope", "seq", "event_id", "kind", "execution", "task", "attempt", "ordinal", "previous", "accepted", "revision", "supersedes"]
FINDING = "scope string, seq long, event_id string, violation string, category string"

# The category of each violation.
CATEGORIES = {
    "DUPLICATE_EVENT": "CONFLICTING_DUPLICATE_EVENT",
    "EXECUTION_ALREADY_STARTED": "CONFLICTING_DUPLICATE_EVENT",
    "TASK_DIFFERS": "CONFLICTING_DUPLICATE_EVENT",
    "ATTEMPT_ALREADY_STARTED": "CONFLICTING_DUPLICATE_EVENT",
    "ORDINAL_REUSED": "CONFLICTING_DUPLICATE_EVENT",
    "NOT_LATEST_REVISION": "CONFLICTING_DUPLICATE_EVENT",
    "WRONG_REVISION": "CONFLICTING_DUPLICATE_EVENT",
    "EXECUTION_NOT_STARTED": "DANGLING_REFERENCE",
    "DANGLING_ATTEMPT": "DANGLING_REFERENCE",
    "DANGLING_PREVIOUS": "DANGLING_REFERENCE",
    "DANGLING_ACCEPTED": "DANGLING_REFERENCE",
    "DANGLING_TARGET": "DANGLING_REFERENCE",
    "ADDRESS_CHANGED": "DANGLING_REFERENCE",
    "ATTEMPT_FINISHED": "INVALID_ORDER",
    "KIND_CHANGED": "INVALID_ORDER",
    "PREVIOUS_CYCLE": "INVALID_ORDER",
}


class History:
    """What the records of one execution that stand have left behind.

    attempts: id to (ordinal, previous, finished); facts: event id to (kind, task, attempt, revision, superseded)."""

    def __init__(self, task: str | None = None, started: bool = False, attempts: dict | None = None, facts: dict | None = None):
        self.task, self.started, self.attempts, self.facts = task, started, attempts or {}, facts or {}

    def violation(self, e: dict) -> str | None:
        """Why a record can't stand, or None."""
        if e["event_id"] in self.facts:
            return "DUPLICATE_EVENT"
        if e["supersedes"] is not None:
            return self._correction(e)
        if e["kind"] == "EXECUTION_STARTED":
            return "EXECUTION_ALREADY_STARTED" if self.started else None
        if not self.started:
            return "EXECUTION_NOT_STARTED"
        if e["task"] != self.task:
            return "TASK_DIFFERS"
        known = self.attempts.get(e["attempt"])
        match e["kind"]:
            case "ATTEMPT_STARTED":
                if known:
                    return "ATTEMPT_ALREADY_STARTED"
                return "ORDINAL_REUSED" if self._taken(e["ordinal"]) else self._dangling(e)
            case "STAGE_RECORDED" | "EVIDENCE_RECORDED" | "ATTEMPT_FINISHED":
                return "DANGLING_ATTEMPT" if known is None else "ATTEMPT_FINISHED" if known[2] else None
            case "OUTCOME_RECORDED":
                return self._dangling(e)
        return None

    def _taken(self, ordinal: int) -> bool:
        return any(a[0] == ordinal for a in self.attempts.values())

    def _dangling(self, e: dict) -> str | None:
        if e["kind"] == "ATTEMPT_STARTED" and e["previous"] is not None and e["previous"] not in self.attempts:
            return "DANGLING_PREVIOUS"
        if e["kind"] == "OUTCOME_RECORDED" and e["accepted"] is not None and e["accepted"] not in self.attempts:
            return "DANGLING_ACCEPTED"
        return None

    def _correction(self, e: dict) -> str | None:
        target = self.facts.get(e["supersedes"])
        if target is None:
            return "DANGLING_TARGET"
        kind, task, attempt, revision, superseded = target
        if (task, attempt) != (e["task"], e["attempt"]):
            return "ADDRESS_CHANGED"
        if superseded:
            return "NOT_LATEST_REVISION"
        if e["revision"] != revision + 1:
            return "WRONG_REVISION"
        if kind != e["kind"]:
            return "KIND_CHANGED"
        if why := self._dangling(e):
            return why
        if kind != "ATTEMPT_STARTED":
            return None
        at = e["previous"]
        for _ in range(len(self.attempts) + 1):
            if at is None:
                break
            if at == attempt:
                return "PREVIOUS_CYCLE"
            at = self.attempts[at][1]
        return "ORDINAL_REUSED" if self.attempts[attempt][0] != e["ordinal"] and self._taken(e["ordinal"]) else None

    def add(self, e: dict) -> None:
        """A record that stands."""
        if e["supersedes"] is not None:
            self.facts[e["supersedes"]] = (*self.facts[e["supersedes"]][:4], True)
        self.facts[e["event_id"]] = (e["kind"], e["task"], e["attempt"], e["revision"], False)
        if e["kind"] == "EXECUTION_STARTED" and not self.started:
            self.task, self.started = e["task"], True
        elif e["kind"] == "ATTEMPT_STARTED":
            self.attempts[e["attempt"]] = (e["ordinal"], e["previous"], self.attempts.get(e["attempt"], (0, None, False))[2])
        elif e["kind"] == "ATTEMPT_FINISHED" and e["supersedes"] is None:
            self.attempts[e["attempt"]] = (*self.attempts[e["attempt"]][:2], True)

    def take(self, e: dict) -> str | None:
        """The violation of a record, which is added if it has none."""
        why = self.violation(e)
        if why is None:
            self.add(e)
        return why


def foreign(ledger: DataFrame) -> DataFrame:
    """(scope, event_id, owner): ids that stand in several executions, with the one whose record comes first."""
    by = ledger.groupBy("scope", "event_id").agg(F.min_by("execution", "seq").alias("owner"), F.min("execution").alias("_a"), F.max("execution").alias("_b"))
    return by.where("_a <> _b").select("scope", "event_id", "owner")


def validate(ledger: DataFrame) -> DataFrame:
    """(scope, seq, event_id, violation, category) of the records that can't stand; none if the ledger is valid.

    ledger: COLUMNS; revision counts from 1, a correction has the kind of what it replaces.  An id belongs to the execution
    that carries it first; in any other it is a DUPLICATE_EVENT, whether or not that first record stands.  A target in
    another execution is a DANGLING_TARGET.  Rows of the same seq are taken in the order of their ids.

    Executions are dealt out and sorted, and go by in order: a task holds the attempts and ids of one execution, not its
    records.  No group is larger than one execution's history, which one agent writes; scopes are spread over all tasks."""
    ship(ledger.sparkSession)
    owner = foreign(ledger)
    rows = ledger.select(*COLUMNS).join(owner, ["scope", "event_id"], "left").withColumn("foreign", F.coalesce(F.col("owner") != F.col("execution"), F.lit(False)))
    dealt = rows.select(*COLUMNS, "foreign").repartition("scope", "execution").sortWithinPartitions("scope", "execution", "seq", "event_id")
    return dealt.mapInArrow(_fold, FINDING)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, history = None, History()
    for batch in batches:
        found = []
        for e in batch.to_pylist():
            if (e["scope"], e["execution"]) != key:
                key, history = (e["scope"], e["execution"]), History()
            why = "DUPLICATE_EVENT" if e["foreign"] else history.take(e)
            if why:
                found.append((e["scope"], e["seq"], e["event_id"], why, CATEGORIES[why]))
        if found:
            cols = list(zip(*found, strict=True))
            yield pa.record_batch([pa.array(c, pa.int64() if i == 1 else pa.string()) for i, c in enumerate(cols)], ["scope", "seq", "event_id", "violation", "category"])
