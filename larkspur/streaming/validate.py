"""Validation of a stream of ledger records, with the state of each execution kept from batch to batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.validation import CATEGORIES, COLUMNS, FINDING, History
from ..shipping import ship

#: What a stream must have besides COLUMNS: the time that orders batches and fires timers.
RECORD = (
    "scope string, seq long, event_id string, kind string, execution string, task string, attempt string, ordinal int, previous string, accepted string, revision int, "
    "supersedes string, recorded_at timestamp"
)
_OWNED = RECORD + ", foreign boolean"


def _plain(row: dict) -> dict:
    """Nulls of pandas as None, numbers as int."""
    return {k: None if v is None or pd.isna(v) else int(v) if k in ("seq", "ordinal", "revision") else v for k, v in row.items()}


def _findings(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["scope", "seq", "event_id", "violation", "category"]).astype({"seq": "int64"})


def _millis(at: pd.Timestamp) -> int:
    """The next whole millisecond: a record never goes before its time."""
    return -(-(at.tz_localize("UTC") if at.tzinfo is None else at).value // 1_000_000)


class Owners(StatefulProcessor):
    """By (scope, event_id): which execution carried an id first; records of another are marked foreign."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.owner = handle.getValueState("owner", "execution string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        t = pd.concat(list(rows)).sort_values("seq", kind="stable")
        if not self.owner.exists():
            self.owner.update((t["execution"].iloc[0],))
        first = self.owner.get()[0]
        t["foreign"] = [x != first for x in t["execution"]]
        yield t

    def close(self) -> None:
        pass


class Executions(StatefulProcessor):
    """By (scope, execution): records wait until the watermark has passed their time, and are then judged in the order of seq.

    State: `waiting` (seq, event_id to the record), and of what stands `start` (task), `attempts` (id to ordinal, previous,
    finished) and `facts` (event id to kind, task, attempt, revision, superseded).  Only entries that a record changes are
    written.  A timer stands at the first time that a record waits for."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        record = "kind string, task string, attempt string, ordinal int, previous string, accepted string, revision int, supersedes string, foreign boolean, at long"
        self.waiting = handle.getMapState("waiting", "seq long, event_id string", record)
        self.start = handle.getValueState("start", "task string, started boolean")
        self.attempts = handle.getMapState("attempts", "attempt string", "ordinal int, previous string, finished boolean")
        self.facts = handle.getMapState("facts", "event_id string", "kind string, task string, attempt string, revision int, superseded boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for t in rows:
            for e in map(_plain, t.to_dict("records")):
                at = _millis(e["recorded_at"])
                first = at if first is None else min(at, first)
                self.waiting.updateValue((e["seq"], e["event_id"]), (e["kind"], e["task"], e["attempt"], e["ordinal"], e["previous"], e["accepted"], e["revision"], e["supersedes"], bool(e["foreign"]), at))
        self.handle.registerTimer(first)
        yield _findings([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = [(tuple(k), tuple(v)) for k, v in self.waiting.iterator()]
        due = sorted((x for x in waiting if x[1][9] <= passed), key=lambda x: x[0])
        if left := [v[9] for _, v in waiting if v[9] > passed]:
            self.handle.registerTimer(min(left))
        history = History(*(self.start.get() if self.start.exists() else (None, False)), *({k[0]: tuple(v) for k, v in state.iterator()} for state in (self.attempts, self.facts))) if due else None
        found, names = [], ("kind", "task", "attempt", "ordinal", "previous", "accepted", "revision", "supersedes")
        for (seq, event_id), v in due:
            e = dict(zip(names, v, strict=False)) | {"event_id": event_id}
            why = "DUPLICATE_EVENT" if v[8] else history.take(e)
            if why:
                found.append((key[0], seq, event_id, why, CATEGORIES[why]))
            elif not v[8]:
                for fact in filter(None, (event_id, e["supersedes"])):
                    self.facts.updateValue((fact,), history.facts[fact])
                if e["attempt"] in history.attempts:
                    self.attempts.updateValue((e["attempt"],), history.attempts[e["attempt"]])
                self.start.update((history.task, history.started))
            self.waiting.removeKey((seq, event_id))
        yield _findings(found)

    def close(self) -> None:
        pass


def validated(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """FINDING rows of a stream of RECORD rows, the same as operators.validation.validate() gives for the whole.

    Records may come up to *late* after others of a later time; each is judged when the watermark has passed its time, and the
    newest ones wait for more to come.  recorded_at must not fall as seq grows within an execution.  A record that
    comes after the watermark is left out by Spark.  State is kept by RocksDB, which
    spark.sql.streaming.stateStore.providerClass must name; it grows with the ids of executions, as an id is used once for ever."""
    ship(stream.sparkSession)
    t = stream.select(*COLUMNS, "recorded_at").withWatermark("recorded_at", late)
    owned = t.groupBy("scope", "event_id").transformWithStateInPandas(Owners(), _OWNED, "append", "None")
    return owned.groupBy("scope", "execution").transformWithStateInPandas(Executions(), FINDING, "append", "EventTime")
