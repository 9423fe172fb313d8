"""What executions leave behind: views of their history, projected texts, scoped recall and exported samples.

Ledger rows: scope, seq, event_id, kind, execution, attempt, ordinal, result, outcome, task, supersedes and, for texts, summary,
solution and lesson.  A correction has the kind of the fact that it replaces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import content_id, reference_key
from ..functions.text import projection_text
from . import digests
from .digests import Chain
from .ledger import effective


def replay(ledger: DataFrame) -> DataFrame:
    """(scope, execution, task, outcome, attempts, events): each execution as its effective records leave it.

    The task is that of its first record, the outcome the last effective one, attempts stand by ordinal with the last
    effective result, null while unfinished."""
    every = ledger.groupBy("scope", "execution").agg(F.min_by("task", "seq").alias("task"), F.count("*").alias("events"))
    now = effective(ledger, "scope")
    outcome = now.where("kind = 'OUTCOME_RECORDED'").groupBy("scope", "execution").agg(F.max_by("outcome", "seq").alias("outcome"))
    begun = now.where("kind = 'ATTEMPT_STARTED'").groupBy("scope", "execution", "attempt").agg(F.max_by("ordinal", "seq").alias("ordinal"))
    ended = now.where("kind = 'ATTEMPT_FINISHED'").groupBy("scope", "execution", "attempt").agg(F.max_by("result", "seq").alias("result"))
    attempts = begun.join(ended, ["scope", "execution", "attempt"], "left").groupBy("scope", "execution").agg(F.array_sort(F.collect_list(F.struct("ordinal", "attempt", "result"))).alias("attempts"))
    none = F.array().cast(dict(attempts.dtypes)["attempts"])
    return every.join(outcome, ["scope", "execution"], "left").join(attempts, ["scope", "execution"], "left").select("scope", "execution", "task", "outcome", F.coalesce("attempts", none).alias("attempts"), "events")


def state(ledger: DataFrame) -> DataFrame:
    """(scope, execution, task, begun, finished, ordinals, superseded, last_seq): what validation of the next event rests on."""
    kind = lambda k: F.col("kind") == k
    return ledger.groupBy("scope", "execution").agg(
        F.min_by("task", "seq").alias("task"),
        F.count_distinct(F.when(kind("ATTEMPT_STARTED"), F.col("attempt"))).alias("begun"),
        F.count_distinct(F.when(kind("ATTEMPT_FINISHED"), F.col("attempt"))).alias("finished"),
        F.array_sort(F.collect_set(F.when(kind("ATTEMPT_STARTED"), F.col("ordinal")))).alias("ordinals"),
        F.count("supersedes").alias("superseded"),
        F.max("seq").alias("last_seq"),
    )


def verify_views(views: DataFrame, ledger: DataFrame) -> DataFrame:
    """(scope, execution, finding): views that their history doesn't bear out."""
    v = views.select("scope", "execution", F.col("events").alias("_n"), F.size("attempts").alias("_a"), F.size(F.array_distinct(F.transform("attempts", lambda a: a["ordinal"]))).alias("_o"), F.lit(True).alias("_v"))
    h = ledger.groupBy("scope", "execution").agg(F.count("*").alias("_h"), F.count_if((F.col("kind") == "EXECUTION_STARTED") & F.col("supersedes").isNull()).alias("_s"))
    t = v.join(h, ["scope", "execution"], "full")
    found = F.array_compact(
        F.array(
            F.when(F.col("_h").isNull(), "VIEW_WITHOUT_HISTORY"),
            F.when(F.col("_v").isNull(), "HISTORY_WITHOUT_VIEW"),
            F.when(F.col("_n") != F.col("_h"), "EVENT_COUNT_DIFFERS"),
            F.when(F.col("_s") != 1, "NOT_STARTED_ONCE"),
            F.when(F.col("_a") != F.col("_o"), "ORDINAL_REPEATED"),
        )
    )
    return t.select("scope", "execution", F.explode(found).alias("finding"))


def revisions(ledger: DataFrame) -> DataFrame:
    """(scope, event_id, latest, later): for each record the one that its chain of corrections ends in, and how many follow it."""
    from .ledger import revision_roots

    roots = revision_roots(ledger).select("event_id", "root_id", "depth")
    t = ledger.select("scope", "event_id").join(roots, "event_id")
    end = t.groupBy("scope", "root_id").agg(F.max_by("event_id", "depth").alias("latest"), F.max("depth").alias("_last"))
    return t.join(end, ["scope", "root_id"]).select("scope", "event_id", "latest", (F.col("_last") - F.col("depth")).alias("later"))


def observations(evidence: DataFrame, policy: Column, *by: str) -> DataFrame:
    """(by, dimension, state, seq): of each dimension the latest observation that *policy* lets count; of one record's several the last.

    evidence: by, seq, observations array<struct<dimension, state>> and the columns of policy."""
    t = evidence.where(policy).select(*by, "seq", F.posexplode("observations").alias("_at", "_o")).select(*by, "seq", "_at", "_o.dimension", "_o.state")
    return t.groupBy(*by, "dimension").agg(F.max_by(F.struct("state", "seq"), F.struct("seq", "_at")).alias("_m")).select(*by, "dimension", "_m.state", "_m.seq")


def resolved(refs: DataFrame, ledger: DataFrame) -> DataFrame:
    """refs (scope, task, execution, attempt, event_id, revision) with seq, the record that all six name, null if there is none."""
    key = lambda t: reference_key(*(F.col(c) for c in ("scope", "task", "execution", "attempt", "event_id", "revision")))
    own = ledger.select(key(ledger).alias("_key"), "seq")
    return refs.withColumn("_key", key(refs)).join(own, "_key", "left").drop("_key")


# -- projection ------------------------------------------------------------------------------------------------------------


def projection_entries(ledger: DataFrame) -> DataFrame:
    """(scope, seq, entry, atom_id, execution, attempt, event_id, text): what a projector writes as it reads the ledger.

    A finished attempt projects the lines of its execution's summary, its solution and its lesson.  A corrected finish
    retires what the attempt stood for and projects anew; a corrected summary does so for the finished attempts whose text
    it changes.  The timeline of an attempt is a window of its own, so the whole is one shuffle by attempt."""
    fin = ledger.where("kind = 'ATTEMPT_FINISHED'").select("scope", "execution", "attempt", "seq", F.lit(None).cast("string").alias("summary"), F.struct("event_id", "solution", "lesson").alias("f"))
    start = ledger.where("kind = 'EXECUTION_STARTED'").select("scope", "execution", "seq", "summary")
    told = start.join(fin.select("scope", "execution", "attempt").distinct(), ["scope", "execution"]).select("scope", "execution", "attempt", "seq", "summary", F.lit(None).cast(fin.schema["f"].dataType).alias("f"))
    by = Window.partitionBy("scope", "execution", "attempt").orderBy("seq")
    t = fin.unionByName(told).withColumn("_s", F.last("summary", ignorenulls=True).over(by)).withColumn("_f", F.last("f", ignorenulls=True).over(by)).where("_f IS NOT NULL")
    text = projection_text(F.col("_s"), F.col("_f.solution"), F.col("_f.lesson"))
    t = t.withColumn("text", text).withColumn("atom_id", content_id(F.col("text")))
    t = t.withColumn("_old", F.lag(F.struct("atom_id", "_f.event_id", "text")).over(by))
    t = t.where(F.col("f").isNotNull() | F.col("_old").isNull() | (F.col("atom_id") != F.col("_old.atom_id")))
    row = lambda kind, a, e, x: F.struct(F.lit(kind).alias("entry"), a.alias("atom_id"), e.alias("event_id"), x.alias("text"))
    entries = F.array_compact(F.array(F.when(F.col("_old").isNotNull(), row("RETIRE", F.col("_old.atom_id"), F.col("_old.event_id"), F.col("_old.text"))), row("PROJECT", F.col("atom_id"), F.col("_f.event_id"), F.col("text"))))
    return t.select("scope", "seq", "execution", "attempt", F.explode(entries).alias("e")).select("scope", "seq", "e.entry", "e.atom_id", "execution", "attempt", "e.event_id", "e.text")


def projected(entries: DataFrame) -> DataFrame:
    """(scope, execution, attempt, event_id, atom_id, text): the live refs, from what each attempt projected last."""
    t = entries.where("entry = 'PROJECT'").groupBy("scope", "execution", "attempt").agg(F.max_by(F.struct("atom_id", "event_id", "text"), "seq").alias("p"))
    return t.select("scope", "execution", "attempt", "p.event_id", "p.atom_id", "p.text")


def atom_states(entries: DataFrame) -> DataFrame:
    """(scope, atom_id, state, refs): LIVE with the number of refs, RETIRED for atoms that no ref stands for any more."""
    live = projected(entries).groupBy("scope", "atom_id").agg(F.count("*").alias("refs"))
    return entries.select("scope", "atom_id").distinct().join(live, ["scope", "atom_id"], "left").select("scope", "atom_id", F.when(F.col("refs") > 0, "LIVE").otherwise("RETIRED").alias("state"), F.coalesce("refs", F.lit(0)).alias("refs"))


def pruned(entries: DataFrame) -> DataFrame:
    """Entries of live atoms only: what remains when the texts of retired atoms are dropped."""
    return entries.join(atom_states(entries).where("state = 'LIVE'").select("scope", "atom_id"), ["scope", "atom_id"], "left_semi")


def recall_experiences(scored: DataFrame, refs: DataFrame, limit: int = 50) -> DataFrame:
    """(query_id, rank, ref, atom_id, score): scored (query_id, atom_id, score) atoms expanded to their live refs.

    Retired atoms have no refs and drop out before anything is ranked, so nothing has to be fetched in excess.  Order:
    score, then atom, then canonical ref."""
    if not 1 <= limit <= 50:
        raise ValueError("limit must be between 1 and 50")
    t = scored.join(refs.select("atom_id", "ref"), "atom_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "atom_id", "ref"))
    return t.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "rank", "ref", "atom_id", "score")


# -- export ----------------------------------------------------------------------------------------------------------------


def digest(ledger: DataFrame, *scope: str) -> DataFrame:
    """(scope, n, digest): SHA-256 over '<seq>:<payload digest>' lines in the order of seq.

    The rows of a scope go by in order and are hashed one after the other: a task holds a hash's state, not the scope."""
    kinds = dict(ledger.dtypes)
    t = ledger.select(*scope, "seq", F.sha2("payload", 256).alias("_d"))

    from pyspark.sql.pandas.types import to_arrow_type

    names = [*scope, "n", "digest"]
    types = [*(to_arrow_type(t.schema[c].dataType) for c in scope), pa.int64(), pa.string()]

    def go(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, h, out = None, 0, hashlib.sha256(), []
        for b in it:
            cols = [c.to_pylist() for c in b.columns]
            for row in zip(*cols, strict=True):
                if row[:-2] != key:
                    if key is not None:
                        out.append((*key, n, h.hexdigest()))
                    key, n, h = row[:-2], 0, hashlib.sha256()
                h.update(f"{row[-2]}:{row[-1]}\n".encode())
                n += 1
        if key is not None:
            out.append((*key, n, h.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], types[k]) for k in range(len(names))], names)

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in scope), "n long", "digest string"])
    dealt = t.repartition(*scope).sortWithinPartitions(*scope, "seq") if scope else t.coalesce(1).sortWithinPartitions("seq")
    return dealt.mapInArrow(go, schema)


def export_page(ledger: DataFrame, size: int, cursor: dict | None = None, cutoff: int | None = None, chain: Chain | None = None) -> tuple[DataFrame, dict | None]:
    """((execution, start_seq) of one page of a scope's executions by start sequence, the cursor of the next page or None).

    The first page fixes the cutoff, by default the ledger's end, and the digest of the history up to it; later pages are
    refused if that history is another.  Pages are keysets on the start sequence, not offsets.  With a *chain* the digest rests
    on its stored blocks, and of the history only records of the open block are hashed; without, all blocks are."""
    if size < 1:
        raise ValueError("page size must be positive")
    end = ledger.agg(F.max("seq")).first()[0] or 0
    at = cursor["cutoff"] if cursor else end if cutoff is None else cutoff
    if at > end:
        raise ValueError(f"no record has sequence {at}; the last is {end}")
    past = ledger.where(F.col("seq") <= at)
    if chain:
        now = chain.at(ledger, at)
    else:
        row = digests.root(digests.blocks(past)).first()
        now = row["digest"] if row else None
    if cursor and cursor["digest"] != now:
        raise ValueError("the cursor was issued for another history")
    starts = past.groupBy("execution").agg(F.min("seq").alias("start_seq")).where(F.col("start_seq") > (cursor["after"] if cursor else 0))
    page = starts.orderBy("start_seq").limit(size)
    last = page.agg(F.max("start_seq").alias("m"), F.count("*").alias("n")).first()
    more = last["n"] == size and starts.where(F.col("start_seq") > last["m"]).limit(1).count() == 1
    return page, {"cutoff": at, "after": last["m"], "digest": now} if more else None


def page_digest(rows: DataFrame, order: str) -> str:
    """SHA-256 over the JSON lines of a page, in order.  A page is bounded by its size."""
    h = hashlib.sha256()
    for r in rows.select(F.to_json(F.struct("*")).alias("j"), F.col(order).alias("o")).orderBy("o").toLocalIterator():
        h.update((r["j"] + "\n").encode())
    return h.hexdigest()


def sample_violations(samples: DataFrame) -> DataFrame:
    """(execution, violation) of samples (execution, label, reasons, status, success_ordinal) that break their contract."""
    lab, n = F.col("label"), F.size("reasons")
    found = F.array_compact(
        F.array(
            F.when(~lab.isin("SUCCESS", "FAILURE", "UNLABELED"), "UNKNOWN_LABEL"),
            F.when((lab == "UNLABELED") & (n == 0), "UNLABELED_WITHOUT_REASON"),
            F.when((lab != "UNLABELED") & (n > 0), "LABELED_DESPITE_REASONS"),
            F.when((lab == "SUCCESS") & (F.col("status") != "VALIDATED_ACCEPTED"), "INCONSISTENT_DERIVATION"),
            F.when((lab == "SUCCESS") != F.col("success_ordinal").isNotNull(), "ORDINAL_MISPLACED"),
        )
    )
    return samples.select("execution", F.explode(found).alias("violation"))
