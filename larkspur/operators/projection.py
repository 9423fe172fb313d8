"""The maintained projection of a ledger: which atoms stand for which finished attempts, kept up as records come.

A projection is derived from the ledger and kept beside it as a log.  Each record is covered once, in the order of its scope:
PROJECT and RETIRE rows say what it changed, a COVER row that it is done, with the digest of its payload.  A batch of records is
three tables: its rows of the log, the state that later batches start from, and, written last, how far each scope is covered.
A batch without that last table was cut off; readers pass it over, and the next one writes in its place.

Only what a batch touches is worked out: executions of its records, from their last summary and their attempts' last finish.
The result is the same for any split of the ledger into batches, and as `experience.projection_entries` of the whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import content_id, reference_key
from ..functions.text import projection_text
from ..sources.snapshots import Folder, Snapshots
from . import experience
from .prefix import Running, running

_FINISH = "event_id string, solution string, lesson string"
LOG = "scope string, seq long, place int, entry string, atom_id string, execution string, attempt string, event_id string, text string, digest string"
STATE = f"scope string, execution string, attempt string, seq long, summary string, f struct<{_FINISH.replace(' string', ':string')}>"
COVERED = "scope string, covered long"
#: Place of a COVER row among those of its record.
LAST = 2


def contiguous(rows: DataFrame, covered: DataFrame) -> DataFrame:
    """The rows of each scope that follow its covered sequence without a gap.

    A row starts a gap if the one before it is neither there nor the covered one; rows from the first such on are left for later.
    That is an equality join and a minimum, no window over a scope."""
    t = rows.join(covered, "scope", "left").withColumn("covered", F.coalesce("covered", F.lit(0).cast("long"))).where("seq > covered")
    before = t.select("scope", (F.col("seq") + 1).alias("seq"), F.lit(True).alias("_before")).distinct()
    gap = t.select("scope", "seq", "covered").join(before, ["scope", "seq"], "left").where("_before IS NULL AND seq <> covered + 1")
    stop = gap.groupBy("scope").agg(F.min("seq").alias("_stop"))
    return t.join(stop, "scope", "left").where("_stop IS NULL OR seq < _stop").drop("covered", "_stop")


def entries(new: DataFrame, seeds: DataFrame) -> DataFrame:
    """LOG rows of new records, without COVER and digest.  seeds: STATE rows of their executions as of the record before."""
    none = F.lit(None).cast(f"struct<{_FINISH.replace(' string', ':string')}>")
    finish = F.struct("event_id", "solution", "lesson").alias("f")
    fin = new.where("kind = 'ATTEMPT_FINISHED'").select("scope", "execution", "attempt", "seq", F.lit(None).cast("string").alias("summary"), finish)
    fin = fin.unionByName(seeds.where("attempt IS NOT NULL").select("scope", "execution", "attempt", F.lit(0).cast("long").alias("seq"), F.lit(None).cast("string").alias("summary"), "f"))
    start = new.where("kind = 'EXECUTION_STARTED'").select("scope", "execution", "seq", "summary")
    start = start.unionByName(seeds.where("attempt IS NULL").select("scope", "execution", F.lit(0).cast("long").alias("seq"), "summary"))
    told = start.join(fin.select("scope", "execution", "attempt").distinct(), ["scope", "execution"]).select("scope", "execution", "attempt", "seq", "summary", none.alias("f"))
    by = Window.partitionBy("scope", "execution", "attempt").orderBy("seq", F.col("f").isNotNull())
    t = fin.unionByName(told).withColumn("_s", F.last("summary", ignorenulls=True).over(by)).withColumn("_f", F.last("f", ignorenulls=True).over(by)).where("_f IS NOT NULL")
    t = t.withColumn("text", projection_text(F.col("_s"), F.col("_f.solution"), F.col("_f.lesson"))).withColumn("atom_id", content_id(F.col("text")))
    t = t.withColumn("_old", F.lag(F.struct("atom_id", "_f.event_id", "text")).over(by))
    t = t.where(F.col("seq") > 0).where(F.col("f").isNotNull() | F.col("_old").isNull() | (F.col("atom_id") != F.col("_old.atom_id")))
    row = lambda place, kind, a, e, x: F.struct(F.lit(place).alias("place"), F.lit(kind).alias("entry"), a.alias("atom_id"), e.alias("event_id"), x.alias("text"))
    made = F.array_compact(F.array(F.when(F.col("_old").isNotNull(), row(0, "RETIRE", F.col("_old.atom_id"), F.col("_old.event_id"), F.col("_old.text"))), row(1, "PROJECT", F.col("atom_id"), F.col("_f.event_id"), F.col("text"))))
    return t.select("scope", "seq", "execution", "attempt", F.explode(made).alias("e")).select("scope", "seq", "e.place", "e.entry", "e.atom_id", "execution", "attempt", "e.event_id", "e.text")


def states(new: DataFrame) -> DataFrame:
    """STATE rows that new records leave: the last summary of an execution (attempt null), the last finish of an attempt."""
    told = new.where("kind = 'EXECUTION_STARTED' AND summary IS NOT NULL").groupBy("scope", "execution").agg(F.max_by("summary", "seq").alias("summary"), F.max("seq").alias("seq"))
    fin = new.where("kind = 'ATTEMPT_FINISHED'").groupBy("scope", "execution", "attempt").agg(F.max_by(F.struct("event_id", "solution", "lesson"), "seq").alias("f"), F.max("seq").alias("seq"))
    return told.withColumn("attempt", F.lit(None).cast("string")).withColumn("f", F.lit(None).cast(fin.schema["f"].dataType)).unionByName(fin.withColumn("summary", F.lit(None).cast("string"))).select("scope", "execution", "attempt", "seq", "summary", "f")


class Projection:
    """A projection under a folder.  Ledger rows: scope, seq (from 1, without gaps, in each scope), event_id, kind, execution,
    attempt, summary, solution, lesson and payload."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.versions = spark, Snapshots(spark, root)

    # -- reading

    def _batches(self, path: str) -> tuple[list[int], list[int]]:
        """Numbers of whole batches, and of those that were cut off."""
        at = Folder(self.spark, path)
        seen = {int(n.removeprefix("b")) for kind in ("log", "state", "covered") for n in at.names(kind) if n.startswith("b")}
        whole = sorted(n for n in seen if at.exists("covered", f"b{n}", "_SUCCESS"))
        return whole, sorted(seen - set(whole))

    def _read(self, path: str, kind: str, schema: str, batches: list[int]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{path}/{kind}/b{n}" for n in batches))

    def log(self) -> DataFrame:
        """LOG rows of the published version's whole batches; no rows if there is none."""
        path = self.versions.current()
        return self._read(path or "", "log", LOG, self._batches(path)[0] if path else [])

    def covered(self) -> DataFrame:
        """(scope, covered): the last record of each scope that is projected."""
        path = self.versions.current()
        return self._read(path or "", "covered", COVERED, self._batches(path)[0] if path else []).groupBy("scope").agg(F.max("covered").alias("covered"))

    def refs(self) -> DataFrame:
        """(scope, execution, attempt, event_id, atom_id, text) of live refs."""
        return experience.projected(self.log().where("entry <> 'COVER'"))

    # -- writing

    def _write(self, path: str, n: int, new: DataFrame, seeds: DataFrame) -> None:
        cover = new.select("scope", "seq", F.lit(LAST).alias("place"), F.lit("COVER").alias("entry"), F.sha2("payload", 256).alias("digest"))
        entries(new, seeds).unionByName(cover, allowMissingColumns=True).select(*(c.split(" ")[0] for c in LOG.split(", "))).write.mode("overwrite").parquet(f"{path}/log/b{n}")
        states(new).write.mode("overwrite").parquet(f"{path}/state/b{n}")
        new.groupBy("scope").agg(F.max("seq").alias("covered")).write.mode("overwrite").parquet(f"{path}/covered/b{n}")

    def advance(self, ledger: DataFrame) -> bool:
        """Project the ledger's records that aren't covered yet, as far as each scope has no gap; False if there are none.

        A batch that was cut off is written anew under its number.  Without a version this is the first batch of a new one."""
        path = self.versions.current()
        if path is None:
            self.rebuild(ledger)
            return True
        whole, _ = self._batches(path)
        new = contiguous(ledger, self.covered())
        if new.limit(1).count() == 0:
            return False
        touched = new.select("scope", "execution").distinct()
        last = self._read(path, "state", STATE, whole).join(touched, ["scope", "execution"], "left_semi")
        last = last.groupBy("scope", "execution", "attempt").agg(F.max_by(F.struct("summary", "f"), "seq").alias("v")).select("scope", "execution", "attempt", "v.summary", "v.f")
        self._write(path, (whole[-1] if whole else 0) + 1, new, last)
        return True

    def rebuild(self, ledger: DataFrame) -> str:
        """A new version from the whole ledger, published once it is whole; earlier ones are removed."""
        none = self.spark.createDataFrame([], STATE)
        new = contiguous(ledger, self.spark.createDataFrame([], COVERED))
        path = self.versions.build(lambda to: self._write(to, 1, new, none))
        self.versions.prune()
        return path

    # -- verification

    def problems(self, ledger: DataFrame) -> DataFrame:
        """(scope, problem): BEYOND_LEDGER, COVER_MISSING (a covered record without its COVER, or with several), DIFFERENT_LEDGER
        (a digest that isn't the record's), UNCOVERED_ENTRY (rows of a record without COVER), MAPPING_DIFFERS (live refs that the
        covered records don't give)."""
        log, covered = self.log(), self.covered()
        head = ledger.groupBy("scope").agg(F.max("seq").alias("head"))
        cover = log.where("entry = 'COVER'")
        found = [
            covered.join(head, "scope", "left").where("covered > coalesce(head, 0)").select("scope", F.lit("BEYOND_LEDGER").alias("problem")),
            covered.join(cover.groupBy("scope").agg(F.count("*").alias("n"), F.count_distinct("seq").alias("d"), F.max("seq").alias("m")), "scope", "left").where("coalesce(n, 0) <> covered OR d <> n OR m <> covered").select("scope", F.lit("COVER_MISSING").alias("problem")),
            cover.join(ledger.select("scope", "seq", F.sha2("payload", 256).alias("_d")), ["scope", "seq"]).where("digest <> _d").select("scope", F.lit("DIFFERENT_LEDGER").alias("problem")),
            log.where("entry <> 'COVER'").join(cover.select("scope", "seq"), ["scope", "seq"], "left_anti").select("scope", F.lit("UNCOVERED_ENTRY").alias("problem")),
        ]
        part = ledger.join(covered, "scope").where("seq <= covered")
        columns = ["scope", "execution", "attempt", "event_id", "atom_id"]
        want, have = (t.select(*columns) for t in (experience.projected(experience.projection_entries(part)), self.refs()))
        found.append(want.exceptAll(have).unionByName(have.exceptAll(want)).select("scope", F.lit("MAPPING_DIFFERS").alias("problem")))
        out = found[0]
        for t in found[1:]:
            out = out.unionByName(t)
        return out.distinct()

    def status(self, ledger: DataFrame) -> DataFrame:
        """(scope, covered, head, status, problems) of the ledger's and the projection's scopes: MISSING, INCOMPATIBLE, STALE (not up
        to the head, or a batch was cut off) or CURRENT."""
        path = self.versions.current()
        torn = bool(self._batches(path)[1]) if path else False
        head = ledger.groupBy("scope").agg(F.max("seq").alias("head"))
        odd = self.problems(ledger).groupBy("scope").agg(F.array_sort(F.collect_set("problem")).alias("problems"))
        t = head.join(self.covered(), "scope", "full").join(odd, "scope", "left")
        state = F.when(F.col("covered").isNull() if path else F.lit(True), "MISSING").when(F.col("problems").isNotNull(), "INCOMPATIBLE").when(F.lit(torn) | (F.col("covered") < F.col("head")), "STALE").otherwise("CURRENT")
        return t.select("scope", "covered", "head", state.alias("status"), F.coalesce("problems", F.array().cast("array<string>")).alias("problems"))


# -- the log as framed lines ----------------------------------------------------------------------------------------------------


def framed_log(log: DataFrame, dimensions: int = 128) -> DataFrame:
    """(scope, line, value): a scope's log as lines 'MXP1 number bytes sha256 payload' (tabs), the first of which is its header.

    Payloads: HEADER|1|summary-text-v1|dimensions|scope, PROJECT and RETIRE with sequence, atom and ref, COVER with sequence
    and digest.  Lines are numbered by a running count in blocks, so that a scope is many tasks."""
    ref = reference_key(*map(F.col, ("scope", "execution", "attempt", "event_id")))
    body = F.when(F.col("entry") == "COVER", F.concat_ws("|", "entry", "seq", "digest")).otherwise(F.concat_ws("|", "entry", "seq", "atom_id", ref))
    # rows of a record stand in the order: retired, projected, cover; several attempts of a record by their ref
    rows = log.select("scope", "seq", "place", body.alias("payload"))
    head = log.select("scope").distinct().select("scope", F.lit(0).cast("long").alias("seq"), F.lit(0).alias("place"), F.concat_ws("|", F.lit("HEADER"), F.lit("1"), F.lit("summary-text-v1"), F.lit(str(dimensions)), "scope").alias("payload"))
    t = running(head.unionByName(rows).withColumn("_cover", (F.col("place") == LAST).cast("int")), ["scope"], ["seq", "_cover", "payload"], [Running("line", "sum", F.lit(1).cast("long"))])
    return t.select("scope", "line", F.concat_ws("\t", F.lit("MXP1"), F.col("line").cast("string"), F.octet_length("payload").cast("string"), F.sha2("payload", 256), "payload").alias("value"))


def read_framed_log(lines: DataFrame) -> DataFrame:
    """lines (scope, line, value) as (scope, line, entry, seq, atom_id, ref, digest, finding).

    Findings: MALFORMED_LINE (frame, number, length or digest), MALFORMED_ENTRY, UNKNOWN_VERSION (of the header), COVER_OUT_OF_ORDER
    (each sequence is covered once, in order), UNCOVERED_TAIL (after a scope's last COVER; not a defect, but the batch was cut off)."""
    p = F.split("value", "\t", 5)
    get = lambda c, k: F.get(c, F.lit(k))
    payload = get(p, 4)
    framed = (F.size(p) == 5) & (get(p, 0) == "MXP1") & (get(p, 1) == F.col("line").cast("string")) & (get(p, 2) == F.octet_length(payload).cast("string")) & (get(p, 3) == F.sha2(payload, 256))
    part = F.split(payload, r"\|", -1)
    kind = get(part, 0)
    seq = F.expr("try_cast(get(split(get(split(value, '\t', 5), 4), '[|]', -1), 1) AS BIGINT)")
    ok = F.when(kind == "HEADER", (F.col("line") == 1) & (F.size(part) >= 5)).when(kind == "COVER", (F.size(part) == 3) & (seq > 0) & get(part, 2).rlike("^[0-9a-f]{64}$")).when(kind.isin("PROJECT", "RETIRE"), (F.size(part) >= 4) & (seq > 0)).otherwise(False)
    t = lines.select("scope", "line", kind.alias("entry"), seq.alias("seq"), F.when(kind.isin("PROJECT", "RETIRE"), get(part, 2)).alias("atom_id"), F.when(kind.isin("PROJECT", "RETIRE"), get(part, 3)).alias("ref"), F.when(kind == "COVER", get(part, 2)).alias("digest"), F.coalesce(framed, F.lit(False)).alias("_framed"), F.coalesce(ok, F.lit(False)).alias("_ok"), get(part, 1).alias("_version"))
    cover = (F.col("entry") == "COVER") & F.col("_framed") & F.col("_ok")
    t = running(t, ["scope"], ["line"], [Running("_covers", "sum", F.when(cover, 1).otherwise(0).cast("long"))])
    last = t.groupBy("scope").agg(F.max(F.when(cover, F.col("line"))).alias("_last"))
    t = t.join(last, "scope")
    due = F.col("_covers") + F.when(cover, 0).otherwise(1)
    finding = (
        F.when(~F.col("_framed"), "MALFORMED_LINE")
        .when(~F.col("_ok"), "MALFORMED_ENTRY")
        .when((F.col("entry") == "HEADER") & (F.col("_version") != "1"), "UNKNOWN_VERSION")
        .when((F.col("entry") != "HEADER") & (F.col("line") > F.coalesce("_last", F.lit(0))), "UNCOVERED_TAIL")
        .when((F.col("entry") != "HEADER") & (F.col("seq") != due), "COVER_OUT_OF_ORDER")
    )
    return t.select("scope", "line", "entry", F.when(F.col("entry") != "HEADER", F.col("seq")).alias("seq"), "atom_id", "ref", "digest", finding.alias("finding"))
