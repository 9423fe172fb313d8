"""Registered queries over executions and their ledgers: views, projection, export, validation, comparison, cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import audit, compare, cost, digests, experience, ledger, recall
from ..sources import segments, snapshots
from . import oracle
from .catalog import executions, query, read

#: Kinds of facts that events stand for.
_KIND = "CASE event_type WHEN 'signup' THEN 'EXECUTION_STARTED' WHEN 'click' THEN 'ATTEMPT_STARTED' WHEN 'purchase' THEN 'ATTEMPT_FINISHED' WHEN 'error' THEN 'OUTCOME_RECORDED' ELSE 'STAGE_RECORDED' END"
_ROW = (
    f"'s' || (user_id % 3) AS scope, event_id + 1 AS seq, 'e' || event_id AS event_id, {_KIND} AS kind, 'x' || user_id AS execution, 't' || (user_id % 5) AS task, "
    "CASE WHEN event_type IN ('click', 'purchase', 'view') THEN 'a' || (event_id % 4) END AS attempt, CAST(CASE WHEN event_type = 'click' THEN event_id % 4 END AS INT) AS ordinal, "
    "CASE WHEN event_type = 'purchase' THEN CASE event_id % 3 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'FAILED' ELSE 'CANCELLED' END END AS result, "
    "CASE WHEN event_type = 'error' THEN CASE event_id % 2 WHEN 0 THEN 'ACCEPTED' ELSE 'REJECTED' END END AS outcome, "
    "CASE WHEN event_type = 'signup' THEN 'summary ' || (event_id % 4) END AS summary, CASE WHEN event_type = 'purchase' THEN 'solution ' || (event_id % 6) END AS solution, "
    "CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 'lesson' END AS lesson, event_type || '|' || event_id AS payload"
)
#: The same rows in both dialects; every seventh record corrects the one of its kind before it.
_HISTORY = (
    f"WITH h0 AS (SELECT {_ROW}, event_id % 7 = 0 AS corrects FROM events), "
    "h AS (SELECT * EXCLUDE (corrects), CASE WHEN corrects THEN lag(event_id) OVER (PARTITION BY execution, kind ORDER BY seq) END AS supersedes FROM h0) "
)
_EFFECTIVE = ", eff AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h s WHERE s.scope = h.scope AND s.supersedes = h.event_id)) "


def history(spark: SparkSession, d: str) -> DataFrame:
    read(spark, d, "events").createOrReplaceTempView("larkspur_events")
    t = spark.sql(f"SELECT {_ROW}, event_id % 7 = 0 AS corrects FROM larkspur_events")
    return t.withColumn("supersedes", F.when(F.col("corrects"), F.lag("event_id").over(Window.partitionBy("execution", "kind").orderBy("seq")))).drop("corrects")


_REPLAY = (
    _HISTORY
    + _EFFECTIVE
    + ", o AS (SELECT execution, arg_max(outcome, seq) AS outcome FROM eff WHERE kind = 'OUTCOME_RECORDED' GROUP BY 1), "
    "b AS (SELECT execution, attempt, arg_max(ordinal, seq) AS ordinal FROM eff WHERE kind = 'ATTEMPT_STARTED' GROUP BY ALL), f AS (SELECT execution, attempt, arg_max(result, seq) AS result FROM eff WHERE kind = 'ATTEMPT_FINISHED' GROUP BY ALL), "
    "a AS (SELECT execution, string_agg(b.ordinal || ':' || b.attempt || ':' || coalesce(result, ''), ',' ORDER BY b.ordinal, b.attempt) AS attempts FROM b LEFT JOIN f USING (execution, attempt) GROUP BY 1) "
)


@query(_REPLAY + "SELECT h.scope, h.execution, arg_min(task, seq) AS task, any_value(o.outcome) AS outcome, coalesce(any_value(attempts), '') AS attempts, count(*) AS events FROM h LEFT JOIN o USING (execution) LEFT JOIN a USING (execution) GROUP BY ALL")
def replay_views(spark, d):
    v = experience.replay(history(spark, d))
    line = F.array_join(F.transform("attempts", lambda a: F.concat_ws(":", a["ordinal"].cast("string"), a["attempt"], F.coalesce(a["result"], F.lit("")))), ",")
    return v.select("scope", "execution", "task", "outcome", line.alias("attempts"), "events")


@query(_HISTORY + "SELECT scope, execution, arg_min(task, seq) AS task, count(DISTINCT CASE WHEN kind = 'ATTEMPT_STARTED' THEN attempt END) AS begun, count(DISTINCT CASE WHEN kind = 'ATTEMPT_FINISHED' THEN attempt END) AS finished, coalesce(array_to_string(list_sort(list(DISTINCT ordinal) FILTER (kind = 'ATTEMPT_STARTED')), ','), '') AS ordinals, count(supersedes) AS superseded, max(seq) AS last_seq FROM h GROUP BY scope, execution")
def ledger_state(spark, d):
    return experience.state(history(spark, d)).withColumn("ordinals", F.array_join(F.transform("ordinals", lambda x: x.cast("string")), ","))


@query(_HISTORY + ", n AS (SELECT scope, execution, count(*) FILTER (kind = 'EXECUTION_STARTED' AND supersedes IS NULL) AS s FROM h GROUP BY ALL) SELECT scope, execution, 'EVENT_COUNT_DIFFERS' AS finding FROM n WHERE CAST(substr(execution, 2) AS INT) % 4 = 1 UNION ALL SELECT scope, execution, 'NOT_STARTED_ONCE' FROM n WHERE s <> 1 AND CAST(substr(execution, 2) AS INT) % 4 <> 2 UNION ALL SELECT scope, execution, 'HISTORY_WITHOUT_VIEW' FROM n WHERE CAST(substr(execution, 2) AS INT) % 4 = 2 UNION ALL SELECT scope, execution, 'NOT_STARTED_ONCE' FROM n WHERE s <> 1 AND CAST(substr(execution, 2) AS INT) % 4 = 2")
def view_findings(spark, d):
    """Views of which a quarter miscounts and a quarter is lost."""
    h = history(spark, d)
    k = F.substring("execution", 2, 9).cast("int") % 4
    v = experience.replay(h).where(k != 2).withColumn("events", F.when(k == 1, F.col("events") + 1).otherwise(F.col("events")))
    return experience.verify_views(v, h)


@query(_HISTORY.replace("WITH", "WITH RECURSIVE", 1) + ", w AS (SELECT event_id, event_id AS cur, 0 AS later FROM h UNION ALL SELECT w.event_id, n.event_id, w.later + 1 FROM w JOIN h n ON n.supersedes = w.cur) SELECT h.scope, event_id, arg_max(cur, later) AS latest, max(later) AS later FROM w JOIN h USING (event_id) GROUP BY ALL")
def revision_latest(spark, d):
    return experience.revisions(history(spark, d))


_OBS = "WITH o AS (SELECT 'x' || user_id AS execution, event_id AS seq, 'p' || (event_id % 2) AS policy, unnest(['TESTS', 'SECURITY', 'TESTS']) AS dimension, unnest([event_id % 3, event_id % 4, event_id % 2]) AS s, unnest([0, 1, 2]) AS pos FROM events WHERE event_type = 'view') "


@query(_OBS + "SELECT execution, dimension, (['PASS', 'FAIL', 'UNKNOWN', 'NOT_APPLICABLE'])[arg_max(s, seq * 10 + pos) + 1] AS state, arg_max(seq, seq * 10 + pos) AS seq FROM o WHERE policy = 'p1' GROUP BY ALL")
def gate_observations(spark, d):
    names = F.array(*map(F.lit, ["PASS", "FAIL", "UNKNOWN", "NOT_APPLICABLE"]))
    one = lambda n, m: F.struct(F.lit(n).alias("dimension"), F.element_at(names, (F.col("event_id") % m + 1).cast("int")).alias("state"))
    e = read(spark, d, "events").where("event_type = 'view'").select(F.concat(F.lit("x"), F.col("user_id").cast("string")).alias("execution"), F.col("event_id").alias("seq"), F.concat(F.lit("p"), (F.col("event_id") % 2).cast("string")).alias("policy"), F.array(one("TESTS", 3), one("SECURITY", 4), one("TESTS", 2)).alias("observations"))
    return experience.observations(e, F.col("policy") == "p1", "execution")


# -- projection ----------------------------------------------------------------------------------------------------------------

_TEXT = "concat_ws(chr(10), s, f.solution, f.lesson)"
_ENTRIES = (
    _HISTORY
    + ", fin AS (SELECT scope, execution, attempt, seq, NULL AS summary, {'event_id': event_id, 'solution': solution, 'lesson': lesson} AS f0 FROM h WHERE kind = 'ATTEMPT_FINISHED'), "
    "told AS (SELECT h.scope, h.execution, a.attempt, h.seq, h.summary, NULL AS f0 FROM h JOIN (SELECT DISTINCT execution, attempt FROM fin) a USING (execution) WHERE kind = 'EXECUTION_STARTED'), "
    "tl AS (SELECT *, last_value(summary IGNORE NULLS) OVER w AS s, last_value(f0 IGNORE NULLS) OVER w AS f FROM (SELECT * FROM fin UNION ALL SELECT * FROM told) WINDOW w AS (PARTITION BY execution, attempt ORDER BY seq ROWS UNBOUNDED PRECEDING)), "
    f"tx AS (SELECT *, {_TEXT} AS text FROM tl WHERE f IS NOT NULL), ta AS (SELECT *, {oracle.content_id('text')} AS atom_id FROM tx), "
    "tb AS (SELECT *, lag(atom_id) OVER w AS old_atom, lag(f.event_id) OVER w AS old_event FROM ta WINDOW w AS (PARTITION BY execution, attempt ORDER BY seq)), "
    "tc AS (SELECT * FROM tb WHERE f0 IS NOT NULL OR old_atom IS NULL OR old_atom <> atom_id), "
    "entries AS (SELECT scope, seq, 'RETIRE' AS entry, old_atom AS atom_id, execution, attempt, old_event AS event_id FROM tc WHERE old_atom IS NOT NULL UNION ALL SELECT scope, seq, 'PROJECT', atom_id, execution, attempt, f.event_id FROM tc) "
)


@query(_ENTRIES + "SELECT * FROM entries")
def projection_log(spark, d):
    return experience.projection_entries(history(spark, d)).drop("text")


_LIVE = _ENTRIES + ", refs AS (SELECT scope, execution, attempt, arg_max(atom_id, seq) AS atom_id, arg_max(event_id, seq) AS event_id FROM entries WHERE entry = 'PROJECT' GROUP BY ALL) "


@query(_LIVE + ", n AS (SELECT scope, atom_id, count(*) AS refs FROM refs GROUP BY ALL) SELECT e.scope, e.atom_id, CASE WHEN n.refs > 0 THEN 'LIVE' ELSE 'RETIRED' END AS state, coalesce(n.refs, 0) AS refs FROM (SELECT DISTINCT scope, atom_id FROM entries) e LEFT JOIN n USING (scope, atom_id)")
def projection_states(spark, d):
    return experience.atom_states(experience.projection_entries(history(spark, d)))


_ASKED = "text || ' summary ' || (item_id % 4) || ' solution ' || (item_id % 6)"


@query(
    _LIVE
    + ", "
    + oracle.scored("ta", asked=_ASKED)
    + "hit AS (SELECT query_id, atom_id, score, scope || '/' || execution || '/' || attempt || '/' || event_id AS ref FROM scored JOIN refs USING (atom_id) WHERE score >= 0), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, atom_id, ref) AS rank FROM hit) SELECT query_id, rank, ref, atom_id, score FROM k WHERE rank <= 20"
)
def experience_hits(spark, d):
    """Recall over the texts of live atoms, expanded to the refs that they stand for: 20 atoms have 20 refs at least."""
    live = experience.projected(experience.projection_entries(history(spark, d)))
    refs = live.select("atom_id", ids.reference_key(*map(F.col, ("scope", "execution", "attempt", "event_id"))).alias("ref"))
    k = F.col("item_id")
    asked = read(spark, d, "benchmark").select(k.alias("query_id"), F.concat("text", F.lit(" summary "), (k % 4).cast("string"), F.lit(" solution "), (k % 6).cast("string")).alias("text"))
    scored = recall.recall(live.select("atom_id", F.col("text").alias("content")).distinct(), asked, 20, 0.0, digits=6)
    return experience.recall_experiences(scored, refs, 20)


@query(_HISTORY + ", s AS (SELECT execution, min(seq) AS start_seq FROM h WHERE seq <= 900 GROUP BY 1) SELECT execution, start_seq FROM s ORDER BY start_seq LIMIT 7 OFFSET 7")
def export_pages(spark, d):
    """The second page of seven executions as of sequence 900."""
    h, chain = history(spark, d), digests.Chain(spark, snapshots.scratch(spark, "digests"), 64)
    _, cursor = experience.export_page(h, 7, cutoff=900, chain=chain)
    return experience.export_page(h, 7, cursor, chain=chain)[0]


@query(
    _HISTORY
    + ", b AS (SELECT scope, (seq - 1) // 64 AS b1, c, count(*) AS n, sha256(string_agg(seq || ':' || sha256(payload) || chr(10), '' ORDER BY seq)) AS d FROM h, (VALUES (700), (1099511627776)) t(c) WHERE seq <= c GROUP BY ALL), "
    "b2 AS (SELECT scope, c, b1 // 64 AS b2, sum(n) AS n, sha256(string_agg(b1 || ':' || d || chr(10), '' ORDER BY b1)) AS d FROM b GROUP BY ALL), b3 AS (SELECT scope, c, b2 // 64 AS b3, sum(n) AS n, sha256(string_agg(b2 || ':' || d || chr(10), '' ORDER BY b2)) AS d FROM b2 GROUP BY ALL) "
    "SELECT scope, c AS cutoff, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(b3 || ':' || d || chr(10), '' ORDER BY b3)) AS digest FROM b3 GROUP BY ALL"
)
def digest_tree(spark, d):
    """Digests by blocks of every scope, of its beginning and of the whole."""
    h = history(spark, d)
    t = h.withColumn("cutoff", F.explode(F.array(F.lit(700).cast("long"), F.lit(1 << 40)))).where("seq <= cutoff")
    return digests.root(digests.blocks(t, "scope", "cutoff", fan=64), "scope", "cutoff", fan=64)


@query(oracle.EXECUTIONS + f", l AS (SELECT o_orderkey, {oracle.LABEL} AS label, status FROM exec) SELECT CAST(o_orderkey AS VARCHAR) AS execution, v AS violation FROM (SELECT o_orderkey, unnest(list_filter([CASE WHEN label <> 'UNLABELED' AND o_orderkey % 3 = 0 THEN 'LABELED_DESPITE_REASONS' END, CASE WHEN label = 'UNLABELED' AND o_orderkey % 3 <> 0 THEN 'UNLABELED_WITHOUT_REASON' END, CASE WHEN label = 'SUCCESS' THEN 'ORDINAL_MISPLACED' END], lambda x: x IS NOT NULL)) AS v FROM l)")
def sample_violations(spark, d):
    """Samples whose reasons and ordinals were replaced."""
    t = executions(spark, d).withColumn("label", ledger.sample_label(F.col("acc.status"), F.col("why")))
    odd = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("X"))).otherwise(F.array().cast("array<string>"))
    return experience.sample_violations(t.select(F.col("o_orderkey").cast("string").alias("execution"), "label", odd.alias("reasons"), F.col("acc.status").alias("status"), F.lit(None).cast("int").alias("success_ordinal")))


# -- records ------------------------------------------------------------------------------------------------------------------


@query(_HISTORY + "SELECT event_id, CASE WHEN seq % 5 = 0 THEN 'MALFORMED_RECORD' WHEN seq % 5 = 1 THEN 'UNSUPPORTED_SCHEMA' END AS finding, CASE WHEN seq % 5 <> 0 THEN kind END AS kind, CASE WHEN seq % 5 <> 0 THEN ordinal END AS ordinal, CASE WHEN seq % 5 <> 0 THEN solution END AS solution FROM h")
def payload_codec(spark, d):
    """Events as canonical JSON and back; a fifth is written with a blank, a fifth has another schema."""
    h = history(spark, d)
    cols = {c: F.col(c) for c in ("kind", "scope", "task", "execution", "event_id", "attempt", "ordinal", "result", "solution", "lesson", "outcome", "summary")}
    j = segments.encode_payload(cols | {"schema": F.when(F.col("seq") % 5 == 1, 2).otherwise(1)})
    j = F.when(F.col("seq") % 5 == 0, F.replace(j, F.lit('{"schema"'), F.lit('{ "schemaa"'))).otherwise(j)
    t = h.select("event_id", "seq", segments.decode_payload(j).alias("p"))
    got = lambda c: F.when(F.col("seq") % 5 != 0, F.col(f"p.event.{c}")).alias(c)
    return t.select("event_id", "p.finding", got("kind"), got("ordinal"), got("solution"))


@query("WITH l AS (SELECT 'f' || (event_id % 5) AS path, event_id // 5 AS line FROM events), v AS (SELECT *, CASE line % 50 WHEN 20 THEN line + 5 WHEN 30 THEN line ELSE line + 1 END AS seq, line % 50 = 49 AS cut FROM l), s AS (SELECT *, coalesce(lag(seq) OVER (PARTITION BY path ORDER BY line), 0) AS before FROM v), f AS (SELECT path, line, seq, CASE WHEN cut THEN 'MALFORMED_RECORD' WHEN seq = before THEN 'DUPLICATE_SEQUENCE' WHEN seq <> before + 1 THEN 'SEQUENCE_GAP' END AS finding FROM s) SELECT path, line, seq, finding, count(finding) OVER (PARTITION BY path ORDER BY line ROWS UNBOUNDED PRECEDING) = 0 AS in_prefix FROM f")
def segment_scan(spark, d):
    """Framed lines of five segments with cut payloads, a gap and a repeat in every fifty."""
    line = F.expr("event_id div 5")
    seq = F.when(line % 50 == 20, line + 5).when(line % 50 == 30, line).otherwise(line + 1)
    value = ledger.framed(seq, F.concat(F.lit("payload "), F.col("event_id").cast("string")))
    value = F.when(line % 50 == 49, F.concat(value, F.lit("x"))).otherwise(value)
    t = read(spark, d, "events").select(F.concat(F.lit("f"), (F.col("event_id") % 5).cast("string")).alias("path"), line.alias("line"), value.alias("value"), F.lit(False).alias("torn"), F.lit(False).alias("broken"))
    return segments.scan_lines(t).drop("payload")


@query("WITH i AS (SELECT event_id AS line, CASE event_id % 11 WHEN 3 THEN NULL ELSE 'v' || (event_id - CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END) END AS id, event_id * 512 + CASE WHEN event_id % 17 = 0 THEN 4 ELSE 0 END - CASE WHEN event_id % 19 = 0 AND event_id > 0 THEN 512 ELSE 0 END AS off FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY id IS NOT NULL, id ORDER BY line) > 1 AS di, row_number() OVER (PARTITION BY id IS NOT NULL, off ORDER BY line) > 1 AS dof FROM i), u AS (SELECT line, unnest(CASE WHEN id IS NULL THEN ['VECTOR_INDEX_MALFORMED'] ELSE list_filter([CASE WHEN off < 0 OR off + 512 > 4096000 THEN 'VECTOR_OFFSET_OUT_OF_BOUNDS' END, CASE WHEN off % 512 <> 0 THEN 'VECTOR_OFFSET_MISALIGNED' END, CASE WHEN di THEN 'DUPLICATE_VECTOR_INDEX_ID' END, CASE WHEN dof THEN 'DUPLICATE_VECTOR_OFFSET' END], lambda x: x IS NOT NULL) END) AS category FROM k) SELECT line, category, CASE WHEN category = 'DUPLICATE_VECTOR_INDEX_ID' THEN 'INFO' ELSE 'ERROR' END AS severity FROM u")
def index_findings(spark, d):
    e = F.col("event_id")
    offset = e * 512 + F.when(e % 17 == 0, 4).otherwise(0) - F.when((e % 19 == 0) & (e > 0), 512).otherwise(0)
    name = F.concat(F.lit("v"), (e - F.when(e % 13 == 0, 1).otherwise(0)).cast("string"))
    value = F.when(e % 11 == 3, F.lit("nonsense")).otherwise(F.concat_ws("\t", name, offset.cast("string")))
    return segments.index_findings(read(spark, d, "events").select(e.alias("line"), value.alias("value")), 4_096_000, 128)


@query(_HISTORY + ", g AS (SELECT scope, seq, event_id, CASE WHEN seq - lag(seq) OVER w = 0 THEN 'DUPLICATE_SEQUENCE' ELSE 'SEQUENCE_GAP' END AS category, seq - lag(seq) OVER w AS step FROM h WINDOW w AS (PARTITION BY scope ORDER BY seq, event_id)), b AS (SELECT scope, execution, min(seq) AS b FROM h WHERE kind = 'EXECUTION_STARTED' GROUP BY ALL) SELECT scope, seq, event_id, category, 'ERROR' AS severity FROM g WHERE step <> 1 UNION ALL SELECT h.scope, h.seq, h.event_id, 'INVALID_ORDER', 'ERROR' FROM h LEFT JOIN b USING (scope, execution) WHERE kind <> 'EXECUTION_STARTED' AND (b.b IS NULL OR h.seq < b.b) UNION ALL SELECT scope, seq, event_id, 'DANGLING_REFERENCE', 'ERROR' FROM h WHERE supersedes IS NOT NULL AND seq % 2 = 0")
def ledger_audit(spark, d):
    """All scopes; the targets of even corrections are spoiled."""
    h = history(spark, d)
    return audit.ledger_findings(h.withColumn("supersedes", F.when((F.col("seq") % 2 == 0) & F.col("supersedes").isNotNull(), F.concat("supersedes", F.lit("?"))).otherwise(F.col("supersedes"))))


@query(_HISTORY + ", c AS (SELECT h.*, CASE WHEN h.seq % 3 = 0 THEN 2 ELSE 1 END AS rev, o.seq AS oseq, CASE WHEN o.seq % 3 = 0 THEN 2 ELSE 1 END AS orev, o.kind AS okind, o.attempt AS oatt, min(h.seq) OVER (PARTITION BY h.scope, h.supersedes) AS first FROM h LEFT JOIN h o ON o.scope = h.scope AND o.event_id = h.supersedes WHERE h.supersedes IS NOT NULL), f AS (SELECT scope, seq, event_id, CASE WHEN oseq IS NULL OR oseq >= seq THEN 'DANGLING_TARGET' WHEN first < seq THEN 'NOT_LATEST_REVISION' WHEN rev <> orev + 1 THEN 'WRONG_REVISION' WHEN kind <> okind THEN 'KIND_CHANGED' WHEN attempt IS DISTINCT FROM oatt THEN 'ADDRESS_CHANGED' END AS finding FROM c) SELECT * FROM f WHERE finding IS NOT NULL")
def correction_checks(spark, d):
    return ledger.correction_findings(history(spark, d).withColumn("revision", F.when(F.col("seq") % 3 == 0, 2).otherwise(1)))


@query(_HISTORY + " SELECT scope, seq % 400 AS event, count(*) - 1 AS ignored, min(seq) AS kept FROM h GROUP BY ALL")
def deduplicated_events(spark, d):
    """Event ids used again: the lowest sequence of each stays."""
    t = history(spark, d).withColumn("event_id", F.col("seq") % 400)
    kept, ignored = ledger.deduplicated(t, "scope")
    n = ignored.groupBy("scope", "event_id").agg(F.count("*").alias("ignored"))
    return kept.join(n, ["scope", "event_id"], "left").select("scope", F.col("event_id").alias("event"), F.coalesce("ignored", F.lit(0)).alias("ignored"), F.col("seq").alias("kept"))


@query(_HISTORY + "SELECT scope, execution, count(*) AS n, max(seq) AS seq FROM h WHERE seq <= 700 AND NOT EXISTS (SELECT 1 FROM h s WHERE s.scope = h.scope AND s.supersedes = h.event_id AND s.seq <= 700) GROUP BY ALL")
def asof_executions(spark, d):
    """Effective facts as of a sequence: later corrections don't count."""
    return ledger.effective(ledger.up_to_sequence(history(spark, d), 700), "scope").groupBy("scope", "execution").agg(F.count("*").alias("n"), F.max("seq").alias("seq"))


@query(_HISTORY + ", r AS (SELECT scope, task, execution, attempt, event_id, 1 AS revision, seq FROM h) SELECT event_id AS asked, CASE WHEN seq % 3 <> 0 THEN seq END AS seq FROM r")
def reference_resolution(spark, d):
    """Refs of all records, of which a third names another task."""
    h = history(spark, d).withColumn("revision", F.lit(1))
    refs = h.select("scope", F.when(F.col("seq") % 3 == 0, F.lit("no/task%")).otherwise(F.col("task")).alias("task"), "execution", "attempt", "event_id", "revision")
    return experience.resolved(refs, h).select(F.col("event_id").alias("asked"), "seq")


@query("SELECT l_orderkey * 10 + l_linenumber AS hit, CASE WHEN l_suppkey % 10 > 7 THEN 'BEYOND_CUTOFF' WHEN o.o_orderkey IS NULL THEN 'NO_SAMPLE' WHEN l_linenumber > 4 THEN 'ATTEMPT_NOT_IN_SAMPLE' WHEN l_linenumber = 3 THEN 'FINISH_MISMATCH' ELSE 'JOINED' END AS status FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0) o ON o_orderkey = l_orderkey")
def attempt_joins(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("execution"), F.col("l_linenumber").alias("attempt"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_id"), (F.col("l_suppkey") % 10).alias("seq"))
    samples = read(spark, d, "orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("execution"))
    attempts = li.where("attempt <= 4").select("execution", "attempt", F.when(F.col("attempt") == 3, -1).otherwise(F.col("event_id")).alias("finish_event")).distinct()
    return ledger.attempt_join(li, samples, attempts, F.lit(7)).select(F.col("event_id").alias("hit"), "status")


# -- comparison and cost ------------------------------------------------------------------------------------------------------

_CAND = "WITH c AS (SELECT s_suppkey, s_nationkey, s_acctbal AS x, CASE WHEN s_suppkey % 13 <> 0 THEN CAST(s_suppkey * 7919 % 101 AS DOUBLE) END AS y, s_suppkey % 9 <> 0 AS ok FROM supplier)"
_TOL = [compare.Objective("s_acctbal", True, 900.0), compare.Objective("speed", False, 12.0)]


@query(
    _CAND.replace("WITH", "WITH RECURSIVE", 1)
    + ", o AS (SELECT * FROM c WHERE ok AND x IS NOT NULL AND y IS NOT NULL), d AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM o a JOIN o b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey AND a.x <= b.x + 900 AND a.y >= b.y - 12 AND (a.x < b.x - 900 OR a.y > b.y + 12)), "
    "reach AS (SELECT s_suppkey AS k FROM o WHERE s_suppkey NOT IN (SELECT b FROM d) UNION SELECT d.b FROM reach JOIN d ON d.a = reach.k) "
    "SELECT s_nationkey, CAST(s_suppkey AS VARCHAR) AS ref, CASE WHEN NOT ok THEN 'EXCLUDED' WHEN x IS NULL OR y IS NULL THEN 'UNASSESSED' WHEN s_suppkey NOT IN (SELECT b FROM d) THEN 'FRONT' WHEN s_suppkey IN (SELECT k FROM reach) THEN 'DOMINATED' ELSE 'UNASSESSED' END AS state FROM c"
)
def pareto_within_tolerance(spark, d):
    from .catalog import candidates

    return compare.pareto(candidates(spark, d), "s_suppkey", ["s_nationkey"], _TOL, "ok")


@query("WITH n AS (SELECT s_suppkey, s_nationkey % 3 AS scope, s_suppkey % 4 AS policy, s_nationkey % 5 AS comparison FROM supplier) SELECT l.comparison, l.s_suppkey AS left_ref, r.s_suppkey AS right_ref, 'NOT_COMPARABLE' AS conclusion, array_to_string(list_filter([CASE WHEN l.scope <> r.scope THEN 'scope' END, CASE WHEN l.policy <> r.policy THEN 'policy' END], lambda x: x IS NOT NULL), ',') AS mismatches FROM n l JOIN n r ON l.comparison = r.comparison AND l.s_suppkey < r.s_suppkey AND (l.scope <> r.scope OR l.policy <> r.policy)")
def not_comparable(spark, d):
    t = read(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") % 3).alias("scope"), (F.col("s_suppkey") % 4).alias("policy"), (F.col("s_nationkey") % 5).alias("comparison"))
    return compare.comparability(t, "s_suppkey", ["scope", "policy"], "comparison").withColumn("mismatches", F.array_join("mismatches", ","))


@query(oracle.EXECUTIONS + "SELECT o_orderkey, array_to_string(list_filter([CASE WHEN status <> 'VALIDATED_ACCEPTED' THEN 'NOT_VALIDATED_ACCEPTED' WHEN o_orderkey % 6 = 0 THEN 'CUTOFF_UNDERIVABLE' END, CASE o_custkey % 4 WHEN 0 THEN 'GATE_MISSING' WHEN 1 THEN 'GATE_FAIL' WHEN 2 THEN 'GATE_UNKNOWN' END], lambda x: x IS NOT NULL), ',') AS codes FROM exec")
def exclusion_codes(spark, d):
    t = executions(spark, d)
    gate = F.when(F.col("o_custkey") % 4 == 1, "FAIL").when(F.col("o_custkey") % 4 == 2, "UNKNOWN").when(F.col("o_custkey") % 4 == 3, "PASS")
    gates = F.array(F.struct(F.lit(1).alias("ordinal"), F.lit("TESTS").alias("dimension"), gate.alias("state")))
    return t.select("o_orderkey", F.array_join(compare.exclusions(F.col("acc.status"), F.when(F.col("o_orderkey") % 6 != 0, 1), gates), ",").alias("codes"))


@query("WITH g AS (SELECT l_orderkey, sum(l_quantity) AS v, count(*) FILTER (l_returnflag = 'R') AS u, count(*) FILTER (l_linestatus = 'F') > 0 AS m FROM lineitem GROUP BY 1) SELECT l_orderkey, CASE WHEN m AND u = 0 THEN v END AS value, CASE WHEN NOT m THEN 'NOT_MEASURED' WHEN u > 0 THEN 'UNKNOWN_USAGE' END AS gap FROM g")
def objective_readings(spark, d):
    g = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("v"), F.count_if(F.col("l_returnflag") == "R").alias("u"), (F.count_if(F.col("l_linestatus") == "F") > 0).alias("m"))
    return g.select("l_orderkey", compare.reading(F.col("v"), F.col("u"), F.col("m")).alias("r")).select("l_orderkey", "r.value", "r.gap")


_BILL = "WITH u0 AS (SELECT l_orderkey * 10 + l_linenumber AS stage, k AS kind, CAST(CASE k WHEN 'IN' THEN l_quantity ELSE l_linenumber * 5 END AS BIGINT) AS value, CASE WHEN l_returnflag = 'R' THEN 'ESTIMATED' WHEN l_returnflag = 'A' AND l_linestatus = 'F' AND k = 'CACHE' AND l_suppkey % 3 = 0 THEN 'UNKNOWN' ELSE 'REPORTED' END AS provenance FROM lineitem, (VALUES ('IN'), ('CACHE')) t(k) WHERE NOT (k = 'CACHE' AND l_suppkey % 7 = 0)), u AS (SELECT stage, kind, min(value) AS value, min(provenance) AS provenance FROM u0 GROUP BY ALL) "


@query(_BILL + ", s AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS stage FROM lineitem), l AS (SELECT s.stage, k AS kind, u.value, u.provenance FROM s CROSS JOIN (VALUES ('IN'), ('CACHE')) t(k) LEFT JOIN u ON u.stage = s.stage AND u.kind = t.k), c AS (SELECT stage, value AS inc, provenance AS p FROM l WHERE kind = 'CACHE') SELECT stage, kind, CASE WHEN kind = 'CACHE' AND provenance IN ('REPORTED', 'ESTIMATED') THEN value WHEN kind = 'IN' AND provenance IS NOT NULL AND p IN ('REPORTED', 'ESTIMATED') AND value >= inc THEN value - inc END AS billable, CASE WHEN kind = 'IN' AND p = 'ESTIMATED' THEN 'ESTIMATED' ELSE provenance END AS provenance, CASE WHEN provenance IS NULL THEN 'MISSING_USAGE' WHEN provenance = 'UNKNOWN' THEN 'UNKNOWN_USAGE' WHEN kind = 'IN' AND coalesce(p, 'UNKNOWN') = 'UNKNOWN' THEN 'INCLUDED_UNMEASURED' WHEN kind = 'IN' AND value < inc THEN 'INCONSISTENT_USAGE' ELSE 'BILLED' END AS state FROM l JOIN c USING (stage)")
def billable_usage(spark, d):
    stage = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("stage")
    li = read(spark, d, "lineitem").withColumn("kind", F.explode(F.array(F.lit("IN"), F.lit("CACHE"))))
    prov = F.when(F.col("l_returnflag") == "R", "ESTIMATED").when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F") & (F.col("kind") == "CACHE") & (F.col("l_suppkey") % 3 == 0), "UNKNOWN").otherwise("REPORTED")
    value = F.when(F.col("kind") == "IN", F.col("l_quantity")).otherwise(F.col("l_linenumber") * 5).cast("long")
    u = li.where(~((F.col("kind") == "CACHE") & (F.col("l_suppkey") % 7 == 0))).select(stage, "kind", value.alias("value"), prov.alias("provenance")).groupBy("stage", "kind").agg(F.min("value").alias("value"), F.min("provenance").alias("provenance"))
    lines = li.select(stage, "kind", F.lit(1.0).alias("price"), F.lit(1000).alias("unit_size"), F.when(F.col("kind") == "CACHE", "IN").alias("included_in")).distinct()
    return cost.billable(u, lines, "stage").select("stage", "kind", "billable", "provenance", "state")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN greatest(o_custkey, o_orderkey, (SELECT max(x) FROM unnest([o_orderkey % 100, o_custkey % 1000]) t(x))) END AS cutoff FROM orders")
def acceptance_cutoffs(spark, d):
    c = F.col("o_custkey")
    return read(spark, d, "orders").select("o_orderkey", cost.acceptance_cutoff(c, F.col("o_orderkey"), F.array(F.col("o_orderkey") % 100, c % 1000), F.col("o_orderkey") % 3 != 0).alias("cutoff"))


@query(oracle.USAGE + ", s AS (SELECT DISTINCT l_suppkey FROM usage), k AS (SELECT unnest(['INPUT_TOKENS', 'CACHED_INPUT_TOKENS', 'OUTPUT_TOKENS', 'REASONING_TOKENS', 'REQUESTS', 'TOOL_CALLS']) AS kind), u AS (SELECT l_suppkey, kind, count(*) AS n FROM usage WHERE l_suppkey % 2 = 0 OR kind <> 'REQUESTS' GROUP BY ALL) SELECT l_suppkey, kind, coalesce(n, 0) AS n FROM s CROSS JOIN k LEFT JOIN u USING (l_suppkey, kind)")
def completed_usage(spark, d):
    """Every supplier with every kind of usage, measured or not."""
    kind = F.element_at(F.array(*map(F.lit, cost.KINDS)), F.col("l_linenumber") % 6 + 1)
    li = read(spark, d, "lineitem").select("l_suppkey", kind.alias("kind"))
    u = li.where("l_suppkey % 2 = 0 OR kind <> 'REQUESTS'").groupBy("l_suppkey", "kind").agg(F.count("*").alias("n"))
    return cost.completed(li, u, "l_suppkey").select("l_suppkey", "kind", F.coalesce("n", F.lit(0)).alias("n"))


@query(_HISTORY + _EFFECTIVE + "SELECT execution, string_agg(ordinal || ':' || attempt, ',' ORDER BY ordinal, attempt, seq) AS attempts FROM eff WHERE kind = 'ATTEMPT_STARTED' GROUP BY 1")
def attempts_views(spark, d):
    now = ledger.effective(history(spark, d), "scope").where("kind = 'ATTEMPT_STARTED'")
    v = ledger.attempts_view(now, "execution")
    return v.select("execution", F.array_join(F.transform("attempts", lambda a: F.concat_ws(":", a["ordinal"].cast("string"), a["attempt"])), ",").alias("attempts"))


@query("SELECT doc_id, concat_ws(chr(10), lang, CASE WHEN doc_id % 3 > 0 THEN source END, CASE WHEN doc_id % 2 = 0 THEN 'lesson ' || doc_id END) AS text FROM documents")
def projection_texts(spark, d):
    lesson = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("lesson "), F.col("doc_id").cast("string")))
    return read(spark, d, "documents").select("doc_id", text.projection_text(F.col("lang"), F.when(F.col("doc_id") % 3 > 0, F.col("source")), lesson).alias("text"))
