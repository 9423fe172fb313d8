"""Registered queries over ledgers in strict order: validation, segments, projection checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, ledger, projection, validation
from ..sources import datasources, segments, snapshots
from .catalog import query, read
from .histories import _ENTRIES, _HISTORY, _KIND

#: Records of executions in both dialects, with planted faults of every kind: the first record of most executions starts it,
#: one in 31 names another task, one in 97 takes the id of the record before it, a quarter are corrections.
_RECORD = (
    "'s' || (user_id % 3) AS scope, event_id + 1 AS seq, 'e' || (CASE WHEN event_id % 97 = 0 AND event_id > 0 THEN event_id - 1 ELSE event_id END) AS event_id, 'x' || user_id AS execution, "
    "CASE WHEN n = 1 AND user_id % 5 > 0 THEN 'EXECUTION_STARTED' ELSE CASE event_type WHEN 'click' THEN 'ATTEMPT_STARTED' WHEN 'purchase' THEN 'ATTEMPT_FINISHED' WHEN 'error' THEN 'OUTCOME_RECORDED' WHEN 'view' THEN 'STAGE_RECORDED' "
    "ELSE CASE WHEN event_id % 9 = 0 THEN 'EXECUTION_STARTED' ELSE 'EVIDENCE_RECORDED' END END END AS kind, 't' || (CASE WHEN event_id % 31 = 0 THEN 9 ELSE user_id % 5 END) AS task, "
    "event_id AS k, event_id % 4 = 1 AS corrects"
)
_FIELDS = (
    "CASE WHEN kind IN ('ATTEMPT_STARTED', 'ATTEMPT_FINISHED', 'STAGE_RECORDED', 'EVIDENCE_RECORDED') THEN 'a' || (k % 5) END AS attempt, CAST(CASE WHEN kind = 'ATTEMPT_STARTED' THEN k % 7 END AS INT) AS ordinal, "
    "CASE WHEN kind = 'ATTEMPT_STARTED' AND k % 3 = 0 THEN 'a' || (k % 6) END AS previous, CASE WHEN kind = 'OUTCOME_RECORDED' AND k % 4 > 0 THEN 'a' || (k % 6) END AS accepted"
)
_TARGET = (
    "CASE WHEN corrects THEN CASE WHEN k % 8 = 1 THEN lag(event_id) OVER (PARTITION BY execution ORDER BY seq) ELSE lag(event_id) OVER (PARTITION BY execution, kind, attempt ORDER BY seq) END END AS supersedes, "
    "CASE WHEN corrects THEN 2 ELSE 1 END AS revision"
)
_RECORDS = f"WITH r0 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), r1 AS (SELECT n, {_RECORD} FROM r0), r2 AS (SELECT *, {_FIELDS} FROM r1), r3 AS (SELECT *, {_TARGET} FROM r2)"


def records(spark: SparkSession, d: str) -> DataFrame:
    read(spark, d, "events").createOrReplaceTempView("larkspur_records")
    return spark.sql(_RECORDS.replace("FROM events", "FROM larkspur_records") + " SELECT * FROM r3").select(*validation.COLUMNS)


_BACK = "lag({0}) OVER (PARTITION BY execution ORDER BY seq) AS {0}_1, lag({0}) OVER (PARTITION BY execution, kind, attempt ORDER BY seq) AS {0}_2"
_STRICT = (
    _RECORDS.replace("WITH", "WITH RECURSIVE", 1)
    + ", r4 AS (SELECT *, "
    + ", ".join(_BACK.format(c) for c in ("kind", "task", "attempt", "corrects"))
    + " FROM r3), own AS (SELECT scope, event_id, arg_min(execution, seq) AS owner FROM r3 GROUP BY ALL), "
    "r AS (SELECT r4.*, owner <> execution AS strange, CASE WHEN k % 8 = 1 THEN kind_1 ELSE kind_2 END AS tkind, CASE WHEN k % 8 = 1 THEN task_1 ELSE task_2 END AS ttask, CASE WHEN k % 8 = 1 THEN attempt_1 ELSE attempt_2 END AS tattempt, "
    "CASE WHEN k % 8 = 1 THEN corrects_1 ELSE corrects_2 END AS tcorrects FROM r4 JOIN own USING (scope, event_id)), "
    "w AS (SELECT execution, 0::BIGINT AS n, false AS started, NULL::VARCHAR AS stask, []::VARCHAR[] AS ids, []::VARCHAR[] AS gone, MAP([]::VARCHAR[], []::INT[]) AS ords, MAP([]::VARCHAR[], []::VARCHAR[]) AS prevs, []::VARCHAR[] AS ended, "
    "NULL::VARCHAR AS scope, NULL::BIGINT AS seq, NULL::VARCHAR AS event_id, NULL::VARCHAR AS violation FROM (SELECT DISTINCT execution FROM r) "
    "UNION ALL SELECT execution, n, started OR (why IS NULL AND kind = 'EXECUTION_STARTED'), CASE WHEN why IS NULL AND kind = 'EXECUTION_STARTED' AND NOT started THEN task ELSE stask END, "
    "CASE WHEN why IS NULL THEN list_append(ids, event_id) ELSE ids END, CASE WHEN why IS NULL AND supersedes IS NOT NULL THEN list_append(gone, supersedes) ELSE gone END, "
    "CASE WHEN why IS NULL AND kind = 'ATTEMPT_STARTED' THEN map_concat(ords, MAP([attempt], [ordinal])) ELSE ords END, CASE WHEN why IS NULL AND kind = 'ATTEMPT_STARTED' THEN map_concat(prevs, MAP([attempt], [previous])) ELSE prevs END, "
    "CASE WHEN why IS NULL AND kind = 'ATTEMPT_FINISHED' AND supersedes IS NULL THEN list_append(ended, attempt) ELSE ended END, scope, seq, event_id, why FROM (SELECT *, "
    "CASE WHEN strange OR list_contains(ids, event_id) THEN 'DUPLICATE_EVENT' WHEN supersedes IS NOT NULL THEN "
    "CASE WHEN NOT list_contains(ids, supersedes) THEN 'DANGLING_TARGET' WHEN ttask <> task OR tattempt IS DISTINCT FROM attempt THEN 'ADDRESS_CHANGED' WHEN list_contains(gone, supersedes) THEN 'NOT_LATEST_REVISION' "
    "WHEN tcorrects THEN 'WRONG_REVISION' WHEN tkind <> kind THEN 'KIND_CHANGED' WHEN previous IS NOT NULL AND NOT list_contains(map_keys(ords), previous) THEN 'DANGLING_PREVIOUS' "
    "WHEN accepted IS NOT NULL AND NOT list_contains(map_keys(ords), accepted) THEN 'DANGLING_ACCEPTED' "
    "WHEN kind = 'ATTEMPT_STARTED' AND attempt IN (previous, prevs[previous], prevs[prevs[previous]], prevs[prevs[prevs[previous]]], prevs[prevs[prevs[prevs[previous]]]]) THEN 'PREVIOUS_CYCLE' "
    "WHEN kind = 'ATTEMPT_STARTED' AND ords[attempt] <> ordinal AND list_contains(map_values(ords), ordinal) THEN 'ORDINAL_REUSED' END "
    "WHEN kind = 'EXECUTION_STARTED' THEN CASE WHEN started THEN 'EXECUTION_ALREADY_STARTED' END WHEN NOT started THEN 'EXECUTION_NOT_STARTED' WHEN task <> stask THEN 'TASK_DIFFERS' "
    "WHEN kind = 'ATTEMPT_STARTED' THEN CASE WHEN list_contains(map_keys(ords), attempt) THEN 'ATTEMPT_ALREADY_STARTED' WHEN list_contains(map_values(ords), ordinal) THEN 'ORDINAL_REUSED' WHEN previous IS NOT NULL AND NOT list_contains(map_keys(ords), previous) THEN 'DANGLING_PREVIOUS' END "
    "WHEN kind = 'OUTCOME_RECORDED' THEN CASE WHEN accepted IS NOT NULL AND NOT list_contains(map_keys(ords), accepted) THEN 'DANGLING_ACCEPTED' END "
    "WHEN NOT list_contains(map_keys(ords), attempt) THEN 'DANGLING_ATTEMPT' WHEN list_contains(ended, attempt) THEN 'ATTEMPT_FINISHED' END AS why "
    "FROM (SELECT w.started, w.stask, w.ids, w.gone, w.ords, w.prevs, w.ended, r.* FROM w JOIN r ON r.execution = w.execution AND r.n = w.n + 1))) "
)
_CATEGORY = "CASE " + " ".join(f"WHEN violation IN ({', '.join(repr(v) for v, c in validation.CATEGORIES.items() if c == name)}) THEN '{name}'" for name in dict.fromkeys(validation.CATEGORIES.values())) + " END AS category"


@query(_STRICT + f"SELECT scope, seq, event_id, violation, {_CATEGORY} FROM w WHERE violation IS NOT NULL")
def ledger_validation(spark, d):
    """Every record of every execution, judged in order; refused ones leave no trace."""
    return validation.validate(records(spark, d))


# -- projection ------------------------------------------------------------------------------------------------------------------

#: A ledger a user: sequences without gaps, two executions in each.
_SCOPED = (
    f"WITH h AS (SELECT 's' || user_id AS scope, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, 'e' || event_id AS event_id, {_KIND} AS kind, 'x' || user_id || '-' || (event_id % 2) AS execution, "
    "CASE WHEN event_type IN ('click', 'purchase', 'view') THEN 'a' || (event_id % 4) END AS attempt, CASE WHEN event_type = 'signup' THEN 'summary ' || (event_id % 4) END AS summary, "
    "CASE WHEN event_type = 'purchase' THEN 'solution ' || (event_id % 6) END AS solution, CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 'lesson' END AS lesson, event_type || '|' || event_id AS payload FROM events) "
)
_LOG = _ENTRIES.replace(_HISTORY, _SCOPED) + (
    ", log AS (SELECT scope, seq, CASE entry WHEN 'RETIRE' THEN 0 ELSE 1 END AS place, entry, atom_id, execution, attempt, event_id, NULL AS digest FROM entries "
    "UNION ALL SELECT scope, seq, 2, 'COVER', NULL, NULL, NULL, NULL, sha256(payload) FROM h) "
)


def scoped(spark: SparkSession, d: str) -> DataFrame:
    read(spark, d, "events").createOrReplaceTempView("larkspur_records")
    return spark.sql(_SCOPED.replace("FROM events", "FROM larkspur_records") + "SELECT * FROM h")


def maintained(spark: SparkSession, h: DataFrame, *cuts: int) -> projection.Projection:
    """A projection that was advanced to each of the sequences, one after the other."""
    p = projection.Projection(spark, snapshots.scratch(spark, "projection"))
    for k in cuts:
        p.advance(h.where(F.col("seq") <= k))
    return p


@query(_LOG + "SELECT * FROM log")
def projection_maintained(spark, d):
    """The log of a projection that was brought up in three steps, against that of the whole history."""
    return maintained(spark, scoped(spark, d), 20, 45, 1 << 40).log().drop("text")


_LINES = (
    _LOG
    + ", p AS (SELECT scope, seq, entry = 'COVER' AS cover, CASE WHEN entry = 'COVER' THEN 'COVER|' || seq || '|' || digest ELSE entry || '|' || seq || '|' || atom_id || '|' || scope || '/' || execution || '/' || attempt || '/' || event_id END AS payload, entry, atom_id FROM log "
    "UNION ALL SELECT DISTINCT scope, 0, false, 'HEADER|1|summary-text-v1|128|' || scope, 'HEADER', NULL FROM h), "
    "l AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY seq, cover, payload) AS line FROM p), b AS (SELECT *, line % 9 = 0 AS bad FROM l), "
    "c AS (SELECT *, count(*) FILTER (cover AND NOT bad) OVER (PARTITION BY scope ORDER BY line) AS covers, max(line) FILTER (cover AND NOT bad) OVER (PARTITION BY scope) AS last FROM b) "
)


@query(
    _LINES
    + "SELECT scope, line, entry, CASE WHEN entry <> 'HEADER' THEN seq END AS seq, atom_id, CASE WHEN bad THEN 'MALFORMED_LINE' WHEN entry <> 'HEADER' AND line > coalesce(last, 0) THEN 'UNCOVERED_TAIL' WHEN entry <> 'HEADER' AND seq <> covers + CASE WHEN cover THEN 0 ELSE 1 END THEN 'COVER_OUT_OF_ORDER' END AS finding FROM c"
)
def projection_lines(spark, d):
    """The log as framed lines, of which every ninth lost a digit of its digest, and read again."""
    lines = projection.framed_log(maintained(spark, scoped(spark, d), 1 << 40).log())
    spoiled = F.regexp_replace("value", r"^(MXP1\t\d+\t\d+\t)[0-9a-f]", "$1")
    t = projection.read_framed_log(lines.withColumn("value", F.when(F.col("line") % 9 == 0, spoiled).otherwise(F.col("value"))))
    return t.select("scope", "line", "entry", "seq", "atom_id", "finding")


@query(
    _SCOPED
    + "SELECT scope, least(max(seq), 60) AS covered, max(seq) AS head, CASE WHEN scope LIKE '%7' THEN 'INCOMPATIBLE' WHEN max(seq) > 60 THEN 'STALE' ELSE 'CURRENT' END AS status, CASE WHEN scope LIKE '%7' THEN 'DIFFERENT_LEDGER' ELSE '' END AS problems FROM h GROUP BY scope"
)
def projection_status(spark, d):
    """A projection up to sequence 60, against a ledger of which the scopes that end in 7 were changed."""
    h = scoped(spark, d)
    p = maintained(spark, h, 30, 60)
    changed = h.withColumn("payload", F.when((F.col("seq") == 3) & F.col("scope").endswith("7"), F.lit("another")).otherwise(F.col("payload")))
    return p.status(changed).withColumn("problems", F.array_join("problems", ","))


# -- files -----------------------------------------------------------------------------------------------------------------------


@query(
    "WITH l AS (SELECT 'f' || (event_id % 5) AS segment, event_id // 5 AS line FROM events), v AS (SELECT *, CASE line % 50 WHEN 20 THEN line + 5 WHEN 30 THEN line ELSE line + 1 END AS seq, line % 50 = 49 AS cut FROM l), "
    "s AS (SELECT *, coalesce(max(seq) OVER (PARTITION BY segment ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS high FROM v), "
    "f AS (SELECT segment, line, seq, array_to_string(list_filter([CASE WHEN seq <= high THEN 'DUPLICATE_SEQUENCE' WHEN seq > high + 1 THEN 'SEQUENCE_GAP' END, CASE WHEN cut THEN 'MALFORMED_RECORD' END, CASE WHEN cut THEN 'DIGEST_MISMATCH' END], lambda x: x IS NOT NULL), ',') AS findings FROM s) "
    "SELECT segment, seq, findings, count(*) FILTER (findings <> '') OVER (PARTITION BY segment ORDER BY line) = 0 AS in_prefix FROM f"
)
def segment_files(spark, d):
    """Five segments written as files and read by ranges of 128 kB; a gap, a repeat and a spoiled line in every fifty."""
    path, line = snapshots.scratch(spark, "segments"), F.expr("event_id div 5")
    seq = F.when(line % 50 == 20, line + 5).when(line % 50 == 30, line).otherwise(line + 1)
    name = F.col("event_id").cast("string")
    fields = {"kind": F.lit("EXECUTION_STARTED"), "scope": F.lit("s"), "task": F.lit("t"), "execution": F.concat(F.lit("x"), name), "event_id": F.concat(F.lit("e"), name), "revision": F.lit(1)}
    value = ledger.framed(seq, segments.encode_payload(fields))
    value = F.when(line % 50 == 49, F.concat(value, F.lit("x"))).otherwise(value)
    t = read(spark, d, "events").select(F.concat(F.lit("f"), (F.col("event_id") % 5).cast("string")).alias("segment"), line.alias("line"), value.alias("value"))
    t.repartition("segment").sortWithinPartitions("segment", "line").drop("line").write.partitionBy("segment").text(path)
    got = segments.scan_ledger(segments.read_segments(spark, path, 131_072), "s", 4)
    return got.select(F.regexp_extract("path", "segment=([^/]*)/", 1).alias("segment"), "seq", F.array_join("findings", ",").alias("findings"), "in_prefix")


@query("SELECT CAST(vec_id AS VARCHAR) AS atom_id, len(embedding) AS dimensions, round(CAST(list_min(embedding) AS DOUBLE), 6) AS lo, round(CAST(list_max(embedding) AS DOUBLE), 6) AS hi, 1 AS versions FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64")
def vector_frames(spark, d):
    """Vectors written as frames with their index, and read back by its offsets."""
    path = snapshots.scratch(spark, "frames")
    datasources.register(spark)
    e = read(spark, d, "embeddings").where("size(embedding) = 64").select(F.col("vec_id").cast("string").alias("atom_id"), F.col("embedding").alias("vec"))
    e.write.format("larkspur_frames").option("dimensions", 64).mode("append").save(path)
    t = spark.read.format("larkspur_frames").option("dimensions", 64).option("range", 4_096).load(path)
    size = lambda c: F.round(c.cast("double"), 6)
    t = t.groupBy("atom_id").agg(F.first(F.size("vec")).alias("dimensions"), F.first(size(F.array_min("vec"))).alias("lo"), F.first(size(F.array_max("vec"))).alias("hi"), F.count("*").cast("int").alias("versions"))
    return t.select("atom_id", "dimensions", "lo", "hi", "versions")


# -- links -----------------------------------------------------------------------------------------------------------------------


@query(
    "WITH RECURSIVE k AS (SELECT doc_id AS id, CASE WHEN doc_id % 40 > 0 THEN (doc_id * doc_id + 7) % (SELECT count(*) + 3 FROM documents) END AS u FROM documents), l AS (SELECT k.id, o.id AS up FROM k LEFT JOIN k o ON o.id = k.u), "
    "reach AS (SELECT id, up AS z FROM l WHERE up IS NOT NULL UNION SELECT r.id, l.up FROM reach r JOIN l ON l.id = r.z WHERE l.up IS NOT NULL), "
    "ring AS (SELECT id FROM reach WHERE id = z), lab AS (SELECT ring.id, min(z) AS cycle, count(*) AS length FROM ring JOIN reach USING (id) GROUP BY 1), "
    "c AS (SELECT r.id, any_value(lab.cycle) AS cycle, any_value(length) AS length FROM reach r JOIN lab ON lab.id = r.z GROUP BY 1), "
    "e AS (SELECT l.id, coalesce(r.z, l.id) AS root FROM l LEFT JOIN (SELECT reach.id, z FROM reach JOIN l x ON x.id = z WHERE x.up IS NULL) r ON r.id = l.id), n AS (SELECT id, count(*) AS depth FROM reach GROUP BY 1) "
    "SELECT l.id, CASE WHEN cycle IS NULL THEN e.root END AS root, CASE WHEN cycle IS NULL THEN coalesce(depth, 0) END AS depth, cycle, ring.id IS NOT NULL AS on_cycle, length FROM l LEFT JOIN c USING (id) LEFT JOIN ring ON ring.id = l.id LEFT JOIN e ON e.id = l.id LEFT JOIN n ON n.id = l.id"
)
def link_ends(spark, d):
    """Where links between documents end, and the cycles that they run into."""
    t = read(spark, d, "documents").select("doc_id")
    k = F.col("doc_id")
    return graph.ends(t.select(k.alias("id"), F.when(k % 40 > 0, (k * k + 7) % (t.count() + 3)).alias("up")))
