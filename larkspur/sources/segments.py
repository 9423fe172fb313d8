"""Files of the stores: framed ledger segments, event payloads, vector frames with their index, chunks, speech samples, properties."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..operators.ledger import parse_framed

# The kinds of events, in order.
KINDS = ["EXECUTION_STARTED", "ATTEMPT_STARTED", "STAGE_RECORDED", "EVIDENCE_RECORDED", "ATTEMPT_FINISHED", "OUTCOME_RECORDED", "CORRECTION"]
#: Fields of each kind's payload beside those that all share; a correction has those of what it replaces.
SHARED = "schema int, kind string, scope string, task string, execution string, event_id string, revision int, supersedes string, recorded_at string"
FIELDS = {
    "EXECUTION_STARTED": "summary string, source_revision string",
    "ATTEMPT_STARTED": "attempt string, ordinal int, reason string, previous string",
    "STAGE_RECORDED": "attempt string, stage string, provider string, model string, started_at string, ended_at string",
    "EVIDENCE_RECORDED": "attempt string, policy string, observations array<struct<dimension:string,state:string>>",
    "ATTEMPT_FINISHED": "attempt string, result string, solution string, lesson string",
    "OUTCOME_RECORDED": "outcome string, origin string, accepted string",
}
PAYLOAD = ", ".join([SHARED, *dict.fromkeys(f for x in FIELDS.values() for f in x.split(", "))])


def encode_payload(fields: dict[str, Column]) -> Column:
    """Canonical JSON of an event: its schema is 1, fields stand in the order of PAYLOAD, and null ones are left out."""
    names = [f.split(" ")[0] for f in PAYLOAD.split(", ")]
    own = {"schema": F.lit(1)} | fields
    if odd := own.keys() - set(names):
        raise ValueError(f"no fields of a payload: {sorted(odd)}")
    return F.to_json(F.struct(*(own[n].alias(n) for n in names if n in own)))


def decode_payload(payload: Column) -> Column:
    """struct<event, finding>: the event's fields, and why it can't be read: MALFORMED_RECORD (no JSON, an unknown kind or field,
    or not in canonical form) or UNSUPPORTED_SCHEMA."""
    e = F.from_json(payload, PAYLOAD)
    again = F.to_json(e)
    finding = F.when(e["kind"].isNull() | ~e["kind"].isin(KINDS) | (again != payload), "MALFORMED_RECORD").when(e["schema"].isNull() | (e["schema"] != 1), "UNSUPPORTED_SCHEMA")
    return F.struct(e.alias("event"), finding.alias("finding"))


def scan_segments(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, seq, payload, finding, in_prefix) of framed segment files, one row a line.

    Findings: those of a line by itself, MALFORMED_RECORD also for bytes that are no UTF-8; SEQUENCE_GAP and DUPLICATE_SEQUENCE
    against the line before; TORN_TAIL for a last line without its end.  in_prefix: the line and all before it hold, so that
    the records of a segment are its rows in the prefix.  A segment is read by one task, as its lines hang together."""
    t = spark.read.format("binaryFile").load(path).select("path", "content")

    def go(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for p, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                lines = raw.as_py().split(b"\n")
                torn = lines.pop() != b""
                lines = raw.as_py().split(b"\n") if torn else lines
                for at in range(0, len(lines), 10_000):
                    rows = []
                    for k, x in enumerate(lines[at : at + 10_000], at):
                        try:
                            rows.append((p, k, x.decode("utf-8"), torn and k == len(lines) - 1, False))
                        except UnicodeDecodeError:
                            rows.append((p, k, None, torn and k == len(lines) - 1, True))
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3]), pa.array(cols[4])], ["path", "line", "value", "torn", "broken"])

    lines = t.mapInArrow(go, "path string, line long, value string, torn boolean, broken boolean")
    return scan_lines(lines)


def scan_lines(lines: DataFrame) -> DataFrame:
    """The same for lines (path, line, value, torn, broken)."""
    p = parse_framed(lines.withColumn("_keep", F.struct("path", "line", "torn", "broken")), keep="_keep").select("_keep.*", "seq", "payload", "finding")
    by = Window.partitionBy("path").orderBy("line")
    before = F.coalesce(F.lag("seq").over(by), F.lit(0))
    p = p.withColumn("_before", before)
    finding = (
        F.when(F.col("torn"), "TORN_TAIL")
        .when(F.col("broken"), "MALFORMED_RECORD")
        .when(F.col("finding").isNotNull(), F.col("finding"))
        .when(F.col("seq") == F.col("_before"), "DUPLICATE_SEQUENCE")
        .when(F.col("seq") != F.col("_before") + 1, "SEQUENCE_GAP")
    )
    p = p.withColumn("finding", finding).drop("_before")
    bad = F.max(F.col("finding").isNotNull().cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return p.withColumn("in_prefix", bad == 0).select("path", "line", "seq", "payload", "finding", "in_prefix")


def severity(finding: Column) -> Column:
    return F.when(finding.isNull(), None).when(finding == "TORN_TAIL", "WARNING").otherwise("ERROR")


# -- vectors -----------------------------------------------------------------------------------------------------------------


def write_frames(spark: SparkSession, rows: DataFrame, path: str, dimensions: int) -> None:
    """(atom_id, vec) as a file of big-endian float32 frames and an index 'id<TAB>offset' for each partition; a vector of other
    dimensions is an error.  Files are the bodies of one-column tables, so any store that Spark writes to will do."""
    ok = F.when(F.size("vec") == dimensions, F.col("vec")).otherwise(F.raise_error(F.lit("vector dimensions differ")).cast("array<float>"))

    def go(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in it:
            n = b.num_rows
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(">f4").reshape(n, -1)
            offsets = at + 4 * dimensions * np.arange(n)
            at += 4 * dimensions * n
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), b.column(0), pa.array(offsets), pa.array([r.tobytes() for r in x], pa.binary())], ["segment", "atom_id", "offset", "frame"])

    rows.select(F.col("atom_id").cast("string"), ok.alias("vec")).mapInArrow(go, "segment int, atom_id string, offset long, frame binary").write.mode("append").parquet(path)


def read_frames(spark: SparkSession, path: str, dimensions: int) -> DataFrame:
    """(atom_id, version, vec) in the order of segments and offsets; all versions of an atom."""

    def go(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = np.frombuffer(b"".join(b.column(3).to_pylist()), ">f4").astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * dimensions, pa.int32()), pa.array(x))], ["segment", "atom_id", "offset", "vec"])

    t = spark.read.schema("segment int, atom_id string, offset long, frame binary").parquet(path)
    t = t.mapInArrow(go, "segment int, atom_id string, offset long, vec array<float>")
    return t.withColumn("version", F.row_number().over(Window.partitionBy("atom_id").orderBy("segment", "offset")) - 1).select("atom_id", "version", "vec")


def index_findings(index: DataFrame, segment_bytes: int, dimensions: int) -> DataFrame:
    """(line, category, severity) of a vector index (line, value) 'id<TAB>offset' against its segment's size."""
    frame = 4 * dimensions
    p = F.split("value", "\t", -1)
    offset = F.expr("try_cast(get(split(value, '\t', -1), 1) AS BIGINT)")
    own = index.select("line", F.get(p, F.lit(0)).alias("id"), offset.alias("offset"), ((F.size(p) == 2) & offset.isNotNull() & (F.get(p, F.lit(0)) != "")).alias("ok"))
    same = lambda c: F.row_number().over(Window.partitionBy("ok", c).orderBy("line")) > 1
    own = own.withColumn("_id", same("id")).withColumn("_at", same("offset"))
    found = F.when(
        F.col("ok"),
        F.array_compact(
            F.array(
                F.when((F.col("offset") < 0) | (F.col("offset") + frame > segment_bytes), "VECTOR_OFFSET_OUT_OF_BOUNDS"),
                F.when(F.col("offset") % frame != 0, "VECTOR_OFFSET_MISALIGNED"),
                F.when(F.col("_id"), "DUPLICATE_VECTOR_INDEX_ID"),
                F.when(F.col("_at"), "DUPLICATE_VECTOR_OFFSET"),
            )
        ),
    ).otherwise(F.array(F.lit("VECTOR_INDEX_MALFORMED")))
    rows = own.select("line", F.explode(found).alias("category"))
    if segment_bytes % frame:
        rows = rows.unionByName(index.sparkSession.createDataFrame([(None, "VECTOR_SEGMENT_SIZE_MISMATCH")], "line long, category string"))
    return rows.withColumn("severity", F.when(F.col("category") == "DUPLICATE_VECTOR_INDEX_ID", "INFO").otherwise("ERROR"))


# -- chunks, samples, properties ---------------------------------------------------------------------------------------------


def chunk_keys(chunks: DataFrame, corpus: str, policy: str, key: str = "doc_id") -> DataFrame:
    """chunks with key: corpus, policy, document and ordinal."""
    return chunks.withColumn("key", F.concat_ws("/", F.lit(corpus), F.lit(policy), F.col(key).cast("string"), F.lpad(F.col("ordinal").cast("string"), 6, "0")))


def write_chunks(chunks: DataFrame, texts: DataFrame, path: str, key: str = "doc_id") -> None:
    """Chunks (with key) and their texts as JSON lines in <path>/chunks, what is known of them in <path>/sidecar."""
    body = chunks.join(texts.select(key, F.col("text").alias("_t")), key).select("key", "ordinal", F.expr("substring(_t, CAST(start AS INT) + 1, CAST(end - start AS INT))").alias("text"))
    body.write.mode("append").json(f"{path}/chunks")
    chunks.drop(key).write.mode("append").json(f"{path}/sidecar")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks with finding: SIDECAR_MISSING, CHUNK_MISSING, SIZE_DIFFERS or DIGEST_DIFFERS, null where both files agree."""
    c = spark.read.schema("key string, ordinal int, text string").json(f"{path}/chunks", mode="FAILFAST")
    s = spark.read.schema("key string, section int, chunk_in_section int, start long, end long, n_bytes long, sha256 string, duplicate_of string").json(f"{path}/sidecar", mode="FAILFAST")
    t = c.join(s, "key", "full")
    finding = F.when(F.col("sha256").isNull(), "SIDECAR_MISSING").when(F.col("text").isNull(), "CHUNK_MISSING").when(F.octet_length("text") != F.col("n_bytes"), "SIZE_DIFFERS").when(F.sha2("text", 256) != F.col("sha256"), "DIGEST_DIFFERS")
    return t.withColumn("finding", finding)


def save_samples(samples: DataFrame, path: str) -> None:
    """Speech samples, appended: seq goes on behind what is stored, so that it orders all appends.  One writer at a time."""
    spark = samples.sparkSession
    try:
        last = spark.read.schema("seq long").parquet(path).agg(F.max("seq")).first()[0]
    except Exception as e:  # nothing is stored yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        last = None
    samples.withColumn("seq", F.monotonically_increasing_id() + F.lit(0 if last is None else last + 1)).write.mode("append").parquet(path)


def read_samples(spark: SparkSession, path: str, sample_id: str | None = None) -> DataFrame:
    """Stored samples, or one of them; a filter that reaches the scan."""
    t = spark.read.schema(schemas.SPEECH + ", seq long").parquet(path)
    return t.where(F.col("sample_id") == sample_id) if sample_id is not None else t


def has_samples(spark: SparkSession, path: str) -> bool:
    return read_samples(spark, path).limit(1).count() == 1


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    r"""(key, value) of properties files; of a key's values the last counts.

    Lines end in \n, \r or both.  A line that ends in an odd number of backslashes goes on in the next, whose leading blanks
    are dropped.  Lines whose first character is # or ! are comments, which don't go on.  A key ends at the first blank, = or : that
    isn't escaped; escapes are \t, \n, \r, \f and \uXXXX, and any other character after a backslash stands for itself."""
    t = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("text"))
    # comments and empty lines go first, then lines are joined
    t = t.select("path", F.regexp_replace("text", r"\r\n?", "\n").alias("text"))
    t = t.select("path", F.regexp_replace("text", r"(?m)(?<!(?<!\\)\\\n)^[ \t\f]*[#!][^\n]*(\n|\z)", "").alias("text"))
    t = t.select("path", F.regexp_replace("text", r"(?<!\\)((?:\\\\)*)\\\n[ \t\f]*", "$1").alias("text"))
    t = t.select("path", F.posexplode(F.split("text", "\n")).alias("line", "value")).where(F.regexp_replace("value", r"[ \t\f]", "") != "")
    cut = r"^[ \t\f]*((?:\\.|[^\\ \t\f=:])*)[ \t\f]*[=:]?[ \t\f]*(.*)$"
    part = lambda k: _unescaped(F.regexp_extract("value", cut, k))
    return t.select("path", "line", part(1).alias("key"), part(2).alias("value")).groupBy("key").agg(F.max_by("value", F.struct("path", "line")).alias("value"))


def _unescaped(c: Column) -> Column:
    """Escapes of a properties file: pieces between backslash pairs are told apart, then each escape is read."""
    pieces = F.regexp_extract_all(c, F.lit(r"(?s)(\\u[0-9a-fA-F]{4}|\\.|[^\\]+|\\)"), F.lit(1))
    code = lambda x: F.decode(F.unhex(F.substring(x, 3, 4)), "UTF-16BE")
    known = {"\\t": "\t", "\\n": "\n", "\\r": "\r", "\\f": "\f"}

    def one(x: Column) -> Column:
        out = F.when(~x.startswith("\\"), x).when(x.rlike(r"^\\u[0-9a-fA-F]{4}$"), code(x))
        for k, v in known.items():
            out = out.when(x == k, v)
        return out.otherwise(F.substring(x, 2, 1))

    return F.array_join(F.transform(pieces, one), "")


def fingerprint_of(rows: list[str]) -> str:
    """SHA-256 over lines, for pins of small fixtures."""
    return hashlib.sha256("\n".join(rows).encode()).hexdigest()


def feedback_for(feedback: DataFrame, query: str | None = None, key: str | None = None) -> DataFrame:
    """Feedback of one query text or one query key: plain equalities, which reach the scan."""
    if query is not None:
        feedback = feedback.where(F.col("query") == query)
    return feedback.where(F.col("query_key") == key) if key is not None else feedback


def known_feedback(feedback: DataFrame, atoms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events that name a stored atom, and those that don't."""
    ids = atoms.select(F.col("id").alias("atom_id")).distinct()
    return feedback.join(ids, "atom_id", "left_semi"), feedback.join(ids, "atom_id", "left_anti")


# -- segments by byte ranges -----------------------------------------------------------------------------------------------------


def read_segments(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """Lines of segment files, by byte ranges: a large segment is many tasks, and no task holds more than a line and a chunk."""
    from .datasources import register

    register(spark)
    r = spark.read.format("larkspur_segments")
    return (r.option("range", range_bytes) if range_bytes else r).load(path)


def scan_ledger(lines: DataFrame, scope: str | None = None, blocks: int | None = None) -> DataFrame:
    """(path, offset, seq, payload, findings, in_prefix) of lines as read_segments() gives them.

    A line is examined by itself: size, five fields, marker, sequence, length, digest, UTF-8, payload and its canonical form,
    and *scope* if given.  Its sequence is held against the highest of the lines before it since the last one without a usable
    sequence: DUPLICATE_SEQUENCE, SEQUENCE_GAP.  A torn last line is a TORN_TAIL, which is a warning, and no record.

    The records of a segment are its longest valid prefix: lines before the first finding, up to the first that the state of
    its execution refuses (its violation's category is then a finding); later lines are only examined by themselves.  What hangs
    on earlier lines is a running value over blocks of a file, so that one segment is as many tasks as it has blocks.  Offsets
    order lines; numbering them would need a pass of its own."""
    from ..operators import validation
    from ..operators.prefix import Running, running
    from .snapshots import scratch

    # fields are cut from bytes, so that a payload that is no UTF-8 still has a length and a digest
    p = F.col("_p")
    get = lambda k: F.get(p, F.lit(k))
    t = lines.withColumn("_p", F.split(F.decode("line", "ISO-8859-1"), "\t", -1))
    t = t.select("path", "offset", "torn", "oversized", (F.size(p) == 5).alias("_fields"), (get(0) == "MXL1").alias("_magic"), get(1).alias("_seq"), get(2).alias("_length"), get(3).alias("_digest"), F.encode(get(4), "ISO-8859-1").alias("_raw"))
    framed = ~F.col("torn") & ~F.col("oversized") & F.col("_fields") & F.col("_magic")
    seq = F.when(framed & F.col("_seq").rlike(r"^[1-9]\d{0,18}$"), F.expr("try_cast(_seq AS BIGINT)"))
    t = t.withColumns({"framed": framed, "seq": seq, "payload": F.when(F.is_valid_utf8(F.col("_raw")), F.col("_raw").cast("string"))})
    own = F.array(
        F.when(F.col("torn"), "TORN_TAIL").when(F.col("oversized"), "OVERSIZED_RECORD").when(F.col("seq").isNull(), "MALFORMED_RECORD"),
        F.when(F.col("framed") & ((F.col("_length") != F.length("_raw").cast("string")) | F.col("payload").isNull()), "MALFORMED_RECORD"),
        F.when(F.col("framed") & (F.col("_digest") != F.sha2("_raw", 256)), "DIGEST_MISMATCH"),
    )
    t = t.withColumns({"own": own, "decoded": F.when(F.col("framed"), decode_payload(F.col("payload")))})
    # examined once: what follows reads it several times
    where = scratch(lines.sparkSession, "segment-lines")
    t.select("path", "offset", "torn", "framed", "seq", "payload", "own", "decoded.event", "decoded.finding").write.parquet(where)
    t = lines.sparkSession.read.parquet(where)

    places = t.select("path", "offset", "seq", (~F.col("torn") & F.col("seq").isNull()).cast("long").alias("_reset"))
    places = running(places, ["path"], ["offset"], [Running("_resets", "sum", F.col("_reset"), False)], blocks).withColumn("_resets", F.coalesce("_resets", F.lit(0)))
    places = running(places, ["path", "_resets"], ["offset"], [Running("_high", "max", F.col("seq"), False)], blocks)
    before = F.coalesce("_high", F.when(F.col("_resets") == 0, 0))
    order = F.when(F.col("seq") <= before, "DUPLICATE_SEQUENCE").when(F.col("seq") > before + 1, "SEQUENCE_GAP")
    order = places.select("path", "offset", order.alias("_order")).where("_order IS NOT NULL")

    scoped = F.when(F.col("framed") & F.col("finding").isNull() & (F.col("event.scope") != F.lit(scope)), "SCOPE_ID_MISMATCH")
    findings = F.array_distinct(F.array_compact(F.concat(F.slice("own", 1, 1), F.array("_order"), F.slice("own", 2, 2), F.array(F.when(F.col("payload").isNotNull(), F.col("finding")), scoped))))
    t = t.join(order, ["path", "offset"], "left").select("path", "offset", "seq", "payload", "event", findings.alias("findings"))
    stop = t.where(F.size("findings") > 0).groupBy("path").agg(F.min("offset").alias("_stop"))
    t = t.join(stop, "path", "left").withColumn("_sound", F.coalesce(F.col("offset") < F.col("_stop"), F.lit(True)))
    # the prefix is judged file by file: a file is a scope of its own here
    shared = ["event_id", "kind", "execution", "task", "attempt", "ordinal", "previous", "accepted", "supersedes"]
    records = t.where("_sound").select(F.col("path").alias("scope"), "seq", F.coalesce("event.revision", F.lit(1)).alias("revision"), *(F.col(f"event.{c}").alias(c) for c in shared))
    refused = validation.validate(records).groupBy("scope").agg(F.min_by(F.struct("seq", "category"), "seq").alias("r")).select(F.col("scope").alias("path"), F.col("r.seq").alias("_refused"), F.col("r.category").alias("_category"))
    t = t.join(refused, "path", "left")
    return t.select(
        "path",
        "offset",
        "seq",
        "payload",
        F.when(F.col("_sound") & (F.col("seq") == F.col("_refused")), F.array("_category")).otherwise(F.col("findings")).alias("findings"),
        (F.col("_sound") & F.coalesce(F.col("seq") < F.col("_refused"), F.lit(True))).alias("in_prefix"),
    )
