"""Readers and writers of atoms, vectors, feedback, manifests, ledgers, chunks and fixtures."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import content_id
from ..operators import ledger as _ledger

#: Manifest versions that can be opened.
VERSIONS = ("0.1", "0.2", "0.3", "0.4")


def _in_order(t: DataFrame) -> DataFrame:
    """t with seq, which orders rows as their files' names, and the places in a file, go: it is the rank of the file and then
    the row's number in it, whatever Spark packs into one task."""
    t = t.withColumn("_file", F.col("_metadata.file_path")).withColumn("_at", F.col("_metadata.file_block_start")).withColumn("_n", F.monotonically_increasing_id())
    blocks = t.groupBy("_file", "_at").agg(F.min("_n").alias("_first"))
    # as many rows as blocks of files; whether they are broadcast is up to their size
    blocks = blocks.withColumn("_place", F.row_number().over(Window.orderBy("_file", "_at")))
    return t.join(blocks, ["_file", "_at"]).withColumn("seq", F.col("_place") * F.lit(1 << 40) + F.col("_n") - F.col("_first")).drop("_file", "_at", "_n", "_first", "_place")


def _text(c: Column) -> Column:
    return F.decode(F.unbase64(c), "UTF-8")


def read_atom_log(spark: SparkSession, path: str) -> DataFrame:
    """(id, type, content, aliases, weight, created_at, seq) of a tab-separated log: 5 or 6 fields, Base64 content and
    comma-separated Base64 aliases.  Blank lines are skipped, other malformed lines are an error.  seq orders the lines of a
    file; a log of several files goes on in the order of their names."""
    rows = _in_order(spark.read.text(path)).where(F.trim("value") != "")
    p = F.split("value", "\t", -1)
    n = F.size(p)
    bad = F.raise_error(F.concat(F.lit("malformed atom line: "), F.substring("value", 1, 80)))
    ok = lambda c, kind: F.when(n.isin(5, 6), c).otherwise(bad.cast(kind))
    raw = F.get(p, F.lit(5))
    aliases = F.when(raw.isNull() | (raw == ""), F.array().cast("array<string>")).otherwise(F.transform(F.split(raw, ","), _text))
    return rows.select(ok(F.get(p, F.lit(0)), "string").alias("id"), F.get(p, F.lit(1)).alias("type"), _text(F.get(p, F.lit(2))).alias("content"), aliases.alias("aliases"), F.get(p, F.lit(3)).cast("double").alias("weight"), F.get(p, F.lit(4)).cast("timestamp").alias("created_at"), "seq")


def write_atom_log(atoms: DataFrame, path: str) -> None:
    enc = lambda c: F.base64(F.encode(c, "UTF-8"))
    line = F.concat_ws("\t", "id", "type", enc(F.col("content")), F.col("weight").cast("string"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.array_join(F.transform("aliases", enc), ","))
    atoms.select(line.alias("value")).write.mode("append").text(path)


def last_wins(atoms: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """One row a key, its last; ordered by the first occurrence, which *order* then holds."""
    other = [c for c in atoms.columns if c not in (key, order)]
    g = atoms.groupBy(key).agg(F.max_by(F.struct(*other), order).alias("_v"), F.min(order).alias(order))
    return g.select(key, *(F.col(f"_v.{c}").alias(c) for c in other), order)


def first_version(vectors: DataFrame) -> DataFrame:
    """Point look-up's version of each atom: the first."""
    return vectors.groupBy("atom_id").agg(F.min_by("vec", "version").alias("vec"))


def merge_aliases(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(id, aliases, changed): stored aliases, then new ones, each once."""
    t = incoming.select("id", F.col("aliases").alias("_new")).join(stored.select("id", F.col("aliases").alias("_old")), "id", "left")
    old = F.coalesce("_old", F.array().cast("array<string>"))
    return t.select("id", F.array_union(old, F.col("_new")).alias("aliases"), (F.size(F.array_except(F.col("_new"), old)) > 0).alias("changed"))


def remember(texts: DataFrame, stored: DataFrame, content: str = "content") -> DataFrame:
    """New atoms (id, content) of texts: one a content, none that is stored."""
    return texts.select(content_id(F.col(content)).alias("id"), F.col(content).alias("content")).dropDuplicates(["id"]).join(stored.select("id"), "id", "left_anti")


def read_vector_file(spark: SparkSession, path: str, dimensions: int, prefixed: bool = False) -> DataFrame:
    """(path, version, vec) of big-endian float32 frames; with *prefixed* each frame begins with its length as int32.

    A file is read by one task; frames of the wrong length are an error."""

    def go(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for p, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                buf = np.frombuffer(raw.as_buffer(), np.uint8)
                step = 4 * dimensions + (4 if prefixed else 0)
                if len(buf) % step:
                    raise ValueError(f"{p}: not a whole number of frames")
                frames = buf.reshape(-1, step)
                if prefixed and (frames[:, :4].copy().view(">i4") != dimensions).any():
                    raise ValueError(f"{p}: a frame has another length")
                x = frames[:, 4 if prefixed else 0 :].copy().view(">f4").astype(np.float32)
                for at in range(0, len(x), 4_096):
                    part = x[at : at + 4_096]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * dimensions, pa.int32()), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(part)), pa.array(np.arange(at, at + len(part))), lists], ["path", "version", "vec"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(go, "path string, version long, vec array<float>")


def write_vectors(vectors: DataFrame, path: str, dimensions: int) -> None:
    """Append, after a check that every vector has the dimensions."""
    ok = F.when(F.size("vec") == dimensions, F.col("vec")).otherwise(F.raise_error(F.lit("vector dimensions differ")).cast("array<float>"))
    vectors.withColumn("vec", ok).write.mode("append").parquet(path)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """Feedback JSON lines with seq; a missing queryKey is the query.  A line whose signal disagrees with its delta's sign, or that
    is invalid otherwise, is an error."""
    t = spark.read.schema("query string, queryKey string, atomId string, signal string, delta double, createdAt timestamp").json(path, mode="FAILFAST")
    t = t.select("query", F.coalesce("queryKey", "query").alias("query_key"), F.col("atomId").alias("atom_id"), "signal", "delta", F.col("createdAt").alias("created_at"), "_metadata")
    t = _in_order(t).drop("_metadata")
    bad = F.raise_error(F.concat(F.lit("invalid feedback for atom "), F.coalesce("atom_id", F.lit("null")))).cast("string")
    return t.withColumn("signal", F.when(F.coalesce(valid_feedback(), F.lit(False)), F.col("signal")).otherwise(bad))


def valid_feedback() -> Column:
    d = F.col("delta")
    finite = d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf"))
    return finite & (F.col("query") != "") & (F.col("atom_id") != "") & (((F.col("signal") == "POSITIVE") & (d > 0)) | ((F.col("signal") == "NEGATIVE") & (d < 0)))


def write_feedback(feedback: DataFrame, path: str) -> None:
    feedback.select("query", F.col("query_key").alias("queryKey"), F.col("atom_id").alias("atomId"), "signal", "delta", F.col("created_at").alias("createdAt")).write.mode("append").json(path)


def save_manifest(spark: SparkSession, path: str, manifest: dict[str, str]) -> None:
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_manifest(spark: SparkSession, path: str, **profile: str) -> dict[str, str]:
    """The manifest; an error for an unknown version or where it differs from *profile*."""
    m = json.loads(spark.read.text(path).first()["value"])
    if m.get("version") not in VERSIONS:
        raise ValueError(f"manifest version {m.get('version')} can't be opened")
    if odd := {k: (m.get(k), v) for k, v in profile.items() if m.get(k) != v}:
        raise ValueError(f"manifest differs: {odd}")
    return m


def read_ledger(spark: SparkSession, path: str, scope: str | None = None) -> DataFrame:
    """A ledger written by write_ledger(); a scope is one partition, and the others aren't read."""
    t = spark.read.parquet(path)
    return t.where(F.col("scope") == scope) if scope is not None else t


def write_ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("scope").parquet(path)


def read_framed_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(path, seq, payload, finding) of framed segment files."""
    t = spark.read.text(path)
    return _ledger.parse_framed(t)


def read_table(spark: SparkSession, path: str, schema: str, sep: str = "|", comment: str = "#") -> DataFrame:
    """Fixture tables: separated values with comment lines; malformed lines are an error."""
    return spark.read.schema(schema).csv(path, sep=sep, comment=comment, mode="FAILFAST", quote="", escape="")


def unescaped(c: Column) -> Column:
    r"""\t, \n and \\ of fixture fields."""
    mark = F.lit("\u0001")
    return F.replace(F.replace(F.replace(F.replace(c, F.lit("\\\\"), mark), F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n")), mark, F.lit("\\"))


def verified_text(spark: SparkSession, path: str, sha256: str | None = None) -> DataFrame:
    """(path, text, sha256, n_bytes) of whole files; an error where the digest isn't *sha256* or lines end in CR."""
    t = spark.read.format("binaryFile").load(path).select("path", "content", F.sha2("content", 256).alias("sha256"), F.col("length").alias("n_bytes"))
    s = F.decode("content", "UTF-8")
    wrong = F.contains(s, F.lit("\r"))
    if sha256:
        wrong = wrong | (F.col("sha256") != sha256)
    return t.select("path", F.when(~wrong, s).otherwise(F.raise_error(F.lit("source is not verified"))).alias("text"), "sha256", "n_bytes")


def sample_json(rows: DataFrame, *columns: str) -> DataFrame:
    """(json, digest) of each sample."""
    j = F.to_json(F.struct(*(columns or rows.columns)))
    return rows.select(j.alias("json"), F.sha2(j, 256).alias("digest"))
