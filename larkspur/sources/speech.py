"""Speech samples: WAV metadata and acoustic features, paths, transcripts, imports."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fusion, recall
from .snapshots import kept

WINDOWS, SILENCE, DIMENSIONS = 8, 0.01, 16


def parse_wav(raw: bytes) -> tuple[int, int, int, np.ndarray]:
    """(sample rate, channels, bits, samples from -1 to 1 averaged over channels) of plain PCM with 1-2 channels, 8 or 16 bits; cut chunks and other formats are errors."""
    if len(raw) < 12 or raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, fmt, data = 12, None, None
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        body = raw[at + 8 : at + 8 + size]
        if len(body) < size:
            raise ValueError("truncated WAV chunk")
        if name == b"fmt ":
            fmt = struct.unpack_from("<HHIIHH", body)
        elif name == b"data":
            data = body
        at += 8 + size + size % 2
    if fmt is None or data is None or fmt[0] != 1 or fmt[1] not in (1, 2) or fmt[5] not in (8, 16):
        raise ValueError("unsupported WAV format")
    _, channels, rate, _, _, bits = fmt
    width = bits // 8 * channels
    data = data[: len(data) // width * width]
    x = np.frombuffer(data, "<i2").astype(np.float64) / 32768 if bits == 16 else (np.frombuffer(data, np.uint8).astype(np.float64) - 128) / 128
    return rate, channels, bits, x.reshape(-1, channels).mean(1)


def acoustic(x: np.ndarray, rate: int, dimensions: int = DIMENSIONS) -> np.ndarray | None:
    """Duration, mean of magnitudes, RMS, zero-crossing rate, peak, share of silence and RMS of eight windows, cut or
    filled to *dimensions* and scaled to length one; None for fewer than 8 samples or silence."""
    if len(x) < 8 or not np.sqrt((x * x).mean()) > 0:
        return None
    mag = np.abs(x)
    parts = [np.sqrt((p * p).mean()) if len(p) else 0.0 for p in np.array_split(x, WINDOWS)]
    f = np.array([len(x) / rate, mag.mean(), np.sqrt((x * x).mean()), ((x[1:] >= 0) != (x[:-1] >= 0)).mean(), mag.max(), (mag < SILENCE).mean(), *parts], np.float32)
    out = np.zeros(dimensions, np.float32)
    out[: min(dimensions, len(f))] = f[:dimensions]
    return out / np.float32(np.sqrt(np.square(out.astype(np.float64)).sum()))


def features_of_samples(rows: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(sample_id, vec, failure) of rows (sample_id, samples array<double>, sample_rate)."""

    def go(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            got = [acoustic(np.array(x or [], np.float64), r or 1, dimensions) for x, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if g is None else g.tolist() for g in got], pa.list_(pa.float32())), pa.array([None if g is not None else "TOO_SHORT_OR_SILENT" for g in got], pa.string())], ["sample_id", "vec", "failure"])

    return rows.select("sample_id", "samples", "sample_rate").mapInArrow(go, "sample_id string, vec array<float>, failure string")


def read_wavs(spark: SparkSession, path: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(path, sample_rate, channels, bits, duration_ms, sha256, vec, failure) of all WAV files below *path*."""
    t = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(path).select("path", F.sha2("content", 256).alias("sha256"), "content")

    def go(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "sha256", "sample_rate", "channels", "bits", "duration_ms", "vec", "failure"]
        for b in it:
            rows = []
            for raw in b.column(2):
                try:
                    rate, ch, bits, x = parse_wav(raw.as_py())
                    v = acoustic(x, rate, dimensions)
                    rows.append((rate, ch, bits, len(x) * 1000 // rate, None if v is None else v.tolist(), None if v is not None else "TOO_SHORT_OR_SILENT"))
                except (ValueError, struct.error) as e:
                    rows.append((None, None, None, None, None, str(e)))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float32()), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    return t.mapInArrow(go, "path string, sha256 string, sample_rate int, channels int, bits int, duration_ms long, vec array<float>, failure string")


def _last(path: Column, pattern: str) -> Column:
    """The last segment of a path that fits."""
    return F.try_element_at(F.filter(F.split(path, "/"), lambda s: s.rlike(pattern)), F.lit(-1))


def speaker(path: Column) -> Column:
    """The last segment like F01, M12, FC03 or MC04."""
    return _last(path, r"^(?i)[FM]C?\d{2}$")


def condition(path: Column) -> Column:
    s = F.upper(speaker(path))
    return F.when(s.isNull(), "UNKNOWN").when(s.rlike("^[FM]C"), "CONTROL").otherwise("DYSARTHRIA")


def task_type(path: Column) -> Column:
    s = F.lower(_last(path, r"(?i)(word|sentence|passage|prompt)"))
    return F.when(s.contains("sentence"), "SENTENCE").when(s.contains("word"), "WORD").when(s.contains("passage"), "PASSAGE").when(s.contains("prompt"), "PROMPT").otherwise("UNKNOWN")


def resolve_transcripts(wavs: DataFrame, candidates: DataFrame) -> DataFrame:
    """wavs with transcript: of candidates (path, priority, content) the first that exists, even if blank, which is none."""
    best = candidates.where("content IS NOT NULL").groupBy("path").agg(F.min_by("content", "priority").alias("_c"))
    clean = F.trim(F.regexp_replace("_c", r"\s+", " "))
    return wavs.join(best, "path", "left").withColumn("transcript", F.when(clean != "", clean)).drop("_c")


def import_audit(samples: DataFrame) -> DataFrame:
    """(warning, n): what is missing from imported samples."""
    w = F.array_compact(F.array(F.when(F.col("transcript").isNull(), "MISSING_TRANSCRIPT"), F.when(F.col("speaker").isNull(), "UNKNOWN_SPEAKER"), F.when(F.col("task_type") == "UNKNOWN", "UNKNOWN_TASK"), F.when(F.col("failure").isNotNull(), "UNREADABLE_AUDIO")))
    return samples.select(F.explode(w).alias("warning")).groupBy("warning").agg(F.count("*").alias("n"))


def last_vectors(features: DataFrame) -> DataFrame:
    """Speech vectors are last-wins per sample, in the order first seen."""
    g = features.groupBy("sample_id").agg(F.max_by("vec", "seq").alias("vec"), F.min("seq").alias("seq"))
    return g


def encode_missing(samples: DataFrame, existing: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """Features of samples that have none yet."""
    return features_of_samples(samples.join(existing.select("sample_id"), "sample_id", "left_anti"), dimensions)


def to_atoms(samples: DataFrame) -> DataFrame:
    """Transcripts as atoms; the sample's id is the atom's."""
    return samples.where("transcript IS NOT NULL").select(F.col("sample_id").alias("atom_id"), F.col("transcript").alias("content"))


def encode_job(samples: DataFrame, existing: DataFrame, *by: str, dimensions: int = DIMENSIONS) -> tuple[DataFrame, DataFrame]:
    """(features, coverage): features of samples (sample_id, samples, sample_rate and the columns of *by*) that have none yet, encoded
    once and kept as a table, and what became of all samples in each group.

    coverage: (grouping, value, samples, skipped, encoded, failed, failures): for ALL, each column of *by* and the dimensions of
    the vectors; failures are 'reason=count' in the order of reasons."""
    new = kept(encode_missing(samples, existing, dimensions), "features")
    have = existing.select("sample_id", F.size("vec").alias("_dims")).groupBy("sample_id").agg(F.max("_dims").alias("_dims"))
    t = samples.select("sample_id", *by).join(have, "sample_id", "left").join(new.select("sample_id", "failure", F.when(F.col("failure").isNull(), F.size("vec")).alias("_new")), "sample_id", "left")
    t = t.withColumn("_size", F.coalesce("_dims", "_new").cast("string"))
    group = lambda name, value: F.struct(F.lit(name).alias("grouping"), F.coalesce(value.cast("string"), F.lit("UNKNOWN")).alias("value"))
    keys = F.array(group("ALL", F.lit("")), *(group(c, F.col(c)) for c in by), group("dimensions", F.coalesce("_size", F.lit("NONE"))))
    each = t.select(F.explode(keys).alias("g"), "failure", F.col("_dims").isNotNull().alias("skipped"), F.col("_new").isNotNull().alias("encoded")).select("g.*", "failure", "skipped", "encoded")
    by_reason = each.groupBy("grouping", "value", "failure").agg(F.count("*").alias("n"), F.count_if("skipped").alias("skipped"), F.count_if("encoded").alias("encoded"))
    said = F.array_join(F.array_sort(F.collect_list(F.when(F.col("failure").isNotNull(), F.concat_ws("=", "failure", F.col("n").cast("string"))))), ",")
    failed = F.sum(F.when(F.col("failure").isNotNull(), F.col("n")).otherwise(0))
    return new, by_reason.groupBy("grouping", "value").agg(F.sum("n").alias("samples"), F.sum("skipped").alias("skipped"), F.sum("encoded").alias("encoded"), failed.alias("failed"), said.alias("failures"))


def search(queries: DataFrame, samples: DataFrame, features: DataFrame, k: int, dimensions: int = DIMENSIONS, threshold: float | None = None, digits: int | None = None, **filters: tuple[str, str | None]) -> tuple[DataFrame, DataFrame]:
    """(ranking, candidates) of audio queries (query_id, vec) over the last features of samples.

    filters: name to (column of samples, wanted value; None passes all).  candidates: (sample_id, status, failed) of every stored
    vector: ORPHAN_VECTOR, INCOMPATIBLE_DIMENSIONS, METADATA_FILTERED (with the filters it fails) or SCORED.  ranking: (query_id,
    rank, sample_id, score) of the k best that are scored; nothing else enters the scan."""
    failed = fusion.failed_filters(**{n: (F.col(c).cast("string"), v) for n, (c, v) in filters.items()})
    known = samples.select("sample_id", F.lit(True).alias("_known"), failed.alias("failed"))
    t = last_vectors(features).select("sample_id", "vec").join(known, "sample_id", "left")
    status = fusion.candidate_status(F.col("_known"), F.size("vec"), F.lit(dimensions), F.coalesce("failed", F.array().cast("array<string>")))
    t = t.withColumn("status", status)
    ranking = recall.scan(t.where("status = 'SCORED'").select("sample_id", "vec"), queries, k, threshold, digits, "sample_id")
    return ranking, t.select("sample_id", "status", F.when(F.col("status") == "METADATA_FILTERED", F.col("failed")).otherwise(F.array().cast("array<string>")).alias("failed"))
