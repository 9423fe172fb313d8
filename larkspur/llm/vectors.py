"""What the vector operators share: valid vectors, equal ones collapsed, coarse lists, and lists met in bounded blocks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Vectors that lists and codebooks are fitted to, at most (by hash of id): what the driver holds.
SAMPLE = 32_768
#: Vectors of either side that one task compares at a time.
BLOCK = 4_096


def as_matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long lists without nulls."""
    if not len(column):
        return np.zeros((0, 1))
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def is_valid(vector: str) -> F.Column:
    """Is the vector not null, empty or zero, and are all its components finite?"""
    x = F.col(vector)
    ok = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return F.coalesce(ok, F.lit(False))


def valid(rows: DataFrame, vector: str) -> DataFrame:
    return rows.where(is_valid(vector))


def fingerprint(vector: str) -> F.Column:
    """The same for equal vectors only: their components in hexadecimal, hashed."""
    return F.sha2(F.concat_ws(",", F.transform(F.col(vector), lambda v: F.hex(F.struct(v).cast("string").cast("binary")))), 256)


def sampled(rows: DataFrame, vector: str, key: str, size: int = SAMPLE) -> tuple[list, np.ndarray]:
    """Keys and unit vectors of at most *size* rows, the same in every run."""
    got = rows.select(key, vector).orderBy(F.xxhash64(key), key).limit(size).toArrow()
    return got[key].to_pylist(), units(as_matrix(got[vector]))


def units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all x to all c."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0)


def list_count(rows: int, sample: int, least: int) -> int:
    """Coarse lists for that many vectors: their square root, so that lists and their lengths grow alike; *least* at least,
    and one for every 16 vectors of the sample at most."""
    return max(1, min(max(least, int(math.sqrt(rows))), sample // 16))


def kmeans(x: np.ndarray, k: int, seed: int = 0, rounds: int = 8) -> np.ndarray:
    """At most k centres; equal rows give equal centres once."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = distances(x, c).argmin(1)
        n = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        total = np.zeros_like(c)
        if len(x):
            starts = np.flatnonzero(np.diff(near[order], prepend=-1))
            total[near[order][starts]] = np.add.reduceat(x[order], starts, axis=0)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def met(members: DataFrame, visitors: DataFrame, keys: list[str], member_id: str, visitor_id: str, go: Callable, schema: str, block: int = BLOCK) -> DataFrame:
    """go(key, members, visitors), the latter two Arrow tables, for every pair of blocks of equal keys.

    Large lists are cut by hash into blocks of about *block* rows on either side, and each pair of blocks is a task of its
    own, so that no list, however hot, has to fit one task.  Counting is all that needs a shuffle besides the meeting.
    """
    ship(members.sparkSession)
    n_m = members.groupBy(*keys).agg(F.ceil(F.count("*") / block).alias("_nm"))
    n_v = visitors.groupBy(*keys).agg(F.ceil(F.count("*") / block).alias("_nv"))
    n = n_m.join(n_v, keys)
    m = members.join(n, keys).withColumn("_bm", F.pmod(F.xxhash64(member_id), F.col("_nm"))).withColumn("_bv", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nv") - 1)))
    v = visitors.join(n, keys).withColumn("_bv", F.pmod(F.xxhash64(visitor_id), F.col("_nv"))).withColumn("_bm", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nm") - 1)))
    by = [*keys, "_bm", "_bv"]
    v = v.drop("_nm", "_nv")
    v = v.select(*(F.col(c).alias(f"v_{c}") for c in v.columns))  # both sides may come from one table

    def named(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return go(key, left, right.rename_columns([c.removeprefix("v_") for c in right.column_names]))

    return m.drop("_nm", "_nv").groupBy(*by).cogroup(v.groupBy(*(f"v_{c}" for c in by))).applyInArrow(named, schema)


def mapped(rows: DataFrame, go: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    ship(rows.sparkSession)

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, 4_096):
                yield go(b.slice(at, 4_096))

    return rows.mapInArrow(each, schema)
