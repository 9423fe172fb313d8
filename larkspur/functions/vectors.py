"""Signed feature hashing and vector arithmetic: float32 products, float64 sums in index order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 128


def bucket(token: Column, dimensions: int = DIMENSIONS) -> Column:
    """SHA-256's first four bytes as a signed integer, modulo the dimensions."""
    n = F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("long")
    return F.pmod(F.when(n >= 1 << 31, n - (1 << 32)).otherwise(n), F.lit(dimensions)).cast("int")


def sign(token: Column) -> Column:
    """1 if the next four bytes are even, else -1."""
    return F.when(F.conv(F.substring(F.sha2(token, 256), 16, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)


#: Tokens whose bucket and sign a worker remembers.
MEMO = 500_000


def encoded(rows: DataFrame, key: str, weighted: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, vec array<float>): the normalised vector of array<struct<token, weight>>, zero without tokens.

    A vector hangs on its row only, so rows are encoded where they are read: no shuffle.  Float32 sums in the tokens' order,
    norm and quotients as in single precision of double sums."""
    kind = dict(rows.dtypes)[key]

    def go(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, float]] = {}
        for b in it:
            lists = b.column(1)
            flat = lists.flatten()
            coded, weight = flat.field("token").dictionary_encode(), flat.field("weight").to_numpy(zero_copy_only=False)
            names = coded.dictionary.to_pylist()
            if len(known) > MEMO:
                known.clear()
            for t in names:
                if t not in known:
                    h = hashlib.sha256(t.encode()).digest()
                    known[t] = (int.from_bytes(h[:4], "big", signed=True) % dimensions, -1.0 if h[7] & 1 else 1.0)
            got = np.array([known[t] for t in names]).reshape(-1, 2)[coded.indices.to_numpy(zero_copy_only=False)]
            row = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            v = np.zeros((b.num_rows, dimensions), np.float32)
            np.add.at(v.reshape(-1), row * dimensions + got[:, 0].astype(np.int64), (got[:, 1] * weight).astype(np.float32))
            norm = np.sqrt((v * v).astype(np.float64).sum(1)).astype(np.float32)
            unit = (v.astype(np.float64) / np.where(norm > 0, norm, 1).astype(np.float64)[:, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * dimensions, pa.int32()), pa.array(unit.ravel()))], ["key", "vec"])

    return rows.select(F.col(key).alias("key"), F.coalesce(weighted, F.array().cast("array<struct<token:string,weight:double>>")).alias("w")).mapInArrow(go, f"key {kind}, vec array<float>").withColumnRenamed("key", key)


def sparse(rows: DataFrame, key: str, weighted: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, bucket, x float): encoded() without zero components."""
    return encoded(rows, key, weighted, dimensions).select(key, F.posexplode("vec").alias("bucket", "x")).where("x <> 0")


def dot(a: Column, b: Column) -> Column:
    """Products and sum in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, p: s + p)


def _float_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, p: s + p.cast("double"))


def cosine(a: Column, b: Column) -> Column:
    """0 if either norm is 0; different lengths are an error."""
    p, m, n = _float_dot(a, b), _float_dot(a, a), _float_dot(b, b)
    value = F.when((m == 0) | (n == 0), 0.0).otherwise(p / (F.sqrt(m) * F.sqrt(n)))
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vector dimensions differ")).cast("double"))


def centroid(rows: DataFrame, vector: str, *by: str) -> DataFrame:
    """(by, position, mean) of vectors of a group."""
    return rows.select(*by, F.posexplode(vector).alias("position", "x")).groupBy(*by, "position").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def cosine_parts(a: Column, b: Column) -> Column:
    """array<struct<bucket, product>> of a pair: what each bucket adds to the cosine of unit vectors."""
    return F.filter(F.transform(F.zip_with(a, b, lambda x, y: (x * y).cast("double")), lambda p, k: F.struct(k.alias("bucket"), p.alias("product"))), lambda s: s["product"] != 0)


def decomposition(pairs: DataFrame, a: str, b: str, first: int) -> DataFrame:
    """pairs with what makes up their cosine: score (the sum of all buckets' products), the *first* largest products'
    sum as covered, the rest as residual, shared buckets and those with products below zero (collisions of signs)."""
    p = pairs.withColumn("_p", cosine_parts(F.col(a), F.col(b)))
    products = F.transform("_p", lambda s: s["product"])
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    top = F.slice(F.sort_array(F.transform(products, lambda v: F.struct(F.abs(v).alias("m"), v.alias("v"))), asc=False), 1, first)
    p = p.withColumn("score", total(products)).withColumn("covered", total(F.transform(top, lambda s: s["v"])))
    return p.withColumn("residual", F.col("score") - F.col("covered")).withColumn("shared", F.size("_p")).withColumn("opposed", F.size(F.filter(products, lambda v: v < 0))).drop("_p")


def centroid_cosine(rows: DataFrame, vector: str, by: str) -> DataFrame:
    """rows with near: the cosine of each vector with the mean of its group."""
    mean = centroid(rows, vector, by).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "mean"))), lambda s: s["mean"]).alias("_c"))
    v = F.transform(vector, lambda x: x.cast("double"))
    return rows.join(mean, by).withColumn("near", dot(v, F.col("_c")) / F.sqrt(dot(v, v) * dot(F.col("_c"), F.col("_c")))).drop("_c")
