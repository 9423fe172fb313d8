"""Nearest neighbours by adaptive dimension scan over probed lists.

Vectors are rotated at random and read in blocks of columns.  The distance over the first d of D rotated dimensions,
scaled by D / d, estimates the whole one; where it exceeds the bound of the query by more than the test at d dimensions
allows, the candidate is abandoned, mostly after the first block.  The bound starts at what the sample promises and falls
with every chunk of candidates to the k-th best distance met so far.  What survives all blocks is scored exactly on the
original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_blocks, saved
from .vectors import SAMPLE, as_matrix, distances, fingerprint, kmeans, list_count, mapped, met, units, valid

K = 5
#: Coarse lists at least (there are as many as the square root of the vectors), vectors of the sample that set a query's
#: first bound, and candidates between two bounds.
LISTS, SEEDS, CHUNK = 64, 8_192, 512
#: Columns of a block, and the test's width: a true neighbour is abandoned at a block about once in a hundred.
COLUMNS, EPSILON = 16, 2.1
#: Recall that the probed lists alone reach on the sample; the number of lists probed follows from it.
RECALL = 0.985


class Index:
    def __init__(self, raw: np.ndarray, k: int = K, lists: int = LISTS, recall: float = RECALL, seed: int = 0):
        x = units(raw)
        dim = x.shape[1]
        rng = np.random.default_rng(seed)
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.centres = kmeans(x, lists, seed)
        self.sample = x[:SEEDS]
        self.probes = self._probes(x, k, recall)

    def _probes(self, x: np.ndarray, k: int, recall: float) -> int:
        """Lists that a query must probe: by the place of its sample neighbours' lists in its own order of lists."""
        q = x[: min(len(x), 512)]
        near = distances(x, self.centres).argmin(1)
        d = distances(q, x)
        d[np.arange(len(q)), np.arange(len(q))] = np.inf
        top = np.argsort(d, axis=1, kind="stable")[:, : min(k, max(1, len(x) - 1))]
        place = np.argsort(np.argsort(distances(q, self.centres), axis=1, kind="stable"), axis=1, kind="stable")
        needed = np.sort(place[np.arange(len(q))[:, None], near[top]].ravel())
        return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1

    def first_bound(self, x: np.ndarray, k: int) -> np.ndarray:
        """The squared distance that k vectors of the sample besides an own copy are within."""
        d = distances(x, self.sample)
        d[d < 1e-12] = np.inf
        return np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(x), np.inf)


def scan(rotated: np.ndarray, queries: np.ndarray, bound: np.ndarray, columns: int = COLUMNS, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, squared distance) of pairs that no test abandons."""
    dim = rotated.shape[1]
    d = min(columns, dim)
    part = distances(queries[:, :d], rotated[:, :d])
    i, j = np.nonzero(part * (dim / d) <= (bound * (1 + epsilon / np.sqrt(d)) ** 2)[:, None])
    part = part[i, j]
    while d < dim:
        e = min(d + columns, dim)
        diff = queries[i, d:e] - rotated[j, d:e]
        part = part + np.einsum("ij,ij->i", diff, diff)
        d = e
        slack = (1 + epsilon / np.sqrt(d)) ** 2 if d < dim else 1 + 1e-6
        ok = part * (dim / d) <= bound[i] * slack + 1e-9
        i, j, part = i[ok], j[ok], part[ok]
    return i, j, part


def tightened(rotated: np.ndarray, queries: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) pairs after a scan in chunks, between which each query's bound falls to the distance that k
    candidates besides an own copy are within."""
    bound = bound.copy()
    top = np.full((len(queries), k + 1), np.inf)
    found = []
    for lo in range(0, len(rotated), CHUNK):
        i, j, d = scan(rotated[lo : lo + CHUNK], queries, bound)
        found.append((i, j + lo, d))
        met_now = np.full((len(queries), min(CHUNK, len(rotated) - lo)), np.inf)
        met_now[i, j] = d
        top = np.partition(np.concatenate([top, met_now], axis=1), k, axis=1)[:, : k + 1]
        bound = np.minimum(bound, top.max(axis=1))
    i, j, d = (np.concatenate(x) for x in zip(*found, strict=True))
    ok = d <= bound[i] * (1 + 1e-6) + 1e-9
    return i[ok], j[ok]


def cosines(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of rows i of a with rows j of b; a row's sum hangs on that row only, so that equal vectors get equal scores."""
    na, nb = np.sqrt(np.einsum("ij,ij->i", a, a)), np.sqrt(np.einsum("ij,ij->i", b, b))
    out = np.empty(len(i))
    for at in range(0, len(i), 100_000):
        p, q = i[at : at + 100_000], j[at : at + 100_000]
        out[at : at + 100_000] = np.einsum("ij,ij->i", a[p], b[q]) / (na[p] * nb[q])
    return out


def nearest(rows: DataFrame, k: int = K, every: int = 50, vector: str = "embedding", key: str = "vec_id", sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row whose key is divisible by *every*.

    Vectors that are null, empty, zero or have null or non-finite components take no part, neither do null keys.  Vectors
    of different length are no candidates of each other.  Fewer than k candidates give as many rows.  Equal vectors are
    one candidate with its k + 1 smallest keys, and equal queries are searched once.  Rows that repeat a key are one candidate
    and one query, with the best score of any of its vectors.  Only the two columns named are read; an empty table gives no rows.
    """
    own = valid(rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where("id IS NOT NULL"), "v").withColumn("fp", fingerprint("v")).withColumn("dim", F.size("v"))
    own = saved(own, "scan-rows")
    few = own.groupBy("fp", "id").agg(F.first("v").alias("v"), F.first("dim").alias("dim")).withColumn("r", F.row_number().over(Window.partitionBy("fp").orderBy("id"))).where(F.col("r") <= k + 1)
    asked = own.where(F.col("id") % every == 0).groupBy("fp").agg(F.count("*").alias("asked"))
    one = saved(few.groupBy("fp").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids"), F.first("v").alias("v"), F.first("dim").alias("dim")).join(asked, "fp", "left"), "scan-distinct")
    out = None
    # each length on its own
    dims = sorted(n for (n,) in one.where("asked IS NOT NULL").select("dim").distinct().collect())
    for got in in_blocks((_searched(one.where(F.col("dim") == dim), k, sample) for dim in dims), "scan-found"):
        out = got if out is None else out.unionByName(got)
    schema = "query_id long, rank int, vec_id long, score double"
    if out is None:
        return rows.sparkSession.createDataFrame([], schema)
    best = Window.partitionBy("fp").orderBy(F.desc("score"), "vec_id")
    top = saved(out.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r"), "scan-top")
    queries = own.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "fp").distinct()
    hits = queries.join(top, "fp").where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searched(one: DataFrame, k: int, sample: int) -> DataFrame:
    """(fp, vec_id, score): of each asked vector the k + 1 best candidates of each block that it meets, itself included.

    The sample only places centres, sets how many lists are probed and where bounds begin: every result comes from a list."""
    got = one.select("fp", "v").orderBy("fp").limit(sample).toArrow()  # fp is a hash
    held = one.sparkSession.sparkContext.broadcast(Index(as_matrix(got["v"]), k, list_count(one.count(), got.num_rows, LISTS)))  # bounded by the sample
    kind = dict(one.dtypes)["v"]

    def place(b: pa.RecordBatch) -> pa.RecordBatch:
        index = held.value
        u = units(as_matrix(b.column(3)))
        order = np.argsort(distances(u, index.centres), axis=1, kind="stable")
        asked = b.column(4).is_valid().to_numpy(zero_copy_only=False)
        bound = np.full(len(u), np.inf)
        if asked.any():
            bound[asked] = index.first_bound(u[asked], k)
        lists = [o[: index.probes].astype(np.int32) if a else np.zeros(0, np.int32) for o, a in zip(order, asked, strict=True)]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(order[:, 0], pa.int32()), pa.array(lists, pa.list_(pa.int32())), pa.array(bound)], ["fp", "rep", "ids", "v", "list", "probes", "bound"])

    placed = saved(mapped(one.select("fp", "rep", "ids", "v", "asked"), place, f"fp string, rep long, ids array<long>, v {kind}, list int, probes array<int>, bound double"), "scan-placed")
    members = placed.select("list", "fp", "rep", "ids", "v")
    visitors = placed.select("fp", "v", "bound", F.explode("probes").alias("list"))

    def go(key: tuple, m: pa.Table, v: pa.Table) -> pa.Table:
        index = held.value
        fps, out = v["fp"].to_pylist(), ([], [], [])
        mx, vx = as_matrix(m["v"]), as_matrix(v["v"])
        mu, vu = units(mx), units(vx)
        ids, reps = m["ids"].to_pylist(), m["rep"].to_numpy()
        if len(mu) and len(vu):
            rm, rv, bound = mu @ index.rotation, vu @ index.rotation, v["bound"].to_numpy()
            for at in range(0, len(vu), 128):
                i, j = tightened(rm, rv[at : at + 128], bound[at : at + 128], k)
                i = i + at
                score = cosines(vx, mx, i, j)
                order = np.lexsort((reps[j], -score, i))
                i, j, score = i[order], j[order], score[order]
                start = np.concatenate([[True], i[1:] != i[:-1]]) if len(i) else np.zeros(0, bool)
                place = np.arange(len(i)) - np.maximum.accumulate(np.where(start, np.arange(len(i)), 0)) if len(i) else i
                for a, b, s in zip(i[place <= k].tolist(), j[place <= k].tolist(), score[place <= k].tolist(), strict=True):
                    for x in ids[b]:
                        out[0].append(fps[a])
                        out[1].append(x)
                        out[2].append(s)
        return pa.table({"fp": pa.array(out[0], pa.string()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return met(members, visitors, ["list"], "fp", "fp", go, "fp string, vec_id long, score double").groupBy("fp", "vec_id").agg(F.max("score").alias("score"))
