"""Embedding near-duplicates by product quantisation: coarse lists, residual codes, table look-ups, exact cosine.

Nothing is lost on the way.  A pair within distance r (unit vectors of cosine c are sqrt(2 - 2c) apart) meets in the list
of one of the two: the other visits every list whose border with its own is no farther than r.  A looked-up distance is
that to the code's point, which lies as far from the vector as the vector's stored error says; a pair is passed over only
where looked-up distance less error exceeds r.  Only pairs of one label meet.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, in_blocks, saved
from .vectors import SAMPLE, as_matrix, distances, fingerprint, kmeans, mapped, met, sampled, units, is_valid

COSINE = 0.93
#: Coarse lists, sub-vectors and points of a codebook.
LISTS, PARTS, POINTS = 64, 8, 256


class Index:
    def __init__(self, x: np.ndarray, lists: int = LISTS, parts: int = PARTS, points: int = POINTS, seed: int = 0):
        self.centres = kmeans(x, min(lists, max(1, int(math.sqrt(len(x))))), seed)
        rest = x - self.centres[distances(x, self.centres).argmin(1)]
        self.cuts = np.array_split(np.arange(x.shape[1]), min(parts, x.shape[1]))
        self.books = [kmeans(rest[:, c], points, seed + 1 + k, 5) for k, c in enumerate(self.cuts)]
        d = self.centres[:, None] - self.centres[None]
        self.apart = np.sqrt((d * d).sum(2))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and error of each vector."""
        near = distances(x, self.centres).argmin(1)
        rest = x - self.centres[near]
        codes = np.stack([distances(rest[:, c], b).argmin(1) for c, b in zip(self.cuts, self.books, strict=True)], 1)
        back = np.concatenate([b[codes[:, k]] for k, b in enumerate(self.books)], 1)
        return near, codes.astype(np.uint8), np.linalg.norm(rest - back, axis=1)

    def probes(self, x: np.ndarray, near: np.ndarray, r: float) -> list[np.ndarray]:
        """Lists from its own on, in order, whose border with its own list is within r."""
        d = distances(x, self.centres)
        border = (d - d[np.arange(len(x)), near][:, None]) / np.maximum(2 * self.apart[near], 1e-12)
        ok = (border <= r + 1e-6) & (np.arange(len(self.centres))[None] >= near[:, None])
        return [np.flatnonzero(row) for row in ok]

    def looked_up(self, visitors: np.ndarray, here: int, codes: np.ndarray) -> np.ndarray:
        """Distances of visitors to the codes' points in list *here*: one table look-up a sub-vector."""
        rest = visitors - self.centres[here]
        out = np.zeros((len(visitors), len(codes)), np.float32)
        for k, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            out += distances(rest[:, c], b).astype(np.float32)[:, codes[:, k]]
        return np.sqrt(np.maximum(out, 0))


def near_vectors(rows: DataFrame, cosine: float = COSINE, vector: str = "embedding", key: str = "vec_id", label: str | None = "label", sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Rows with a null label, or a vector that is null, empty, zero or has null or non-finite components, have no links and
    are components of their own.  Vectors of different length never link.  Equal vectors of a label are compared once, so
    a third of all rows may be copies of one.  Rows that repeat a key are vectors of their own: each has its links, and
    counts in those of others; an empty table gives no rows, and other columns aren't read.
    """
    spark = rows.sparkSession
    lab = F.col(label).cast("string") if label else F.lit("")
    own = rows.select(F.col(key).cast("long").alias("id"), lab.alias("label"), F.col(vector).alias("v"))
    usable = F.col("label").isNotNull() & F.col("id").isNotNull() & is_valid("v")
    good = own.where(usable).withColumn("label", F.concat_ws("/", "label", F.size("v"))).withColumn("fp", fingerprint("v"))
    good = saved(good, "pq-rows")
    one = saved(good.groupBy("label", "fp").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v")).withColumn("rep", F.xxhash64("label", "fp")), "pq-distinct")
    r = math.sqrt(max(0.0, 2 - 2 * cosine))
    found = None
    # each length on its own
    dims = sorted(n for (n,) in one.select(F.size("v").alias("n")).distinct().collect())
    for found_here in in_blocks((_found(one.where(F.size("v") == dim), cosine, r, sample) for dim in dims), "pq-found"):
        found = found_here if found is None else found.unionByName(found_here)
    if found is None:
        known = one.select("label", "fp", (F.col("copies") - 1).alias("n"), F.col("least").alias("component"))
    else:
        found = saved(found, "pq-found")
        counts = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
        label_of = components(found.where("b IS NOT NULL").select("a", "b"), "pq").select(F.col("id").alias("rep"), "component")
        known = one.join(counts, "rep", "left").join(label_of, "rep", "left").select("label", "fp", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
        smallest = known.groupBy("c").agg(F.min("least").alias("component"))
        known = known.join(smallest, "c").select("label", "fp", "n", "component")
    linked = good.join(known, ["label", "fp"]).select(F.col("id").alias(key), F.col("n").alias("n_links"), F.col("component").alias("component_id"))
    alone = own.where(~usable).select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def _found(one: DataFrame, cosine: float, r: float, sample: int) -> DataFrame:
    """(a, b, n): with b, links that connect what is linked; without, how many rows a is linked with, in parts."""
    _, x = sampled(one, "v", "rep", sample)
    held = one.sparkSession.sparkContext.broadcast(Index(x))  # bounded by the sample

    def place(b: pa.RecordBatch) -> pa.RecordBatch:
        index = held.value
        u = units(as_matrix(b.column(3)))
        near, codes, error = index.encode(u)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(near, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error, pa.float64()), pa.array([p.astype(np.int32) for p in index.probes(u, near, r)], pa.list_(pa.int32()))], ["label", "rep", "copies", "v", "list", "codes", "error", "probes"])

    kind = dict(one.dtypes)["v"]
    placed = saved(mapped(one.select("label", "rep", "copies", "v"), place, f"label string, rep long, copies long, v {kind}, list int, codes binary, error double, probes array<int>"), "pq-codes")
    members = placed.select("label", "list", "rep", "copies", "v", "codes", "error")
    visitors = placed.select("label", F.col("list").alias("home"), "rep", "copies", "v", F.explode("probes").alias("list"))

    def go(key: tuple, m: pa.Table, v: pa.Table) -> pa.Table:
        index, here = held.value, key[1].as_py()
        mi, vi = m["rep"].to_numpy(), v["rep"].to_numpy()
        mc, vc, home = m["copies"].to_numpy(), v["copies"].to_numpy(), v["home"].to_numpy()
        mx, vx = units(as_matrix(m["v"])), units(as_matrix(v["v"]))
        codes = np.stack([np.frombuffer(c, np.uint8) for c in m["codes"].to_pylist()]) if len(mi) else np.zeros((0, 1), np.uint8)
        error = m["error"].to_numpy()
        n_m, n_v = np.zeros(len(mi), np.int64), np.zeros(len(vi), np.int64)
        tree: dict[int, int] = {}
        edges: list[tuple[int, int]] = []

        def root(i: int) -> int:
            while (p := tree.setdefault(i, i)) != i:
                tree[i] = i = tree.setdefault(p, p)
            return i

        for at in range(0, len(vi) if len(mi) else 0, 256):
            part = vx[at : at + 256]
            close = index.looked_up(part, here, codes) - error[None].astype(np.float32) <= r + 1e-4
            # inside a list a pair is met from both sides: the smaller id's visit counts
            close &= (home[at : at + 256] != here)[:, None] | (vi[at : at + 256][:, None] < mi[None])
            i, j = np.nonzero(close)
            for lo in range(0, len(i), 200_000):
                a, b = i[lo : lo + 200_000], j[lo : lo + 200_000]
                ok = np.einsum("ij,ij->i", part[a], mx[b]) >= cosine
                a, b = a[ok] + at, b[ok]
                np.add.at(n_v, a, mc[b])
                np.add.at(n_m, b, vc[a])
                for p, q in zip(vi[a].tolist(), mi[b].tolist(), strict=True):
                    x, y = root(p), root(q)
                    if x != y:
                        tree[max(x, y)] = min(x, y)
                        edges.append((p, q))
        ids = np.concatenate([mi[n_m > 0], vi[n_v > 0]])
        n = np.concatenate([n_m[n_m > 0], n_v[n_v > 0]])
        a = np.concatenate([ids, np.array([e[0] for e in edges], np.int64)])
        b = pa.array([None] * len(ids) + [e[1] for e in edges], pa.int64())
        return pa.table({"a": pa.array(a, pa.int64()), "b": b, "n": pa.array([*n.tolist(), *[0] * len(edges)], pa.int64())})

    return met(members, visitors, ["label", "list"], "rep", "rep", go, "a long, b long, n long")
