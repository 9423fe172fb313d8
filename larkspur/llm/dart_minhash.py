"""Near-duplicate documents by DartMinHash signatures, banded joining and exact verification.

Every element of a weighted set owns a strip of the plane as wide as its weight.  Hashed darts fall on the strip as a
Poisson process in the direction of rank, the same darts for the same element in every set.  A set throws the darts of
rank up to t / its weight, about t in all however large it is; each dart is hashed to one of K coordinates, and a
coordinate keeps its earliest dart.  Two sets agree in a coordinate with the probability of their weighted Jaccard
similarity.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import batches, texts_of
from .common import components, only, saved, ship
from .vectors import met

#: Words of a shingle, and the least similarity of a link.
WORDS, SIMILARITY = 5, 0.8
#: Bands and coordinates of a band: at similarity 0.8 a pair shares no band once in 20 million times.
BANDS, ROWS = 32, 4
#: Texts of either side that a task compares in a bucket of several components.
PAIR_BLOCK = 512
_WORD = re.compile(r"\w+")
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (splitmix64's finaliser)."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(own: list[str], words: int = WORDS) -> np.ndarray:
    """Hashes of the runs of five words (lower case, marks dropped); all words of a shorter text are one shingle."""
    import xxhash

    if not own:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))
    n = max(1, len(h) - words + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(h))):
        out = mixed(out ^ h[k : k + n])
    return out


def weighted(s: np.ndarray, counted: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and their weights: how often they occur, or 1 each."""
    x, n = np.unique(s, return_counts=True)
    return x, n.astype(np.float64) if counted else np.ones(len(x))


def strips(elements: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(name, width) of the unit strips that make up each element's region; the last one of a region may be narrower."""
    n = np.ceil(weights).astype(np.int64)
    if len(elements) == 0 or n.max() <= 1:
        return mixed(elements), weights
    at = np.repeat(np.arange(len(elements)), n)
    turn = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    return mixed(elements[at] ^ mixed(turn.astype(np.uint64))), np.minimum(weights[at] - turn, 1.0)


def signature(elements: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """The K earliest darts of a set with positive real weights (not empty).

    On each unit strip, gaps between darts are exponential; only strips with a dart of low enough rank go on to their next
    dart.  A dart falls at a hashed place across its strip and misses the region where that is narrower.  Should a
    coordinate stay empty, more ranks are thrown.
    """
    names, widths = strips(elements, weights)
    narrow = bool((widths < 1).any())
    t = k * (np.log(k) + 3.0)
    while True:
        limit = t / weights.sum()
        ident = np.zeros(k, np.uint64)
        filled = np.zeros(k, bool)
        step = max(1, int(np.ceil(limit)) if limit >= 0.5 else 1)
        live, own, rank, n = names, widths, np.zeros(len(names)), 0
        ranks, darts = [], []
        while len(live):
            dart = mixed(live[:, None] + np.arange(n + 1, n + step + 1, dtype=np.uint64) * _GOLD)
            gap = -np.log((dart >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54)
            got = rank[:, None] + np.cumsum(gap, axis=1)
            below = got < limit
            hit = below & ((mixed(dart ^ _M1) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < own[:, None]) if narrow else below
            ranks.append(got[hit])
            darts.append(dart[hit])
            on = below[:, -1]
            live, own, rank, n = live[on], own[on], got[on, -1], n + step
        ranks, darts = np.concatenate(ranks), np.concatenate(darts)
        name = mixed(darts)
        coordinate = (name % np.uint64(k)).astype(np.int64)
        order = np.argsort(-ranks, kind="stable")  # the earliest is written last
        ident[coordinate[order]] = name[order]
        filled[coordinate] = True
        if filled.all():
            return ident
        t *= 2


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    x = sig.reshape(-1, rows)
    out = np.arange(len(x), dtype=np.uint64)
    for k in range(rows):
        out = mixed(out ^ x[:, k])
    return out.view(np.int64)


def signed(docs: DataFrame, n_bands: int = BANDS, rows: int = ROWS, counted: bool = True) -> DataFrame:
    """(id, h1, h2, fp, node, bands) of every row, in one pass over the texts.

    h1 and h2 hash the text as it is.  Texts with the same words in the same order share fp, and node, 64 bits of it; a text
    without words has the fingerprint of its characters, so that only equal ones meet, and no bands; a null text has neither.
    """
    ship(docs.sparkSession)

    def go(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in it:
            for b in batches(whole):
                fps, out, at = [], [], [0]
                for t in b.column(3).to_pylist():
                    words = [] if t is None else _WORD.findall(t.lower())
                    fps.append(None if t is None else xxhash.xxh3_128_digest((" ".join(words) if words else "\n" + t).encode()))
                    if words:
                        out.append(bands(signature(*weighted(shingles(words), counted), n_bands * rows), rows))
                    at.append(at[-1] + (n_bands if words else 0))
                flat = np.concatenate(out) if out else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))
                nodes = pa.array([None if f is None else int.from_bytes(f[:8], "little", signed=True) for f in fps], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(fps, pa.binary()), nodes, lists], ["id", "h1", "h2", "fp", "node", "bands"])

    own = docs.select(F.col("doc_id").cast("long").alias("id"), *(h.alias(n) for h, n in zip(text_hashes("text"), ("h1", "h2"), strict=True)), "text")
    return own.mapInArrow(go, "id long, h1 long, h2 long, fp binary, node long, bands array<long>")


def text_hashes(text: str) -> list[F.Column]:
    """Two independent hashes of a text."""
    return [F.xxhash64(F.col(text)), F.xxhash64(F.lit(7), F.col(text))]


def shingled(docs: DataFrame, counted: bool = True) -> DataFrame:
    """(id, s binary) of (id, text): the strips of the text's shingles as sorted 32-bit hashes."""
    ship(docs.sparkSession)

    def go(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for b in batches(whole):
                got = [np.unique((strips(*weighted(shingles(_WORD.findall(t.lower())), counted))[0] >> np.uint64(32)).astype(np.uint32)).tobytes() for t in texts_of(b.column(1))]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], ["id", "s"])

    return docs.select("id", "text").mapInArrow(go, "id long, s binary")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Those of the pairs (a, b) whose shingle sets have at least that Jaccard similarity."""

    def go(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                small, large = min(len(x), len(y)), max(len(x), len(y))
                if small < similarity * large:
                    keep.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (small + large - both) - 1e-9)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    left, right = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(go, "a long, b long")


def block_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places (left, right) whose sets are similar: shared elements are counted by matrix products, some columns at a time."""
    every, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    shared = np.bincount(code, minlength=len(every)) > 1
    column = np.cumsum(shared) - 1
    keep = shared[code]
    code, owner = column[code[keep]], owner[keep]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    both = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, 4_096):
        lo, hi = np.searchsorted(code, [at, at + 4_096])
        m = np.zeros((len(sets), 4_096), np.float32)
        m[owner[lo:hi], code[lo:hi] - at] = 1
        both += m[left] @ m[right].T
    size = np.array(list(map(len, sets)), np.float32)
    return np.nonzero(both >= similarity * (size[left][:, None] + size[right][None] - both) - 1e-4)


def links_across(open_: DataFrame, similarity: float) -> DataFrame:
    """open_ (band, bucket, id, component, s): links (a, b) between components that meet in a bucket.

    Blocks of a bucket meet in tasks of their own, and a task returns what joins components, at most one link for each:
    nothing of the pairs that it compares leaves it."""

    def go(key: tuple, m: pa.Table, v: pa.Table) -> pa.Table:
        ids, comp = (np.concatenate([m[c].to_numpy(), v[c].to_numpy()]) for c in ("id", "component"))
        sets = [np.frombuffer(x, np.uint32) for x in m["s"].to_pylist() + v["s"].to_pylist()]
        n = m.num_rows
        up: dict[int, int] = {}

        def root(i: int) -> int:
            while (p := up.setdefault(i, i)) != i:
                up[i] = i = up.setdefault(p, p)
            return i

        a, b = [], []
        if n and len(sets) > n:
            for x, y in zip(*block_links(sets, np.arange(n), np.arange(n, len(sets)), similarity), strict=True):
                y += n
                p, q = root(int(comp[x])), root(int(comp[y]))
                if p != q:
                    up[max(p, q)] = min(p, q)
                    a.append(int(ids[x]))
                    b.append(int(ids[y]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return met(open_, open_, ["band", "bucket"], "id", "id", go, "a long, b long", PAIR_BLOCK)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, n_bands: int = BANDS, rows: int = ROWS, counted: bool = True) -> DataFrame:
    """(doc_id, class_id, text_id, keep) of every row of docs.

    class_id is the smallest doc_id that links lead to, text_id the smallest of equal texts, keep whether the row is the
    one of its class that stays.  Links: equal words in order, or five-word shingles, weighted by their occurrences, with a
    Jaccard similarity of at least *similarity* that share a band.  Null texts and null doc_ids are classes of their own and
    stay.  Texts, not doc_ids, are what is compared: rows that repeat a doc_id with other texts are in the classes of their
    texts, and of rows that repeat a doc_id and its text one stays.  Empty texts are equal texts.  An empty table gives no
    rows; other columns aren't read.

    1. One pass gives each row a fingerprint and the bands of its signature; the text is read again for candidates only.
       Equal texts collapse to one node (the min combines before the shuffle).
    2. In each band bucket one member is the hub: the text with the largest buckets, as the origin of many variants meets
       most of them; every other member is paired with it, so a bucket of n texts makes n - 1 pairs.  Pairs are verified
       exactly and the links joined to components.
    3. Buckets inside one component are done.  In the others members of different components are compared, block by block
       inside tasks that return only what joins components; so no link of a bucket is lost, and no pairs are shuffled.
    """
    return _classes(docs, similarity, n_bands, rows, counted).select(F.col("id").alias("doc_id"), "class_id", "text_id", "keep")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, with all their columns, that near_duplicates() keeps: one of each class, and all rows without a
    doc_id or a text.  Rows are told apart by doc_id and text; of rows alike in both, the one whose other columns have the
    least hash stays."""
    stays = _classes(docs, similarity, BANDS, ROWS, True).where("keep AND id IS NOT NULL AND fp IS NOT NULL").select("id", "h1", "h2").distinct()
    alone = F.col("doc_id").isNull() | F.col("text").isNull()
    other = [F.col(f"`{c}`") for c, kind in docs.dtypes if c not in ("doc_id", "text") and "map<" not in kind]
    h1, h2 = text_hashes("text")
    own = docs.where(~alone).select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), h1.alias("h1"), h2.alias("h2"), (F.xxhash64(*other) if other else F.lit(0)).alias("place"))
    turn = F.row_number().over(Window.partitionBy("id", "h1", "h2").orderBy("place"))
    return own.join(stays, ["id", "h1", "h2"], "left_semi").withColumn("turn", turn).where("turn = 1").select("row.*").unionByName(docs.where(alone))


def _classes(docs: DataFrame, similarity: float, n_bands: int, rows: int, counted: bool) -> DataFrame:
    """(id, h1, h2, fp, class_id, text_id, keep) of every row."""
    sig = saved(signed(docs, n_bands, rows, counted), "near-signed")
    first = saved(sig.where("fp IS NOT NULL AND id IS NOT NULL").groupBy("fp", "node").agg(F.min(F.struct("id", "h1")).alias("m")).select("fp", "node", F.col("m.id").alias("text_id"), "m.h1"), "near-first")
    # the bands of one row of each text: rows of one fp have the same
    one = saved(sig.where("fp IS NOT NULL").select(F.col("id").alias("text_id"), "fp", "h1", "bands").join(first, ["fp", "text_id", "h1"]).dropDuplicates(["fp", "text_id", "h1"]).select(F.col("node").alias("id"), "bands"), "near-bands")
    placed = one.select("id", F.posexplode("bands").alias("band", "bucket"))
    sizes = placed.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    crowded = saved(placed.join(sizes, ["band", "bucket"]), "near-crowded")
    popular = crowded.groupBy("id").agg(F.sum("n").alias("weight"))
    hub = crowded.select("band", "bucket", "id").join(popular, "id").groupBy("band", "bucket").agg(F.max_by("id", F.struct("weight", "id")).alias("hub"))
    members = crowded.select("band", "bucket", "id")
    star = members.join(hub, ["band", "bucket"]).where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    # of each candidate text one row is read again
    wanted = first.join(popular.select(F.col("id").alias("node")), "node").select("node", F.xxhash64("text_id", "h1").alias("id"))
    texts = docs.where("text IS NOT NULL").select(F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("id"), "text")
    again = shingled(only(texts, wanted.select("id"), "id"), counted)
    sets = saved(again.join(wanted, "id").dropDuplicates(["id"]).select(F.col("node").alias("id"), "s"), "near-sets")
    links = saved(similar(star, sets, similarity), "near-links")
    label = components(links, "near")
    of = lambda x, label: x.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed2 = of(members, label)
    several = placed2.groupBy("band", "bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band", "bucket")
    open_ = saved(placed2.join(several, ["band", "bucket"]).join(sets, "id"), "near-open")
    more = saved(links_across(open_, similarity), "near-more")
    if more.limit(1).count():
        label = components(links.unionByName(more), "near")
    text_class = of(first.select(F.col("node").alias("id"), "fp", "text_id"), label)
    least = text_class.groupBy("component").agg(F.min("text_id").alias("class_id"))
    known = text_class.join(least, "component").select("fp", "text_id", "class_id")
    # rows without a doc_id or a text have no class to look up: they pass by the join and the window, however many they are
    every, free = sig.select("id", "h1", "h2", "fp"), F.col("id").isNull() | F.col("fp").isNull()
    alone = every.where(free).select("*", F.col("id").alias("class_id"), F.col("id").alias("text_id"), F.lit(True).alias("keep"))
    turn = F.row_number().over(Window.partitionBy("id", "class_id").orderBy("h1", "h2"))
    found = every.where(~free).join(known, "fp").select("id", "h1", "h2", "fp", "class_id", "text_id").withColumn("turn", turn)
    return found.select("id", "h1", "h2", "fp", "class_id", "text_id", ((F.col("id") == F.col("class_id")) & (F.col("turn") == 1)).alias("keep")).unionByName(alone)
