"""Quality by perplexity under an interpolated modified Kneser-Ney model of words, trained on trusted text.

Pairs of words are counted, their contexts and continuations summed, and the pairs that documents have are looked up in
tables that grow with the corpus.  Counting and looking up are joins of shards: a task sums what it has read, sorts it, packs
it by shard (a pair costs a few bytes) and sends it there; a shard's task puts the packs together, or answers them.  A word that
makes up much of the text is spread over many shards, so that none grows with it.  Words are open: one never seen has the
probability of its spelling under a model of characters.

In that model characters are mapped to a closed alphabet of 64 symbols, so that it has 64**ORDER entries however large
the corpus: that bound is what lets it be broadcast.  Scripts that the alphabet lacks are told apart by their words.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import batches, texts_of
from .common import discard, keep_one, lean, only, saved, ship
from .dart_minhash import mixed, text_hashes

#: Longest n-gram and bits of a symbol: 64**4 = 16.8 million entries of 4 bytes at most.
ORDER, BITS = 4, 6
#: A document is kept if its perplexity is at most this quantile of trusted held-out documents of its language.
QUANTILE = 0.999
#: Quantiles beyond this one are estimated from the tail above it.
TAIL = 0.9
#: Languages with fewer trusted held-out documents use the quantile over all languages.
LEAST_DOCS = 20
#: Of trusted documents those of this fold (crc32 of doc_id) set the thresholds; the others train.
FOLDS = 5
#: The symbols after blank (0) and unknown (1), lower case; the rest of 64 are classes.
SYMBOLS = "abcdefghijklmnopqrstuvwxyzäöüßéèêëàâáíîïóôúùûñç.,;:'\"-()"
#: Words and pairs that are written that often at least, the most frequent of them, are held by every task (12 bytes each);
#: all others are looked up in their shards.
HELD_COUNT, HELD_RUNS = 8, 1 << 20
#: Bits of the bitmap of all others, which stops most words and pairs that the model doesn't have: 16 MB, always.
TAIL_BITS = 1 << 27
#: Words, and fingerprints of texts, that a worker remembers.
MEMO = 100_000
#: Words that a task counts before it packs them, words of the trusted text to a shard, least shards (there is no most: their
#: number follows the text), and shards that a frequent word is spread over.
FLUSH, SHARD_WORDS, SHARDS, SPREAD = 1_000_000, 2_000_000, 8, 64
#: A word is its 40-bit hash; these stand before and behind a text's words.
WORD_SHIFT, START, END = 24, 1, 2
#: A shard is asked by 40 bits of a key: of its some million keys another one has them once in some hundred thousand times.
KEY_SHIFT = 24
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_DIGIT, _UPPER, _OTHER_LETTER, _MARK = (2 + len(SYMBOLS) + k for k in range(4))
assert _MARK < 1 << BITS


def _table() -> np.ndarray:
    """Symbol of each code point below 2**16."""
    out = np.full(1 << 16, 1, np.int32)
    for k in range(1 << 16):
        c = chr(k)
        if c.isspace():
            out[k] = 0
        elif (at := SYMBOLS.find(c.lower()[0])) >= 0 and c.isalpha() and c == c.lower():
            out[k] = 2 + at
        elif c.isdigit():
            out[k] = _DIGIT
        elif c.isupper():
            out[k] = _UPPER
        elif c.isalpha():
            out[k] = _OTHER_LETTER
        elif c in SYMBOLS:
            out[k] = 2 + SYMBOLS.index(c)
        else:
            out[k] = _MARK
    return out


_TABLE: list[np.ndarray] = []


def symbols(text: str) -> np.ndarray:
    """The text's symbols behind ORDER - 1 blanks; a run of white space is one blank, capitals are their own class."""
    if not _TABLE:
        _TABLE.append(_table())
    code = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    s = _TABLE[0][np.minimum(code, (1 << 16) - 1)]
    s = s[(s != 0) | (np.concatenate([[1], s[:-1]]) != 0)] if len(s) else s
    return np.concatenate([np.zeros(ORDER - 1, np.int32), s])


def grams(s: np.ndarray) -> np.ndarray:
    """The code of the n-gram that ends at each symbol after the blanks in front."""
    n = len(s) - ORDER + 1
    out = np.zeros(n, np.int32)
    for k in range(ORDER):
        out = (out << BITS) | s[k : k + n]
    return out


def gram_counts(docs: DataFrame) -> DataFrame:
    """(g int, n long) of all n-grams of order ORDER.  A task sums over all its documents before the shuffle."""
    ship(docs.sparkSession)

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << (BITS * ORDER), np.int32)  # the closed alphabet bounds it: 64 MB
        for whole in it:
            for b in batches(whole):
                codes = [grams(symbols(t)) for t in texts_of(b.column(0)) if t]
                if codes:
                    g, n = np.unique(np.concatenate(codes), return_counts=True)
                    total[g] += n.astype(np.int32)
                if total.max() > 1 << 30:
                    at = np.flatnonzero(total)
                    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["g", "n"])
                    total[:] = 0
        at = np.flatnonzero(total)
        for k in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + 100_000], pa.int32()), pa.array(total[at[k : k + 100_000]], pa.int64())], ["g", "n"])

    return docs.select("text").mapInArrow(rows, "g int, n long").groupBy("g").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(g int, p double, order int): probabilities of observed n-grams of each order and, as order 0 - k, the back-off
    weight of each observed context of k symbols.

    Discounts D1, D2, D3+ of each order come from its counts of counts.  Lower orders count continuations: different
    symbols in front.  p is interpolated: discounted share plus back-off weight times the lower order's p.
    """
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        # continuation count: how many different symbols stand in front
        mask = (1 << (BITS * k)) - 1
        levels[k] = levels[k + 1].groupBy(F.col("g").bitwiseAND(F.lit(mask)).cast("int").alias("g")).agg(F.count("*").alias("n"))
    levels = {k: saved(x, f"kn-{k}") for k, x in levels.items()}
    lower, parts = None, []
    for k in range(1, ORDER + 1):
        t = levels[k]
        cc = {r["n"]: r["c"] for r in t.where("n <= 4").groupBy("n").agg(F.count("*").alias("c")).collect()}
        d = discounts([cc.get(j, 0) for j in (1, 2, 3, 4)])
        off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        t = t.withColumn("ctx", F.shiftright("g", BITS)).withColumn("d", off)
        sums = t.groupBy("ctx").agg(F.sum("n").alias("total"), F.sum("d").alias("left"))
        own = t.join(sums, "ctx").select("g", ((F.col("n") - F.col("d")) / F.col("total")).alias("share"), (F.col("left") / F.col("total")).alias("weight"))
        if lower is None:
            # below single symbols: all symbols alike
            own = own.select("g", (F.col("share") + F.col("weight") / (1 << BITS)).alias("p"))
        else:
            mask = (1 << (BITS * (k - 1))) - 1
            down = lower.select(F.col("g").alias("low"), F.col("p").alias("q"))
            own = own.join(down, F.col("g").bitwiseAND(F.lit(mask)).cast("int") == F.col("low")).select("g", (F.col("share") + F.col("weight") * F.col("q")).alias("p"))
        lower = saved(own, f"kn-p{k}")
        parts.append(lower.select("g", "p", F.lit(k).alias("order")))
        parts.append(sums.select(F.col("ctx").alias("g"), (F.col("left") / F.col("total")).alias("p"), F.lit(1 - k).alias("order")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from how many n-grams occur once, twice, three and four times."""
    if not n[0] or not n[1]:
        return 0.5, 0.75, 0.9
    y = n[0] / (n[0] + 2 * n[1])
    d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 2.0]
    return tuple(min(max(x, 0.05), j + 0.95) for j, x in enumerate(d))


@dataclass
class Model:
    """Natural logarithms of all probabilities of order ORDER, by context and symbol: 4 * 64**ORDER bytes, always."""

    rows: list[tuple[np.ndarray, np.ndarray, int]]

    def dense(self) -> np.ndarray:
        size = 1 << BITS
        by = {k: (g, p) for g, p, k in self.rows}
        p = np.full(size, 1.0 / size, np.float32)
        if 0 in by and len(by[0][1]):
            p *= by[0][1][0]
        g, q = by.get(1, (np.zeros(0, np.int64), np.zeros(0)))
        p[g] = q
        for k in range(2, ORDER + 1):
            weight = np.ones(1 << (BITS * (k - 1)), np.float32)
            g, w = by.get(1 - k, (np.zeros(0, np.int64), np.zeros(0)))
            weight[g] = w
            # context c of k - 1 symbols backs off to its last k - 2
            p = (weight.reshape(-1, len(p) // size, 1) * p.reshape(1, -1, size)).reshape(-1)
            g, q = by.get(k, (np.zeros(0, np.int64), np.zeros(0)))
            p[g] = q
        return np.log(np.maximum(p, 1e-12, out=p), out=p)


def train(trusted: DataFrame) -> Model | None:
    """The model of trusted documents' whole texts; None without any text."""
    counts = saved(gram_counts(trusted), "kn-counts")
    got = kneser_ney(counts).toArrow()  # bounded by the closed alphabet
    discard(counts)
    if not got.num_rows:
        return None
    order = got["order"].to_numpy()
    g, p = got["g"].to_numpy(), got["p"].to_numpy().astype(np.float32)
    return Model([(g[order == k].astype(np.int32), p[order == k], int(k)) for k in np.unique(order)])


# -- words ---------------------------------------------------------------------------------------------------------------


def tokens(text: str) -> list[str]:
    """Runs of letters and digits, and runs of other marks, as they are written."""
    return _TOKEN.findall(text)


def pack(*columns: np.ndarray) -> bytes:
    """Columns as bytes: each byte's place of a column together, so that what is alike or zero costs little."""
    import zstandard

    head = struct.pack("<B", len(columns)) + b"".join(struct.pack("<I2s", len(c), c.dtype.str[1:].encode()) for c in columns)
    return zstandard.compress(head + b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns), 1)


def unpack(raw: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.decompress(raw)
    at, out = 1 + 6 * raw[0], []
    for k in range(raw[0]):
        n, kind = struct.unpack_from("<I2s", raw, 1 + 6 * k)
        dtype = np.dtype("<" + kind.decode())
        planes = np.frombuffer(raw, np.uint8, n * dtype.itemsize, at).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype) if n else np.zeros(0, dtype))
        at += n * dtype.itemsize
    return out


def joined(packs: list[bytes], columns: int) -> list[np.ndarray]:
    got = [unpack(x) for x in packs if x is not None]
    return [np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.int64) for k in range(columns)]


def run_key(b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """One 64-bit key of a pair of words; a word alone is a pair with 0 before it."""
    return mixed(mixed(b.view(np.uint64)) + c.view(np.uint64)).view(np.int64)


def found_in(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands in the sorted ones, and whether it does."""
    if not len(known):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return at, known[at] == keys


@dataclass
class Places:
    """Which shard has a word, or a pair by one of its words: that word's home, or one of SPREAD from there on, chosen by the
    other word, if it is among the frequent ones."""

    shards: int
    frequent: np.ndarray

    def home(self, w: np.ndarray) -> np.ndarray:
        return (mixed(w.view(np.uint64)) % np.uint64(self.shards)).astype(np.int64)

    def of(self, w: np.ndarray, other: np.ndarray) -> np.ndarray:
        out = self.home(w)
        _, spread = found_in(w, self.frequent)
        out[spread] = (out[spread] + (mixed(other[spread].view(np.uint64)) % np.uint64(min(SPREAD, self.shards))).astype(np.int64)) % self.shards
        return out


def by_shard(shard: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Each shard's part of the columns, in their order."""
    if not len(shard):
        return
    order = np.argsort(shard, kind="stable")
    here, first = np.unique(shard[order], return_index=True)
    for k, at in zip(here.tolist(), np.split(order, first[1:]), strict=True):
        yield k, [c[at] for c in columns]


class Words(dict):
    """word -> (hash, log probability of its spelling and the blank behind it under the model of characters)"""

    def __init__(self, logp: np.ndarray):
        super().__init__({"": (END, float(logp[0]))})
        self.logp = logp

    def know(self, ws: set[str]) -> None:
        import xxhash

        if len(self) > MEMO:
            end = self[""]
            self.clear()
            self[""] = end
        new = [w for w in ws if w not in self]
        if not new:
            return
        gap = " " * (ORDER - 1)
        code = np.frombuffer((gap + gap.join(new) + gap).encode("utf-32-le", "replace"), "<u4")
        if not _TABLE:
            _TABLE.append(_table())
        lp = self.logp[grams(_TABLE[0][np.minimum(code, (1 << 16) - 1)])]
        # symbol k of the text is lp[k - ORDER + 1]; a word's part ends with one blank, the other blanks count for nothing
        size = np.array([len(w) for w in new])
        start = np.concatenate([[0], np.cumsum(size + ORDER - 1)[:-1]])
        cum = np.concatenate([[0.0], np.cumsum(lp, dtype=np.float64)])
        for w, x in zip(new, (cum[start + size + 1] - cum[start]).tolist(), strict=True):
            self[w] = (max(3, xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace")) >> WORD_SHIFT), x)

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the text's words between START and END, and base log probabilities of all but START."""
        ws = tokens(text)
        self.know(set(ws))
        got = [self[w] for w in ws]
        got.append(self[""])
        return np.array([START, *(x[0] for x in got)], np.int64), np.array([x[1] for x in got])


def _worded(it: Iterator[pa.RecordBatch], words: Words, column: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for whole in it:
        for b in batches(whole, 1_000_000):
            for t in texts_of(b.column(column)):
                if t and not t.isspace():
                    yield words.of(t)


class Spelling:
    """The model of characters as tasks get it; a worker makes one memory of words of it, whatever passes use it."""

    def __init__(self, spark: SparkSession, chars: Model):
        self.held = spark.sparkContext.broadcast(chars)  # what was observed; dense only in a worker
        self.number = self.held._jbroadcast.id() if self.held._jbroadcast is not None else id(self)

    def words(self) -> Words:
        return keep_one(("words", self.number), lambda: Words(self.held.value.dense()))

    def __getstate__(self) -> dict:
        return {"held": self.held, "number": self.number}


def frequent_words(docs: DataFrame, spelling: Spelling, shards: int) -> np.ndarray:
    """Words that would fill a quarter of a shard or more, of a sixteenth of the texts: this only decides where words are kept."""
    ship(docs.sparkSession)

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = spelling.words()
        for h, _ in _worded(it, words):
            w, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(n)], ["w", "n"])

    n = docs.where(F.pmod(F.xxhash64("text"), F.lit(16)) == 0).select("text").mapInArrow(rows, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    n = saved(n, "words-frequent")
    total = n.agg(F.sum("n")).first()[0] or 0
    got = n.where(F.col("n") * (4 * shards) > total).select("w").collect()  # at most 4 * shards words
    discard(n)
    return np.sort(np.array([r["w"] for r in got], np.int64))


_PARTS = "shard int, pairs binary, words binary, frequent array<struct<w:bigint,total:bigint,n1:bigint,n2:bigint,n3:bigint,base:double>>, hist array<bigint>"


def _shard_row(shard: int, pairs: bytes, words: bytes, frequent: list[dict], hist: np.ndarray) -> pa.Table:
    kind = pa.list_(pa.struct([("w", pa.int64()), ("total", pa.int64()), ("n1", pa.int64()), ("n2", pa.int64()), ("n3", pa.int64()), ("base", pa.float64())]))
    cols = [pa.array([shard], pa.int32()), pa.array([pairs], pa.binary()), pa.array([words], pa.binary()), pa.array([frequent], kind), pa.array([hist.tolist()], pa.list_(pa.int64()))]
    return pa.table(cols, names=["shard", "pairs", "words", "frequent", "hist"])


def grouped(w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """(w, first place, total, how many n are 1, 2 and more) of each run of equal words."""
    u, first = np.unique(w, return_index=True)
    if not len(u):
        return u, first, *[np.zeros(0, np.int64)] * 4
    return u, first, *(np.add.reduceat(x.astype(np.int64), first) for x in (n, n == 1, n == 2, n > 2))


def _counts_of(n: np.ndarray, written: np.ndarray) -> np.ndarray:
    """How many n are 1, 2, 3, 4, all of them; then how many of *written* lie from each power of two to the next."""
    first = [int((n == k).sum()) for k in (1, 2, 3, 4)] + [len(n)]
    return np.array(first + np.bincount(np.log2(np.maximum(written, 1)).astype(int), minlength=48)[:48].tolist(), np.int64)


def pair_counts(docs: DataFrame, spelling: Spelling, places: Places) -> DataFrame:
    """One row a shard: its pairs (b, c, n) in order of b, by b's place, and its words (w, base)."""
    ship(docs.sparkSession)

    def packed(h: list[np.ndarray], base: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        x = np.concatenate(h)
        lp = np.concatenate([y for b in base for y in ([0.0], b)])
        u, first, inv = np.unique(x, return_index=True, return_inverse=True)
        pair = (inv[:-1].astype(np.int64) * len(u) + inv[1:])[x[:-1] != END]
        pair, n = np.unique(pair, return_counts=True)
        b, c = u[pair // len(u)], u[pair % len(u)]
        words = dict(by_shard(places.home(u), u, lp[first].astype(np.float32)))
        pairs = dict(by_shard(places.of(b, c), b, c, n.astype(np.int64)))
        none = [np.zeros(0, np.int64)] * 3
        for k in sorted(words.keys() | pairs.keys()):
            p, w = pairs.get(k, none), words.get(k, [np.zeros(0, np.int64), np.zeros(0, np.float32)])
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pack(np.diff(p[0], prepend=0), p[1], p[2])], pa.binary()), pa.array([pack(*w)], pa.binary())], ["shard", "pairs", "words"])

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        words, h, base, size = spelling.words(), [], [], 0
        for x, lp in _worded(it, words):
            h.append(x)
            base.append(lp)
            size += len(x)
            if size >= FLUSH:
                yield from packed(h, base)
                h, base, size = [], [], 0
        if h:
            yield from packed(h, base)

    def one(key: tuple, t: pa.Table) -> pa.Table:
        keep_one("no words", lambda: None)
        parts = [unpack(x) for x in t["pairs"].to_pylist()]
        b, c, n = np.concatenate([np.cumsum(p[0]) for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        order = np.lexsort((c, b))
        b, c, n = b[order], c[order], n[order]
        new = np.concatenate([[True], (b[1:] != b[:-1]) | (c[1:] != c[:-1])]) if len(b) else np.zeros(0, bool)
        n = np.add.reduceat(n, np.flatnonzero(new)) if len(b) else n
        b, c = b[new], c[new]
        w, base = joined(t["words"].to_pylist(), 2)
        w, first = np.unique(w, return_index=True)
        u, _, total, n1, n2, n3 = grouped(b, n)
        _, here = found_in(u, places.frequent)
        frequent = [dict(zip(("w", "total", "n1", "n2", "n3"), x, strict=True), base=None) for x in zip(*(y[here].tolist() for y in (u, total, n1, n2, n3)), strict=True)]
        return _shard_row(key[0].as_py(), pack(np.diff(b, prepend=0), c, n), pack(w, base[first]), frequent, _counts_of(n, n))

    return docs.select("text").mapInArrow(rows, "shard int, pairs binary, words binary").groupBy("shard").applyInArrow(one, _PARTS)


def continuations(counts: DataFrame, d: tuple[float, float, float], places: Places) -> DataFrame:
    """One row a shard: its pairs (c, b, r, n) in order of c, by c's place, and its words (w, base, log weight, total).

    r is the pair's discounted share over the back-off weight of b: (n - d) over the sum of b's discounts."""
    frequent = counts.select(F.explode("frequent").alias("f")).groupBy("f.w").agg(*(F.sum(f"f.{k}").alias(k) for k in ("total", "n1", "n2", "n3"))).collect()  # at most 4 * shards words
    frequent = sorted((r["w"], r["total"], r["n1"], r["n2"], r["n3"]) for r in frequent)
    known = [np.array([r[k] for r in frequent], np.int64) for k in range(5)]
    off = np.array([0.0, *d])
    ship(counts.sparkSession)

    def go(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for shard, pairs, words in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                b, c, n = unpack(pairs)
                b = np.cumsum(b)
                u, first, total, *ns = grouped(b, n)
                at, here = found_in(u, known[0])
                total[here] = known[1][at[here]]
                for k in range(3):
                    ns[k][here] = known[2 + k][at[here]]
                left = sum(x * y for x, y in zip(ns, d, strict=True)) if len(u) else np.zeros(0)
                size = np.diff(np.append(first, len(b)))
                r = ((n - off[np.minimum(n, 3)]) / np.repeat(left, size)).astype(np.float32)
                # a frequent word's weight is told by its home, where it may have no pair
                at_home = places.home(known[0]) == shard
                u = np.concatenate([u[~here], known[0][at_home]])
                total = np.concatenate([total[~here], known[1][at_home]])
                left = np.concatenate([left[~here], sum(x[at_home] * y for x, y in zip(known[2:], d, strict=True))])
                weight = np.log(left / np.maximum(total, 1)).astype(np.float32)
                w, base = unpack(words)
                told = {k: x for k, x in by_shard(places.home(u), u, weight, total)}
                sent = {k: x for k, x in by_shard(places.of(c, b), c, b, r, n)}
                for k in sorted(told.keys() | sent.keys() | {shard}):
                    p = sent.get(k, [c[:0], b[:0], r[:0], n[:0]])
                    x = told.get(k, [u[:0], weight[:0], total[:0]])
                    v = (w, base) if k == shard else (w[:0], base[:0])
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pack(*p)], pa.binary()), pa.array([pack(*x)], pa.binary()), pa.array([pack(*v)], pa.binary())], ["shard", "pairs", "told", "words"])

    def one(key: tuple, t: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        c, b, r, n = joined(t["pairs"].to_pylist(), 4)
        order = np.lexsort((b, c))
        c, b, r, n = c[order], b[order], r[order], n[order]
        w, base = joined(t["words"].to_pylist(), 2)
        order = np.argsort(w)
        w, base = w[order], base[order].astype(np.float32)
        weight, total = np.zeros(len(w), np.float32), np.zeros(len(w), np.int64)
        tw, tweight, ttotal = joined(t["told"].to_pylist(), 3)
        at, ok = found_in(tw, w)
        weight[at[ok]], total[at[ok]] = tweight[ok], ttotal[ok]
        u, _, many, *_ = grouped(c, np.ones(len(c), np.int64))
        _, spread = found_in(u, places.frequent)
        seen = [{"w": x, "total": y, "n1": 0, "n2": 0, "n3": 0, "base": None} for x, y in zip(u[spread].tolist(), many[spread].tolist(), strict=True)]
        _, spread_home = found_in(w, places.frequent)
        seen += [{"w": x, "total": 0, "n1": 0, "n2": 0, "n3": 0, "base": y} for x, y in zip(w[spread_home].tolist(), base[spread_home].tolist(), strict=True)]
        return _shard_row(shard, pack(np.diff(c, prepend=0), b, r, n), pack(w, base, weight, total), seen, _counts_of(many[~spread], total))

    return counts.select("shard", "pairs", "words").mapInArrow(go, "shard int, pairs binary, told binary, words binary").groupBy("shard").applyInArrow(one, _PARTS)


@dataclass
class Scale:
    """What a shard needs besides its own rows to turn them into log probabilities."""

    d: tuple[float, float, float]
    total: int
    weight: float
    frequent: tuple[np.ndarray, np.ndarray, np.ndarray]


def shard_values(pairs: bytes, words: bytes, scale: Scale) -> tuple[np.ndarray, ...]:
    """(c, b, gain, n) of a shard's pairs and (w, value, total) of its words.

    The log probability of a text is a sum of independent terms: the spellings of its words, the log weight that each of them
    backs off to it with, a value for each word that the model has and a gain for each pair that it has.  A word's value is
    what it adds to its spelling, and its log weight as a context of what follows it."""
    c, b, r, n = unpack(pairs)
    c = np.cumsum(c)
    w, base, weight, total = unpack(words)
    off = np.array([0.0, *scale.d])

    def p(many: np.ndarray, spelling: np.ndarray) -> np.ndarray:
        return (many - off[np.minimum(many, 3)]) / scale.total + scale.weight * np.exp(spelling.astype(np.float64))

    u, first, many, *_ = grouped(c, np.ones(len(c), np.int64))
    at, ok = found_in(u, w)
    spelling = np.where(ok, base[at] if len(w) else 0.0, 0.0).astype(np.float64)
    fw, fmany, fbase = scale.frequent
    at, ok = found_in(u, fw)
    many[ok], spelling[ok] = fmany[at[ok]], fbase[at[ok]]
    gain = np.log1p(r.astype(np.float64) / np.repeat(p(many, spelling), np.diff(np.append(first, len(c)))))
    all_many = np.zeros(len(w), np.int64)
    at, ok = found_in(w, u)
    all_many[ok] = many[at[ok]]
    at, ok = found_in(w, fw)
    all_many[ok] = fmany[at[ok]]
    predicted = np.log(p(all_many, base)) - np.log(scale.weight) - base
    return c, b, gain, n, w, np.where(all_many > 0, predicted, 0.0) + weight, np.maximum(total, (w == END) * (1 << 40))


@dataclass
class WordModel:
    """What a task holds of the model of words, all of fixed size: the model of characters, the most frequent words and pairs,
    and a bitmap of the others' keys.  The others themselves stay in shards that grow with the corpus."""

    spelling: Spelling | None
    places: Places
    scale: Scale
    keys: np.ndarray
    values: np.ndarray
    bits: np.ndarray


def _sums(table: DataFrame) -> np.ndarray:
    got = table.select(F.posexplode("hist").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect()  # at most 53 rows
    out = np.zeros(53, np.int64)
    for r in got:
        out[r["k"]] = r["n"]
    return out


def train_words(trusted: DataFrame, held: int | None = None, shards: int | None = None, least: int = HELD_COUNT) -> tuple[WordModel, DataFrame] | None:
    """The model of trusted documents' whole texts, and its shards (shard, pairs, words).  At most *held* words and pairs, such
    that are written *least* times or more, are held by every task."""
    chars = train(trusted)
    if chars is None:
        return None
    spark = trusted.sparkSession
    ship(spark)
    if shards is None:
        size = trusted.agg(F.sum(F.length("text"))).first()[0] or 0
        shards = max(SHARDS, size // 5 // SHARD_WORDS)
    spelling = Spelling(spark, chars)
    places = Places(shards, frequent_words(trusted, spelling, shards))
    counts = saved(pair_counts(trusted, spelling, places), "words-counts")
    hist = _sums(counts)
    if not hist[4]:
        return None
    table = saved(continuations(counts, discounts(hist[:4].tolist()), places), "words-shards")
    discard(counts, release=True)
    frequent = table.select(F.explode("frequent").alias("f")).groupBy("f.w").agg(F.sum("f.total").alias("n"), F.max("f.base").alias("base")).collect()
    frequent = sorted((r["w"], r["n"], r["base"] or 0.0) for r in frequent)
    written = _sums(table)
    many = written[:5]
    more = np.array([r[1] for r in frequent], np.int64)
    for k in range(4):
        many[k] += (more == k + 1).sum()
    many[4] += (more > 0).sum()
    d = discounts(many[:4].tolist())
    left = many[0] * d[0] + many[1] * d[1] + (many[4] - many[0] - many[1]) * d[2]
    scale = Scale(d, int(hist[4]), float(left / hist[4]), (np.array([r[0] for r in frequent], np.int64), more, np.array([r[2] for r in frequent], np.float64)))
    room = HELD_RUNS if held is None else held
    while least < 1 << 40 and (hist + written)[5 + int(np.log2(least)) :].sum() > room:
        least *= 2

    def runs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for pairs, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c, b, gain, n, w, value, total = shard_values(pairs, words, scale)
                keys = np.concatenate([run_key(b, c), run_key(np.zeros(len(w), np.int64), w)])
                for at in range(0, len(keys), 100_000):
                    part = slice(at, at + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[part]), pa.array(np.concatenate([gain, value])[part].astype(np.float32)), pa.array(np.concatenate([n, total])[part])], ["key", "value", "n"])

    every = table.select("pairs", "words").mapInArrow(runs, "key long, value float, n long")
    if held == 0:
        least = 1 << 62
    got = every.where(F.col("n") >= least).select("key", "value").toArrow()  # bounded by HELD_RUNS
    keys, values = got["key"].to_numpy(), got["value"].to_numpy().astype(np.float64)
    order = np.argsort(keys)
    place = F.pmod("key", F.lit(TAIL_BITS)) + 1
    tail = every.where(F.col("n") < least).select(F.bitmap_bucket_number(place).alias("k"), F.bitmap_bit_position(place).alias("bit"))
    bits = np.zeros(TAIL_BITS // 8, np.uint8)
    for r in tail.groupBy("k").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        part = np.frombuffer(r["bits"], np.uint8)  # 16 MB in all
        bits[(r["k"] - 1) * len(part) : r["k"] * len(part)] = part
    return WordModel(spelling, places, scale, keys[order], values[order], bits), table


def fingerprint(text: str = "text") -> list[F.Column]:
    """Two independent hashes of the text: what a score belongs to."""
    return [F.when(F.col(text).isNotNull(), x).alias(name) for x, name in zip(text_hashes(text), ("_h1", "_h2"), strict=True)]


def text_scores(docs: DataFrame, model: WordModel, table: DataFrame) -> DataFrame:
    """(_h1, _h2, log_ppl) of each different text with words.

    A task adds up spellings and what it holds of a block of texts, and packs for each shard the other words and pairs that the
    bitmap lets pass, with the number of the text; the shard answers with sums by text, and these are put together by
    block.  A shard's rows are read one after the other behind the shard itself: a task holds one shard and one pack.
    """
    spark = docs.sparkSession
    ship(spark)
    spelling = model.spelling
    held = spark.sparkContext.broadcast(replace(model, spelling=None))  # a broadcast can't hold another
    names = ["shard", "block", "asked", "own"]

    def ask(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lean()
        m = held.value
        words = spelling.words()
        block = TaskContext.get().partitionId() << 32
        log_weight = float(np.log(m.scale.weight))
        seen: set[tuple[int, int]] = set()
        for whole in it:
            for batch in batches(whole, 1_000_000):
                h, ids, own = [], [], []
                for h1, h2, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), strict=True):
                    if not t or t.isspace() or (h1, h2) in seen:
                        continue
                    if len(seen) > MEMO:
                        seen.clear()
                    seen.add((h1, h2))
                    x, base = words.of(t)
                    h.append(x)
                    ids.append((h1, h2))
                    own.append((base.sum() + len(base) * log_weight, len(base)))
                if not ids:
                    continue
                block += 1
                x = np.concatenate(h)
                text = np.repeat(np.arange(len(h)), list(map(len, h)))
                inside = x[:-1] != END
                b = np.concatenate([x[:-1][inside], np.zeros(len(x), np.int64)])
                c = np.concatenate([x[1:][inside], x])
                text = np.concatenate([text[1:][inside], text])
                keys = run_key(b, c)
                at, hit = found_in(keys, m.keys)
                score = np.array([o[0] for o in own])
                score += np.bincount(text[hit], m.values[at[hit]], len(h)) if hit.any() else 0.0
                bit = keys & (TAIL_BITS - 1)
                ok = ~hit & ((m.bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1)
                b, c, text = b[ok], c[ok], text[ok]
                order = np.argsort(text, kind="stable")
                b, c, text, short = b[order], c[order], text[order], keys[ok][order].view(np.uint64) >> np.uint64(KEY_SHIFT)
                shard = np.where(b == 0, m.places.home(c), m.places.of(c, b))
                mine = pack(np.array([i[0] for i in ids], np.int64), np.array([i[1] for i in ids], np.int64), score, np.array([o[1] for o in own], np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([block % m.places.shards], pa.int32()), pa.array([block]), pa.array([None], pa.binary()), pa.array([mine], pa.binary())], names)
                for k, (asks, texts) in by_shard(shard, short, text):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([block]), pa.array([pack(asks, np.diff(texts, prepend=0))], pa.binary()), pa.array([None], pa.binary())], names)

    def answer(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        lean()
        keep_one("no words", lambda: None)  # the memory of words isn't needed any more
        none = np.zeros(0, np.uint64)
        keys, values, loaded = none, np.zeros(0), -1
        for batch in it:
            for shard, block, asked, own in zip(*(batch.column(k) for k in range(4)), strict=True):
                shard, block, asked, own = shard.as_py(), block.as_py(), asked.as_py(), own.as_py()
                if block < 0:
                    c, b, gain, _, w, value, _ = shard_values(asked, own, m.scale)
                    keys = np.concatenate([run_key(b, c), run_key(np.zeros(len(w), np.int64), w)]).view(np.uint64) >> np.uint64(KEY_SHIFT)
                    values = np.concatenate([gain, value]).astype(np.float32)
                    del c, b, gain, w, value
                    order = np.argsort(keys)
                    keys, values, loaded = keys[order], values[order], shard
                    continue
                sums = None
                if asked is not None:
                    asks, steps = unpack(asked)
                    at, hit = found_in(asks, keys if loaded == shard else none)
                    found, place = np.unique(np.cumsum(steps)[hit], return_inverse=True)
                    if not len(found):
                        continue
                    sums = pack(np.diff(found, prepend=0), np.bincount(place, values[at[hit]]).astype(np.float32))
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block]), pa.array([sums], pa.binary()), pa.array([own], pa.binary())], names)

    def together(key: tuple, t: pa.Table) -> pa.Table:
        h1, h2, score, n = unpack(next(x for x in t["own"].to_pylist() if x is not None))
        score = score.copy()
        for _, sums in sorted((s, x) for s, x in zip(t["shard"].to_pylist(), t["asked"].to_pylist(), strict=True) if x is not None):
            text, part = unpack(sums)
            score[np.cumsum(text)] += part
        return pa.table({"_h1": pa.array(h1), "_h2": pa.array(h2), "log_ppl": pa.array(-score / n)})

    kind = "shard int, block long, asked binary, own binary"
    asked = docs.select(*fingerprint(), "text").mapInArrow(ask, kind)
    shards = table.select("shard", F.lit(-1).cast("long").alias("block"), F.col("pairs").alias("asked"), F.col("words").alias("own"))
    met = shards.unionByName(asked).repartition(model.places.shards, "shard").sortWithinPartitions("shard", "block").mapInArrow(answer, kind)
    # a text that several tasks have read has the same score from each
    return met.groupBy("block").applyInArrow(together, "_h1 long, _h2 long, log_ppl double").groupBy("_h1", "_h2").agg(F.min("log_ppl").alias("log_ppl"))


def thresholds(held_out: DataFrame, quantile: float = QUANTILE, least: int = LEAST_DOCS) -> dict[str | None, float]:
    """Language -> greatest log perplexity that is kept; the key '' has that over all languages.

    Up to TAIL the quantile is the sample's.  A quantile beyond it is estimated from the tail above TAIL, as no sample of some
    hundred documents has a document at its 0.999 quantile: log perplexities above the threshold u of TAIL exceed it by b
    on average, and with an exponential tail (a Pareto tail of perplexity) the quantile q is u + b ln((1 - TAIL) / (1 - q)).
    The estimator is the same at every size.  Perplexities are counted in bins of a ten-thousandth, so that it is exact to
    that and the same in every run."""
    bins = held_out.where("log_ppl IS NOT NULL").groupBy("lang", F.ceil(F.col("log_ppl") * 10_000).alias("bin")).agg(F.count("*").alias("n"))
    both = bins.unionByName(bins.groupBy("bin").agg(F.sum("n").alias("n")).select(F.lit("").alias("lang"), "bin", "n"))
    from pyspark.sql import Window

    level = min(quantile, TAIL)
    w = Window.partitionBy("lang")
    cum = both.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    cum = cum.withColumn("u", F.min(F.when(F.col("upto") >= F.col("all") * level, F.col("bin"))).over(w))
    over = F.col("bin") > F.col("u")
    cut = cum.groupBy("lang").agg(F.first("u").alias("u"), F.first("all").alias("n"), F.sum(F.when(over, (F.col("bin") - F.col("u")) * F.col("n"))).alias("excess"), F.sum(F.when(over, F.col("n"))).alias("above"))
    further = float(np.log((1 - level) / (1 - quantile)))
    return {r["lang"]: (r["u"] + (r["excess"] / r["above"] * further if r["above"] else 0.0)) / 10_000 for r in cut.where((F.col("n") >= least) | (F.col("lang") == "")).collect()}


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, perplexity, threshold, keep) of every row.

    Trusted are documents that labels calls of quality 1 and not toxic.  A fifth of them, by crc32 of doc_id, sets the
    thresholds of each language; the others train.  Null and wordless texts have no perplexity and are not kept; where no
    trusted text exists everything else is kept.  A perplexity that equals the threshold is kept.  Repeated rows give repeated
    rows, of a repeated doc_id each row is judged by its own text; very long texts are read whole; an empty table gives none, and
    other columns aren't read.
    """
    own = docs.select("doc_id", "text", "lang")
    prepared = prepare(own, labels)
    if prepared is None:
        none = F.lit(None).cast("double")
        return own.select("doc_id", "lang", none.alias("perplexity"), none.alias("threshold"), (F.trim(F.coalesce("text", F.lit(""))) != "").alias("keep"))
    found, limit = prepared
    rows = own.select("doc_id", "lang", *fingerprint()).join(found, ["_h1", "_h2"], "left")
    keep = F.coalesce(F.col("log_ppl") <= F.coalesce(limit, F.col("log_ppl")), F.lit(False))
    return rows.select("doc_id", "lang", F.exp("log_ppl").alias("perplexity"), F.exp(limit).alias("threshold"), keep.alias("keep"))


def prepare(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> tuple[DataFrame, F.Column] | None:
    """(_h1, _h2, log_ppl) of all texts with words and, by the column lang, the greatest log perplexity that is kept (null where
    nothing sets one); None without trusted text."""
    good = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q = 1 AND t = 0").select("doc_id")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    train_on = saved(only(docs.where(fold != 0).select("doc_id", "text"), good.where(fold != 0), "doc_id").select("text"), "words-trusted")
    trained = train_words(train_on)
    discard(train_on, release=True)
    if trained is None:
        return None
    found = saved(text_scores(docs, *trained), "words-scores")
    discard(trained[1])
    held_out = docs.where(fold == 0).select("doc_id", "lang", *fingerprint()).join(good.where(fold == 0), "doc_id").join(found, ["_h1", "_h2"])
    cut = thresholds(held_out.select("lang", "log_ppl"), quantile)
    limit = F.lit(cut.pop("", None)).cast("double")
    for lang, x in cut.items():
        limit = F.when(F.col("lang").eqNullSafe(F.lit(lang)), F.lit(x)).otherwise(limit)
    return found, limit


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all their columns, that quality() keeps."""
    prepared = prepare(docs.select("doc_id", "text", "lang"), labels)
    if prepared is None:
        return docs.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    found, limit = prepared
    rows = docs.select(F.struct("*").alias("doc"), "lang", *fingerprint()).join(found, ["_h1", "_h2"])
    return rows.where(F.col("log_ppl") <= F.coalesce(limit, F.col("log_ppl"))).select("doc.*")
