"""Toxicity by compression distance: one zstandard dictionary trained on toxic text, one on ordinary text, compared by windows.

The dictionaries are the output of the library's trainer.  The ordinary one is trained on runs of eight words of ordinary
texts; the toxic one on what toxic texts have and ordinary ones lack: words and pairs of words that a likelihood-ratio test
finds in more different contexts of toxic texts than chance allows.  Both are loaded as plain content, so that neither
has letters of its own price, behind a carrier that both contain, so that even a short window becomes a compressed block.

A window is a word between blanks (a part of one, where a word is very long), or a pair of words that both stand in a
phrase of the toxic dictionary.  What the toxic dictionary saves against the ordinary one, in parts of the window's
length, is the window's evidence; a text has the evidence of its strongest window, turned into a score from 0 to 1 by a
threshold that is calibrated on the training rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .bpe import batches, texts_of
from .common import discard, keep_one, saved, ship

#: Labelled rows of either class that the dictionaries and the threshold are fitted to, at most (by hash of doc_id).
MAX_TRAINING_ROWS = 10_000
#: Bytes of a dictionary, and samples that the trainer gets for one (by their hash), each of that many words.
TOXIC_BYTES, ORDINARY_BYTES = 8_192, 112_640
SAMPLES, SAMPLE_WORDS = 40_000, 8
#: Selected windows that the toxic dictionary is trained on, and pairs of words that are tested, at most (the most frequent).
MAX_WINDOWS = 20_000
#: A window is selected if that many contexts have it at least, and its likelihood ratio (2 ln) passes the one that chance
#: reaches among as many windows as were tested, by this much.
LEAST_CONTEXTS, MARGIN = 3, 10.0
LEVEL = 19
CARRIER = b" carrier::window::0123456789 "
#: Stands before a dictionary's content, whose first bytes no match can reach.
PAD = bytes(range(16))
#: Windows whose evidence a worker keeps.
MEMO = 250_000
#: Longer words are compared by overlapping parts of this length.
PART = 32
STEEPNESS = 25.0
_NOT_WORD = re.compile(r"[^\w]+")


def words(text: str) -> list[str]:
    out = text.lower().split()
    if any(len(w) > 2 * PART for w in out):
        out = [p for w in out for p in ([w] if len(w) <= 2 * PART else [w[k : k + PART] for k in range(0, len(w), PART // 2)])]
    return out


def bare(word: str) -> str:
    return _NOT_WORD.sub("", word)


def bare_words(text: str) -> list[str]:
    return [x for w in words(text) if (x := bare(w))]


@dataclass
class Model:
    """Two dictionaries, the threshold, and the words of the toxic dictionary's phrases."""

    toxic: bytes
    ordinary: bytes
    threshold: float
    phrase_words: frozenset[str] = frozenset()


class Tags(dict):
    """word -> itself without marks if it is a phrase's, '' if it is marks only, else None"""

    def __init__(self, phrase_words: frozenset[str]):
        super().__init__()
        self.phrase_words = phrase_words

    def __missing__(self, word: str) -> str | None:
        if len(self) > MEMO:
            self.clear()
        w = bare(word)
        out = self[word] = w if not w or w in self.phrase_words else None
        return out


class Scorer(dict):
    """window -> evidence"""

    def __init__(self, model: Model):
        import zstandard as z

        def compressor(content: bytes) -> z.ZstdCompressor:
            d = z.ZstdCompressionDict(PAD + content + CARRIER, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            return z.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)

        self.toxic, self.ordinary = compressor(model.toxic).compress, compressor(model.ordinary).compress
        self.phrase_words = model.phrase_words
        self.tags = Tags(model.phrase_words)

    def __missing__(self, word: str) -> float:
        if len(self) > MEMO:
            self.clear()
        w = word if " " in word else bare(word)
        if w == word:
            framed = CARRIER + f" {w} ".encode()
            out = (len(self.ordinary(framed)) - len(self.toxic(framed))) / (len(framed) - len(CARRIER)) if w else -1.0
        else:
            out = self[w] if w else -1.0
        self[word] = out
        return out

    def evidence(self, text: str) -> float:
        ws = words(text)
        out = max(map(self.__getitem__, ws), default=-1.0)
        if self.phrase_words:
            # the words of phrases and, as None, all others; words without letters or digits don't count
            tags = [t for t in map(self.tags.__getitem__, ws) if t != ""]
            out = max([out, *(self[f"{a} {b}"] for a, b in zip(tags, tags[1:], strict=False) if a and b)])
        return out


def contexts(ws: list[str]) -> dict[str, int]:
    """Each word with one of its contexts, the least hash of what stands before and behind it: near copies of a text share
    most of them, so that a word counts by the places that it was written in, not by how often a text was copied."""
    import xxhash

    out: dict[str, int] = {}
    for before, w, behind in zip(["", *ws], ws, [*ws[1:], ""], strict=False):
        h = xxhash.xxh32_intdigest(f"{before} {behind}")
        if h < out.get(w, 1 << 32):
            out[w] = h
    return out


def pair_contexts(ws: list[str]) -> dict[str, int]:
    """The same for pairs of words."""
    import xxhash

    out: dict[str, int] = {}
    for k in range(len(ws) - 1):
        p = f"{ws[k]} {ws[k + 1]}"
        h = xxhash.xxh32_intdigest(f"{ws[k - 1] if k else ''} {ws[k + 2] if k + 2 < len(ws) else ''}")
        if h < out.get(p, 1 << 32):
            out[p] = h
    return out


def in_fold(doc_id: str = "doc_id") -> F.Column:
    """Is the row held out?"""
    return (F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0) & F.col(doc_id).isNotNull()


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> Model | None:
    """Fit to at most max_rows labelled rows of either class outside the held-out fold; None if a class has none.

    Rows of one doc_id count once, by the least of their texts.  What reaches the driver is bounded: the windows and samples
    that fill a dictionary, and a histogram of evidence."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for y in (1, 0)]
    chosen = F.broadcast(rows[0].unionByName(rows[1]))  # 2 * max_rows rows of 12 bytes
    own = docs.select("doc_id", "text").where("text IS NOT NULL").join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").cast("int").alias("toxic"))
    sample = saved(own.select("text", "toxic"), "toxic-sample")
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        discard(sample)
        return None
    seen = _windows(sample, lambda ws, y: [contexts(ws), pair_contexts(ws)] if y else [contexts(ws)]).distinct()
    counts = saved(seen.groupBy("w").agg(F.count_if(F.col("y") == 1).alias("a"), F.count_if(F.col("y") == 0).alias("b")), "toxic-counts")
    # pairs were counted in toxic texts only; those that may pass are counted in ordinary ones too
    pairs = counts.where((F.instr("w", " ") > 0) & (F.col("a") >= LEAST_CONTEXTS)).orderBy(F.desc("a"), "w").limit(MAX_WINDOWS).select("w", "a")
    asked = frozenset(r["w"] for r in pairs.select("w").collect())
    plain = _windows(sample.where("toxic = 0"), lambda ws, y: [{p: h for p, h in pair_contexts(ws).items() if p in asked}]).distinct().groupBy("w").agg(F.count("*").alias("b"))
    every = counts.where(F.instr("w", " ") == 0).unionByName(pairs.join(plain, "w", "left").select("w", "a", F.coalesce("b", F.lit(0)).alias("b")))
    tested = counts.count()
    p, q = F.col("a").cast("double"), F.col("b").cast("double")
    share = n[1] / (n[1] + n[0])
    term = lambda x, s: F.when(x > 0, x * F.log(x / ((p + q) * s))).otherwise(0.0)
    good = every.where((p >= LEAST_CONTEXTS) & (p > (p + q) * share)).where(2 * (term(p, share) + term(q, 1 - share)) > F.lit(2.0) * F.log(F.lit(float(max(tested, 1)))) + MARGIN)
    picked = [r["w"] for r in good.orderBy(F.desc("a"), "w").limit(MAX_WINDOWS).collect()]
    single = {w for w in picked if " " not in w}
    phrases = {w for w in picked if " " in w and not single & set(w.split(" "))}
    discard(counts)
    if not single and not phrases:
        discard(sample)
        return None
    kept = frozenset(single | phrases)

    def shown(ws: list[str]) -> list[str]:
        return [x for k, w in enumerate(ws) for x in (w, " ".join(ws[k : k + 2])) if x in kept]

    toxic = _samples(sample.where("toxic = 1"), shown)
    ordinary = _samples(sample.where("toxic = 0"), lambda ws: ws)
    model = Model(trained(toxic, TOXIC_BYTES), trained(ordinary, ORDINARY_BYTES), 0.0, frozenset(x for p in phrases for x in p.split(" ")))
    # the threshold that separates the classes best, in the middle of the gap
    bins = scored(sample, model, ["toxic"]).groupBy(F.round("evidence", 3).alias("e")).agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") == 0).alias("b")).collect()
    model.threshold = calibrated([(float(r["e"]), r["a"], r["b"]) for r in bins])
    discard(sample)
    return model


def _windows(sample: DataFrame, of) -> DataFrame:
    """(w, y, k): windows of each text with a context."""

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for b in batches(whole, 250_000):
                ws, ys, ks = [], [], []
                for t, y in zip(texts_of(b.column(0)), b.column(1).to_pylist(), strict=True):
                    for found in of(bare_words(t), y):
                        ws += found.keys()
                        ks += found.values()
                        ys += [y] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(ws, pa.string()), pa.array(ys, pa.int32()), pa.array(ks, pa.int64())], ["w", "y", "k"])

    return sample.select("text", "toxic").mapInArrow(rows, "w string, y int, k long")


def _samples(sample: DataFrame, shown) -> list[bytes]:
    """At most SAMPLES runs of SAMPLE_WORDS of what *shown* leaves of each text's words, the same in every run."""

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for b in batches(whole, 250_000):
                out = []
                for t in texts_of(b.column(0)):
                    ws = shown(bare_words(t))
                    out += [" ".join(ws[k : k + SAMPLE_WORDS]) for k in range(0, len(ws), SAMPLE_WORDS)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["s"])

    got = sample.select("text", "toxic").mapInArrow(rows, "s string").orderBy(F.xxhash64("s"), "s").limit(SAMPLES).collect()
    return [f" {r['s']} ".encode() for r in got]


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary that zstandard's trainer makes of the samples.  The trainer refuses too little text: fewer than 2,000
    samples are repeated, and what it still refuses is the dictionary itself, cut to its size."""
    import zstandard as z

    try:
        return z.train_dictionary(size, samples * (1 + 2_000 // max(1, len(samples))), level=LEVEL).as_bytes()
    except z.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def calibrated(bins: list[tuple[float, int, int]]) -> float:
    """The evidence between two bins at which the mean of both classes' accuracy is greatest."""
    bins = sorted(bins)
    pos, neg = sum(b[1] for b in bins), sum(b[2] for b in bins)
    below_pos = below_neg = 0
    best = (-1.0, 0.0)
    for k, (e, a, b) in enumerate(bins):
        below_pos, below_neg = below_pos + a, below_neg + b
        upper = bins[k + 1][0] if k + 1 < len(bins) else e + 0.1
        best = max(best, ((pos - below_pos) / max(pos, 1) + below_neg / max(neg, 1), (e + upper) / 2))
    return best[1]


def scored(docs: DataFrame, model: Model, keep: list[str], text: str = "text", name: str = "evidence") -> DataFrame:
    """The columns of keep, with *name* double, the evidence of the whole text."""
    ship(docs.sparkSession)
    own = docs.select(*keep, F.col(text).alias("_text"))
    schema = StructType([*own.schema.fields[:-1], StructField(name, DoubleType())])

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = keep_one(("toxicity", model.toxic, model.ordinary, model.phrase_words), lambda: Scorer(model))
        for whole in it:
            for b in batches(whole):
                e = pa.array([s.evidence(t) for t in texts_of(b.column(b.num_columns - 1))], pa.float64())
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], e], [*b.schema.names[:-1], name])

    return own.mapInArrow(rows, schema)


def toxicity(docs: DataFrame, labels: DataFrame, model: Model | None = None, fitted: bool = False) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every row of docs.

    Null, empty and wordless texts have evidence -1 and a score near 0.  Repeated rows give repeated rows.  Without
    labelled rows of both classes every score is 0; an empty table gives no rows.  Very long texts are scored whole, word by
    word, with a memo of bounded size.  Labels, lang, source and doc_id enter no score; other columns aren't read.
    """
    if model is None and not fitted:
        model = fit(docs, labels)
    own = docs.select("doc_id", "text")
    rows = scored(own, model, ["doc_id"]) if model else own.select("doc_id", F.lit(-1.0).alias("evidence"))
    score = 1 / (1 + F.exp(-STEEPNESS * (F.col("evidence") - model.threshold))) if model else F.lit(0.0)
    return rows.withColumn("score", score).select("doc_id", in_fold().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "evidence")
