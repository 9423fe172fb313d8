"""Divergence of the sources of each language: which terms a source overuses, and how far sources are from each other.

Sort-based streaming.  Rows (lang, term, source, document) are dealt out by (lang, term) and sorted within partitions; a scan
over runs yields the document frequency of each term and its count in each source.  A second scan, over the kept terms only,
emits partial pairs of sources; terms are ranked by a window whose limit Spark applies before its shuffle.

Before they are dealt out, terms are summed up by task: documents are whole in a task, so what it sends for a term and a source
is one row with a number of documents, however common the term.  Only a document longer than a slice is sent in several rows,
which carry its number; the scan counts it once, as its rows lie next to each other.

Pairs.  f(p, q) of two sources without the term is the same for all such terms, and with the term in one of them only it
hangs on that source's p and the other's least p.  So

    sum over terms f(pA, pB) = V f(A0, B0) + sum over terms of A [f(pA, B0) - f(A0, B0)]
                             + sum over terms of B [f(A0, pB) - f(A0, B0)]
                             + sum over terms of both [f(pA, pB) - f(pA, B0) - f(A0, pB) + f(A0, B0)]

with A0, B0 the values of p at no occurrence.  The sums over one source are taken from its histogram of p, the last from runs;
a term costs the square of the sources that have it, not of all sources, and tasks hold sums by pair of sources.

All arithmetic is on integers: 64 bits, and 38 digits where counts are multiplied by the scale.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, ship

SCALE = 1_000_000_000
#: Bytes of text that are cut into terms at once.
SLICE = 1 << 20
#: Terms by source that a task sums up before it sends them.
HELD = 800_000
#: Pairs of occurrences that a task computes at once.
PAIRS = 1 << 19

#: Bytes of terms: letters, A-Z lower-cased, and all of characters beyond ASCII.  Others end a term.
_LETTERS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_SENT = "lang string, term binary, source string, document long, documents long, n long"
_COUNTS = "lang string, term binary, source string, n long, total long, first long"


def _slices(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, slice by slice; a slice ends between two terms."""
    text = text.translate(_LETTERS)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + SLICE) if len(text) - at > SLICE else -1
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _combine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to _SENT: sums by term and source, with document -1; slices of long documents apart."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    task, serial, size = TaskContext.get().partitionId(), 0, 0

    def sent(lang: str, source: str, counts: Counter, documents: Counter | None, document: int) -> Iterator[pa.RecordBatch]:
        terms, n = list(counts), list(counts.values())
        for i in range(0, len(terms), 20_000):
            part = terms[i : i + 20_000]
            k = len(part)
            yield pa.record_batch(
                [
                    pa.array([lang] * k, pa.string()),
                    pa.array(part, pa.binary()),
                    pa.array([source] * k, pa.string()),
                    pa.array(np.full(k, document)),
                    pa.array([documents[t] for t in part] if documents else np.zeros(k, np.int64), pa.int64()),
                    pa.array(n[i : i + 20_000], pa.int64()),
                ],
                ["lang", "term", "source", "document", "documents", "n"],
            )

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, documents) in held.items():
            yield from sent(lang, source, n, documents, -1)
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if len(text) > SLICE:
                serial += 1
                for terms in _slices(text):
                    yield from sent(lang, source, Counter(terms), None, task << 32 | serial)
                continue
            n, documents = held.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            terms = text.translate(_LETTERS).split()
            n.update(terms)
            documents.update(set(terms))
            size += len(n) - before
            if size >= HELD:
                yield from flush()
                size = 0
    yield from flush()


def _starts(table: pa.Table, names: list[str]) -> np.ndarray:
    """Whether a row begins a run of equal values in the named columns."""
    out = np.zeros(table.num_rows, bool)
    out[:1] = True
    for name in names:
        c = table.column(name).combine_chunks()
        out[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return out


def _runs(min_documents: int):
    """Sorted _SENT rows to _COUNTS rows of the terms in enough documents.  Of a run that goes on in the next batch a task
    holds sums by source."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.Table | None = None
        last: tuple | None = None  # the last row's place, as a long document may go on in the next batch

        def summed(t: pa.Table) -> pa.Table:
            at = np.flatnonzero(_starts(t, ["lang", "term", "source"]))
            add = lambda c: pa.array(np.add.reduceat(t.column(c).to_numpy(), at))
            keys = t.select(["lang", "term", "source"]).take(pa.array(at))
            return keys.append_column("documents", add("documents")).append_column("n", add("n"))

        def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
            if not t.num_rows:
                return
            new = _starts(t, ["lang", "term"])
            at = np.flatnonzero(new)
            run = np.cumsum(new) - 1
            documents, total = (np.add.reduceat(t.column(c).to_numpy(), at) for c in ("documents", "n"))
            out = t.drop_columns(["documents"]).append_column("total", pa.array(total[run])).append_column("first", pa.array(new.astype(np.int64)))
            yield from out.filter(pa.array(documents[run] >= min_documents)).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            document = t.column("document").to_numpy()
            new = _starts(t, ["lang", "term", "source", "document"])
            ends = lambda i, t=t: tuple(t.column(c)[i].as_py() for c in ("lang", "term", "source", "document"))
            new[0] = ends(0) != last
            last = ends(t.num_rows - 1)
            documents = t.column("documents").to_numpy() + (new & (document >= 0))
            t = t.select(["lang", "term", "source"]).append_column("documents", pa.array(documents)).append_column("n", t.column("n"))
            t = summed(t if carry is None else pa.concat_tables([carry, summed(t)]))
            open_at = int(np.flatnonzero(_starts(t, ["lang", "term"]))[-1])
            carry = t.slice(open_at)
            yield from done(t.slice(0, open_at))
        if carry is not None:
            yield from done(carry)

    return scan


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _meetings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (lang, term, g, p, least) to (a, b, value): what terms of both sources add to a pair, summed up by chunk."""

    def pairs(g: np.ndarray, p: np.ndarray, least: np.ndarray, new: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(new)
        sizes = np.diff(np.append(at, len(g)))
        begin, size = np.repeat(at, sizes), np.repeat(sizes, sizes)  # of each row's run
        cost = np.cumsum(size)
        lo = 0
        while lo < len(g):
            hi = max(lo + 1, int(np.searchsorted(cost, (cost[lo - 1] if lo else 0) + PAIRS, "right")))
            k = size[lo:hi]
            i = np.repeat(np.arange(lo, hi), k)
            j = np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(begin[lo:hi], k)
            i, j = i[i != j], j[i != j]
            lo = hi
            if not len(i):
                continue
            value = _f(p[i], p[j]) - _f(p[i], least[j]) - _f(least[i], p[j]) + _f(least[i], least[j])
            order = np.lexsort((g[j], g[i]))
            a, b = g[i][order], g[j][order]
            first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            yield pa.record_batch([pa.array(a[first]), pa.array(b[first]), pa.array(np.add.reduceat(value[order], first))], ["a", "b", "value"])

    carry: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if carry is None else pa.concat_tables([carry, t])
        new = _starts(t, ["lang", "term"])
        open_at = int(np.flatnonzero(new)[-1])
        carry = t.slice(open_at)
        yield from pairs(*(t.column(c).to_numpy()[:open_at] for c in ("g", "p", "least")), new[:open_at])
    if carry is not None:
        yield from pairs(*(carry.column(c).to_numpy() for c in ("g", "p", "least")), _starts(carry, ["lang", "term"]))


def _p(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE (n + 1) / (total + kept)); null where nothing is kept."""
    under = F.when(kept > 0, total + kept)
    wide = F.call_function("div", (n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), under.cast("decimal(20,0)"))
    return F.when(n < (1 << 63) // SCALE - 1, F.call_function("div", (n + 1) * SCALE, under)).otherwise(wide) + 1


def _f_of(p: str, q: str) -> Column:
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})")


def term_counts(docs: DataFrame, min_documents: int = 3, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """Counts of the terms found in at least *min_documents* documents of their language: lang, term binary, source, n long,
    total long (the language's), first long (1 on one row of a term, else 0).  Written to the shared folder."""
    ship(docs.sparkSession)
    rows = docs.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(to) for c, to in ((lang, "lang"), (source, "source"), (text, "text"))))
    sent = rows.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(_combine, _SENT)
    runs = _sorted(sent, "source", "document")
    return saved(runs.mapInArrow(_runs(min_documents), _COUNTS), "term-counts")


def _sorted(rows: DataFrame, *then: str) -> DataFrame:
    """rows dealt out by (lang, term) and sorted by it, then by *then*.  The hash of both goes first, so that most comparisons
    are of one number, not of strings that begin alike."""
    columns = rows.columns
    keyed = rows.withColumn("at", F.xxhash64("lang", "term"))
    return keyed.repartition("at").sortWithinPartitions("at", "lang", "term", *then).select(*columns)


def divergence(docs: DataFrame, min_documents: int = 3, top: int = 200, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """Rows lang, source, part ('pair' or 'term'), item, value long, rank int.

    For a source of a language, p of a kept term is 1 + floor(10^9 (n + 1) / (N + V)): n its occurrences, N the sum of n over
    the V kept terms of the language.  Pairs: each other source of the language with the sum of f(p, q) over all kept terms,
    q the other's p.  Terms: the *top* terms of the source with p > q, q being the language's p, by f.  f is
    floor((p - q)^2 / q).  Ranks go by value, then by item in UTF-8 order.

    Defined cases.  A null in lang, source or text is the empty string.  A document is a row; rows alike are documents of
    their own.  A group without kept terms, or without any, has pairs too; where a language keeps no term they are 0.  A
    language with one source has no pairs.  Texts are read whole, very long ones slice by slice.  An empty table gives an
    empty result.  Other columns are not read and may have any name.
    """
    counts = term_counts(docs, min_documents, lang, source, text)
    named = docs.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(to) for c, to in ((lang, "lang"), (source, "source")))).distinct()
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    kept = counts.groupBy("lang").agg(F.sum("first").alias("kept"), F.sum("n").alias("whole"))
    groups = named.join(sums, ["lang", "source"], "left").join(kept, "lang", "left").na.fill(0, ["own", "kept", "whole"])
    groups = groups.withColumn("least", _p(F.lit(0).cast("long"), F.col("own"), F.col("kept")))
    # a few rows as a rule; a written table, so that Spark broadcasts it by its size or joins by a shuffle
    groups = saved(groups.select(F.monotonically_increasing_id().alias("g"), "lang", "source", "own", "kept", "whole", "least"), "groups")

    priced = counts.join(groups, ["lang", "source"]).select(
        "lang",
        "term",
        "source",
        "g",
        "least",
        _p(F.col("n"), F.col("own"), F.col("kept")).alias("p"),
        _p(F.col("total"), F.col("whole"), F.col("kept")).alias("q"),
    )
    over = priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), _f_of("p", "q").alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = over.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

    # sums over the terms of one source, for each least p that another source of the language may have
    shape = priced.groupBy("lang", "g", "p", "least").agg(F.count(F.lit(1)).alias("n"))
    others = groups.where("kept > 0").select("lang", F.col("least").alias("x")).distinct()
    one = shape.join(others, "lang").groupBy("g", "x").agg(
        F.sum(F.col("n") * (_f_of("p", "x") - _f_of("least", "x"))).alias("before"),
        F.sum(F.col("n") * (_f_of("x", "p") - _f_of("x", "least"))).alias("after"),
    )
    one = saved(one, "one-source")
    runs = _sorted(priced.select("lang", "term", "g", "p", "least"))
    both = runs.mapInArrow(_meetings, "a long, b long, value long").groupBy("a", "b").agg(F.sum("value").alias("both"))

    side = lambda s: groups.select("lang", *(F.col(c).alias(f"{c}_{s}") for c in ("g", "source", "least")), *(["kept"] if s == "a" else []))
    pairs = side("a").join(side("b"), "lang").where("g_a <> g_b")
    pairs = pairs.join(one.select(F.col("g").alias("g_a"), F.col("x").alias("least_b"), "before"), ["g_a", "least_b"], "left")
    pairs = pairs.join(one.select(F.col("g").alias("g_b"), F.col("x").alias("least_a"), "after"), ["g_b", "least_a"], "left")
    pairs = pairs.join(both.select(F.col("a").alias("g_a"), F.col("b").alias("g_b"), "both"), ["g_a", "g_b"], "left")
    value = F.expr("CASE WHEN kept = 0 THEN 0 ELSE kept * ((least_a - least_b) * (least_a - least_b) div least_b) + coalesce(before, 0) + coalesce(after, 0) + coalesce(both, 0) END")
    pairs = pairs.select("lang", F.col("source_a").alias("source"), F.lit("pair").alias("part"), F.col("source_b").alias("item"), value.cast("long").alias("value"))
    return pairs.withColumn("rank", F.row_number().over(by_value)).unionByName(terms)
