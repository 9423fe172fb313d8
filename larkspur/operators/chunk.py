"""Chunking of whole texts: sections, paragraphs, greedy packing to a byte limit, overlap."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """A line that is a heading, whole; bytes of a chunk with its overlap at most; bytes repeated from the chunk before at most."""

    max_bytes: int = 2_048
    overlap_bytes: int = 0
    heading: str = r"CHAPTER [IVXLC]+\."


def _paragraphs(text: str, policy: Policy) -> list[tuple[int, int, int]]:
    """(section, start, end) of runs of lines that aren't blank, without white space at either end."""
    heading = re.compile(policy.heading)
    out: list[tuple[int, int, int]] = []
    section, at, begin = 0, 0, None
    for line in text.split("\n"):
        is_heading = heading.fullmatch(line) is not None
        if begin is not None and (is_heading or not line.strip()):
            out.append((section, begin, at))
            begin = None
        section += is_heading
        if line.strip() and begin is None:
            begin = at
        at += len(line) + 1
    if begin is not None:
        out.append((section, begin, len(text)))
    trimmed = ((s, b + len(text[b:e]) - len(text[b:e].lstrip()), b + len(text[b:e].rstrip())) for s, b, e in out)
    return [(s, b, e) for s, b, e in trimmed if e > b]


#: White space at which nothing may be cut.
NO_BREAK = "\u00a0\u2007\u202f"
_CLUSTER = regex.compile(r"\X")


class Offsets:
    """Bytes (UTF-8) before each character of a text, and where its grapheme clusters begin."""

    def __init__(self, text: str):
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        self.text = text
        self.at = np.concatenate([[0], np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))])
        self._known: tuple[int, int, set[int]] = (0, 0, {0})

    def size(self, start: int, end: int) -> int:
        return int(self.at[end] - self.at[start])

    def fits(self, start: int, end: int, limit: int) -> int:
        """The last index up to *end* that is no more than *limit* bytes behind *start*."""
        return min(end, int(np.searchsorted(self.at, self.at[start] + limit, "right")) - 1)

    def reaches(self, end: int, limit: int) -> int:
        """The first index that is no more than *limit* bytes before *end*."""
        return int(np.searchsorted(self.at, self.at[end] - limit, "left"))

    def clusters(self, start: int, end: int) -> set[int]:
        """The cluster boundaries of a part that begins at one, and ends where a paragraph does."""
        lo, hi, found = self._known
        if not lo <= start <= end <= hi:
            self._known = lo, hi, found = start, end, {start, *(m.end() for m in _CLUSTER.finditer(self.text, start, end))}
        return found

    def breakable(self, k: int) -> bool:
        return self.text[k].isspace() and self.text[k] not in NO_BREAK

    def skip(self, k: int, end: int) -> int:
        while k < end and self.text[k].isspace():
            k += 1
        return k


def _pieces(o: Offsets, start: int, end: int, limit: int) -> list[tuple[int, int]]:
    """Parts of a paragraph that is too long.

    They are cut at the last white space that fits, is no no-break space and isn't followed by a mark that belongs to it;
    where there is none, between two grapheme clusters.  A cluster that is longer than the limit alone is an error."""
    out, bound = [], o.clusters(start, end)
    while o.size(start, end) > limit:
        fit = o.fits(start, end, limit)
        cut = next((k for k in range(fit, start, -1) if o.breakable(k) and o.skip(k, end) in bound), None)
        if cut is None:
            cut = next((k for k in range(fit, start, -1) if k in bound), None)
        if cut is None:
            raise ValueError(f"a grapheme cluster at byte {int(o.at[start])} is longer than {limit} bytes")
        out.append((start, start + len(o.text[start:cut].rstrip())))
        start = o.skip(cut, end)
    return [*out, (start, end)] if end > start else out


def split_text(text: str, policy: Policy) -> list[tuple[int, int, int]]:
    """(section, start, end) of chunks, in characters.

    Headings begin sections; blank lines end paragraphs; paragraphs of a section are packed until the next would pass the
    limit.  One that passes it alone is cut, and its parts are chunks of their own: the chunk before it is closed, and the
    one behind it begins anew.  A chunk after the first of its section begins at a word's start within the overlap before
    it; the limit holds with the overlap.  Nothing is cut inside a grapheme cluster; an error where one is too long."""
    limit = policy.max_bytes - policy.overlap_bytes
    o = Offsets(text)
    out: list[tuple[int, int, int]] = []
    current: tuple[int, int, int] | None = None
    for s, a, b in _paragraphs(text, policy):
        if current and current[0] == s and o.size(a, b) <= limit and o.size(current[1], b) <= limit:
            current = (s, current[1], b)
            continue
        if current:
            out.append(current)
        current = (s, a, b)
        if o.size(a, b) > limit:
            out += [(s, p, q) for p, q in _pieces(o, a, b, limit)]
            current = None
    if current:
        out.append(current)
    final = []
    for k, (s, a, b) in enumerate(out):
        if k and out[k - 1][0] == s and policy.overlap_bytes:
            first = out[k - 1][1]
            lo = max(first, o.reaches(a, policy.overlap_bytes))
            bound = o.clusters(first, a) if lo < a else set()
            a = next((p for p in range(lo, a) if p == first or (not text[p].isspace() and o.breakable(p - 1) and p in bound)), a)
        final.append((s, a, b))
    return final


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", policy: Policy = Policy()) -> DataFrame:
    """(key, ordinal, section, chunk_in_section, start, end, n_bytes, sha256, duplicate_of) of every whole text.

    A document with a grapheme cluster that no chunk can hold is an error that names it.  A document is chunked where it is
    read; equal chunks are marked with the first of them, found by a min() that
    combines before its shuffle."""
    kind = dict(docs.dtypes)[key]

    def go(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "ordinal", "section", "chunk_in_section", "start", "end", "n_bytes", "sha256"]
        for b in it:
            for k, t in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                rows, last, n = [], None, 0
                try:
                    split = split_text(t or "", policy)
                except ValueError as e:
                    raise ValueError(f"{key} {k.as_py()}: {e}") from e
                for o, (s, a, e) in enumerate(split):
                    n = n + 1 if s == last else 0
                    last = s
                    raw = t[a:e].encode()
                    rows.append((o, s, n, a, e, len(raw), hashlib.sha256(raw).hexdigest()))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(rows), b.schema.field(0).type), *(pa.array(c, pa.int32()) for c in cols[:3]), *(pa.array(c, pa.int64()) for c in cols[3:6]), pa.array(cols[6])], names)

    t = docs.select(key, text).mapInArrow(go, f"key {kind}, ordinal int, section int, chunk_in_section int, start long, end long, n_bytes long, sha256 string")
    first = t.groupBy("sha256").agg(F.min(F.struct("key", "ordinal")).alias("_f"))
    own = F.struct("key", "ordinal")
    return t.join(first, "sha256").withColumn("duplicate_of", F.when(F.col("_f") != own, F.concat_ws("#", F.col("_f.key").cast("string"), F.col("_f.ordinal").cast("string")))).drop("_f").withColumnRenamed("key", key)


def neighbours(chunk_rows: DataFrame, evidence: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks next to evidence chunks of the same text: an equi-join on the two ordinals beside it, not a band join."""
    near = evidence.select(key, F.explode(F.array(F.col("ordinal") - 1, F.col("ordinal") + 1)).alias("ordinal")).distinct()
    return chunk_rows.join(near, [key, "ordinal"], "left_semi")


