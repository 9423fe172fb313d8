"""Line dedup: lines that many documents share are dropped from all but the last of them.

Lines are exploded, normalised and hashed; distinct documents are counted for each hash; lines over the threshold are dropped
and what stays is put together by position.  Everything is built-in functions.

What is shuffled: for counting, one (hash, doc_id) for each line long enough; for dropping, the hash and position of those
lines, which meet the shared hashes in a join that Spark splits where a hash is hot (the shared ones are a written table, so
that both sides come straight from a shuffle, or the small side is broadcast by its file size); and each text once, as its
dropped positions come from other tasks.  A hash is two 64-bit xxHash values with different seeds.

No row needs a number of its own: whether a line goes hangs on its document's doc_id and its key only, so that rows alike in
doc_id and text share their dropped positions.  A doc_id that a third of the rows carry is spread by the hash of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: What is stripped from a line's ends: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """A line without blanks at its ends, A-Z lower-cased; other letters stay as they are."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), _UPPER, _LOWER)


def _hashes(name: str, value: Column) -> list[Column]:
    return [F.xxhash64(value).alias(f"{name}1"), F.xxhash64(F.lit(1), value).alias(f"{name}2")]


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_lines long (before dropping), n_dropped long, kept_text string.

    A text is split at \\n; keys of at least *min_chars* code points found in at least *min_docs* documents lose all their
    lines, except those in the largest doc_id that holds the key.

    Defined cases.  A null or empty text is one empty line, which is never long enough to go.  Where all lines go the kept
    text is empty.  A document is a doc_id: rows that repeat a doc_id count once for a key, and all of them keep its lines
    where they are the largest.  Rows without a doc_id count as one document, below all others, so that they keep no
    shared line.  A line that a document repeats goes, or stays, with all its repeats.  A very long text is one row as it
    was when read; its positions are one array, no longer than its lines.  An empty table gives an empty result.  Only
    *doc_id* and *text* are read: other columns may have any name.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", *_hashes("t", F.col("text")))
    lines = rows.select("doc_id", "t1", "t2", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    # a key is never longer than its line: most short lines stop before they are normalised
    lines = lines.where(F.length("line") >= min_chars).select("doc_id", "t1", "t2", "pos", line_key(F.col("line")).alias("key"))
    lines = lines.where(F.length("key") >= min_chars).select("doc_id", "t1", "t2", "pos", *_hashes("k", F.col("key")))

    holders = lines.select("k1", "k2", "doc_id").distinct()
    shared = holders.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= min_docs)
    shared = saved(shared.select("k1", "k2", "last"), "shared-lines")

    gone = lines.join(shared, ["k1", "k2"]).where(~F.col("doc_id").eqNullSafe(F.col("last")))
    gone = gone.groupBy(F.col("doc_id").alias("gone_id"), F.col("t1").alias("g1"), F.col("t2").alias("g2")).agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    met = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("t1") == F.col("g1")) & (F.col("t2") == F.col("g2")), "left")

    met = met.select("doc_id", "text", "gone", F.split("text", "\n").alias("lines"))
    met = met.select("doc_id", "text", "gone", "lines", F.concat(F.array(F.lit(-1)), "gone", F.array(F.size("lines"))).alias("cuts"))
    # between two dropped positions a run of lines stays: as much work as there are lines, however many go
    run = lambda i: F.slice("lines", F.get("cuts", i) + 2, F.get("cuts", i + 1) - F.get("cuts", i) - 1)
    kept = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size("gone")), run)), "\n")
    return met.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("kept_text"),
    )
