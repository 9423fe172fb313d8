"""Indexes that can be put together: each finds the best atoms of queries, and some wrap another.

An index has search(queries, k, threshold) -> (query_id, rank, atom_id, score), a DataFrame transform: `Exact` scans vectors,
`Blocked` lets blocks of queries meet blocks of vectors, `WithFeedback` re-ranks what any index finds, `OfTexts` encodes
queries for any.  All give the same rows for the same vectors.  `VectorStore` keeps vectors in versions that are rebuilt aside.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..sources.snapshots import Snapshots, scratch
from . import recall
from .blocks import meet


class Index(Protocol):
    def search(self, queries: DataFrame, k: int, threshold: float | None = 0.0) -> DataFrame: ...


@dataclass(frozen=True)
class Exact:
    """A scan of stored (atom_id, vec); the queries, (query_id, vec), are broadcast as long as they are few."""

    stored: DataFrame
    digits: int | None = None

    def search(self, queries: DataFrame, k: int, threshold: float | None = 0.0) -> DataFrame:
        return recall.scan(self.stored, queries, k, threshold, self.digits)

    def counted(self, queries: DataFrame, k: int, threshold: float | None = 0.0) -> tuple[DataFrame, dict[str, int]]:
        """The same rows, and counters of the scan: see _counted()."""
        return _counted(self.stored, queries, k, threshold, self.digits, recall.QUERY_BLOCK, recall.VECTOR_BLOCK)


@dataclass(frozen=True)
class Blocked:
    """Blocks of queries meet blocks of vectors, for any number of queries."""

    stored: DataFrame
    digits: int | None = None
    query_block: int = recall.QUERY_BLOCK
    vector_block: int = recall.VECTOR_BLOCK

    def search(self, queries: DataFrame, k: int, threshold: float | None = 0.0) -> DataFrame:
        return recall.blocked(self.stored, queries, k, threshold, self.digits, "atom_id", self.query_block, self.vector_block)

    def counted(self, queries: DataFrame, k: int, threshold: float | None = 0.0) -> tuple[DataFrame, dict[str, int]]:
        return _counted(self.stored, queries, k, threshold, self.digits, self.query_block, self.vector_block)


@dataclass(frozen=True)
class WithFeedback:
    """What *inner* finds, re-ranked by the feedback of each query's key; queries have query_key besides.

    Only the pool * k best of a query can end among its k best, so that many are asked of the inner index, without a threshold."""

    inner: Index
    feedback: DataFrame
    pool: int = 4

    def search(self, queries: DataFrame, k: int, threshold: float | None = 0.0) -> DataFrame:
        found = self.inner.search(queries, self.pool * k, None).join(queries.select("query_id", "query_key"), "query_id")
        got = recall.rerank(found, recall.adjustments(self.feedback), k, -1e308 if threshold is None else threshold, self.pool)
        return got.select("query_id", "rank", "atom_id", "score")


@dataclass(frozen=True)
class OfTexts:
    """Queries (query_id, text and whatever *inner* needs besides), normalised and encoded; blank ones find nothing."""

    inner: Index
    lexicon: text.Lexicon | None = text.Lexicon()
    dimensions: int = vectors.DIMENSIONS

    def search(self, queries: DataFrame, k: int, threshold: float | None = 0.0) -> DataFrame:
        asked = queries.where(F.trim(text.normalized(F.col("text"), self.lexicon) if self.lexicon else F.col("text")) != "")
        vec = recall.encoded(asked, "query_id", F.col("text"), self.lexicon, self.dimensions)
        return self.inner.search(vec.join(asked.drop("text"), "query_id"), k, threshold)


def _counted(stored: DataFrame, queries: DataFrame, k: int, threshold: float | None, digits: int | None, query_block: int, vector_block: int) -> tuple[DataFrame, dict[str, int]]:
    """(rows of the search, counters): scanned, the vectors that queries were held against; offered, the atoms that passed the
    threshold; kept, the rows that left the tasks; retained, the rows of the result.

    Each task writes its rows and, as one more row, its counts, in one run.  What a table's commit takes in is the output of one
    attempt of each task, so that counts hold if tasks were tried again; accumulators would count those twice."""
    kinds = dict(stored.dtypes)["atom_id"], dict(queries.dtypes)["query_id"]
    schema = f"query_id {kinds[1]}, atom_id {kinds[0]}, score double, scanned long, offered long"

    def go(q: pa.Table, v: pa.Table) -> pa.Table:
        tally: dict[str, int] = {}
        t = recall._best(q, v, k, threshold, digits, "atom_id", tally)
        none = pa.nulls(t.num_rows, pa.int64())
        t = t.append_column("scanned", none).append_column("offered", none)
        counts = [pa.nulls(1, f.type) for f in t.schema][:3] + [pa.array([tally.get(c, 0)], pa.int64()) for c in ("scanned", "offered")]
        return pa.concat_tables([t, pa.table(counts, names=t.column_names)])

    out = meet(queries.select("query_id", "vec"), stored.select("atom_id", "vec"), [], F.col("query_id"), F.col("atom_id"), go, schema, query_block, vector_block)
    path = scratch(stored.sparkSession, "scan")
    out.write.parquet(path)
    t = stored.sparkSession.read.parquet(path)
    result = recall._ranked(t.where("scanned IS NULL").select("query_id", "atom_id", "score"), k, "atom_id", True)
    row = t.agg(F.coalesce(F.sum("scanned"), F.lit(0)).alias("scanned"), F.coalesce(F.sum("offered"), F.lit(0)).alias("offered"), F.count_if(F.col("scanned").isNull()).alias("kept")).first()
    return result, row.asDict() | {"retained": result.count()}


class VectorStore:
    """Vectors of atoms in versions: a rebuild after a change of the profile is written aside, verified and then published."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.versions = spark, Snapshots(spark, root)

    def load(self) -> DataFrame:
        path = self.versions.current()
        if path is None:
            raise FileNotFoundError("no version of the vectors was published")
        return self.spark.read.parquet(path)

    def rebuild(self, atoms: DataFrame, lexicon: text.Lexicon | None = text.Lexicon(), dimensions: int = vectors.DIMENSIONS) -> str:
        """Encode all atoms (atom_id, content, aliases if any) into a new version.  It is published if reading it back gives one
        vector of the dimensions for each atom, equal to what its text encodes to; else the version before stays."""

        def encode() -> DataFrame:
            aliases = F.col("aliases") if "aliases" in atoms.columns else None
            return recall.encoded(atoms, "atom_id", F.col("content"), lexicon, dimensions, aliases)

        def check(path: str) -> None:
            have = self.spark.read.parquet(path)
            met = have.withColumnRenamed("vec", "_have").join(encode(), "atom_id", "full")
            odd = met.where(F.col("vec").isNull() | F.col("_have").isNull() | (F.col("vec") != F.col("_have")) | (F.size("_have") != dimensions))
            if n := odd.count() + abs(have.count() - atoms.count()):
                raise ValueError(f"{n} vectors of the new version differ from their texts")

        return self.versions.build(lambda path: encode().write.parquet(path), check)
