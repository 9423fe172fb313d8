"""Digests of a ledger by blocks: a tree of SHA-256, of which new records change one path.

A block is the records of so many sequences; its digest is that of its lines '<seq>:<sha256 of the payload>' in order.  So many
blocks make a block of the next level, whose lines are '<number>:<digest>'; after LEVELS levels the root is left.  All groups
are bounded by the fan-out, so that a scope is as many tasks as it has blocks, and the digest at any cutoff needs the closed
blocks' digests and the records of the open one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.snapshots import Snapshots

#: Records of a block, and blocks of a block of the next level; levels above the records.
FAN, LEVELS = 4_096, 3
BLOCKS = "block long, n long, digest string"


def _hashed(place: str, line: Column) -> Column:
    """SHA-256 of a group's lines in the order of *place*."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(place), line.alias("line")))), lambda x: x["line"]), ""), 256)


def blocks(ledger: DataFrame, *scope: str, fan: int = FAN) -> DataFrame:
    """(scope, block, n, digest) of the records (seq from 1, payload)."""
    line = F.concat(F.col("seq").cast("string"), F.lit(":"), F.sha2("payload", 256), F.lit("\n"))
    number = F.floor((F.col("seq") - 1) / F.lit(fan)).cast("long").alias("block")
    return ledger.groupBy(*scope, number).agg(F.count("*").alias("n"), _hashed("seq", line).alias("digest"))


def root(blocks: DataFrame, *scope: str, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """(scope, n, digest) of all blocks; no row for a scope without records."""
    t = blocks
    for level in range(levels):
        line = F.concat(F.col("block").cast("string"), F.lit(":"), F.col("digest"), F.lit("\n"))
        number = (F.floor(F.col("block") / F.lit(fan)) if level < levels - 1 else F.lit(0)).cast("long").alias("block")
        t = t.select(*scope, "n", "digest", "block").withColumn("line", line).withColumn("up", number)
        t = t.groupBy(*scope, "up").agg(F.sum("n").alias("n"), _hashed("block", F.col("line")).alias("digest")).withColumnRenamed("up", "block")
    return t.select(*scope, "n", "digest")


class Chain:
    """Digests of the closed blocks of one scope's ledger, kept in a folder beside it.

    They are taken as they are as long as all files of the ledger that they came from are there unchanged, by path, length and
    time: records are appended as new files.  If a file changed or went, all blocks are worked out anew, so that a record that
    was changed changes the digest."""

    def __init__(self, spark: SparkSession, folder: str, fan: int = FAN):
        self.spark, self.fan, self.versions = spark, fan, Snapshots(spark, folder)

    def _files(self, ledger: DataFrame) -> set[tuple[str, int, int]]:
        jvm, out = self.spark._jvm, set()
        for name in ledger.inputFiles():
            path = jvm.org.apache.hadoop.fs.Path(name)
            s = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getFileStatus(path)
            out.add((name, s.getLen(), s.getModificationTime()))
        return out

    def closed(self, ledger: DataFrame) -> DataFrame:
        """BLOCKS rows of the ledger's closed blocks; those that aren't stored are worked out and stored."""
        now, path = self._files(ledger), self.versions.current()
        kept, n = None, 0
        if path and {tuple(r) for r in self.spark.read.parquet(f"{path}/files").collect()} <= now:
            kept = self.spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
            n = kept.count()
        rest = ledger.where(F.col("seq") > n * self.fan)
        head = rest.agg(F.max("seq")).first()[0] or 0
        if head // self.fan <= n and kept is not None:
            return kept
        new = blocks(rest.where(F.col("seq") <= head // self.fan * self.fan), fan=self.fan).select("block", "n", "digest")
        every = kept.unionByName(new) if kept is not None else new

        def write(to: str) -> None:
            every.write.parquet(f"{to}/blocks")
            self.spark.createDataFrame(sorted(now), "path string, size long, time long").write.parquet(f"{to}/files")

        return self.spark.read.schema(BLOCKS).parquet(f"{self.versions.build(write)}/blocks")

    def at(self, ledger: DataFrame, cutoff: int) -> str | None:
        """The digest of the records up to a sequence; None if there are none.  Of the ledger the records behind the last closed
        block are read, and those of blocks that aren't stored yet."""
        whole = cutoff // self.fan
        known = self.closed(ledger).where(F.col("block") < whole)
        open_ = blocks(ledger.where((F.col("seq") > whole * self.fan) & (F.col("seq") <= cutoff)), fan=self.fan)
        row = root(known.select("block", "n", "digest").unionByName(open_.select("block", "n", "digest")), fan=self.fan).first()
        return row["digest"] if row else None
