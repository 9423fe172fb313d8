"""Shared plumbing of the training-data operators: work folders, shipping code, connected components."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Hashable, Iterable, Iterator
from itertools import chain, islice
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's default for spark.checkpoint.dir: reported by the session even where nobody set it.
_UNSET = {None, "", "/tmp/checkpoints"}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_larkspur_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    with tempfile.NamedTemporaryFile(prefix="larkspur-", suffix=".zip", delete=False) as f:
        with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            for d, _, names in os.walk(os.path.join(top, "larkspur")):
                for n in names:
                    if n.endswith(".py"):
                        p = os.path.join(d, n)
                        z.write(p, os.path.relpath(p, top))
    sc.addPyFile(f.name)
    sc._larkspur_shipped = True


_LEAN: list[bool] = []


def lean() -> None:
    """From now on this worker gives blocks of a megabyte and more back to the system as soon as they are freed: workers live
    on from stage to stage, and by default keep what the largest one needed."""
    if not _LEAN:
        _LEAN.append(True)
        if mallopt := getattr(ctypes.CDLL(None), "mallopt", None):
            mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
            mallopt(-1, 1 << 22)  # M_TRIM_THRESHOLD


_KEPT: dict[Hashable, Any] = {}


def keep_one(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a worker keeps from task to task: one object at a time.  Workers outlive queries and stages, so the caches of
    several operators would add up; the one before goes when another is asked for, and its memory is given back."""
    if key not in _KEPT:
        _KEPT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)
        _KEPT[key] = make()
    return _KEPT[key]


def work_dir(spark: SparkSession, tag: str) -> str:
    """A new folder name under the shared folder of spark.checkpoint.dir.

    Where the setting names none the session's warehouse folder is used, on one machine only: on a cluster executors need
    not see it, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base in _UNSET:
        base = spark.sparkContext._conf.get("spark.checkpoint.dir", None)
    if base in _UNSET:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/larkspur-work"
    return f"{base.rstrip('/')}/larkspur-{tag}-{uuid.uuid4().hex}"


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, and lost executors cost one stage at most."""
    path = work_dir(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._larkspur_path = path
    return out


def discard(df: DataFrame, release: bool = False) -> None:
    """Remove what saved() wrote.  Call it only when nothing reads df any more.

    Shuffle files of ended jobs go when the driver collects its garbage; with *release* it is asked to, as a chain of large
    jobs would otherwise keep the files of all its steps."""
    path = getattr(df, "_larkspur_path", None)
    if path:
        spark = df.sparkSession
        if release:
            gc.collect()
            spark.sparkContext._jvm.System.gc()
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def in_blocks(parts: Iterable[DataFrame], tag: str, block: int = 32) -> Iterator[DataFrame]:
    """The parts themselves where they fit one block; of more, the saved union of each block, so that no plan has them all."""
    parts = iter(parts)
    held = list(islice(parts, block))
    more = next(parts, None)
    if more is None:
        yield from held
        return
    parts = chain([more], parts)
    while held:
        whole = held[0]
        for x in held[1:]:
            whole = whole.unionByName(x)
        yield saved(whole, tag)
        held = list(islice(parts, block))


def components(edges: DataFrame, tag: str, rounds: int = 100) -> DataFrame:
    """Connected components of undirected edges (a long, b long): rows (id long, component long, the smallest id reached).

    Rounds of contraction.  In a round every node that still has edges hooks to its smallest neighbour or stays a root where
    it is the least of them, chains of hooks are followed to their root by pointer jumping, and edges are carried over to
    roots.  A root that nothing hooked to has smaller neighbours only in the next round, and is no root then; so two rounds
    at least halve the nodes that have edges, whatever the shape of the graph, and 100 rounds do for 2**50 nodes.  Each step
    is joins and a min() that combines before the shuffle, written to the shared folder; neither edges nor labels reach the
    driver.
    *rounds* is only a guard and raises when passed.
    """
    left = saved(edges.select("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{tag}-edges")
    labels = None
    for _ in range(rounds):
        if left.limit(1).count() == 0:
            if labels is None:
                labels = saved(left.select(F.col("a").alias("id"), F.col("b").alias("component")), f"{tag}-labels")
            discard(left)
            return labels
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = _roots(saved(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")), f"{tag}-hooks"), tag, rounds)
        root = lambda name: up.select(F.col("id").alias(name), F.col("component").alias(f"root_{name}"))  # noqa: B023, E731
        carried = left.join(root("a"), "a").join(root("b"), "b").where("root_a <> root_b")
        nxt = saved(carried.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(), f"{tag}-edges")
        discard(left)
        left = nxt
        if labels is None:
            labels = up
        else:
            # what earlier rounds found hangs below the roots that are hooked now
            over = up.select(F.col("id").alias("component"), F.col("component").alias("c"))
            new = saved(labels.join(over, "component", "left").select("id", F.coalesce("c", "component").alias("component")), f"{tag}-labels")
            discard(labels)
            discard(up)
            labels = new
    raise RuntimeError("components did not settle")


def _roots(up: DataFrame, tag: str, rounds: int) -> DataFrame:
    """Pointers (id, component), none of which goes up, followed to their end: each round doubles what a pointer spans."""
    for _ in range(rounds):
        over = up.select(F.col("id").alias("component"), F.col("component").alias("c"))
        new = saved(up.join(over, "component").select("id", F.col("c").alias("component"), (F.col("c") != F.col("component")).alias("moved")), f"{tag}-hooks")
        done = new.where("moved").limit(1).count() == 0
        discard(up)
        up = new.drop("moved")
        up._larkspur_path = new._larkspur_path
        if done:
            return up
    raise RuntimeError("pointers did not settle")


#: Bits of the bitmap that only() broadcasts: 8 MB, whatever the number of keys.
BITMAP_BITS = 1 << 26


def only(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among *keys*, a left semi-join that deals out few of the others.

    Keys are hashed into a bitmap of fixed size, summed up by task and broadcast.  Rows whose bit isn't set stop where they
    are read; what passes, wanted rows and a few by chance, goes through the exact join.  With so many keys that all bits
    are set the bitmap stops nothing, and the join alone decides.
    """
    h = F.pmod(F.xxhash64(key), F.lit(BITMAP_BITS)) + 1
    bits = keys.select(F.bitmap_bucket_number(h).alias("_bucket"), F.bitmap_bit_position(h).alias("_bit")).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    place = F.bitmap_bit_position(h)
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_place div 8 as int) + 1, 1)")), 16, 10).cast("int")
    near = rows.withColumn("_bucket", F.bitmap_bucket_number(h)).withColumn("_place", place).join(F.broadcast(bits), "_bucket")
    near = near.withColumn("_byte", byte).where(F.expr("(shiftright(_byte, cast(_place % 8 as int)) & 1) = 1"))
    # an inner join with distinct keys: a left semi-join would be moved below the bitmap
    return near.select(*rows.columns).join(keys.select(key).distinct(), key).select(*rows.columns)
