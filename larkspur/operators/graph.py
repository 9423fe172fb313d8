"""Links that lead from each row to one other at most: where they end, and the cycles that some run into."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.snapshots import Folder, scratch


def _kept(df: DataFrame, tag: str, before: DataFrame | None = None) -> DataFrame:
    """df as a written table; the one that it was made from, if given, is removed."""
    spark, path = df.sparkSession, scratch(df.sparkSession, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = Folder(spark, path)
    if before is not None:
        before._folder.delete()
    return out


def ends(links: DataFrame) -> DataFrame:
    """links (id, up) as (id, root, depth, cycle, on_cycle, length).

    root is the id that following *up* ends in, depth the steps to it; up is null, or names no row, at an end.  Where the way
    runs into a cycle root and depth are null, cycle is the least id of that cycle, on_cycle whether the row is part of
    it, and length its number of rows.  Ids are unique and not null; an empty table gives no rows.

    Pointers are doubled: after r rounds they span 2**r steps, and ways to an end that are no longer are done.  While a longer
    one is left each round finishes some; once a round finishes none, all u rows left run into cycles, and 2**r >= u steps
    lead each of them onto its own.  Every row of a cycle is such a place, as a cycle is mapped onto itself.  The least id of a cycle is found by doubling too.  Each round is one join on a written table."""
    kind = dict(links.dtypes)["id"]
    known = links.select(F.col("id").alias("up"), F.lit(True).alias("_there"))
    t = links.select("id", "up").join(known, "up", "left").select("id", F.when(F.col("_there"), F.col("up")).alias("at"), F.when(F.col("_there"), 1).otherwise(0).cast("long").alias("steps"))
    # a row at its end points at itself, done
    t = _kept(t.select("id", F.coalesce("at", "id").alias("at"), "steps", F.col("at").isNull().alias("done")), "links")
    first, rounds, before = t, 0, None
    while True:
        left = t.where(~F.col("done")).count()
        if not left or (left == before and 2**rounds >= left):
            break
        before = left
        hop = t.select(F.col("id").alias("at"), F.col("at").alias("_to"), F.col("steps").alias("_more"), F.col("done").alias("_done"))
        going = t.where(~F.col("done")).join(hop, "at").select("id", F.col("_to").alias("at"), (F.col("steps") + F.col("_more")).alias("steps"), F.col("_done").alias("done"))
        t = _kept(t.where("done").unionByName(going), "links", t if rounds else None)
        rounds += 1
    none = F.lit(None)
    done = t.where("done").select("id", F.col("at").alias("root"), F.col("steps").alias("depth"), none.cast(kind).alias("cycle"), F.lit(False).alias("on_cycle"), none.cast("long").alias("length"))
    if not left:
        return done
    bound = t.where(~F.col("done")).select("id", "at")
    ring = bound.select(F.col("at").alias("id")).distinct()
    turn = _kept(first.join(ring, "id").select("id", "at", F.least("id", "at").alias("least")), "cycles")
    n, spanned = ring.count(), 1
    while spanned < n:
        hop = turn.select(F.col("id").alias("at"), F.col("at").alias("_to"), F.col("least").alias("_least"))
        new = turn.join(hop, "at").select("id", F.col("_to").alias("at"), F.least("least", "_least").alias("least"))
        turn = _kept(new, "cycles", turn)
        spanned *= 2
    size = turn.groupBy("least").agg(F.count("*").alias("length"))
    ring = turn.select("id", "least").join(size, "least")
    into = bound.join(ring.select(F.col("id").alias("at"), F.col("least").alias("cycle"), "length"), "at")
    into = into.join(ring.select("id", F.lit(True).alias("_on")), "id", "left")
    return done.unionByName(into.select("id", none.cast(kind).alias("root"), none.cast("long").alias("depth"), "cycle", F.coalesce("_on", F.lit(False)).alias("on_cycle"), "length"))
