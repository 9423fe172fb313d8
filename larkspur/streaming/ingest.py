"""Streaming ingest of ledger events: exactly once by event id, and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ledger import append_status
from ..operators.projection import Projection

#: Scopes of a batch that are named in the filter on the ledger.
MAX_SCOPES = 1_000
EVENT = "scope string, seq long, event_id string, kind string, payload string, recorded_at timestamp"


def events(spark: SparkSession, path: str, schema: str = EVENT, per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", per_trigger) if per_trigger else r).json(path)


def append_once(stream: DataFrame, ledger_path: str, conflict_path: str, checkpoint: str) -> StreamingQuery:
    """Append events that are new to the ledger; an id with another payload goes to *conflict_path*.

    A batch that is run again finds its own rows stored and appends nothing, so each event is stored once; its conflicts
    stand in a folder of the batch, which running it again replaces.  Only the scopes of a batch are read from the ledger,
    which is kept by scope."""

    def batch(df: DataFrame, number: int) -> None:
        append_batch(df, number, ledger_path, conflict_path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_batch(df: DataFrame, number: int, ledger_path: str, conflict_path: str) -> None:
    """One batch of append_once()."""
    spark = df.sparkSession
    schema = df.schema
    try:
        stored = spark.read.schema(schema).parquet(ledger_path)
        scopes = [r["scope"] for r in df.select("scope").distinct().limit(MAX_SCOPES + 1).collect()]
        if len(scopes) <= MAX_SCOPES:
            stored = stored.where(F.col("scope").isin(scopes))  # prunes partitions; many scopes are left to the join
        stored.limit(1).count()
    except Exception as e:  # the ledger doesn't exist before its first batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = spark.createDataFrame([], schema)
    # of a batch's own repeats the first counts
    first = df.groupBy("scope", "event_id").agg(F.min_by(F.struct(*df.columns), "seq").alias("r")).select("r.*")
    again = df.join(first.select("scope", "event_id", F.col("payload").alias("_p")), ["scope", "event_id"]).where("payload <> _p").drop("_p")
    marked = append_status(first, stored)
    marked.where("status = 'CONFLICT'").drop("status").unionByName(again).write.mode("overwrite").parquet(f"{conflict_path}/batch={number}")
    marked.where("status = 'APPENDED'").drop("status").select(*df.columns).write.mode("append").partitionBy("scope").parquet(ledger_path)


def maintain(stream: DataFrame, ledger_path: str, conflict_path: str, projection_root: str, checkpoint: str) -> StreamingQuery:
    """append_once(), and after each batch the projection of the ledger is brought up to it.

    The projection takes what it doesn't cover yet from the ledger, not from the batch: a batch that is run again finds its
    rows stored and covered, and one that died between the two is caught up with by the next."""

    def batch(df: DataFrame, number: int) -> None:
        append_batch(df, number, ledger_path, conflict_path)
        spark = df.sparkSession
        Projection(spark, projection_root).advance(spark.read.schema(df.schema).parquet(ledger_path))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(scope, kind, window, n) under a watermark."""
    return stream.withWatermark("recorded_at", late).groupBy("scope", "kind", F.window("recorded_at", window)).agg(F.count("*").alias("n"))
