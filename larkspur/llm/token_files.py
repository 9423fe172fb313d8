"""Token ids in ORC files, in the order of doc_id, with row indexes and Bloom filters on doc_id."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import batches, encoder, texts_of, vocabulary
from .common import ship, work_dir

#: GPT-style end of a document, appended to each.
END_ID = 2
ORC = {
    "orc.compress": "ZSTD",
    "orc.stripe.size": str(16 << 20),  # a stripe is the unit of parallel reads
    "orc.row.index.stride": "1000",  # documents between two entries of the row index
    "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
SCHEMA = "doc_id long, part int, place long, start_in_part long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, vocab: str | None = None, end_id: int = END_ID, partitions: int | None = None) -> None:
    """Encode whole texts and write them to ORC files at *path*, ascending by doc_id over files and inside each.

    Range partitioning by doc_id and a row's place in docs deals the texts out, so a hot source or group of copies spreads
    like any rows, and so do the rows of one doc_id, which stand in the order of docs over files and of their texts in
    each.  The place is a number that needs no text, so that finding the ranges reads doc_ids only.
    Null text: only the end id.  A null doc_id comes first.  An empty table gives no documents.  A very long text is one
    row; other columns aren't read and may have any name.  Integer columns of ORC are run-length encoded by the writer;
    stripes, row index and Bloom filter follow ORC above.
    """
    ship(docs.sparkSession)
    vocab = vocab or vocabulary()

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, start, place = encoder(vocab), TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], "<u4").tobytes()
        for whole in it:
            for b in batches(whole, 8_000_000):
                got = enc.encode(texts_of(b.column(1)))
                n = np.array([len(x) // 4 + 1 for x in got], "<i8")
                upto = np.cumsum(n)
                ids = pa.Array.from_buffers(pa.int32(), int(upto[-1]), [None, pa.py_buffer(end.join([*got, b""]))])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], upto]), pa.int32()), ids)
                k = len(got)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([part] * k, pa.int32()), pa.array(np.arange(place, place + k)), pa.array(start + upto - n), pa.array(n), lists], ["doc_id", "part", "place", "start_in_part", "n_tokens", "ids"])
                start, place = start + int(upto[-1]), place + k

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("place"))
    dealt = own.repartitionByRange(partitions, "doc_id", "place") if partitions else own.repartitionByRange("doc_id", "place")
    dealt.sortWithinPartitions("doc_id", "text").select("doc_id", "text").mapInArrow(rows, SCHEMA).write.options(**ORC).orc(path)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, before): the ids in all files before that file; as many rows as there are files."""
    sums = spark.read.schema(SCHEMA).orc(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("before"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): start counts the ids of all documents before it, over all files.

    Files hold a running count of their own; what comes before a file is broadcast: one row of 12 bytes for each file, and
    a writer's tasks, so its files, are bounded by its partitions.
    """
    t = spark.read.schema(SCHEMA).orc(path)
    return t.join(F.broadcast(starts(spark, path)), "part").select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def token_digest(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from rows of read_tokens()."""

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            lists = b.column(3)
            at, ids = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False).view("<u4")
            crc = [zlib.crc32(ids[at[k] : at[k + 1]].tobytes()) for k in range(len(lists))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, vocab: str | None = None) -> DataFrame:
    """Write all documents' ids to ORC in the shared folder and report what reading the files back gives."""
    spark = docs.sparkSession
    path = work_dir(spark, "orc")
    write_tokens(docs, path, vocab)
    return token_digest(read_tokens(spark, path))
