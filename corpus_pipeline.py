"""From raw documents to token ids: toxicity, quality, near-duplicates, source mix, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of docs.  Labels come from sf_dir.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm import bpe, dart_minhash, mixing, ngram_quality, toxicity
from larkspur.llm.common import work_dir


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.5.  One pass: the score is computed beside the document's columns.

    Null and empty texts stay, as nothing in them is toxic; repeated rows share one decision; without labelled rows of both
    classes, and of an empty table, all rows stay.  Other columns may have any name."""
    model = toxicity.fit(docs, _labels(spark, sf_dir))
    if model is None:
        return docs
    # columns go by their places, so that no name can clash
    rows = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    rows = toxicity.scored(rows, model, rows.columns, text=f"c{docs.columns.index('text')}")
    return rows.where(F.col("evidence") < model.threshold).drop("evidence").toDF(*docs.columns)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality operator keeps.

    Null, empty and wordless texts go; a perplexity that equals the threshold stays; repeated rows share one decision; where
    no trusted text exists every text with words stays; an empty table stays empty.  Other columns may have any name."""
    return ngram_quality.kept(docs, _labels(spark, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates: a text of the smallest doc_id.

    Rows without a doc_id or a text stay.  Rows of one doc_id with different texts are judged each by its own text; of rows
    with the same doc_id and text one stays.  Other columns may have any name; an empty table stays empty."""
    return dart_minhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: not at all, once or twice.

    The mix decides for rows, not doc_ids: rows alike in doc_id, source and text are taken as often, all together, as the mix
    takes all of them.  Null and empty texts have no words and may be taken or not; a null source is a source.  Other columns
    may have any name; an empty table stays empty."""
    named = [x for c in ("doc_id", "source", "text") for x in (F.col(c).isNull(), F.coalesce(F.col(c).cast("string"), F.lit("")))]
    key = F.xxhash64(*named)
    mixed = mixing.mix(docs.select(key.alias("row"), "source", "text"), key="row")
    taken = mixed.groupBy("row").agg(F.sum("copies").alias("total"), F.count("*").alias("alike"))
    # rows alike may differ in other columns: which of them is taken is the same in every run
    other = [F.col(f"`{c}`") for c, kind in docs.dtypes if c not in ("doc_id", "source", "text") and "map<" not in kind]
    rows = docs.select(F.struct("*").alias("doc"), key.alias("row"), (F.xxhash64(*other) if other else F.lit(0)).alias("other"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("row").orderBy("other")))
    copies = F.floor(F.col("total") / F.col("alike")) + F.when(F.col("place") <= F.col("total") % F.col("alike"), 1).otherwise(0)
    met = rows.join(taken, "row").withColumn("copies", copies).where("copies > 0")
    return met.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long")))).select("doc.*")


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each text's ids and of what they decode to, one row for every row: null is an empty text, rows taken twice
    are two rows, an empty table gives none, and other columns aren't read."""
    return bpe.bpe_round_trip(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_poor),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", to_tokens),
]

#: SQL can express neither trained models nor BPE: tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = work_dir(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
