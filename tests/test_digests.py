"""Digests by blocks: any cutoff, appended files, changed records, pages."""

import hashlib

import pytest
from pyspark.sql import functions as F

from larkspur.operators import digests, experience, recall


def plain(n, fan, levels=digests.LEVELS, payload=lambda k: f"p{k}"):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    level = {}
    for k in range(1, n + 1):
        level.setdefault((k - 1) // fan, []).append(f"{k}:{sha(payload(k))}\n")
    level = {b: sha("".join(x)) for b, x in level.items()}
    for i in range(levels):
        up = {}
        for b in sorted(level):
            up.setdefault(b // fan if i < levels - 1 else 0, []).append(f"{b}:{level[b]}\n")
        level = {b: sha("".join(x)) for b, x in up.items()}
    return level.get(0)


def rows(spark, a, b):
    return spark.range(a, b + 1).select(F.col("id").alias("seq"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("payload"), F.concat(F.lit("x"), (F.col("id") % 9).cast("string")).alias("execution"))


def test_chain_over_appends_and_changes(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows(spark, 1, 40).coalesce(1).write.parquet(path)
    chain = digests.Chain(spark, str(tmp_path / "chain"), 8)
    load = lambda: spark.read.parquet(path)
    for cutoff in (0, 1, 7, 8, 9, 40):
        assert chain.at(load(), cutoff) == plain(cutoff, 8)
    stored = chain.versions.current()
    assert spark.read.parquet(f"{stored}/blocks").count() == 5
    rows(spark, 41, 47).coalesce(1).write.mode("append").parquet(path)
    assert chain.at(load(), 47) == plain(47, 8) and chain.versions.current() == stored  # no block was closed
    rows(spark, 48, 70).coalesce(1).write.mode("append").parquet(path)
    assert chain.at(load(), 70) == plain(70, 8) and chain.at(load(), 33) == plain(33, 8)
    now = chain.versions.current()
    assert now != stored and spark.read.parquet(f"{now}/blocks").count() == 8
    page, cursor = experience.export_page(load(), 4, chain=chain)
    assert page.count() == 4
    assert experience.export_page(load(), 4, cursor, chain=chain)[0].count() == 4
    changed = load().withColumn("payload", F.when(F.col("seq") == 3, "other").otherwise(F.col("payload")))
    spark.createDataFrame(changed.collect(), changed.schema).write.mode("overwrite").parquet(path)
    with pytest.raises(ValueError, match="another history"):
        experience.export_page(load(), 4, cursor, chain=chain)
    with pytest.raises(ValueError, match="the last is 70"):
        experience.export_page(load(), 4, cutoff=71)


def test_ranks_count_what_is_better(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 5)).round(1).astype(np.float32)
    x[10] = x[11] = x[12]  # ties
    x[13] = 0
    ids = [f"a{k // 2}" if k < 20 else f"a{k}" for k in range(60)]  # several vectors an atom
    stored = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "atom_id string, vec array<float>")
    queries = spark.createDataFrame([(k, x[k].tolist()) for k in (0, 10, 12, 40)], "query_id int, vec array<float>")
    every = sorted(set(ids))
    wanted = queries.select("query_id", F.explode(F.array(*map(F.lit, [*every, "nobody"]))).alias("atom_id"))
    got = {(r["query_id"], r["atom_id"]): (r["rank"], r["score"]) for r in recall.ranks(stored, queries, wanted, 6, query_block=2, vector_block=7).collect()}
    full = recall.scan(stored, queries, len(every), None, 6).collect()
    assert len(got) == 4 * (len(every) + 1)
    for r in full:
        assert got[r["query_id"], r["atom_id"]] == (r["rank"], r["score"])
    assert all(got[q, "nobody"] == (None, None) for q in (0, 10, 12, 40))
