"""Indexes put together, counters of scans, vectors rebuilt aside."""

import pytest
from pyspark.sql import functions as F

from larkspur.functions import text
from larkspur.operators import index, recall

TEXTS = ["cache the lookups", "redis caching", "similarity search of vectors", "nearest neighbor", "read write path", "command query", "the the", "other words here", "paths and models"]


@pytest.fixture(scope="module")
def atoms(spark):
    return recall.atoms(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), "text", "doc_id").cache()


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_both_scans_agree_through_every_wrapper(spark, atoms):
    stored = recall.encoded(atoms, "atom_id", F.col("content"))
    queries = spark.createDataFrame([(1, "temporary lookup", "a"), (2, "similarity search", "b"), (3, "", "a"), (4, "words", "c")], "query_id int, text string, query_key string")
    first = atoms.where("content = 'nearest neighbor'").first()["atom_id"]
    feedback = spark.createDataFrame([("b", first, 0.7), ("a", first, -0.1)], "query_key string, atom_id string, delta double")
    arms = [index.Exact(stored, 6), index.Blocked(stored, 6, 2, 3)]
    plain = [rows(index.OfTexts(a).search(queries, 3)) for a in arms]
    assert plain[0] == plain[1] == rows(recall.recall(atoms, queries.select("query_id", "text"), 3, digits=6)) and {r[0] for r in plain[0]} <= {1, 2, 4}
    moved = [rows(index.OfTexts(index.WithFeedback(a, feedback)).search(queries, 3)) for a in arms]
    assert moved[0] == moved[1] != plain[0]
    assert (2, 1, first) in {r[:3] for r in moved[0]}


def test_counters_equal_a_plain_replay(spark, atoms):
    stored = recall.encoded(atoms, "atom_id", F.col("content"))
    queries = stored.select(F.col("atom_id").alias("query_id"), "vec")
    every = [r for r in recall.scan(stored, queries, len(TEXTS), None, 6).collect()]
    for arm in (index.Exact(stored, 6), index.Blocked(stored, 6, 2, 4)):
        result, n = arm.counted(queries, 2, 0.2)
        assert rows(result) == rows(arm.search(queries, 2, 0.2))
        assert n["scanned"] == len(TEXTS) ** 2 and n["offered"] == sum(r["score"] >= 0.2 for r in every)
        assert n["retained"] == result.count() <= n["kept"]


def test_rebuild_keeps_the_old_version_until_the_new_one_holds(spark, atoms, tmp_path, monkeypatch):
    store = index.VectorStore(spark, str(tmp_path / "v"))
    with pytest.raises(FileNotFoundError):
        store.load()
    store.rebuild(atoms)
    before = rows(store.load())
    assert len(before) == len(TEXTS) and len(before[0][1]) == index.vectors.DIMENSIONS
    real = recall.encoded
    calls = []

    def spoiled(*a, **b):  # what is written differs from what is verified
        calls.append(1)
        t = real(*a, **b)
        return t.withColumn("vec", F.transform("vec", lambda x: x * 2)) if len(calls) == 1 else t

    monkeypatch.setattr(recall, "encoded", spoiled)
    with pytest.raises(ValueError, match="differ"):
        store.rebuild(atoms, text.Lexicon(), 64)
    assert rows(store.load()) == before
    monkeypatch.setattr(recall, "encoded", real)
    store.rebuild(atoms, None, 64)
    assert len(rows(store.load())[0][1]) == 64
    assert store.versions.rollback() and rows(store.load()) == before
