"""Sums of feedback, and rankings by scores that are alike but for the last bits, against their SQL."""

import pytest

from larkspur.operators import recall
from larkspur.plans import catalog

#: Cosines of two atoms with the query, and the values of the events that bring both to scores alike but for the last bits.
ALIKE = [((0.204624, 201.73), (0.402774, 3.58)), ((0.397541, 3.58), (0.166601, 234.52)), ((0.200048, 32.33), (0.227728, 4.65))]


def both(spark, d, name, vectors, clicks):
    """Sorted rows of the query and of its SQL over these vectors, and clicks (event_id, value) of user 0."""
    import duckdb

    spark.createDataFrame([(k, v, 0) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([(k, 0, "click", v) for k, v in clicks], "event_id long, user_id long, event_type string, value double").write.parquet(f"{d}/events.parquet")
    c = duckdb.connect()
    for t in ("embeddings", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet/*.parquet')")
    df = catalog.QUERIES[name](spark, d)
    return sorted(map(tuple, df.collect())), sorted(c.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall())


def test_deltas_are_added_as_doubles_in_the_order_of_the_log(spark):
    log = [(k, f"k{k % 2}", k % 3, v / 1000) for k, v in enumerate([0.12, 1.12, 3.84, 0.1, 0.2, 0.3, -0.7, 1e9, 1e-9, -1e9, 0.01, 7.27] * 5)]
    want = {}
    for _, key, atom, delta in log:
        want[key, atom] = want.get((key, atom), 0.0) + delta
    t = spark.createDataFrame(log[::-1], "seq long, query_key string, atom_id int, delta double").repartition(7)
    assert {(r["query_key"], r["atom_id"]): r["delta"] for r in recall.adjustments(t).collect()} == want


def test_a_delta_of_one_event_stays_as_it_is(spark):
    log = [("k", k, k / 100 / 1000) for k in range(1, 500)]
    t = spark.createDataFrame(log, "query_key string, atom_id int, delta double")
    assert sorted(map(tuple, recall.adjustments(t).collect())) == log


@pytest.mark.parametrize("name", ["feedback_rerank", "index_feedback"])
@pytest.mark.parametrize("alike", ALIKE)
def test_scores_that_are_alike_rank_as_in_the_sql(spark, tmp_path, name, alike):
    got, want = both(spark, str(tmp_path), name, [[1.0, 0.0]] + [[s, (1 - s * s) ** 0.5] for s, _ in alike], [(k, v) for k, (_, v) in enumerate(alike, 1)])
    assert len(want) >= 9 and got == want


@pytest.mark.parametrize("name", ["feedback_rerank", "index_feedback"])
def test_a_missing_vector_is_no_query_and_no_result(spark, tmp_path, name):
    got, want = both(spark, str(tmp_path), name, [[1.0, 0.0], None, [0.6, 0.8], [0.8, 0.6]], [(1, 900.0), (2, 300.0)])
    assert len(want) >= 9 and got == want
