"""The maintained projection: any split gives one state, a batch that was cut off is found and written anew, versions are whole."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from larkspur.operators import experience, projection
from larkspur.operators.prefix import Running, running
from larkspur.sources.snapshots import Snapshots

LEDGER = "scope string, seq long, event_id string, kind string, execution string, attempt string, summary string, solution string, lesson string, payload string"
COLUMNS = ["scope", "seq", "place", "entry", "atom_id", "execution", "attempt", "event_id", "text"]


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect() if columns else df.collect()), key=repr)


@pytest.fixture(scope="module")
def ledger(spark):
    rng, out = random.Random(3), []
    for scope in ("s", "t"):
        for seq in range(1, 41):
            x, a = f"x{rng.randrange(3)}", f"a{rng.randrange(2)}"
            kind = rng.choice(["EXECUTION_STARTED", "ATTEMPT_FINISHED", "ATTEMPT_FINISHED", "STAGE_RECORDED"])
            told = kind == "EXECUTION_STARTED"
            fin = kind == "ATTEMPT_FINISHED"
            out.append((scope, seq, f"{scope}{seq}", kind, f"{scope}-{x}", None if told else a, f"sum {rng.randrange(2)}" if told else None, f"sol {rng.randrange(2)}" if fin else None, "lesson" if fin and seq % 3 == 0 else None, f"p{scope}{seq}"))
    return spark.createDataFrame(out, LEDGER).cache()


def test_any_split_gives_the_whole(spark, ledger, tmp_path):
    want = rows(experience.projection_entries(ledger), "scope", "seq", "entry", "atom_id", "execution", "attempt", "event_id", "text")
    for i, cuts in enumerate([[40], [1, 2, 40], [7, 7, 23, 40]]):
        p = projection.Projection(spark, str(tmp_path / f"p{i}"))
        done = [p.advance(ledger.where(F.col("seq") <= k)) for k in cuts]
        assert done == [k not in cuts[:j] for j, k in enumerate(cuts)]
        log = p.log()
        assert rows(log.where("entry <> 'COVER'"), "scope", "seq", "entry", "atom_id", "execution", "attempt", "event_id", "text") == want
        assert log.where("entry = 'COVER'").count() == 80
        assert {tuple(r) for r in p.status(ledger).select("scope", "status").collect()} == {("s", "CURRENT"), ("t", "CURRENT")}


def test_gap_waits_and_cut_off_batch_is_found(spark, ledger, tmp_path):
    root = tmp_path / "p"
    p = projection.Projection(spark, str(root))
    assert {r["status"] for r in p.status(ledger).collect()} == {"MISSING"}
    p.advance(ledger.where("seq <= 10"))
    p.advance(ledger.where("seq <= 30 AND NOT (scope = 's' AND seq = 15)"))
    assert rows(p.covered()) == [("s", 14), ("t", 30)]
    current = p.versions.current()
    shutil.rmtree(f"{current}/covered/b2")  # as if the writer had died before the commit
    assert rows(p.covered()) == [("s", 10), ("t", 10)]
    assert {r["status"] for r in p.status(ledger.where("seq <= 10")).collect()} == {"STALE"}
    p.advance(ledger)
    assert rows(p.covered()) == [("s", 40), ("t", 40)]
    assert {r["status"] for r in p.status(ledger).collect()} == {"CURRENT"}
    changed = ledger.withColumn("payload", F.when(F.col("event_id") == "s3", "x").otherwise(F.col("payload")))
    assert rows(p.problems(changed)) == [("s", "DIFFERENT_LEDGER")]
    assert {("s", "BEYOND_LEDGER"), ("t", "BEYOND_LEDGER")} <= set(rows(p.problems(ledger.where("seq < 40"))))
    p.rebuild(changed)
    assert p.problems(changed).count() == 0 and p.versions.current() != current
    assert len(p.versions._at.names("versions")) == 1


def test_lost_rows_of_the_log(spark, ledger, tmp_path):
    p = projection.Projection(spark, str(tmp_path / "p"))
    p.advance(ledger)
    path = p.versions.current()
    whole = spark.read.schema(projection.LOG).parquet(f"{path}/log/b1").collect()
    kept = [r for r in whole if not (r["scope"] == "s" and r["entry"] == "COVER" and r["seq"] == 5)]
    spark.createDataFrame(kept, projection.LOG).write.mode("overwrite").parquet(f"{path}/log/b1")
    assert ("s", "COVER_MISSING") in rows(p.problems(ledger))


def test_framed_log_round_trip(spark, ledger, tmp_path):
    p = projection.Projection(spark, str(tmp_path / "p"))
    p.advance(ledger)
    lines = projection.framed_log(p.log())
    back = projection.read_framed_log(lines)
    assert back.where("finding IS NOT NULL").count() == 0
    assert back.where("entry = 'COVER'").count() == 80 and back.where("entry = 'HEADER'").count() == 2
    last = lines.where("scope = 's'").agg(F.max("line")).first()[0]
    cut = projection.read_framed_log(lines.where((F.col("scope") == "s") & (F.col("line") < last)))
    assert {r["finding"] for r in cut.collect()} <= {None, "UNCOVERED_TAIL"}
    swapped = projection.read_framed_log(lines.where(F.col("line") != 3))
    assert "COVER_OUT_OF_ORDER" in {r["finding"] for r in swapped.collect()} or swapped.where("finding IS NULL").count() > 0


def test_versions_survive_a_failure_at_every_step(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "v"))
    assert s.current() is None and s.rollback() is None
    first = s.build(lambda to: spark.range(3).write.parquet(to))

    def fail(*_):
        raise OSError("full")

    with pytest.raises(OSError):
        s.build(fail)
    with pytest.raises(OSError):
        s.build(lambda to: spark.range(5).write.parquet(to), check=fail)
    assert s.current() == first and spark.read.parquet(first).count() == 3
    real, s._at.write = s._at.write, fail
    with pytest.raises(OSError):
        s.build(lambda to: spark.range(5).write.parquet(to))
    s._at.write = real
    s._at.write("vcutoff", "published", "000000000005")  # a pointer without its line feed
    assert s.current() == first
    second = s.build(lambda to: spark.range(5).write.parquet(to))
    assert s.current() == second
    assert s.rollback() == first
    assert [f"v{n[1:]}" for n in s.prune()] == [second.rsplit("/", 1)[1]] and s.current() == first


@pytest.mark.parametrize("blocks", [1, 2, 7])
def test_running_values_over_blocks(spark, blocks):
    rng = random.Random(blocks)
    data = [("hot" if rng.random() < 0.8 else rng.choice(["a", None]), k // 2, k, rng.choice([None, rng.randrange(100)])) for k in range(300)]
    t = spark.createDataFrame(data, "g string, o long, id long, v long")
    got = running(t, ["g"], ["o", "id"], [Running("s", "sum", F.col("v")), Running("m", "max", F.col("v"), False), Running("l", "last", F.col("v"), False), Running("n", "sum", F.lit(1))], blocks)
    want, state = {}, {}
    for g, _, k, v in data:
        s, m, last, n = state.get(g, (None, None, None, 0))
        s2 = s if v is None else (s or 0) + v
        want[k] = (s2, m, last, n + 1)
        state[g] = (s2, m if v is None else max(v, m if m is not None else v), last if v is None else v, n + 1)
    assert {r["id"]: (r["s"], r["m"], r["l"], r["n"]) for r in got.collect()} == want
    assert set(got.columns) == {"g", "o", "id", "v", "s", "m", "l", "n"}
