"""Properties with escapes, samples over appends, a stream that keeps its projection up."""

import datetime as dt
import json

from pyspark.sql import functions as F

from larkspur.operators import experience, projection
from larkspur.sources import segments
from larkspur.streaming import ingest

PROPERTIES = r"""# a comment
! another \
a = 1
b:2
  c   three words
d\ e = x\
    y\\
f = é\t|\q
g\=h\:i : =
last
a = 2
""".replace("\n", "\r\n", 3)


def test_properties(spark, tmp_path):
    (tmp_path / "p").write_bytes(PROPERTIES.encode())
    got = {r["key"]: r["value"] for r in segments.read_properties(spark, str(tmp_path / "p")).collect()}
    assert got == {"a": "2", "b": "2", "c": "three words", "d e": "xy\\", "f": "é\t|q", "g=h:i": "=", "last": ""}


def test_samples_are_ordered_over_appends(spark, tmp_path):
    path = str(tmp_path / "s")
    cols = "sample_id string, path string, transcript string, speaker string, condition string, task_type string, language string, source string"
    for k in range(3):
        segments.save_samples(spark.createDataFrame([(f"s{k}{j}", *[None] * 7) for j in range(4)], cols).repartition(2), path)
    t = segments.read_samples(spark, path)
    assert t.select("seq").distinct().count() == 12
    assert [r["sample_id"][1] for r in t.orderBy("seq").collect()] == [*"0" * 4, *"1" * 4, *"2" * 4]


def test_stream_keeps_the_projection_up(spark, tmp_path):
    schema = "scope string, seq long, event_id string, kind string, execution string, attempt string, summary string, solution string, lesson string, payload string, recorded_at timestamp"
    kinds = ["EXECUTION_STARTED", "ATTEMPT_FINISHED", "STAGE_RECORDED", "ATTEMPT_FINISHED"]
    records = []
    for seq in range(1, 25):
        kind = kinds[seq % 4]
        fin = kind == "ATTEMPT_FINISHED"
        records.append(("s", seq, f"e{seq}", kind, f"x{seq % 3}", "a" if kind != "EXECUTION_STARTED" else None, f"sum {seq}" if kind == "EXECUTION_STARTED" else None, f"sol {seq % 2}" if fin else None, None, f"p{seq}", dt.datetime(2024, 1, 1)))
    ledger, source = str(tmp_path / "ledger"), tmp_path / "in"
    source.mkdir()
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def put(name, rows):
        (source / name).write_text("".join(json.dumps(dict(zip(names, [*r[:-1], "2024-01-01T00:00:00Z"], strict=True))) + "\n" for r in rows))

    def go():
        s = ingest.events(spark, str(source), schema, 1)
        ingest.maintain(s, ledger, str(tmp_path / "conflicts"), str(tmp_path / "projection"), str(tmp_path / "checkpoint")).awaitTermination()

    put("1.json", records[:7])
    put("2.json", [*records[5:12], *records[14:16]])  # repeats, and a gap
    go()
    p = projection.Projection(spark, str(tmp_path / "projection"))
    assert [tuple(r) for r in p.covered().collect()] == [("s", 12)]
    put("3.json", records[12:20])
    put("4.json", records[20:])
    go()
    whole = spark.createDataFrame(records, schema)
    assert spark.read.parquet(ledger).count() == 24
    cols = ["scope", "seq", "entry", "atom_id", "execution", "attempt", "event_id", "text"]
    rows = lambda t: sorted(map(tuple, t.select(*cols).collect()), key=repr)
    assert rows(p.log().where("entry <> 'COVER'")) == rows(experience.projection_entries(whole))
    assert {r["status"] for r in p.status(whole.withColumn("scope", F.lit("s"))).collect()} == {"CURRENT"}
