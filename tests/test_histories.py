"""Projection, export, segment files and drivers on small fixtures."""

import os

import pytest
from pyspark.sql import functions as F

from larkspur.operators import experience, generate, judging, ledger
from larkspur.plans import drivers
from larkspur.sources import segments, stores

LEDGER = "scope string, seq long, event_id string, kind string, execution string, attempt string, summary string, solution string, lesson string, payload string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_projection_moves_with_corrections(spark):
    t = spark.createDataFrame(
        [
            ("s", 1, "e1", "EXECUTION_STARTED", "x", None, "sum", None, None, "p"),
            ("s", 2, "e2", "ATTEMPT_FINISHED", "x", "a", None, "one", None, "p"),
            ("s", 3, "e3", "ATTEMPT_FINISHED", "x", "b", None, "one", None, "p"),
            ("s", 4, "e4", "ATTEMPT_FINISHED", "x", "a", None, "two", "less", "p"),
            ("s", 5, "e5", "EXECUTION_STARTED", "x", None, "new", None, None, "p"),
            ("s", 6, "e6", "EXECUTION_STARTED", "x", None, "new", None, None, "p"),
        ],
        LEDGER,
    )
    e = experience.projection_entries(t)
    got = [(r.seq, r.entry, r.attempt, r.event_id, r.text) for r in e.orderBy("seq", "attempt", F.desc("entry")).collect()]
    assert got == [
        (2, "PROJECT", "a", "e2", "sum\none"),
        (3, "PROJECT", "b", "e3", "sum\none"),
        (4, "RETIRE", "a", "e2", "sum\none"),
        (4, "PROJECT", "a", "e4", "sum\ntwo\nless"),
        (5, "RETIRE", "a", "e4", "sum\ntwo\nless"),
        (5, "PROJECT", "a", "e4", "new\ntwo\nless"),
        (5, "RETIRE", "b", "e3", "sum\none"),
        (5, "PROJECT", "b", "e3", "new\none"),
    ]
    assert sorted(r.state for r in experience.atom_states(e).collect()) == ["LIVE", "LIVE", "RETIRED", "RETIRED"]
    assert {r.text for r in experience.pruned(e).collect()} == {"new\none", "new\ntwo\nless"}
    assert rows(ledger.verify_projection(experience.projected(e), experience.projected(e))) == []


def test_export_pages_keep_their_cutoff(spark):
    events = generate.executions(spark, 9, scopes=1).cache()
    seen, cursor, n = [], None, 0
    while True:
        page, cursor = experience.export_page(events, 4, cursor)
        seen += [r.execution for r in page.orderBy("start_seq").collect()]
        n += 1
        if cursor is None:
            break
    assert n == 3 and len(set(seen)) == 9 == len(seen)
    _, cursor = experience.export_page(events, 4)
    later = events.unionByName(events.limit(1).withColumn("seq", F.lit(999).cast("long")))
    assert rows(experience.export_page(later, 4, cursor)[0]) == rows(experience.export_page(events, 4, cursor)[0])
    with pytest.raises(ValueError, match="another history"):
        experience.export_page(events.withColumn("payload", F.lit("x")), 4, cursor)
    with pytest.raises(ValueError):
        experience.export_page(events, 4, cutoff=10_000)
    assert experience.page_digest(events.where("seq <= 3"), "seq") == experience.page_digest(events.where("seq <= 3").repartition(3), "seq")


def test_event_ids_are_used_once_in_a_scope(spark):
    good = generate.executions(spark, 4, scopes=1).cache()
    other = good.where("execution = 'x1' AND kind = 'STAGE_RECORDED'").withColumn("seq", F.col("seq") + 100).withColumn("execution", F.lit("x2"))
    assert {r[3] for r in rows(ledger.fold_validate(good.unionByName(other)))} == {"DUPLICATE_EVENT"}


def test_segments(spark, tmp_path):
    line = lambda s, p: spark.range(1).select(ledger.framed(F.lit(s), F.lit(p))).first()[0]
    body = "\n".join([line(1, "a"), line(2, "b\tc"), line(2, "d"), line(5, "e")]) + "\n"
    (tmp_path / "s1").write_bytes(body.encode() + b"MXL1\t6\t1")
    (tmp_path / "s2").write_bytes(line(1, "a").encode() + b"\n\xff\xfe\nonly text\n")
    got = {os.path.basename(p): [] for p in ("s1", "s2")}
    for r in segments.scan_segments(spark, str(tmp_path)).orderBy("path", "line").collect():
        got[os.path.basename(r.path)].append((r.finding, r.in_prefix))
    assert got["s1"] == [(None, True), (None, True), ("DUPLICATE_SEQUENCE", False), ("SEQUENCE_GAP", False), ("TORN_TAIL", False)]
    assert got["s2"] == [(None, True), ("MALFORMED_RECORD", False), ("MALFORMED_RECORD", False)]


def test_frames_chunks_samples_properties(spark, tmp_path):
    v = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0]), ("a", [5.0, 6.0])], "atom_id string, vec array<float>").coalesce(1)
    segments.write_frames(spark, v, str(tmp_path / "v"), 2)
    got = [(r.atom_id, r.version, r.vec) for r in segments.read_frames(spark, str(tmp_path / "v"), 2).orderBy("atom_id", "version").collect()]
    assert got == [("a", 0, [1.0, 2.0]), ("a", 1, [5.0, 6.0]), ("b", 0, [3.0, 4.0])]
    with pytest.raises(Exception, match="dimensions"):
        segments.write_frames(spark, v, str(tmp_path / "w"), 3)
    from larkspur.operators import chunk

    texts = spark.createDataFrame([(1, "alpha beta\n\ngamma"), (2, "alpha beta")], "doc_id long, text string")
    c = segments.chunk_keys(chunk.chunks(texts, policy=chunk.Policy(16)), "corpus", "p1")
    segments.write_chunks(c, texts, str(tmp_path / "c"))
    back = segments.read_chunks(spark, str(tmp_path / "c"))
    assert sorted(r.text for r in back.collect()) == ["alpha beta", "alpha beta", "gamma"] and back.where("finding IS NOT NULL").count() == 0
    (tmp_path / "x.properties").write_text("# note\na = 1\nb=2\na=3\n")
    assert rows(segments.read_properties(spark, str(tmp_path / "x.properties"))) == [("a", "3"), ("b", "2")]
    s = spark.createDataFrame([("s1", "/p", "t", "F01", "C", "WORD", "en", "CUSTOM")], "sample_id string, path string, transcript string, speaker string, condition string, task_type string, language string, source string")
    segments.save_samples(s, str(tmp_path / "samples"))
    assert segments.has_samples(spark, str(tmp_path / "samples")) and segments.read_samples(spark, str(tmp_path / "samples"), "s2").count() == 0


def test_logs_go_by_the_names_of_their_files(spark, tmp_path):
    for name, body in (("b.tsv", "Mg=="), ("a.tsv", "MQ=="), ("c.tsv", "Mw==")):
        (tmp_path / name).write_text("\n".join(f"i{k}\tTEXT\t{body}\t1.0\t2024-01-01T00:00:00Z" for k in range(3 if name != "b.tsv" else 400)) + "\n")
    got = {r.id: r.content for r in stores.last_wins(stores.read_atom_log(spark, str(tmp_path))).collect()}
    assert got["i1"] == "3" and got["i7"] == "2"
    (tmp_path / "f.json").write_text('{"query":"q","atomId":"a","signal":"POSITIVE","delta":-1.0,"createdAt":"2024-01-01T00:00:00Z"}\n')
    with pytest.raises(Exception, match="invalid feedback"):
        stores.read_feedback(spark, str(tmp_path / "f.json")).collect()


def test_drivers(spark):
    assert all(drivers.execution_flow(spark, 6).values())
    atoms = spark.createDataFrame([(f"a{k}", f"text number {k} cache") for k in range(40)], "atom_id string, content string")
    q = spark.createDataFrame([("q", "cache number 3")], "query_id string, text string")
    sweep = drivers.latency_sweep(atoms, q, [10, 40], [1, 5], repeats=1)
    assert {(r["size"], r.k, r.returned) for r in sweep.collect()} == {(10, 1, 1), (10, 5, 5), (40, 1, 1), (40, 5, 5)}
    assert drivers.optimization_signal(sweep, 1e9) == "OPTIMIZATION_NOT_YET_JUSTIFIED"
    found = drivers.readback(atoms, atoms.where("atom_id <> 'a3'"))
    assert rows(found) == [("a3", "MISSING")] and drivers.import_kind(found, 0, 40) == "DAMAGED"
    assert drivers.import_kind(found.limit(0), 40, 40) == "REPEAT"
    rel = spark.createDataFrame([("q", "a3")], "query_id string, label string")
    assert drivers.expansion_ab(atoms, q, q.withColumn("text", F.lit("3")), rel).first().change in ("IMPROVED", "MAINTAINED")
    b = judging.effect(F.lit(3), F.lit(1), F.lit(False))
    assert spark.range(1).select(b).first()[0] == "IMPROVED"
