"""Traps of the semantics, on small fixtures."""

import hashlib
import struct
import uuid
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions import ids, text, vectors
from larkspur.operators import audit, chunk, compare, cost, fusion, generate, ledger, metrics, recall
from larkspur.sources import speech, stores


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def python_vector(tokens, d=128):
    v = np.zeros(d, np.float32)
    for t, w in tokens:
        h = hashlib.sha256(t.encode()).digest()
        b, s = struct.unpack(">ii", h[:8])
        v[b % d] += np.float32(w if s % 2 == 0 else -w)
    m = 0.0
    for x in v:
        m += float(x * x)
    return v / np.float32(np.sqrt(m)) if m else v


def test_content_id_is_a_name_uuid(spark):
    df = spark.createDataFrame([("héllo",), ("",), ("x" * 999,)], "t string")
    for t, i in df.select("t", ids.content_id(F.col("t"))).collect():
        u = uuid.UUID(bytes=hashlib.md5(t.encode()).digest(), version=3)
        assert i == str(u)


def test_vectors_equal_a_plain_implementation(spark):
    texts = ["The paths of models", "similarity search with a cache", "!!!", "naïve café 42"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r.id: r.vec for r in recall.encoded(df, "id", F.col("t"), None).collect()}
    for i, t in enumerate(texts):
        tokens = [x for x in "".join(c if c.isascii() and c.isalnum() else " " for c in t.lower()).split()]
        assert got[i] == python_vector([(x, 1.0) for x in tokens]).tolist()


def test_expansion_repeats_tokens(spark):
    df = spark.createDataFrame([("similarity search",)], "t string")
    norm = text.normalized(F.col("t"))
    got = df.select(text.weighted(norm, text.expansions(norm)).alias("w")).first().w
    assert [x.token for x in got].count("nearest") == 2
    assert {x.weight for x in got} == {1.0, 0.25}


def test_alias_weights():
    assert text.alias_weights() == (0.25, 0.0625)


def test_best_version_threshold_ties_and_orphans(spark):
    e = lambda *x: [float(v) for v in x]
    stored = spark.createDataFrame([("b", e(1, 0)), ("a", e(1, 0)), ("c", e(0, 1)), ("c", e(1, 0)), ("z", e(0, 0)), ("n", e(-1, 0))], "atom_id string, vec array<float>")
    q = spark.createDataFrame([("q", e(1, 0)), ("zero", e(0, 0))], "query_id string, vec array<float>")
    assert rows(recall.scan(stored, q, 3, 0.0)) == [("q", 1, "a", 1.0), ("q", 2, "b", 1.0), ("q", 3, "c", 1.0), ("zero", 1, "a", 0.0), ("zero", 2, "b", 0.0), ("zero", 3, "c", 0.0)]
    assert len(rows(recall.scan(stored, q.where("query_id = 'q'"), 9, 0.0))) == 4
    assert len(rows(recall.scan(stored, q.where("query_id = 'q'"), 9, None))) == 5
    with pytest.raises(ValueError):
        recall.scan(stored, q, 0)


def test_scan_in_passes_equals_one(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = lambda n, p: spark.createDataFrame([(f"{p}{i}", [float(x) for x in rng.standard_normal(8)]) for i in range(n)], "k string, vec array<float>")
    stored, q = v(50, "a").withColumnRenamed("k", "atom_id").cache(), v(20, "q").withColumnRenamed("k", "query_id").cache()
    one = rows(recall.scan(stored, q, 4, None))
    monkeypatch.setattr(recall, "MAX_QUERIES", 6)
    assert rows(recall.scan(stored.repartition(7), q, 4, None)) == one


def test_blank_query_finds_nothing(spark):
    a = recall.atoms(spark.createDataFrame([("redis cache",)], "text string"))
    q = spark.createDataFrame([("q1", "the of"), ("q2", "!!!"), ("q3", "cache")], "query_id string, text string")
    assert {r[0] for r in rows(recall.recall(a, q))} == {"q3"}
    assert rows(recall.Query(a, q).top(1).threshold(0.1).run())[0][:2] == ("q3", 1)


def test_feedback_pool(spark):
    scored = spark.createDataFrame([("q", "k", f"a{i:02d}", 1 - i / 100) for i in range(30)] + [("p", "none", "x", 0.2)], "query_id string, query_key string, atom_id string, score double")
    deltas = spark.createDataFrame([("k", "a07", 0.5), ("k", "a29", 5.0), ("k", "a00", -2.0)], "query_key string, atom_id string, delta double")
    got = rows(recall.rerank(scored, deltas, 2, 0.5))
    assert [r[2] for r in got if r[0] == "q"] == ["a07", "a01"]  # a29 lies beyond the pool of 8
    assert not [r for r in got if r[0] == "p"]
    only_negative = deltas.where("delta < 0")
    assert [r[2] for r in rows(recall.rerank(scored, only_negative, 2, 0.5)) if r[0] == "q"] == ["a01"]


def test_precision_recall_mrr(spark):
    ranked = spark.createDataFrame([("q", 1, "x"), ("q", 2, "a"), ("q", 3, "a")], "query_id string, rank int, label string")
    rel = spark.createDataFrame([("q", "a"), ("q", "b"), ("r", "c")], "query_id string, label string")
    got = {r.query_id: r for r in metrics.per_query(ranked, rel).collect()}
    assert (got["q"].p_at_3, got["q"].r_at_3, got["q"].rr) == (2 / 3, 0.5, 0.5)
    assert (got["q"].p_at_5, got["r"].rr, got["r"].hit_at_5) == (2 / 5, 0.0, 0.0)


def test_recorded_prefix_is_not_a_filter(spark):
    t = spark.createDataFrame([("s", 1, 10), ("s", 2, 30), ("s", 3, 20)], "scope string, seq long, recorded_at long")
    assert [r[1] for r in rows(ledger.recorded_prefix(t, F.lit(20), "scope"))] == [1]


def test_acceptance(spark):
    schema = "status string, origin string, result string, dims array<struct<ordinal:int,dimension:string,state:string>>"
    cases = [
        (("PENDING", "V", None, []), ("PENDING", [])),
        (("REJECTED", "V", "COMPLETED", []), ("NOT_ACCEPTED", ["outcome is REJECTED"])),
        (("ACCEPTED", "VALIDATED", "COMPLETED", [(1, "BUILD", "PASS"), (2, "TESTS", "NOT_APPLICABLE")]), ("VALIDATED_ACCEPTED", [])),
        (("ACCEPTED", "IMPORTED_CLAIM", None, [(2, "TESTS", "FAIL"), (1, "BUILD", None)]), ("ACCEPTED_UNVALIDATED", ["accepted attempt is not finished", "outcome is an imported claim, not a validated outcome", "BUILD: no applicable evidence", "TESTS: FAIL"])),
    ]
    df = spark.createDataFrame([c[0] for c in cases], schema)
    got = [tuple(r[0]) for r in df.select(ledger.acceptance(*map(F.col, df.columns))).collect()]
    assert [(s, list(r)) for s, r in got] == [c[1] for c in cases]


def test_chains_and_corrections(spark):
    base = [("s", 1, "e1", "K", "x", "a", 1, None), ("s", 2, "e2", "K", "x", "a", 2, "e1"), ("s", 3, "e3", "K", "x", "a", 3, "e2"), ("s", 4, "e4", "L", "x", "a", 2, "e1"), ("s", 5, "e5", "K", "x", "a", 9, "e3"), ("s", 6, "e6", "K", "x", "a", 2, "gone")]
    t = spark.createDataFrame(base, "scope string, seq long, event_id string, kind string, execution string, attempt string, revision int, supersedes string")
    assert rows(ledger.revision_roots(t.where("seq <= 3"))) == [("e1", "e1", 0), ("e2", "e1", 1), ("e3", "e1", 2)]
    assert {r[2]: r[3] for r in rows(ledger.correction_findings(t))} == {"e4": "NOT_LATEST_REVISION", "e5": "WRONG_REVISION", "e6": "DANGLING_TARGET"}


def test_fold(spark):
    good = generate.executions(spark, 6).cache()
    assert rows(ledger.fold_validate(good)) == []
    bad = good.unionByName(good.where("kind = 'STAGE_RECORDED'").withColumn("seq", F.col("seq") + 100).withColumn("event_id", F.concat("event_id", F.lit("+"))))
    assert {r[3] for r in rows(ledger.fold_validate(bad))} == {"ATTEMPT_FINISHED"}
    assert rows(generate.executions(spark, 3).exceptAll(good)) == []


def test_as_of_price(spark):
    p = spark.createDataFrame([(1, "x", "1999-06-01"), (2, "x", "2001-03-01"), (3, "x", "2001-03-01"), (4, "x", "2001-04-01")], "id long, provider string, d string").select("id", "provider", F.to_date("d").alias("effective_date"))
    s = spark.createDataFrame([(1, "x", "1999-05-31 23:00:00"), (2, "x", "1999-06-01 00:00:00"), (3, "x", "2001-01-05 00:00:00"), (4, "x", "2001-03-01 10:00:00"), (5, "x", "2003-01-01 00:00:00"), (6, "y", "2003-01-01 00:00:00"), (6, "y", "2003-01-01 00:00:00")], "k long, provider string, t string").select("k", "provider", F.to_timestamp("t").alias("t"))
    got = [(r.k, r.match, r.price_id) for r in cost.asof_price(s, p, "t", "provider").orderBy("k").collect()]
    assert got == [(1, "NONE", None), (2, "FOUND", 1), (3, "FOUND", 1), (4, "AMBIGUOUS", None), (5, "FOUND", 4), (6, "NONE", None), (6, "NONE", None)]


def test_line_cost_is_half_even(spark):
    df = spark.createDataFrame([(1, Decimal("0.000500")), (3, Decimal("0.000500"))], "u long, p decimal(18,6)")
    got = [r[0] for r in df.select(cost.report(cost.line_cost(F.col("u"), F.col("p"), 1000))).collect()]
    assert got == [Decimal("0.000000"), Decimal("0.000002")]
    with pytest.raises(ValueError):
        cost.line_cost(F.lit(1), F.lit(1), 7)


def test_included_usage(spark):
    u = spark.createDataFrame([("s", "IN", 10, "REPORTED"), ("s", "CACHE", 4, "ESTIMATED"), ("t", "IN", 1, "REPORTED"), ("t", "CACHE", 4, "REPORTED"), ("v", "IN", 5, "REPORTED")], "stage string, kind string, value long, provenance string")
    lines = spark.createDataFrame([(s, k, 1.0, 1000, i) for s in "stv" for k, i in (("IN", None), ("CACHE", "IN"))], "stage string, kind string, price double, unit_size long, included_in string")
    got = {(r.stage, r.kind): (r.billable, r.provenance, r.state) for r in cost.billable(u, lines, "stage").collect()}
    assert got["s", "IN"] == (6, "ESTIMATED", "BILLED")
    assert got["t", "IN"][2] == "INCONSISTENT_USAGE"
    assert got["v", "IN"][2] == "INCLUDED_UNMEASURED" and got["v", "CACHE"][2] == "MISSING_USAGE"
    assert cost.acyclic({"a": None, "b": "a"}) and not cost.acyclic({"a": "b", "b": "a"})


def test_touching_intervals_merge(spark):
    t = spark.createDataFrame([("g", 0, 10), ("g", 10, 20), ("g", 12, 15), ("g", 30, 31)], "g string, s long, e long").select("g", F.timestamp_seconds("s").alias("started_at"), F.timestamp_seconds("e").alias("ended_at"))
    assert rows(cost.time_totals(t, "g")) == [("g", 24.0, 31.0, 21.0)]


def test_pareto_cycle_is_unassessed(spark):
    # within a tolerance of 1 a beats b beats c beats a
    data = [("g", "a", 0.0, 2.0, 1.0), ("g", "b", 1.0, 0.0, 2.4), ("g", "c", 2.4, 1.0, 0.0), ("h", "d", 1.0, 1.0, 1.0), ("h", "e", 3.0, 3.0, 3.0), ("h", "f", None, 0.0, 0.0)]
    df = spark.createDataFrame(data, "g string, ref string, x double, y double, z double")
    o = [compare.Objective(c, True, 1.0) for c in "xyz"]
    got = {r.ref: r.state for r in compare.pareto(df, "ref", ["g"], o).collect()}
    assert (got["d"], got["e"], got["f"]) == ("FRONT", "DOMINATED", "UNASSESSED")
    want = {}
    for a in data[:3]:
        lost = [b[1] for b in data[:3] if b is not a and all(b[k] <= a[k] + 1 for k in (2, 3, 4)) and any(b[k] < a[k] - 1 for k in (2, 3, 4))]
        want[a[1]] = lost
    if all(want.values()):
        assert {got[k] for k in "abc"} == {"UNASSESSED"}


def test_constant_arm_and_routes(spark):
    s = spark.createDataFrame([("q", "a", 2.0), ("q", "b", 2.0)], "query_id string, sample_id string, score double")
    assert {(r.normalized, r.status) for r in fusion.min_max(s, "query_id").collect()} == {(0.0, "CONSTANT_NO_DISCRIMINATION")}
    corpus = spark.createDataFrame([("q", x) for x in "abc"], "query_id string, sample_id string")
    t = fusion.min_max(spark.createDataFrame([("q", "a", 1.0), ("q", "b", 2.0)], s.schema), "query_id")
    a = fusion.min_max(spark.createDataFrame([("q", "a", 1.0)], s.schema), "query_id")
    al = fusion.aligned(corpus, t, a)
    assert [r.route for r in fusion.routes(al).collect()] == ["DEFERRED_TO_TRANSCRIPT"]
    assert [r[1] for r in rows(fusion.missing_policy(al, "BOTH_REQUIRED", 0.5, 0.5))] == ["a"]
    assert len(rows(fusion.missing_policy(al, "AVAILABLE_MODALITY_ONLY", 0.5, 0.5))) == 2


def test_chunks_cover_the_text():
    t = "# One\nalpha beta gamma\n\n" + "delta " * 500 + "\n\n# Two\nomega\n"
    p = chunk.Policy(max_bytes=300, overlap_bytes=40, heading=r"# .+")
    got = chunk.split_text(t, p)
    assert all(len(t[a:b].encode()) <= 300 for _, a, b in got)
    assert all(any(a <= k < b for _, a, b in got) for k, c in enumerate(t) if not c.isspace())
    assert {s for s, _, _ in got} == {1, 2}
    assert chunk.split_text("", p) == []


def test_atom_log_round_trip(spark, tmp_path):
    a = spark.createDataFrame([("i1", "TEXT", "héllo\tworld", ["x", "y,z"], 1.0), ("i2", "TEXT", "b", [], 2.0)], "id string, type string, content string, aliases array<string>, weight double").withColumn("created_at", F.timestamp_seconds(F.lit(0)))
    p = str(tmp_path / "atoms")
    stores.write_atom_log(a, p)
    got = stores.read_atom_log(spark, p)
    assert rows(got.select("id", "content", "aliases", "weight")) == rows(a.select("id", "content", "aliases", "weight"))
    spark.createDataFrame([("only\tthree\tfields",)], "value string").write.mode("append").text(p)
    with pytest.raises(Exception, match="malformed"):
        stores.read_atom_log(spark, p).collect()


def test_last_wins_keeps_first_place(spark):
    t = spark.createDataFrame([("a", "1", 1), ("b", "1", 2), ("a", "2", 3)], "id string, content string, seq long")
    assert rows(stores.last_wins(t)) == [("a", "2", 1), ("b", "1", 2)]


def test_vector_files(spark, tmp_path):
    x = np.arange(12, dtype=">f4").reshape(3, 4)
    (tmp_path / "v.bin").write_bytes(x.tobytes())
    got = stores.read_vector_file(spark, str(tmp_path / "v.bin"), 4).orderBy("version").collect()
    assert [r.vec for r in got] == x.tolist()
    (tmp_path / "p.bin").write_bytes(b"".join(struct.pack(">i", 4) + r.tobytes() for r in x))
    assert stores.read_vector_file(spark, str(tmp_path / "p.bin"), 4, True).count() == 3


def test_manifest_gate(spark, tmp_path):
    p = str(tmp_path / "m")
    stores.save_manifest(spark, p, {"version": "0.4", "encoder": "hash-128"})
    assert stores.load_manifest(spark, p, encoder="hash-128")["version"] == "0.4"
    with pytest.raises(ValueError):
        stores.load_manifest(spark, p, encoder="other")


def test_wav(spark, tmp_path):
    x = (np.sin(np.arange(800) / 5) * 20000).astype("<i2")
    head = b"RIFF" + struct.pack("<I", 36 + x.nbytes) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16) + b"data" + struct.pack("<I", x.nbytes)
    d = tmp_path / "F01" / "words"
    d.mkdir(parents=True)
    (d / "a.wav").write_bytes(head + x.tobytes())
    (d / "b.wav").write_bytes(b"nonsense")
    got = {r.path[-5:]: r for r in speech.read_wavs(spark, str(tmp_path)).collect()}
    assert got["a.wav"].duration_ms == 100 and abs(np.linalg.norm(got["a.wav"].vec) - 1) < 1e-5
    assert got["b.wav"].failure == "not a WAV file"
    p = spark.createDataFrame([("/x/FC03/Session1/sentences/1.wav",)], "p string")
    c = F.col("p")
    assert tuple(p.select(speech.speaker(c), speech.condition(c), speech.task_type(c)).first()) == ("FC03", "CONTROL", "SENTENCE")


def test_audit(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", [1.0]), ("d", [float("nan"), 1.0])], "atom_id string, vec array<float>")
    assert {r[0]: r[1] for r in rows(audit.vector_findings(v, 2))} == {"b": "ZERO_VECTOR", "c": "DIMENSION_MISMATCH", "d": "NON_FINITE_COMPONENT"}


def test_streaming_appends_once(spark, tmp_path):
    from larkspur.streaming import ingest

    src, out, bad, cp = (str(tmp_path / x) for x in ("in", "ledger", "conflicts", "cp"))
    ev = lambda *r: spark.createDataFrame(list(r), ingest.EVENT.replace("recorded_at timestamp", "recorded_at string")).write.mode("append").json(src)
    ev(("s", 1, "e1", "K", "p", "2024-01-01 00:00:00"), ("s", 2, "e1", "K", "p", "2024-01-01 00:00:00"))
    ingest.append_once(ingest.events(spark, src), out, bad, cp).awaitTermination()
    ev(("s", 3, "e1", "K", "p", "2024-01-01 00:00:00"), ("s", 4, "e1", "K", "other", "2024-01-01 00:00:00"), ("s", 5, "e2", "K", "p", "2024-01-01 00:00:00"))
    ingest.append_once(ingest.events(spark, src), out, bad, cp).awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == ["e1", "e2"]
    assert [r.payload for r in spark.read.parquet(bad).collect()] == ["other"]


def test_book_failures(spark):
    q = spark.createDataFrame([(k, k not in ("n1", "n2")) for k in ("a", "b", "c", "d", "e", "n1", "n2", "z")], "query_id string, answerable boolean")
    j = spark.createDataFrame([(k, "E", 10, 2, "EVIDENCE") for k in "abcdez"] + [("e", "F", 30, 1, "EVIDENCE"), ("a", "X", 99, 0, "CONFOUNDER")], "query_id string, key string, ordinal int, grade int, role string")
    r = [("a", 1, "X", 99), ("a", 2, "E", 10), ("b", 1, "N", 11), ("b", 2, "E", 10), ("c", 1, "Q", 50), ("c", 2, "E", 10), ("d", 1, "E", 10), ("e", 1, "E", 10), ("n1", 1, "E", 10), ("z", 1, "Q", 50)]
    got = dict(map(tuple, metrics.book_failure(spark.createDataFrame(r, "query_id string, rank int, key string, ordinal int"), j, q).collect()))
    assert got == {"a": "DISTRACTOR", "b": "CHUNK_BOUNDARY_GAP", "c": "WRONG_RANK", "d": "NONE", "e": "MULTI_EVIDENCE_GAP", "n1": "FALSE_POSITIVE", "n2": "ABSTAINED", "z": "NO_RELEVANT_RESULT"}


def test_key_classes(spark):
    t = spark.createDataFrame([("EVAL", True, True, True), ("EVAL", False, True, True), ("EVAL", False, True, False), ("EVAL", True, False, True)], "x string, intended boolean, matched boolean, moved boolean")
    c = [F.col(n) for n in ("intended", "matched", "moved")]
    assert [r[0] for r in t.select(metrics.key_transfer(*c)).collect()] == ["INTENDED_TRANSFER", "CONTAMINATION", "SHARED_KEY_NO_MOVEMENT", "ISOLATED_NO_TRANSFER"]
    cases = spark.createDataFrame([("EQUIVALENT", True, True), ("DISTINCT", False, False)], "relationship string, key_matched boolean, moved boolean")
    assert metrics.stress_decision(cases).first()[0] == "NORMALIZED_STRESS_PASS"
    assert metrics.stress_decision(cases.withColumn("key_matched", F.lit(True))).first()[0] == "NORMALIZED_STRESS_RISK"


def test_speech_classes(spark):
    t = spark.createDataFrame([(True, False, True), (False, False, False)], "t boolean, a boolean, h boolean")
    o = fusion.modality_outcome(F.col("t"), F.col("a"))
    assert [r[0] for r in t.select(fusion.disagreement(o, F.col("h"))).collect()] == ["RECOVERED_ACOUSTIC_MISS", "BOTH_MISS_RETAINED"]
    s = spark.createDataFrame([("s", 4, []), (None, 4, []), ("s", 3, []), ("s", 4, ["speaker"])], "s string, d int, f array<string>")
    assert [r[0] for r in s.select(fusion.candidate_status(F.col("s"), F.col("d"), F.lit(4), F.col("f"))).collect()] == ["SCORED", "ORPHAN_VECTOR", "INCOMPATIBLE_DIMENSIONS", "METADATA_FILTERED"]


def test_exclusions(spark):
    df = spark.createDataFrame([("VALIDATED_ACCEPTED", 5, [(2, "TESTS", "FAIL"), (1, "BUILD", None)]), ("PENDING", None, [])], "s string, c long, g array<struct<ordinal:int,dimension:string,state:string>>")
    assert [r[0] for r in df.select(compare.exclusions(*map(F.col, "scg"))).collect()] == [["GATE_MISSING", "GATE_FAIL"], ["NOT_VALIDATED_ACCEPTED"]]
