"""Segments and vector frames as data sources: ranges, torn and spoiled lines, tailing streams, layout, commits, look-ups."""

import hashlib
import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.sources import datasources, segments


def line(seq, payload, magic=b"MXL1", length=None, digest=None):
    payload = payload if isinstance(payload, bytes) else payload.encode()
    return b"\t".join([magic, str(seq).encode(), str(len(payload) if length is None else length).encode(), (digest or hashlib.sha256(payload).hexdigest()).encode(), payload])


def event(seq, kind="EXECUTION_STARTED", scope="s", execution="x", **more):
    fields = {"schema": 1, "kind": kind, "scope": scope, "task": "t", "execution": execution, "event_id": f"e{seq}", "revision": 1} | more
    import json

    names = [f.split(" ")[0] for f in segments.PAYLOAD.split(", ")]
    return json.dumps({n: fields[n] for n in names if n in fields}, separators=(",", ":"), ensure_ascii=False)


@pytest.mark.parametrize("step", [1, 7, 64, 10_000])
def test_ranges_give_each_line_once(tmp_path, step, monkeypatch):
    monkeypatch.setattr(datasources, "CHUNK", 16)
    rng = random.Random(step)
    content = b"\n".join(bytes(rng.randrange(97, 123) for _ in range(rng.choice([0, 0, 1, 3, 40]))) for _ in range(60))
    for tail in (b"", b"\n", b"\nend"):
        path = str(tmp_path / f"f{len(tail)}")
        with open(path, "wb") as f:
            f.write(content + tail)
        want, at = [], 0
        for part in (content + tail).splitlines(keepends=True):
            want.append((at, part.rstrip(b"\n"), not part.endswith(b"\n")))
            at += len(part)
        got = [(o, x, torn) for r in datasources._ranges([(path, 0, at)], step) for o, n, x, torn in datasources._lines(r, 1 << 20)]
        assert got == want
        short = [(n, x) for r in datasources._ranges([(path, 0, at)], step) for o, n, x, torn in datasources._lines(r, 5)]
        assert short == [(len(x), x[:5]) for _, x, _ in want]


def scan(spark, folder, **kw):
    t = segments.scan_ledger(segments.read_segments(spark, str(folder), 6_000), **kw)
    return {(os.path.basename(r["path"]), r["offset"]): (r["seq"], r["findings"], r["in_prefix"]) for r in t.collect()}


def test_scan_findings(spark, tmp_path):
    good = [line(k, event(k, "EXECUTION_STARTED" if k == 1 else "OUTCOME_RECORDED", outcome="ACCEPTED")) for k in range(1, 30)]
    cases = {
        "whole": (good, {}),
        "gap": ([*good[:5], *good[7:]], {5: ["SEQUENCE_GAP"]}),
        "repeat": ([*good[:5], good[4], *good[5:]], {5: ["DUPLICATE_SEQUENCE"]}),
        "fields": ([*good[:3], b"nonsense", *good[6:]], {3: ["MALFORMED_RECORD"]}),  # what follows has no expectation
        "magic": ([good[0], line(2, event(2), magic=b"MXL9"), good[2]], {1: ["MALFORMED_RECORD"]}),
        "zero": ([line(0, event(1)), good[0]], {0: ["MALFORMED_RECORD"]}),
        "length": ([good[0], line(2, event(2), length=3), good[2]], {1: ["MALFORMED_RECORD"]}),
        "digest": ([good[0], line(2, event(2, "OUTCOME_RECORDED"), digest="0" * 64), good[2]], {1: ["DIGEST_MISMATCH"]}),
        "bytes": ([good[0], line(2, b"\xff\xfe"), good[2]], {1: ["MALFORMED_RECORD"]}),
        "form": ([good[0], line(2, event(2).replace(",", ", ")), good[2]], {1: ["MALFORMED_RECORD"]}),
        "state": ([good[0], line(2, event(2)), good[2], line(4, event(4))], {1: ["CONFLICTING_DUPLICATE_EVENT"]}),
        "scope": ([good[0], line(2, event(2, "OUTCOME_RECORDED", scope="u")), good[2]], {1: ["SCOPE_ID_MISMATCH"]}),
        "large": ([good[0], line(2, "x" * (1 << 20)) + b"y" * 600, good[2]], {1: ["OVERSIZED_RECORD"]}),
    }
    for name, (lines, _) in cases.items():
        (tmp_path / name).write_bytes(b"".join(x + b"\n" for x in lines))
    (tmp_path / "torn").write_bytes(b"\n".join(good[:3]))
    got = scan(spark, tmp_path, scope="s", blocks=3)
    for name, (lines, want) in [*cases.items(), ("torn", (good[:3], {2: ["TORN_TAIL"]}))]:
        at, sound = 0, True
        for k, x in enumerate(lines):
            seq, findings, in_prefix = got[name, at]
            assert findings == want.get(k, []), (name, k, findings)
            sound = sound and k not in want
            assert in_prefix == sound, (name, k)
            at += len(x) + 1
    assert len(got) == sum(len(lines) for lines, _ in cases.values()) + 3


def test_stream_follows_growing_segments(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    datasources.register(spark)

    def go():
        s = spark.readStream.format("larkspur_segments").option("range", 50).load(str(folder))
        q = s.select("path", "offset", F.col("line").cast("string").alias("line"), "torn").writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(path=out, format="parquet")
        q.awaitTermination()
        return sorted(r["line"] for r in spark.read.parquet(out).collect())

    (folder / "a").write_bytes(b"one\ntwo\nthr")
    assert go() == ["one", "two"]
    with open(folder / "a", "ab") as f:
        f.write(b"ee\n" + b"x" * 200 + b"\n")
    (folder / "b").write_bytes(b"four\n")
    want = sorted(["one", "two", "three", "x" * 200, "four"])
    assert go() == want and go() == want


def write(spark, path, rows, dimensions=3, mode="append", prefixed=False, parts=1):
    datasources.register(spark)
    t = spark.createDataFrame(rows, "atom_id string, vec array<float>").coalesce(parts)
    t.write.format("larkspur_frames").option("dimensions", dimensions).option("prefixed", str(prefixed).lower()).mode(mode).save(path)


def load(spark, path, dimensions=3, **options):
    r = spark.read.format("larkspur_frames").option("dimensions", dimensions)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load(path)


def test_frames_layout_versions_and_overwrite(spark, tmp_path):
    path = str(tmp_path / "v")
    write(spark, path, [("a", [1.0, 2.0, 3.0]), ("b", [0.5, -1.0, 0.0])])
    part = next(f[:-4] for f in os.listdir(path) if f.endswith(".vec"))
    assert open(f"{path}/{part}.vec", "rb").read() == struct.pack(">6f", 1, 2, 3, 0.5, -1, 0)
    assert open(f"{path}/{part}.map").read() == "a\t0\nb\t12\n"
    write(spark, path, [("a", [9.0, 9.0, 9.0])], prefixed=True)
    rows = load(spark, path, range=5).orderBy("version", "place").collect()
    assert [(r["atom_id"], list(r["vec"])) for r in rows] == [("a", [1, 2, 3]), ("b", [0.5, -1, 0]), ("a", [9, 9, 9])]
    write(spark, path, [("c", [1.0, 1.0, 1.0])], mode="overwrite")
    assert [r["atom_id"] for r in load(spark, path).collect()] == ["c"]
    assert load(spark, str(tmp_path / "nothing")).collect() == []


def test_frames_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "v")
    write(spark, path, [("a", [1.0, 2.0, 3.0])])
    before = sorted(os.listdir(path))
    for bad in ([("b", [1.0, 2.0])], [("b", None)], [("b\tc", [1.0, 2.0, 3.0])]):
        with pytest.raises(Exception, match="dimensions|null|blank"):
            write(spark, path, [("ok", [1.0, 1.0, 1.0]), *bad])
        assert sorted(os.listdir(path)) == before
    assert [r["atom_id"] for r in load(spark, path).collect()] == ["a"]


@pytest.mark.parametrize("index, what", [("a\t4\n", "aligned"), ("a\t-12\n", "outside"), ("a\t24\n", "outside"), ("a 0\n", "malformed"), ("\t0\n", "malformed")])
def test_frames_bad_offsets(spark, tmp_path, index, what):
    path = str(tmp_path / "v")
    write(spark, path, [("a", [1.0, 2.0, 3.0]), ("b", [1.0, 2.0, 3.0])])
    part = next(f for f in os.listdir(path) if f.endswith(".map"))
    open(f"{path}/{part}", "w").write(index)
    with pytest.raises(Exception, match=what):
        load(spark, path).collect()


def test_frames_point_look_up_reads_one_frame(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "v")
    write(spark, path, [(f"a{k}", [float(k), 0.0, 1.0]) for k in range(500)])
    t = load(spark, path).where("atom_id = 'a77'")
    assert [list(r["vec"]) for r in t.collect()] == [[77, 0, 1]]
    reader = datasources.FrameReader({"path": path, "dimensions": "3"})
    reader.wanted = {"a77"}
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert [b.num_rows for b in batches] == [1]
    assert np.asarray(batches[0].column("vec").flatten()).tolist() == [77, 0, 1]
