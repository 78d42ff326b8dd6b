"""Files told by their first bytes, and folders of samples and pins."""

import gzip
import hashlib
import json

import pytest
import zstandard
from pyspark.errors import AnalysisException

from wiretide.operators import protobuf, report
from wiretide.sources import captures, files

EVENT = {"ts_ns": 1, "kind": "conn_end", "pid": 1, "tgid": 1, "uid": 0, "gid": 0, "cgroup_id": 7, "comm": "x", "cpu": 0}


def text(*marks):
    return "".join(json.dumps(EVENT | {"pid": m}) + "\n" for m in marks).encode()


@pytest.fixture
def folder(tmp_path):
    zipped = zstandard.ZstdCompressor().compress
    rows = {
        "named.gz": text(1, 2), "plain.jsonl": gzip.compress(text(3)) + gzip.compress(b"\n\nno json\n" + text(4)) + b"\0" * 20, "more.bin": zipped(text(5)) + zipped(text(6)[:-1]),
        "cut.jsonl": gzip.compress(text(*range(100, 3100)))[:-40], "cut.zst": zipped(text(*range(10)))[:-6], "damaged": b"\x1f\x8bnothing", "empty": b"", "odd.txt": b"\xff\xfe\n" + text(7) + b'{"kind": "dns"}',
    }
    (tmp_path / "below").mkdir()
    for name, data in rows.items():
        (tmp_path / ("below" if name == "odd.txt" else "") / name).write_bytes(data)
    return tmp_path


def test_codecs_by_first_bytes(spark, folder):
    rows = files.read_lines(spark, str(folder))
    at = {}
    for r in rows.collect():
        at.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["line_no"], r["pid"]))
    at = {k: sorted(v) for k, v in at.items()}
    assert at["named.gz"] == [(1, 1), (2, 2)] and at["plain.jsonl"] == [(1, 3), (4, None), (5, 4)] and at["more.bin"] == [(1, 5), (2, 6)]
    assert at["damaged"] == [(1, None)] and "empty" not in at and at["odd.txt"] == [(1, None), (2, 7), (3, None)]
    assert at["cut.jsonl"][:2000] == [(i + 1, i + 100) for i in range(2000)] and at["cut.jsonl"][-1][1] is None
    told = {r["path"].rsplit("/", 1)[1]: (r["lines"], r["faulty"], r["json"], r["missing"]) for r in files.faults(rows).collect()}
    assert told["plain.jsonl"] == (3, 1, 1, 0) and told["odd.txt"] == (3, 2, 1, 1) and told["damaged"] == (1, 1, 1, 0) and told["more.bin"] == (2, 0, 0, 0)
    assert told["cut.zst"][1] >= 1
    assert report.quality(rows).first()[1] == sum(t[2] for t in told.values())
    assert captures.events(rows.where("pid between 1 and 7")).count() >= 7


def test_streamed_files(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("streamed")
    own = files.stream_lines(spark, str(folder)).select("path", "line_no", "pid")
    own.writeStream.format("parquet").option("path", str(out / "rows")).option("checkpointLocation", str(out / "state")).trigger(availableNow=True).start().awaitTermination(120)
    want = files.read_lines(spark, str(folder)).where("path not like '%odd.txt'").select("path", "line_no", "pid")
    assert sorted(map(str, spark.read.parquet(str(out / "rows")).collect())) == sorted(map(str, want.collect()))


def test_long_lines_and_batches(spark, monkeypatch):
    monkeypatch.setattr(files, "LINES", 7)
    monkeypatch.setattr(files, "STEP", 11)
    long = b"x" * 3_000_000
    made = spark.createDataFrame([("a", gzip.compress(b"1\n" + long + b"\n\n" + b"2\n" * 20)), ("b", None), (None, b"z")], "path string, content binary")
    got = sorted((r["path"] or "", r["line_no"], len(r["line"])) for r in files.lines(made).collect())
    assert got == [("", 1, 1), ("a", 1, 1), ("a", 2, 3_000_000), *(("a", i, 1) for i in range(4, 24))]
    assert files.lines(made.limit(0)).count() == 0


def test_samples_and_pins(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in {"a.bin": b"\x08\x01", "in/b": b"\x08\x02\x08\x03", "none": b"", "big": b"\x08\x01" * 60, "c.der": b"cert", "d.der": b"cert", "e.DER": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    found = files.samples(spark, str(tmp_path), largest=100)
    assert sorted(bytes(r["content"]) for r in found.collect()) == sorted([b"\x08\x01", b"\x08\x02\x08\x03", b"cert", b"cert", b"x"])
    (field,) = protobuf.profile(protobuf.decoded(found)).where("tag = 1").collect()
    assert (field["messages"], field["seen"], field["repeated"]) == (2, 3, True)
    assert [r["sha256"] for r in files.pins(spark, str(tmp_path)).collect()] == [hashlib.sha256(b"cert").hexdigest()]
    with pytest.raises(AnalysisException):
        files.pins(spark, str(tmp_path / "absent"))
