"""Binary frames against the layout written out with struct."""

import base64
import ipaddress
import struct

from pyspark.sql import functions as F

from wiretide.operators import report
from wiretide.sources import captures, frames

BIG = 2**64 - 1


def frame(kind, payload, version=1, size=None, comm=b"curl\0\0junk"):
    size = frames.HEADER + len(payload) if size is None else size
    return struct.pack("<BBHIIxxxxQIIIIQQ16s", version, kind, 0, size, 3, 1000, 101, 100, 5, 6, BIG, 0, comm) + payload


def ip(text):
    return ipaddress.ip_address(text).packed.ljust(16, b"\0")


def pair(a, b):
    return ip(a) + ip(b)


def tcp(data, captured=None, protocol=6, family=2, a="10.0.0.1", b="10.0.0.2", direction=1):
    return struct.pack("<BBBBH", protocol, direction, family, 0, 40000) + struct.pack(">H", 80) + pair(a, b) + struct.pack("<QII", BIG, 99, len(data) if captured is None else captured) + data


CONN = struct.pack("<BBHH", 17, 10, 0, 5353) + struct.pack(">H", 53) + pair("2001:db8::1", "::ffff:1.2.3.4") + struct.pack("<Q", 7)
END = struct.pack("<QQQII", 7, BIG, 2, 250, 0)
TLS = struct.pack("<BBHxxxxQiIII", 3, 0, 0, 77, -1, 5, 5, 0) + b"hello"
DNS = struct.pack("<BBHHH", 0, 2, 0, 5000, 53) + pair("10.0.0.1", "8.8.8.8") + struct.pack("<HH", 12, 3) + b"abc"
SQL = struct.pack("<B3xxxxxQII", 2, 12345, 2**32 - 1, 13) + b"SELECT \xff1\0tail"


def read(spark, rows):
    made = spark.createDataFrame(list(enumerate(rows)), "id int, frame binary")
    return {r["id"]: r for r in frames.decoded(made).collect()}


def test_kinds(spark):
    out = read(spark, [frame(1, CONN), frame(2, END), frame(3, tcp(b"\x00\xffx")), frame(4, TLS), frame(5, DNS), frame(8, SQL) + b"beyond"])
    assert all(r["fault"] is None for r in out.values())
    e = {k: r["event"].asDict() for k, r in out.items()}
    assert {k: v for k, v in e[0].items() if v is not None} == {"ts_ns": 1000, "kind": "conn_start", "pid": 101, "tgid": 100, "uid": 5, "gid": 6, "cgroup_id": BIG, "comm": "curl", "cpu": 3, "sock_id": 7, "protocol": 17, "src": "[2001:db8::1]:5353", "dst": "1.2.3.4:53"}
    assert (e[1]["sock_id"], e[1]["bytes_sent"], e[1]["bytes_recv"], e[1]["rtt_us"], e[1]["src"]) == (7, BIG, 2, 250, None)
    assert (e[2]["sock_id"], e[2]["direction"], e[2]["src"], e[2]["dst"], e[2]["total_bytes"], base64.b64decode(e[2]["data_b64"])) == (BIG, "rx", "10.0.0.1:40000", "10.0.0.2:80", 99, b"\x00\xffx")
    assert (e[3]["tls_lib"], e[3]["direction"], e[3]["conn_id"], e[3]["socket_fd"], e[3]["total_bytes"], base64.b64decode(e[3]["data_b64"])) == ("gnutls", "tx", 77, -1, 5, b"hello")
    assert (e[4]["src"], e[4]["dst"], e[4]["total_bytes"], base64.b64decode(e[4]["data_b64"])) == ("10.0.0.1:5000", "8.8.8.8:53", 12, b"abc")
    assert (e[5]["api"], e[5]["db_handle"], e[5]["sql_total_bytes"], e[5]["sql"], e[5]["data_b64"]) == ("exec", 12345, None, "SELECT �1", None)


def test_faults(spark):
    rows = [
        (None, "short"), (b"", "short"), (frame(1, CONN)[:71], "short"), (frame(1, CONN, version=2), "version"), (frame(1, CONN, size=121), "truncated"), (frame(1, CONN, size=71), "truncated"),
        (frame(6, b""), "silent"), (frame(127, b""), "silent"), (frame(9, b""), "kind"), (frame(0, b""), "kind"), (frame(1, CONN[:-1]), "truncated"), (frame(3, tcp(b"ab", captured=3)), "truncated"),
        (frame(3, tcp(b"ab", captured=2**32 - 1)), "truncated"), (frame(3, tcp(b"", protocol=1)), "protocol"), (frame(3, tcp(b"", family=3)), "family"), (frame(4, b"\x06" + TLS[1:]), "library"), (frame(8, b"\x03" + SQL[1:]), "call"), (frame(2, END), None),
    ]
    out = read(spark, [data for data, _ in rows])
    assert [out[i]["fault"] for i in range(len(rows))] == [fault for _, fault in rows]
    assert all((r["event"] is None) == (r["fault"] is not None) for r in out.values())


def test_addresses(spark):
    texts = ["::", "::1", "1::", "2001:db8::1:0:0:1", "2001:0:0:1:0:0:0:1", "1:2:3:4:5:6:7:8", "1:0:3:0:5:0:7:0", "0:0:0:1:0:0:0:1", "fe80::a00:1", "::ffff:1.2.3.4", "100:20:3::"]
    made = spark.createDataFrame([(10, ip(t), t) for t in texts] + [(2, ip("255.0.1.20"), "255.0.1.20"), (3, ip("1.1.1.1"), None)], "family int, raw binary, text string")
    for r in made.select(frames.ip_text(F.col("family"), F.col("raw")).alias("got"), "text").collect():
        shown = r["text"] if r["text"] is None or "ffff:1." in r["text"] else str(ipaddress.ip_address(r["text"]))
        assert r["got"] == shown


def test_blobs_of_frames(spark):
    many = [frame(3, tcp(b"x" * (i % 40))) for i in range(3000)]
    bad = frame(3, tcp(b"y"), size=10)
    blobs = [(1, b"".join(many), "a"), (2, many[0] + bad + many[1], None), (3, None, "c"), (4, b"", "d"), (5, b"\x01", "e")]
    cut = frames.split(spark.createDataFrame(blobs, "id int, content binary, at_host string").repartition(3))
    assert cut.columns == ["id", "at_host", "ordinal", "at", "frame"]
    rows = {(r["id"], r["ordinal"]): r for r in cut.collect()}
    assert [bytes(rows[1, i]["frame"]) for i in range(3000)] == many
    assert {k for k in rows if k[0] != 1} == {(2, 0), (2, 1), (5, 0)}
    assert bytes(rows[2, 1]["frame"]) == bad + many[1] and rows[2, 1]["at"] == len(many[0])
    own = frames.events(cut, wall_ms=lambda ts: (ts / 1_000_000).cast("long") + 7)
    assert own.count() == 3001 and {r[0] for r in own.select("ts_wall_ms").distinct().collect()} == {7}
    assert report.totals(captures.events(own.withColumn("_corrupt", F.lit(None).cast("string")))).count() == 1
    assert frames.events(cut.limit(0)).count() == 0
