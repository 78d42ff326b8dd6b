"""A small capture from its lines to reports, flows and messages."""

import base64
import gzip
import json

import pytest
from pyspark.sql import functions as F

from wiretide.functions import protocols as P
from wiretide.functions import text as X
from wiretide.operators import edges, flows, report
from wiretide.sources import captures
from wiretide.streaming import live

BASE = {"uid": 0, "gid": 0, "cpu": 0, "cgroup_id": 7}


def b64(data: bytes) -> str:
    return base64.b64encode(data).decode()


REQUEST = b"GET /users/42?a=1 HTTP/1.1\r\nHost: api.x\r\n\r\n"
RESPONSE = b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nok"
DNS = b"\x12\x34\x01\x00\x00\x01\x00\x00\x00\x00\x00\x00\x07example\x03com\x00\x00\x01\x00\x01"
BIG = 2**64 - 1
EVENTS = [
    {"ts_ns": 1000, "ts_wall_ms": 1700000000000, "kind": "conn_start", "pid": 101, "tgid": 100, "comm": "curl", "direction": "tx", "sock_id": BIG, "protocol": 6, "src": "10.0.0.1:40000", "dst": "10.0.0.2:80"},
    {"ts_ns": 2000, "ts_wall_ms": 1700000000100, "kind": "tcp_data", "pid": 101, "tgid": 100, "comm": "curl", "sock_id": BIG, "direction": "tx", "protocol": 6, "src": "10.0.0.1:40000", "dst": "10.0.0.2:80", "total_bytes": 43, "data_b64": b64(REQUEST)},
    {"ts_ns": 3000, "ts_wall_ms": 1700000000180, "kind": "tcp_data", "pid": 101, "tgid": 100, "comm": "curl", "sock_id": BIG, "direction": "rx", "protocol": 6, "src": "10.0.0.1:40000", "dst": "10.0.0.2:80", "total_bytes": 40, "data_b64": b64(RESPONSE)},
    {"ts_ns": 4000, "ts_wall_ms": 1700000000200, "kind": "conn_end", "pid": 101, "tgid": 100, "comm": "curl", "sock_id": BIG, "bytes_sent": 43, "bytes_recv": 40, "rtt_us": 250},
    {"ts_ns": 5000, "ts_wall_ms": 1700000001000, "kind": "tcp_data", "pid": 200, "tgid": 200, "comm": "dig", "sock_id": 9, "direction": "tx", "protocol": 17, "src": "10.0.0.1:5000", "dst": "8.8.8.8:53", "total_bytes": 29, "data_b64": b64(DNS)},
    {"ts_ns": 6000, "ts_wall_ms": 1700000001500, "kind": "tls_data", "pid": 300, "tgid": 300, "comm": "app", "conn_id": 77, "direction": "rx", "tls_lib": "openssl", "socket_fd": -1, "total_bytes": 5, "data_b64": b64(b"hello")},
    {"ts_ns": 7000, "ts_wall_ms": 1700000002000, "kind": "sqlite", "pid": 400, "tgid": 400, "comm": "sqlite3", "api": "exec", "db_handle": 12345, "sql_total_bytes": None, "sql": "SELECT 1"},
    {"ts_ns": 8000, "ts_wall_ms": 1700000002500, "kind": "tcp_data", "pid": 100, "tgid": 100, "comm": "curl", "sock_id": 11, "direction": "tx", "protocol": 6, "src": "[2001:db8::1]:41000", "dst": "[2001:db8::2]:443", "total_bytes": 100, "data_b64": ""},
]
LINES = [json.dumps(BASE | e) for e in EVENTS[:7]] + ["not json", "", json.dumps(BASE | EVENTS[7])]


@pytest.fixture(scope="module", params=["jsonl", "jsonl.gz"])
def lines(request, spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("capture") / f"c.{request.param}"
    path.write_bytes(gzip.compress("\n".join(LINES).encode()) if request.param.endswith("gz") else "\n".join(LINES).encode())
    return captures.read_lines(spark, str(path)).cache()


def test_summary(lines):
    assert tuple(report.quality(lines).first()) == (9, 1)
    events = captures.events(lines)
    assert [tuple(r) for r in report.kinds(events).collect()] == [("tcp_data", 4), ("conn_end", 1), ("conn_start", 1), ("sqlite", 1), ("tls_data", 1)]
    assert report.span(events).first()["duration_ms"] == 2500
    assert sorted(tuple(r) for r in report.processes(events).collect()) == [(100, "curl", 5, 143, 40), (200, "dig", 1, 29, 0), (300, "app", 1, 0, 5), (400, "sqlite3", 1, 0, 0)]
    assert [tuple(r) for r in report.peers(events).collect()] == [("[2001:db8::2]:443", 1, 100, 0), ("10.0.0.2:80", 3, 43, 40), ("8.8.8.8:53", 1, 29, 0)]
    assert [int(v) for v in report.totals(events).first()] == [172, 45, 43, 40]
    assert int(events.agg(F.max("sock_id")).first()[0]) == BIG


def test_faults(spark):
    rows = [json.dumps(BASE | e) for e in ({"ts_ns": 1, "kind": "dns", "pid": 1, "tgid": 1, "comm": "x"}, {"ts_ns": 1, "kind": "proc_exec", "pid": 1, "tgid": 1, "comm": "x"}, {"ts_ns": 1, "kind": "tls_data", "pid": 1, "tgid": 1, "comm": "x", "tls_lib": "odd"}, {"ts_ns": 1, "kind": "conn_end", "pid": 1, "tgid": 1, "comm": "x"}, {"kind": "conn_end"})]
    schema = captures.T.StructType([*captures.EVENT.fields, captures.T.StructField("_corrupt", captures.T.StringType())])
    parsed = spark.createDataFrame([(r,) for r in rows], "line string").select(F.from_json("line", schema).alias("e")).select("e.*")
    assert [r[0] for r in parsed.select(captures.fault()).collect()] == ["missing", "unknown", "unknown", None, "missing"]


def test_written_captures_read_back(lines, spark, tmp_path):
    events = captures.events(lines)
    captures.write(events, str(tmp_path / "out"), "gzip")
    again = captures.events(captures.read_lines(spark, str(tmp_path / "out")))
    assert sorted(map(str, again.select(*events.columns).collect())) == sorted(map(str, events.collect()))


def test_flows_and_messages(lines):
    packets = flows.payloads(captures.events(lines))
    streams = flows.streams(packets).cache()
    assert {(r["flow"]["tgid"], r["l7"]) for r in streams.collect()} == {(100, "http1"), (200, "dns"), (300, "unknown")}
    (call,) = flows.http_exchanges(streams).collect()
    assert (call["method"], call["target"], call["host"], call["status"], call["peer"]) == ("GET", "/users/42?a=1", "api.x", 200, "10.0.0.2")
    (question,) = flows.dns_records(packets).collect()
    assert (question["id"], question["is_response"], question["name"], question["type"]) == (0x1234, False, "example.com", "A")
    seg = {r["ts_ns"]: (r["tcp_seq"], r["tcp_ack"]) for r in flows.segments(packets).collect()}
    assert seg[2000] == (1, 1) and seg[3000] == (1, 1 + len(REQUEST))


def test_split_packets_give_the_same_messages(spark):
    both = REQUEST * 2 + b"POST /x HTTP/1.1\r\nA: b\r\n\r\n"
    cuts = [0, 5, 30, 31, len(REQUEST), len(both)]
    rows = [("f", i, 0, "tx", both[a:b], "1.2.3.4:9") for i, (a, b) in enumerate(zip(cuts, cuts[1:]))] + [("f", 9, 1, "rx", RESPONSE + b"HTTP/1.1 404 Not Found\r\n\r\n", "1.2.3.4:9")]
    packets = spark.createDataFrame(rows, "flow string, ts_ns int, seq int, direction string, data binary, dst string")
    got = [(r["method"], r["target"], r["status"]) for r in flows.http_exchanges(flows.streams(packets)).orderBy("ordinal").collect()]
    assert got == [("GET", "/users/42?a=1", 200), ("GET", "/users/42?a=1", 404), ("POST", "/x", None)]


VECTORS = [
    (b"\xc3\x00\x00\x00\x01abc", "quic"), (b"\x16\x03\x01\x02\x00\x01", "tls"), (b"PRI * HTTP/2.0\r\n\r\nSM\r\n\r\n", "http2"), (b"HTTP/1.1 200 OK", "http1"), (b"DELETE /x HTTP/1.1\r\n", "http1"), (b"SUB a 1\r\n", "nats"),
    (b"*1\r\n$4\r\nPING\r\n", "redis"), (b"\x80\x01\x00\x00", "memcached"), (b"\x10\x0c\x00\x04MQTT\x04\x02\x00\x3c", "mqtt"), (b"\x04\x00\x00\x00\x01\x00\x00\x00\x10", "cassandra"),
    (b"\x20\x00\x00\x00\x01\x00\x00\x00\x00\x00\x00\x00\xdd\x07\x00\x00", "mongodb"), (b"\x00\x00\x00\x08\x04\xd2\x16\x2f", "postgres"), (b"\x00\x00\x00\x20\x00\x03\x00\x00user", "postgres"), (b"\x00\x00\x00\x20\x00\x12\x00\x00\x00\x00\x00\x01", "kafka"), (b"abc", None), (b"zzzz", None), (b"", None),
]


def test_signatures(spark):
    rows = spark.createDataFrame([(i, bytearray(b)) for i, (b, _) in enumerate(VECTORS)], "i int, b binary")
    got = {r[0]: r[1] for r in rows.select("i", P.by_bytes(F.col("b"))).collect()}
    assert [got[i] for i in range(len(VECTORS))] == [v for _, v in VECTORS]
    ports = {r[0]: r[1] for r in spark.createDataFrame([(80,), (5353,), (1,), (None,)], "p int").select("p", P.detect(F.col("p"), F.lit(b"zzzz"), F.lit(b"HTTP/1.1"))).collect()}
    assert ports == {80: "http1", 5353: "mdns", 1: "http1", None: "http1"}


def test_small_decoders(spark):
    one = spark.range(1)
    got = one.select(
        P.redis_commands(F.lit(b"*2\r\n$3\r\nGET\r\n$1\r\nk\r\n*1\r\n$4\r\nPING\r\n")), P.protobuf_varint(F.lit(b"\x2a")), P.protobuf_varint(F.lit(b"\xac\x02\x07")), P.protobuf_varint(F.lit(b"\xff")),
        X.fnv1a32(F.lit("a")), X.humanised(F.lit(1536)), X.humanised(F.lit(1)), X.age(F.lit(3700)), X.base64_lenient(F.lit("aGVs bG8-!=zz")).cast("string"), X.base64_strict(F.lit("a!b")), X.is_private(F.lit("fe80::1")), X.is_private(F.lit("8.8.8.8")), X.is_private(F.lit("::ffff:10.1.1.1")),
    ).first()
    assert list(got)[:8] == [["GET k", "PING"], 42, 300, None, 0xE40C292C, "1.5 KiB", "1 B", "1h"]
    assert list(got)[9:] == [None, True, False, True]


def test_secrets_are_masked_and_urls_decoded_in_part(spark):
    auth = b"*2\r\n$4\r\nauth\r\n$7\r\nhunter2\r\n*5\r\n$5\r\nHELLO\r\n$1\r\n3\r\n$4\r\nAUTH\r\n$1\r\nu\r\n$7\r\nhunter2\r\n*2\r\n$3\r\nGET\r\n$4\r\nAUTH\r\n"
    web = b"GET / HTTP/1.1\r\nHost: h\r\nAuthorization: Basic aHVudGVyMg==\r\ncookie: a=hunter2\r\n\r\n"
    redis, http, text = spark.range(1).select(P.redis_commands(F.lit(auth)), P.http1_requests(F.lit(web)), X.url_decoded(F.lit("a%20b%zz+c%"))).first()
    assert redis == ["auth", "HELLO 3 AUTH u <redacted>", "GET AUTH"] and text == "a b%zz c%"
    assert [tuple(h) for h in http[0]["headers"]] == [("Host", "h"), ("Authorization", "<redacted>"), ("cookie", "<redacted>")]


def test_http_walks_by_length(spark):
    fake = b"GET /no HTTP/1.1\r\nHost: x\r\n\r\n"
    asked = b"junk" + b"POST /a HTTP/1.1\r\nContent-Length: %d\r\n\r\n" % len(fake) + fake + b"PUT /b HTTP/1.1\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nGET\r\n1;a=b\r\n \r\n0\r\n\r\nGET /c HTTP/1.1\r\n\r\nHEAD /cut HTTP/1.1\r\nA: b\r\n"
    said = b"HTTP/1.1 204 No Content\r\n\r\nHTTP/1.1 200 OK\r\ncontent-length: 17\r\n\r\nHTTP/1.1 500 No\r\nHTTP/1.1 200\r\nTransfer-Encoding: gzip, Chunked\r\n\r\n2\r\nok\r\n0\r\nT: u\r\n\r\nHTTP/1.0 200 OK\r\n\r\nto the end"
    own = spark.createDataFrame([(asked, said), (b"", b""), (None, None)], "a binary, b binary")
    got = own.select(P.http1_requests(F.col("a")).alias("a"), P.http1_responses(F.col("b")).alias("b")).collect()
    assert [(r["method"], r["target"], r["body"]) for r in got[0]["a"]] == [("POST", "/a", fake.decode()), ("PUT", "/b", "GET "), ("GET", "/c", "")]
    assert [(r["status"], r["body"]) for r in got[0]["b"]] == [(204, ""), (200, "HTTP/1.1 500 No\r\n"), (200, "ok"), (200, "to the end")]
    assert tuple(got[1]) == ([], []) and tuple(got[2]) == (None, None)


def test_redis_reads_by_length(spark):
    data = b"*2\r\n$3\r\nGET\r\n$4\r\na\r\nb\r\n+junk\r\n*1\r\n$4\r\nPING\r\n*2\r\n$3\r\nGET\r\n$99\r\ncut"
    own = spark.createDataFrame([(data,), (b"",), (b"*999999999\r\n$1\r\na\r\n",), (None,)], "d binary")
    assert [r[0] for r in own.select(P.redis_commands(F.col("d"))).collect()] == [["GET a\r\nb", "PING"], [], [], None]


def test_addresses_of_both_families(spark):
    keys = {"::": "0" * 32, "::1": "0" * 31 + "1", "1.2.3.4": "0" * 20 + "ffff01020304", "::ffff:1.2.3.4": "0" * 20 + "ffff01020304", "2001:DB8::a:0:1": "20010db8000000000000000a00000001", "1:2:3:4:5:6:7:8": "00010002000300040005000600070008"}
    bad = ["1:2:3", "::1::", "1:2:3:4:5:6:7:8:9", "12345::", "x", "1.2.3.400", "", "1:2:3:4::5:6:7:8", ":1:2:3:4:5:6:7"]
    own = spark.createDataFrame([(k,) for k in [*keys, *bad]], "ip string")
    got = {r[0]: r[1] for r in own.select("ip", X.ip_key(F.col("ip"))).collect()}
    assert got == keys | dict.fromkeys(bad)
    hits = [r[0] for r in own.where(X.in_cidr(F.col("ip"), "2001:db8::/32") | X.in_cidr(F.col("ip"), "1.2.0.0/16")).collect()]
    assert sorted(hits) == ["1.2.3.4", "2001:DB8::a:0:1", "::ffff:1.2.3.4"]


def test_json_bodies(spark):
    from wiretide.operators import endpoints

    rows = ['{"name":"a","age":1,"note":"7"}', '{"name":"b","age":2,"admin":true,"id":"123e4567-e89b-12d3-a456-426614174000","password":{"x":1}}', "no", None, '[{"a":1.5},{"a":null}]', '"text"', '{"name":"c","age":9999999999999999999}']
    own = spark.createDataFrame([("k", r) for r in rows], "k string, body string")
    nodes = endpoints.json_nodes(own, ["k"], "body")
    got = {r["path"]: (r["type"], r["samples"], r["required"], r["example"]) for r in endpoints.json_schema_tree(nodes, ["k"]).collect()}
    assert got["$.name"] == ("string", 3, True, "c") and got["$.age"][:3] == ("integer", 3, True) and got["$.admin"] == ("boolean", 1, False, "true")
    assert got["$.id"][0] == "uuid" and got["$.password"] == ("string", 1, False, "<redacted>") and "$.password.x" not in got and got["$.note"][0] == "string"
    assert got["$[].a"] == ("number", 2, True, "1.5") and got["$"][:2] == ("object", 5)
    assert endpoints.json_nodes(own.limit(0), [], "body").count() == 0
    fields = {(r["name"], r["type"]) for r in endpoints.json_fields(own.limit(1), ["k"], "body").collect()}
    assert fields == {("name", "string"), ("age", "integer"), ("note", "string")}


def _bodies_of_all_kinds(spark):
    rows = ['{"a":{"b":[{"c":1},{"c":"x"}],"token":{"y":1}},"e":{},"f":[]}', "{}", "[[],[2]]", "null", "[" * 9 + "]" * 9, "no", None]
    return spark.createDataFrame([(None, r) for r in rows], "k string, body string")


def test_json_tree_reads_its_source_once(spark):
    from wiretide.operators import endpoints

    tree = endpoints.json_schema_tree(endpoints.json_nodes(_bodies_of_all_kinds(spark), ["k"], "body"), ["k"])
    plan = tree._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1
    # All nodes are shuffled as counts by text, before anything sorts them.
    assert "Sort" not in plan[plan.rindex("Exchange") :]
    got = {r["path"]: (r["type"], r["samples"], r["required"], r["example"]) for r in tree.collect()}
    # The key is null: such bodies are an endpoint, too.
    assert got["$.a"] == ("object", 1, False, None) and got["$.a.b"] == ("array", 1, True, None) and got["$.a.b[].c"] == ("integer", 2, True, "x") and got["$.a.token"] == ("string", 1, True, "<redacted>")


def test_json_nodes_parse_each_body_once(spark):
    from collections import Counter

    from wiretide.operators import endpoints

    nodes = endpoints.json_nodes(_bodies_of_all_kinds(spark), ["k"], "body")
    plan = nodes._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and plan.count("parseJson") == 1
    want = [(None, "$", "object", None), ("$", "$.a", "object", None), ("$.a", "$.a.b", "array", None), ("$.a.b", "$.a.b[]", "object", None), ("$.a.b", "$.a.b[]", "object", None), ("$.a.b[]", "$.a.b[].c", "integer", "1"), ("$.a.b[]", "$.a.b[].c", "string", "x")]
    want += [("$.a", "$.a.token", "string", "<redacted>"), ("$", "$.e", "object", None), ("$", "$.f", "array", None), (None, "$", "object", None), (None, "$", "unknown", None)]
    want += [(None, "$", "array", None), ("$", "$[]", "array", None), ("$", "$[]", "array", None), ("$[]", "$[][]", "integer", "2")]
    want += [("$" + "[]" * (n - 1) if n else None, "$" + "[]" * n, "array", None) for n in range(8)]
    assert Counter(tuple(r)[1:] for r in nodes.collect()) == Counter(want)


def test_sizes_and_durations():
    assert [X.size_of(t) for t in ("10", "10k", "1.5G", "2 MiB", "7b")] == [10, 10240, 1610612736, 2097152, 7]
    assert [X.seconds_of(t) for t in ("30s", "5m", "1h 30m", "250ms")] == [30, 300, 5400, 0.25]
    for bad in ("", "x", "1q"):
        with pytest.raises(ValueError):
            X.size_of(bad)
        with pytest.raises(ValueError):
            X.seconds_of(bad)


def test_report_as_json_and_edge_orders(lines, spark):
    got = json.loads(report.as_json(captures.events(lines)).first()["report"])
    assert set(got) == {"span", "totals", "kinds", "processes", "peers"} and got["span"][0]["duration_ms"] == 2500 and {"kind": "tcp_data", "n": 4} in got["kinds"]
    own = spark.createDataFrame([(1, 5, 1, 9, 0, "b", "x"), (2, 7, 2, 1, 1, "a", None), (3, 6, 2, 4, 4, "c", "w")], "k int, last_seen int, calls int, tx int, rx int, protocol string, label string")
    order = lambda *a: [r["k"] for r in report.sorted_edges(own, a[0], ["k"], *a[1:]).collect()]
    assert [order("last_seen"), order("calls"), order("bytes"), order("protocol"), order("peer"), order("calls", True)] == [[2, 3, 1], [2, 3, 1], [1, 3, 2], [2, 1, 3], [2, 3, 1], [1, 2, 3]]


def test_edges_keep_first_label_and_last_protocol(spark):
    rows = [(1, "p", True, 5, 0, "http1", None, 1, 1), (1, "p", True, 5, 2, None, "a", 2, 2), (1, "p", False, 0, 0, "tls", "b", 3, 3), (2, "q", False, 0, 0, None, None, 1, 4)]
    table = spark.createDataFrame(rows, "pid int, peer string, is_call boolean, tx long, rx long, protocol string, label string, ts int, seq int")
    got = {r["pid"]: r.asDict() for r in edges.service_edges(table, ["pid", "peer"]).collect()}
    assert got[1] == {"pid": 1, "peer": "p", "calls": 2, "tx": 10, "rx": 2, "first_seen": 1, "last_seen": 3, "protocol": "tls", "label": "a"}
    assert got[2]["protocol"] == "-" and {r["protocol"]: r["weight"] for r in edges.protocol_weights(edges.service_edges(table, ["pid", "peer"])).collect()} == {"tls": 2, "-": 1}
    assert json.loads(edges.ndjson(edges.service_edges(table, ["pid", "peer"]).where("pid = 1")).first()[0])["calls"] == 2


def test_streams_equal_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.jsonl").write_text("\n".join(LINES[k::3]))
    batch = report.processes(captures.events(captures.read_lines(spark, str(tmp_path / "in"))), top=None)
    seen = {}
    events = captures.events(captures.stream_lines(spark, str(tmp_path / "in"), 1))
    live.snapshots(report.processes(events, top=None), lambda df, n: seen.update({n: sorted(map(tuple, df.collect()))}), str(tmp_path / "c1"), once=True).awaitTermination()
    assert seen[max(seen)] == sorted(map(tuple, batch.collect()))
    live.append(live.rates(live.timed(events, "0 seconds"), "1 second", "kind"), str(tmp_path / "out"), str(tmp_path / "c2"), once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("events")).first()[0] >= 1


def test_packet_records(lines):
    import ipaddress
    import struct

    from wiretide.operators import packets

    got = {r["ts_ns"]: r["record"] for r in packets.records(flows.payloads(captures.events(lines))).collect()}
    data = got[3000]
    sec, usec, size, full = struct.unpack("<IIII", data[:16])
    assert (sec, usec, size, full) == (1700000000, 180000, len(data) - 16, len(data) - 16) and size == 40 + len(RESPONSE)
    ip, tcp = data[16:36], data[36:56]
    assert [str(ipaddress.ip_address(ip[k : k + 4])) for k in (12, 16)] == ["10.0.0.2", "10.0.0.1"]
    assert struct.unpack(">HHII", tcp[:12]) == (80, 40000, 1, 1 + len(REQUEST)) and data[56:] == RESPONSE
    assert len(packets.FILE_HEADER) == 24


def test_addresses(spark):
    import ipaddress

    from wiretide.operators import packets

    ips = ["10.0.0.1", "2001:db8::1", "::1", "1:2:3:4:5:6:7:8", "fe80::"]
    got = spark.createDataFrame([(i,) for i in ips], "ip string").select(packets.address(F.col("ip"))).collect()
    assert [bytes.fromhex(r[0]) for r in got] == [ipaddress.ip_address(i).packed for i in ips]


def test_bodies(spark):
    import zlib

    from wiretide.operators import bodies

    rows = [(5, "GET", "a.b:80", "/x/y?z", "text/html; charset=x", "GZIP", gzip.compress(b"hi")), (5, "GET", "a", "/d", None, "deflate", zlib.compress(b"yo")), (5, "GET", "a", "/e", "a/b", "gzip", b"damaged"), (5, "GET", "a", "/f", "a/b", None, b""), (5, "GET", "a", "/g", "a/b", None, None)]
    got = {r["name"]: bytes(r["content"]) for r in bodies.files(spark.createDataFrame(rows, "at_ms long, method string, host string, path string, content_type string, encoding string, body binary")).collect()}
    assert sorted(got.values()) == [b"damaged", b"hi", b"yo"]
    assert any(n.startswith("0000000000005_GET_a.b_80__x_y_") and n.endswith(".html") for n in got)


def test_stream_pairs(spark, tmp_path):
    schema = "flow string, id int, ts timestamp_ltz"
    for name, rows in (("q", [("f", 1, 10), ("f", 2, 20), ("g", 1, 30)]), ("a", [("f", 1, 11), ("f", 2, 900), ("h", 1, 12)])):
        spark.createDataFrame([(f, i, s) for f, i, s in rows], "flow string, id int, s int").select("flow", "id", F.timestamp_seconds("s").alias("ts")).write.parquet(str(tmp_path / name))
    q, a = (spark.readStream.schema(schema).parquet(str(tmp_path / n)).withWatermark("ts", "1 minute") for n in ("q", "a"))
    live.append(live.paired(q, a, ["flow", "id"], "5 minutes"), str(tmp_path / "out"), str(tmp_path / "c"), once=True).awaitTermination()
    got = [(r["flow"], r["id"], r["response_ts"].second) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert got == [("f", 1, 11)]


def test_openapi_and_proto_lines(spark):
    from wiretide.operators import protobuf, tools

    ends = spark.createDataFrame([("api.x", "/users/{id}", 2)], "host string, template string, calls long")
    params = spark.createDataFrame([("api.x", "/users/{id}", "id", "path", "integer", True), ("api.x", "/users/{id}", "a", "query", "string", False)], "host string, template string, name string, place string, type string, required boolean")
    text = "\n".join(r["text"] for r in tools.openapi_lines(ends, params).collect())
    assert text.index('"/users/{id}":') < text.index('{name: "id", in: path, required: true') < text.index('{name: "a", in: query, required: false')
    samples = spark.createDataFrame([(1, bytearray(b"\x08\x01")), (2, bytearray(b"\x08\x2a\x12\x02hi")), (3, bytearray(b"\xff"))], "sample int, content binary")
    fields = protobuf.profile(protobuf.decoded(samples))
    assert [r["text"] for r in protobuf.proto_lines(fields).collect()] == ['syntax = "proto3";', "message Inferred {", "  int32 field_1 = 1;", "  string field_2 = 2;", "}"]


def der(tag: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x82]) + len(body).to_bytes(2, "big")
    return bytes([tag]) + size + body


def make_certificate(subject: str, issuer: str, signature: bytes, bits: int, begin: bytes, end: bytes) -> bytes:
    named = lambda cn: der(0x30, der(0x31, der(0x30, der(6, b"\x55\x04\x03"), der(0x0C, cn.encode()))))
    algorithm = der(0x30, der(6, signature), der(5))
    key = der(0x30, der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01"), der(5)), der(3, b"\0", der(0x30, der(2, b"\0" + (1 << (bits - 1)).to_bytes(bits // 8, "big")), der(2, b"\1\0\1"))))
    san = der(0xA3, der(0x30, der(0x30, der(6, b"\x55\x1d\x11"), der(4, der(0x30, der(0x82, b"a.x"), der(0x82, b"b.x"))))))
    body = der(0x30, der(0xA0, der(2, b"\2")), der(2, b"\5"), algorithm, named(issuer), der(0x30, der(0x17, begin), der(0x17, end)), named(subject), key, san)
    return der(0x30, body, algorithm, der(3, b"\0sig"))


def test_certificates(spark):
    from wiretide.operators import certificates, enrich

    sha256, sha1 = b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x0b", b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x05"
    good = make_certificate("api.x", "ca", sha256, 2048, b"250101000000Z", b"251201000000Z")
    bad = make_certificate("self", "self", sha1, 1024, b"200101000000Z", b"240101000000Z")
    rows = spark.createDataFrame([(1, good), (2, bad), (3, b"junk"), (4, None), (5, good)], "id int, der binary")
    read = certificates.parsed(rows)
    got = {r["id"]: r for r in read.withColumn("odd", certificates.anomalies(F.lit("2025-06-01").cast("timestamp"))).collect()}
    x = got[1]["x509"]
    assert (x["subject_cn"], x["issuer_cn"], x["names"], x["rsa_bits"], x["signature"], x["self_signed"]) == ("api.x", "ca", 2, 2048, "1.2.840.113549.1.1.11", False)
    assert got[1]["odd"] == [] and got[3]["odd"] == [] and got[4]["odd"] == []
    assert got[2]["odd"] == ["self_signed", "weak_signature", "short_rsa_key", "not_valid_now", "long_validity"]
    assert certificates.first_of_each(read.where("der is not null")).count() == 3
    assert {r["id"] for r in enrich.unpinned(read, read.where("id = 1").select("sha256")).where("der is not null").collect()} == {2, 3}
