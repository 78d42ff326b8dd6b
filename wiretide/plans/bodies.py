"""Messages by length, JSON schemas, parameters, findings and filters, over payloads made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import protocols as N
from ..functions import text as X
from ..operators import endpoints as P
from ..operators import filters, pairing, report
from ..sources import files
from ..sources import frames as R
from ..sources.captures import tables
from .registry import query

_FAKE = "GET /fake HTTP/1.1\r\nHost: no\r\n\r\n"


def _joined(rows, piece):
    """The pieces of each conversation in order of turn, as bytes."""
    parts = F.array_sort(F.collect_list(F.struct("turn", piece.alias("p"))))
    return rows.groupBy("conv_id").agg(F.encode(F.array_join(F.transform(parts, lambda x: x["p"]), ""), "UTF-8").alias("data"))


_SIZE = f"octet_length(encode(coalesce(text, ''))) + {len(_FAKE)}"


@query(f"SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS ordinal, 'POST' AS method, '/c/' || turn AS target, 'h' || turn AS host, CAST({_SIZE} AS INTEGER) AS body_bytes FROM conversations")
def http_messages(spark, sf_dir):
    """Requests whose bodies hold further request lines; every third is chunked."""
    (rows,) = tables(spark, sf_dir, "conversations")
    body = F.concat(F.lit(_FAKE), F.coalesce("text", F.lit("")))
    head = F.format_string("POST /c/%d HTTP/1.1\r\nHost: h%d\r\n", "turn", "turn")
    size = F.octet_length(body)
    chunks = F.concat(F.lit("Transfer-Encoding: chunked\r\n\r\n5\r\nGET /\r\n"), F.lower(F.hex(size - 5)), F.lit(";x=1\r\n"), F.substr(body, F.lit(6)), F.lit("\r\n0\r\nTrailer: t\r\n\r\n"))
    plain = F.concat(F.lit("content-length: "), size.cast("string"), F.lit("\r\n\r\n"), body)
    sent = _joined(rows, F.concat(head, F.when(F.col("turn") % 3 == 1, chunks).otherwise(plain)))
    each = sent.select("conv_id", F.posexplode(N.http1_requests(F.col("data"))).alias("ordinal", "r"))
    return each.select("conv_id", "ordinal", "r.method", "r.target", X.header_value(F.col("r.headers"), "host").alias("host"), F.length("r.body").alias("body_bytes"))


@query("SELECT conv_id, CAST(0 AS INTEGER) AS ordinal, sha256('AUTH') AS command_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER), sha256('SET k' || turn || ' ' || coalesce(text, '') || chr(13) || chr(10) || '*1' || chr(13) || chr(10) || '$4') FROM conversations")
def redis_messages(spark, sf_dir):
    """Commands whose values hold line ends and the marks of other commands, after a login."""
    (rows,) = tables(spark, sf_dir, "conversations")
    key = F.concat(F.lit("k"), F.col("turn").cast("string"))
    value = F.concat(F.coalesce("text", F.lit("")), F.lit("\r\n*1\r\n$4"))
    bulk = lambda x: F.concat(F.lit("$"), F.octet_length(x).cast("string"), F.lit("\r\n"), x, F.lit("\r\n"))
    sent = _joined(rows, F.concat(F.lit("*3\r\n$3\r\nSET\r\n"), bulk(key), bulk(value)))
    data = F.concat(F.lit(b"*2\r\n$4\r\nAUTH\r\n$7\r\nhunter2\r\n"), "data")
    each = sent.select("conv_id", F.posexplode(N.redis_commands(data)).alias("ordinal", "command"))
    return each.select("conv_id", "ordinal", F.sha2(F.encode("command", "ISO-8859-1"), 256).alias("command_sha256"))


def _bodies(spark, sf_dir):
    """Orders as JSON objects with members of every type; some are missing, null or secret."""
    (orders,) = tables(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    customer = F.struct(F.col("o_custkey").alias("key"), F.lit("hunter2").alias("api_key"), F.when(key % 2 == 0, F.lit(True)).alias("big"))
    tags = F.array(F.to_json(F.struct(F.lit(1).alias("n"))), F.to_json(F.struct(F.lit("x").alias("n"))))
    body = F.to_json(F.struct(key.alias("id"), F.col("o_totalprice").cast("double").alias("price"), F.col("o_orderstatus").alias("status"), F.when(key % 3 == 0, "5").alias("note"), customer.alias("customer"), F.array("o_orderpriority").alias("tags")))
    # A null member, and an array of objects whose member has two types.
    whole = F.concat(F.lit('{"none":null,"pair":['), F.array_join(tags, ","), F.lit("],"), F.substr(body, F.lit(2)))
    return orders.select("o_orderstatus", F.when(key % 5 == 0, "not json").otherwise(whole).alias("body"))


_OK = "FROM orders WHERE o_orderkey % 5 <> 0"
_VOTES = f"""SELECT '$' AS path, 'object' AS type, count(*) AS votes {_OK} UNION ALL SELECT '$.none', 'unknown', count(*) {_OK} UNION ALL SELECT '$.pair', 'array', count(*) {_OK} UNION ALL SELECT '$.pair[]', 'object', 2 * count(*) {_OK}
 UNION ALL SELECT '$.pair[].n', unnest(['integer', 'string']), count(*) {_OK} UNION ALL SELECT '$.id', 'integer', count(*) {_OK} UNION ALL SELECT '$.price', 'number', count(*) {_OK} UNION ALL SELECT '$.status', 'string', count(*) {_OK}
 UNION ALL SELECT '$.note', 'string', count(*) {_OK} AND o_orderkey % 3 = 0 UNION ALL SELECT '$.customer', 'object', count(*) {_OK} UNION ALL SELECT '$.customer.key', 'integer', count(*) {_OK} UNION ALL SELECT '$.customer.api_key', 'string', count(*) {_OK}
 UNION ALL SELECT '$.customer.big', 'boolean', count(*) {_OK} AND o_orderkey % 2 = 0 UNION ALL SELECT '$.tags', 'array', count(*) {_OK} UNION ALL SELECT '$.tags[]', 'string', count(*) {_OK}"""


@query(f"SELECT path, type, CAST(votes AS BIGINT) AS votes FROM ({_VOTES})")
def json_nested_types(spark, sf_dir):
    return P.json_nodes(_bodies(spark, sf_dir), [], "body").groupBy("path", "type").agg(F.count("*").alias("votes"))


@query(
    f"""WITH v AS ({_VOTES}), n AS (SELECT count(*) AS n {_OK}) SELECT path, CASE WHEN path = '$.none' THEN 'unknown' ELSE min(type) END AS type, CAST(sum(votes) AS BIGINT) AS samples,
 path <> '$' AND NOT path LIKE '%[]' AND sum(votes) >= CASE WHEN path LIKE '$.pair[]%' THEN 2 ELSE 1 END * any_value(n) AS required,
 CASE path WHEN '$.status' THEN (SELECT count(*) >= 5 AND count(DISTINCT o_orderstatus) BETWEEN 2 AND 20 {_OK}) WHEN '$.tags[]' THEN (SELECT count(*) >= 5 AND count(DISTINCT o_orderpriority) BETWEEN 2 AND 20 {_OK}) ELSE false END AS is_enum,
 CASE path WHEN '$.status' THEN (SELECT max(o_orderstatus) {_OK}) WHEN '$.tags[]' THEN (SELECT max(o_orderpriority) {_OK}) WHEN '$.note' THEN '5' WHEN '$.customer.api_key' THEN '<redacted>' WHEN '$.pair[].n' THEN 'x' WHEN '$.customer.big' THEN 'true' END AS example
 FROM v, n WHERE path NOT IN ('$.id', '$.price', '$.customer.key') GROUP BY path"""
)
def json_schema_tree(spark, sf_dir):
    tree = P.json_schema_tree(P.json_nodes(_bodies(spark, sf_dir), [], "body"), [])
    # The greatest text of a number depends on how it is printed, so members with many numbers are left to a test.
    return tree.where(~F.col("path").isin("$.id", "$.price", "$.customer.key"))


@query(
    """WITH c AS (SELECT c_mktsegment, count(*) AS calls FROM customer GROUP BY ALL), h AS (SELECT c_mktsegment, 'x-tenant' AS name, CAST(c_nationkey AS VARCHAR) AS value FROM customer UNION ALL SELECT c_mktsegment, 'authorization', 'Bearer ' || c_name FROM customer
 UNION ALL SELECT c_mktsegment, 'x-session-token', c_name FROM customer WHERE c_custkey % 2 = 0) SELECT c_mktsegment, name, count(*) AS samples, count(DISTINCT value) AS distinct_values, count(*) >= any_value(calls) AS required, CASE WHEN name = 'x-tenant' THEN max(value) ELSE '<redacted>' END AS example FROM h JOIN c USING (c_mktsegment) GROUP BY c_mktsegment, name"""
)
def header_params(spark, sf_dir):
    (customer,) = tables(spark, sf_dir, "customer")
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    sent = F.array(pair("Host", F.lit("h")), pair("X-Tenant", F.col("c_nationkey").cast("string")), pair("Authorization", F.concat(F.lit("Bearer "), "c_name")), F.when(F.col("c_custkey") % 2 == 0, pair("X-Session-Token", F.col("c_name"))))
    return P.header_params(customer.select("c_mktsegment", F.filter(sent, lambda h: h.isNotNull()).alias("headers")), ["c_mktsegment"])


_TOTALS = """count(*) AS calls, min({t}) AS first_seen, max({t}) AS last_seen, CAST(coalesce(sum(a) FILTER (a > 0), 0) AS BIGINT) AS total_request_bytes, CAST(coalesce(sum(a) FILTER (a > 0) // count(*) FILTER (a > 0), 0) AS BIGINT) AS avg_request_bytes,
 CAST(coalesce(sum(b) FILTER (b > 0), 0) AS BIGINT) AS total_response_bytes, CAST(coalesce(sum(b) FILTER (b > 0) // count(*) FILTER (b > 0), 0) AS BIGINT) AS avg_response_bytes"""


@query(f"SELECT event_type, {_TOTALS.format(t='event_id')} FROM (SELECT event_type, event_id, CAST(floor(value) AS BIGINT) AS a, CAST(event_id % 3 AS BIGINT) AS b FROM events) GROUP BY event_type")
def endpoint_totals(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    return P.endpoint_totals(events.select("event_type", "event_id", F.floor("value").alias("request_bytes"), (F.col("event_id") % 3).alias("response_bytes")), ["event_type"], "event_id")


@query(f"SELECT service, method, {_TOTALS.format(t='l_orderkey')} FROM (SELECT 'pkg.' || l_returnflag AS service, 'Do' || l_linestatus AS method, l_orderkey, CAST(l_linenumber - 1 AS BIGINT) AS a, CAST(l_orderkey % 4 AS BIGINT) AS b FROM lineitem WHERE l_linenumber <> 3) GROUP BY ALL")
def grpc_rollup(spark, sf_dir):
    (items,) = tables(spark, sf_dir, "lineitem")
    path = F.concat(F.lit("/pkg."), "l_returnflag", F.when(F.col("l_linenumber") == 3, "/a").otherwise(""), F.lit("/Do"), "l_linestatus")
    return P.grpc_rollup(items.select(path.alias("path"), "l_orderkey", (F.col("l_linenumber") - 1).alias("request_bytes"), (F.col("l_orderkey") % 4).alias("response_bytes")), time="l_orderkey")


_USERS, _PASSWORDS, _PEERS = ["admin", "root", "sa", "ann"], ["admin", "", "vizxv", "1234", "manager"], ["10.0.0.1", "8.8.8.8", "2001:4860::8", "fe80::1"]
_KNOWN = ", ".join(f"('{u}', '{p}')" for u, p in C.DEFAULT_CREDENTIALS)
_LOGIN = f"SELECT c_custkey, list_extract({_USERS}, CAST(c_custkey % 4 AS INTEGER) + 1) AS u, list_extract({_PASSWORDS}, CAST(c_custkey % 5 AS INTEGER) + 1) AS p, list_extract({_PEERS}, CAST(c_custkey // 2 % 4 AS INTEGER) + 1) AS ip FROM customer"


@query(f"WITH l AS ({_LOGIN}) SELECT c_custkey, 'default_credentials' AS kind, 'critical' AS severity FROM l WHERE (u, p) IN (VALUES {_KNOWN}) UNION ALL SELECT c_custkey, 'plaintext_credentials_on_public', 'high' FROM l WHERE ip IN ('8.8.8.8', '2001:4860::8')")
def login_findings(spark, sf_dir):
    (customer,) = tables(spark, sf_dir, "customer")
    pick = lambda of, n: F.get(F.array(*map(F.lit, of)), n.cast("int"))
    key = F.col("c_custkey")
    found = C.login_findings(pick(_USERS, key % 4), pick(_PASSWORDS, key % 5), pick(_PEERS, F.floor(key / 2) % 4))
    return customer.select("c_custkey", F.explode(found).alias("f")).select("c_custkey", "f.*")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey BETWEEN 64 AND 127 OR s_suppkey = 7 OR s_suppkey % 5 = 0")
def filter_cidr_v6(spark, sf_dir):
    """Networks of both families over addresses of four spellings."""
    (supplier,) = tables(spark, sf_dir, "supplier")
    n = F.col("s_suppkey")
    digits = F.lower(F.hex(n))
    ip = F.when(n % 5 == 0, F.concat(F.lit("::ffff:10.9.0."), (n % 200).cast("string"))).when(n % 2 == 0, F.concat(F.lit("2001:DB8::"), digits)).otherwise(F.concat(F.lit("2001:db8:0:0:0:0:0:"), digits))
    return supplier.where(X.in_cidr(ip, "2001:db8::40/122") | X.in_cidr(ip, "2001:db8::7/128") | X.in_cidr(ip, "10.9.0.0/16")).select("s_suppkey")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name || '[' ELSE '' END || CASE WHEN s_suppkey % 2 = 0 THEN '10.0.0.1' ELSE '[2001:db8::1]' END || CASE WHEN s_suppkey % 3 = 0 THEN ']' ELSE '' END || ':' || s_suppkey AS shown FROM supplier")
def endpoint_display(spark, sf_dir):
    (supplier,) = tables(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    name = F.when(key % 3 == 0, F.col("s_name")).when(key % 3 == 1, "10.0.0.1")
    ip = F.when(key % 2 == 0, F.when(key % 4 == 0, "10.0.0.1").otherwise("::ffff:10.0.0.1")).otherwise("2001:db8::1")
    return supplier.select("s_suppkey", X.shown_endpoint(F.when((key % 3 == 1) & (key % 2 == 1), None).otherwise(name), ip, key).alias("shown"))


@query("SELECT c_custkey, lpad(lower(hex(CAST(list_reduce(list_prepend(CAST(14695981039346656037 AS UHUGEINT), list_transform(range(1, length(c_name) + 1), lambda i: CAST(ascii(substr(c_name, i, 1)) AS UHUGEINT))), lambda h, b: xor(h, b) * 1099511628211 % CAST(18446744073709551616 AS UHUGEINT)) AS UBIGINT))), 16, '0') AS fnv FROM customer")
def fnv64_names(spark, sf_dir):
    (customer,) = tables(spark, sf_dir, "customer")
    return customer.select("c_custkey", X.fnv1a64(F.col("c_name")).alias("fnv"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '<redacted>' ELSE c_name END AS shown, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS label FROM customer")
def scrubbed_labels(spark, sf_dir):
    (customer,) = tables(spark, sf_dir, "customer")
    key, name = F.col("c_custkey"), F.col("c_name")
    text = F.when(key % 2 == 0, F.repeat(F.lit("eyJ_.-"), 11)).otherwise(name)
    protocol = F.when(key % 3 == 0, "redis").when(key % 3 == 1, "tls").otherwise("oracle")
    fields = F.when(key % 3 == 1, F.create_map(F.lit("sni"), name)).otherwise(F.create_map(F.lit("sid"), name))
    return customer.select("c_custkey", X.scrubbed(text).alias("shown"), C.peer_label(protocol, fields).alias("label"))


@query("SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_custkey <> 5")
def filter_pod(spark, sf_dir):
    orders, customer = tables(spark, sf_dir, "orders", "customer")
    events = orders.select("o_orderkey", F.col("o_custkey").alias("cgroup_id"), F.col("o_custkey").alias("tgid"))
    return filters.without_self(filters.in_pods(events, customer.select(F.col("c_custkey").alias("cgroup_id"), F.col("c_mktsegment").alias("pod")), "BUILDING"), own=5).select("o_orderkey")


@query("SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1")
def filter_cgroup(spark, sf_dir):
    supplier, nation = tables(spark, sf_dir, "supplier", "nation")
    cgroups = nation.select(F.col("n_nationkey").alias("cgroup_id"), F.concat(F.lit("/r"), F.col("n_regionkey").cast("string"), F.lit("/"), "n_name").alias("path"))
    return filters.in_cgroup(supplier.withColumnRenamed("s_nationkey", "cgroup_id"), cgroups, "/r1/").select("s_suppkey")


@query("SELECT doc_id, substr(text, 1, 10) AS text FROM documents")
def clipped_bodies(spark, sf_dir):
    (docs,) = tables(spark, sf_dir, "documents")
    return filters.clipped(docs.select("doc_id", "text"), "text", max_body=10)


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 90 SECOND")
def filter_since(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    return filters.since(events, X.seconds_of("1m 30s")).select("event_id")


@query("SELECT event_id, CAST(coalesce(sum(CAST(event_type = 'signup' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS incarnation FROM events")
def flow_incarnations(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    return filters.incarnations(events, ["user_id"], [F.asc("ts"), F.asc("event_id")], F.col("event_type") == "signup").select("event_id", "incarnation")


_CALLS = "SELECT *, event_type IN ('click', 'view') AS asks FROM events"


@query(f"SELECT event_id, request FROM (SELECT event_id, asks, CASE WHEN lag(asks) OVER w THEN lag(event_id) OVER w END AS request FROM ({_CALLS}) WINDOW w AS (PARTITION BY user_id, event_id % 3 ORDER BY ts, event_id)) WHERE NOT asks")
def correlated_responses(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    own = events.withColumns({"is_request": F.col("event_type").isin("click", "view"), "correlation": F.col("event_id") % 3})
    return pairing.answered(own, ["user_id", "correlation"], [F.asc("ts"), F.asc("event_id")], "event_id").select("event_id", "request")


@query(f"SELECT event_id, statement FROM (SELECT event_id, asks, last_value(CASE WHEN asks THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id, event_id % 3 ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS statement FROM ({_CALLS})) WHERE NOT asks")
def prepared_statements(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    own = events.withColumns({"is_request": F.col("event_type").isin("click", "view"), "statement_id": F.col("event_id") % 3})
    return pairing.prepared(own, ["user_id", "statement_id"], [F.asc("ts"), F.asc("event_id")], "event_id").select("event_id", "statement")


def _le(value, size):
    """A number as little-endian hex digits."""
    digits = F.lpad(F.hex(value.cast("long")), 16, "0")
    return F.concat(*(F.substring(digits, 15 - 2 * k, 2) for k in range(size)))


_KIND = "list_extract(['conn_start', 'conn_end', 'tcp_data', 'tls_data', 'dns', 'sqlite'], CAST(o_orderkey % 6 AS INTEGER) + 1)"


@query(
    f"""WITH o AS (SELECT *, o_orderkey % 6 AS k, o_orderkey % 11 <> 0 AS fine, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n, ':' || (o_orderkey % 60000) AS sport FROM orders)
 SELECT o_custkey, CAST(n AS INTEGER) AS ordinal, CASE WHEN NOT fine THEN 'version' END AS fault, CASE WHEN fine THEN {_KIND} END AS kind, CASE WHEN fine THEN o_custkey END AS tgid, CASE WHEN fine THEN 'c' || o_orderkey END AS comm,
 CASE WHEN fine THEN CASE WHEN k IN (0, 4) THEN '10.0.0.1' || sport WHEN k = 2 THEN '[2001:db8::' || lower(hex(o_custkey % 60000 + 1)) || ']' || sport END END AS src, CASE WHEN fine THEN CASE k WHEN 0 THEN '10.0.' || (o_custkey // 256 % 256) || '.' || (o_custkey % 256) || ':443' WHEN 2 THEN '10.0.0.9:80' WHEN 4 THEN '8.8.8.8:53' END END AS dst,
 CASE WHEN fine AND k IN (0, 1, 2) THEN o_orderkey END AS sock_id, CASE WHEN fine AND k IN (2, 3, 4) THEN 1000 + o_orderkey % 7 END AS total_bytes, CASE WHEN fine AND k = 1 THEN o_custkey * 4294967296 END AS bytes_sent,
 CASE WHEN fine AND k IN (2, 3, 4) THEN o_orderpriority END AS data, CASE WHEN fine AND k = 5 THEN 'SELECT ' || o_orderpriority END AS sql FROM o"""
)
def binary_frames(spark, sf_dir):
    """Each customer's orders as frames of every kind in one blob; some have another version."""
    (orders,) = tables(spark, sf_dir, "orders")
    key, customer, text = F.col("o_orderkey"), F.col("o_custkey"), F.hex(F.encode("o_orderpriority", "UTF-8"))
    sport, size, total = _le(key % 60000, 2), (F.length(text) / 2).cast("long"), F.lit(1000) + key % 7
    zeros = lambda n: F.lit("00" * n)
    ip4 = lambda digits: F.concat(digits, zeros(12))
    own = ip4(F.lit("0A000001"))
    own6 = F.concat(F.lit("20010DB8"), zeros(10), F.lpad(F.hex(customer % 60000 + 1), 4, "0"))
    sql = F.concat(F.hex(F.lit("SELECT ")), text, F.lit("0058"))
    payloads = [
        F.concat(F.lit("06020000"), sport, F.lit("01BB"), own, ip4(F.concat(F.lit("0A00"), F.lpad(F.hex(customer % 65536), 4, "0"))), _le(key, 8)),
        F.concat(_le(key, 8), _le(customer * F.lit(1 << 32), 8), zeros(16)),
        F.concat(F.lit("06010A00"), sport, F.lit("0050"), own6, zeros(10), F.lit("FFFF0A000009"), _le(key, 8), _le(total, 4), _le(size, 4), text),
        F.concat(F.lit("0100"), zeros(6), _le(key, 8), F.lit("FFFFFFFF"), _le(total, 4), _le(size, 4), zeros(4), text),
        F.concat(F.lit("00020000"), sport, _le(F.lit(53), 2), own, ip4(F.lit("08080808")), _le(total, 2), _le(size, 2), text),
        F.concat(F.lit("01"), zeros(7), _le(key, 8), F.lit("FFFFFFFF"), _le(F.length(sql) / 2, 4), sql),
    ]
    kinds = [1, 2, 3, 4, 5, 8]
    pick = lambda of: F.get(F.array(*of), (key % 6).cast("int"))
    payload = pick(payloads)
    comm = F.rpad(F.hex(F.encode(F.concat(F.lit("c"), key.cast("string")), "UTF-8")), 32, "0")
    head = F.concat(F.when(key % 11 == 0, "02").otherwise("01"), _le(pick([F.lit(k) for k in kinds]), 1), zeros(2), _le(F.length(payload) / 2 + R.HEADER, 4), zeros(8), _le(key, 8), zeros(4), _le(customer, 4), zeros(24), comm)
    made = orders.select("o_custkey", "o_orderkey", F.concat(head, payload).alias("digits"))
    pieces = F.array_sort(F.collect_list(F.struct("o_orderkey", "digits")))
    blobs = made.groupBy("o_custkey").agg(F.unhex(F.array_join(F.transform(pieces, lambda x: x["digits"]), "")).alias("content"))
    told = R.decoded(R.split(blobs)).select("o_custkey", "ordinal", "fault", "event.*")
    return told.select("o_custkey", "ordinal", "fault", "kind", "tgid", "comm", "src", "dst", F.col("sock_id").cast("long").alias("sock_id"), "total_bytes", F.col("bytes_sent").cast("long").alias("bytes_sent"), F.unbase64("data_b64").cast("string").alias("data"), "sql")


@query(
    """WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS path, o_custkey, o_orderkey || ' ' || o_orderpriority AS line, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) * 2 - 1 AS line_no FROM orders)
 SELECT path, line_no, line, CAST(NULL AS VARCHAR) AS broken FROM o UNION ALL SELECT path, max(line_no) + 2, NULL, 'gzip' FROM o WHERE o_custkey % 3 = 1 AND o_custkey % 10 = 7 GROUP BY path"""
)
def sniffed_files(spark, sf_dir):
    """Each customer's orders as lines of a file: plain, gzip (stored, some without its end) or zstandard (raw blocks)."""
    (orders,) = tables(spark, sf_dir, "orders")
    pieces = F.array_sort(F.collect_list(F.struct("o_orderkey", F.concat_ws(" ", "o_orderkey", "o_orderpriority").alias("line"))))
    text = F.encode(F.array_join(F.transform(pieces, lambda x: F.concat(x["line"], F.lit("\n\n"))), ""), "UTF-8")
    made = orders.groupBy("o_custkey").agg(text.alias("text"))
    key, size = F.col("o_custkey"), F.octet_length("text")
    end = F.when(key % 10 == 7, "").otherwise(F.concat(_le(F.crc32("text"), 4), _le(size, 4)))
    gzip = F.concat(F.lit("1F8B08000000000000FF01"), _le(size, 2), _le(65535 - size, 2), F.hex("text"), end)
    zstd = F.concat(F.lit("28B52FFDA0"), _le(size, 4), _le(size * 8 + 1, 3), F.hex("text"))
    packed = F.when(key % 3 == 1, F.unhex(gzip)).when(key % 3 == 2, F.unhex(zstd)).otherwise(F.col("text"))
    return files.lines(made.select(key.cast("string").alias("path"), packed.alias("content")))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN CASE WHEN p_partkey % 3 > 0 THEN 'docs' END ELSE 'b' || p_size END AS bucket, CASE WHEN p_partkey % 4 = 3 AND p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN p_name || '/x' ELSE repeat('k', 512) END AS key,
 CASE WHEN p_partkey % 2 = 0 THEN 'AKIA' || p_partkey END AS key_id, CASE WHEN p_partkey % 2 = 0 THEN 'eu-west-' || (p_size % 3) END AS region, CASE WHEN p_partkey % 2 = 0 THEN 's3' END AS service FROM part"""
)
def s3_objects(spark, sf_dir):
    """Requests for objects and buckets: named by host in two ways, or by path in two ways, half of them signed."""
    (part,) = tables(spark, sf_dir, "part")
    key, bucket = F.col("p_partkey"), F.concat(F.lit("b"), F.col("p_size").cast("string"))
    rest = F.when(key % 3 == 0, "").when(key % 3 == 1, F.concat("p_name", F.lit("/x"))).otherwise(F.repeat(F.lit("k"), 600))
    host = F.when(key % 4 == 0, F.concat(F.upper(bucket), F.lit(".s3.amazonaws.com"))).when(key % 4 == 1, F.concat(bucket, F.lit(".s3.eu-west-1.amazonaws.com"))).otherwise("s3.amazonaws.com")
    path = F.when(key % 4 <= 1, F.concat(F.lit("/"), rest)).when(key % 4 == 2, F.concat(F.lit("/"), bucket, F.when(rest == "", "").otherwise(F.concat(F.lit("/"), rest)))).when(key % 3 > 0, F.concat(F.lit("//docs/"), rest)).otherwise("/")
    signed = F.concat(F.lit("AWS4-HMAC-SHA256 Credential=AKIA"), key.cast("string"), F.lit("/20240101/eu-west-"), (F.col("p_size") % 3).cast("string"), F.lit("/s3/aws4_request, SignedHeaders=host"))
    found = part.select("p_partkey", C.s3_object(host, path).alias("o"), C.sigv4_scope(F.when(key % 2 == 0, signed).otherwise("Bearer x")).alias("s"))
    return found.select("p_partkey", "o.*", "s.*")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN 'f' || o_custkey END AS field, CASE o_orderkey % 5 WHEN 1 THEN 'mutation' WHEN 4 THEN NULL ELSE 'query' END AS kind FROM orders")
def graphql_fields(spark, sf_dir):
    """Shorthand, named and commented operations, one that begins with a fragment, and bodies that are none."""
    (orders,) = tables(spark, sf_dir, "orders")
    key, field = F.col("o_orderkey"), F.concat(F.lit("f"), F.col("o_custkey").cast("string"))
    text = F.when(key % 5 == 0, F.concat(F.lit("{ , "), field, F.lit("(id: 1) { name } }"))).when(key % 5 == 1, F.concat(F.lit("mutation Add($x: Int) @live {\n"), field, F.lit(" other }")))
    text = text.when(key % 5 == 2, F.concat(F.lit("# { no }\nquery Get { # {\n"), field, F.lit("}"))).when(key % 5 == 3, "query { ...Part }")
    body = F.when(key % 5 == 4, F.concat(F.lit('{"text": "{ '), field, F.lit(' }"}'))).otherwise(F.to_json(F.struct(text.alias("query"))))
    return orders.select("o_orderkey", C.graphql_field(body).alias("field"), C.graphql_kind(body).alias("kind"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 6")
def top_protocols(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    return report.top_protocols(events, "event_type")
