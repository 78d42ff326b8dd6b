"""Capture summaries, filters and service edges over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import edges as E
from ..operators import processes
from ..operators import report as R
from ..sources.captures import as_events, tables
from .registry import query

_DIR = "CASE WHEN event_type IN ('click','view') THEN 'tx' WHEN event_type IN ('purchase','signup') THEN 'rx' END"
_TX = "CAST(coalesce(sum(CAST(floor(value) AS BIGINT)) FILTER (event_type IN ('click','view')), 0) AS BIGINT)"
_RX = "CAST(coalesce(sum(CAST(floor(value) AS BIGINT)) FILTER (event_type IN ('purchase','signup')), 0) AS BIGINT)"
_IP = r"(?:^|[^0-9.])((?:[0-9]{1,3}\.){3}[0-9]{1,3})(?:[^0-9.]|$)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_events(tables(spark, sf_dir, "events")[0])


@query("SELECT event_type AS kind, count(*) AS n FROM events GROUP BY event_type")
def kind_histogram(spark, sf_dir):
    return R.kinds(events(spark, sf_dir))


@query("SELECT epoch_us(min(ts)) // 1000 AS first_ms, epoch_us(max(ts)) // 1000 AS last_ms, epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000 AS duration_ms FROM events")
def capture_span(spark, sf_dir):
    return R.span(events(spark, sf_dir).withColumn("ts_wall_ms", F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")))


@query(f"SELECT user_id AS tgid, count(*) AS events, {_TX} AS tx, {_RX} AS rx FROM events GROUP BY user_id ORDER BY events DESC, tgid LIMIT 20")
def top_processes(spark, sf_dir):
    return R.processes(events(spark, sf_dir), "tgid", top=20)


@query(f"SELECT user_id AS tgid, event_type AS kind, count(*) AS events, {_TX} AS tx, {_RX} AS rx FROM events GROUP BY ALL")
def process_kinds(spark, sf_dir):
    return R.processes(events(spark, sf_dir), "tgid", "kind", top=None)


@query(f"SELECT props AS peer, count(*) AS events, {_TX} AS tx, {_RX} AS rx FROM events WHERE props IS NOT NULL GROUP BY props ORDER BY tx + rx DESC, peer LIMIT 20")
def top_peers(spark, sf_dir):
    return R.peers(events(spark, sf_dir).withColumnRenamed("props", "peer"), "peer", top=20)


@query(f"SELECT {_TX} AS tx, {_RX} AS rx FROM events")
def direction_totals(spark, sf_dir):
    return R.totals(events(spark, sf_dir))


@query(f"SELECT event_id FROM events WHERE user_id IN (1, 2, 3, 5, 8, 13, 21) AND event_type IN ('click', 'purchase') AND floor(value) >= 5 AND {_DIR} = 'tx'")
def filter_and_or(spark, sf_dir):
    own = events(spark, sf_dir)
    return own.where(F.col("tgid").isin(1, 2, 3, 5, 8, 13, 21) & F.col("kind").isin("click", "purchase") & (F.col("total_bytes") >= 5) & (F.col("direction") == "tx")).select("event_id")


@query("SELECT c_custkey FROM customer WHERE c_name LIKE 'Customer#%1_5'")
def filter_glob(spark, sf_dir):
    (customer,) = tables(spark, sf_dir, "customer")
    return customer.where(X.glob(F.col("c_name"), "Customer#*1?5")).select("c_custkey")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey BETWEEN 10 AND 19 OR s_suppkey = 42 OR s_suppkey BETWEEN 70 AND 71")
def filter_port_ranges(spark, sf_dir):
    (supplier,) = tables(spark, sf_dir, "supplier")
    port = F.col("s_suppkey")
    return supplier.where(port.between(10, 19) | (port == 42) | port.between(70, 71)).select("s_suppkey")


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_IP), F.lit(1))).alias("ip"))


_ADDRESSES = f"SELECT doc_id, unnest(regexp_extract_all(text, '{_IP}', 1)) AS ip FROM documents"
_NUMBER = "CASE WHEN list_max(list_transform(string_split(ip, '.'), lambda x: CAST(x AS BIGINT))) <= 255 THEN list_reduce(list_transform(string_split(ip, '.'), lambda x: CAST(x AS BIGINT)), lambda a, b: a * 256 + b) END"


@query(f"SELECT doc_id, ip FROM (SELECT doc_id, ip, {_NUMBER} AS n FROM ({_ADDRESSES})) WHERE n BETWEEN 2147483648 AND 4294967295")
def filter_cidr(spark, sf_dir):
    return addresses(spark, sf_dir).where(X.in_cidr(F.col("ip"), "128.0.0.0/1"))


_RANGES = " OR ".join(f"n BETWEEN {a} AND {b}" for a, b in ((2130706432, 2147483647), (167772160, 184549375), (2886729728, 2887778303), (3232235520, 3232301055), (2851995648, 2852061183), (4294967295, 4294967295), (3221225984, 3221226239), (3325256704, 3325256959), (3405803776, 3405804031), (0, 0)))


@query(f"SELECT ip, count(*) AS n, coalesce(bool_or({_RANGES}), false) AS is_private FROM (SELECT ip, {_NUMBER} AS n FROM ({_ADDRESSES})) GROUP BY ip")
def private_ip_flags(spark, sf_dir):
    return addresses(spark, sf_dir).groupBy("ip").agg(F.count("*").alias("n")).withColumn("is_private", X.is_private(F.col("ip")))


@query("SELECT event_id, props FROM events WHERE contains(props, '42') ORDER BY event_id LIMIT 50")
def grep_events(spark, sf_dir):
    return events(spark, sf_dir).where(F.col("props").contains("42")).select("event_id", "props").orderBy("event_id").limit(50)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are processes, suppliers peers, order lines calls; returned lines were received."""
    line, order = tables(spark, sf_dir, "lineitem", "orders")
    size = F.col("l_quantity").cast("long")
    records = line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("pid"),
        F.col("l_suppkey").alias("peer"),
        F.lit(True).alias("is_call"),
        F.when(F.col("l_returnflag") != "R", size).otherwise(0).alias("tx"),
        F.when(F.col("l_returnflag") == "R", size).otherwise(0).alias("rx"),
        F.col("l_linestatus").alias("protocol"),
        F.col("o_orderpriority").alias("label"),
        F.col("l_shipdate").alias("ts"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"),
    )
    return E.service_edges(records, ["pid", "peer"])


_EDGES = """SELECT o_custkey AS pid, l_suppkey AS peer, count(*) AS calls,
 CAST(sum(CASE WHEN l_returnflag <> 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS tx, CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS rx,
 min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen, arg_max(l_linestatus, (l_shipdate, l_orderkey * 100 + l_linenumber)) AS protocol,
 arg_min(o_orderpriority, (l_shipdate, l_orderkey * 100 + l_linenumber)) AS label
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL"""
_FEW = ("pid", "peer", "calls", "tx", "rx")


@query(f"SELECT pid, peer, calls, tx, rx, first_seen, last_seen FROM ({_EDGES})")
def service_edges(spark, sf_dir):
    return edges(spark, sf_dir).select(*_FEW, "first_seen", "last_seen")


@query(f"SELECT protocol, CAST(sum(greatest(calls, 1)) AS BIGINT) AS weight FROM (SELECT o_orderstatus AS protocol, o_custkey, count(*) AS calls FROM orders GROUP BY ALL) GROUP BY protocol")
def edge_protocol_hist(spark, sf_dir):
    (order,) = tables(spark, sf_dir, "orders")
    return E.protocol_weights(order.groupBy(F.col("o_orderstatus").alias("protocol"), "o_custkey").agg(F.count("*").alias("calls")))


@query("SELECT DISTINCT 'source' AS side, CAST(o_custkey AS VARCHAR) AS vertex FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION SELECT DISTINCT 'target', CAST(l_suppkey AS VARCHAR) FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def edge_vertices(spark, sf_dir):
    line, order = tables(spark, sf_dir, "lineitem", "orders")
    return E.vertices(line.join(order, F.col("l_orderkey") == F.col("o_orderkey")), "o_custkey", "l_suppkey")


@query(f"SELECT pid, peer, calls, tx, rx, last_seen FROM ({_EDGES}) ORDER BY last_seen DESC, pid, peer LIMIT 40")
def edges_topk_by_lastseen(spark, sf_dir):
    return edges(spark, sf_dir).select(*_FEW, "last_seen").orderBy(F.desc("last_seen"), "pid", "peer").limit(40)


_NATION_EDGES = "SELECT c_nationkey AS pid, n_regionkey AS peer, count(*) AS calls, CAST(sum(CAST(floor(c_acctbal) AS BIGINT)) AS BIGINT) AS tx FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL"


@query(
    f"""WITH e AS ({_NATION_EDGES}), names(peer, q) AS (VALUES (0, 'q_350ca8af'), (1, 'q_340ca71c'), (2, 'q_370cabd5'), (3, 'q_360caa42'), (4, 'q_310ca263'))
 SELECT DISTINCT 'p' || pid || ' [shape=box];' AS line FROM e UNION ALL SELECT DISTINCT q || ' [label="' || peer || '", style=dashed];' FROM e JOIN names USING (peer)
 UNION ALL SELECT 'p' || pid || ' -> ' || q || ' [label="tcp ' || calls || 'c tx=' || tx || ' rx=0"];' FROM e JOIN names USING (peer)"""
)
def edge_dot_lines(spark, sf_dir):
    customer, nation = tables(spark, sf_dir, "customer", "nation")
    own = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("c_nationkey").alias("pid"), F.col("n_regionkey").alias("peer"))
    own = own.agg(F.count("*").alias("calls"), F.sum(F.floor("c_acctbal").cast("long")).alias("tx")).withColumns({"rx": F.lit(0), "protocol": F.lit("tcp")})
    return E.dot_lines(own, "pid", "peer")


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def enrich_left_join(spark, sf_dir):
    customer, nation, region = tables(spark, sf_dir, "customer", "nation", "region")
    named = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return named.select("c_custkey", "n_name", "r_name")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unknown_left_anti(spark, sf_dir):
    docs, labels = tables(spark, sf_dir, "documents", "labels")
    return docs.select("doc_id").join(labels, "doc_id", "left_anti")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def known_semi(spark, sf_dir):
    docs, labels = tables(spark, sf_dir, "documents", "labels")
    return docs.select("doc_id").join(labels.where("quality = 0"), "doc_id", "left_semi")


@query(
    "WITH RECURSIVE fork(parent, child) AS (SELECT n_regionkey, 100 + n_nationkey FROM nation UNION ALL SELECT 100 + c_nationkey, 1000 + c_custkey FROM customer), down(pid) AS (SELECT 2::BIGINT UNION SELECT f.child::BIGINT FROM fork f JOIN down d ON f.parent = d.pid) SELECT pid FROM down"
)
def fork_closure(spark, sf_dir):
    """All descendants of process 2."""
    nation, customer = tables(spark, sf_dir, "nation", "customer")
    first = nation.select(F.col("n_regionkey").alias("parent"), (F.col("n_nationkey") + 100).alias("child"))
    forks = first.union(customer.select((F.col("c_nationkey") + 100).alias("parent"), (F.col("c_custkey") + 1000).alias("child")))
    return processes.descendants(forks, spark.range(2, 3).withColumnRenamed("id", "pid"))


@query(
    """WITH RECURSIVE fork(parent, child) AS (SELECT l_suppkey % 50, 1000 + l_partkey FROM lineitem UNION SELECT 1000 + l_partkey, 100000 + l_orderkey FROM lineitem WHERE l_linenumber = 1 UNION SELECT 100000 + l_orderkey, l_suppkey % 50 FROM lineitem WHERE l_linenumber = 7),
 down(pid) AS (SELECT 3::BIGINT UNION SELECT f.child::BIGINT FROM fork f JOIN down d ON f.parent = d.pid) SELECT pid FROM down"""
)
def fork_cycles(spark, sf_dir):
    """Descendants in a graph with cycles and many parents for a process."""
    (items,) = tables(spark, sf_dir, "lineitem")
    part, order, supplier = F.col("l_partkey") + 1000, F.col("l_orderkey") + 100000, F.col("l_suppkey") % 50
    forks = items.select(supplier.alias("parent"), part.alias("child")).union(items.where("l_linenumber = 1").select(part, order)).union(items.where("l_linenumber = 7").select(order, supplier))
    return processes.descendants(forks, spark.range(3, 4).withColumnRenamed("id", "pid"))
