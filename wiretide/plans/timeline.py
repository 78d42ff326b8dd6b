"""Pairing, running positions, rates and sessions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import flows
from ..operators import pairing as P
from ..sources.captures import tables
from .registry import query

_ORD = "SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS ordinal FROM conversations WHERE role IN ('user', 'assistant')"


def _pairs(spark, sf_dir):
    (talk,) = tables(spark, sf_dir, "conversations")
    return P.by_ordinal(talk, ["conv_id"], ["turn"], "role", "user", "assistant", "turn")


@query(f"WITH o AS ({_ORD}) SELECT q.conv_id, CAST(q.ordinal AS INTEGER) AS ordinal, q.turn AS request, a.turn AS response FROM o q LEFT JOIN o a ON q.conv_id = a.conv_id AND q.ordinal = a.ordinal AND a.role = 'assistant' WHERE q.role = 'user'")
def request_response_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query(f"WITH o AS ({_ORD}) SELECT q.conv_id, CAST(q.ordinal AS INTEGER) AS ordinal, q.turn AS request FROM o q WHERE q.role = 'user' AND NOT EXISTS (SELECT 1 FROM o a WHERE q.conv_id = a.conv_id AND q.ordinal = a.ordinal AND a.role = 'assistant')")
def unmatched_requests(spark, sf_dir):
    return _pairs(spark, sf_dir).where("response is null").drop("response")


@query(
    """SELECT user_id, event_id AS response_id, request AS request_id FROM (SELECT *, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS request FROM events) WHERE event_type = 'purchase'"""
)
def asof_pairs(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    found = P.latest_before(events, ["user_id"], ["ts", "event_id"], "event_type = 'view'", "event_type = 'purchase'", "event_id")
    return found.select("user_id", F.col("event_id").alias("response_id"), F.col("request").alias("request_id"))


@query(
    """WITH s AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS request FROM events)
 SELECT user_id, request AS request_id, event_id AS response_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, request ORDER BY ts, event_id) AS rn FROM s WHERE event_type = 'purchase' AND request IS NOT NULL) WHERE rn = 1"""
)
def consumed_pairs(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    found = P.first_answers(events, ["user_id"], ["ts", "event_id"], "event_type = 'view'", "event_type = 'purchase'", "event_id")
    return found.select("user_id", F.col("request").alias("request_id"), F.col("event_id").alias("response_id"))


_SIDE = "CASE WHEN event_type IN ('click','view') THEN 'tx' WHEN event_type IN ('purchase','signup') THEN 'rx' END"


@query(f"SELECT event_id, user_id, side, CAST(coalesce(sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id, side ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 4294967296 AS BIGINT) AS seq FROM (SELECT *, {_SIDE} AS side FROM events) WHERE side IS NOT NULL")
def running_seq(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    side = F.when(F.col("event_type").isin("click", "view"), "tx").when(F.col("event_type").isin("purchase", "signup"), "rx")
    own = events.withColumns({"side": side, "size": F.floor("value").cast("long")}).where("side is not null")
    return P.running_sequence(own, ["user_id", "side"], ["ts", "event_id"], "size").select("event_id", "user_id", "side", "seq")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_rate_1h(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    return P.rate(events, "ts", "1 hour", "event_type")


@query("WITH r AS (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT start, event_type, n, n - lag(n) OVER (PARTITION BY event_type ORDER BY start) AS delta FROM r")
def rate_delta(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    return P.rate(events, "ts", "1 hour", "event_type").withColumn("delta", F.col("n") - F.lag("n").over(Window.partitionBy("event_type").orderBy("start")))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
 SELECT user_id, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY user_id, session"""
)
def sessions_30m(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    return P.sessions(events, ["user_id"], "ts", "30 minutes")


@query("SELECT start, user_id, n FROM (SELECT date_trunc('day', ts) AS start, user_id, count(*) AS n FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY start ORDER BY n DESC, user_id) <= 5")
def busiest_per_day(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    daily = P.rate(events, "ts", "1 day", "user_id")
    return daily.withColumn("rank", F.row_number().over(Window.partitionBy("start").orderBy(F.desc("n"), "user_id"))).where("rank <= 5").drop("rank")


@query("SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_kind, arg_max(event_type, (ts, event_id)) AS last_kind FROM events GROUP BY user_id")
def sticky_first_last(spark, sf_dir):
    (events,) = tables(spark, sf_dir, "events")
    at = F.struct("ts", "event_id")
    return events.groupBy("user_id").agg(F.min_by("event_type", at).alias("first_kind"), F.max_by("event_type", at).alias("last_kind"))


_LIFE = """told AS (SELECT *, CASE WHEN event_type IN ('click', 'view') THEN 'tx' WHEN event_type <> 'error' THEN 'rx' END AS side, CASE WHEN event_type <> 'error' THEN coalesce(props, '') ELSE '' END AS data,
  CASE WHEN lag(event_type) OVER w = 'error' OR ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 lived AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS life FROM told),
 whole AS (SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, coalesce(string_agg(data, '' ORDER BY ts, event_id) FILTER (side = 'tx'), '') AS tx, coalesce(string_agg(data, '' ORDER BY ts, event_id) FILTER (side = 'rx'), '') AS rx, bool_or(event_type = 'error') AS ended FROM lived GROUP BY user_id, life)"""


@query(f"WITH {_LIFE} SELECT user_id, first_ts, last_ts, right(tx, 60) AS tx, right(rx, 60) AS rx, CAST(length(tx) AS BIGINT) AS seen_tx, CAST(length(rx) AS BIGINT) AS seen_rx, ended FROM whole WHERE length(tx) + length(rx) > 0")
def flow_lives(spark, sf_dir):
    """Users are connections, errors their ends; the last 60 bytes of each side are kept."""
    (events,) = tables(spark, sf_dir, "events")
    kind = F.col("event_type")
    side = F.when(kind.isin("click", "view"), "tx").when(kind != "error", "rx")
    data = F.when(kind != "error", F.encode(F.coalesce("props", F.lit("")), "UTF-8"))
    packets = events.select("user_id", "ts", F.col("event_id").alias("seq"), side.alias("direction"), data.alias("data"), (kind == "error").alias("ended"))
    found = flows.lives(packets, ["user_id"], 60, "6 hours")
    return found.withColumns({"tx": F.decode("tx", "UTF-8"), "rx": F.decode("rx", "UTF-8")})


@query("SELECT conv_id, md5(right(hex(encode(tx)), 3000)) AS tx_md5, md5(right(hex(encode(rx)), 3000)) AS rx_md5 FROM (SELECT conv_id, coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'user'), '') AS tx, coalesce(string_agg(text, '' ORDER BY turn) FILTER (role <> 'user'), '') AS rx FROM conversations GROUP BY conv_id)")
def bounded_streams(spark, sf_dir):
    """Conversations as flows, of which the last 1,500 bytes of each side are put together."""
    (talk,) = tables(spark, sf_dir, "conversations")
    side = F.when(F.col("role") == "user", "tx").otherwise("rx")
    packets = talk.select(F.col("conv_id").alias("flow"), F.col("turn").alias("ts_ns"), F.lit(0).alias("seq"), side.alias("direction"), F.lit("10.0.0.1:99").alias("dst"), F.encode("text", "UTF-8").alias("data"))
    kept = flows.streams(packets, most=1500)
    return kept.select(F.col("flow").alias("conv_id"), F.md5(F.hex("tx")).alias("tx_md5"), F.md5(F.hex("rx")).alias("rx_md5"))
