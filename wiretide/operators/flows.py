"""Byte streams of connections put together again, and the messages in them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import protocols as P
from ..functions.text import base64_lenient, header_value, host_of, port_of


def payloads(events: DataFrame) -> DataFrame:
    """TCP and TLS payload events of a capture with their flow key and bytes.

    Sockets and TLS connections number their flows apart. ``seq`` should be unique within a capture;
    without such a column events of one time are ordered by their bytes.
    """
    own = events.where(F.col("kind").isin("tcp_data", "tls_data") & (F.col("data_b64") != ""))
    flow = F.struct(F.when(F.col("kind") == "tls_data", "tls").otherwise("tcp").alias("layer"), F.col("tgid"), F.when(F.col("kind") == "tls_data", F.col("conn_id")).otherwise(F.col("sock_id")).alias("id"))
    seq = F.col("seq") if "seq" in events.columns else F.lit(0)
    return own.select(flow.alias("flow"), "ts_ns", "ts_wall_ms", seq.alias("seq"), "direction", "protocol", "src", "dst", "comm", base64_lenient(F.col("data_b64")).alias("data"))


def joined(pieces: Column) -> Column:
    """Binary pieces of an array as one, each copied a fixed number of times."""
    return F.unhex(F.array_join(F.transform(pieces, F.hex), ""))


def last_bytes(packets: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """Packets whose ``data`` is cut to what lies in the last ``most`` bytes of their side of the flow, null if none does.

    A running sum from the end decides it packet by packet, before anything is gathered.
    """
    later = Window.partitionBy(*keys, "direction").orderBy(*(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    room = F.lit(most) - F.coalesce(F.sum(F.octet_length("data")).over(later), F.lit(0))
    size = F.octet_length("data")
    kept = F.when(room >= size, F.col("data")).when(room > 0, F.substr("data", (size - room + 1).cast("int"), room.cast("int")))
    return packets.withColumn("data", kept)


def _side(direction: str, order: list[str]) -> Column:
    piece = F.when((F.col("direction") == direction) & F.col("data").isNotNull(), F.struct(*order, "data"))
    return joined(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["data"]))


def streams(packets: DataFrame, most: int | None = None) -> DataFrame:
    """Both sides of each flow in order of time, its first known port, and its protocol.

    A flow is one connection; its bytes come together in one row, as any decoder needs them. ``most``
    keeps that many last bytes of a side, and no others are gathered.
    """
    order, at = ["ts_ns", "seq"], F.struct("ts_ns", "seq")
    kept = last_bytes(packets, ["flow"], order, most) if most else packets
    port = port_of(F.col("dst"))
    out = kept.groupBy("flow").agg(
        _side("tx", order).alias("tx"), _side("rx", order).alias("rx"), F.min_by(port, F.when(port > 0, at)).alias("port"), F.min_by(host_of(F.col("dst")), at).alias("peer"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns")
    )
    return out.withColumn("l7", P.detect(F.col("port"), F.col("tx"), F.col("rx")))


def lives(packets: DataFrame, keys: list[str], most: int = 1 << 16, idle: str = "5 minutes") -> DataFrame:
    """What each life of a connection holds: the last ``most`` bytes of its sides, how many there were, and its times.

    ``packets`` has the keys, ts, seq, direction (tx or rx), data and ended. An end closes a life, and
    so does a pause longer than ``idle``; what follows under the same key is a new one. Lives without
    bytes have no row. Events of one time are in the order of seq. ``streaming.lives`` gives the same
    rows from a stream.
    """
    own = Window.partitionBy(*keys).orderBy("ts", "seq")
    pause = F.col("ts") - F.lag("ts").over(own) > F.make_dt_interval(secs=F.lit(micros(idle) / 1e6))
    fresh = F.coalesce(F.lag("ended").over(own), F.lit(False)) | F.coalesce(pause, F.lit(False))
    told = packets.withColumn("fresh_", fresh.cast("int")).withColumn("life_", F.sum("fresh_").over(own)).withColumn("size_", F.coalesce(F.octet_length("data"), F.lit(0)))
    kept = last_bytes(told, [*keys, "life_"], ["ts", "seq"], most)
    seen = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("size_"))), F.lit(0)).cast("long")
    sides = [x for d in ("tx", "rx") for x in (_side(d, ["ts", "seq"]).alias(d), seen(d).alias(f"seen_{d}"))]
    out = kept.groupBy(*keys, "life_").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), *sides, F.bool_or("ended").alias("ended"))
    return out.where("seen_tx + seen_rx > 0").select(*keys, "first_ts", "last_ts", "tx", "rx", "seen_tx", "seen_rx", "ended")


def micros(duration: str) -> int:
    """Microseconds of a duration such as ``5 minutes``."""
    return int(pd.Timedelta(duration).value // 1000)


def http_exchanges(flows: DataFrame) -> DataFrame:
    """HTTP/1 requests with the responses of the same place in their flow.

    The side that holds request lines is the client, whichever direction it is.
    """
    own = flows.where("l7 = 'http1'")
    server_side = P.latin1(F.col("tx")).startswith("HTTP/")
    asked, said = F.when(server_side, F.col("rx")).otherwise(F.col("tx")), F.when(server_side, F.col("tx")).otherwise(F.col("rx"))
    listed = own.select("flow", "peer", P.http1_requests(asked).alias("requests"), P.http1_responses(said).alias("responses"))
    each = listed.select("flow", "peer", F.posexplode("requests").alias("ordinal", "request"), "responses")
    return each.select("flow", "peer", "ordinal", "request.method", "request.target", header_value(F.col("request.headers"), "host").alias("host"), F.get("responses", F.col("ordinal"))["status"].alias("status"))


def dns_records(packets: DataFrame) -> DataFrame:
    """The first question of each DNS message; datagrams are decoded one by one."""
    own = packets.where((F.col("protocol") == 17) & port_of(F.col("dst")).isin(53, 5353))
    return own.select("flow", "ts_ns", P.dns_question(F.col("data")).alias("q")).where("q is not null").select("flow", "ts_ns", "q.*")


def redis_calls(flows: DataFrame) -> DataFrame:
    return flows.where("l7 = 'redis'").select("flow", F.posexplode(P.redis_commands(F.col("tx"))).alias("ordinal", "command"))


def segments(packets: DataFrame) -> DataFrame:
    """Sequence and acknowledgement numbers that a packet file of these payloads would have."""
    before = Window.partitionBy("flow").orderBy("ts_ns", "seq").rowsBetween(Window.unboundedPreceding, -1)
    size = F.octet_length("data")
    total = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, size)).over(before), F.lit(0))
    own, other = F.when(F.col("direction") == "tx", total("tx")).otherwise(total("rx")), F.when(F.col("direction") == "tx", total("rx")).otherwise(total("tx"))
    return packets.select("flow", "ts_ns", "seq", "direction", size.alias("size"), F.pmod(own + 1, F.lit(1 << 32)).alias("tcp_seq"), F.pmod(other + 1, F.lit(1 << 32)).alias("tcp_ack"))
