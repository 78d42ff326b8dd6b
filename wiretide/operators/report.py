"""Summary of a capture: kinds, processes, peers, totals, span and line quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sent(column: str = "total_bytes") -> Column:
    return F.coalesce(F.sum(F.when(F.col("direction") == "tx", F.col(column))), F.lit(0)).cast("long")


def received(column: str = "total_bytes") -> Column:
    return F.coalesce(F.sum(F.when(F.col("direction") == "rx", F.col(column))), F.lit(0)).cast("long")


def kinds(events: DataFrame) -> DataFrame:
    return events.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


def span(events: DataFrame, time: str = "ts_wall_ms") -> DataFrame:
    """First and last time and what lies between; an empty capture lasts 0."""
    return events.agg(F.min(time).alias("first_ms"), F.max(time).alias("last_ms"), F.coalesce(F.max(time) - F.min(time), F.lit(0)).alias("duration_ms"))


def processes(events: DataFrame, *keys: str, top: int | None = 20) -> DataFrame:
    """Events and bytes of each process; ties go by key."""
    keys = keys or ("tgid", "comm")
    out = events.groupBy(*keys).agg(F.count("*").alias("events"), sent().alias("tx"), received().alias("rx"))
    return out.orderBy(F.desc("events"), *keys).limit(top) if top else out


def peers(events: DataFrame, key: str = "dst", top: int | None = 20) -> DataFrame:
    out = events.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("events"), sent().alias("tx"), received().alias("rx"))
    return out.orderBy(F.desc(F.col("tx") + F.col("rx")), key).limit(top) if top else out


def totals(events: DataFrame) -> DataFrame:
    """Payload bytes, and the lifetime bytes that closed connections report, apart."""
    whole = {c: F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,0)") for c in ("bytes_sent", "bytes_recv") if c in events.columns}
    extra = [whole[c].alias(n) for c, n in (("bytes_sent", "lifetime_tx"), ("bytes_recv", "lifetime_rx")) if c in whole]
    return events.agg(sent().alias("tx"), received().alias("rx"), *extra)


def quality(lines: DataFrame, corrupt: str = "_corrupt") -> DataFrame:
    return lines.agg(F.count("*").alias("total_lines"), F.count(corrupt).alias("parse_errors"))


def sorted_edges(edges: DataFrame, by: str, keys: list[str], reverse: bool = False, top: int | None = None) -> DataFrame:
    """The edge table by last_seen, calls or bytes (greatest first), or by protocol or peer (which have no reverse order); ties by key."""
    value = {"bytes": F.col("tx") + F.col("rx"), "peer": F.coalesce("label", F.lit(""))}.get(by, F.col(by))
    ascending = by in ("protocol", "peer") or reverse
    out = edges.orderBy(value.asc() if ascending else value.desc(), *keys)
    return out.limit(top) if top else out


def top_protocols(events: DataFrame, column: str = "protocol", top: int = 6) -> DataFrame:
    return events.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(top)


def as_json(events: DataFrame) -> DataFrame:
    """The whole summary as one row of JSON: span, totals, kinds and the busiest processes and peers.

    Each part is a list of at most 20 rows, of one row, or of one row for each kind, in no order of rank.
    """
    parts = {"span": span(events), "totals": totals(events), "kinds": kinds(events), "processes": processes(events), "peers": peers(events)}
    lists = [t.select(F.struct(*t.columns).alias("r")).agg(F.collect_list("r").alias("a")).scalar().alias(n) for n, t in parts.items()]
    return events.sparkSession.range(1).select(F.to_json(F.struct(*lists)).alias("report"))
