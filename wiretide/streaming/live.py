"""The same reports over streams: event time, watermarks, bounded state, restartable sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import report


def timed(events: DataFrame, late: str = "30 seconds") -> DataFrame:
    """Event time from the wall clock of the capture, with a bound on lateness."""
    return events.withColumn("ts", F.timestamp_millis("ts_wall_ms")).withWatermark("ts", late)


def rates(events: DataFrame, width: str = "1 second", *keys: str) -> DataFrame:
    """Events and bytes per window; closed windows leave the state."""
    own = events.groupBy(F.window("ts", width).alias("w"), *keys)
    return own.agg(F.count("*").alias("events"), report.sent().alias("tx"), report.received().alias("rx")).select(F.col("w.start").alias("start"), *keys, "events", "tx", "rx")


def sessions(events: DataFrame, gap: str = "30 minutes", *keys: str) -> DataFrame:
    own = events.groupBy(F.session_window("ts", gap).alias("s"), *keys)
    return own.agg(F.count("*").alias("events")).select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), *keys, "events")


def distinct_within(events: DataFrame, *keys: str) -> DataFrame:
    """Each key once per lateness bound (certificates, fingerprints)."""
    return events.dropDuplicatesWithinWatermark(list(keys))


def snapshots(table: DataFrame, show: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 second", once: bool = False) -> StreamingQuery:
    """Hand the whole current result to ``show`` at every trigger."""
    writer = table.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(show)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def append(table: DataFrame, path: str, checkpoint: str, once: bool = False, every: str = "10 seconds") -> StreamingQuery:
    """Append finished rows as Parquet, exactly once across restarts."""
    writer = table.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def paired(requests: DataFrame, responses: DataFrame, keys: list[str], within: str = "5 minutes") -> DataFrame:
    """Requests joined to responses of the same keys that follow in time; both have ``ts`` with a watermark.

    The bound on time lets old rows leave the state. Columns of responses get the prefix ``response_``.
    """
    renamed = responses.select(*(F.col(c).alias(f"response_{c}") for c in responses.columns))
    on = [F.col(k) == F.col(f"response_{k}") for k in keys]
    later = (F.col("response_ts") >= F.col("ts")) & (F.col("response_ts") <= F.col("ts") + F.expr(f"INTERVAL {within}"))
    condition = later
    for c in on:
        condition = condition & c
    return requests.join(renamed, condition, "inner").drop(*(f"response_{k}" for k in keys))
