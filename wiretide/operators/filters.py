"""Which events of a capture are looked at, and how much of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import redacted


def without_self(events: DataFrame, own: int, include_self: bool = False) -> DataFrame:
    """Events of all processes but the recorder's own."""
    return events if include_self else events.where(~F.col("tgid").eqNullSafe(F.lit(own)))


def in_pods(events: DataFrame, pods: DataFrame, name: str) -> DataFrame:
    """Events in cgroups of the pods of that name; ``pods`` has cgroup_id and pod."""
    return events.join(pods.where(F.col("pod") == name).select("cgroup_id"), "cgroup_id", "left_semi")


def in_cgroup(events: DataFrame, cgroups: DataFrame, path: str) -> DataFrame:
    """Events in a cgroup and those below it; ``cgroups`` has cgroup_id and path."""
    base = path.rstrip("/")
    own = cgroups.where((F.col("path") == base) | F.startswith(F.col("path"), F.lit(base + "/"))).select("cgroup_id")
    return events.join(own, "cgroup_id", "left_semi")


def clipped(events: DataFrame, body: str, no_body: bool = False, redact: bool = False, max_body: int | None = None) -> DataFrame:
    """Bodies left out, masked and cut, in that order."""
    text: Column = F.col(body)
    if no_body:
        return events.withColumn(body, F.lit(None).cast("string"))
    if redact:
        text = redacted(text)
    if max_body is not None:
        text = F.substring(text, 1, max_body)
    return events.withColumn(body, text)


def since(events: DataFrame, seconds: float, time: str = "ts") -> DataFrame:
    """Events of the last seconds of the capture."""
    last = events.agg(F.max(time).alias("last_")).select((F.col("last_") - F.make_dt_interval(secs=F.lit(seconds))).alias("from_"))
    return events.where(F.col(time) >= last.scalar())


def incarnations(events: DataFrame, keys: list[str], order: list[Column], ended: Column) -> DataFrame:
    """Numbers the lives of each connection: what follows an end is a new flow under the same key."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("incarnation", F.coalesce(F.count_if(ended).over(before), F.lit(0)))
