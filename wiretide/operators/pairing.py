"""Pairing requests with responses, and running positions within a flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_ordinal(messages: DataFrame, flow: list[str], order: list[str], side: str, request: str, response: str, value: str) -> DataFrame:
    """The n-th request of a flow with its n-th response; requests without one have nulls."""
    turn = Window.partitionBy(*flow, side).orderBy(*order)
    numbered = messages.where(F.col(side).isin(request, response)).withColumn("ordinal", F.row_number().over(turn))
    pick = lambda which: F.max(F.when(F.col(side) == which, F.col(value)))
    has = F.max((F.col(side) == request).cast("int"))
    both = numbered.groupBy(*flow, "ordinal").agg(has.alias("has"), pick(request).alias("request"), pick(response).alias("response"))
    return both.where("has = 1").drop("has")


def latest_before(events: DataFrame, keys: list[str], order: list[str], is_request: str, is_response: str, request_value: str) -> DataFrame:
    """Each response with the latest request before it in its flow (as-of), without a join."""
    past = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = events.withColumn("request", F.last(F.when(F.expr(is_request), F.col(request_value)), ignorenulls=True).over(past))
    return seen.where(is_response)


def first_answers(events: DataFrame, keys: list[str], order: list[str], is_request: str, is_response: str, request_value: str) -> DataFrame:
    """As ``latest_before``, but a request is used up by its first response."""
    found = latest_before(events, keys, order, is_request, is_response, request_value).where("request is not null")
    first = Window.partitionBy(*keys, "request").orderBy(*order)
    return found.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


def running_sequence(packets: DataFrame, keys: list[str], order: list[str], size: str, modulus: int = 1 << 32) -> DataFrame:
    """Bytes before each packet of its flow and side, as TCP counts them."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return packets.withColumn("seq", F.pmod(F.coalesce(F.sum(size).over(before), F.lit(0)), F.lit(modulus)))


def sessions(events: DataFrame, keys: list[str], time: str, gap: str = "30 minutes") -> DataFrame:
    """Events whose pauses are shorter than the gap; merged before the shuffle, and usable on streams."""
    return events.groupBy(*keys, F.session_window(time, gap).alias("session")).agg(F.count("*").alias("events"), F.min(time).alias("first_ts"), F.max(time).alias("last_ts")).drop("session")


def rate(events: DataFrame, time: str, width: str, *keys: str) -> DataFrame:
    return events.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def answered(messages: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """Responses with the request that they answer: the one just before them under the same correlation id.

    ``messages`` has the keys (flow and id), is_request and the request's value. A request is answered once;
    responses without one stay, with nulls. Ids may be used again.
    """
    own = Window.partitionBy(*keys).orderBy(*order)
    asked = F.when(F.lag("is_request").over(own), F.lag(value).over(own))
    return messages.withColumn("request", asked).where(~F.col("is_request"))


def prepared(messages: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """Executions with the statement last prepared before them under the same id; any number may use it."""
    own = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("statement", F.last(F.when(F.col("is_request"), F.col(value)), ignorenulls=True).over(own)).where(~F.col("is_request"))
