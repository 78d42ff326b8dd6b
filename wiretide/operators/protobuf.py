"""Field profiles of protobuf messages whose schema isn't known."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIELD = "array<struct<tag:int,wire:int,number:decimal(20,0),length:int,kind:string>>"


def _varint(data: bytes, at: int) -> tuple[int, int] | None:
    value = shift = 0
    while at < len(data) and shift < 70:
        value |= (data[at] & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if not data[at - 1] & 0x80:
            return value & (2**64 - 1), at
    return None


def fields_of(data: bytes | None, depth: int = 0) -> list[dict] | None:
    """The fields of one message, or None if the bytes aren't one."""
    out, at = [], 0
    data = data or b""
    while at < len(data):
        key = _varint(data, at)
        if not key or not key[0] >> 3 or key[0] >> 3 > 2**29 - 1:
            return None
        tag, wire, at = key[0] >> 3, key[0] & 7, key[1]
        row = {"tag": tag, "wire": wire, "number": None, "length": None, "kind": None}
        if wire == 0:
            got = _varint(data, at)
            if not got:
                return None
            row["number"], at = got
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            row["number"], at = int.from_bytes(data[at : at + size], "little"), at + size
        elif wire == 2:
            got = _varint(data, at)
            if not got or got[1] + got[0] > len(data):
                return None
            part = data[got[1] : got[1] + got[0]]
            row["length"], row["kind"], at = got[0], _kind(part, depth), got[1] + got[0]
        else:
            return None
        if at > len(data):
            return None
        out.append(row)
    return out


def _kind(part: bytes, depth: int) -> str:
    """message, string or bytes, as the content suggests."""
    try:
        text = part.decode("utf-8")
        if part and sum(c.isprintable() or c in "\r\n\t" for c in text) >= 0.8 * len(text):
            return "string"
    except UnicodeDecodeError:
        pass
    return "message" if part and depth < 32 and fields_of(part, depth + 1) else "bytes"


def decoded(samples: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``fields`` (null where the content is no message)."""

    @F.pandas_udf(FIELD)
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            yield column.map(fields_of)

    return samples.withColumn("fields", parse(F.col(content)))


def profile(parsed: DataFrame, sample: str = "sample") -> DataFrame:
    """One row per tag: type by most votes, repeated, messages that have it, and bytes."""
    flat = parsed.where("fields is not null").select(sample, F.explode("fields").alias("f")).select(sample, "f.*")
    times = flat.withColumn("times", F.count("*").over(Window.partitionBy(sample, "tag")))
    sums = times.groupBy("tag").agg(
        F.mode("wire", True).alias("wire"), F.max("number").alias("largest"), F.max("times").alias("most"), F.countDistinct(sample).alias("messages"), F.sum("length").alias("bytes"), F.mode("kind", True).alias("kind"), F.count("*").alias("seen")
    )
    number = F.when(F.col("largest") <= 1, "bool").when(F.col("largest") <= 2**32 - 1, "int32").otherwise("int64")
    kind = F.when(F.col("wire") == 0, number).when(F.col("wire") == 1, "fixed64").when(F.col("wire") == 5, "fixed32").when(F.col("kind") == "message", F.concat(F.lit("Message_"), F.col("tag"))).otherwise(F.col("kind"))
    return sums.select("tag", kind.alias("type"), (F.col("most") > 1).alias("repeated"), "messages", "seen", F.coalesce("bytes", F.lit(0)).alias("bytes")).orderBy("tag")


def proto_lines(fields: DataFrame, name: str = "Inferred") -> DataFrame:
    """Lines of a proto3 file, numbered in order."""
    body = fields.select(F.col("tag").alias("line"), F.concat(F.lit("  "), F.when(F.col("repeated"), "repeated ").otherwise(""), F.col("type"), F.lit(" field_"), F.col("tag"), F.lit(" = "), F.col("tag"), F.lit(";")).alias("text"))
    spark = fields.sparkSession
    frame = spark.sql(f"SELECT * FROM VALUES (-1, 'syntax = \"proto3\";'), (0, 'message {name} {{'), (2147483647, '}}') AS t(line, text)")
    return body.unionByName(frame).orderBy("line")
