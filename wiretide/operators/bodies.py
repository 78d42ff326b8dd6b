"""Response bodies as files: decompressed contents and their names."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.classify import extension
from ..functions.text import fnv1a32


def unpack(body: bytes | None, encoding: str | None) -> bytes | None:
    """The body without its content encoding; damaged or unknown ones stay as they are."""
    try:
        if body is None or not encoding:
            return body
        if encoding in ("gzip", "x-gzip"):
            return zlib.decompress(body, 31)
        if encoding == "deflate":
            try:
                return zlib.decompress(body)
            except zlib.error:
                return zlib.decompress(body, -15)
        if encoding == "zstd":
            import zstandard

            return zstandard.ZstdDecompressor().decompressobj().decompress(body)
    except Exception:  # noqa: BLE001  any damage means the original is kept
        pass
    return body


@F.pandas_udf(T.BinaryType())
def decompressed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for body, encoding in batches:
        yield pd.Series([unpack(b, e) for b, e in zip(body, encoding, strict=True)], dtype=object)


def file_name(at_ms: Column, method: Column, host: Column, path: Column, content_type: Column) -> Column:
    """``<ms>_<method>_<host>_<slug>_<hash>.<ext>``; the hash tells paths with one slug apart."""
    safe = lambda c: F.regexp_replace(F.coalesce(c, F.lit("-")), "[^A-Za-z0-9.-]", "_")
    slug = F.substring(F.regexp_replace(F.substring_index(path, "?", 1), "[^A-Za-z0-9]+", "_"), 1, 64)
    return F.concat(F.lpad(at_ms.cast("string"), 13, "0"), F.lit("_"), safe(method), F.lit("_"), safe(host), F.lit("_"), slug, F.lit("_"), F.lpad(F.lower(F.hex(fnv1a32(path))), 8, "0"), F.lit("."), extension(content_type))


def files(responses: DataFrame) -> DataFrame:
    """(name, content) of responses (at_ms, method, host, path, content_type, encoding, body); empty ones have none."""
    named = responses.where("body is not null and octet_length(body) > 0").withColumn("name", file_name(F.col("at_ms"), F.col("method"), F.col("host"), F.col("path"), F.col("content_type")))
    return named.select("name", decompressed("body", F.lower("encoding")).alias("content"))
