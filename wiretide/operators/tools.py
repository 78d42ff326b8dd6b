"""The questions a chat assistant may ask of a capture, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sort keys of ``list_endpoints`` and the most rows either listing gives.
SORTS = {"calls": "calls", "p50": "p50", "p99": "p99", "bytes": "avg_bytes"}
MOST_ENDPOINTS, MOST_EVENTS = 200, 500


def list_endpoints(catalogue: DataFrame, sort: str = "calls", limit: int = 20) -> DataFrame:
    """Endpoints by a measure, unknown ones last; ties go by host and template."""
    return catalogue.orderBy(F.coalesce(F.col(SORTS[sort]), F.lit(0)).desc(), "host", "template").limit(min(limit, MOST_ENDPOINTS))


def get_endpoint(catalogue: DataFrame, template: str) -> DataFrame:
    """The first endpoint with this template, or with this host and template written together."""
    return catalogue.where((F.col("template") == template) | (F.concat("host", "template") == template)).orderBy("host", "template").limit(1)


def catalog_stats(catalogue: DataFrame) -> DataFrame:
    return catalogue.agg(F.count("*").alias("endpoints"), F.countDistinct("host").alias("hosts"), F.sum("calls").alias("calls"), F.min("p99").alias("least_p99"), F.max("p99").alias("most_p99"))


def search_events(lines: DataFrame, pattern: str, limit: int = 50) -> DataFrame:
    """Raw lines (column ``value``) that hold the pattern."""
    return lines.where(F.col("value").contains(pattern)).limit(min(limit, MOST_EVENTS))


def openapi_lines(endpoints: DataFrame, params: DataFrame) -> DataFrame:
    """Lines of an OpenAPI description, ordered by template, host, part and line.

    ``endpoints`` has host, template and calls; ``params`` host, template, name, place (path, query
    or header), type and required.
    """
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    head = endpoints.select("template", "host", F.lit(0).alias("part"), F.lit("").alias("key"), F.concat_ws("\n", F.concat(F.lit("  "), quoted(F.col("template")), F.lit(":")), F.lit("    get:"), F.concat(F.lit("      x-call-count: "), F.col("calls").cast("string")), F.concat(F.lit("      servers: [{url: "), quoted(F.concat(F.lit("//"), F.col("host"))), F.lit("}]")), F.lit("      parameters:")).alias("text"))
    place = F.when(F.col("place") == "path", 1).when(F.col("place") == "query", 2).otherwise(3)
    body = params.select("template", "host", place.alias("part"), F.col("name").alias("key"), F.concat(F.lit("        - {name: "), quoted(F.col("name")), F.lit(", in: "), F.col("place"), F.lit(", required: "), F.col("required").cast("string"), F.lit(", schema: {type: "), F.col("type"), F.lit("}}")).alias("text"))
    return head.unionByName(body).orderBy("template", "host", "part", "key")
