"""API catalogue: URL templates, endpoint roll-ups, parameters, latencies and body schemas."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import PLACEHOLDERS, REDACTED_HEADERS, SECRET_KEY, STANDARD_HEADERS, UUID, grpc_call, segment_class, values_type
from ..functions.text import path_of, query_of, scrubbed, shortened, url_decoded, url_host


def requests(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds host, path, query, segments and the shape that decides a request's endpoint.

    In a shape each segment that isn't literal is replaced by its class, so two requests belong to
    one endpoint exactly if host and shape are equal. Empty segments don't count.
    """
    path = path_of(F.col(url))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    shape = F.transform("segments", lambda s: F.when(segment_class(s) == "literal", s).otherwise(F.concat(F.lit("{"), segment_class(s), F.lit("}"))))
    out = urls.withColumns({"host": url_host(F.col(url)), "path": path, "query": query_of(F.col(url)), "segments": segments})
    return out.withColumn("shape", F.array_join(F.transform(shape, lambda s: F.concat(F.lit("/"), s)), ""))


def templates(reqs: DataFrame) -> DataFrame:
    """The template of each (host, shape): a segment with one value stays as it is.

    Only the least and greatest value of each position are needed to tell one value from several,
    so the aggregate combines before its shuffle.
    """
    spot = reqs.select("host", "shape", F.posexplode_outer("segments").alias("pos", "segment"))
    seen = spot.groupBy("host", "shape", "pos").agg(F.min("segment").alias("low"), F.max("segment").alias("high"))
    kind = segment_class(F.col("low"))
    mark = F.lit(None).cast("string")
    for name, sign in PLACEHOLDERS.items():
        mark = F.when(kind == name, F.lit(sign)).otherwise(mark)
    part = F.when((F.col("low") != F.col("high")) & mark.isNotNull(), mark).otherwise(F.col("low"))
    parts = seen.withColumn("part", part).groupBy("host", "shape").agg(F.sort_array(F.collect_list(F.struct("pos", "part"))).alias("parts"))
    text = F.array_join(F.transform(F.filter("parts", lambda p: p["part"].isNotNull()), lambda p: F.concat(F.lit("/"), p["part"])), "")
    return parts.select("host", "shape", F.when(text == "", "/").otherwise(text).alias("template"))


def rollup(reqs: DataFrame, bytes_column: str) -> DataFrame:
    """Calls and bytes of each endpoint; the average is a whole number."""
    sums = reqs.groupBy("host", "shape").agg(F.count("*").alias("calls"), F.sum(bytes_column).alias("total_bytes"), F.floor(F.sum(bytes_column) / F.count("*")).cast("long").alias("avg_bytes"))
    return sums.join(templates(reqs), ["host", "shape"]).select("host", "template", "calls", "total_bytes", "avg_bytes")


def query_params(reqs: DataFrame) -> DataFrame:
    """Query parameters of each endpoint: samples, distinct values, type, required, and an example.

    A parameter is required if there are as many samples as calls. Examples of secret names are hidden.
    """
    calls = reqs.groupBy("host", "shape").agg(F.count("*").alias("calls"))
    pair = reqs.where("query is not null").select("host", "shape", F.explode(F.split("query", "&")).alias("pair")).where("pair <> ''")
    name, value = F.substring_index("pair", "=", 1), F.when(F.instr("pair", "=") > 0, F.substr("pair", F.instr("pair", F.lit("=")) + 1)).otherwise("")
    named = pair.select("host", "shape", url_decoded(name).alias("name"), url_decoded(value).alias("value"))
    stats = named.groupBy("host", "shape", "name").agg(F.count("*").alias("samples"), F.countDistinct("value").alias("distinct_values"), values_type(F.col("value")).alias("type"), F.max("value").alias("example"))
    shown = F.when(F.col("name").rlike(SECRET_KEY), "<redacted>").otherwise(F.col("example"))
    return stats.join(calls, ["host", "shape"]).select("host", "shape", "name", "samples", "distinct_values", "type", (F.col("samples") >= F.col("calls")).alias("required"), shown.alias("example"))


def path_params(reqs: DataFrame) -> DataFrame:
    """Positions of endpoints that take several values of one class."""
    spot = reqs.select("host", "shape", F.posexplode("segments").alias("pos", "segment")).where(segment_class(F.col("segment")) != "literal")
    kind = segment_class(F.min("segment"))
    stats = spot.groupBy("host", "shape", "pos").agg(F.count("*").alias("samples"), F.countDistinct("segment").alias("distinct_values"), kind.alias("class"), F.max("segment").alias("example"))
    return stats.where("distinct_values >= 2")


def latency(records: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact p50 and p99; at many values per key ``approx_latency`` needs bounded memory."""
    return records.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("p50"), F.percentile(value, F.lit(0.99)).alias("p99"))


def approx_latency(records: DataFrame, keys: list[str], value: str, accuracy: int = 10_000) -> DataFrame:
    got = F.percentile_approx(value, [0.5, 0.99], accuracy)
    return records.groupBy(*keys).agg(got[0].alias("p50"), got[1].alias("p99"))


def status_map(records: DataFrame, keys: list[str], status: str) -> DataFrame:
    counts = records.groupBy(*keys, status).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(status, "n")))).alias("statuses"))


def last_examples(records: DataFrame, keys: list[str], order: list[Column], most: int = 16) -> DataFrame:
    recent = Window.partitionBy(*keys).orderBy(*order)
    return records.withColumn("rank", F.row_number().over(recent)).where(F.col("rank") <= most)


def endpoint_totals(calls: DataFrame, keys: list[str], time: str = "ts") -> DataFrame:
    """Calls, first and last time, and bytes of both bodies of each endpoint.

    ``calls`` has request_bytes and response_bytes; empty and unknown bodies don't count into the
    averages, which are whole numbers.
    """
    out = [F.count("*").alias("calls"), F.min(time).alias("first_seen"), F.max(time).alias("last_seen")]
    for side in ("request", "response"):
        size = F.when(F.col(f"{side}_bytes") > 0, F.col(f"{side}_bytes"))
        out += [F.coalesce(F.sum(size), F.lit(0)).cast("long").alias(f"total_{side}_bytes"), F.coalesce(F.floor(F.sum(size) / F.count(size)), F.lit(0)).cast("long").alias(f"avg_{side}_bytes")]
    return calls.groupBy(*keys).agg(*out)


def grpc_rollup(calls: DataFrame, path: str = "path", time: str = "ts") -> DataFrame:
    """``endpoint_totals`` of gRPC calls by service and method; other paths are left out."""
    named = calls.withColumn("call", grpc_call(F.col(path))).where("call is not null")
    return endpoint_totals(named.withColumns({"service": F.col("call.service"), "method": F.col("call.method")}), ["service", "method"], time)


def header_params(calls: DataFrame, keys: list[str], headers: str = "headers") -> DataFrame:
    """Headers of each endpoint that aren't standard ones: samples, distinct values, required and an example.

    ``headers`` is an array of (name, value); names count without case. Values of credentials
    and secret names are hidden.
    """
    total = calls.groupBy(*keys).agg(F.count("*").alias("calls"))
    each = calls.select(*keys, F.explode(headers).alias("h")).select(*keys, F.lower("h.name").alias("name"), F.col("h.value").alias("value")).where(~F.col("name").isin(STANDARD_HEADERS))
    stats = each.groupBy(*keys, "name").agg(F.count("*").alias("samples"), F.countDistinct("value").alias("distinct_values"), F.max("value").alias("example"))
    hidden = F.col("name").isin(REDACTED_HEADERS) | F.col("name").rlike(SECRET_KEY)
    return stats.join(total, keys).select(*keys, "name", "samples", "distinct_values", (F.col("samples") >= F.col("calls")).alias("required"), F.when(hidden, "<redacted>").otherwise(F.col("example")).alias("example"))


def variant_type(value: Column) -> Column:
    """unknown, boolean, integer, number, uuid, string, array or object."""
    shape, text = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
    return (
        F.when(shape == "VOID", "unknown")
        .when(shape == "BOOLEAN", "boolean")
        .when((shape == "BIGINT") | (shape.isin("DECIMAL(19,0)", "DECIMAL(20,0)") & text.try_cast("decimal(20,0)").between(Decimal(-(2**63)), Decimal(2**64 - 1))), "integer")
        .when(shape.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number")
        .when(shape == "STRING", F.when(text.rlike(UUID), "uuid").otherwise("string"))
        .when(shape.startswith("ARRAY"), "array")
        .when(shape.startswith("OBJECT"), "object")
        .otherwise("unknown")
    )


_HOLDER = "struct<parent: string, path: string, type: string>"


def json_nodes(records: DataFrame, keys: list[str], body: str, depth: int = 8) -> DataFrame:
    """Every value in JSON bodies: its path (``$.a.b``, ``$.tags[]``), its parent's path, type and text.

    Bodies that are no JSON have no rows. Values of secret names count as strings and are hidden,
    with what they hold. ``depth`` bounds the levels, the body being the first. A body is parsed once: each level replaces
    the containers among the rows by what they hold, and the first row of a container carries it (``above``) to the end.
    """
    level = records.select(*keys, F.try_parse_json(body).alias("value"), F.lit("$").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(False).alias("secret"), F.lit(None).cast(f"array<{_HOLDER}>").alias("above"))
    for _ in range(depth - 1):
        inner = level.lateralJoin(level.sparkSession.tvf.variant_explode_outer(F.col("value").outer()).toDF("pos", "key", "item"))
        inner = inner.withColumn("hide", F.coalesce(F.col("key").rlike(SECRET_KEY), F.lit(False)))
        stays, member = F.col("pos").isNull(), F.col("key").isNotNull()
        holder = F.array(F.struct("parent", "path", F.when(member, "object").otherwise("array").alias("type")))
        level = inner.select(
            *keys,
            F.when(stays, F.col("value")).when(~F.col("hide"), F.col("item")).alias("value"),
            F.when(stays, F.col("path")).when(member, F.concat("path", F.lit("."), "key")).otherwise(F.concat("path", F.lit("[]"))).alias("path"),
            F.when(stays, F.col("parent")).otherwise(F.col("path")).alias("parent"),
            F.when(stays, F.col("secret")).otherwise(F.col("hide")).alias("secret"),
            F.when(stays, F.col("above")).when(F.col("pos") == 0, F.when(F.col("above").isNull(), holder).otherwise(F.concat("above", holder))).alias("above"),
        )
    own = F.array(F.lit(None).cast(_HOLDER))
    each = level.where("secret or value is not null").withColumn("up", F.explode_outer(F.when(F.col("above").isNull(), own).otherwise(F.concat("above", own))))
    holds = F.col("up").isNotNull()
    typed = each.withColumn("type", F.when(holds, F.col("up.type")).when(F.col("secret"), "string").otherwise(variant_type(F.col("value"))))
    text = F.when(holds | F.col("type").isin("object", "array"), None).when(F.col("secret"), "<redacted>").otherwise(F.try_variant_get("value", "$", "string"))
    return typed.select(*keys, *(F.when(holds, F.col(f"up.{c}")).otherwise(F.col(c)).alias(c) for c in ("parent", "path")), "type", text.alias("raw"))


def json_schema_tree(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """The schema of each path: type by most votes (ties: first by name), required, enum and an example.

    A member is required if it is in every object at its parent's path; items of arrays and the body aren't.
    A string is an enum with at least five samples and 2 to 20 values. Examples are at
    most 64 characters, and those that look like tokens are hidden. The nodes are read once: they are counted by
    text first, which needs no sort, and all else comes from these counts.
    """
    seen = nodes.groupBy(*keys, "parent", "path", "type", "raw").agg(F.count("*").alias("n"))
    votes = seen.groupBy(*keys, "parent", "path", "type").agg(F.sum("n").alias("votes"), F.max("raw").alias("top"), F.count("raw").alias("values"), F.sum(F.when(F.col("raw").isNotNull(), F.col("n"))).alias("texts"))
    of = lambda kind, column: F.sum(F.when(F.col("type") == kind, F.col(column)))
    best = votes.groupBy(*keys, "parent", "path").agg(
        F.min_by("type", F.when(F.col("type") != "unknown", F.struct(-F.col("votes"), F.col("type")))).alias("type"), F.sum("votes").alias("samples"), F.max("top").alias("example"),
        of("object", "votes").alias("objects"), of("string", "values").alias("distinct_values"), of("string", "texts").alias("strings"),
    )
    # Each path stands once beside the members of its objects, for their number, and once as the member it is.
    role = F.array(F.struct(F.col("path").alias("at"), F.lit(False).alias("member")), F.struct(F.col("parent").alias("at"), F.lit(True).alias("member")))
    beside = Window.partitionBy(*keys, "at")
    out = best.select("*", F.inline(role)).withColumn("objects", F.sum(F.when(~F.col("member"), F.col("objects"))).over(beside)).where("member")
    enum = (F.col("type") == "string") & (F.col("strings") >= 5) & F.col("distinct_values").between(2, 20)
    required = ~F.col("path").endswith("[]") & (F.col("samples") >= F.col("objects"))
    return out.select(*keys, "path", F.coalesce("type", F.lit("unknown")).alias("type"), "samples", F.coalesce(required, F.lit(False)).alias("required"), F.coalesce(enum, F.lit(False)).alias("is_enum"), shortened(scrubbed(F.col("example")), 64).alias("example"))


def json_fields(records: DataFrame, keys: list[str], body: str) -> DataFrame:
    """Top-level fields of JSON object bodies with the type and raw value of each."""
    top = json_nodes(records, keys, body, depth=2).where("parent = '$' and path <> '$[]'")
    return top.select(*keys, F.substr("path", F.lit(3)).alias("name"), "raw", "type")


def json_schema(fields: DataFrame, keys: list[str], samples: DataFrame) -> DataFrame:
    """Type by most votes (ties: first by name), required, and the enum of a string field.

    ``samples`` has the number of object bodies per key. A string field is an enum with at least
    five samples and 2 to 20 values.
    """
    votes = fields.groupBy(*keys, "name", "type").agg(F.count("*").alias("votes"))
    best = votes.where("type <> 'unknown'").groupBy(*keys, "name").agg(F.min_by("type", F.struct(-F.col("votes"), F.col("type"))).alias("type"))
    seen = fields.groupBy(*keys, "name").agg(F.count("*").alias("seen"), F.countDistinct("raw").alias("distinct_values"))
    out = seen.join(best, [*keys, "name"], "left").join(samples, keys) if keys else seen.join(best, ["name"], "left").crossJoin(samples)
    enum = (F.col("type") == "string") & (F.col("seen") >= 5) & F.col("distinct_values").between(2, 20)
    return out.select(*keys, "name", F.coalesce("type", F.lit("unknown")).alias("type"), "seen", "distinct_values", (F.col("seen") >= F.col("bodies")).alias("required"), F.coalesce(enum, F.lit(False)).alias("is_enum"))
