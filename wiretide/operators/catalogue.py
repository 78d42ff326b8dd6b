"""An API catalogue that grows by parts: aggregates that merge, kept in versions that appear at once.

A part has a table per kind of fact, each keyed by endpoint (host and shape). Merging two parts is one
more aggregation over their union, so parts may come in any number and order. Distinct values are HLL
sketches. Latencies are counts of each value, which give exact quantiles, and KLL sketches, which say where
in them to look: no key's values meet in one row.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.classify import PLACEHOLDERS, SECRET_KEY, narrowest, segment_class, value_kinds
from ..functions.text import url_decoded

KEYS = ["host", "shape"]
#: KLL's k: a rank is off by less than 0.1 % (at 99 % confidence), and nothing is lost while a key has at most so many values.
KLL_K = 4096
#: How far in rank from a quantile its exact value is looked for first.
NEAR = 0.002
HLL_BITS = 12
KINDS = ["integer", "number", "boolean", "uuid"]

Part = dict[str, DataFrame]


def quantiles(sketch: Column, *ranks: float) -> list[Column]:
    """Values at these ranks: the least value that such a share of the values doesn't exceed."""
    return [F.kll_sketch_get_quantile_double(sketch, F.lit(r)) for r in ranks]


def sketched(records: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A latency sketch per key and the number of its values; sketches of parts merge with ``merged_sketches``."""
    known = records.where(F.col(value).isNotNull())
    return known.groupBy(*keys).agg(F.count(value).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(KLL_K)).alias("sketch"))


def merged_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(KLL_K)).alias("sketch"))


def counted(records: DataFrame, keys: list[str], value: str) -> DataFrame:
    """How often each value of a key occurs (null too); counts of parts merge by their sum."""
    return records.groupBy(*keys, F.col(value).cast("double").alias(value)).agg(F.count("*").alias("n"))


def exact_quantiles(counts: DataFrame, sketches: DataFrame, keys: list[str], value: str, *ranks: float) -> DataFrame:
    """keys and q0, q1, ...: the least value that such a share of a key's values doesn't exceed, as SQL's quantile_disc.

    ``counts`` as ``counted`` gives it, ``sketches`` with each key's KLL sketch. The sketch only cuts a key's values into
    stretches, narrow ones around the ranks; the stretches are counted and the one that holds a rank is ranked. A sketch
    that is off makes that stretch longer, never the result another. Nulls don't count.
    """
    edges = sorted({min(max(r + d, 0.0), 1.0) for r in ranks for d in (-NEAR, NEAR)})
    known = F.kll_sketch_get_n_double("sketch") > 0  # NaN is in no sketch
    cuts = sketches.select(F.struct(*keys).alias("of"), *(F.when(known, q).alias(f"cut{i}") for i, q in enumerate(quantiles(F.col("sketch"), *edges))))
    own = counts.where(F.col(value).isNotNull()).select(F.struct(*keys).alias("key"), F.col(value).alias("value"), "n")
    stretch = sum((F.coalesce(F.col("value") > F.col(f"cut{i}"), F.lit(False)).cast("int") for i in range(len(edges))), F.lit(0))
    placed = own.join(cuts, F.col("key").eqNullSafe(F.col("of")), "left").select("key", "value", "n", stretch.alias("stretch"))
    lengths = placed.groupBy("key", "stretch").agg(F.sum("n").alias("n"))
    of_key = Window.partitionBy("key")
    before = F.coalesce(F.sum("n").over(of_key.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lengths = lengths.select("key", "stretch", "n", before.alias("before"), F.sum("n").over(of_key).alias("total"))
    places = [F.struct(F.lit(i).alias("i"), F.greatest(F.lit(1), F.ceil(F.col("total").cast("decimal(20,0)") * F.lit(Decimal(str(r)))).cast("long")).alias("place")) for i, r in enumerate(ranks)]
    wanted = lengths.select(F.col("key").alias("of"), F.col("stretch").alias("at"), "n", "before", F.explode(F.array(*places)).alias("p"))
    wanted = wanted.where((F.col("before") < F.col("p.place")) & (F.col("p.place") <= F.col("before") + F.col("n"))).select("of", "at", "p.i", (F.col("p.place") - F.col("before")).alias("place"))
    near = placed.join(wanted, F.col("key").eqNullSafe(F.col("of")) & (F.col("stretch") == F.col("at")))
    upto = F.sum("n").over(Window.partitionBy("key", "i").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    fine = near.select("key", "value", "i", (upto >= F.col("place")).alias("fine")).where("fine")
    return fine.groupBy("key").agg(*(F.min(F.when(F.col("i") == i, F.col("value"))).alias(f"q{i}") for i in range(len(ranks)))).select("key.*", *(f"q{i}" for i in range(len(ranks))))


def part(calls: DataFrame) -> Part:
    """Facts of calls: host, shape, segments and query as ``endpoints.requests`` gives them, ts, status, latency and both sizes.

    Status, latency and sizes may be null. Empty tables give empty facts.
    """
    size = lambda side: F.when(F.col(f"{side}_bytes") > 0, F.col(f"{side}_bytes"))
    sums = [x for s in ("request", "response") for x in (F.coalesce(F.sum(size(s)), F.lit(0)).cast("long").alias(f"{s}_bytes"), F.count(size(s)).alias(f"{s}_bodies"))]
    spot = calls.select(*KEYS, F.posexplode("segments").alias("pos", "value"))
    pair = calls.where("query is not null").select(*KEYS, F.explode(F.split("query", "&")).alias("pair")).where("pair <> ''")
    value = F.when(F.instr("pair", "=") > 0, F.substr("pair", F.instr("pair", F.lit("=")) + 1)).otherwise("")
    named = pair.select(*KEYS, url_decoded(F.substring_index("pair", "=", 1)).alias("name"), url_decoded(value).alias("value"))
    distinct = F.hll_sketch_agg("value", HLL_BITS).alias("distinct")
    return {
        "endpoints": calls.groupBy(*KEYS).agg(F.count("*").alias("calls"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), *sums),
        "statuses": calls.where("status is not null").groupBy(*KEYS, "status").agg(F.count("*").alias("n")),
        "latencies": sketched(calls, KEYS, "latency"),
        "latency_counts": counted(calls.where("latency is not null"), KEYS, "latency"),
        "segments": spot.groupBy(*KEYS, "pos").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), distinct),
        "params": named.groupBy(*KEYS, "name").agg(F.count("*").alias("n"), *(F.bool_and(x).alias(k) for k, x in value_kinds(F.col("value")).items()), F.max("value").alias("example"), distinct),
    }


def merged(*parts: Part) -> Part:
    """One part that says what all of them say."""
    all_ = {k: reduce(DataFrame.unionByName, [p[k] for p in parts]) for k in parts[0]}
    total = lambda *names: [F.sum(c).alias(c) for c in names]
    low, high = (lambda c: F.min(c).alias(c)), (lambda c: F.max(c).alias(c))
    distinct = F.hll_union_agg("distinct", False).alias("distinct")
    sums = total("request_bytes", "request_bodies", "response_bytes", "response_bodies")
    return {
        "endpoints": all_["endpoints"].groupBy(*KEYS).agg(*total("calls"), low("first_seen"), high("last_seen"), *sums),
        "statuses": all_["statuses"].groupBy(*KEYS, "status").agg(*total("n")),
        "latencies": merged_sketches(all_["latencies"], KEYS),
        "latency_counts": all_["latency_counts"].groupBy(*KEYS, "latency").agg(*total("n")),
        "segments": all_["segments"].groupBy(*KEYS, "pos").agg(*total("n"), low("low"), high("high"), distinct),
        "params": all_["params"].groupBy(*KEYS, "name").agg(*total("n"), *(F.bool_and(k).alias(k) for k in KINDS), high("example"), distinct),
    }


def endpoints(own: Part) -> DataFrame:
    """A row per endpoint: template, calls, times, sizes, statuses and latencies."""
    kind, mark = segment_class(F.col("low")), F.lit(None).cast("string")
    for name, sign in PLACEHOLDERS.items():
        mark = F.when(kind == name, F.lit(sign)).otherwise(mark)
    shown = F.when((F.col("low") != F.col("high")) & mark.isNotNull(), mark).otherwise(F.col("low"))
    parts = own["segments"].groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("pos", shown.alias("s")))).alias("parts"))
    template = F.coalesce(F.array_join(F.transform("parts", lambda p: F.concat(F.lit("/"), p["s"])), ""), F.lit("/"))
    statuses = own["statuses"].groupBy(*KEYS).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("statuses"))
    mean = lambda side: F.when(F.col(f"{side}_bodies") > 0, F.floor(F.col(f"{side}_bytes") / F.col(f"{side}_bodies"))).otherwise(0).cast("long").alias(f"avg_{side}_bytes")
    latency = exact_quantiles(own["latency_counts"], own["latencies"], KEYS, "latency", 0.5, 0.99)
    whole = own["endpoints"].join(parts, KEYS, "left").join(statuses, KEYS, "left").join(latency, KEYS, "left")
    return whole.select(*KEYS, template.alias("template"), "calls", "first_seen", "last_seen", mean("request"), mean("response"), "statuses", F.col("q0").alias("p50"), F.col("q1").alias("p99"))


def params(own: Part) -> DataFrame:
    """Query parameters of each endpoint: samples, about how many values, type, required, and an example."""
    kind = narrowest({k: F.col(k) for k in KINDS})
    example = F.when(F.col("name").rlike(SECRET_KEY), "<redacted>").otherwise(F.col("example"))
    joined = own["params"].join(own["endpoints"].select(*KEYS, "calls"), KEYS)
    return joined.select(*KEYS, "name", F.col("n").alias("samples"), F.hll_sketch_estimate("distinct").alias("distinct_values"), kind.alias("type"), (F.col("n") >= F.col("calls")).alias("required"), example.alias("example"))


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions at this place, ascending; what a lost writer left isn't one."""
    place, files = _files(spark, path)
    if not files.exists(place):
        return []
    found = [s.getPath() for s in files.listStatus(place)]
    at = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(p.getName()[1:]) for p in found if p.getName()[:1] == "v" and files.exists(at(p, "_DONE")))


def save(own: Part, path: str, version: int, keep: int = 2) -> None:
    """Write all tables of a version, then the mark that makes it the newest; older ones but ``keep`` go.

    A reader sees the version before or this one, never a part of it. Tables without a mark are overwritten.
    """
    spark = next(iter(own.values())).sparkSession
    for name, frame in own.items():
        frame.write.mode("overwrite").parquet(f"{path}/v{version}/{name}")
    mark, files = _files(spark, f"{path}/v{version}/_DONE")
    files.create(mark, True).close()
    for old in versions(spark, path)[:-keep]:
        # The mark goes first, so that no version is seen half deleted.
        files.delete(_files(spark, f"{path}/v{old}/_DONE")[0], False)
        files.delete(_files(spark, f"{path}/v{old}")[0], True)


def load(spark: SparkSession, path: str, before: int | None = None) -> Part | None:
    """The newest finished version (below ``before``), or nothing if there is none."""
    known = [v for v in versions(spark, path) if before is None or v < before]
    if not known:
        return None
    return {name: spark.read.parquet(f"{path}/v{known[-1]}/{name}") for name in ("endpoints", "statuses", "latencies", "latency_counts", "segments", "params")}


def fold(calls: DataFrame, batch: int, path: str) -> None:
    """Add a stream's batch to the catalogue, for ``foreachBatch``; a batch that is already in it changes nothing."""
    spark, version = calls.sparkSession, batch + 1
    if version in versions(spark, path):
        return
    before, new = load(spark, path, version), part(calls)
    save(merged(before, new) if before else new, path, version)
