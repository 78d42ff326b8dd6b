"""Flow state in batches and streams, and the catalogue that grows by parts."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from wiretide.operators import catalogue, flows, processes
from wiretide.operators.endpoints import requests
from wiretide.streaming import lives

PACKETS = "k long, ts timestamp, seq long, direction string, data binary, ended boolean"
START = dt.datetime(2024, 1, 1)


def packets(n, seed=1):
    rng, t, rows = random.Random(seed), 0.0, []
    for i in range(n):
        t += rng.choice([0.1, 1, 3, 20])
        rows.append((rng.randint(1, 5), START + dt.timedelta(seconds=t), i, rng.choice(["tx", "rx"]), rng.randbytes(rng.randint(1, 30)) if rng.random() < 0.9 else None, rng.random() < 0.08))
    return rows


def brute_lives(rows, most, idle):
    out, open_ = [], {}

    def close(k, ended):
        first, last, sides = open_.pop(k)
        if sides["tx"] or sides["rx"]:
            out.append((k, first, last, sides["tx"][-most:], sides["rx"][-most:], len(sides["tx"]), len(sides["rx"]), ended))

    for k, ts, _, direction, data, ended in sorted(rows, key=lambda r: (r[1], r[2])):
        if k in open_ and (ts - open_[k][1]).total_seconds() > idle:
            close(k, False)
        first, _, sides = open_.get(k, (ts, ts, {"tx": b"", "rx": b""}))
        sides[direction] += data or b""
        open_[k] = (first, ts, sides)
        if ended:
            close(k, True)
    for k in list(open_):
        close(k, False)
    return sorted(out)


def rows_of(frame):
    return sorted((r[0], r[1], r[2], bytes(r[3]), bytes(r[4]), *r[5:]) for r in frame.collect())


def test_lives_equal_brute_force(spark):
    rows = packets(500)
    for most, idle in ((40, 30), (1 << 16, 15), (1, 1000)):
        got = flows.lives(spark.createDataFrame(rows, PACKETS).repartition(3), ["k"], most, f"{idle} seconds")
        assert rows_of(got) == brute_lives(rows, most, idle)
    assert flows.lives(spark.createDataFrame([], PACKETS), ["k"]).count() == 0


def test_a_long_flow_is_cut_before_it_is_gathered(spark):
    own = spark.range(40_000).select(F.lit(1).alias("flow"), F.col("id").alias("ts_ns"), F.lit(0).alias("seq"), F.lit("tx").alias("direction"), F.lit("10.0.0.1:99").alias("dst"), F.encode(F.format_string("%06d", F.col("id")), "UTF-8").alias("data"))
    (kept,) = flows.streams(own, most=100).collect()
    assert bytes(kept["tx"]) == "".join(f"{i:06d}" for i in range(39_000, 40_000)).encode()[-100:] and bytes(kept["rx"]) == b""
    (whole,) = flows.streams(own).collect()
    assert len(whole["tx"]) == 240_000


@pytest.fixture
def state_store(spark):
    before = spark.conf.get(lives.PROVIDER[0])
    spark.conf.set(*lives.PROVIDER)
    yield
    spark.conf.set(lives.PROVIDER[0], before)


def test_stream_of_lives_equals_the_batch(spark, state_store, tmp_path):
    """Packets come in any order within the watermark; the query is stopped and started again."""
    rows, late = packets(300), 60
    rng = random.Random(2)
    come = sorted(rows, key=lambda r: r[1] + dt.timedelta(seconds=rng.uniform(0, late - 5)))
    far = START + dt.timedelta(days=2)
    marks = [(99, far, 1000, "tx", b"x", True), (98, far + dt.timedelta(hours=1), 1001, "tx", b"x", False)]
    parts = [come[i : i + 75] for i in range(0, 300, 75)] + [[m] for m in marks]
    left = []
    for i, part in enumerate(parts):
        spark.createDataFrame(part, PACKETS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if i in (1, 3, 4, 5):  # four runs of the query over one checkpoint
            stream = spark.readStream.schema(PACKETS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withWatermark("ts", f"{late} seconds")
            found = lives.lives(stream, ["k"], 40, "30 seconds")
            query = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
            assert query.awaitTermination(200)
            left.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert rows_of(spark.read.parquet(f"{tmp_path}/out").where("k < 90")) == brute_lives(rows, 40, 30)
    # Only the packet that no watermark has passed yet is left.
    assert left[0] > 1 and left[-1] == 1


CALLS = "url string, ts long, status int, latency double, request_bytes long, response_bytes long"


def calls(spark, n, seed=3):
    rng = random.Random(seed)
    paths = ["/a/{}", "/a/{}/x", "/", "/b?q={}&token=s{}", "/c?on=true&n=1.5"]
    rows = [(f"http://h{rng.randint(1, 3)}{rng.choice(paths).replace('{}', str(rng.randint(1, 500)))}", i, rng.choice([200, 404, None]), rng.choice([None, rng.lognormvariate(3, 1)]), rng.choice([0, 10, None]), rng.randint(1, 9)) for i in range(n)]
    return spark.createDataFrame(rows, CALLS)


def facts(part):
    ends = sorted(map(str, catalogue.endpoints(part).collect()))
    return ends, sorted(map(str, catalogue.params(part).collect()))


def test_parts_merge_to_the_whole(spark):
    own = requests(calls(spark, 900)).cache()
    pieces = [catalogue.part(own.where(F.col("ts") % 4 == k)) for k in range(4)]
    whole = facts(catalogue.part(own))
    assert facts(catalogue.merged(*pieces)) == whole
    assert facts(catalogue.merged(catalogue.merged(*pieces[2:]), pieces[1], pieces[0], catalogue.part(own.limit(0)))) == whole
    exact = {tuple(r)[:3]: r[3] for r in own.selectExpr("host", "shape", "regexp_extract(query, 'q=([0-9]+)', 1) AS q").where("q <> ''").groupBy("host", "shape").agg(F.lit("q"), F.countDistinct("q")).collect()}
    about = {(r["host"], r["shape"], r["name"]): r["distinct_values"] for r in catalogue.params(catalogue.part(own)).where("name = 'q'").collect()}
    assert set(about) == set(exact) and all(abs(about[k] - exact[k]) <= 0.05 * exact[k] for k in exact)


def test_merged_quantiles_keep_their_rank(spark):
    """Skewed values, one key with most of them: ranks of 20 merged sketches are off by less than 0.2 %."""
    own = spark.range(200_000, numPartitions=20).select(F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("k"), F.spark_partition_id().alias("part"), F.exp(3 * F.randn(5)).alias("v")).cache()
    merged = catalogue.merged_sketches(catalogue.sketched(own, ["k", "part"], "v"), ["k"])
    ranks = (0.01, 0.5, 0.9, 0.99)
    for r in merged.select("k", "n", F.array(*catalogue.quantiles(F.col("sketch"), *ranks)).alias("q")).collect():
        mine = own.where(F.col("k") == r["k"])
        below = mine.agg(*(F.avg((F.col("v") <= v).cast("int")) for v in r["q"])).first()
        assert r["n"] == mine.count() and all(abs(got - want) < 0.002 for got, want in zip(below, ranks, strict=True))


def test_quantiles_are_exact_beyond_a_sketch(spark):
    """20,000 skewed values of a key and more, null keys, NaN, nulls; a sketch of other values changes nothing."""
    rng = random.Random(8)
    rows = [(k, rng.randint(0, 40), round(rng.expovariate(0.01), 2)) for k, n in (("hot", 20_000), (None, 9_000), ("few", 3)) for _ in range(n)]
    rows += [("few", 1, None), ("none", 1, None), ("odd", 1, float("nan")), ("hot", 2, float("nan"))]
    own = spark.createDataFrame(rows, "k string, part int, v double").repartition(6)
    counts = catalogue.counted(own, ["k"], "v")
    sketches = catalogue.merged_sketches(catalogue.sketched(own, ["k", "part"], "v"), ["k"])
    other = catalogue.sketched(own.withColumn("v", F.col("v") % 7 + 300), ["k"], "v")
    ranks = (0.001, 0.5, 0.9, 0.99)
    values = {k: sorted((v for x, _, v in rows if x == k and v is not None), key=lambda v: (math.isnan(v), v)) for k in ("hot", None, "few", "odd")}
    want = {k: [str(v[max(1, -(-len(v) * round(1000 * r) // 1000)) - 1]) for r in ranks] for k, v in values.items()}
    for known in (sketches, other, sketches.limit(0)):
        got = {r[0]: [str(x) for x in r[1:]] for r in catalogue.exact_quantiles(counts, known, ["k"], "v", *ranks).collect()}
        assert got == want


def test_latencies_of_a_busy_endpoint_are_exact(spark):
    rng = random.Random(9)
    took = [rng.lognormvariate(3, 1) for _ in range(12_000)]
    own = requests(spark.createDataFrame([("http://h/a", i, 200, x, 1, 1) for i, x in enumerate(took)], CALLS))
    (r,) = catalogue.endpoints(catalogue.merged(*(catalogue.part(own.where(F.col("ts") % 3 == k)) for k in range(3)))).collect()
    took.sort()
    assert (r["p50"], r["p99"]) == (took[5999], took[11879])


def test_a_lost_writer_loses_nothing(spark, tmp_path):
    place, own = str(tmp_path / "catalogue"), requests(calls(spark, 400)).cache()
    first, second = own.where("ts < 200"), own.where("ts >= 200")
    assert catalogue.load(spark, place) is None
    catalogue.fold(first, 0, place)
    # A writer that is lost before its mark leaves tables that no reader sees and the next attempt overwrites.
    catalogue.part(second)["endpoints"].write.parquet(f"{place}/v2/endpoints")
    assert catalogue.versions(spark, place) == [1] and facts(catalogue.load(spark, place)) == facts(catalogue.part(first))
    catalogue.fold(second, 1, place)
    catalogue.fold(second, 1, place)  # the same batch again
    assert catalogue.versions(spark, place) == [1, 2] and facts(catalogue.load(spark, place)) == facts(catalogue.part(own))
    catalogue.fold(own.limit(0), 2, place)
    assert catalogue.versions(spark, place) == [2, 3] and facts(catalogue.load(spark, place)) == facts(catalogue.part(own))


def test_a_stream_folds_its_batches(spark, tmp_path):
    own = calls(spark, 300)
    for k in range(3):
        own.where(F.col("ts") % 3 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = requests(spark.readStream.schema(CALLS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    query = stream.writeStream.foreachBatch(lambda frame, batch: catalogue.fold(frame, batch, f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
    assert query.awaitTermination(200)
    assert catalogue.versions(spark, f"{tmp_path}/out") == [2, 3] and facts(catalogue.load(spark, f"{tmp_path}/out")) == facts(catalogue.part(requests(own)))


def below(edges, roots):
    out, todo = set(roots), list(roots)
    down = {}
    for a, b in edges:
        down.setdefault(a, []).append(b)
    while todo:
        for x in down.get(todo.pop(), []):
            if x not in out:
                out.add(x)
                todo.append(x)
    return out


def descended(spark, edges, roots):
    forks, start = spark.createDataFrame(edges, "parent long, child long"), spark.createDataFrame([(r,) for r in roots], "pid long")
    return sorted(r[0] for r in processes.descendants(forks, start).collect())


def test_a_chain_of_five_thousand_and_a_cycle(spark):
    chain = [(i, i + 1) for i in range(5000)]
    assert descended(spark, chain, [100]) == list(range(100, 5001))
    ring = [(i, (i + 1) % 37) for i in range(37)] + [(5, 100), (100, 101)]
    assert descended(spark, ring, [36]) == sorted(below(ring, [36]))
    assert descended(spark, [(1, 1), (1, None), (None, 2)], [1, None, 1]) == [1]
    assert descended(spark, [], [4]) == [4] and descended(spark, chain[:3], []) == []


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_descendants_of_any_graph(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(rng.choice([30, 60, 90]))]
    roots = [rng.randint(0, 60) for _ in range(2)]
    assert descended(spark, edges + edges[:5], roots) == sorted(below(edges, roots))
