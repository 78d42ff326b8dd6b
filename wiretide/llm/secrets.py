"""Secrets in texts: fixed patterns, and tokens that a battery of randomness tests can't tell from random.

A candidate is a maximal run of key characters, and its encoding the smallest alphabet that holds
it. Three tests measure how far it is from uniform random symbols: chi-squared over classes of the
alphabet, the number of runs above and below its middle, and the correlation of neighbours. Fisher's
sum of their logarithms is small for random tokens. How small it gets by chance for text that is no
secret is known from a null model: chains of symbols with the neighbour frequencies of the whole
corpus, of the same encoding and length, as short chains look random more often. Benjamini and
Hochberg's procedure on these p-values of distinct tokens, in each class of encoding and length, and
the battery itself, which must not reject that the token is random, say which candidates are reported.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import table
from .textbytes import flat, hash_spans, slices, spans_of

#: The patterns of known kinds in the order of their listing, and the least size of what they catch.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
KINDS = ["assign", "access", "hex", "random"]

_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Alphabets from narrow to wide; digits alone are numbers and no encoding of a key.
ENCODINGS = {
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "lower": _LOWER,
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "BASE36": _DIGITS + _UPPER,
    "base62": _UPPER + _LOWER + _DIGITS,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
NAMES = list(ENCODINGS)
SIZES = np.array([len(x) for x in ENCODINGS.values()])
#: Place of each byte in each alphabet, -1 outside; and alphabets that hold a byte, as bits.
PLACES = np.full((len(NAMES), 256), -1, np.int16)
for _k, _letters in enumerate(ENCODINGS.values()):
    PLACES[_k, list(_letters.encode())] = np.arange(len(_letters))
HOLDS = ((PLACES >= 0) * (1 << np.arange(len(NAMES)))[:, None]).sum(axis=0)
_KEY = np.zeros(256, bool)
_KEY[list((_UPPER + _LOWER + _DIGITS + "+/-_").encode())] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_HEX = PLACES[0] >= 0

#: Lengths at which classes begin; the null model of a class has chains of its least length.
LENGTHS = np.array([20, 24, 28, 32, 40, 48, 64, 96, 128])
SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, base string, candidates array<struct<start:long,end:long,stratum:int,token:long,t:double>>, pairs array<struct<stratum:int,pair:int,n:long>>"


@dataclass(frozen=True)
class Battery:
    """Share of false reports allowed in each class, of random tokens that the battery may miss, and chains of a null model."""

    rate: float = 0.05
    missed: float = 0.01
    chains: int = 1 << 15
    seed: int = 7


def most_random(missed: float) -> float:
    """The value that Fisher's statistic of three tests of random symbols exceeds with this probability."""
    low, high = 0.0, 1000.0
    for _ in range(60):
        x = (low + high) / 2
        low, high = (x, high) if math.exp(-x / 2) * (1 + x / 2 + x * x / 8) > missed else (low, x)
    return high


def tail(z: np.ndarray) -> np.ndarray:
    """Probability that a standard normal is above z."""
    return np.array([0.5 * math.erfc(x / math.sqrt(2)) for x in z.tolist()])


def battery(symbols: np.ndarray, bounds: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Fisher's statistic of each token: small if the three tests find nothing against random symbols.

    ``symbols`` are places in the alphabets, ``bounds`` those of tokens, ``size`` their alphabets'.
    """
    if len(bounds) < 2:
        return np.zeros(0)
    n = np.diff(bounds)
    of = np.repeat(np.arange(len(n)), n)
    head = bounds[:-1]
    # Chi-squared: as many classes of the alphabet as leave five symbols in each, two at least.
    classes = np.clip(np.minimum(n // 5, size), 2, 16)
    low = -(-(np.arange(17)[None, :] * size[:, None]) // classes[:, None])  # the first symbol of each class
    width = np.diff(low, axis=1).clip(0) * (np.arange(16)[None, :] < classes[:, None])
    counts = np.bincount(of * 16 + symbols * classes[of] // size[of], minlength=16 * len(n)).reshape(-1, 16)
    expected = width * (n / size)[:, None]
    x = np.where(width > 0, (counts - expected) ** 2 / np.where(width > 0, expected, 1), 0).sum(axis=1)
    k = classes - 1
    uniform = tail(((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / np.sqrt(2 / (9 * k)))
    # Runs of symbols above and below the middle (Wald and Wolfowitz).
    up = (2 * symbols >= size[of]).astype(np.int64)
    change = np.zeros(len(up), np.int64)
    change[1:] = up[1:] != up[:-1]
    change[head] = 0
    above = np.add.reduceat(up, head)
    runs = 1 + np.add.reduceat(change, head)
    mean = 2.0 * above * (n - above) / n + 1
    spread = np.sqrt(np.maximum((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    run = 2 * tail(np.abs(runs - mean) / spread)
    run[(above == 0) | (above == n)] = 0
    # Correlation of neighbours.
    centred = symbols - (np.add.reduceat(symbols, head) / n)[of]
    product = np.zeros(len(centred))
    product[1:] = centred[1:] * centred[:-1]
    product[head] = 0
    square = np.add.reduceat(centred**2, head)
    r = np.divide(np.add.reduceat(product, head), square, out=np.ones(len(n)), where=square > 0)
    serial = 2 * tail(np.abs(r + 1 / n) * np.sqrt(n))
    # Rounded, so that equal tokens have equal statistics whatever stands beside them.
    return np.round(-2 * sum(np.log(np.maximum(p, 1e-300)) for p in (uniform, run, serial)), 6)


def candidates(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, classes and statistics of runs of key characters whose encoding is known."""
    starts, ends = spans_of(_KEY[raw], at)
    keep = ends - starts >= LENGTHS[0]
    starts, ends = starts[keep], ends[keep]
    if not len(starts):
        return starts, ends, np.zeros(0, np.int64), np.zeros(0)
    n = ends - starts
    lead = np.cumsum(n) - n
    inner = np.arange(int(n.sum())) - np.repeat(lead - starts, n)
    data = raw[inner]
    common = np.bitwise_and.reduceat(HOLDS[data], lead)
    digits = np.logical_and.reduceat(_DIGIT[data], lead)
    known = (common > 0) & ~digits
    # The lowest bit is the narrowest alphabet.
    encoding = np.log2(np.where(known, common & -common, 1)).astype(np.int64)
    keep = np.repeat(known, n)
    symbols = PLACES[np.repeat(encoding[known], n[known]), data[keep]].astype(np.int64)
    bounds = np.concatenate(([0], np.cumsum(n[known])))
    t = battery(symbols, bounds, SIZES[encoding[known]])
    stratum = encoding[known] * len(LENGTHS) + np.searchsorted(LENGTHS, n[known], "right") - 1
    return starts[known], ends[known], stratum, t


def neighbours(raw: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """How often each two symbols of an alphabet follow each other in a text, other characters left out."""
    out = []
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for k, size in enumerate(SIZES.tolist()):
        place = PLACES[k][raw]
        kept = np.flatnonzero(place >= 0)
        symbol, of = place[kept].astype(np.int64), text[kept]
        inside = of[1:] == of[:-1]
        out.append(np.bincount((symbol[:-1] * size + symbol[1:])[inside], minlength=size * size))
    return out


def base_spans(data: bytes) -> list[tuple[int, int, int]]:
    """Byte spans of the fixed kinds in one text, but for hexadecimal runs: (start, kind, end)."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(data) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    return out + [(m.start(), 1, m.end()) for m in ACCESS.finditer(data) if m.end() - m.start() >= ACCESS_LEAST]


def scanned(docs: DataFrame) -> DataFrame:
    """A row per document with its fixed spans and candidates; a last row per task (null base) has the neighbour counts."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("stratum", pa.int32()), ("token", pa.int64()), ("t", pa.float64())]))
    pair = pa.list_(pa.struct([("stratum", pa.int32()), ("pair", pa.int32()), ("n", pa.int64())]))
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base", "candidates", "pairs"]

    def rows(part: pa.RecordBatch, total: list[np.ndarray]) -> pa.RecordBatch:
        raw, at = flat(part.column(1))
        for sums, own in zip(total, neighbours(raw, at), strict=True):
            sums += own
        # Code points before each byte.
        points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        data, bounds = raw.tobytes(), at.tolist()
        starts, ends = spans_of(_HEX[raw], at)
        long = ends - starts >= HEX_LEAST
        starts, ends = starts[long], ends[long]
        hexes = np.searchsorted(starts, at)
        first, last, stratum, t = candidates(raw, at)
        token = hash_spans(raw, first, last).view(np.int64)
        of = np.searchsorted(first, at)
        counts, base, found = [], [], []
        for i in range(part.num_rows):
            a, b = bounds[i], bounds[i + 1]
            text = base_spans(data[a:b])
            n = [sum(k == kind for _, k, _ in text) for kind in (0, 1)]
            text += [(s - a, 2, e - a) for s, e in zip(starts[hexes[i] : hexes[i + 1]].tolist(), ends[hexes[i] : hexes[i + 1]].tolist(), strict=True)]
            counts.append((*n, len(text) - sum(n)))
            shift = int(points[a])
            base.append(",".join(f"{KINDS[k]}:{int(points[a + s]) - shift}:{int(points[a + e]) - shift}" for s, k, e in sorted(text)))
            j = slice(of[i], of[i + 1])
            found.append([{"start": int(points[s]) - shift, "end": int(points[e]) - shift, "stratum": k, "token": h, "t": v} for s, e, k, h, v in zip(first[j].tolist(), last[j].tolist(), stratum[j].tolist(), token[j].tolist(), t[j].tolist(), strict=True)])
        sums = np.array(counts, np.int64).reshape(-1, 3)
        return pa.RecordBatch.from_arrays([part.column(0), *(pa.array(sums[:, k]) for k in range(3)), pa.array(base, pa.string()), pa.array(found, span), pa.nulls(part.num_rows, pair)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(s * s, np.int64) for s in SIZES.tolist()]
        for batch in batches:
            for part in slices(batch):
                yield rows(part, total)
        pairs = [{"stratum": k, "pair": p, "n": int(own[p])} for k, own in enumerate(total) for p in np.flatnonzero(own).tolist()]
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 4 + [pa.nulls(1, pa.string()), pa.nulls(1, span), pa.array([pairs], pair)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCANNED)


def chains(follow: np.ndarray, length: int, how_many: int, rng: np.random.Generator) -> np.ndarray:
    """Rows of symbols, each drawn given the one before by the frequencies of neighbours."""
    first = np.cumsum(follow.sum(axis=1) / follow.sum())
    steps = np.cumsum(follow / np.maximum(follow.sum(axis=1, keepdims=True), 1), axis=1)
    # A symbol that nothing followed goes on as a chain begins.
    steps[follow.sum(axis=1) == 0] = first
    # Row k of the flat table lies in k to k + 1, so one search serves every chain.
    table_, size = (steps + np.arange(len(steps))[:, None]).ravel(), len(steps)
    out = np.empty((how_many, length), np.int64)
    out[:, 0] = np.searchsorted(first, rng.random(how_many)).clip(0, size - 1)
    for i in range(1, length):
        before = out[:, i - 1]
        out[:, i] = (np.searchsorted(table_, before + rng.random(how_many)) - before * size).clip(0, size - 1)
    return out


def null_model(pairs: DataFrame, settings: Battery) -> dict[int, np.ndarray]:
    """Sorted statistics of chains for each class of encoding and length that has candidates.

    ``pairs`` (stratum: encoding, pair, n; and wanted classes as rows without pair) has a row per two
    symbols of an alphabet and per class: at most some 20,000 whatever the corpus.
    """
    spark = pairs.sparkSession
    got = pairs.collect()  # bounded by the alphabets
    follow = [np.zeros((s, s)) for s in SIZES.tolist()]
    for r in got:
        if r["pair"] is not None:
            follow[r["stratum"]].flat[r["pair"]] = r["n"]
    wanted = sorted(r["stratum"] for r in got if r["pair"] is None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.column(0).to_pylist():
                encoding, length = s // len(LENGTHS), int(LENGTHS[s % len(LENGTHS)])
                own = follow[encoding]
                if own.sum() == 0:
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([b""], pa.binary())], names=["stratum", "t"])
                    continue
                drawn = chains(own, length, settings.chains, np.random.default_rng([settings.seed, s]))
                t = battery(drawn.ravel(), np.arange(0, drawn.size + 1, length), np.full(len(drawn), SIZES[encoding]))
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.sort(t).tobytes()], pa.binary())], names=["stratum", "t"])

    if not wanted:
        return {}
    todo = spark.createDataFrame([(s,) for s in wanted], "stratum int").repartition(len(wanted))
    return {r["stratum"]: np.frombuffer(r["t"]) for r in todo.mapInArrow(run, "stratum int, t binary").collect()}  # classes x chains


def secrets(docs: DataFrame, settings: Battery = Battery()) -> DataFrame:
    """doc_id, counts of the fixed kinds, their spans (``base``) and all spans, one row for each row of docs.

    Spans are kind:start:end in code points, end exclusive, by start and then kind as KINDS lists
    them; ``assign`` spans the whole match. Null and empty texts have none. Equal texts get equal
    spans; doc_id may be null or repeat; further columns are ignored; an empty table gives none. The
    counts behind the null model are taken over all texts.
    """
    stored = table(scanned(docs), "scanned")
    each = stored.where("size(candidates) > 0").select(F.explode("candidates").alias("c")).select("c.stratum", "c.token", "c.t").distinct().drop("token")
    neighbours_ = stored.where("base is null").select(F.explode("pairs").alias("p")).groupBy("p.stratum", "p.pair").agg(F.sum("p.n").alias("n"))
    null = null_model(neighbours_.unionByName(each.select("stratum").distinct().selectExpr("stratum", "cast(null as int) AS pair", "cast(null as long) AS n")), settings)
    held = docs.sparkSession.sparkContext.broadcast(null)

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many chains of the class have a statistic as small; all if there are none."""
        for batch in batches:
            stratum, t = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rank = np.full(len(t), settings.chains)
            for s in np.unique(stratum).tolist():
                if len(held.value[s]):
                    rank[stratum == s] = np.searchsorted(held.value[s], t[stratum == s], "right")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rank, pa.int32()), batch.column(1)], names=["stratum", "rank", "t"])

    # A row per class and rank: bounded by the null model, and summed before its shuffle.
    steps = each.mapInArrow(ranks, "stratum int, rank int, t double").groupBy("stratum", "rank").agg(F.count("*").alias("n"), F.max("t").alias("t"))
    upto = Window.partitionBy("stratum").orderBy("rank")
    p = (F.col("rank") + 1) / F.lit(settings.chains + 1.0)
    passed = steps.withColumns({"seen": F.sum("n").over(upto), "all": F.sum("n").over(Window.partitionBy("stratum"))}).where(p <= settings.rate * F.col("seen") / F.col("all"))
    limits = {r["stratum"]: min(r["t"], most_random(settings.missed)) for r in passed.groupBy("stratum").agg(F.max("t").alias("t")).collect()}  # one per class
    limit = F.create_map(*(F.lit(v) for s, t in sorted(limits.items()) for v in (s, t))) if limits else None
    random = F.filter("candidates", lambda c: c["t"] <= limit[c["stratum"]]) if limits else F.filter("candidates", lambda c: F.lit(False))
    number = {k: i for i, k in enumerate(KINDS)}
    place = lambda x: F.create_map(*(F.lit(v) for item in number.items() for v in item))[F.substring_index(x, ":", 1)]
    base = F.filter(F.split("base", ","), lambda x: x != "")
    keyed = F.concat(
        F.transform(base, lambda x: F.struct(F.element_at(F.split(x, ":"), 2).cast("long").alias("start"), place(x).alias("kind"), x.alias("span"))),
        F.transform(random, lambda c: F.struct(c["start"].alias("start"), F.lit(number["random"]).alias("kind"), F.concat(F.lit("random:"), c["start"], F.lit(":"), c["end"]).alias("span"))),
    )
    spans = F.array_join(F.transform(F.array_sort(keyed), lambda k: k["span"]), ",")
    return stored.where("base is not null").select("doc_id", "n_assign", "n_access", "n_hex", "base", spans.alias("spans"))
