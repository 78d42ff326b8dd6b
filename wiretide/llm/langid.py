"""Language identification with interpolated Kneser-Ney models of characters.

Each language has n-gram counts of orders 1 to 4: raw counts at order 4, and below it the number of
distinct characters that precede an n-gram. They are counted over all training texts with Spark
and kept as sorted arrays of 22-bit n-gram hashes, so a model has at most ``4 * 2 * 2**22`` entries
per language however large the corpus is. A text gets the language with the lowest cross-entropy
per character; it is rejected where that is far above what the language's own texts have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, table
from .textbytes import flat, mix, slices

ORDER = 4
HASH_BITS = 22
#: N-grams whose log probabilities a Python worker keeps.
MOST_KNOWN = 1 << 20
#: Scales of which calibration takes the likeliest.
SCALES = (1, 2, 4, 8, 16, 32)
#: Calibration sums whole multiples of 1 / UNIT, so that no order of the texts changes a sum.
UNIT = 1 << 20
SPACE = 32
_SYMBOL: np.ndarray | None = None


def symbols() -> np.ndarray:
    """A 16-bit symbol for each code point: letters in lower case, all else a space."""
    global _SYMBOL
    if _SYMBOL is None:
        own = np.full(0x110000, SPACE, np.uint16)
        for c in range(0x110000):
            char = chr(c)
            if char.isalpha():
                low = char.lower()
                low = ord(low) if len(low) == 1 else c
                own[c] = low if low < 0xF000 else 0x1000 + low % 0xE000
        _SYMBOL = own
    return _SYMBOL


class Grams:
    """N-grams (four 16-bit symbols, the last one lowest) of all texts of a column."""

    def __init__(self, column: pa.Array):
        raw, at = flat(column)
        code = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        bounds = lead[at]
        symbol = symbols()[code]
        text = np.repeat(np.arange(len(at) - 1), np.diff(bounds))
        blank = symbol == SPACE
        keep = np.ones(len(symbol), bool)
        keep[1:] = ~(blank[1:] & blank[:-1] & (text[1:] == text[:-1]))
        starts = bounds[:-1][np.diff(bounds) > 0]
        keep[starts] &= ~blank[starts]
        symbol, text = symbol[keep], text[keep]
        counts = np.bincount(text, minlength=len(at) - 1)
        pad = ORDER - 1
        padded = np.full(len(symbol) + pad * (len(at) - 1), SPACE, np.uint64)
        place = np.arange(len(symbol)) + pad * (text + 1)
        padded[place] = symbol
        gram = padded[place]
        for back in range(1, ORDER):
            gram |= padded[place - back] << np.uint64(16 * back)
        self.gram, self.text, self.counts = gram, text, counts
        self.letters = np.bincount(text, symbol != SPACE, minlength=len(at) - 1)
        self.first = np.concatenate(([0], np.cumsum(counts)))


def short(gram: np.ndarray, order: int) -> np.ndarray:
    """The hash of n-grams of one order."""
    return (mix(gram * np.uint64(8) + gram // np.uint64(1 << 60) + np.uint64(order)) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def counted(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) over all texts of rows (lang, text); counts are combined within each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for own in slices(batch):
                codes = own.column(0).dictionary_encode()
                of = codes.indices.to_numpy()
                got = Grams(own.column(1))
                lang = of[got.text]
                for i, name in enumerate(codes.dictionary.to_pylist()):
                    gram, n = np.unique(got.gram[lang == i], return_counts=True)
                    if name in held:
                        both = np.concatenate((held[name][0], gram))
                        whole, back = np.unique(both, return_inverse=True)
                        n = np.bincount(back, np.concatenate((held[name][1], n)), minlength=len(whole)).astype(np.int64)
                        gram = whole
                    held[name] = gram, n
                if sum(len(g) for g, _ in held.values()) > 2 * MOST_KNOWN:
                    yield from out(held)
                    held = {}
        yield from out(held)

    def out(held: dict) -> Iterator[pa.RecordBatch]:
        for name, (gram, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    parts = rows.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(run, "lang string, gram long, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Sorted hash arrays of all languages and orders."""

    def __init__(self, langs: list[str], grams: dict, contexts: dict, discounts: dict):
        self.langs, self.grams, self.contexts, self.discounts = langs, grams, contexts, discounts
        self.scale, self.limit = 1.0, {x: np.inf for x in langs}
        self.known, self.logs = np.zeros(0, np.uint64), np.zeros((0, len(langs)), np.float32)

    @staticmethod
    def look(sorted_keys: np.ndarray, keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
        place = np.minimum(np.searchsorted(sorted_keys, keys), max(len(sorted_keys) - 1, 0))
        hit = sorted_keys[place] == keys if len(sorted_keys) else np.zeros(len(keys), bool)
        return [np.where(hit, v[place] if len(v) else 0, 0) for v in values]

    def log_probabilities(self, gram: np.ndarray) -> np.ndarray:
        """A row of natural logarithms for each n-gram, a column for each language."""
        out = np.empty((len(gram), len(self.langs)), np.float32)
        for i, lang in enumerate(self.langs):
            p = np.full(len(gram), 1 / 65536)
            for order in range(1, ORDER + 1):
                low = gram & np.uint64((1 << 16 * order) - 1) if order < 4 else gram
                (count,) = self.look(self.grams[lang, order][0], short(low, order), self.grams[lang, order][1])
                keys, total, types = self.contexts[lang, order]
                total, types = self.look(keys, short(low >> np.uint64(16), order), total, types)
                d = self.discounts[lang, order]
                p = np.where(total > 0, (np.maximum(count - d, 0) + d * types * p) / np.maximum(total, 1), p)
            out[:, i] = np.log(p)
        return out

    def logs_of(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers for each n-gram and the table of logarithms they point into."""
        import pandas as pd

        code, distinct = pd.factorize(gram)
        if len(self.known) > MOST_KNOWN:
            self.known, self.logs = self.known[:0], self.logs[:0]
        order = np.argsort(distinct)
        ordered = distinct[order]
        place = np.searchsorted(self.known, ordered)
        fresh = np.ones(len(ordered), bool)
        inside = place < len(self.known)
        fresh[inside] = self.known[place[inside]] != ordered[inside]
        if fresh.any():
            new = ordered[fresh]
            self.logs = np.insert(self.logs, place[fresh], self.log_probabilities(new), axis=0)
            self.known = np.insert(self.known, place[fresh], new)
        rows = np.empty(len(distinct), np.int64)
        rows[order] = np.searchsorted(self.known, ordered)
        return code, self.logs[rows]

    def entropies(self, got: Grams) -> np.ndarray:
        """Cross-entropy per character of each text under each language (zero for empty texts)."""
        code, logs = self.logs_of(got.gram)
        out = np.zeros((len(got.counts), len(self.langs)))
        for i in range(len(self.langs)):
            total = np.concatenate(([0.0], np.cumsum(logs[code, i], dtype=np.float64)))
            out[:, i] = (total[got.first[:-1]] - total[got.first[1:]]) / np.maximum(got.counts, 1)
        return out


def learn(rows: DataFrame) -> Model:
    """Models of all languages of rows (lang, text); rows without language or text don't count."""
    rows = rows.where("lang is not null and text is not null").select("lang", "text")
    grams = table(counted(rows), "grams")
    level, levels = grams, []
    for order in range(ORDER, 0, -1):
        levels.append(level.withColumn("order", F.lit(order)))
        mask = (1 << 16 * (order - 1)) - 1
        level = level.groupBy("lang", F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).agg(F.count("*").alias("n"))
    every = levels[0]
    for x in levels[1:]:
        every = every.unionByName(x)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gram, order = b.column(1).to_numpy().view(np.uint64), b.column(3).to_numpy()
            own, context = np.zeros(len(gram), np.int64), np.zeros(len(gram), np.int64)
            for k in np.unique(order).tolist():
                i = order == k
                own[i], context[i] = short(gram[i], k), short(gram[i] >> np.uint64(16), k)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(own), pa.array(context), b.column(2)], names=["lang", "order", "own", "context", "n"])

    keyed = table(every.mapInArrow(hashed, "lang string, order int, own long, context long, n long"), "keyed")
    # Both have at most 2**HASH_BITS rows for each language and order.
    own = keyed.groupBy("lang", "order", "own").agg(F.sum("n").alias("n")).toPandas()
    context = keyed.groupBy("lang", "order", "context").agg(F.sum("n").alias("n"), F.count("*").alias("types")).toPandas()
    few = keyed.groupBy("lang", "order").agg(F.sum((F.col("n") == 1).cast("long")).alias("one"), F.sum((F.col("n") == 2).cast("long")).alias("two")).collect()
    drop(grams, keyed)
    langs = sorted(own["lang"].unique().tolist())
    discounts = {(r["lang"], r["order"]): min(max(r["one"] / (r["one"] + 2 * r["two"]), 0.1), 0.95) if r["one"] else 0.5 for r in few}
    held, contexts = {}, {}
    for key, g in own.groupby(["lang", "order"]):
        g = g.sort_values("own")
        held[key] = g["own"].to_numpy(), g["n"].to_numpy(np.float64)
    for key, g in context.groupby(["lang", "order"]):
        g = g.sort_values("context")
        contexts[key] = g["context"].to_numpy(), g["n"].to_numpy(np.float64), g["types"].to_numpy(np.float64)
    model = Model(langs, held, contexts, discounts)
    calibrate(model, rows)
    return model


def calibrate(model: Model, rows: DataFrame) -> None:
    """Scale of scores and rejection limits from all training texts; a task sends sums by language only."""
    held = rows.sparkSession.sparkContext.broadcast(model)
    names = ["n", "one", "two", *(f"fit{k}" for k in range(len(SCALES)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Model = held.value
        sums = np.zeros((len(now.langs), len(names)), np.int64)
        for batch in batches:
            for own in slices(batch):
                got = Grams(own.column(1))
                keep = np.flatnonzero(got.letters > 0)
                found, true = now.entropies(got)[keep], np.array([now.langs.index(x) for x in own.column(0).take(pa.array(keep)).to_pylist()], np.int64)
                each = np.arange(len(true))
                mine, best = found[each, true], found - found.min(axis=1, keepdims=True)
                parts = [np.ones(len(true)) / UNIT, mine, mine**2]
                for scale in SCALES:
                    p = np.exp(-scale * best)
                    parts.append(np.log(np.maximum(p[each, true] / p.sum(axis=1), 1e-12)))
                np.add.at(sums, true, np.rint(np.stack(parts, axis=1) * UNIT).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(now.langs, pa.string()), *(pa.array(sums[:, k]) for k in range(len(names)))], names=["lang", *names])

    if not model.langs:
        return
    parts = rows.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(run, "lang string, " + ", ".join(f"{x} long" for x in names))
    got = {r["lang"]: np.array([int(r[x]) for x in names], np.float64) for r in parts.groupBy("lang").agg(*(F.sum(F.col(x).cast("decimal(20,0)")).alias(x) for x in names)).collect()}
    if sum(x[0] for x in got.values()):
        model.scale = float(SCALES[int(np.argmax(sum(x[3:] for x in got.values())))])
    for lang, (n, one, two, *_) in got.items():
        if n >= 5:
            mean = one / UNIT / n
            model.limit[lang] = float(mean + 4 * np.sqrt(max(two / UNIT / n - mean**2, 0.0)) + 0.1)
    held.unpersist()


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and rejected for each whole text.

    ``und`` with score 0 if a text is null or has no letter, or nothing was learned; ties go to
    the first language by name. A rejected text keeps its nearest language.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Model = held.value
        names = np.array([*now.langs, "und"], object)
        limit = np.array([now.limit[x] for x in now.langs])
        for batch in batches:
            for own in slices(batch):
                n = own.num_rows
                which, score, rejected = np.full(n, len(now.langs)), np.zeros(n), np.ones(n, bool)
                if now.langs:
                    got = Grams(own.column(1))
                    found = now.entropies(got)
                    fine = got.letters > 0
                    best = found.argmin(axis=1)
                    least = found[np.arange(n), best]
                    p = 1 / np.exp(-now.scale * (found - least[:, None])).sum(axis=1)
                    which, score = np.where(fine, best, which), np.where(fine, p, 0.0)
                    rejected = ~fine | (least > limit[best])
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(names[which], pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
