"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts (P) and texts without any claim (U) train a linear numpy classifier on pieces
of words, words and word pairs. The risk of the negative class is estimated from U with the part of
P taken out by the class prior; where that estimate falls below zero its gradient is reversed, which
keeps the classifier from overfitting P (non-negative risk). The prior is estimated from the mixture
itself, P against U, so it doesn't matter how many of the toxic texts are marked; a label 0 is never
used. Scoring reads each text once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import drop, table
from .textbytes import Words, distinct, mix, slices, strings

#: Bytes of the word pieces, whose words have a blank on either side.
PIECES = (3, 4, 5, 6)
#: Bytes of the texts that are taken apart at once; a worker keeps what the largest slice needed.
SLICE = 1 << 18


@dataclass(frozen=True)
class Fit:
    """Bounds of what the fit reads and holds: sampled distinct texts of each kind, and terms kept."""

    positives: int = 4000
    unlabelled: int = 16000
    terms: int = 4096
    least: float = 5.0  # standard errors by which a term must be more frequent in P than in U
    epochs: int = 30
    batch: int = 512
    rate: float = 0.02
    decay: float = 1e-3
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """Terms in ascending order, two weights for each (count and density), and a bias."""

    terms: np.ndarray
    weights: np.ndarray
    bias: float


def in_fold(modulus: int, remainder: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) == remainder


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def folded(column: pa.Array) -> pa.Array:
    """Texts in lower case, for words of any script."""
    return pc.utf8_lower(strings(column))


def pieces(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of these words, and the place in ``which`` of the word that each comes from."""
    length = words.ends[which] - words.starts[which]
    size = length + 2
    end = np.cumsum(size)
    of = np.repeat(np.arange(len(which)), size)
    step = np.arange(int(end[-1]) if len(end) else 0) - np.repeat(end - size, size)
    inner = (step > 0) & (step <= length[of])
    raw = np.full(len(of), 32, np.uint64)
    raw[inner] = words.raw[(words.starts[which][of] + step - 1)[inner]]
    left = np.repeat(end, size) - np.arange(len(of))
    found, owner, packed = [], [], raw
    for n in range(2, max(PIECES) + 1):
        packed = (packed[:-1] << np.uint64(8)) | raw[n - 1 :] if len(packed) > 1 else packed[:0]
        if n in PIECES:
            at = np.flatnonzero(left[: len(packed)] >= n)
            found.append(packed[at] | np.uint64(n << 56))
            owner.append(of[at])
    return np.concatenate(found), np.concatenate(owner)


def hashes(terms: np.ndarray) -> np.ndarray:
    """44 bits of a term: they fit beside a row number, and two of some million terms hardly ever meet."""
    return mix(terms) >> np.uint64(20)


def word_terms(column: pa.Array, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of the distinct words of a slice, its (text, word) pairs, and its pairs of words.

    (word, term) ascending by word; text, word and how often for each distinct (text, word) where the
    word has a term; (text, term) of word pairs; and the words of each text. Terms are hashes; with
    ``wanted`` (sorted hashes) only these.
    """
    words = Words(folded(column))
    text = words.text_of()
    whole = words.hash | np.uint64(1) << np.uint64(63)
    unique, first, back = np.unique(whole, return_index=True, return_inverse=True)
    piece, owner = pieces(words, first)
    owner, term = np.concatenate((np.arange(len(unique)), owner)), hashes(np.concatenate((unique, piece)))
    inside = np.flatnonzero(text[:-1] == text[1:])
    pair, pair_text = hashes((mix(whole[inside] * np.uint64(3) + whole[inside + 1]) >> np.uint64(2)) | np.uint64(1) << np.uint64(62)), text[inside]
    if wanted is not None:
        gate = np.zeros(1 << 16, bool)
        gate[wanted >> np.uint64(28)] = True

        def among(x: np.ndarray) -> np.ndarray:
            near = np.flatnonzero(gate[x >> np.uint64(28)])
            return near[wanted[np.minimum(np.searchsorted(wanted, x[near]), len(wanted) - 1)] == x[near]] if len(wanted) else near

        kept, kept_pair = among(term), among(pair)
        owner, term, pair, pair_text = owner[kept], term[kept], pair[kept_pair], pair_text[kept_pair]
    order = np.argsort(owner, kind="stable")
    useful = np.zeros(len(unique) + 1, bool)
    useful[owner] = True
    at = np.flatnonzero(useful[back])
    has = np.sort(text[at].astype(np.uint64) << np.uint64(32) | back[at].astype(np.uint64))
    heads = np.flatnonzero(np.concatenate(([True], has[1:] != has[:-1]))) if len(has) else np.zeros(0, np.int64)
    times = np.diff(np.append(heads, len(has)))
    return owner[order], term[order], has[heads], times, pair_text, pair, words.counts


def spread(owner: np.ndarray, has: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (text, word) the places of the word's terms: place of the pair, place of the term."""
    word = (has & np.uint64(0xFFFFFFFF)).astype(np.int64)
    low = np.searchsorted(owner, word)
    n = np.searchsorted(owner, word, "right") - low
    pair = np.repeat(np.arange(len(has)), n)
    return pair, np.arange(len(pair)) - np.repeat(np.cumsum(n) - n - low, n)


def frequencies(column: pa.Array, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct terms of a slice and, for each of the values of texts, the sum over texts with the term."""
    owner, term, has, _, pair_text, pair, _ = word_terms(column, None)
    at, place = spread(owner, has)
    key = distinct(np.concatenate((has[at] >> np.uint64(32), pair_text.astype(np.uint64))) << np.uint64(44) | np.concatenate((term[place], pair)))
    text, term = (key >> np.uint64(44)).astype(np.int64), key & np.uint64((1 << 44) - 1)
    every = distinct(term)
    place = np.searchsorted(every, term)
    sums = [np.bincount(place, value[text], minlength=len(every)).astype(np.int64) for value in values]
    return every, sums


def entries(column: pa.Array, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in wanted, count) of each text's wanted terms, ascending, and the words of each text."""
    owner, term, has, times, pair_text, pair, words = word_terms(column, wanted)
    # A word has a term once, however often its letters repeat in it.
    own = distinct(owner.astype(np.uint64) << np.uint64(32) | np.searchsorted(wanted, term).astype(np.uint64))
    owner, term = (own >> np.uint64(32)).astype(np.int64), own & np.uint64(0xFFFFFFFF)
    at, place = spread(owner, has)
    key = np.concatenate((has[at] & ~np.uint64(0xFFFFFFFF) | term[place], pair_text.astype(np.uint64) << np.uint64(32) | np.searchsorted(wanted, pair).astype(np.uint64)))
    key, group = np.unique(key, return_inverse=True)
    count = np.bincount(group, np.concatenate((times[at], np.ones(len(pair)))), minlength=len(key))
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64), count, words


@dataclass
class Rows:
    """Sparse features of texts: for row i the entries from bounds[i] to bounds[i + 1]."""

    bounds: np.ndarray
    place: np.ndarray
    count: np.ndarray
    density: np.ndarray

    @property
    def n(self) -> int:
        return len(self.bounds) - 1

    @staticmethod
    def of(n: int, text: np.ndarray, place: np.ndarray, count: np.ndarray, words: np.ndarray) -> Rows:
        return Rows(np.searchsorted(text, np.arange(n + 1)), place, np.log2(1 + count), 50 * count / (50 + words[text]))

    def take(self, rows: np.ndarray) -> Rows:
        n = np.diff(self.bounds)[rows]
        bounds = np.concatenate(([0], np.cumsum(n)))
        at = np.repeat(self.bounds[rows] - bounds[:-1], n) + np.arange(bounds[-1])
        return Rows(bounds, self.place[at], self.count[at], self.density[at])

    def only(self, kept: np.ndarray) -> Rows:
        """The same texts with the entries of some terms only."""
        at = np.flatnonzero(kept[self.place])
        return Rows(np.searchsorted(at, self.bounds), self.place[at], self.count[at], self.density[at])

    def outputs(self, w: np.ndarray, bias: float) -> np.ndarray:
        half = len(w) // 2
        each = w[self.place] * self.count + w[half + self.place] * self.density
        return bias + np.diff(np.concatenate(([0.0], np.cumsum(each)))[self.bounds])

    def pull(self, factor: np.ndarray, size: int) -> np.ndarray:
        """Mean over rows of factor times features, the constant feature last."""
        each = np.repeat(factor, np.diff(self.bounds))
        both = (np.bincount(self.place, each * self.count, minlength=size), np.bincount(self.place, each * self.density, minlength=size))
        return np.concatenate((*both, [factor.sum()])) / max(self.n, 1)


def risk(w: np.ndarray, p: Rows, u: Rows, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The two parts of the PU risk with the sigmoid loss, of the positive and the negative class, and their gradients."""
    size = len(w) // 2
    sp, su = sigmoid(p.outputs(w[:-1], w[-1])), sigmoid(u.outputs(w[:-1], w[-1]))
    of_p, of_u = p.pull(sp * (1 - sp), size), u.pull(su * (1 - su), size)
    # Loss of an example as positive: 1 - s; as negative: s.
    return prior * (1 - sp.mean()), su.mean() - prior * sp.mean(), -prior * of_p, of_u - prior * of_p


def start(p: Rows, u: Rows, prior: float, size: int) -> np.ndarray:
    """Log ratios of the terms' shares in P and in U without its positives, scaled to a bias of -3."""
    in_p, in_u = (np.bincount(x.place, minlength=size) / x.n for x in (p, u))
    in_n = np.maximum((in_u - prior * in_p) / (1 - prior), 0)
    ratio = np.maximum(np.log((in_p + 1 / p.n) / (in_n + 1 / p.n)), 0)
    w = np.concatenate((ratio, np.zeros(size)))
    zp, zu = p.outputs(w, 0.0), u.outputs(w, 0.0)
    cut, _ = middle(zp, zu, prior)
    scale = 3 / max(cut, 1e-3)
    return np.append(w * scale, -3.0)


def train(p: Rows, u: Rows, prior: float, size: int, fit: Fit) -> np.ndarray:
    """Weights, none negative, and at the end a bias that minimise the non-negative PU risk (Adam)."""
    rng = np.random.default_rng(fit.seed)
    w = start(p, u, prior, size)
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    steps = max(1, u.n // fit.batch)
    blocks = [u.take(x) for x in np.array_split(rng.permutation(u.n), steps)]
    parts = [p.take(x) for x in np.array_split(rng.permutation(p.n), max(1, p.n // fit.batch))]
    for _ in range(fit.epochs):
        for k in rng.permutation(steps):
            _, negative, up, down = risk(w, parts[t % len(parts)], blocks[k], prior)
            grad = -down if negative < 0 else up + down
            grad[:-1] += fit.decay * prior * w[:-1]
            t += 1
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad**2
            w -= fit.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            np.maximum(w[:-1], 0, out=w[:-1])
    return w


def mixture_prior(zp: np.ndarray, zu: np.ndarray) -> float:
    """Share of the positive class in U: the least ratio of the shares of U and P above a threshold.

    Above any threshold U has at least the positives' share of it. Of thresholds that keep half of
    P and more, the ratio with three standard errors added is least where the classes are best apart.
    """
    cuts = distinct(np.quantile(zp, np.linspace(0, 0.5, 101)))
    p = 1 - np.searchsorted(np.sort(zp), cuts) / len(zp)
    u = 1 - np.searchsorted(np.sort(zu), cuts) / len(zu)
    error = np.sqrt((u + 1 / len(zu)) / len(zu)) + u / p * np.sqrt((1 - p + 1 / len(zp)) / len(zp))
    best = int(np.argmin((u + 3 * error) / p))
    return float(np.clip(u[best] / p[best], 1e-4, 0.95))


def middle(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """Threshold above which U has about the prior's share, where its outputs are sparsest, and a scale for sigmoid."""
    low, high = np.quantile(zu, [max(1 - 1.4 * prior, 0), 1 - 0.85 * prior])
    counts, edges = np.histogram(zu, 24, (low, max(high, low + 1e-6)))
    near = np.convolve(counts, np.ones(5), "valid")
    cut = float(edges[2 + int(np.median(np.flatnonzero(near == near.min())))] + edges[3 + int(np.median(np.flatnonzero(near == near.min())))]) / 2
    return cut, 4 / max(float(np.median(zp)) - cut, 1.0)


def strong(p: Rows, u: Rows, size: int, fit: Fit) -> np.ndarray:
    """Terms that these texts alone would have chosen."""
    n_p, n_u = (np.bincount(x.place, minlength=size) for x in (p, u))
    pooled = (n_p + n_u) / (p.n + u.n)
    return (n_p >= 3) & ((n_p / p.n - n_u / u.n) >= fit.least * np.sqrt(pooled * (1 - pooled) * (1 / p.n + 1 / u.n) + 1e-12))


def fitted(p: Rows, u: Rows, guess: float, size: int, fit: Fit) -> tuple[np.ndarray, float, float, float]:
    """Weights with bias, threshold, scale and the prior, which is estimated from outputs of texts left out."""
    prior = guess
    half_p, half_u = np.arange(p.n) % 2, np.arange(u.n) % 2
    for _ in range(2):
        zp, zu = np.zeros(p.n), np.zeros(u.n)
        for side in (0, 1) if min(p.n, u.n) >= 4 else ():
            own_p, own_u = p.take(np.flatnonzero(half_p == side)), u.take(np.flatnonzero(half_u == side))
            kept = strong(own_p, own_u, size, fit)
            w = train(own_p.only(kept), own_u.only(kept), prior, size, fit)
            for z, rows, half in ((zp, p, half_p), (zu, u, half_u)):
                z[half != side] = rows.take(np.flatnonzero(half != side)).outputs(w[:-1], w[-1])
        if min(p.n, u.n) >= 4:
            prior = mixture_prior(zp, zu)
    w = train(p, u, prior, size, fit)
    if min(p.n, u.n) < 4:
        return w, 0.0, 1.0, prior
    return w, *middle(p.outputs(w[:-1], w[-1]), u.outputs(w[:-1], w[-1]), prior), prior


def model(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> Model:
    """Terms, weights and bias from the given rows only; equal texts count once.

    ``labels`` (doc_id, toxic): 1 is confirmed toxic; other labels are not read. P holds at most
    ``fit.positives`` distinct confirmed texts and U ``fit.unlabelled`` distinct texts of all rows,
    both those of the least text hash. Terms are pieces of 3 to 6 bytes of words, words and pairs of
    words; the ``fit.terms`` strongest of those that P has more often than U are features, with
    their count in the text and their density. Without toxic texts no text is toxic. Labels and
    documents with a null doc_id and null texts are left out; further columns are ignored.
    """
    blank = Model(np.zeros(0, np.uint64), np.zeros(0), -5.0)
    marked = labels.where("toxic = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(1).alias("p")).distinct()
    known = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    texts = table(known.join(marked, "doc_id", "left").groupBy("h").agg(F.max("p").alias("p"), F.min_by("doc_id", F.struct(F.col("p").isNull(), "doc_id")).alias("doc_id")), "distinct")
    positive = texts.where("p = 1").orderBy("h", "doc_id").limit(fit.positives).select("doc_id", F.lit(1).alias("positive"))
    other = texts.orderBy("h", "doc_id").limit(fit.unlabelled).select("doc_id", F.lit(0).alias("positive"))
    chosen = table(positive.union(other).groupBy("doc_id").agg(F.max("positive").alias("p"), (F.min("positive") == 0).alias("u")), "chosen")  # at most the two bounds
    texts_of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    sample = table(texts_of.join(F.broadcast(chosen), "doc_id").select("p", "u", "text", F.xxhash64("text").alias("h")), "sample")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in slices(batch, "text", SLICE):
                unique, sums = frequencies(own.column(2), [own.column(0).to_numpy() == 1, own.column(1).to_numpy(zero_copy_only=False), own.column(3).to_numpy() >> 34 & (1 << 30) - 1])  # sums of the last tell sets of texts apart
                yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), *map(pa.array, sums)], names=["term", "p", "u", "mark"])

    n_p, n_u = (int(x or 0) for x in sample.agg(F.sum("p"), F.sum(F.col("u").cast("int"))).first())
    if not n_p or not n_u:
        return blank
    found = sample.mapInArrow(counts, "term long, p long, u long, mark long").groupBy("term").agg(*(F.sum(x).alias(x) for x in ("p", "u", "mark")))
    # Of the terms that the same texts have, as the pieces of one word, one is enough.
    found = found.where("p >= 3").groupBy("p", "u", "mark").agg(F.min("term").alias("term"))
    in_p, in_u, pooled = F.col("p") / n_p, F.col("u") / n_u, (F.col("p") + F.col("u")) / (n_p + n_u)
    strength = (in_p - in_u) / F.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u) + 1e-12)
    best = found.withColumn("strength", strength).where(F.col("strength") >= fit.least).orderBy(F.desc("strength"), "term").limit(fit.terms).collect()
    if not best:
        return blank
    terms = np.sort(np.array([r["term"] for r in best], np.int64).view(np.uint64))
    # Any term that a good part of P has bounds the prior from above: a first guess.
    ratio = [(r["u"] + 1.0) / n_u * n_p / r["p"] for r in best if r["p"] >= max(3, 0.1 * n_p)]
    wanted = docs.sparkSession.sparkContext.broadcast(terms)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in slices(batch, "text", SLICE):
                text, place, count, words = entries(own.column(2), wanted.value)
                bounds = pa.array(np.searchsorted(text, np.arange(own.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int32())) for x in (place, count.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(words, pa.int64()), *lists, own.column(3)], names=["p", "u", "words", "place", "count", "h"])

    rows = sample.mapInArrow(features, "p int, u boolean, words long, place array<int>, count array<int>, h long").toArrow()
    # The texts' hashes order them, as they are distinct; partitions and retries change nothing.
    rows = rows.sort_by([("h", "ascending")])
    drop(texts, chosen, sample)
    n = np.diff(rows.column("place").combine_chunks().offsets.to_numpy())
    place, count = (rows.column(c).combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("place", "count"))
    every = Rows.of(rows.num_rows, np.repeat(np.arange(rows.num_rows), n), place, count, rows.column("words").to_numpy())
    p, u = (every.take(np.flatnonzero(rows.column(c).to_numpy())) for c in ("p", "u"))
    w, cut, scale, _ = fitted(p, u, min([*ratio, 0.5]), len(terms), fit)
    return Model(terms, w[:-1] * scale, float((w[-1] - cut) * scale))


def _scores(column: pa.Array, own: Model) -> np.ndarray:
    text, place, count, words = entries(column, own.terms)
    return sigmoid(Rows.of(len(column), text, place, count, words).outputs(own.weights, own.bias))


def score(docs: DataFrame, fitted_model: Model) -> DataFrame:
    """doc_id and score of each whole text, one row for each row of docs.

    Null, empty and wordless texts get the bias alone; equal texts get equal scores whatever their
    doc_id, which may be null or repeat. Further columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(fitted_model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in slices(batch, "text", SLICE):
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(_scores(own.column(1), held.value))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, fitted_model: Model, limit: float = 0.5) -> DataFrame:
    """The documents whose score stays below the limit, with all their columns as they are."""
    held = docs.sparkSession.sparkContext.broadcast(fitted_model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in slices(batch, "text", SLICE):
                yield own.filter(pa.array(_scores(own.column(own.schema.get_field_index("text")), held.value) < limit))

    return docs.mapInArrow(run, docs.schema)
