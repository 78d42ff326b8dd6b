"""Hard negatives by a vector-approximation file.

Vectors are kept in blocks with their exact integers and, for each dimension, a cell number of one
byte; the cells' bounds are quantiles of the block's own values. A query never reads exact integers
of a block before the cells have ruled most of its rows out: looking up each row's lower and upper
cell bound gives bounds of its score, and only rows whose bounds may still enter the result are
scored exactly. Queries go over the index in passes of bounded size; a task keeps its best rows of
each query, so what leaves it is a few rows per query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import shuffle_partitions, table

#: Rows in a block, cells in a dimension, bytes of anchors in a pass, and anchors that are looked up at a time.
BLOCK_ROWS, CELLS, PASS_BYTES, TILE = 1 << 14, 256, 1 << 24, 256
INDEX = "dims int, n int, ids binary, labels binary, cells binary, edges binary, exact binary"
NEAREST = "anchor long, anchor_id long, place int, vec_id long, score long"


def vectors(rows: DataFrame, label: Column | None = None) -> DataFrame:
    """vec_id, label and the vector's integers floor(256 * x).

    Rows with a null vec_id, label or vector or a null or non-finite component are left out; exact
    repeats of a row count once.
    """
    own = F.col("embedding").cast("array<double>")
    parts = shuffle_partitions(rows.sparkSession)
    finite = F.forall(own, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & own.isNotNull() & finite)
    kind = F.col("label").cast("long") if label is None else label.cast("long")
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), kind.alias("label"), F.transform(own, lambda x: F.floor(x * 256)).alias("v")).repartition(parts, "vec_id").distinct()


def build_index(own: DataFrame) -> DataFrame:
    """Blocks of ``vectors``; vectors of different lengths are in blocks of their own."""

    def block(ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> tuple:
        # The edge before a cell is its least value and the edge after it lies above its values.
        own = min(CELLS, len(v))
        cuts = np.quantile(v, np.linspace(0, 1, own + 1), axis=0, method="inverted_cdf").astype(np.int64).T if v.size else np.zeros((0, own + 1), np.int64)
        cells = np.empty(v.shape, np.uint8)
        for d in range(v.shape[1]):
            cells[:, d] = np.clip(np.searchsorted(cuts[d], v[:, d], "right") - 1, 0, own - 1)
        wide = next(t for t in ("<i2", "<i4", "<i8") if not v.size or np.iinfo(t).min <= v.min() and v.max() <= np.iinfo(t).max)
        return v.shape[1], len(ids), ids.astype("<i8").tobytes(), labels.astype("<i8").tobytes(), cells.tobytes(), cuts.astype("<i8").tobytes(), v.astype(wide).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

        def close(dims: int) -> pa.RecordBatch:
            row = block(*(np.concatenate(x) for x in zip(*held.pop(dims), strict=True)))
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int32() if i < 2 else pa.binary()) for i, x in enumerate(row)], names=[x.split()[0] for x in INDEX.split(", ")])

        for batch in batches:
            ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            flat, size = batch.column(2).flatten().to_numpy(), batch.column(2).value_lengths().to_numpy()
            first = np.cumsum(size) - size
            for dims in np.unique(size).tolist():
                rows = np.flatnonzero(size == dims)
                held.setdefault(dims, []).append((ids[rows], labels[rows], flat[first[rows][:, None] + np.arange(dims)]))
                if sum(len(x[0]) for x in held[dims]) >= BLOCK_ROWS:
                    yield close(dims)
        for dims in list(held):
            yield close(dims)

    return own.mapInArrow(run, INDEX)


class Block:
    """One block of the index; the exact integers are decoded when they are first asked for."""

    def __init__(self, row: dict):
        self.dims, self.n = row["dims"], row["n"]
        self.ids, self.labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
        cells = np.frombuffer(row["cells"], np.uint8).reshape(self.n, self.dims).astype(np.int64)
        edges = np.frombuffer(row["edges"], "<i8").reshape(self.dims, min(CELLS, self.n) + 1)
        self.low, self.high = edges[np.arange(self.dims), cells], edges[np.arange(self.dims), cells + 1]
        self.largest = int(np.abs(edges).max(initial=0))
        self.exact, self.wide = row["exact"], f"<i{len(row['exact']) // max(1, self.n * self.dims) or 8}"

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores, anchors by rows.

        A component of an anchor takes one edge of the row's cell if it is positive and the other if
        it is negative; sums of the looked-up edges are products of matrices.
        """
        reach = self.largest * int(np.abs(anchors).sum(axis=1).max(initial=0))
        kind = np.float32 if reach < 1 << 24 else np.float64
        up, down = np.maximum(anchors, 0).astype(kind), np.minimum(anchors, 0).astype(kind)
        low, high = self.low.astype(kind).T, self.high.astype(kind).T
        # Beyond 53 bits sums are rounded, and bounds are made wider by more than that.
        slack = 0.0 if reach < 1 << 53 else reach * 2.0**-45
        return up @ low + down @ high - slack, up @ high + down @ low + slack

    def scores(self, anchors: np.ndarray, rows: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Exact scores of chosen rows with the anchors of these places."""
        own = np.frombuffer(self.exact, self.wide).reshape(self.n, self.dims)
        if self.largest * int(np.abs(anchors).sum(axis=1).max(initial=0)) >= 1 << 63:
            raise OverflowError("a score doesn't fit 64 bits")
        out = np.empty(len(rows), np.int64)
        for i in range(0, len(rows), 1 << 16):
            out[i : i + (1 << 16)] = np.einsum("ij,ij->i", own[rows[i : i + (1 << 16)]].astype(np.int64), anchors[of[i : i + (1 << 16)]])
        return out


def kth_largest(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest value of each row, minus infinity where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


class Best:
    """The best k rows of each query that a task has seen: by score, ties by smaller vec_id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score, self.id = np.zeros((queries, k), np.int64), np.zeros((queries, k), np.int64)
        self.full = np.zeros((queries, k), bool)

    def least(self, queries: slice) -> np.ndarray:
        """What a row must reach to enter."""
        return np.where(self.full[queries, -1], self.score[queries, -1], -np.inf)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        touched = np.unique(query)
        old = self.full[touched]
        query = np.concatenate((query, np.repeat(touched, old.sum(axis=1))))
        ids, score = np.concatenate((ids, self.id[touched][old])), np.concatenate((score, self.score[touched][old]))
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.k
        at = (query[keep], place[keep])
        self.score[at], self.id[at], self.full[at] = score[keep], ids[keep], True


class Anchors:
    """Anchors of one pass by their dimensions: keys, vec_ids, labels and integers."""

    def __init__(self, rows: pa.Table):
        key, ids, label = (rows.column(c).to_numpy() for c in ("anchor", "vec_id", "label"))
        v = rows.column("v").combine_chunks()
        flat, size = v.flatten().to_numpy(), v.value_lengths().to_numpy()
        first = np.cumsum(size) - size
        self.by = {}
        for dims in np.unique(size).tolist():
            own = np.flatnonzero(size == dims)
            own = own[np.argsort(key[own])]
            self.by[dims] = key[own], ids[own], label[own], flat[first[own][:, None] + np.arange(dims)]


class Positives:
    """Each anchor's query for the best other rows of its label."""

    per = 1

    def __init__(self, anchors: Anchors, k: int):
        self.anchors, self.k = anchors, k

    def candidates(self, block: Block, tile: slice, low: np.ndarray, high: np.ndarray, best: Best) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Place of the query at its anchor, anchors in the tile and rows in the block that may be wanted."""
        _, ids, label, _ = self.anchors.by[block.dims]
        own = (label[tile, None] == block.labels) & (ids[tile, None] != block.ids)
        least = np.maximum(kth_largest(np.where(own, low, -np.inf), self.k), best.least(tile))
        yield 0, *np.nonzero(own & (high >= least[:, None]))

    def inside(self, dims: int, place: int, anchors: np.ndarray, score: np.ndarray) -> np.ndarray:
        return np.ones(len(score), bool)


class Windows:
    """Queries of each anchor for the best rows of other labels in a window of scores below each of its positives."""

    def __init__(self, anchors: Anchors, positives: pa.Table, per: int, k: int, low: int, high: int):
        self.anchors, self.per, self.k = anchors, per, k
        key, place, score = (positives.column(c).to_numpy() for c in ("anchor", "place", "score"))
        self.by = {}
        for dims, (keys, *_) in anchors.by.items():
            at = np.searchsorted(keys, key)
            own = at < len(keys)
            own[own] = keys[at[own]] == key[own]
            # An empty window where there is no such positive.
            bounds = np.zeros((2, len(keys), per), np.int64)
            bounds[0] = 1
            bounds[0, at[own], place[own]] = -(-low * score[own] // 100)
            bounds[1, at[own], place[own]] = high * score[own] // 100
            self.by[dims] = bounds

    def candidates(self, block: Block, tile: slice, low: np.ndarray, high: np.ndarray, best: Best) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        other = self.anchors.by[block.dims][2][tile, None] != block.labels
        least, most = (x[tile] for x in self.by[block.dims])
        for place in range(self.per):
            a, b = least[:, place, None], most[:, place, None]
            may = other & (high >= a) & (low <= b)
            sure = may & (low >= a) & (high <= b)
            queries = np.arange(tile.start, tile.start + len(other)) * self.per + place
            at_least = np.maximum(kth_largest(np.where(sure, low, -np.inf), self.k), best.least(queries))
            yield place, *np.nonzero(may & (high >= at_least[:, None]))

    def inside(self, dims: int, place: int, anchors: np.ndarray, score: np.ndarray) -> np.ndarray:
        least, most = self.by[dims]
        return (score >= least[anchors, place]) & (score <= most[anchors, place])


def search(index: DataFrame, wanted: Positives | Windows) -> DataFrame:
    """The best k rows of each query and task, as anchor, its vec_id, place, and the row's vec_id and score."""
    held = index.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = held.value
        best: dict[int, Best] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                block = Block(batch.slice(k, 1).to_pylist()[0])
                if block.dims not in now.anchors.by:
                    continue
                v = now.anchors.by[block.dims][3]
                own = best.setdefault(block.dims, Best(len(v) * now.per, now.k))
                for i in range(0, len(v), TILE):
                    tile = slice(i, min(i + TILE, len(v)))
                    low, high = block.bounds(v[tile])
                    for place, of, rows in now.candidates(block, tile, low, high, own):
                        score = block.scores(v[tile], rows, of)
                        keep = now.inside(block.dims, place, of + i, score)
                        own.add((of[keep] + i) * now.per + place, block.ids[rows[keep]], score[keep])
        for dims, own in best.items():
            key, ids, *_ = now.anchors.by[dims]
            query, rank = np.nonzero(own.full)
            columns = [key[query // now.per], ids[query // now.per], (query % now.per).astype(np.int32), own.id[query, rank], own.score[query, rank]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=[x.split()[0] for x in NEAREST.split(", ")])

    return index.mapInArrow(run, NEAREST)


def first_ranks(found: DataFrame, k: int) -> DataFrame:
    """The first k of all tasks' rows for each query, with ``rank`` from 1."""
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(own: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """For each anchor and each of its best positives, the best negatives in a window of scores below the positive's.

    ``own`` is what ``vectors`` gives, and ``anchors`` says which rows are anchors. Scores are integer
    inner products; vectors of different lengths have none with each other. Higher scores come first,
    ties by smaller vec_id. A negative's score is between ``low`` and ``high`` hundredths of the
    positive's, both included; below zero there is none. Rows that share a vec_id with an anchor are
    never its positives. Fewer positives or negatives than asked for are all returned; without any
    there is no row. A score beyond 64 bits is an error.

    A pass holds at most PASS_BYTES of anchors' integers (one anchor at least), so what is collected
    and broadcast in it doesn't grow with the data.
    """
    own = table(own, "vectors")
    index = table(build_index(own), "cells")
    asked = table(own.where(anchors).withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    size = asked.agg(F.sum(8 * F.size("v") + 8 * (3 + 3 * positives))).first()[0] or 0
    passes = max(1, math.ceil(size / PASS_BYTES))
    out = []
    for k in range(passes):
        now = Anchors(asked.where(F.pmod(F.xxhash64("anchor"), F.lit(passes)) == k).toArrow())  # about PASS_BYTES
        best = first_ranks(search(index, Positives(now, positives)), positives)
        best = table(best.select("anchor", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        windows = Windows(now, best.select("anchor", "place", F.col("positive_score").alias("score")).toArrow(), positives, negatives, low, high)  # a few numbers per anchor of the pass
        out.append(first_ranks(search(index, windows), negatives).join(best, ["anchor", "place"]))
    names = ["anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")]
    return reduce(DataFrame.unionAll, out).select(*names)
