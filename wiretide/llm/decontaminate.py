"""Benchmark decontamination with a positional inverted index that is split by documents.

Each index row covers a block of documents: its sorted term hashes, and for each term the
ascending positions at which it stands. A test window (consecutive words of a benchmark text)
occurs where the offset-adjusted position lists of its terms meet; lists are intersected from
the term that is rarest in the block. With a slop, terms may each stand a few words away from
their places (a proximity match). All lists of a document are in one block, so neither building
nor searching moves a posting between machines.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import free_name, own_columns, table
from .suffixes import uid_of, with_uid
from .textbytes import distinct, Words, slices

BLOCK_BYTES = 1 << 22
#: Windows searched in one pass over the index, about; a pass broadcasts some 6 MB at most.
PASS_WINDOWS = 1 << 16
INDEX = "block long, doc_ids binary, bounds binary, terms binary, sizes binary, positions binary"
HIT = "array<struct<item_id:string,start:int,n:int,kind:string>>"
FOUND = f"block long, ordinal int, doc_id long, n_words long, hits {HIT}"


def pack(values: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def unpack(data: bytes, kind: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def build_index(docs: DataFrame) -> DataFrame:
    """Index rows of (doc_id, text); null texts have no words, repeated doc_ids stay apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for own in slices(batch, size=BLOCK_BYTES):
                words = Words(own.column(1))
                order = np.argsort(words.hash, kind="stable").astype(np.uint32)
                ordered = words.hash[order]
                heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)
                sizes = np.diff(np.append(heads, len(ordered))).astype(np.uint32)
                step = order.copy()
                step[1:] -= order[:-1]
                step[heads] = order[heads]
                ids = own.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False).astype("<i8")
                row = [block, pack(ids), pack(words.first.astype("<u4")), pack(ordered[heads]), pack(sizes), pack(step)]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary() if i else pa.int64()) for i, v in enumerate(row)], names=[x.split()[0] for x in INDEX.split(", ")])
                block += 1

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, INDEX)


def windows(items: DataFrame, size: int = 10) -> DataFrame:
    """Distinct windows of benchmark texts: ``terms`` has 8 bytes a word; shorter texts are one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in slices(batch):
                words, item, terms = Words(own.column(1)), [], []
                for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
                    for k in range(a, max(a + (b > a), b - size + 1)):
                        item.append(i)
                        terms.append(words.hash[k : min(b, k + size)].tobytes())
                yield pa.RecordBatch.from_arrays([own.column(0).take(pa.array(item, pa.int64())), pa.array(terms, pa.binary())], names=["item_id", "terms"])

    rows = items.select(F.col("item_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, "item_id string, terms binary")
    return rows.where("item_id is not null").distinct()


class Pass:
    """Windows of one pass, ready to be looked up in any block."""

    def __init__(self, rows: list):
        self.items = sorted({r[0] for r in rows})
        place = {x: i for i, x in enumerate(self.items)}
        by: dict[bytes, list[int]] = {}
        for r in rows:
            by.setdefault(bytes(r[1]), []).append(place[r[0]])
        self.groups = []
        for length in sorted({len(t) for t in by}):
            own = [t for t in by if len(t) == length]
            terms = np.frombuffer(b"".join(own), np.uint64).reshape(len(own), length // 8)
            of = [by[t] for t in own]
            self.groups.append((terms, np.array([i for x in of for i in x]), np.concatenate(([0], np.cumsum([len(x) for x in of])))))
        self.vocabulary = distinct(np.concatenate([g[0].ravel() for g in self.groups])) if self.groups else np.zeros(0, np.uint64)
        self.groups = [(np.searchsorted(self.vocabulary, t), i, f) for t, i, f in self.groups]


def find(terms: np.ndarray, first: np.ndarray, position: np.ndarray, wanted: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that occur: row of ``wanted`` (places in ``terms``), start, and whether it is exact."""
    size = first[wanted + 1] - first[wanted]
    rarity = np.argsort(size, axis=1, kind="stable")
    rows = np.arange(len(wanted))
    rare = rarity[:, 0]
    counts = size[rows, rare]
    window = np.repeat(rows, counts)
    inner = np.arange(len(window)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = position[first[wanted[rows, rare]][window] + inner] - rare[window]
    span = int(position.max()) + 1 if len(position) else 1
    # Lists follow each other in one ascending array: the term's rank, then the position.
    whole = np.repeat(np.arange(len(terms), dtype=np.int64), np.diff(first)) * span + position
    exact = np.ones(len(window), bool)
    for k in range(1, wanted.shape[1]):
        j = rarity[window, k]
        term = wanted[window, j]
        at = start + j
        low, high = np.maximum(at - slop, 0), np.minimum(at + slop, span - 1)
        keep = high >= 0
        near = np.searchsorted(whole, term * span + low) < np.searchsorted(whole, term * span + np.maximum(high, 0), "right")
        if slop:
            same = np.searchsorted(whole, term * span + at)
            exact &= (at >= 0) & (at < span) & (whole[np.minimum(same, len(whole) - 1)] == term * span + at)
        keep &= near
        window, start, exact = window[keep], start[keep], exact[keep]
    return window, start, exact


def search(index: DataFrame, items: DataFrame, size: int = 10, slop: int = 0) -> DataFrame:
    """Each document of the index with its hits: item, first word, words and kind.

    ``phrase``: the window stands there word for word. ``near``: each of its words stands at most
    ``slop`` words from its place around the rarest one. Without windows there are no hits.
    """
    spark = index.sparkSession
    stored = table(windows(items, size), "windows")
    passes = max(1, math.ceil(stored.count() / PASS_WINDOWS))
    found = []
    for k in range(passes):
        rows = stored.where(F.pmod(F.xxhash64("terms"), F.lit(passes)) == k).collect()  # about PASS_WINDOWS
        found.append(_search(index, spark.sparkContext.broadcast(Pass(rows)), slop))
    if passes == 1:
        return found[0]
    merged = reduce(DataFrame.union, found).groupBy("block", "ordinal")
    return merged.agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"))


def _search(index: DataFrame, wanted, slop: int) -> DataFrame:
    kind = pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int32()), ("n", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Pass = wanted.value
        for batch in batches:
            for i in range(batch.num_rows):
                block, ids, bounds, terms, sizes, steps = (batch.column(c)[i].as_py() for c in range(6))
                ids, bounds, terms, sizes, steps = unpack(ids, "<i8"), unpack(bounds, "<u4").astype(np.int64), unpack(terms, np.uint64), unpack(sizes, "<u4").astype(np.int64), unpack(steps, "<u4")
                first = np.concatenate(([0], np.cumsum(sizes)))
                hits: dict[int, list] = {}
                place = np.searchsorted(terms, now.vocabulary)
                have = place < len(terms)
                have[have] = terms[place[have]] == now.vocabulary[have]
                position = None
                for group, items, of in now.groups:
                    rows = np.flatnonzero(have[group].all(axis=1))
                    if not len(rows):
                        continue
                    if position is None:  # undo the differences within each term's list
                        total = np.cumsum(steps.astype(np.int64))
                        position = total - np.repeat(total[first[:-1]] - steps[first[:-1]], sizes)
                    window, start, exact = find(terms, first, position, place[group[rows]], slop)
                    n = group.shape[1]
                    doc = np.searchsorted(bounds, np.maximum(start, 0), "right") - 1
                    inside = (start >= bounds[doc]) & (start + n <= bounds[doc + 1]) if len(start) else np.zeros(0, bool)
                    for w, s, d, e in zip(rows[window[inside]].tolist(), (start - bounds[doc])[inside].tolist(), doc[inside].tolist(), exact[inside].tolist(), strict=True):
                        hits.setdefault(d, []).extend({"item_id": now.items[x], "start": s, "n": n, "kind": "phrase" if e else "near"} for x in items[of[w] : of[w + 1]].tolist())
                n = len(ids)
                null = ids == np.iinfo(np.int64).min
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, block)), pa.array(np.arange(n, dtype=np.int32)), pa.array(ids, mask=null), pa.array(np.diff(bounds)), pa.array([hits.get(d, []) for d in range(n)], kind)],
                    names=["block", "ordinal", "doc_id", "n_words", "hits"],
                )

    return index.mapInArrow(run, FOUND)


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, slop: int = 0) -> DataFrame:
    """Documents with counts of words inside exact matches and the benchmark items that occur.

    Null or wordless texts of either side have no words and no hits; items without id are left
    out. Repeated doc_ids keep a row each. Further columns of both sides are ignored.
    """
    found = search(table(build_index(docs), "postings"), items, size, slop)
    exact = F.filter("hits", lambda h: h["kind"] == "phrase")
    words = F.array_distinct(F.flatten(F.transform(exact, lambda h: F.sequence(h["start"], h["start"] + h["n"] - 1))))
    names = F.array_sort(F.array_distinct(F.transform(exact, lambda h: h["item_id"])))
    near = F.array_distinct(F.transform("hits", lambda h: h["item_id"]))
    out = found.select("doc_id", "n_words", F.size(words).cast("long").alias("n_hit"), names.alias("items"), F.size(near).cast("long").alias("n_items_near"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def clean(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """The documents without any exact match of a benchmark window, with all their columns."""
    found = search(table(build_index(with_uid(docs).select(F.col("uid").alias("doc_id"), "text")), "postings"), items, size)
    key = free_name(docs, "uid")
    hit = found.where(F.exists("hits", lambda h: h["kind"] == "phrase")).select(F.col("doc_id").alias(key))
    return docs.withColumn(key, uid_of()).join(hit.distinct().hint("merge"), key, "left_anti").select(*own_columns(docs))
