"""Best-fit packing planned on the histogram of lengths.

Texts become token pieces of at most ``capacity`` ids. The plan is made by best-fit over counts
of lengths, of which there are at most ``capacity``, so it doesn't grow with the corpus. Each
piece then takes its planned slot by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .store import table
from .textbytes import slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def ranks_within(length: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Rank of each item among those of its length; ``seen`` counts earlier ones and is updated."""
    order = np.argsort(length, kind="stable")
    ordered = length[order]
    change = np.flatnonzero(np.diff(ordered, prepend=-1))
    inner = np.arange(len(order)) - np.repeat(change, np.diff(np.append(change, len(order))))
    out = np.empty(len(order), np.int64)
    out[order] = inner + seen[ordered]
    np.add.at(seen, length, 1)
    return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Token pieces of all texts; ``rank`` counts within (part, length).

    Null texts are empty and still have their end id. A text of more than ``capacity`` ids is cut
    so that every piece but the first is full. Repeated doc_ids are packed row by row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, enc = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), encoder(tokenizer)
        for batch in batches:
            for own in slices(batch):
                ids, counts = enc.encode(own.column(1))
                total = counts + 1
                lead = np.concatenate(([0], np.cumsum(total)))
                full = np.empty(lead[-1], "<u4")
                keep = np.ones(lead[-1], bool)
                keep[lead[1:] - 1] = False
                full[keep], full[~keep] = ids, end_id
                n = -(-total // capacity)
                doc = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                short = total - (n - 1) * capacity
                length = np.where(piece == 0, short[doc], capacity)
                start = np.where(piece == 0, 0, short[doc] + (piece - 1) * capacity)
                data = memoryview(full).cast("B")
                low = lead[doc] + start
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(low.tolist(), (low + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [own.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part, np.int32)), pa.array(ranks_within(length, seen))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit, longest first, over counts: rows (length, first rank, ranks, first sequence, offset).

    Ranks first rank + i of a row go to sequence first sequence + i, at the offset.
    """
    space: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    rows, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left, room = 0, histogram[length], length
        while left:
            while room <= capacity and not space[room]:
                room += 1
            if room > capacity:
                break
            first, have = space[room].pop()
            take = min(left, have)
            rows.append((length, rank, take, first, capacity - room))
            if have > take:
                space[room].append((first + take, have - take))
            if room > length:
                space[room - length].append((first, take))
            rank, left = rank + take, left - take
            if room - length >= length:
                room = length
        per = capacity // length
        for each, bins in ((per, left // per), (left % per, 1)):
            if not each or not bins:
                continue
            for k in range(each):
                rows.append((length, rank, bins, sequences, k * length))
                rank += bins
            if capacity > each * length:
                space[capacity - each * length].append((sequences, bins))
            sequences += bins
    return np.array(rows, np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece with its sequence and its place there; see ``pieces`` for odd rows.

    An empty table packs into no sequences. Further columns of ``docs`` are ignored.
    """
    cut = table(pieces(docs, tokenizer, capacity, end_id), "pieces")
    counts = table(cut.groupBy("part", "length").count(), "counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}  # at most capacity rows
    slots = docs.sparkSession.sparkContext.broadcast(plan(histogram, capacity))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base"))
    # The offsets grow with the number of tasks, so they are never broadcast.
    ranked = cut.join(base.hint("merge"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = slots.value
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        bounds = np.searchsorted(rows[:, 0], np.arange(capacity + 2))
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.zeros(len(length), np.int64)
            for k in np.unique(length):
                own = rows[bounds[k] : bounds[k + 1]]
                here = length == k
                at[here] = bounds[k] + np.searchsorted(own[:, 1], rank[here], "right") - 1
            got = rows[at] if len(at) else np.zeros((0, 5), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(got[:, 3] + rank - got[:, 1]), pa.array(got[:, 4])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PACKED)
