"""Repeated passages by a sparse suffix array over words.

Of all suffixes only those are kept that start at minimiser positions: where the hash of the next
``prefix`` words is the least among ``window`` neighbouring positions. Passages of ``min_words``
words that stand in two documents share such a position with ``prefix`` words to its right, so
sorting the kept suffixes brings them together. The first sort finds suffixes with an equal one in
another document; only these get the hashes of the ``window`` passages of ``min_words`` words around
their prefix. The second sort brings together the suffixes of equal prefix, and all their passages
are grouped by hash, so the first and last document of each passage are known however many others
have the same prefix. Rows are range-partitioned by suffix and document, so a prefix that very many
documents share is spread over partitions; what a partition can't decide alone is grouped once more.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import drop, free_name, own_columns, table
from .textbytes import Words, mix, slices, window_hash, window_starts

#: Suffixes that are compared at once; a class with more is decided by the second grouping.
CHUNK = 1 << 16
ANCHOR = "key long, uid long, pos int"
CONTEXT = "uid long, doc_id long, key long, pos int, n_left int, n_right int, around binary, words binary"
LINK = "uid long, doc_id long, other_id long, first int, last int, later boolean, passage long"
SPANS = "doc_id long, start_word int, end_word int, start_char int, end_char int, n_words int, later boolean, other_id long, uid long"


def sizes(min_words: int) -> tuple[int, int]:
    """Window and prefix such that ``min_words`` common words hold a common kept suffix."""
    window = max(1, min_words // 2)
    return window, min_words - window + 1


def one(rows: pa.Table) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c.combine_chunks() for c in rows.columns], schema=rows.schema)


def slide(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) over each ``width`` consecutive values."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = best(out[:-step], out[step:])
        done += step
    return out


def minimisers(key: np.ndarray, width: int) -> np.ndarray:
    """Positions whose hash is least in some window; of equal hashes one in ``width`` is kept."""
    if len(key) < width:
        return np.zeros(0, np.int64)
    value = (key >> np.uint64(24) << np.uint64(24)) | (np.arange(len(key)) % width).astype(np.uint64)
    least = slide(value, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(slide(np.concatenate((pad, least, pad)), width, np.maximum) == value)


def with_uid(docs: DataFrame) -> DataFrame:
    """uid, doc_id and text; rows with equal doc_id and text are one document."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(uid_of().alias("uid"), doc_id.alias("doc_id"), text.alias("text"))


def uid_of() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def anchors(docs: DataFrame, min_words: int) -> DataFrame:
    width, prefix = sizes(min_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in slices(batch):
                words = Words(own.column(1))
                key = window_hash(words.hash, prefix)
                found = []
                for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                    if b - a >= min_words:
                        found.append(a + minimisers(key[a : b - prefix + 1], width))
                at = np.concatenate(found) if found else np.zeros(0, np.int64)
                text = np.searchsorted(words.first, at, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(key[at].view(np.int64)), own.column(0).take(pa.array(text)), pa.array((at - words.first[text]).astype(np.int32))], names=["key", "uid", "pos"])

    return with_uid(docs).select("uid", "text").mapInArrow(run, ANCHOR)


def shared(suffixes: DataFrame) -> DataFrame:
    """Suffixes with an equal one in another document; groups at partition bounds may stay in vain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        first = True
        for batch in batches:
            rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            key = rows.column(0).to_numpy()
            if not len(key):
                continue
            heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            held = one(rows.slice(int(heads[-1])))
            if len(heads) > 1:
                yield keep(rows.slice(0, int(heads[-1])), first, False)
                first = False
        if held is not None:
            yield keep(pa.Table.from_batches([held]), first, True)

    def keep(rows: pa.Table, first: bool, last: bool) -> pa.RecordBatch:
        key, uid = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        mixed = np.maximum.reduceat(uid, heads) != np.minimum.reduceat(uid, heads)
        if first:
            mixed[0] = True
        if last:
            mixed[-1] = True
        chosen = rows.filter(pa.array(np.repeat(mixed, np.diff(np.append(heads, len(key))))))
        return pa.RecordBatch.from_arrays([chosen.column(c).combine_chunks() for c in range(3)], names=["key", "uid", "pos"])

    order = ["key", "uid", "pos"]
    return suffixes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, ANCHOR)


def contexts(docs: DataFrame, kept: DataFrame, min_words: int) -> DataFrame:
    """Hashes of the passages around each kept suffix's prefix, and a row of word offsets per document."""
    width, prefix = sizes(min_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for own in slices(batch):
                words = Words(own.column(2))
                lists = own.column(3)
                bounds = lists.offsets.to_numpy().astype(np.int64)
                flat = lists.flatten()
                pos, key = flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy()
                text = np.repeat(np.arange(own.num_rows), np.diff(bounds))
                at = words.first[text] + pos
                n_left = np.minimum(pos, width - 1)
                n_right = np.minimum(words.first[text + 1] - at - prefix, width - 1)
                passage = window_hash(words.hash, min_words)
                # Item i of a row is the passage with i words before the prefix, 0 where there is none.
                step = np.arange(width)
                whole = (step <= n_left[:, None]) & (step >= width - 1 - n_right[:, None])
                around = np.where(whole, passage[np.where(whole, at[:, None] - step, 0)], np.uint64(0)).tobytes() if len(passage) else b""
                size = 8 * width
                n = len(pos)
                blank = pa.nulls(own.num_rows)
                char = np.concatenate(([0], np.cumsum((words.raw & 0xC0) != 0x80)))
                spans = np.stack((char[words.starts], char[words.ends]), axis=1)
                base = char[words.at[:-1]]
                offsets = [press.compress((spans[a:b] - base[i]).astype("<i4").T.tobytes()) for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True))]
                for arrays in (
                    [own.column(0).take(pa.array(text)), own.column(1).take(pa.array(text)), pa.array(key), pa.array(pos, pa.int32()), pa.array(n_left, pa.int32()), pa.array(n_right, pa.int32()), pa.array([around[i * size : (i + 1) * size] for i in range(n)], pa.binary()), pa.nulls(n, pa.binary())],
                    [own.column(0), own.column(1), *(blank.cast(t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())), pa.array(offsets, pa.binary())],
                ):
                    yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in CONTEXT.split(", ")])

    lists = kept.groupBy("uid").agg(F.sort_array(F.collect_set(F.struct("pos", "key"))).alias("found"))
    joined = with_uid(docs).join(lists.hint("merge"), "uid")
    return joined.select("uid", "doc_id", "text", "found").mapInArrow(run, CONTEXT)


def links(rows: DataFrame, min_words: int) -> DataFrame:
    """Passages that other documents have too, joined around each suffix's prefix.

    The first and last class of a partition and those of more than ``CHUNK`` suffixes may have more
    suffixes elsewhere: of these, the passages of the least and greatest document at hand come out
    by themselves (``passage`` is set) for ``across``. All rows between have both kinds of partner.
    """
    width, _ = sizes(min_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        open_keys = set()
        for batch in batches:
            if not batch.num_rows:
                continue
            if not open_keys:
                open_keys.add(batch.column(2)[0].as_py())
            held.append(batch)
            n += batch.num_rows
            if n < CHUNK:
                continue
            rows = one(pa.Table.from_batches(held))
            key = rows.column(2).to_numpy()
            head = int(np.searchsorted(key, key[-1]))
            if not head:
                open_keys.add(int(key[-1]))
                head = n
            yield from compare(rows.slice(0, head), open_keys)
            held = [one(pa.Table.from_batches([rows.slice(head)]))] if head < n else []
            n -= head
        if held:
            rows = one(pa.Table.from_batches(held))
            yield from compare(rows, open_keys | {rows.column(2)[n - 1].as_py()})

    def compare(rows: pa.RecordBatch, open_keys: set) -> Iterator[pa.RecordBatch]:
        uid, doc_id, key, pos, n_left, n_right, around = rows.columns
        key, pos, n_left, n_right = (c.to_numpy().astype(np.int64) for c in (key, pos, n_left, n_right))
        who, doc = uid.to_numpy(), doc_id.fill_null(np.iinfo(np.int64).min).to_numpy()
        step = np.arange(width)
        whole = ((step <= n_left[:, None]) & (step >= width - 1 - n_right[:, None])).ravel()
        passage = (np.frombuffer(b"".join(around.to_pylist()), "<u8").reshape(-1, width) ^ mix(key.view(np.uint64))[:, None]).ravel()
        at = np.flatnonzero(whole)
        at = at[np.argsort(passage[at], kind="stable")]  # rows ascend by document within a class
        row, found = at // width, passage[at]
        heads = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
        size = np.diff(np.append(heads, len(at)))
        least, most = np.repeat(row[heads], size), np.repeat(row[heads + size - 1], size)
        for later, partner in ((True, least), (False, most)):
            other = np.full(len(whole), -1)
            other[at] = np.where(who[partner] != who[row], partner, -1)
            # Neighbouring passages of a suffix with the same partner are one link; item i begins i words before.
            of = np.repeat(np.arange(len(pos)), width)
            cut = np.concatenate(([True], (other[1:] != other[:-1]) | (of[1:] != of[:-1])))
            head, tail = np.flatnonzero(cut), np.flatnonzero(np.append(cut[1:], True))
            hit = other[head] >= 0
            head, tail = head[hit], tail[hit]
            yield named(rows, of[head], doc[other[head]], pos[of[head]] - tail % width, pos[of[head]] - head % width + min_words, later, None)
        bound = np.flatnonzero(np.isin(key[row], np.array(sorted(open_keys), np.int64)) & ((who[row] == who[least]) | (who[row] == who[most])))
        if len(bound):  # occurrences of a passage one word apart are one row
            own = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (who[1:] != who[:-1]))))[row[bound]]
            first, of = pos[row[bound]] - at[bound] % width, np.repeat(np.arange(len(heads)), size)[bound]
            order = np.lexsort((first, own, of))
            own, first, of = own[order], first[order], of[order]
            fresh = np.concatenate(([True], (of[1:] != of[:-1]) | (own[1:] != own[:-1]) | (first[1:] > first[:-1] + 1)))
            head, tail = np.flatnonzero(fresh), np.flatnonzero(np.append(fresh[1:], True))
            chosen = bound[order[head]]
            yield named(rows, row[chosen], None, first[head], first[tail] + min_words, None, found[chosen].view(np.int64))

    def named(rows, row, other, first, last, later, passage) -> pa.RecordBatch:
        taken = pa.Table.from_batches([rows.select(["uid", "doc_id"])]).take(pa.array(row))
        n = len(row)
        arrays = [
            taken.column(0).combine_chunks(),
            taken.column(1).combine_chunks(),
            pa.nulls(n, pa.int64()) if other is None else pa.array(other, mask=other == np.iinfo(np.int64).min),
            pa.array(first, pa.int32()),
            pa.array(last, pa.int32()),
            pa.nulls(n, pa.bool_()) if later is None else pa.array(np.full(n, later)),
            pa.nulls(n, pa.int64()) if passage is None else pa.array(passage),
        ]
        arrays = [a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays]
        return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in LINK.split(", ")])

    return rows.mapInArrow(run, LINK)


def across(found: DataFrame) -> DataFrame:
    """Links of the passages that partitions and chunks of ``links`` left open."""
    same = Window.partitionBy("passage")
    who = F.struct("doc_id", "uid")
    ends = found.where("passage is not null").withColumn("least", F.min(who).over(same)).withColumn("most", F.max(who).over(same))
    ends = table(ends.where("least.uid != uid or most.uid != uid"), "ends")

    def side(end: str, later: bool) -> DataFrame:
        return ends.where(f"{end}.uid != uid").select("uid", "doc_id", F.col(f"{end}.doc_id").alias("other_id"), "first", "last", F.lit(later).alias("later"), "passage")

    return side("least", True).unionByName(side("most", False))


def islands(found: DataFrame, keys: list[str], first: str, last: str, apart: int) -> DataFrame:
    """Adds ``island``: what begins less than ``apart`` after the reach of those before has their number."""
    own = Window.partitionBy(*keys).orderBy(first, last)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col(first) >= F.max(last).over(before) + apart
    return found.withColumn("fresh", F.coalesce(fresh, F.lit(True)).cast("int")).withColumn("island", F.sum("fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)))


def merged(found: DataFrame, min_words: int) -> DataFrame:
    """One span per run of neighbouring passages with the same partner; apart for first and later occurrences."""
    keys = ["uid", "later", "other_id"]
    runs = islands(found.select(*keys, "doc_id", "first", "last"), keys, "first", "last", 2 - min_words)
    return runs.groupBy(*keys, "island").agg(F.first("doc_id").alias("doc_id"), F.min("first").alias("first"), F.max("last").alias("last"))


def repeats(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """Passages of at least ``min_words`` words that stand in more than one document.

    One row per document, partner and longest run of passages: word and character spans, whether
    the partner comes before in order of id (``later``), and the partner (``other_id``), which has
    every ``min_words`` consecutive words of the span. Each passage has the first and the last
    document that has it as partners, others may come besides, and spans of different partners may
    overlap. Words are runs of ASCII letters and digits and non-ASCII characters, compared without
    ASCII case. Null and short texts have no rows; equal rows count as one document; further columns
    are ignored. Repeats within one document alone are not reported.
    """
    spark = docs.sparkSession
    suffixes = table(anchors(docs, min_words), "suffixes")
    kept = table(shared(suffixes), "shared")
    drop(suffixes)
    free(spark)
    around = table(contexts(docs, kept, min_words), "contexts")
    drop(kept)
    free(spark)
    order = ["key", "doc_id", "uid", "pos"]
    rows = around.where("key is not null").drop("words")
    found = table(links(rows.repartitionByRange(*order).sortWithinPartitions(*order), min_words), "links")
    free(spark)
    spans = merged(found.where("passage is null").unionByName(across(found)), min_words)
    lists = spans.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("first", "last", "later", "other_id"))).alias("spans"))
    offsets = around.where("words is not null").dropDuplicates(["uid"]).select("uid", "doc_id", "words")
    return lists.join(offsets, "uid").select("uid", "doc_id", "words", "spans").mapInArrow(_places, SPANS)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    press = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            start, end = np.frombuffer(press.decompress(r["words"]), "<i4").reshape(2, -1)
            for s in r["spans"]:
                a, b = s["first"], s["last"]
                out.append({"doc_id": r["doc_id"], "start_word": a, "end_word": b, "start_char": int(start[a]), "end_char": int(end[b - 1]), "n_words": b - a, "later": s["later"], "other_id": s["other_id"], "uid": r["uid"]})
        types = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([(x.split()[0], types[x.split()[1]]) for x in SPANS.split(", ")]))


def free(spark) -> None:
    """Let Spark delete the shuffle files of phases whose result is stored."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def without_repeats(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """The documents with every later occurrence of a repeated passage cut out of the text.

    Documents without a word left are dropped if something was cut; all others stay as they are.
    """
    spans = islands(repeats(docs, min_words).where("later").select("uid", "start_char", "end_char"), ["uid"], "start_char", "end_char", 0)
    spans = spans.groupBy("uid", "island").agg(F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char"))
    cut = table(spans.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("start_char", "end_char"))).alias("cut")), "cut")
    free(docs.sparkSession)
    key, spans = free_name(docs, "uid"), free_name(docs, "cut")
    cut = cut.select(F.col("uid").alias(key), F.col("cut").alias(spans))
    bounds = F.concat(F.array(F.lit(0)), F.flatten(F.transform(spans, lambda c: F.array(c["start_char"], c["end_char"]))), F.array(F.length("text")))
    keep = F.transform(F.sequence(F.lit(0), F.size(spans)), lambda i: F.substring("text", F.get(bounds, 2 * i) + 1, F.get(bounds, 2 * i + 1) - F.get(bounds, 2 * i)))
    whole = F.col(spans).isNull()
    rest = docs.withColumn(key, uid_of()).join(cut.hint("merge"), key, "left").withColumn("text", F.when(whole, F.col("text")).otherwise(F.array_join(keep, "")))
    rest = rest.where(whole | F.col("text").rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]"))
    if "n_chars" in docs.columns:
        rest = rest.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return rest.select(*own_columns(docs))
