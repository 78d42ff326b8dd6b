"""Near-duplicate join on word n-grams: MinHash banding, then full n-gram sets.

Documents with the same n-gram set are one node. Nodes that share a band of their signature are
candidates; the components of the candidate graph are cut into tiles, pairs of tiles are shuffled
together, and all pairs in them are compared on their full sets with matrix products. Only link
counts and spanning edges leave a tile, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graphs import star_components
from .store import drop, free_name, own_columns, table
from .suffixes import free, uid_of, with_uid
from .textbytes import Words, distinct, mix, slices, window_hash, window_starts

#: Nodes in a tile.
TILE = 256
#: Columns of the n-gram matrix that are multiplied at a time.
COLUMNS = 8192


def bands_and_rows(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """The most selective banding that finds a pair at the threshold with this probability.

    Of all (bands, rows) with ``bands * rows <= most`` that reach the recall, the one with the
    most rows, as more rows let fewer unlike pairs through.
    """
    for rows in range(most, 0, -1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else int(np.ceil(np.log(1 - recall) / np.log1p(-hit)))
        if bands * rows <= most:
            return bands, rows
    return most, 1


def gram_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes (48 bits) of all texts, ascending in each, and the bounds of texts.

    A text of fewer words, but not none, has one shorter n-gram.
    """
    words = Words(column)
    starts, per = window_starts(words.first, n)
    parts, texts = [window_hash(words.hash, n)[starts]], [np.repeat(np.arange(words.n), per)]
    counts = words.counts
    for size in range(1, n):
        short = np.flatnonzero(counts == size)
        if len(short):
            parts.append(window_hash(words.hash, size)[words.first[short]])
            texts.append(short)
    text = np.concatenate(texts).astype(np.uint64)
    whole = distinct((text << np.uint64(48)) | (np.concatenate(parts) >> np.uint64(16)))
    bounds = np.searchsorted(whole, np.arange(words.n + 1, dtype=np.uint64) << np.uint64(48))
    return whole & np.uint64((1 << 48) - 1), bounds


def short_slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    for own in slices(batch, column):
        for i in range(0, own.num_rows, 1 << 15):
            yield own.slice(i, 1 << 15)


def signatures(docs: DataFrame, n: int, bands: int, rows: int, seed: int = 1) -> DataFrame:
    """uid, doc_id, node (a hash of the n-gram set), set size and band hashes of each document."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in short_slices(batch, "text"):
                grams, bounds = gram_sets(own.column(2), n)
                size = np.diff(bounds)
                full = np.flatnonzero(size)
                at = bounds[:-1][full]
                mixed = mix(grams + np.uint64(1))
                node = mix(own.column(0).to_numpy().view(np.uint64))
                band = np.zeros((own.num_rows, bands), np.uint64)
                if len(full):
                    node[full] = mix(np.add.reduceat(mixed, at) + size[full].astype(np.uint64))
                    for k in range(bands * rows):
                        least = np.minimum.reduceat(mixed * factors[k] + shifts[k], at)
                        b = k // rows
                        band[full, b] = mix(band[full, b] + least + np.uint64(b + 1))
                kept = np.where(size > 0, bands, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(kept))), pa.int32()), pa.array(band[full].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(node.view(np.int64)), pa.array(size.astype(np.int32)), lists], names=["uid", "doc_id", "node", "n_grams", "bands"])

    return with_uid(docs).mapInArrow(run, "uid long, doc_id long, node long, n_grams int, bands array<long>")


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all sets of b."""
    grams = np.concatenate([*a, *b])
    of = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    order = np.argsort(grams, kind="stable")
    grams, of = grams[order], of[order]
    heads = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
    column = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(grams))))
    # Only n-grams of both sides count.
    left = np.zeros(len(heads), bool)
    right = np.zeros(len(heads), bool)
    left[column[of < len(a)]] = True
    right[column[of >= len(a)]] = True
    both = left & right
    new = np.cumsum(both) - 1
    keep = both[column]
    column, of = new[column[keep]], of[keep]
    out = np.zeros((len(a), len(b)), np.float32)
    for start in range(0, int(both.sum()), COLUMNS):
        low, high = np.searchsorted(column, [start, start + COLUMNS])
        cells = np.zeros((len(a) + len(b), min(COLUMNS, int(both.sum()) - start)), np.float32)
        cells[of[low:high], column[low:high] - start] = 1
        out += cells[: len(a)] @ cells[len(a) :].T
    return out


def compare(threshold: float):
    """mapInArrow over rows sorted by (component, tile, other): links per node and spanning edges."""

    def group(rows: list[dict]) -> tuple[list, list, list]:
        i, j = rows[0]["low"], rows[0]["high"]
        sets = [np.frombuffer(r["grams"], np.uint64) for r in rows]
        side = np.array([r["tile"] for r in rows])
        a = np.flatnonzero(side == i)
        b = a if i == j else np.flatnonzero(side == j)
        if not len(a) or not len(b) or (i == j and len(a) < 2):
            return [], [], []
        sizes = np.array([len(s) for s in sets], np.float64)
        same = overlaps([sets[k] for k in a], [sets[k] for k in b]).astype(np.float64)
        linked = same >= threshold * (sizes[a][:, None] + sizes[b][None, :] - same) - 1e-9
        if i == j:
            np.fill_diagonal(linked, False)
        links = np.zeros(len(rows), np.int64)
        links[a] += linked.sum(axis=1)
        if i != j:
            links[b] += linked.sum(axis=0)
        # A forest over the links of this pair of tiles.
        root = np.arange(len(rows))
        while True:
            near = root.copy()
            np.minimum.at(near, a, np.where(linked, root[b][None, :], len(rows)).min(axis=1))
            np.minimum.at(near, b, np.where(linked, root[a][:, None], len(rows)).min(axis=0))
            near = near[near]
            if (near == root).all():
                break
            root = near
        node = [r["node"] for r in rows]
        hit = np.flatnonzero(links)
        return [node[k] for k in hit], [node[root[k]] for k in hit], links[hit].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], ([], [], [])
        for batch in batches:
            for r in batch.to_pylist():
                key = (r["label"], r["low"], r["high"])
                if key != now:
                    if len(held) > 1:
                        for x, y in zip(out, group(held), strict=True):
                            x.extend(y)
                    now, held = key, []
                held.append(r)
            if len(out[0]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["node", "root", "links"])
                out = ([], [], [])
        if len(held) > 1:
            for x, y in zip(out, group(held), strict=True):
                x.extend(y)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["node", "root", "links"])

    return run


def classified(docs: DataFrame, n: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """Signatures of all rows, and each node with its first document, copies, links and class label."""
    spark = docs.sparkSession
    bands, rows = bands_and_rows(threshold, recall)
    signed = table(signatures(docs, n, bands, rows), "signatures")
    nodes = signed.groupBy("node").agg(F.min(F.struct("doc_id", "uid")).alias("first"), F.count("*").alias("copies"))
    # One row of each node carries its bands.
    firsts = signed.where("n_grams > 0").groupBy("node").agg(F.min_by("bands", "uid").alias("bands"), F.min("uid").alias("uid"))
    spread = table(firsts.select("node", "uid", F.explode("bands").alias("band")), "bands")
    heads = spread.groupBy("band").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    grouped = table(star_components(spread.join(heads, "band").select("node", "head")), "grouped")
    size = grouped.groupBy("label").agg(F.count("*").alias("size"))
    chosen = grouped.join(size, "label").join(firsts.select("node", "uid"), "node")
    chosen = table(chosen.select("uid", "node", "label", F.ceil(F.col("size") / TILE).cast("int").alias("tiles")), "chosen")
    drop(spread)
    free(spark)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in short_slices(batch, "text"):
                grams, bounds = gram_sets(own.column(0), n)
                data = [grams[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([own.column(1), own.column(2), own.column(3), pa.array(data, pa.binary())], names=["node", "label", "tiles", "grams"])

    # A shuffle at every size: no bound is known for the chosen documents. Equal rows leave one set.
    texts = with_uid(docs).join(chosen.hint("merge"), "uid").dropDuplicates(["uid"]).select("text", "node", "label", "tiles")
    full = table(texts.mapInArrow(sets, "node long, label long, tiles int, grams binary"), "sets")
    free(spark)
    tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    paired = full.withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    paired = paired.select("label", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "node", "grams")
    order = ["label", "low", "high"]
    found = table(paired.repartition(*order).sortWithinPartitions(*order, "node").mapInArrow(compare(threshold), "node long, root long, links long"), "links")
    drop(full, chosen)
    free(spark)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = star_components(found.select("node", F.col("root").alias("head")))
    marked = nodes.join(links, "node", "left").join(classes, "node", "left").withColumn("label", F.coalesce("label", "node"))
    marked = table(marked, "nodes")
    return signed, marked


def near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """Each document with its class and links; classes are connected by similarities of the threshold.

    uid, doc_id, class_id (the least doc_id of the class), n_links (other n-gram sets that are
    similar enough), n_same (other documents with the same set), class_size, kept (the class's
    first document by doc_id, then by content). Texts are compared as sets of word n-grams
    without ASCII case; null and wordless texts are alone in their classes. Equal rows fall in one
    class and each have a row. A pair at exactly the threshold is found with probability
    ``recall``, more similar pairs almost surely. Further columns are ignored.
    """
    signed, marked = classified(docs, n, threshold, recall)
    whole = marked.groupBy("label").agg(F.min("first").alias("head"), F.sum("copies").alias("class_size"))
    named = marked.join(whole, "label").select("node", "links", "copies", "head", "class_size")
    out = signed.select("uid", "doc_id", "node").join(named, "node")
    return out.select(
        "uid", "doc_id", F.col("head.doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"), (F.col("copies") - 1).alias("n_same"), "class_size", F.struct("doc_id", "uid").eqNullSafe(F.col("head")).alias("kept")
    )


def one_of_each(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """The first document of each class; equal rows stay once."""
    _, nodes = classified(docs, n, threshold, recall)
    kept = table(nodes.groupBy("label").agg(F.min("first").alias("head")).select("head.uid").distinct(), "kept")
    free(docs.sparkSession)
    key = free_name(docs, "uid")
    first = docs.withColumn(key, uid_of()).join(kept.withColumnRenamed("uid", key).hint("merge"), key)
    return first.dropDuplicates([key]).select(*own_columns(docs))
