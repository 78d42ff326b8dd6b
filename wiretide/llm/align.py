"""Alignment of two tokenizers' ids on the bytes of the same texts.

A transducer reads both id sequences. Its state is the side that leads and that side's bytes which
the other hasn't matched yet (the dangling suffix); reading the next token of the side behind gives
the next state. Transitions are memoised by state and token, and a group closes where the suffix is
empty. Texts are cut at spaces at which both tokenizers always begin a new token, and each distinct
piece of text goes through both libraries and the transducer once per worker.

Documents are held in blocks of bounded size: a block has a dictionary of its id pairs, so that
corpus-wide counts are joined once per pair and block and not once per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder, byte_letters
from .store import table
from .textbytes import flat, hash_spans, slices
from .tokenfile import decode_chunk, encode_chunk

#: Bytes of texts in a block (one document at least).
BLOCK_BYTES = 1 << 24
#: Pieces and bytes of pieces kept per worker; the memory starts anew beyond it.
MOST_PIECES, MOST_BYTES = 600_000, 1 << 25
BLOCK = "block long, doc_ids binary, sums binary, digests binary, n_pairs binary, plane_sizes binary, planes binary, id_bytes int, pairs array<long>, holders array<int>"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
SPACE = 32


class Transducer:
    """States are interned (0: empty suffix) and moves memoised; many sequences step side by side."""

    def __init__(self, bytes_a: list[bytes], bytes_b: list[bytes]):
        self.tokens = (bytes_a, bytes_b)
        self.width = max(len(bytes_a), len(bytes_b))
        self.clear()

    def clear(self) -> None:
        self.states: dict[tuple[int, bytes], int] = {(0, b""): 0}
        self.of: list[tuple[int, bytes]] = [(0, b"")]
        self.sides = np.zeros(1, np.int8)
        # Memoised moves: state * width + token in ascending order, and the state after.
        self.keys, self.after = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def state(self, side: int, suffix: bytes) -> int:
        if not suffix:
            return 0
        got = self.states.setdefault((side, suffix), len(self.of))
        if got == len(self.of):
            self.of.append((side, suffix))
        return got

    def move(self, state: int, token: int) -> int:
        """The state after the side behind reads this token (side a from state 0); -1 if bytes differ."""
        side, suffix = self.of[state]
        if not state:
            return self.state(0, self.tokens[0][token])
        own = self.tokens[1 - side][token]
        if suffix.startswith(own):
            return self.state(side, suffix[len(own) :])
        return self.state(1 - side, own[len(suffix) :]) if own.startswith(suffix) else -1

    def moved(self, keys: np.ndarray) -> np.ndarray:
        """States after these moves; moves that are new are made and kept."""
        place = np.searchsorted(self.keys, keys)
        inside = place < len(self.keys)
        fresh = ~inside
        fresh[inside] = self.keys[place[inside]] != keys[inside]
        if fresh.any():
            new = np.unique(keys[fresh])
            got = [self.move(k // self.width, k % self.width) for k in new.tolist()]
            at = np.searchsorted(self.keys, new)
            self.keys, self.after = np.insert(self.keys, at, new), np.insert(self.after, at, got)
            self.sides = np.array([x[0] for x in self.of], np.int8)
            place = np.searchsorted(self.keys, keys)
        return self.after[place]

    def run(self, a: np.ndarray, first_a: np.ndarray, b: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Whether each pair of sequences has the same bytes, the last tokens of groups on both sides, and links.

        A link is the sequence's number and its ids (a, then b, 32 bits each): a token that is read
        links with the leading one, the last token of the leading side.
        """
        n = len(first_a) - 1
        state, i, j = np.zeros(n, np.int64), first_a[:-1].copy(), first_b[:-1].copy()
        good, last_a, last_b = np.ones(n, bool), np.zeros(len(a), bool), np.zeros(len(b), bool)
        whose, links = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        at = np.arange(n)
        while True:
            ended = (state[at] == 0) & (i[at] == first_a[at + 1]) & (j[at] == first_b[at + 1])
            at = at[~ended]
            if not len(at):
                return good, last_a, last_b, np.concatenate(whose), np.concatenate(links)
            own = state[at]
            reads_a = (own == 0) | (self.sides[own] == 1)
            short = np.where(reads_a, i[at] >= first_a[at + 1], j[at] >= first_b[at + 1])
            good[at[short]] = False
            at, own, reads_a = at[~short], own[~short], reads_a[~short]
            token = np.empty(len(at), np.int64)
            token[reads_a], token[~reads_a] = a[i[at[reads_a]]], b[j[at[~reads_a]]]
            led = own != 0
            by_a, by_b = led & reads_a, led & ~reads_a
            for k, pairs in ((by_a, (token[by_a] << 32) | b[j[at[by_a]] - 1]), (by_b, (a[i[at[by_b]] - 1] << 32) | token[by_b])):
                whose.append(at[k])
                links.append(pairs)
            then = self.moved(own * self.width + token)
            i[at[reads_a]] += 1
            j[at[~reads_a]] += 1
            good[at[then < 0]] = False
            at, then = at[then >= 0], then[then >= 0]
            state[at] = then
            closed = at[then == 0]
            last_a[i[closed] - 1] = last_b[j[closed] - 1] = True


def written(a: np.ndarray, last_a: np.ndarray, b: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups as text, each with a semicolon at its end, and the offset of each group."""
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    groups = int(last_a.sum())
    before_a = np.concatenate(([0], np.cumsum(np.bincount(group_a, minlength=groups))))
    before_b = np.concatenate(([0], np.cumsum(np.bincount(group_b, minlength=groups))))
    value, end = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
    at_a, at_b = np.arange(len(a)) + before_b[group_a], np.arange(len(b)) + before_a[group_b + 1]
    value[at_a], value[at_b] = a, b
    end[at_a], end[at_b] = np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))
    digits = 1 + sum((value >= 10**k).astype(np.int64) for k in range(1, 10))
    lead = np.concatenate(([0], np.cumsum(digits + 1)))
    out = np.empty(lead[-1], np.uint8)
    out[lead[1:] - 1] = end
    for k in range(int(digits.max(initial=0))):
        own = digits > k
        out[lead[1:][own] - 2 - k] = value[own] // 10**k % 10 + 48
    return out, lead[before_a + before_b]


class Pieces:
    """What is known of distinct pieces of text, in a worker."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = Encoder(path_a)
        self.a.added = []  # their strings are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = {chr(c): b for b, c in enumerate(byte_letters().tolist())}
        names = [self.a.library.id_to_token(i) or "" for i in range(self.a.library.get_vocab_size())]
        bytes_a = [bytes(byte_of[c] for c in x) if all(c in byte_of for c in x) else x.encode() for x in names]
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        bytes_b = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        # A piece of b with a space inside could join what is cut apart; then texts stay whole.
        self.cut = not any("▁" in x.lstrip("▁") for x in names)
        self.blank = [self.b.piece_to_id("▁")]
        self.transducer = Transducer(bytes_a, bytes_b)
        self.size_a = np.array([len(x) for x in bytes_a])
        self.first_a, self.flat_a = np.cumsum(self.size_a) - self.size_a, np.frombuffer(b"".join(bytes_a), np.uint8)
        self.clear()

    def clear(self) -> None:
        self.keys, self.rows, self.bytes = np.zeros(0, np.uint64), np.zeros(0, np.int32), 0
        self.sums = np.zeros((1024, 4), np.int32)
        self.first = np.zeros(1025, np.int64)
        self.pool = np.zeros(4096, np.int32)
        self.text: list[bytes] = []
        # Linked id pairs by number, and their ascending order.
        self.pair, self.sorted, self.number = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.transducer.clear()

    def starts(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Starts of texts and of spaces after a byte that ends no white space: there both sides begin a token."""
        head = at[:-1][np.diff(at) > 0]
        if not self.cut or len(raw) < 3:
            return head
        before, second = raw[1:-1], raw[:-2]
        plain = (before > 32) & (before < 127)
        wide = (before >= 128) & ~((second == 0xC2) & np.isin(before, [0x85, 0xA0])) & ~(np.isin(second, [0x80, 0x81, 0x9A]) & np.isin(before, [*range(0x80, 0x8B), 0x9F, 0xA8, 0xA9, 0xAF]))
        flag = np.zeros(len(raw), bool)
        flag[2:] = (raw[2:] == SPACE) & (plain | wide)
        flag[head] = True
        return np.flatnonzero(flag)

    def numbers(self, pairs: np.ndarray) -> np.ndarray:
        """The worker's numbers of linked pairs; new ones get the next."""
        known, back = np.unique(pairs, return_inverse=True)
        place = np.searchsorted(self.sorted, known)
        inside = place < len(self.sorted)
        fresh = ~inside
        fresh[inside] = self.sorted[place[inside]] != known[inside]
        new = known[fresh]
        self.sorted, self.number = np.insert(self.sorted, place[fresh], new), np.insert(self.number, place[fresh], len(self.pair) + np.arange(len(new)))
        self.pair = np.concatenate((self.pair, new))
        return self.number[np.searchsorted(self.sorted, known)][back]

    def learn(self, texts: list[bytes], keys: np.ndarray) -> None:
        """Encode and align new pieces; each begins with a space that b adds by itself."""
        n, m = len(self.text), len(texts)
        plain = [x.decode() for x in texts]
        a, n_a = self.a.encode(pa.array(plain, pa.large_string()))
        self.a.clear()  # pieces aren't seen twice
        # Of nothing b makes nothing, so the space at a text's end is its token for a space.
        got = [x if t != " " else self.blank for x, t in zip(self.b.encode([x[1:] for x in plain], num_threads=1), plain, strict=True)]
        n_b = np.array([len(x) for x in got], np.int64)
        a, b = a.astype(np.int64), np.fromiter(chain.from_iterable(got), np.int64, int(n_b.sum()))
        first_a, first_b = np.concatenate(([0], np.cumsum(n_a))), np.concatenate(([0], np.cumsum(n_b)))
        good, last_a, last_b, whose, links = self.transducer.run(a, first_a, b, first_b)
        # The transducer says that a's bytes are b's; they must be the piece's, too.
        own = np.frombuffer(b"".join(texts), np.uint8)
        lengths = np.array([len(x) for x in texts])
        size = self.size_a[a]
        total = np.concatenate(([0], np.cumsum(size)))
        good &= total[first_a[1:]] - total[first_a[:-1]] == lengths
        of_a = np.repeat(np.arange(m), n_a)
        joined = self.flat_a[np.repeat(self.first_a[a] - total[:-1], size) + np.arange(total[-1])][np.repeat(good[of_a], size)]
        differs = joined != own[np.repeat(good, lengths)]
        good[np.unique(np.repeat(np.flatnonzero(good), lengths[good])[differs])] = False
        keep_a, keep_b, keep = np.repeat(good, n_a), np.repeat(good, n_b), good[whose]
        n_a, n_b = n_a * good, n_b * good
        groups = np.bincount(of_a[keep_a & last_a], minlength=m)
        shown, at = written(a[keep_a], last_a[keep_a], b[keep_b], last_b[keep_b])
        at = at[np.concatenate(([0], np.cumsum(groups)))].tolist()
        data = shown.tobytes()
        self.text += [data[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
        while len(self.sums) < n + m:
            self.sums = np.concatenate((self.sums, np.zeros_like(self.sums)))
            self.first = np.concatenate((self.first, np.zeros(len(self.first) - 1, np.int64)))
        self.sums[n : n + m] = np.stack([n_a, n_b, groups, ~good], axis=1)
        linked = self.numbers(links[keep][np.argsort(whose[keep], kind="stable")])
        used = int(self.first[n])
        self.first[n + 1 : n + m + 1] = used + np.cumsum(np.bincount(whose[keep], minlength=m))
        while len(self.pool) < used + len(linked):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[used : used + len(linked)] = linked
        self.bytes += len(own)
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.rows = np.insert(self.rows, place, np.arange(n, n + m))

    def full(self) -> bool:
        return len(self.text) > MOST_PIECES or self.bytes > MOST_BYTES or len(self.transducer.keys) > MOST_PIECES

    def of(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all pieces of these texts, and the bounds of texts in them."""
        import pandas as pd

        starts = self.starts(raw, at)
        ends = np.append(starts[1:], len(raw))
        code, known = pd.factorize(hash_spans(raw, starts, ends))
        place = np.searchsorted(self.keys, known)
        fresh = np.ones(len(known), bool)
        inside = place < len(self.keys)
        fresh[inside] = self.keys[place[inside]] != known[inside]
        if fresh.any():
            example = np.empty(len(known), np.int64)
            example[code[::-1]] = np.arange(len(code))[::-1]
            new = np.flatnonzero(fresh)
            new = new[np.argsort(known[new])]
            data = raw.tobytes()
            self.learn([data[a:b] for a, b in zip(starts[example[new]].tolist(), ends[example[new]].tolist(), strict=True)], known[new])
            place = np.searchsorted(self.keys, known)
        return self.rows[place][code].astype(np.int64), np.searchsorted(starts, at)


_PIECES: dict[tuple[str, str], Pieces] = {}


def pieces(path_a: str, path_b: str) -> Pieces:
    if (path_a, path_b) not in _PIECES:
        _PIECES[path_a, path_b] = Pieces(path_a, path_b)
    return _PIECES[path_a, path_b]


def with_space(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts with a space before each; empty texts stay empty."""
    raw, at = flat(column)
    full = np.diff(at) > 0
    out = np.full(len(raw) + int(full.sum()), SPACE, np.uint8)
    lead = np.concatenate(([0], np.cumsum(full)))
    shift = np.repeat(lead[1:], np.diff(at))
    out[np.arange(len(raw)) + shift] = raw
    return out, at + lead


class Block:
    """Aligned documents that wait for the block to close."""

    def __init__(self, own: Pieces):
        self.own, self.size = own, 0
        self.ids: list[np.ndarray] = []
        self.sums: list[np.ndarray] = []
        self.digests: list[bytes] = []
        self.links: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, ids: np.ndarray, column: pa.Array) -> None:
        """Per document its sums, digest, and distinct pairs (as the worker numbers them) with how often each is linked."""
        own = self.own
        raw, at = with_space(column)
        rows, bounds = own.of(raw, at) if len(raw) else (np.zeros(0, np.int64), np.zeros(len(at), np.int64))
        total = np.concatenate((np.zeros((1, 4), np.int64), np.cumsum(own.sums[rows], axis=0, dtype=np.int64)))
        sums = total[bounds[1:]] - total[bounds[:-1]]
        good = (sums[:, 3] == 0) & (sums[:, 0] > 0)
        sums[~good] = 0
        of = np.repeat(np.arange(len(ids)), np.diff(bounds))
        keep = good[of]
        size = (own.first[rows + 1] - own.first[rows])[keep]
        lead = np.cumsum(size) - size
        pair = own.pool[np.repeat(own.first[rows[keep]] - lead, size) + np.arange(int(size.sum()))]
        width = np.int64(max(1, len(own.pair)))
        keys, often = np.unique(np.repeat(of[keep], size) * width + pair, return_counts=True)
        self.links.append((np.bincount(keys // width, minlength=len(ids)), keys % width, often))
        text, order = own.text, rows.tolist()
        for ok, i, j in zip(good.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            self.digests.append(hashlib.sha256(b"".join([text[k] for k in order[i:j]])[:-1]).digest() if ok else bytes(32))
        sums[:, 3] = good
        self.ids.append(ids)
        self.sums.append(sums)
        self.size += len(raw)

    def close(self, number: int) -> pa.RecordBatch:
        n_pairs, pair, often = (np.concatenate(x) for x in zip(*self.links, strict=True))
        holders = np.bincount(pair, minlength=len(self.own.pair))
        local = np.flatnonzero(holders)
        place = np.zeros(len(holders), np.int64)
        place[local] = np.arange(len(local))
        # Steps between the ascending places of a document take few bits.
        place = place[pair]
        step = np.diff(place, prepend=0)
        heads = (np.cumsum(n_pairs) - n_pairs)[n_pairs > 0]
        step[heads] = place[heads]
        id_bytes, sizes, planes = encode_chunk(np.concatenate((step, often)).astype("<u4"))
        packed = [np.concatenate(self.ids).astype("<i8").tobytes(), np.concatenate(self.sums).astype("<i8").tobytes(), b"".join(self.digests), n_pairs.astype("<u4").tobytes(), sizes.tobytes(), planes]
        columns = [pa.array([number], pa.int64()), *(pa.array([x], pa.binary()) for x in packed), pa.array([id_bytes], pa.int32())]
        columns += [pa.array([self.own.pair[local]], pa.list_(pa.int64())), pa.array([holders[local].astype(np.int32)], pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in BLOCK.split(", ")])


NULL_ID = np.iinfo(np.int64).min


def blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Aligned documents in blocks: sums and digests, their pairs, and how many of the block's documents hold each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        block = Block(own)
        for batch in batches:
            for part in slices(batch):
                block.add(part.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False), part.column(1))
                if block.size >= BLOCK_BYTES or own.full():
                    yield block.close(number)
                    number += 1
                    if own.full():
                        own.clear()
                    block = Block(own)
        if block.ids:
            yield block.close(number)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, BLOCK)


def pair_counts(stored: DataFrame) -> DataFrame:
    """pair (id of a, then of b, 32 bits each), the number of documents that hold it linked, and whether no pair of its a id has more.

    The greatest counts by a id are at most as many as a's vocabulary, which bounds their broadcast.
    """
    each = stored.select(F.explode(F.arrays_zip("pairs", "holders")).alias("p"))
    counts = table(each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.holders").alias("docs")), "pair_counts")
    first = F.shiftright("pair", 32).alias("a")
    top = counts.groupBy(first).agg(F.max("docs").alias("most"))
    return counts.withColumn("a", first).join(F.broadcast(top), "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def finished(stored: DataFrame, counts: DataFrame) -> DataFrame:
    """A row per document, with the counts of its links summed."""
    each = stored.select("block", F.posexplode(F.arrays_zip("pairs", "holders")).alias("place", "p")).select("block", "place", F.col("p.pairs").alias("pair"))
    found = each.join(counts, "pair").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "docs", "best"))).alias("found"))
    held = found.select("block", F.transform("found", lambda x: x["docs"]).alias("docs"), F.transform("found", lambda x: x["best"].cast("int")).alias("best"))
    whole = stored.drop("pairs", "holders").join(held.hint("merge"), "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc, sums, digests, n_pairs, sizes, planes, id_bytes = (batch.column(k)[i].as_py() for k in range(1, 8))
                docs, best = (np.array(batch.column(k)[i].values, np.int64) if batch.column(k)[i].is_valid else np.zeros(0, np.int64) for k in (8, 9))
                doc, sums, n_pairs = np.frombuffer(doc, "<i8"), np.frombuffer(sums, "<i8").reshape(-1, 4), np.frombuffer(n_pairs, "<u4").astype(np.int64)
                n = int(n_pairs.sum())
                both = decode_chunk(planes, np.frombuffer(sizes, "<u4"), "byte", id_bytes, 1 << 16, 2 * n).astype(np.int64)
                step, often = both[:n], both[n:]
                first = np.cumsum(n_pairs) - n_pairs
                total = np.concatenate(([0], np.cumsum(step)))
                place = total[1:] - np.repeat(total[first], n_pairs)
                add = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[np.append(first, n)])
                good = sums[:, 3] == 1
                shown = [digests[32 * k : 32 * k + 32].hex() if ok else "" for k, ok in enumerate(good.tolist())]
                links = sums[:, 0] + sums[:, 1] - sums[:, 2]
                columns = [pa.array(doc, mask=doc == NULL_ID), *(pa.array(sums[:, k]) for k in range(3)), pa.array(links), pa.array(add(often * best[place])), pa.array(add(often * docs[place])), pa.array(shown)]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in ALIGNED.split(", ")])

    return whole.mapInArrow(run, ALIGNED)


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Groups and links of each whole text's ids under both tokenizers, one row for each row of docs.

    a encodes a space and the text, b (which adds the space) the text. Null and empty texts, and
    those whose joined token bytes aren't these bytes on both sides, have no tokens: zeros and an
    empty digest. Rows that repeat count as documents of their own; doc_id may be null; further
    columns are ignored; empty tables give empty results. A pair's count is the number of rows of
    docs that hold it linked.
    """
    stored = table(blocks(docs, path_a, path_b), "aligned")
    return finished(stored, table(pair_counts(stored), "pairs"))
