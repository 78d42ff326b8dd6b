"""Byte-level BPE of whole Arrow columns with the tokenizers library.

Byte-level BPE works on one pre-token at a time. The pre-tokens of a slice are found in numpy,
each distinct one is encoded once per Python worker by the library's own model, and the ids of
texts are gathered from that table. Files with another pre-tokenizer go through
``encode_batch``. Equality with plain ``encode`` is tested on random texts.
"""

from __future__ import annotations

import json
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textbytes import flat, hash_spans

LETTER, NUMBER, OTHER, WHITE, SPACE = range(5)
#: Words kept per worker; the table starts anew beyond it, so memory stays bounded.
MOST_WORDS = 2_000_000
_ENCODERS: dict[str, Encoder] = {}
_CLASS: np.ndarray | None = None


def encoder(path: str) -> Encoder:
    """The worker's encoder for this tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def classes() -> np.ndarray:
    """The class of each code point: letter, number, white space or other."""
    global _CLASS
    if _CLASS is None:
        major = "".join(unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1))
        kind = np.frombuffer(major.encode(), np.uint8)
        _CLASS = np.full(len(kind), OTHER, np.uint8)
        _CLASS[kind == ord("L")] = LETTER
        _CLASS[kind == ord("N")] = NUMBER
        _CLASS[[*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = WHITE
        _CLASS[32] = SPACE
    return _CLASS


def byte_letters() -> np.ndarray:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = np.zeros(256, np.uint32)
    out[own] = own
    out[[b for b in range(256) if b not in set(own)]] = 256 + np.arange(256 - len(own))
    return out


def pretoken_starts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Byte starts of the byte-level pre-tokens of all texts; each runs to the next start."""
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    n = len(lead)
    if not n:
        return np.zeros(0, np.int64)
    code = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = classes()[code]
    heads = np.searchsorted(lead, at[:-1][np.diff(at) > 0])
    head = np.zeros(n + 1, bool)
    head[heads] = head[n] = True
    group = np.minimum(kind, WHITE)
    flag = head[:n].copy()
    flag[1:] |= group[1:] != group[:-1]
    # The last of some white space before a word stands alone; a plain space joins the word.
    white = group == WHITE
    before = np.flatnonzero(white[:-1] & ~white[1:] & ~head[1:n])
    flag[before] = True
    flag[before[kind[before] == SPACE] + 1] = False
    # English contractions begin at an apostrophe that opens a pre-token.
    quote = np.flatnonzero((code[:-1] == 39) & flag[:-1] & (kind[1:] == LETTER) & ~head[1:n])
    if len(quote):
        one = code[quote + 1]
        two = np.where((quote + 2 < n) & ~head[np.minimum(quote + 2, n)], code[np.minimum(quote + 2, n - 1)], 0)
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for length, hit in ((2, quote[single]), (3, quote[double & ~single])):
            flag[hit + 1] = False
            rest = hit + length
            rest = rest[rest < n]
            flag[rest] = True
    return lead[np.flatnonzero(flag)]


class Encoder:
    """Ids of whole texts, as the library gives them without special tokens around a text.

    A text in which an added token's string stands, such as ``<|endoftext|>``, has that token's id
    there; these texts are left to the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        spec = json.load(open(path, encoding="utf-8"))
        pre = spec.get("pre_tokenizer") or {}
        self.plain = not (spec["model"]["type"] == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"))
        self.library, self.whole = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.added = [t["content"].encode() for t in spec.get("added_tokens") or [] if t["content"]]
        if not self.plain:
            self.letters = byte_letters()
            # Byte 0 parts the joined pre-tokens and shows in the ids where one ends.
            self.part = chr(self.letters[0])
            self.part_id = self.library.token_to_id(self.part)
            self.library.pre_tokenizer = pre_tokenizers.Split(self.part, "isolated")
            self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.row = np.zeros(0, np.int64)
        self.first, self.size, self.used, self.words = np.zeros(1024, np.int64), np.zeros(1024, np.int32), 0, 0
        self.pool = np.zeros(4096, np.uint32)

    def learn(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> None:
        """Encode new pre-tokens; their hashes are ``keys`` in ascending order."""
        size = ends - starts
        lead = np.concatenate(([0], np.cumsum(size + 1)))
        joined = np.full(lead[-1], ord(self.part), np.uint32)
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        byte = raw[inner + np.repeat(starts, size)]
        joined[inner + np.repeat(lead[:-1], size)] = self.letters[byte]
        if (byte == 0).any():
            texts = [joined[a : b - 1].tobytes().decode("utf-32-le") for a, b in zip(lead[:-1], lead[1:], strict=True)]
            got = [[k.id for k in self.library.model.tokenize(x)] for x in texts]
            ids, lengths = np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got])
        else:
            step = 500
            parts = [joined[lead[i] : lead[min(i + step, len(keys))]].tobytes().decode("utf-32-le") for i in range(0, len(keys), step)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(parts, add_special_tokens=False)])
            close = np.flatnonzero(ids == self.part_id)
            lengths = np.diff(close, prepend=-1) - 1
            ids = np.delete(ids, close)
        n, m = self.words, len(keys)
        while len(self.first) < n + m:
            self.first, self.size = np.concatenate((self.first, np.zeros_like(self.first))), np.concatenate((self.size, np.zeros_like(self.size)))
        while len(self.pool) < self.used + len(ids):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used : self.used + len(ids)] = ids
        self.first[n : n + m] = self.used + np.cumsum(lengths) - lengths
        self.size[n : n + m] = lengths
        self.used += len(ids)
        self.words += m
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.row = np.insert(self.row, place, np.arange(n, n + m))

    def find(self, known: np.ndarray) -> np.ndarray:
        """Places in the sorted keys; looked up in order, as that stays in the cache."""
        order = np.argsort(known)
        place = np.empty(len(known), np.int64)
        place[order] = np.searchsorted(self.keys, known[order])
        return place

    def holders(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The texts that hold the string of an added token."""
        data, found = raw.tobytes(), set()
        for token in self.added:
            place = data.find(token)
            while place >= 0:
                text = int(np.searchsorted(at, place, "right")) - 1
                if place + len(token) <= at[text + 1]:
                    found.add(text)
                    place = data.find(token, int(at[text + 1]))
                else:
                    place = data.find(token, place + 1)
        return np.array(sorted(found), np.int64)

    def with_special(self, column: pa.Array, special: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` where some texts go through the library."""
        texts = column.take(pa.array(special)).to_pylist()
        mask = np.zeros(len(column), bool)
        mask[special] = True
        ids, counts = self.encode(pc.if_else(pa.array(mask), pa.scalar("", column.type), column))
        got = [np.array(self.whole.encode(x, add_special_tokens=False).ids, np.uint32) for x in texts]
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for i, own in zip(special.tolist(), got, strict=True):
            parts[i], counts[i] = own, len(own)
        return np.concatenate(parts), counts

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the column's texts, and the number of ids of each text."""
        if self.plain:
            got = [e.ids for e in self.whole.encode_batch_fast(column.fill_null("").to_pylist(), add_special_tokens=False)]
            return np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got], np.int64)
        import pandas as pd

        raw, at = flat(column)
        special = self.holders(raw, at)
        if len(special):
            return self.with_special(column, special)
        starts = pretoken_starts(raw, at)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(at) - 1, np.int64)
        ends = np.append(starts[1:], len(raw))
        code, known = pd.factorize(hash_spans(raw, starts, ends))
        if self.words + len(known) > MOST_WORDS:
            self.clear()
        place = self.find(known)
        fresh = np.ones(len(known), bool)
        inside = place < len(self.keys)
        fresh[inside] = self.keys[place[inside]] != known[inside]
        if fresh.any():
            example = np.empty(len(known), np.int64)
            example[code[::-1]] = np.arange(len(code))[::-1]
            new = np.flatnonzero(fresh)
            new = new[np.argsort(known[new])]
            self.learn(raw, starts[example[new]], ends[example[new]], known[new])
            place = self.find(known)
        row = self.row[place][code]
        size = self.size[row].astype(np.int64)
        lead = np.concatenate(([0], np.cumsum(size)))
        ids = self.pool[np.repeat(self.first[row] - lead[:-1], size) + np.arange(lead[-1])]
        bounds = np.searchsorted(starts, at)
        return ids, np.diff(lead[bounds])
