"""Words, byte-level BPE, FLAC and token planes: exact round trips and equality with plain code."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wiretide.llm import flac, packing, tokenfile
from wiretide.llm.bpe import Encoder
from wiretide.llm.queries import tokenizer_path
from wiretide.llm.textbytes import Words, hash_spans, slices

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, uid string, part string, label string"
texts = st.lists(st.one_of(st.none(), st.text(max_size=60), st.text(alphabet="ab 's\n.é漢1'", max_size=40)), max_size=8)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def encoder():
    return Encoder(tokenizer_path())


def odd_docs(spark):
    rows = [(1, "One two three.", "u", "p", "l"), (2, None, None, None, None), (3, "", "u", "p", "l"), (4, "wörd " * 3000, "u", "p", "l"), (5, "One two three.", "u", "p", "l"), (5, "One two three.", "u", "p", "l"), (None, "x", "u", "p", "l")]
    return spark.createDataFrame(rows, SCHEMA)


@settings(max_examples=60, deadline=None)
@given(texts)
def test_words_are_those_of_the_pattern(column):
    words = Words(pa.array(column, pa.string()))
    raw = words.raw.tobytes()
    got = [[raw[a:b].decode() for a, b in zip(words.starts[i:j], words.ends[i:j], strict=True)] for i, j in zip(words.first[:-1], words.first[1:], strict=True)]
    assert [[lower(w) for w in x] for x in got] == [WORD.findall(lower(t)) for t in column]


def test_hash_depends_on_bytes_alone():
    raw = np.frombuffer(b"abcabc" * 400_000, np.uint8)
    starts = np.arange(0, len(raw), 3)
    assert len(np.unique(hash_spans(raw, starts, starts + 3))) == 1
    assert len(np.unique(hash_spans(raw[:8], np.arange(8), np.arange(8) + 1))) == 3


def test_slices_keep_every_row():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 50, "", "c"]})
    assert sum(s.num_rows for s in slices(batch, size=12)) == 5


@settings(max_examples=80, deadline=None)
@given(texts)
def test_ids_equal_the_library(encoder, column):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    ids, counts = encoder.encode(pa.array(column, pa.string()))
    parts = np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else []
    assert [p.tolist() for p in parts] == [plain.encode(t or "", add_special_tokens=False).ids for t in column]


def test_strings_of_added_tokens_equal_the_library(encoder):
    from tokenizers import Tokenizer

    plain, token = Tokenizer.from_file(tokenizer_path()), "<|endoftext|>"
    column = ["plain words", f"a {token} b", None, token, f"{token}{token} é", "", token[:5], token[5:], f"x{token[:-1]}", f"{token}'s " * 5000, "last"]
    ids, counts = encoder.encode(pa.array(column, pa.string()))
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in column]
    assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == want
    assert plain.token_to_id(token) in want[1]


def test_other_pretokenizers_use_the_library():
    own = Encoder(tokenizer_path("word_bpe_49k.json"))
    assert own.plain
    ids, counts = own.encode(pa.array(["hello world", None]))
    assert ids.tolist() == own.library.encode("hello world", add_special_tokens=False).ids and counts[1] == len(own.library.encode("", add_special_tokens=False).ids)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=400)), min_size=1, max_size=5), st.booleans())
def test_flac_round_trip(column, ranked):
    payload, bounds, size = flac.padded_payloads(pa.array(column, pa.string()))
    table = flac.text_samples() if ranked else flac.plain_samples()
    files = flac.encode(payload, bounds, table)
    samples, got, _, _ = flac.decode(files)
    assert (got == bounds).all() and (samples == table[payload].astype(np.int64)).all()
    assert size.tolist() == [len((t or "").encode()) for t in column] and (np.diff(bounds) % 64 == 0).all()


def test_flac_kinds_of_subframes_and_damage():
    rng = np.random.default_rng(1)
    wave = np.zeros(12000)
    for t in range(2, len(wave)):
        wave[t] = 0.6 * wave[t - 1] - 0.9 * wave[t - 2] + 8 * rng.standard_normal()
    wave = np.clip(wave, -127, 127).astype(int) + 128
    parts = [np.zeros(64, int), rng.integers(0, 256, 5056), wave[:11968], np.cumsum(rng.integers(-1, 2, 4096)) % 256]
    payload = np.concatenate(parts).astype(np.uint8)
    bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    files = flac.encode(payload, bounds, flac.plain_samples())
    samples, _, kinds, _ = flac.decode(files)
    assert (samples + 128 == payload).all()
    assert {flac.CONSTANT, flac.VERBATIM, flac.LPC} <= set(kinds.tolist())
    bad = bytearray(files[2])
    bad[-20] ^= 4
    with pytest.raises(ValueError):
        flac.decode([bytes(bad)])


def test_flac_reads_escapes_wide_parameters_and_wasted_bits():
    bits = []

    def put(value, n):
        bits.extend((value >> (n - 1 - i)) & 1 for i in range(n))

    samples = [8, -16, 24, 0, 40, -48, 56, 64] * 4
    put(0b0010001, 7)  # pad, fixed order 0 follows below
    bits.clear()
    put(0, 1), put(0b001000, 6), put(1, 1)  # fixed, order 0, wasted bits follow
    put(0, 1), put(0, 1), put(1, 1)  # three wasted bits
    put(1, 2), put(1, 4)  # 5-bit parameters, two partitions
    put(31, 5), put(6, 5)  # escape: 6-bit numbers
    for s in samples[:16]:
        put((s >> 3) & 63, 6)
    put(2, 5)
    for s in samples[16:]:
        u = 2 * (s >> 3) if s >= 0 else -2 * (s >> 3) - 1
        put(0, u >> 2), put(1, 1), put(u & 3, 2)
    bits += [0] * (-len(bits) % 8)
    head = b"\xff\xf8\x60\x02\x00" + bytes([len(samples) - 1])
    frame = head + bytes([flac.crc8(head)]) + np.packbits(bits).tobytes()
    data = np.frombuffer(frame, np.uint8)
    frame += int(flac.crc16(data, np.array([0]), np.array([len(data)]))[0]).to_bytes(2, "big")
    info = (4096).to_bytes(2, "big") * 2 + bytes(6) + ((8000 << 44) | (7 << 36) | len(samples)).to_bytes(8, "big") + bytes(16)
    got, _, kinds, _ = flac.decode([b"fLaC\x80" + len(info).to_bytes(3, "big") + info + frame])
    assert got.tolist() == samples and kinds.tolist() == [flac.FIXED]


def test_pcm_blocks_are_seekable(spark):
    docs = odd_docs(spark)
    files = flac.texts_to_flac(docs)
    blocks = flac.pcm_blocks(files.selectExpr("doc_id AS key", "flac")).collect()
    long = sorted((b for b in blocks if b["key"] == 4), key=lambda b: b["first_sample"])
    assert [b["first_sample"] for b in long] == [i * 4096 for i in range(len(long))]
    assert sum(b["n_samples"] for b in long) == len(b"".join(b["pcm"] for b in long)) == -(-len(("wörd " * 3000).encode()) // 64) * 64


def test_media_features(spark):
    rows = flac.text_features(flac.texts_to_flac(odd_docs(spark))).collect()
    assert len(rows) == 7
    for r in rows:
        text = {1: "One two three.", 2: "", 3: "", 4: "wörd " * 3000, 5: "One two three.", None: "x"}[r["doc_id"]].encode()
        payload = text + bytes(max(-(-len(text) // 64), 1) * 64 - len(text))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    same = {tuple(r)[1:] for r in rows if r["doc_id"] in (1, 5)}
    assert len(same) == 1
    assert flac.text_features(flac.texts_to_flac(odd_docs(spark).limit(0))).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.sampled_from(["bit", "byte"]), st.sampled_from([7, 64, 1000]))
def test_planes_round_trip(ids, kind, block):
    own = np.array(ids, "<u4")
    id_bytes, sizes, planes = tokenfile.encode_chunk(own, kind, block)
    assert tokenfile.decode_chunk(planes, sizes, kind, id_bytes, block, len(own)).tolist() == ids


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_token_files(spark, kind, encoder):
    rows = sorted(map(tuple, tokenfile.write_and_read(odd_docs(spark), tokenizer_path(), 2, kind).collect()), key=lambda r: r[1])
    want, start = [], 0
    for key, text in [(None, "x"), (1, "One two three."), (2, ""), (3, ""), (4, "wörd " * 3000), (5, "One two three."), (5, "One two three.")]:
        ids = np.append(encoder.encode(pa.array([text]))[0], 2).astype("<u4")
        want.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert rows == want
    assert tokenfile.write_and_read(odd_docs(spark).limit(0), tokenizer_path()).count() == 0


def test_plan_is_exact_and_tight():
    rng = random.Random(3)
    for _ in range(20):
        cap = rng.choice([8, 50, 2048])
        hist = {rng.randint(1, cap): rng.randint(1, 400) for _ in range(rng.randint(1, 40))}
        rows = packing.plan(hist, cap)
        used, place = {}, set()
        for length, first, n, seq, offset in rows.tolist():
            for i in range(n):
                place.add((length, first + i))
                used.setdefault(seq + i, []).append((offset, length))
        assert place == {(k, r) for k, n in hist.items() for r in range(n)} and len(place) == rows[:, 2].sum()
        for parts in used.values():
            end = 0
            for offset, length in sorted(parts):
                assert offset == end
                end += length
            assert end <= cap
        least = -(-sum(k * n for k, n in hist.items()) // cap)
        assert len(used) <= 11 / 9 * max(least, sum(n for k, n in hist.items() if 2 * k > cap)) + 1


def test_packing(spark, encoder):
    rows = packing.pack(odd_docs(spark), tokenizer_path(), 128, 0).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        if r["doc_id"] == 4:
            by_doc[r["piece"]] = r
    ids = np.append(encoder.encode(pa.array(["wörd " * 3000]))[0], 0).astype("<u4")
    assert [by_doc[k]["start"] for k in sorted(by_doc)] == [0] + list(range(by_doc[0]["length"], len(ids), 128))
    assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in by_doc.values())
    assert len(rows) == len(by_doc) + 6
    for parts in by_sequence.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[0][0] == 0 and sum(parts[-1]) <= 128
    assert packing.pack(odd_docs(spark).limit(0), tokenizer_path()).count() == 0
