"""FLAC columns in numpy: many frames are coded and decoded side by side.

The decoder reads mono streams of up to 16 bits: constant, verbatim, fixed and linear predictors,
Rice residuals in partitions with 4- or 5-bit parameters and escapes, wasted bits; it checks the
CRC-8 of frame headers, the CRC-16 of frames and the MD5 of the samples. PCM comes out in blocks
that carry their first sample's number. The encoder writes 8-bit mono with a seek table.

Texts become samples by a table that puts frequent bytes near zero, as companding does for speech:
samples then have small residuals, and files are about a third smaller than with byte - 128.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import flat, slices

BLOCK = 4096
RATE = 8000
LPC_ORDER, PRECISION = 4, 10
CONSTANT, VERBATIM, FIXED, LPC = range(4)
#: Coefficients of the fixed predictors by order.
FIXED_COEFFICIENTS = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


#: Bytes of texts, the commonest first; all others follow by value.
_COMMON = b" etaoinshrdlucmfwypvbgkjqxz.,\n\xc3\xa9\xa8\xbc\xa4\xb3\xb6\xaa\xb1\xa7"


def plain_samples() -> np.ndarray:
    return (np.arange(256) - 128).astype(np.int8)


def text_samples() -> np.ndarray:
    """The sample of each byte: 0, -1, 1, -2 and so on by rank."""
    order = [*_COMMON, *(b for b in range(256) if b not in _COMMON)]
    rank = np.arange(256)
    out = np.empty(256, np.int8)
    out[order] = np.where(rank % 2, -(rank + 1) // 2, rank // 2)
    return out


def _crc_table(polynomial: int, bits: int) -> np.ndarray:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for value in range(256):
        crc = value << (bits - 8)
        for _ in range(8):
            crc = ((crc << 1) ^ polynomial if crc & top else crc << 1) & mask
        out.append(crc)
    return np.array(out, np.uint16)


CRC8 = _crc_table(0x07, 8).tolist()
CRC16 = _crc_table(0x8005, 16)
_FAR = CRC16[None, :].copy()


def crc8(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = CRC8[crc ^ b]
    return crc


def crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of spans. A byte's share depends only on its value and its distance from the end."""
    global _FAR
    longest = int((ends - starts).max()) if len(starts) else 0
    step = 1 << 14
    if longest > step:  # rare: fold long spans piece by piece
        out = np.zeros(len(starts), np.uint16)
        for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            crc = 0
            for byte in data[a:b].tolist():
                crc = ((crc << 8) & 0xFFFF) ^ int(CRC16[(crc >> 8) ^ byte])
            out[i] = crc
        return out
    while len(_FAR) < longest:
        rows = [_FAR[-1]]
        for _ in range(min(len(_FAR), step)):
            rows.append((rows[-1] << np.uint16(8)) ^ CRC16[rows[-1] >> np.uint16(8)])
        _FAR = np.concatenate((_FAR, np.stack(rows[1:])))
    size = ends - starts
    lead = np.cumsum(size) - size
    inner = np.arange(int(size.sum())) - np.repeat(lead, size)
    share = _FAR[np.repeat(size, size) - 1 - inner, data[inner + np.repeat(starts, size)]]
    return np.bitwise_xor.reduceat(share, lead)


def utf8_number(n: int) -> bytes:
    """A frame number as FLAC codes it (UTF-8 extended to 36 bits)."""
    if n < 0x80:
        return bytes([n])
    tail = []
    limit = 0x40
    while True:
        tail.append(0x80 | (n & 0x3F))
        n >>= 6
        limit >>= 1
        if n < limit:
            return bytes([(0xFF ^ (2 * limit - 1)) & 0xFF | n, *tail[::-1]])


# ---------------------------------------------------------------- encoding


def lpc_coefficients(x: np.ndarray, lead: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised predictors of order LPC_ORDER and their shifts for all frames (Levinson-Durbin)."""
    own = x.astype(np.float64)
    auto = []
    for lag in range(LPC_ORDER + 1):
        product = np.zeros(len(x))
        product[lag:] = own[lag:] * own[: len(x) - lag]
        product[inner < lag] = 0
        auto.append(np.add.reduceat(product, lead))
    auto = np.stack(auto)
    error = auto[0] * (1 + 1e-9) + 1e-9
    coef = np.zeros((LPC_ORDER, len(lead)))
    for i in range(LPC_ORDER):
        k = (auto[i + 1] - sum(coef[j] * auto[i - j] for j in range(i))) / error
        new = coef.copy()
        new[i] = k
        for j in range(i):
            new[j] = coef[j] - k * coef[i - 1 - j]
        coef, error = new, np.maximum(error * (1 - k * k), 1e-9)
    largest = np.maximum(np.abs(coef).max(axis=0), 1e-6)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(largest)).astype(np.int64), 0, 15)
    limit = 1 << (PRECISION - 1)
    return np.clip(np.rint(coef * 2.0**shift), -limit, limit - 1).astype(np.int64), shift


def residuals(x: np.ndarray, inner: np.ndarray, coefficients: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """x minus its prediction; coefficients[j] and shift are given for every sample."""
    guess = np.zeros(len(x), np.int64)
    for j, c in enumerate(coefficients, 1):
        guess[j:] += c[j:] * x[: len(x) - j]
    return x - (guess >> shift)


def encode(payload: np.ndarray, bounds: np.ndarray, samples: np.ndarray) -> list[bytes]:
    """A FLAC file for each payload; ``samples`` has the 8-bit sample of each byte."""
    size = np.diff(bounds)
    frames = -(-size // BLOCK)
    doc = np.repeat(np.arange(len(size)), frames)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(frames) - frames, frames)
    lead = bounds[doc] + number * BLOCK
    length = np.minimum(BLOCK, bounds[doc + 1] - lead)
    x = samples[payload].astype(np.int64)
    inner = np.arange(len(x)) - np.repeat(lead, length)
    of = np.repeat(np.arange(len(lead)), length)
    quantised, shift = lpc_coefficients(x, lead, inner)
    orders = [0, 1, 2, LPC_ORDER]
    options = [x]
    for order in (1, 2):
        options.append(residuals(x, inner, np.array([[c] for c in FIXED_COEFFICIENTS[order]]) * np.ones((1, len(x)), np.int64), np.zeros(len(x), np.int64)))
    options.append(residuals(x, inner, quantised[:, of], shift[of]))
    costs = []
    for order, r in zip(orders, options, strict=True):
        costs.append(np.add.reduceat(np.where(inner < order, 0, np.abs(r)), lead))
    choice = np.argmin(np.stack(costs), axis=0)
    constant = np.maximum.reduceat(x, lead) == np.minimum.reduceat(x, lead)
    order = np.array(orders)[choice]
    residual = np.choose(choice[of], options)
    parts = np.where(length % 4 == 0, 4, 1)  # four partitions where they divide the block
    part_size = length // parts
    folded = np.where(residual >= 0, 2 * residual, -2 * residual - 1)
    coded = inner >= order[of]
    folded[~coded] = 0
    first_part = np.cumsum(parts) - parts
    part = first_part[of] + inner // part_size[of]
    sums = np.bincount(part, folded, minlength=int(parts.sum()))
    counts = np.bincount(part, coded, minlength=int(parts.sum()))
    k = np.clip(np.floor(np.log2(np.maximum(sums / np.maximum(counts, 1) * 0.7, 1))).astype(np.int64), 0, 14)
    own_k = k[part]
    bits = np.where(coded, (folded >> own_k) + 1 + own_k, 0)
    total = np.add.reduceat(bits, lead) + 4 * parts
    prefix_bits = 8 + 8 * order + np.where(choice == 3, 9 + PRECISION * LPC_ORDER, 0) + 6
    kind = np.where(choice == 3, LPC, FIXED)
    kind = np.where(total + prefix_bits >= 8 + 8 * length, VERBATIM, kind)
    kind = np.where(constant, CONSTANT, kind)
    prefixes, prefix_sizes = [], np.zeros(len(lead), np.int64)
    raw = x.astype(np.int8).tobytes()
    rows = zip(lead.tolist(), length.tolist(), number.tolist(), kind.tolist(), order.tolist(), shift.tolist(), parts.tolist(), quantised.T.tolist(), strict=True)
    for i, (at, n, no, what, o, s, p, q) in enumerate(rows):
        head = b"\xff\xf8" + (b"\xc0\x02" if n == 4096 else b"\x70\x02") + utf8_number(no) + (b"" if n == 4096 else (n - 1).to_bytes(2, "big"))
        head += bytes([crc8(head)])
        if what == CONSTANT:
            body, width = raw[at : at + 1], 8
            head += b"\x00"
        elif what == VERBATIM:
            body, width = raw[at : at + n], 8 * n
            head += b"\x02"
        else:
            head += bytes([(0b001000 | o) << 1 if what == FIXED else (0b100000 | (o - 1)) << 1])
            value, width = int.from_bytes(raw[at : at + o], "big"), 8 * o
            if what == LPC:
                value = (((value << 4) | (PRECISION - 1)) << 5) | s
                for c in q:
                    value = (value << PRECISION) | (c & ((1 << PRECISION) - 1))
                width += 9 + PRECISION * LPC_ORDER
            value, width = (value << 6) | (2 if p == 4 else 0), width + 6
            pad = -width % 8
            body = (value << pad).to_bytes((width + pad) // 8, "big")
        prefixes.append(head + body)
        prefix_sizes[i] = 8 * len(head) + width
    rice = kind >= FIXED
    frame_bits = prefix_sizes + np.where(rice, total, 0)
    frame_bytes = (frame_bits + 7) // 8 + 2
    at_byte = np.cumsum(frame_bytes) - frame_bytes
    out = np.zeros(8 * int(frame_bytes.sum()), np.uint8)
    whole = np.array([len(p) for p in prefixes]) * 8
    source = np.unpackbits(np.frombuffer(b"".join(prefixes), np.uint8))
    inside = np.arange(len(source)) - np.repeat(np.cumsum(whole) - whole, whole)
    out[np.repeat(8 * at_byte, whole) + inside] = source
    # Rice parameters, then codes: q zeros, a one, k low bits.
    bits[~rice[of]] = 0
    cum = np.cumsum(bits)
    start = cum - bits - (cum[lead] - bits[lead])[of] + (8 * at_byte + prefix_sizes)[of] + 4 * (part - first_part[of] + 1)
    use = np.flatnonzero(coded & rice[of])
    stop = start[use] + bits[use] - 1
    low = (folded[use] & ((1 << own_k[use]) - 1)) | (1 << own_k[use])
    width = own_k[use]
    for b in range(int(width.max()) + 1 if len(use) else 0):
        some = width >= b
        out[stop[some] - b] = (low[some] >> b) & 1
    of_part = np.repeat(np.arange(len(lead)), parts)
    inner_part = np.arange(len(of_part)) - first_part[of_part]
    before = np.bincount(part, bits, minlength=len(of_part)).astype(np.int64)
    before = np.cumsum(before) - before
    mark = (8 * at_byte + prefix_sizes)[of_part] + 4 * inner_part + before - before[first_part[of_part]]
    for b in range(4):
        some = rice[of_part]
        out[mark[some] + b] = (k[some] >> (3 - b)) & 1
    data = np.packbits(out)
    check = crc16(data, at_byte, at_byte + frame_bytes - 2)
    data[at_byte + frame_bytes - 2], data[at_byte + frame_bytes - 1] = check >> 8, check & 255
    files, blob, done = [], data.tobytes(), np.concatenate(([0], np.cumsum(frames))).tolist()
    at_byte, frame_bytes, length = at_byte.tolist(), frame_bytes.tolist(), length.tolist()
    for d, n in enumerate(size.tolist()):
        own = range(done[d], done[d + 1])
        sizes = [frame_bytes[f] for f in own]
        a = at_byte[done[d]]
        info = BLOCK.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += ((RATE << 44) | (7 << 36) | n).to_bytes(8, "big") + hashlib.md5(raw[bounds[d] : bounds[d + 1]]).digest()
        seek = b"".join((BLOCK * i).to_bytes(8, "big") + (at_byte[f] - a).to_bytes(8, "big") + length[f].to_bytes(2, "big") for i, f in enumerate(own))
        head = b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek
        files.append(head + blob[a : a + sum(sizes)])
    return files


# ---------------------------------------------------------------- decoding


@dataclass
class Stream:
    """What a file's metadata says, and where its frames are."""

    block: int
    sample_bits: int
    samples: int
    md5: bytes
    frames: list[tuple[int, int, int, int]]  # first byte, bytes, first bit after the header, samples


def read_stream(data: bytes) -> Stream:
    """Metadata and frame bounds; a frame begins at a sync code with a right header checksum and number."""
    if data[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, info = 4, None
    while True:
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        if kind & 0x7F == 0:
            info = data[at + 4 : at + 4 + size]
        at += 4 + size
        if kind & 0x80:
            break
    packed = int.from_bytes(info[10:18], "big")
    bits, samples = ((packed >> 36) & 31) + 1, packed & ((1 << 36) - 1)
    if (packed >> 41) & 7 or bits > 16:
        raise ValueError("only mono streams of up to 16 bits are read")
    block = int.from_bytes(info[2:4], "big")
    starts, expected = [], 0
    while (at := data.find(b"\xff\xf8", at)) >= 0:
        code = data[at + 2] >> 4 if at + 3 < len(data) else 0
        number = utf8_number(expected)
        end = at + 4 + len(number) + {6: 1, 7: 2}.get(code, 0) + {12: 1, 13: 2, 14: 2}.get(data[at + 2] & 15 if code else 0, 0)
        if code and data[at + 4 : at + 4 + len(number)] == number and end < len(data) and crc8(data[at:end]) == data[end]:
            if code == 6 or code == 7:
                n = int.from_bytes(data[at + 4 + len(number) : at + 4 + len(number) + code - 5], "big") + 1
            else:
                n = 192 if code == 1 else 576 << (code - 2) if code < 6 else 256 << (code - 8)
            starts.append((at, 8 * (end + 1), n))
            expected += 1
            at = end
        else:
            at += 1
    ends = [s[0] for s in starts[1:]] + [len(data)]
    return Stream(block, bits, samples, info[18:34], [(a, e - a, bit, n) for (a, bit, n), e in zip(starts, ends, strict=True)])


def decode(files: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[Stream]]:
    """Samples of all files, their bounds, and the kind of each frame's subframe."""
    streams = [read_stream(f) for f in files]
    base, joined = 0, []
    first, size, bit, length, width = [], [], [], [], []
    for f, s in zip(files, streams, strict=True):
        for a, n, start, samples in s.frames:
            first.append(base + a)
            size.append(n)
            bit.append(8 * base + start)
            length.append(samples)
            width.append(s.sample_bits)
        base += len(f)
        joined.append(f)
    blob = b"".join(joined) + bytes(16)  # windows may reach past the end
    data = np.frombuffer(blob, np.uint8)
    first, size, length = np.array(first, np.int64), np.array(size, np.int64), np.array(length, np.int64)
    if len(first) and crc16(data, first, first + size).any():
        raise ValueError("a frame's checksum is wrong")
    n = len(first)
    kind, order, shift, wasted = (np.zeros(n, np.int64) for _ in range(4))
    coefficients = np.zeros((n, 32), np.int64)
    x = np.zeros((int(length.max()) if n else 0, n), np.int32)
    position, parts, wide = np.zeros(n, np.int64), np.ones(n, np.int64), np.zeros(n, bool)

    def take(at: int, count: int) -> int:
        a, b = at >> 3, (at + count + 7) >> 3
        return (int.from_bytes(blob[a:b], "big") >> (8 * b - at - count)) & ((1 << count) - 1)

    def signed(value: int, count: int) -> int:
        return value - (1 << count) if count and value >> (count - 1) else value

    for i in range(n):
        at, bits = bit[i], width[i]
        what = take(at, 8)
        at += 8
        if what & 1:
            while not take(at, 1):
                at += 1
                wasted[i] += 1
            at += 1
            wasted[i] += 1
            bits -= int(wasted[i])
        what = (what >> 1) & 63
        if what == 0:
            x[: length[i], i] = signed(take(at, bits), bits)
            continue
        if what == 1:
            kind[i] = VERBATIM
            if bits == 8 and not at & 7:
                x[: length[i], i] = data[at >> 3 : (at >> 3) + length[i]].view(np.int8)
            else:
                x[: length[i], i] = [signed(take(at + j * bits, bits), bits) for j in range(length[i])]
            continue
        o = what - 31 if what >= 32 else what - 8
        if not (8 <= what <= 12 or what >= 32):
            raise ValueError("a reserved subframe type")
        kind[i], order[i] = (LPC if what >= 32 else FIXED), o
        for j in range(o):
            x[j, i] = signed(take(at, bits), bits)
            at += bits
        if what >= 32:
            precision = take(at, 4) + 1
            shift[i] = signed(take(at + 4, 5), 5)
            at += 9
            for j in range(o):
                coefficients[i, j] = signed(take(at, precision), precision)
                at += precision
        method = take(at, 2)
        if method > 1:
            raise ValueError("a reserved residual method")
        wide[i], parts[i], position[i] = method == 1, 1 << take(at + 2, 4), at + 6
    rice = np.flatnonzero(kind >= FIXED)
    if len(rice):
        _residuals(data, x, rice[np.argsort(-length[rice], kind="stable")], length, order, position, parts, wide)
        _predict(x, rice, kind, order, shift, coefficients)
    x <<= wasted.astype(np.int32)
    counts = [sum(f[3] for f in s.frames) for s in streams]
    bounds = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
    lead = np.cumsum(length) - length
    inner = np.arange(int(length.sum())) - np.repeat(lead, length)
    samples = x[inner, np.repeat(np.arange(n), length)]
    for s, a, b in zip(streams, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if s.samples and s.samples != b - a:
            raise ValueError("samples are missing")
        if s.md5 != bytes(16) and hashlib.md5(samples[a:b].astype("<i2" if s.sample_bits > 8 else np.int8).tobytes()).digest() != s.md5:
            raise ValueError("the samples' MD5 is wrong")
    return samples, bounds, kind, streams


def _residuals(data, x, frames, length, order, position, parts, wide) -> None:
    """Rice codes of all frames side by side, a sample of each per step; frames by falling length."""
    word = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    low53, one = np.uint64((1 << 64) - (1 << 11)), np.uint64(1)

    def window(at: np.ndarray) -> np.ndarray:
        """The 57 bits and more from each place, at the top of 64."""
        return word[at >> 3].astype(np.uint64) << (at & 7).view(np.uint64)

    def field(at: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Up to 32 bits from each place; none give 0."""
        return ((window(at) >> one) >> (63 - count).view(np.uint64)).view(np.int64)

    pos, size, per, marks = position[frames], length[frames], length[frames] // parts[frames], np.where(wide[frames], 5, 4)
    k, turn, raw = np.zeros(len(frames), np.int64), np.zeros(len(frames), np.int64), np.zeros(len(frames), bool)
    begin = order[frames]
    low, longest = int(begin.min()), int(begin.max())
    active, next_turn, escapes = len(frames), 0, False
    for t in range(low, int(size.max())):
        while active and size[active - 1] <= t:
            active -= 1
        due = np.flatnonzero((turn[:active] <= t) & (begin[:active] <= t)) if t < longest or t >= next_turn else ()
        if len(due):
            k[due] = field(pos[due], marks[due])
            pos[due] += marks[due]
            raw[due] = k[due] == (1 << marks[due]) - 1
            plain = due[raw[due]]
            if len(plain):
                k[plain] = field(pos[plain], np.full(len(plain), 5))
                pos[plain] += 5
            turn[due] = (t // per[due] + 1) * per[due]
            next_turn = int(turn[:active].min())
            escapes = bool(raw.any())
        p = pos[:active]
        own_k = k[:active]
        bits = window(p)
        # The exponent of the float tells where the first one stands.
        zeros = 1086 - ((bits & low53).astype(np.float64).view(np.int64) >> 52)
        far = np.flatnonzero(zeros + own_k > 55)
        after = p + (zeros + 1 + own_k)
        rest = (((bits << zeros.view(np.uint64) << one) >> one) >> (63 - own_k).view(np.uint64)).view(np.int64)
        value = (zeros << own_k) | rest
        for i in far.tolist():  # long runs of zeros
            at = int(p[i])
            while not data[at >> 3] >> (7 - (at & 7)) & 1:
                at += 1
            low_bits = field(np.array([at + 1]), own_k[i : i + 1])
            value[i], after[i] = ((at - int(p[i])) << int(own_k[i])) | int(low_bits[0]), at + 1 + int(own_k[i])
        value = (value >> 1) ^ -(value & 1)
        if escapes:
            plain = np.flatnonzero(raw[:active])
            own = field(p[plain], own_k[plain])
            value[plain] = np.where(own_k[plain] > 0, own - ((own >> np.maximum(own_k[plain] - 1, 0)) << own_k[plain]), 0)
            after[plain] = p[plain] + own_k[plain]
        if t < longest:
            late = begin[:active] > t
            ready = np.flatnonzero(~late)
            x[t, frames[ready]] = value[ready]
            pos[ready] = after[ready]
        else:
            x[t, frames[:active]] = value
            pos[:active] = after


def _predict(x, frames, kind, order, shift, coefficients) -> None:
    """Samples from residuals; fixed predictors are repeated sums, others run all frames side by side."""
    for o in range(1, 5):
        own = frames[(kind[frames] == FIXED) & (order[frames] == o)]
        if len(own):
            part = x[:, own].astype(np.int64)
            starts = [np.diff(part[:o], n=j, axis=0)[0].copy() for j in range(o)]
            for j in range(o - 1, -1, -1):
                part[:j] = 0
                part[j] = starts[j]
                # differences of level j at j are those of the warm-up samples
                part[j:] = np.cumsum(part[j:], axis=0)
            x[:, own] = part
    for o in np.unique(order[frames[kind[frames] == LPC]]).tolist():
        own = frames[(kind[frames] == LPC) & (order[frames] == o)]
        part, c, s = x[:, own].astype(np.int64), np.ascontiguousarray(coefficients[own, :o].T), shift[own]
        for t in range(o, len(part)):
            guess = c[0] * part[t - 1]
            for j in range(1, o):
                guess += c[j] * part[t - 1 - j]
            part[t] += guess >> s
        x[:, own] = part


# ---------------------------------------------------------------- columns


def padded_payloads(column: pa.Array, unit: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of texts with zeros up to a positive multiple of ``unit``; bounds; sizes without zeros."""
    raw, at = flat(column)
    size = np.diff(at)
    full = np.maximum(-(-size // unit), 1) * unit
    bounds = np.concatenate(([0], np.cumsum(full)))
    out = np.zeros(int(bounds[-1]), np.uint8)
    out[np.arange(len(raw)) + np.repeat(bounds[:-1] - at[:-1], size)] = raw
    return out, bounds, size


def texts_to_flac(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the FLAC file of each text (null: empty); repeated rows stay."""

    samples = text_samples()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in slices(batch, size=1 << 20):
                payload, bounds, size = padded_payloads(own.column(1))
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(size), pa.array(encode(payload, bounds, samples), pa.binary())], names=["doc_id", "n_bytes", "flac"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, flac binary")


def pcm_blocks(files: DataFrame) -> DataFrame:
    """PCM blocks of a column ``flac``: key, block, first_sample, n_samples, sample_bits, pcm (little-endian).

    ``files`` has ``key`` and ``flac``; null files have no blocks. Damaged streams raise.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in file_slices(batch, 1):
                samples, bounds, _, streams = decode(own.column(1).to_pylist())
                sizes = [[f[3] for f in s.frames] for s in streams]
                key = np.repeat(np.arange(len(sizes)), [len(s) for s in sizes])
                n = np.array([k for s in sizes for k in s], np.int64)
                block = np.concatenate([np.arange(len(s)) for s in sizes]) if sizes else np.zeros(0, np.int64)
                lead = np.cumsum(n) - n
                bits = np.array([s.sample_bits for s in streams], np.int32)[key]
                pcm = [samples[a : a + k].astype(np.int8 if b <= 8 else "<i2").tobytes() for a, k, b in zip(lead.tolist(), n.tolist(), bits.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([own.column(0).take(pa.array(key)), pa.array(block, pa.int32()), pa.array(lead - bounds[key]), pa.array(n), pa.array(bits), pa.array(pcm, pa.binary())], names=["key", "block", "first_sample", "n_samples", "sample_bits", "pcm"])

    return files.where("flac is not null").select(F.col("key").cast("long"), "flac").mapInArrow(run, "key long, block int, first_sample long, n_samples long, sample_bits int, pcm binary")


def file_slices(batch: pa.RecordBatch, column: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute as pc

    total = np.concatenate(([0], np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))))
    row = 0
    while row < batch.num_rows:
        end = min(batch.num_rows, max(row + 1, int(np.searchsorted(total, total[row] + size, "right")) - 1))
        yield batch.slice(row, end - row)
        row = end


def text_features(files: DataFrame) -> DataFrame:
    """Digests and features of stored files of ``texts_to_flac``, from the bytes they decode to."""
    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    back = np.empty(256, np.uint8)
    back[text_samples().astype(np.int64) + 128] = np.arange(256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in file_slices(batch, 2, 3 << 20):
                data = own.column(2).to_pylist()
                samples, bounds, kind, streams = decode(data)
                raw = back[samples + 128].tobytes()
                lead = bounds[:-1]
                energy = np.add.reduceat(samples.astype(np.int64) ** 2, lead)
                peak = np.maximum.reduceat(np.abs(samples), lead)
                frames = np.cumsum([0] + [len(s.frames) for s in streams])
                rows = []
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    by = np.bincount(kind[frames[i] : frames[i + 1]], minlength=4).tolist()
                    feature = f"frames={sum(by)};constant={by[0]};verbatim={by[1]};fixed={by[2]};lpc={by[3]};peak={peak[i]};energy={energy[i] // (b - a)}"
                    rows.append((b - a, hashlib.sha256(raw[a:b]).hexdigest(), zlib.crc32(raw[b - 64 : b]), len(data[i]), hashlib.sha256(data[i]).hexdigest(), feature))
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), *(pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True))], names=[x.split()[0] for x in kinds.split(", ")])

    return files.mapInArrow(run, kinds)
