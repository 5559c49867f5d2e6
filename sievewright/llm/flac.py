"""Media columns: FLAC streams in a binary column, written and read in numpy.

Writing: 8-bit mono samples in frames of 192, each frame as the smallest of a constant, verbatim samples, a fixed predictor
of order 0 to 4 and a linear predictor of order 2, residuals Rice-coded; a stream has STREAMINFO with the samples' MD5 and
a seek table. Reading: frame headers are checked by CRC-8, frames by CRC-16; frames of that common shape are decoded many
at a time, everything else the format allows (up to 32 bits, 8 channels, stereo decorrelation, partitioned and escaped
residuals, wasted bits) sample by sample. Frames become PCM blocks, each with the offset of its first sample.

Edge cases: no samples are a stream without frames; a damaged stream raises ValueError; a null text is stored as an empty
one; equal texts give equal streams, whatever batch they are in.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, text_bytes, write_table

BLOCK = 192
#: A seek point for every so many frames.
SEEK_EVERY = 64
#: Frames that are worked on at once.
CHUNK = 4096
SAMPLE_RATE = 8000
#: Coefficients of the fixed predictors by order (fixed values of the format).
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
PRECISION, SHIFT = 6, 4


def crc_table(poly: int, bits: int) -> np.ndarray:
    out = []
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = (c << 1) ^ (poly if c >> (bits - 1) & 1 else 0)
        out.append(c & (1 << bits) - 1)
    return np.array(out, np.int64)


CRC8, CRC16 = crc_table(0x07, 8), crc_table(0x8005, 16)


def crc_rows(rows: np.ndarray, sizes: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """The CRC of the first sizes[i] bytes of each row."""
    crc, columns, mask = np.zeros(len(rows), np.int64), np.ascontiguousarray(rows.T), (1 << bits) - 1
    least = int(sizes.min()) if len(sizes) else 0
    for j in range(int(sizes.max()) if len(sizes) else 0):
        now = (table[(crc >> (bits - 8)) ^ columns[j]] ^ (crc << 8)) & mask
        crc = now if j < least else np.where(j < sizes, now, crc)
    return crc


def coded_number(n: int) -> bytes:
    """A frame number in the extended UTF-8 code."""
    if n < 128:
        return bytes([n])
    out = []
    size = 2
    while n >= 1 << (5 * size + 1):
        size += 1
    for _ in range(size - 1):
        out.append(n & 63 | 128)
        n >>= 6
    return bytes([(0xFF << (8 - size)) & 0xFF | n, *out[::-1]])


def zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def rice_choice(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best parameter of each row and the bits of its codes."""
    cost = np.stack([(u >> k).sum(1) + u.shape[1] * (1 + k) for k in range(9)])
    k = cost.argmin(0)
    return k, cost[k, np.arange(len(u))]


def put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, n: int) -> None:
    for b in range(n):
        bits[at + b] = (value >> (n - 1 - b)) & 1


def fitted(x: np.ndarray) -> np.ndarray:
    """Quantised coefficients of order 2 for each row, from exact integer correlations."""
    x = x.astype(np.int64)
    r0, r1, r2 = (x * x).sum(1), (x[:, 1:] * x[:, :-1]).sum(1), (x[:, 2:] * x[:, :-2]).sum(1)
    det = (r0 * r0 - r1 * r1).astype(np.float64)
    det[det == 0] = np.inf
    a, b = (r1 * r0 - r1 * r2) / det, (r0 * r2 - r1 * r1) / det
    most = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(np.stack([a, b], 1) * (1 << SHIFT)), -most, most).astype(np.int32)


def encode_frames(x: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of x, 192 samples each, as frames: their bytes one after the other, their sizes and kinds
    (0 constant, 1 verbatim, 2 to 6 fixed of order 0 to 4, 7 linear)."""
    n = len(x)
    x = x.astype(np.int32)
    coef = fitted(x)
    residuals, r = [x], x
    for _ in range(4):
        r = np.diff(r, axis=1)
        residuals.append(r)
    residuals.append(x[:, 2:] - ((coef[:, :1] * x[:, 1:-1] + coef[:, 1:] * x[:, :-2]) >> SHIFT))
    orders = [0, 1, 2, 3, 4, 2]
    cost, ks = np.full((8, n), 1 << 30), np.zeros((8, n), np.int64)
    cost[0, (x == x[:, :1]).all(1)] = 8
    cost[1] = 8 * BLOCK
    for i, (r, order) in enumerate(zip(residuals, orders, strict=True)):
        ks[i + 2], coded = rice_choice(zigzag(r))
        cost[i + 2] = coded + 8 * order + 10 + (9 + 2 * PRECISION) * (i == 5)
    kind = cost.argmin(0)
    body = -(-(8 + cost[kind, np.arange(n)]) // 8)
    codes = [coded_number(int(i)) for i in numbers]
    head = np.fromiter(map(len, codes), np.int64, n) + 5
    size = head + body + 2
    rows = np.zeros((n, int(head.max()) + BLOCK + 3), np.uint8)
    rows[:, :4] = (0xFF, 0xF8, 0x10, 0x02)
    for h in np.unique(head):
        g = np.flatnonzero(head == h)
        rows[g, 4 : h - 1] = np.frombuffer(b"".join(codes[i] for i in g.tolist()), np.uint8).reshape(len(g), -1)
        rows[g, h - 1] = crc_rows(rows[g, : h - 1], np.full(len(g), h - 1), CRC8, 8)
        v = g[kind[g] == 1]
        rows[v, h] = 2
        rows[v, h + 1 : h + 1 + BLOCK] = x[v] & 255
        c = g[kind[g] == 0]
        rows[c, h + 1] = x[c, 0] & 255
    for i, (r, order) in enumerate(zip(residuals, orders, strict=True)):
        g = np.flatnonzero(kind == i + 2)
        if not len(g):
            continue
        ends = np.cumsum(body[g] * 8)
        bits, at = np.zeros(int(ends[-1]), np.uint8), ends - body[g] * 8
        put(bits, at, np.full(len(g), 2 * (0b100001 if i == 5 else 0b001000 | order)), 8)
        at = at + 8
        for j in range(order):
            put(bits, at, x[g, j] & 255, 8)
            at = at + 8
        if i == 5:
            put(bits, at, np.full(len(g), (PRECISION - 1) << 5 | SHIFT), 9)
            put(bits, at + 9, coef[g, 0] & (1 << PRECISION) - 1, PRECISION)
            put(bits, at + 9 + PRECISION, coef[g, 1] & (1 << PRECISION) - 1, PRECISION)
            at = at + 9 + 2 * PRECISION
        k = ks[i + 2, g]
        put(bits, at + 6, k, 4)
        u = zigzag(r[g]).astype(np.int64)
        q = u >> k[:, None]
        length = q + 1 + k[:, None]
        one = (at + 10)[:, None] + np.cumsum(length, 1) - length + q
        bits[one] = 1
        for b in range(int(k.max())):
            some = np.broadcast_to((k > b)[:, None], u.shape)
            bits[(one + k[:, None] - b)[some]] = ((u >> b) & 1)[some]
        packed, taken = np.packbits(bits), np.cumsum(body[g]) - body[g]
        for j in range(int(body[g].max())):
            some = body[g] > j
            rows[g[some], head[g[some]] + j] = packed[taken[some] + j]
    crc = crc_rows(rows, size - 2, CRC16, 16)
    at = np.arange(n)
    rows[at, size - 2], rows[at, size - 1] = crc >> 8, crc & 255
    return rows[np.arange(rows.shape[1]) < size[:, None]], size, kind


def stream_head(n: int, sizes: np.ndarray, md5: bytes) -> bytes:
    """The magic, STREAMINFO and the seek table."""
    least, most = (int(sizes.min()), int(sizes.max())) if len(sizes) else (0, 0)
    info = struct.pack(">HH", BLOCK, BLOCK) + least.to_bytes(3, "big") + most.to_bytes(3, "big")
    info += (SAMPLE_RATE << 44 | 0 << 41 | 7 << 36 | n).to_bytes(8, "big") + md5
    at = np.cumsum(sizes) - sizes
    points = b"".join(struct.pack(">QQH", i * BLOCK, int(at[i]), BLOCK) for i in range(0, len(sizes), SEEK_EVERY))
    return b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points


def encode(payloads: list[bytes]) -> list[bytes]:
    """A stream for each payload of 8-bit samples (byte 128 is silence); lengths are multiples of 192."""
    flat = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    counts = [len(p) // BLOCK for p in payloads]
    numbers = np.concatenate([np.empty(0, np.int64), *(np.arange(c) for c in counts)])
    parts, sizes = [], []
    for i in range(0, len(flat), CHUNK):
        raw, size, _ = encode_frames((flat[i : i + CHUNK] ^ 128).view(np.int8), numbers[i : i + CHUNK])
        parts.append(raw.tobytes())
        sizes.append(size)
    data, sizes = b"".join(parts), np.concatenate([np.empty(0, np.int64), *sizes])
    out, frame, at = [], 0, 0
    for p, c in zip(payloads, counts, strict=True):
        own = sizes[frame : frame + c]
        signed = (np.frombuffer(p, np.uint8) ^ 128).tobytes()
        end = at + int(own.sum())
        out.append(stream_head(len(p), own, hashlib.md5(signed).digest()) + data[at:end])
        frame, at = frame + c, end
    return out


class Info:
    """A stream's metadata: rate, channels, bits, samples, md5, seek points (sample, byte, samples) and where frames begin."""

    def __init__(self, stream: bytes) -> None:
        if stream[:4] != b"fLaC":
            raise ValueError("no FLAC stream")
        at, last, self.seek = 4, False, []
        self.samples = None
        while not last:
            last, kind = bool(stream[at] & 128), stream[at] & 127
            size = int.from_bytes(stream[at + 1 : at + 4], "big")
            body = stream[at + 4 : at + 4 + size]
            if kind == 0:
                packed = int.from_bytes(body[10:18], "big")
                self.rate, self.channels, self.bits = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1
                self.samples, self.md5 = packed & (1 << 36) - 1, body[18:34]
                self.block = struct.unpack(">HH", body[:4])
            elif kind == 3:
                points = struct.iter_unpack(">QQH", body)
                self.seek = [p for p in points if p[0] != (1 << 64) - 1]
            at += 4 + size
        if self.samples is None:
            raise ValueError("no STREAMINFO")
        self.frames = at


class Bits:
    """Bits of a stream, the first one highest."""

    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at = data, 8 * at

    def take(self, n: int) -> int:
        if not n:
            return 0
        a, b = self.at >> 3, (self.at + n + 7) >> 3
        if b > len(self.data):
            raise ValueError("the stream ends early")
        value = int.from_bytes(self.data[a:b], "big") >> (8 * b - self.at - n)
        self.at += n
        return value & (1 << n) - 1

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value - (1 << n) if n and value >> (n - 1) else value

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def one_residual(bits: Bits, size: int, order: int) -> list[int]:
    wide = 4 + bits.take(2)
    if wide > 5:
        raise ValueError("unknown residual coding")
    partitions, out = 1 << bits.take(4), []
    for p in range(partitions):
        n = size // partitions - (order if p == 0 else 0)
        k = bits.take(wide)
        if k == (1 << wide) - 1:
            raw = bits.take(5)
            out += [bits.signed(raw) for _ in range(n)]
        else:
            for _ in range(n):
                u = bits.unary() << k | bits.take(k)
                out.append(u >> 1 ^ -(u & 1))
    return out


def one_subframe(bits: Bits, size: int, depth: int) -> list[int]:
    bits.take(1)
    kind, wasted = bits.take(6), 0
    if bits.take(1):
        wasted = bits.unary() + 1
    depth -= wasted
    if kind == 0:
        out = [bits.signed(depth)] * size
    elif kind == 1:
        out = [bits.signed(depth) for _ in range(size)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        out, shift = [bits.signed(depth) for _ in range(order)], 0
        if kind < 32:
            coef = FIXED[order]
        else:
            precision, shift = bits.take(4) + 1, bits.signed(5)
            coef = [bits.signed(precision) for _ in range(order)]
        for r in one_residual(bits, size, order):
            out.append(r + (sum(c * out[-1 - j] for j, c in enumerate(coef)) >> shift))
    else:
        raise ValueError("a reserved kind of subframe")
    return [v << wasted for v in out]


def one_frame(stream: bytes, at: int, info: Info) -> tuple[list[list[int]], int]:
    """The channels of the frame at byte `at`, checked by its CRCs, and where it ends."""
    bits = Bits(stream, at)
    if bits.take(15) != 0x7FFC:
        raise ValueError("no frame here")
    bits.take(1)
    size, rate, channels, depth = bits.take(4), bits.take(4), bits.take(4), bits.take(3)
    bits.take(1)
    first = bits.take(8)
    for _ in range(max(0, 7 - (first ^ 0xFF).bit_length()) if first >= 0xC0 else 0):
        bits.take(8)
    size = 192 if size == 1 else 576 << (size - 2) if 2 <= size <= 5 else bits.take(8) + 1 if size == 6 else bits.take(16) + 1 if size == 7 else 256 << (size - 8)
    bits.take({12: 8, 13: 16, 14: 16}.get(rate, 0))
    end = bits.at >> 3
    row = np.frombuffer(stream[at:end], np.uint8)[None]
    if int(crc_rows(row, np.array([end - at]), CRC8, 8)[0]) != bits.take(8):
        raise ValueError("a frame header's CRC is wrong")
    depth = (info.bits, 8, 12, 0, 16, 20, 24, 32)[depth]
    both = channels + 1 if channels < 8 else 2
    out = [one_subframe(bits, size, depth + (channels in (8, 10) and c == 1 or channels == 9 and c == 0)) for c in range(both)]
    if channels == 8:
        out[1] = [a - b for a, b in zip(*out, strict=True)]
    elif channels == 9:
        out[0] = [a + b for a, b in zip(*out, strict=True)]
    elif channels == 10:
        mid = [(m << 1 | s & 1, s) for m, s in zip(*out, strict=True)]
        out = [[(m + s) >> 1 for m, s in mid], [(m - s) >> 1 for m, s in mid]]
    end = (bits.at + 7) >> 3
    row = np.frombuffer(stream[at:end], np.uint8)[None]
    if int(crc_rows(row, np.array([end - at]), CRC16, 16)[0]) != int.from_bytes(stream[end : end + 2], "big"):
        raise ValueError("a frame's CRC is wrong")
    return out, end + 2


def decode_slowly(stream: bytes, info: Info) -> Iterator[list[list[int]]]:
    at, done = info.frames, 0
    while done < info.samples:
        channels, at = one_frame(stream, at, info)
        done += len(channels[0])
        yield channels


def frame_starts(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, numbers and header sizes of the headers of the common shape whose CRC-8 is right."""
    at = np.flatnonzero((raw[:-4] == 0xFF) & (raw[1:-3] == 0xF8) & (raw[2:-2] == 0x10) & (raw[3:-1] == 0x02))
    padded = np.concatenate([raw, np.zeros(16, np.uint8)])
    first = padded[at + 4].astype(np.int64)
    extra = np.select([first < 0x80, first < 0xC0, first < 0xE0, first < 0xF0, first < 0xF8, first < 0xFC, first < 0xFE], [0, 9, 1, 2, 3, 4, 5], 6)
    number = np.where(extra == 0, first, first & (0x3F >> extra))
    for j in range(1, 7):
        number = np.where((extra >= j) & (extra < 9), number << 6 | padded[at + 4 + np.minimum(j, 8)] & 63, number)
    size = np.where(extra == 9, 1, 6 + extra)
    rows = padded[at[:, None] + np.arange(12)]
    good = (extra < 9) & (crc_rows(rows, size - 1, CRC8, 8) == rows[np.arange(len(at)), size - 1])
    return at[good], number[good], size[good]


def decode_frames(raw: np.ndarray, at: np.ndarray, body: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples (rows of 192), kinds and whether each frame's CRC-16 and shape are right."""
    n, span = len(at), int((end - at).max())
    padded = np.concatenate([raw, np.zeros(span + 8, np.uint8)])
    rows = padded[at[:, None] + np.arange(span)]
    size = end - at
    good = (size >= body - at + 4) & (size <= 240)
    crc = crc_rows(rows, size - 2, CRC16, 16)
    good &= crc == (rows[np.arange(n), size - 2].astype(np.int64) << 8 | rows[np.arange(n), size - 1])
    kind = padded[body].astype(np.int64)
    x = np.zeros((n, BLOCK), np.int32)
    c = np.flatnonzero(good & (kind == 0))
    x[c] = padded[body[c] + 1].view(np.int8)[:, None]
    v = np.flatnonzero(good & (kind == 2) & (end - body == BLOCK + 3))
    x[v] = padded[body[v][:, None] + 1 + np.arange(BLOCK)].view(np.int8)
    done = np.zeros(n, bool)
    done[c] = done[v] = True
    for code in np.unique(kind[good & (kind >= 16)]):
        half = int(code) >> 1
        order, linear = (half - 31, True) if half >= 32 else (half - 8, False)
        if code & 1 or order not in range(5) or half in range(13, 32):
            continue
        g = np.flatnonzero(good & (kind == code))
        width = int((end[g] - body[g]).max()) + 8
        data = padded[np.minimum(body[g][:, None] + np.arange(width), len(padded) - 1)].astype(np.int64)
        me = np.arange(len(g))

        def field(pos: np.ndarray, k: np.ndarray | int, data=data, me=me) -> np.ndarray:
            """k bits, at most 16, from bit pos on."""
            b = pos >> 3
            word = data[me, b] << 16 | data[me, b + 1] << 8 | data[me, b + 2]
            return word >> (24 - (pos & 7) - k) & (1 << np.asarray(k)) - 1

        pos = np.full(len(g), 8)
        y = np.zeros((len(g), BLOCK), np.int64)
        for j in range(order):
            y[:, j] = field(pos, 8)
            y[:, j] -= (y[:, j] > 127) << 8
            pos += 8
        shift = np.zeros(len(g), np.int64)
        coef = np.tile(np.array(FIXED[order] if not linear else [0] * order, np.int64), (len(g), 1)).reshape(len(g), order)
        if linear:
            precision, shift = field(pos, 4) + 1, field(pos + 4, 5)
            pos += 9
            for j in range(order):
                value = field(pos, precision)
                coef[:, j] = value - ((value >> (precision - 1)) << precision)
                pos += precision
        fits = (field(pos, 6) == 0) & (shift < 16)
        k = field(pos + 6, 4)
        fits &= k < 15
        pos += 10
        bits = np.unpackbits(data.astype(np.uint8), axis=1)
        places = np.where(bits == 1, np.arange(8 * width, dtype=np.int16), np.int16(8 * width - 1))
        following = np.minimum.accumulate(places[:, ::-1], axis=1)[:, ::-1]
        limit = 8 * width - 32
        for t in range(order, BLOCK):
            one = following[me, pos].astype(np.int64)
            u = (one - pos) << k | field(np.minimum(one + 1, limit), k)
            pos = np.minimum(one + 1 + k, limit)
            guess = sum((coef[:, j] * y[:, t - 1 - j] for j in range(order)), np.zeros(len(g), np.int64)) >> shift
            y[:, t] = guess + (u >> 1 ^ -(u & 1))
        fits &= (pos + 7 >> 3) == end[g] - body[g] - 2
        x[g[fits]] = y[fits]
        done[g[fits]] = True
    return x, np.select([kind >= 64, kind >= 16], [7, (kind >> 1) - 6], kind >> 1), done


def decode(streams: list[bytes]) -> list[tuple[Info, np.ndarray, list[int]]]:
    """Info, samples (a row for each frame of 192 samples where the stream is 8-bit mono; else a row for each sample, a
    column for each channel) and frames by kind (constant, verbatim, fixed, linear)."""
    out: list = [None] * len(streams)
    fast = []
    for i, s in enumerate(streams):
        info = Info(s)
        if info.bits == 8 and info.channels == 1 and info.block == (BLOCK, BLOCK) and info.samples % BLOCK == 0:
            fast.append((i, info))
        else:
            out[i] = info, None, [0] * 4
    raw = np.frombuffer(b"".join(streams[i][info.frames :] for i, info in fast) + bytes(8), np.uint8)
    if len(fast):
        ends = np.cumsum([len(streams[i]) - info.frames for i, info in fast])
        at, number, head = frame_starts(raw)
        owner = np.searchsorted(ends, at, "right")
        bounds = np.searchsorted(owner, np.arange(len(fast) + 1), "left")
        stop = np.concatenate([at[1:], ends[-1:]]) if len(at) else at
        stop = np.minimum(stop, ends[np.minimum(owner, len(ends) - 1)])
        parts = [decode_frames(raw, at[j : j + CHUNK], (at + head)[j : j + CHUNK], stop[j : j + CHUNK]) for j in range(0, len(at), CHUNK)]
        x, kind, done = (np.concatenate([p[j] for p in parts]) for j in range(3)) if parts else (np.empty((0, BLOCK), np.int32), *[np.empty(0, np.int64)] * 2)
        for j, (i, info) in enumerate(fast):
            a, b = int(bounds[j]), int(bounds[j + 1])
            whole = b - a == info.samples // BLOCK and (number[a:b] == np.arange(b - a)).all() and done[a:b].all()
            kinds = np.bincount(np.minimum(np.maximum(kind[a:b], 0), 7), minlength=8) if whole else np.zeros(8, int)
            fixed = int(kinds[2:7].sum())
            out[i] = info, x[a:b] if whole else None, [int(kinds[0]), int(kinds[1]), fixed, int(kinds[7])]
    for i, (info, x, kinds) in enumerate(out):
        if x is None:
            frames = [np.array(f, np.int64).T for f in decode_slowly(streams[i], info)]
            x = np.concatenate([np.empty((0, info.channels), np.int64), *frames])
            x = x.reshape(-1, BLOCK) if i in {j for j, _ in fast} else x
            out[i] = info, x, kinds
        check(info, out[i][1])
    return out


def check(info: Info, x: np.ndarray) -> None:
    """The samples' MD5, where the stream has one."""
    size = (info.bits + 7) // 8
    flat = x.reshape(-1).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :size]
    if info.md5 != bytes(16) and hashlib.md5(flat.tobytes()).digest() != info.md5:
        raise ValueError("the samples' MD5 is wrong")


def read_at(stream: bytes, sample: int, n: int) -> bytes:
    """n samples of an 8-bit mono stream from `sample` on, as unsigned bytes; only frames from the seek point before it are decoded."""
    info = Info(stream)
    point = max((p for p in info.seek if p[0] <= sample), default=(0, 0, 0))
    at, now, out = info.frames + point[1], point[0], []
    while now < sample + n:
        (x,), at = one_frame(stream, at, info)
        out += [v + 128 for i, v in enumerate(x, now) if sample <= i < sample + n]
        now += len(x)
    return bytes(out)


def store_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, media: each text's UTF-8 bytes, filled up with spaces to a positive multiple of 192, as a stream.
    Written to the shared folder. A null text is empty; a long one is one stream of many frames; each row has a stream of its own, equal for
    equal texts. An empty table gives no rows. Columns beside the identifier and the text are not read, whatever their names."""

    def make():
        def step(batch: dict[str, list]) -> dict[str, list]:
            texts = [t or b"" for t in batch["text"]]
            payloads = [t + b" " * (max(1, -(-len(t) // BLOCK)) * BLOCK - len(t)) for t in texts]
            return {"key": batch["key"], "n_bytes": list(map(len, texts)), "media": encode(payloads)}

        return step

    df = text_bytes(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    out = map_rows(df, make, f"key {dict(df.dtypes)['key']}, n_bytes long, media binary")
    return write_table(out.withColumnRenamed("key", key), "flac", level=6)


def pcm_blocks(
    media: DataFrame, key: str = "doc_id", column: str = "media", samples: int = 65536, keep: tuple[str, ...] = ()
) -> DataFrame:
    """PCM blocks of every stream, one after the other: key, block, sample_offset, n_samples, channels, bits and pcm, the samples
    interleaved, little endian, 8-bit ones unsigned; total_samples and kinds (frames that are constant, verbatim, fixed and
    linear) of the whole stream; and the stream's columns named in keep. A reader finds sample s in the block whose
    sample_offset is the last one up to s. A null stream and one without samples have no blocks."""
    own = ("key", "block", "sample_offset", "n_samples", "channels", "bits", "pcm", "total_samples", "kinds")
    df = media.select(F.col(key).alias("key"), F.col(column).alias("media"), *(F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)))
    names = (*own, *(f"keep{i}" for i in range(len(keep))))

    def make():
        def step(batch: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {n: [] for n in names}
            at = [i for i, m in enumerate(batch["media"]) if m is not None]
            for i, (info, x, kinds) in zip(at, decode([batch["media"][i] for i in at]), strict=True):
                flat, size = x.reshape(-1, info.channels), (info.bits + 7) // 8
                for b, begin in enumerate(range(0, len(flat), samples)):
                    part = flat[begin : begin + samples].reshape(-1).astype("<i8") + (128 if info.bits == 8 else 0)
                    pcm = part.view(np.uint8).reshape(-1, 8)[:, :size].tobytes()
                    row = (batch["key"][i], b, begin, len(part) // info.channels, info.channels, info.bits, pcm, len(flat), kinds)
                    for n, v in zip(names, (*row, *(batch[f"keep{k}"][i] for k in range(len(keep)))), strict=True):
                        out[n].append(v)
            return out

        return step

    types = dict(df.dtypes)
    schema = f"key {types['key']}, block long, sample_offset long, n_samples long, channels int, bits int, pcm binary, total_samples long, kinds array<long>"
    schema += "".join(f", keep{i} {types[f'keep{i}']}" for i in range(len(keep)))
    return map_rows(df, make, schema).withColumnsRenamed({"key": key, **{f"keep{i}": c for i, c in enumerate(keep)}})


class Figures:
    """What the blocks of one 8-bit mono stream add up to, one block after the other."""

    def __init__(self) -> None:
        self.sha, self.n, self.tail = hashlib.sha256(), 0, b""
        self.sum = self.energy = self.peak = self.crossings = 0
        self.negative: bool | None = None

    def add(self, pcm: bytes, tail: int) -> None:
        self.sha.update(pcm)
        self.n += len(pcm)
        self.tail = (self.tail + pcm[-tail:])[-tail:]
        x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
        if len(x):
            below = x < 0
            self.crossings += int(np.count_nonzero(below[1:] != below[:-1])) + (self.negative is not None and self.negative != bool(below[0]))
            self.negative = bool(below[-1])
            self.sum += int(x.sum())
            self.energy += int((x * x).sum())
            self.peak = max(self.peak, int(np.abs(x).max()))

    def feature(self, kinds: list[int]) -> str:
        """Figures of the samples and of how the frames were coded, as whole numbers."""
        named = zip(("constant", "verbatim", "fixed", "linear"), kinds, strict=True)
        parts = [f"frames={sum(kinds)}", *(f"{n}={v}" for n, v in named), f"sum={self.sum}", f"energy={self.energy}"]
        return ";".join([*parts, f"peak={self.peak}", f"crossings={self.crossings}"])


def digests(media: DataFrame, key: str = "doc_id", tail: int = 16, samples: int = 65536) -> DataFrame:
    """key, n_bytes and what reading the stored streams back as PCM blocks gives: size and SHA-256 of payload and stream, CRC-32
    of the last samples, features, and n_blocks. The blocks of a stream follow one another, so that a task holds one of them
    and the figures so far, however long a stream is."""
    df = media.select(
        F.col(key).alias("key"), "n_bytes", "media", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256")
    )
    blocks = pcm_blocks(df, "key", samples=samples, keep=("n_bytes", "media_bytes", "media_sha256"))
    blocks = blocks.select("key", "sample_offset", "n_samples", "pcm", "total_samples", "kinds", "n_bytes", "media_bytes", "media_sha256")
    schema = f"key {dict(df.dtypes)['key']}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_blocks long"
    names = [f.split()[0] for f in schema.split(", ")]

    def make():
        now, n = Figures(), 0

        def step(batch: dict[str, list]) -> dict[str, list]:
            nonlocal now, n
            out: dict[str, list] = {c: [] for c in names}
            for i, pcm in enumerate(batch["pcm"]):
                now.add(pcm, tail)
                n += 1
                if batch["sample_offset"][i] + batch["n_samples"][i] == batch["total_samples"][i]:
                    row = (now.n, now.sha.hexdigest(), zlib.crc32(now.tail), batch["media_bytes"][i], batch["media_sha256"][i], now.feature(batch["kinds"][i]), n)
                    for c, v in zip(names, (batch["key"][i], batch["n_bytes"][i], *row), strict=True):
                        out[c].append(v)
                    now, n = Figures(), 0
            return out

        return step

    return map_rows(blocks, make, schema).withColumnRenamed("key", key)
