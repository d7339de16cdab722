"""FLAC media columns: lossless 8-bit mono streams, written and decoded for many rows at once.

The codec follows the public FLAC format (RFC 9639). All frames of a batch of
rows advance in step: sample i of every frame is one numpy operation, so the cost
per sample is a few array lookups and no Python loop runs over samples of a
single row. A stream holds STREAMINFO (with the MD5 of the samples), a SEEKTABLE
with one point per frame, and frames of ``BLOCK`` samples. The encoder picks for
each frame a constant, a fixed predictor (order 0 to 2) or a linear predictor of
order 4, and its Rice parameter; the decoder also reads verbatim subframes,
fixed orders 3 and 4, any linear order, Rice partitions, both parameter widths
and escaped partitions. CRC-8 of the header, CRC-16 of the frame and the MD5 are
verified; a stream that fails raises ``ValueError`` unless ``errors="null"``.

Bytes are stored as signed samples: byte - 128.

Nulls and edge cases: a null payload gives a null stream, a null stream no
blocks; an empty payload gives a stream of no frames; equal payloads give equal
streams. Extra columns are kept as they are. Memory is bounded by
``BATCH_BYTES`` or the longest row.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm._storage import stored

#: Samples in a frame; the last frame of a stream may be shorter.
BLOCK = 1152
SAMPLE_RATE = 8000
#: Rows are encoded and decoded together until they hold about so many bytes.
BATCH_BYTES = 2 << 20
_LPC_ORDER, _LPC_BITS = 4, 8


def _crc_table(poly: int, width: int, steps: int) -> np.ndarray:
    """The register after ``steps`` bits, for every start value of ``width`` bits."""
    x, top, mask = np.arange(1 << width, dtype=np.uint32), 1 << (width - 1), (1 << width) - 1
    for _ in range(steps):
        x = np.where(x & top, (x << 1) ^ poly, x << 1) & mask
    return x


_CRC8 = _crc_table(0x07, 8, 8)
_CRC16 = _crc_table(0x8005, 16, 8)  # one byte: T[(register >> 8 ^ byte) << 8] ^ register << 8
_CRC16_WORD = _crc_table(0x8005, 16, 16)  # two bytes at once: T[register ^ word]
_CLZ = np.array([16 - int(i).bit_length() for i in range(1 << 16)], np.int64)


def crc16(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-16 of many spans, two bytes of each span per step."""
    order = np.argsort(-sizes, kind="stable")
    at, left, crc = starts[order], sizes[order], np.zeros(len(starts), np.uint32)
    padded = np.concatenate((data, np.zeros(2, np.uint8))).astype(np.uint32)
    pairs = (padded[:-1] << 8) | padded[1:]
    for i in range(0, int(left.max(initial=0)) - 1, 2):
        n = np.searchsorted(-left, -(i + 1), side="left")  # spans with two bytes left
        crc[:n] = _CRC16_WORD[crc[:n] ^ pairs[at[:n] + i]]
    odd = np.flatnonzero(left % 2)
    last = padded[at[odd] + left[odd] - 1]
    crc[odd] = ((crc[odd] << 8) & 0xFFFF) ^ _CRC16[(((crc[odd] >> 8) ^ last) << 8) & 0xFFFF]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _crc8(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    crc = np.zeros(len(rows), np.uint32)
    for i in range(int(sizes.max(initial=0))):
        crc = np.where(i < sizes, _CRC8[crc ^ rows[:, min(i, rows.shape[1] - 1)]], crc)
    return crc


def _coded(n: int) -> bytes:
    """A frame number in FLAC's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    tail = []
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    for _ in range(size - 1):
        tail.append(0x80 | n & 0x3F)
        n >>= 6
    return bytes([(0xFF00 >> size) & 0xFF | n, *reversed(tail)])


def _linear(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantised linear predictors of each row: coefficients, shift and residual (int32)."""
    f = x.astype(np.float64)
    n = x.shape[1]
    r = np.stack([(f[:, : n - k] * f[:, k:]).sum(axis=1) for k in range(_LPC_ORDER + 1)], axis=1)
    r[:, 0] = r[:, 0] * (1 + 1e-9) + 1e-3
    a, err = np.zeros((len(x), _LPC_ORDER)), r[:, 0].copy()
    for i in range(_LPC_ORDER):  # Levinson and Durbin's recursion, a row per frame
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1][:, :i]).sum(axis=1)) / err
        a[:, :i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        err = np.maximum(err * (1 - k * k), 1e-6)
    top = np.maximum(np.abs(a).max(axis=1), 1e-9)
    shift = np.clip(_LPC_BITS - 1 - np.ceil(np.log2(top) + 1e-9), 0, 15).astype(np.int32)
    limit = 1 << (_LPC_BITS - 1)
    c = np.clip(np.round(a * np.exp2(shift)[:, None]), -limit, limit - 1).astype(np.int32)
    guess = np.zeros_like(x)
    for j in range(_LPC_ORDER):
        guess[:, _LPC_ORDER:] += c[:, j : j + 1] * x[:, _LPC_ORDER - 1 - j : n - 1 - j]
    return c, shift, x - (guess >> shift[:, None])


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload."""
    sizes = np.array([len(p) for p in payloads], np.int64)
    frames_of = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(payloads)), frames_of)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(frames_of) - frames_of, frames_of)
    length = np.minimum(BLOCK, sizes[owner] - number * BLOCK)
    bodies, byte_sizes = _frames(payloads, owner, number, length) if len(owner) else (b"", np.empty(0, np.int64))
    cuts = np.concatenate(([0], np.cumsum(byte_sizes)))
    out, k = [], 0
    for p, n in zip(payloads, frames_of.tolist(), strict=True):
        mine = byte_sizes[k : k + n]
        info = struct.pack(">HH", max(16, min(BLOCK, len(p))), max(16, BLOCK if n > 1 else len(p)))
        info += int(mine.min(initial=0) if n else 0).to_bytes(3, "big") + int(mine.max(initial=0)).to_bytes(3, "big")
        info += ((SAMPLE_RATE << 44) | (0 << 41) | (7 << 36) | len(p)).to_bytes(8, "big")
        info += hashlib.md5((np.frombuffer(p, np.uint8) ^ 0x80).tobytes()).digest()
        points = b"".join(struct.pack(">QQH", i * BLOCK, int(cuts[k + i] - cuts[k]), int(length[k + i])) for i in range(n))
        out.append(b"fLaC\0" + (34).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points + bodies[cuts[k] : cuts[k + n]])
        k += n
    return out


def _frames(payloads: list[bytes], owner: np.ndarray, number: np.ndarray, length: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All frames one after the other, and the bytes of each."""
    count = len(owner)
    raw = np.frombuffer(b"".join(payloads), np.uint8)
    begin = np.concatenate(([0], np.cumsum(length)))[:-1]
    inside = np.arange(BLOCK) < length[:, None]
    x = np.zeros((count, BLOCK), np.int32)
    x[inside] = raw.astype(np.int32) - 128
    # Residuals by predictor; the first samples of an order stay as they are (warm-up).
    fixed1, fixed2 = x.copy(), x.copy()
    fixed1[:, 1:] -= x[:, :-1]
    fixed2[:, 2:] -= 2 * x[:, 1:-1] - x[:, :-2]
    c, shift, linear = _linear(np.where(inside, x, 0))
    best, kind, rice = None, None, None
    for order, res in ((0, x), (1, fixed1), (2, fixed2), (32 + _LPC_ORDER - 1, linear)):
        u = (res << 1) ^ (res >> 31)
        used = inside.copy()
        skip = order if order < 8 else _LPC_ORDER
        used[:, :skip] = False
        u = np.where(used, u, 0)
        n = np.maximum(length - skip, 1)
        near = np.clip(np.floor(np.log2(np.maximum(u.sum(axis=1) / n, 1))), 0, 13).astype(np.int64)
        extra = skip * 8 + (9 + _LPC_ORDER * _LPC_BITS if order >= 8 else 0)
        for k in (np.maximum(near - 1, 0), near):
            bits = (u >> k[:, None]).sum(axis=1) + n * (k + 1) + extra
            if order >= 8 or skip:
                bits = np.where(length > 8, bits, 1 << 40)
            if best is None:
                best, kind, rice, codes = bits, np.full(count, order), k, u
            else:
                better = bits < best
                best, kind, rice = np.where(better, bits, best), np.where(better, order, kind), np.where(better, k, rice)
                codes = np.where(better[:, None], u, codes) if better.any() else codes
    same = (np.where(inside, x, x[:, :1]) == x[:, :1]).all(axis=1)
    kind = np.where(same, -1, kind)  # a constant subframe
    skip = np.select([kind < 0, kind >= 8], [0, _LPC_ORDER], kind)
    # Headers
    numbers = [_coded(i) for i in range(int(number.max()) + 1)]
    wide = np.zeros((len(numbers), 7), np.uint8)
    for i, b in enumerate(numbers):
        wide[i, : len(b)] = list(b)
    long = np.array([len(b) for b in numbers])[number]
    head = np.zeros((count, 14), np.uint8)
    full = length == BLOCK
    head[:, :4] = [0xFF, 0xF8, 0, 0x02]
    head[:, 2] = np.where(full, 3 << 4, 7 << 4)
    head[:, 4:11] = wide[number]
    rows = np.arange(count)
    short = ~full
    head[rows[short], 4 + long[short]] = (length[short] - 1) >> 8
    head[rows[short], 5 + long[short]] = (length[short] - 1) & 255
    head_size = 4 + long + 2 * short
    head[rows, head_size] = _crc8(head, head_size)
    head_size = head_size + 1
    # Bits of the subframe
    coded = (kind >= 0)[:, None] & inside & (np.arange(BLOCK) >= skip[:, None])
    need = np.where(coded, (codes >> rice[:, None]) + 1 + rice[:, None], 0)
    lpc = kind >= 8
    lead = np.where(kind < 0, 16, 8 + skip * 8 + np.where(lpc, 9 + _LPC_ORDER * _LPC_BITS, 0) + 10)
    size = head_size + -(-(lead + need.sum(axis=1)) // 8) + 2
    start = np.concatenate(([0], np.cumsum(size)))[:-1]
    bits = np.zeros(int(size.sum()) * 8, np.uint8)

    def put(at: np.ndarray, value: np.ndarray, width: int) -> None:
        for b in range(width):
            bits[at + b] = (value >> (width - 1 - b)) & 1

    for i in range(int(head_size.max())):
        own = i < head_size
        put((start[own] + i) * 8, head[own, i].astype(np.int64), 8)
    at = (start + head_size) * 8
    put(at, np.select([kind < 0, lpc], [0, kind], kind + 8) << 1, 8)
    at = at + 8
    put(at[same], x[same, 0].astype(np.int64) & 255, 8)
    for i in range(_LPC_ORDER):
        own = (kind >= 0) & (i < skip)
        put(at[own] + 8 * i, x[own, i].astype(np.int64) & 255, 8)
    at = at + 8 * skip
    put(at[lpc], np.full(int(lpc.sum()), _LPC_BITS - 1), 4)
    put(at[lpc] + 4, shift[lpc].astype(np.int64), 5)
    for j in range(_LPC_ORDER):
        put(at[lpc] + 9 + j * _LPC_BITS, c[lpc, j].astype(np.int64) & ((1 << _LPC_BITS) - 1), _LPC_BITS)
    at = np.where(lpc, at + 9 + _LPC_ORDER * _LPC_BITS, at)
    own = kind >= 0
    put(at[own] + 6, rice[own], 4)  # method 0, partition order 0, then the parameter
    place = (at + 10)[:, None] + np.cumsum(need, axis=1) - need
    place, value, k = place[coded], codes[coded].astype(np.int64), np.broadcast_to(rice[:, None], coded.shape)[coded]
    stop = place + (value >> k)
    bits[stop] = 1
    for b in range(int(k.max(initial=0))):
        low = k > b  # the bit of weight 2^b stands k - b behind the stop bit
        bits[(stop + k - b)[low]] = ((value >> b) & 1)[low]
    data = np.packbits(bits)
    crc = crc16(data, start, size - 2)
    data[start + size - 2], data[start + size - 1] = crc >> 8, crc & 255
    return data.tobytes(), size


class _Reader:
    """Bits of many places of one buffer at once."""

    def __init__(self, data: np.ndarray):
        wide = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
        self.word = (wide[:-7] << 32) | (wide[1:-6] << 24) | (wide[2:-5] << 16) | (wide[3:-4] << 8) | wide[4:-3]  # 40 bits
        self.end = len(data)

    def bits(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        """Up to 32 bits, unsigned."""
        at = np.minimum(at, self.end * 8)
        left = (self.word[at >> 3] << (at & 7).astype(np.uint64)) & np.uint64(0xFFFFFFFFFF)
        return (left >> (np.uint64(40) - np.asarray(width).astype(np.uint64))).astype(np.int64)


def _signed(x: np.ndarray, width: np.ndarray | int) -> np.ndarray:
    return np.where(x >> (width - 1) & 1, x - (1 << np.asarray(width)), x)


def decode_frames(data: np.ndarray, at: np.ndarray, depth: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Decodes the mono frames that start at the bytes ``at``, all in step.

    Returns the samples (a row per frame), their count, the frame's number, the
    byte after the frame, and whether both checksums and the layout were right.
    """
    read = _Reader(data)
    f = at * 8
    good = read.bits(f, 15) == 0x7FFC
    size_code, rate_code = read.bits(f + 16, 4), read.bits(f + 20, 4)
    good &= (read.bits(f + 24, 4) == 0) & np.isin(read.bits(f + 28, 3), [0, 1])
    lead = read.bits(f + 32, 8)
    long = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [1, 2, 3, 4, 5, 6], 7)
    number = np.where(long == 1, lead, lead & ((1 << np.maximum(7 - long, 0)) - 1))
    for i in range(1, int(long.max(initial=1))):
        number = np.where(i < long, number << 6 | (read.bits(f + 32 + 8 * i, 8) & 0x3F), number)
    p = f + 32 + 8 * long
    n = np.select([size_code == 1, (size_code >= 2) & (size_code <= 5), size_code == 6, size_code == 7, size_code >= 8], [np.int64(192), 576 << np.maximum(size_code - 2, 0), read.bits(p, 8) + 1, read.bits(p, 16) + 1, 256 << np.maximum(size_code - 8, 0)], 0)
    p = p + np.select([size_code == 6, size_code == 7], [8, 16], 0)
    p = p + np.select([rate_code == 12, (rate_code == 13) | (rate_code == 14)], [8, 16], 0)
    head_size = (p >> 3) - at
    rows = data[np.minimum(at[:, None] + np.arange(16), max(len(data) - 1, 0))]
    good &= (n > 0) & (_crc8(rows, head_size) == read.bits(p, 8))
    p = p + 8
    kind = read.bits(p + 1, 6)
    good &= (read.bits(p, 1) == 0) & (read.bits(p + 7, 1) == 0)
    p = p + 8
    good &= (kind <= 1) | ((kind >= 8) & (kind <= 12)) | (kind >= 32)
    n = np.where(good, n, 0)
    kind = np.where(good, kind, 0)
    order = np.select([kind >= 32, kind >= 8], [kind - 31, kind - 8], 0)
    width = int(n.max(initial=0))
    x = np.zeros((len(at), width), np.int64)
    flat = good & (kind == 0)
    x[flat] = _signed(read.bits(p[flat], depth), depth)[:, None]
    p = np.where(flat, p + depth, p)
    plain = np.flatnonzero(good & (kind == 1))
    for i in range(int(n[plain].max(initial=0))):
        own = plain[i < n[plain]]
        x[own, i] = _signed(read.bits(p[own] + depth * i, depth), depth)
    p[plain] += depth * n[plain]
    for i in range(int(order.max(initial=0))):
        own = np.flatnonzero(i < order)
        x[own, i] = _signed(read.bits(p[own], depth), depth)
        p[own] += depth
    lpc = np.flatnonzero(kind >= 32)
    precision, shift = read.bits(p[lpc], 4) + 1, _signed(read.bits(p[lpc] + 4, 5), 5)
    p[lpc] += 9
    c = np.zeros((len(lpc), int(order[lpc].max(initial=0))), np.int64)
    for j in range(c.shape[1]):
        own = j < order[lpc]
        c[own, j] = _signed(read.bits(p[lpc[own]], precision[own]), precision[own])
        p[lpc[own]] += precision[own]
    p = _residuals(read, x, p, n, order, np.flatnonzero(good & (kind >= 8)), good)
    # Predictors: fixed ones are repeated sums, linear ones go sample by sample over all frames.
    for k in range(1, 5):
        own = np.flatnonzero(kind == 8 + k)
        if len(own):
            x[own] = _undo_fixed(x[own], k)
    for k in np.unique(order[lpc]).tolist():
        own = order[lpc] == k
        y, w, s = x[lpc[own]].T.copy(), c[own, :k].T.copy(), shift[own]
        for i in range(k, width):
            y[i] += (w * y[i - 1 :: -1][:k] if i >= k else 0).sum(axis=0) >> s
        x[lpc[own]] = y.T
    x[np.arange(width) >= n[:, None]] = 0
    end = (p + 7) >> 3
    good &= end + 2 <= len(data)
    sizes = np.where(good, end - at, 0)
    crc = crc16(data, at, sizes)
    good &= crc == read.bits(np.minimum(end, len(data)) * 8, 16)
    return x, n, number, end + 2, good


def _undo_fixed(x: np.ndarray, k: int) -> np.ndarray:
    """Samples from a fixed predictor's residual: each order is one more running sum."""
    warm = x[:, :k].copy()
    firsts = [warm[:, 0]]
    d = warm
    for _ in range(k - 1):
        d = np.diff(d, axis=1)
        firsts.append(d[:, 0])
    y = x[:, k:]  # differences of order k
    # Values of each difference order just before the coded part.
    tail, lasts = warm, []
    for _ in range(k):
        lasts.append(tail[:, -1])
        tail = np.diff(tail, axis=1)
    for level in reversed(range(k)):
        y = np.cumsum(y, axis=1) + lasts[level][:, None]
    return np.concatenate((warm, y), axis=1)


def _residuals(read: _Reader, x: np.ndarray, p: np.ndarray, n: np.ndarray, order: np.ndarray, own: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Reads Rice codes into x, one sample of every frame at a time; returns where each frame's bits end."""
    if not len(own):
        return p
    method, parts = read.bits(p[own], 2), read.bits(p[own] + 2, 4)
    p = p.copy()
    good[own[method > 1]] = False
    own, method, parts = own[method <= 1], method[method <= 1], parts[method <= 1]
    sort = np.argsort(-n[own], kind="stable")
    own, method, parts = own[sort], method[sort], parts[sort]
    at, count, first = p[own] + 6, n[own], order[own]
    step, bound = count >> parts, np.zeros(len(own), np.int64)
    rice, raw = np.zeros(len(own), np.int64), np.full(len(own), -1)
    y = np.zeros((int(count.max(initial=0)), len(own)), np.int64)
    width = 4 + method
    simple = bool((parts == 0).all() and (first == first[:1]).all())
    word = read.word
    for i in range(len(y)):
        live = int(np.searchsorted(-count, -i, side="left"))  # frames with a sample i
        if i == 0 or not simple:
            opens = np.flatnonzero(bound[:live] == i)
            if len(opens):
                got = read.bits(at[opens], width[opens])
                at[opens] += width[opens]
                escape = got == (1 << width[opens]) - 1
                raw[opens] = np.where(escape, read.bits(at[opens], 5), -1)
                at[opens] += 5 * escape
                rice[opens] = np.where(escape, 0, got)
                bound[opens] += step[opens]
        if simple and i < first[0]:
            continue
        a, k = at[:live], rice[:live]
        a = np.minimum(a, (read.end - 1) * 8)
        q = _CLZ[(word[a >> 3] << (a & 7).astype(np.uint64) >> np.uint64(24) & np.uint64(0xFFFF)).astype(np.int64)]
        far = np.flatnonzero(q == 16)
        while len(far):  # a long run of zeros
            more = _CLZ[read.bits(a[far] + q[far], 16)]
            q[far] += more
            far = far[(more == 16) & (a[far] + q[far] < read.end * 8)]
        b = a + q + 1
        low = (word[np.minimum(b >> 3, read.end)] << (b & 7).astype(np.uint64) & np.uint64(0xFFFFFFFFFF)) >> (np.uint64(40) - k.astype(np.uint64))
        u = q << k | low.astype(np.int64)
        value, to = (u >> 1) ^ -(u & 1), b + k
        if not simple:
            flat = raw[:live] >= 0
            if flat.any():
                bits = read.bits(a, raw[:live] * flat)
                value = np.where(flat, np.where(raw[:live] > 0, _signed(bits, np.maximum(raw[:live], 1)), 0), value)
                to = np.where(flat, a + raw[:live], to)
            skip = i < first[:live]
            value, to = np.where(skip, 0, value), np.where(skip, a, to)
        y[i, :live], at[:live] = value, to
    top = int(first.max(initial=0))
    warm = x[own, :top].copy()
    x[own, : len(y)] = y.T
    keep = np.arange(top) < first[:, None]
    x[own, :top] = np.where(keep, warm, x[own, :top])
    p[own] = at
    return p


def _head(stream: bytes) -> tuple[int, int, bytes, list[int] | None]:
    """Where the frames begin, the samples, the MD5, and each frame's offset if a seek table names them all."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, samples, md5, points = 4, False, 0, b"", None
    while not last:
        last, kind, size = bool(stream[at] & 128), stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            samples, md5 = packed & ((1 << 36) - 1), body[18:34]
            if (packed >> 41) & 7 or (packed >> 36) & 31 != 7:
                raise ValueError("only 8-bit mono is stored here")
        elif kind == 3:
            table = np.frombuffer(body, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
            table = table[table["sample"] != (1 << 64) - 1]
            if int(table["n"].astype(np.int64).sum()) == samples:
                points = table["offset"].astype(np.int64).tolist()
        at += 4 + size
    return at, samples, md5, points


def decode(streams: list[bytes]) -> list[list[np.ndarray]]:
    """The blocks of samples of each stream, as unsigned bytes. Frames are found by the seek table, else one after the other."""
    data = np.frombuffer(b"".join(streams), np.uint8)
    base = np.concatenate(([0], np.cumsum([len(s) for s in streams]))).astype(np.int64)
    heads = [_head(s) for s in streams]
    blocks: list[list[np.ndarray]] = [[] for _ in streams]
    done = [0] * len(streams)
    todo = {i: base[i] + h[0] for i, h in enumerate(heads) if h[1]}
    while todo:
        who, at = [], []
        for i, place in todo.items():
            points = heads[i][3]
            who += [i] * len(points) if points else [i]
            at += [place + o for o in points] if points else [place]
        x, n, number, end, good = decode_frames(data, np.array(at, np.int64))
        for j, i in enumerate(who):
            if not good[j] or number[j] != len(blocks[i]):
                raise ValueError("a frame's checksum, layout or number is wrong")
            blocks[i].append((x[j, : n[j]] + 128).astype(np.uint8))
            done[i] += int(n[j])
            todo[i] = end[j]
        todo = {i: p for i, p in todo.items() if done[i] < heads[i][1]}
    for i, h in enumerate(heads):
        whole = np.concatenate(blocks[i]) if blocks[i] else np.empty(0, np.uint8)
        if done[i] != h[1] or hashlib.md5((whole ^ 0x80).tobytes()).digest() != h[2]:
            raise ValueError("the samples' MD5 is wrong")
    return blocks


def _groups(sizes: list[int], limit: int = BATCH_BYTES) -> Iterator[slice]:
    at, total = 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total >= limit:
            yield slice(at, i + 1)
            at, total = i + 1, 0
    if at < len(sizes):
        yield slice(at, len(sizes))


def encode_media(df: DataFrame, payload: str = "payload", media: str = "media") -> DataFrame:
    """Replaces a binary column by its FLAC stream."""
    schema = T.StructType([*[f for f in df.schema.fields if f.name not in (payload, media)], T.StructField(media, T.BinaryType())])
    names = schema.fieldNames()[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(payload)).to_pylist()
            for part in _groups([len(v or b"") for v in values]):
                some = [v for v in values[part] if v is not None]
                made = iter(encode(some))
                rows = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([*[rows.column(rows.schema.get_field_index(x)) for x in names], pa.array([None if v is None else next(made) for v in values[part]], pa.binary())], [*names, media])

    return df.select(*names, payload).mapInArrow(run, schema)


def pcm_blocks(df: DataFrame, key: str, media: str = "media") -> DataFrame:
    """One row per block of a stream: key, block, first_sample (where to seek to), n_samples, pcm (unsigned bytes)."""
    schema = T.StructType([df.schema[key], T.StructField("block", T.LongType()), T.StructField("first_sample", T.LongType()), T.StructField("n_samples", T.LongType()), T.StructField("pcm", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, streams = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in _groups([len(v or b"") for v in streams]):
                have = [(k, v) for k, v in zip(keys[part], streams[part], strict=True) if v is not None]
                rows = [(k, i, b) for (k, _), blocks in zip(have, decode([v for _, v in have]), strict=True) for i, b in enumerate(blocks)]
                yield pa.RecordBatch.from_pydict({key: [r[0] for r in rows], "block": [r[1] for r in rows], "first_sample": [r[1] * BLOCK for r in rows], "n_samples": [len(r[2]) for r in rows], "pcm": [r[2].tobytes() for r in rows]}, schema=pa.schema([batch.schema.field(0).with_name(key), ("block", pa.int64()), ("first_sample", pa.int64()), ("n_samples", pa.int64()), ("pcm", pa.binary())]))

    return df.select(key, media).mapInArrow(run, schema)


def features(pcm: np.ndarray) -> str:
    """Whole-number features of a stream's samples (unsigned bytes)."""
    x = pcm.astype(np.int64) - 128
    turns = int(np.count_nonzero(np.diff(np.signbit(x)))) if len(x) else 0
    return f"n={len(x)};min={int(x.min(initial=127))};max={int(x.max(initial=-128))};sum={int(x.sum())};energy={int((x * x).sum())};turns={turns}"


MEDIA_FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(df: DataFrame, media: str = "media", tail: int = 16) -> DataFrame:
    """Reads the streams back and replaces them by digests and features of their samples; columns of those names are replaced too."""
    names = [c for c in df.columns if c != media and c not in [x.split()[0] for x in MEDIA_FEATURES.split(", ")]]
    schema = T.StructType([*[df.schema[c] for c in names], *T.StructType.fromDDL(MEDIA_FEATURES).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams = batch.column(batch.schema.get_field_index(media)).to_pylist()
            for part in _groups([len(v or b"") for v in streams]):
                some = [v for v in streams[part] if v is not None]
                made = []
                for stream, blocks in zip(some, decode(some), strict=True):
                    pcm = np.concatenate(blocks) if blocks else np.empty(0, np.uint8)
                    raw = pcm.tobytes()
                    made.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-tail:]), len(stream), hashlib.sha256(stream).hexdigest(), features(pcm)))
                it = iter(made)
                got = [(None,) * 6 if v is None else next(it) for v in streams[part]]
                rows = batch.slice(part.start, part.stop - part.start)
                types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([*[rows.column(rows.schema.get_field_index(c)) for c in names], *[pa.array([g[i] for g in got], t) for i, t in enumerate(types)]], [*names, *[x.split()[0] for x in MEDIA_FEATURES.split(", ")]])

    return df.select(*names, media).mapInArrow(run, schema)


def padded_payload(text: F.Column, unit: int = 192) -> F.Column:
    """UTF-8 bytes of a text (null: empty), filled up with spaces to a positive multiple of ``unit``."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    n = F.octet_length(raw)
    target = F.greatest(F.lit(1), F.ceil(n / F.lit(unit))) * unit
    return F.concat(raw, F.repeat(F.lit(" "), (target - n).cast("int")).cast("binary"))


def op9_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as a FLAC stream, written, read back and decoded."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    media = stored(encode_media(docs.select("doc_id", n_bytes, padded_payload(F.col("text")).alias("payload"))), "media")
    return media_features(media)
