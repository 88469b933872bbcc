"""A FLAC codec in numpy that works on many frames at once.

Frames are rows: every step of a decoder (one residual, one predicted sample, one checksum byte) is done for all frames
of a chunk together. Sound is mono, 8 or 16 bits a sample; all subframe kinds (constant, verbatim, fixed and linear
prediction), wasted bits, Rice partitions with 4- and 5-bit parameters and escaped partitions are read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Sequence

import numpy as np

BLOCK = 192
SEEK_FRAMES = 64
RATE = 8000
MARKER = b"fLaC"
#: fourth header byte of one channel with samples as the file states, of 8 bits and of 16 bits
_LAYOUTS = (0x00, 0x02, 0x08)
_FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for byte in range(256):
        c = byte << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, np.uint16)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_WORD = np.arange(1 << 16).astype(np.uint16)
_CRC16_WORD = _CRC16[(_CRC16[_WORD >> 8] >> 8) ^ (_WORD & 0xFF)] ^ (_CRC16[_WORD >> 8] << 8)
_TOP_ZEROS = np.full(1 << 16, 16, np.int64)
for _bit in range(16):
    _TOP_ZEROS[1 << _bit : 2 << _bit] = 15 - _bit


class BadFlac(ValueError):
    """A stream that fails a check; the message names the check."""


def checksum(buf: np.ndarray, start: np.ndarray, length: np.ndarray, wide: bool) -> np.ndarray:
    """CRC-16 (wide) or CRC-8 of the byte ranges, one a row."""
    order = np.argsort(-length, kind="stable")
    at, left = start[order], length[order]
    crc = np.zeros(len(at), np.uint16)
    # rows that still have a j-th byte are a prefix, as they are sorted by length
    most = int(left[0]) if len(left) else 0
    counts = np.searchsorted(-left, -np.arange(most + 1), side="left")
    if wide:  # two bytes at a time
        words = np.ndarray((max(0, len(buf) - 1),), ">u2", np.ascontiguousarray(buf), strides=(1,))
        for j in range(0, most, 2):
            n, odd = counts[j + 1], counts[j]
            crc[:n] = _CRC16_WORD[crc[:n] ^ words[at[:n] + j]]
            if odd > n:
                crc[n:odd] = _CRC16[(crc[n:odd] >> 8) ^ buf[at[n:odd] + j]] ^ (crc[n:odd] << 8)
    else:
        for j, n in enumerate(counts[:most]):
            crc[:n] = _CRC8[crc[:n] ^ buf[at[:n] + j]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


class _Writer:
    """Collects numbers of up to 32 bits at bit positions of their own, and writes them all at once."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def put(self, at: np.ndarray, value: np.ndarray | int, n: np.ndarray | int) -> None:
        value = np.broadcast_to(np.asarray(value, np.int64), at.shape).ravel()
        self.parts.append((at.ravel(), value, np.broadcast_to(np.asarray(n, np.int64), at.shape).ravel()))

    def to_bytes(self, size: int) -> np.ndarray:
        at, value, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        last = at + n - 1
        shifted = value << (31 - (last & 31))
        word, low, high = last >> 5, shifted & 0xFFFFFFFF, shifted >> 32
        # numbers never share a bit, so sums are unions; they stay exact below 2^53
        total = np.bincount(word, low, size // 4 + 2)
        over = np.flatnonzero(high)
        total += np.bincount(word[over] - 1, high[over], len(total))
        return total.astype(">u4").view(np.uint8)[:size].copy()


def _number_bytes(number: np.ndarray) -> np.ndarray:
    """How many bytes the coded frame numbers take."""
    return np.select([number < 1 << 7, number < 1 << 11, number < 1 << 16, number < 1 << 21, number < 1 << 26], [1, 2, 3, 4, 5], 6)


def _zigzag(x: np.ndarray) -> np.ndarray:
    return (x << 1) ^ (x >> 31)


def _rice_parameter(u: np.ndarray, count: int) -> np.ndarray:
    mean = u.sum(1, dtype=np.float32) / max(1, count)
    return np.clip(np.floor(np.log2(np.maximum(mean * 0.7, 1e-9) + 0.5)), 0, 14).astype(np.int32)


def _lpc(x: np.ndarray, order: int, shift: int, precision: int) -> np.ndarray:
    """Quantised predictor coefficients of every row (autocorrelation, Levinson-Durbin)."""
    f, n = x.astype(np.float32), x.shape[1]
    r = np.stack([np.einsum("ij,ij->i", f[:, k:], f[:, : n - k]) for k in range(order + 1)], 1).astype(np.float64)
    a, err = np.zeros((len(x), order)), r[:, 0] * (1 + 1e-6) + 1e-3
    for i in range(order):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / err
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        err *= np.maximum(1 - k * k, 1e-9)
    top = (1 << (precision - 1)) - 1
    return np.clip(np.rint(a * (1 << shift)), -top, top).astype(np.int32)


def encode_frames(x: np.ndarray, number: np.ndarray, bps: int, order: int = 4, partition_order: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Encoded frames of equally long blocks x (rows), and the bytes of each.

    A row is coded as constant, verbatim, fixed (0 or 1) or linear prediction, whichever is shortest.
    """
    rows, n = x.shape
    x = x.astype(np.int32)
    order = order if n > 4 * order else 0
    partition_order = partition_order if n % (1 << partition_order) == 0 and n >> partition_order > order else 0
    shift, precision = 6, 8
    kinds = [(0, x, 0)]  # order, residual with warm-up in place, header bits
    if n > 1:
        kinds.append((1, np.concatenate([x[:, :1], np.diff(x, axis=1)], 1), 0))
    coefficients = None
    if order:
        coefficients = _lpc(x, order, shift, precision)
        pred = np.zeros((rows, n - order), np.int32)
        for j in range(order):
            pred += coefficients[:, j : j + 1] * x[:, order - 1 - j : n - 1 - j]
        kinds.append((order, np.concatenate([x[:, :order], x[:, order:] - (pred >> shift)], 1), 9 + order * precision))
    costs, us = [], []
    for warm, res, head in kinds:
        u = _zigzag(res)
        k = _rice_parameter(u[:, warm:], n - warm)[:, None]
        costs.append((u[:, warm:] >> k).sum(1) + (n - warm) * (k[:, 0] + 1) + warm * bps + head + 10)
        us.append(u)
    kind = np.argmin(np.stack(costs), 0)
    best = np.min(np.stack(costs), 0)
    verbatim, constant = best >= n * bps, (x == x[:, :1]).all(1)
    kind = np.where(constant, 8, np.where(verbatim, 9, kind))

    nb = _number_bytes(number)
    head = 4 + nb + np.where(n == BLOCK, 0, 2) + 1
    parts, plen = 1 << partition_order, n >> partition_order
    n_bits = np.where(kind == 8, bps, n * bps)
    groups = []
    for i, (warm, _, lead) in enumerate(kinds):
        rows_i = np.flatnonzero(kind == i)
        if not len(rows_i):
            continue
        u = us[i][rows_i]
        k = np.stack([_rice_parameter(u[:, p * plen : (p + 1) * plen], plen) for p in range(parts)], 1)
        u, kk = u[:, warm:], k if parts == 1 else np.repeat(k, plen, 1)[:, warm:]
        lengths = (u >> kk) + kk + 1
        first = [max(0, p * plen - warm) for p in range(parts)]  # each partition begins with its parameter
        lengths[:, first] += 4
        ends = np.cumsum(lengths, 1, dtype=np.int64)
        n_bits[rows_i] = warm * bps + lead + 6 + ends[:, -1]
        groups.append((rows_i, warm, lead, u, k, kk, first, lengths, ends))
    total = (8 * head + 8 + n_bits + 7) // 8 + 2
    start = np.concatenate([[0], np.cumsum(total)])
    bits, at = _Writer(), start[:-1] * 8
    bits.put(at, 0xFFF8, 16)
    bits.put(at + 16, 1 if n == BLOCK else 7, 4)
    bits.put(at + 20, 4, 4)
    bits.put(at + 28, 1 if bps == 8 else 4, 3)
    for size in np.unique(nb):
        own = nb == size
        a, num = at[own] + 32, number[own]
        if size == 1:
            bits.put(a, num, 8)
        else:
            bits.put(a, ((0xFF00 >> size) & 0xFF) | (num >> (6 * (size - 1))), 8)
            for j in range(1, size):
                bits.put(a + 8 * j, 0x80 | ((num >> (6 * (size - 1 - j))) & 0x3F), 8)
    if n != BLOCK:
        bits.put(at + 32 + 8 * nb, n - 1, 16)
    sub, mask = at + 8 * head, (1 << bps) - 1
    bits.put(sub, np.select([kind == 8, kind == 9, kind == 2, kind == 1], [0, 1 << 1, (0x20 | max(0, order - 1)) << 1, 9 << 1], 8 << 1), 8)
    sub = sub + 8
    own = kind == 8
    bits.put(sub[own], x[own, 0] & mask, bps)
    own = kind == 9
    bits.put(sub[own][:, None] + bps * np.arange(n), x[own] & mask, bps)
    for rows_i, warm, lead, u, k, kk, first, lengths, ends in groups:
        rice = sub[rows_i]
        bits.put(rice[:, None] + bps * np.arange(warm), x[rows_i, :warm] & mask, bps)
        rice = rice + warm * bps
        if lead:
            bits.put(rice, precision - 1, 4)
            bits.put(rice + 4, shift, 5)
            bits.put(rice[:, None] + 9 + precision * np.arange(order), coefficients[rows_i] & ((1 << precision) - 1), precision)
            rice = rice + lead
        bits.put(rice + 2, partition_order, 4)
        begin = rice[:, None] + 6 + ends - lengths
        bits.put(begin[:, first], k, 4)
        begin[:, first] += 4
        # zeros, a one, and the low bits
        bits.put(begin + (u >> kk), (1 << kk) | (u & ((1 << kk) - 1)), kk + 1)
    out = bits.to_bytes(int(start[-1]))
    crc8 = checksum(out, start[:-1], head - 1, wide=False)
    out[start[:-1] + head - 1] = crc8
    crc16 = checksum(out, start[:-1], total - 2, wide=True)
    out[start[1:] - 2], out[start[1:] - 1] = crc16 >> 8, crc16 & 0xFF
    return out, total


def encode(payloads: Sequence[bytes], bps: int = 8, chunk_frames: int = 256, **how: int) -> list[bytes]:
    """FLAC files of mono sounds given as PCM bytes (8 bits: unsigned as in WAV; 16 bits: signed little-endian)."""
    width = bps // 8
    sounds = [np.frombuffer(p, np.uint8).astype(np.int32) - 128 if bps == 8 else np.frombuffer(p, "<i2").astype(np.int32) for p in payloads]
    full = [(i, f) for i, s in enumerate(sounds) for f in range(len(s) // BLOCK)]
    frames: list[list[bytes]] = [[b""] * -(-len(s) // BLOCK) for s in sounds]
    for at in range(0, len(full), chunk_frames):
        part = full[at : at + chunk_frames]
        x = np.stack([sounds[i][f * BLOCK : (f + 1) * BLOCK] for i, f in part])
        data, size = encode_frames(x, np.array([f for _, f in part], np.int64), bps, **how)
        data, ends = data.tobytes(), np.cumsum(size)
        for (i, f), a, b in zip(part, ends - size, ends, strict=True):
            frames[i][f] = data[a:b]
    rests: dict[int, list[int]] = {}
    for i, s in enumerate(sounds):
        if rest := len(s) % BLOCK:
            rests.setdefault(rest, []).append(i)
    for rest, ended in rests.items():
        for a in range(0, len(ended), chunk_frames):
            part = ended[a : a + chunk_frames]
            data, size = encode_frames(np.stack([sounds[i][-rest:] for i in part]), np.array([len(sounds[i]) // BLOCK for i in part], np.int64), bps, **how)
            data, ends = data.tobytes(), np.cumsum(size)
            for i, a0, b0 in zip(part, ends - size, ends, strict=True):
                frames[i][-1] = data[a0:b0]
    return [_file(s, f, p, bps, width) for s, f, p in zip(sounds, frames, payloads, strict=True)]


def _file(sound: np.ndarray, frames: list[bytes], payload: bytes, bps: int, width: int) -> bytes:
    sizes = [len(f) for f in frames] or [0]
    signed = payload if width == 2 else (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
    info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += ((RATE << 44) | ((bps - 1) << 36) | len(sound)).to_bytes(8, "big") + hashlib.md5(signed).digest()
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    points = b"".join(struct.pack(">QQH", f * BLOCK, int(offsets[f]), min(BLOCK, len(sound) - f * BLOCK)) for f in range(0, len(frames), SEEK_FRAMES))
    return b"".join([MARKER, b"\0", len(info).to_bytes(3, "big"), info, b"\x83", len(points).to_bytes(3, "big"), points, *frames])


class _Bits:
    """Reads bits at a position of its own in every row; past the end, bits without a meaning."""

    def __init__(self, buf: np.ndarray, at: np.ndarray) -> None:
        self.view = np.ndarray((len(buf) - 7,), ">u8", buf.tobytes(), strides=(1,))
        self.at = at

    def window(self, own: np.ndarray | slice = slice(None)) -> np.ndarray:
        at = self.at[own]
        return self.view[np.minimum(at >> 3, len(self.view) - 1)].astype(np.uint64) << (at & 7).astype(np.uint64)

    def take(self, n: int, own: np.ndarray | slice = slice(None), signed: bool = False) -> np.ndarray:
        v = (self.window(own) >> np.uint64(64 - n)).astype(np.int64) if n else np.zeros(len(self.at[own]), np.int64)
        self.at[own] += n
        return (v ^ (1 << (n - 1))) - (1 << (n - 1)) if signed and n else v

    def rice(self, own: np.ndarray | slice, k: np.ndarray) -> np.ndarray:
        w = self.window(own)
        q = _TOP_ZEROS[(w >> np.uint64(48)).astype(np.int64)]
        if (q == 16).any():
            rows = np.arange(len(self.at))[own]
            far = q == 16
            q[far] = [self.run(int(p)) for p in self.at[rows[far]]]
            self.at[own] += q + 1
            rest = self.window(own)
            self.at[own] += k
        else:
            rest = w << (q + 1).astype(np.uint64)
            self.at[own] += q + 1 + k
        low = (rest >> np.uint64(1) >> (63 - k).astype(np.uint64)).view(np.int64)
        u = (q << k) | low
        return (u >> 1) ^ -(u & 1)

    def run(self, at: int) -> int:
        """Zeros before the next one, or before the end of the data."""
        n = 0
        while True:
            if (at >> 3) >= len(self.view):
                return n
            w = (int(self.view[at >> 3]) << (at & 7)) & ((1 << 64) - 1)
            left = 64 - (at & 7)
            if w:
                return n + 64 - w.bit_length()
            n, at = n + left, at + left


#: what may be wrong with a frame, by its number in ``decode_frames``
PROBLEMS = ("", "unknown subframe", "no bits left beside wasted bits", "reserved predictor precision", "negative predictor shift", "unknown residual coding", "uneven partitions", "the data end inside a frame")
_UNKNOWN, _WASTED, _PRECISION, _SHIFT, _CODING, _UNEVEN, _ENDS = range(1, 8)


def decode_frames(buf: np.ndarray, start: np.ndarray, size: np.ndarray, head: np.ndarray, bps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples (rows of ``size``, all equal), the end byte and the problem (0: none) of frames whose subframe begins ``head`` bytes in.

    Rows don't disturb each other: bytes that only look like a frame give a problem, or samples that nobody asks for.
    """
    n, rows = int(size[0]), len(start)
    bits = _Bits(buf, (start + head) * 8)
    flag = bits.take(8)
    kind, wasted = (flag >> 1) & 0x3F, np.zeros(rows, np.int64)
    for i in np.flatnonzero(flag & 1):
        wasted[i] = bits.run(int(bits.at[i])) + 1
        bits.at[i] += wasted[i]
    order = np.select([(kind >= 8) & (kind <= 12), kind >= 32], [kind - 8, kind - 31], 0)
    problem = np.zeros(rows, np.int8)
    problem[(flag > 127) | ~np.isin(kind, [0, 1, *range(8, 13), *range(32, 64)]) | (order > n)] = _UNKNOWN
    problem[(problem == 0) & (wasted >= bps)] = _WASTED
    s = np.zeros((n, rows), np.int32 if bps == 8 else np.int64)  # predictions of 8-bit samples fit 32 bits
    for w in np.unique(wasted[problem == 0]):
        mine, width = (problem == 0) & (wasted == w), bps - int(w)
        if (own := mine & (kind == 0)).any():
            s[:, own] = bits.take(width, own, signed=True)
        if (own := mine & (kind == 1)).any():
            for i in range(n):
                s[i, own] = bits.take(width, own, signed=True)
        coded = np.flatnonzero(mine & (kind >= 8))
        if len(coded):
            _predicted(bits, coded, kind[coded], order[coded], width, s, problem)
        if w:
            s[:, mine] <<= w
    end = (bits.at + 7) >> 3
    problem[(problem == 0) & (end + 2 > len(buf))] = _ENDS
    return s.T, end, problem


def _predicted(bits: _Bits, coded: np.ndarray, kind: np.ndarray, order: np.ndarray, bps: int, s: np.ndarray, problem: np.ndarray) -> None:
    """Reads the predicted subframes of the rows ``coded`` into ``s``; rows that can't be read get a problem instead."""
    most, n = int(order.max()), len(s)
    out = np.zeros((n, len(coded)), s.dtype)
    for i in range(most):
        own = order > i
        out[i, own] = bits.take(bps, coded[own], signed=True)
    shift, coef = np.zeros(len(coded), out.dtype), np.zeros((most, len(coded)), out.dtype)
    for o in range(1, 5):
        if (own := kind == 8 + o).any():
            coef[:o, own] = np.array(_FIXED[o])[:, None]
    lpc = np.flatnonzero(kind >= 32)
    if len(lpc):
        precision = bits.take(4, coded[lpc]) + 1
        shift[lpc] = bits.take(5, coded[lpc], signed=True)
        problem[coded[lpc[shift[lpc] < 0]]] = _SHIFT
        problem[coded[lpc[precision == 16]]] = _PRECISION
        for p in np.unique(precision):
            own = lpc[precision == p]
            for j in range(int(order[own].max())):
                some = own[order[own] > j]
                coef[j, some] = bits.take(int(p), coded[some], signed=True)
    method, partition_order = bits.take(2, coded), bits.take(4, coded)
    problem[coded[method > 1]] = _CODING
    problem[coded[(n % (1 << partition_order) != 0) | ((partition_order > 0) & (n >> partition_order < order))]] = _UNEVEN
    good = problem[coded] == 0
    if not good.all():
        coded, order, shift, method, partition_order = coded[good], order[good], shift[good], method[good], partition_order[good]
        coef, out = coef[:, good], out[:, good]
        most = int(order.max(initial=0))
    for m, po in set(zip(method.tolist(), partition_order.tolist(), strict=True)):
        own = np.flatnonzero((method == m) & (partition_order == po))
        _residuals(bits, coded[own], own, order, n, 4 + m, po, out)
    for i in range(n):
        live = order <= i
        if most and live.any():
            pred = np.zeros(len(coded), out.dtype)
            for j in range(min(most, i)):
                pred += coef[j] * out[i - 1 - j]
            out[i] += np.where(live, pred >> shift, 0)
    s[:, coded] = out


def _residuals(bits: _Bits, at: np.ndarray, own: np.ndarray, order: np.ndarray, n: int, width: int, partition_order: int, out: np.ndarray) -> None:
    plen, escape = n >> partition_order, (1 << width) - 1
    rank = order[own]
    inner = _Bits.__new__(_Bits)
    inner.view, inner.at = bits.view, bits.at[at]
    for i in range(n):
        if i % plen == 0:
            k = inner.take(width)
            raw = k == escape
            raw_bits = np.zeros(len(k), np.int64)
            if any_raw := bool(raw.any()):
                raw_bits[raw] = inner.take(5, raw)
        live = slice(None) if i >= rank.max(initial=0) else rank <= i
        if not any_raw:
            if isinstance(live, slice):
                out[i, own] = inner.rice(live, k)
            elif live.any():
                out[i, own[live]] = inner.rice(live, k[live])
            continue
        mask = np.ones(len(k), bool) if isinstance(live, slice) else live
        if (a := mask & ~raw).any():
            out[i, own[a]] = inner.rice(a, k[a])
        for b in np.unique(raw_bits[mask & raw]):
            a = mask & raw & (raw_bits == b)
            out[i, own[a]] = inner.take(int(b), a, signed=True)
    bits.at[at] = inner.at


def find_frames(buf: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, coded number, block size and header bytes of the places that look like frames of one channel (their CRC-8 holds).

    Bytes inside a frame may look like one as well; only the chain from a file's first frame tells them apart.
    """
    at = np.flatnonzero((buf[: max(0, end - 1)] == 0xFF) & (buf[1 : max(1, end)] == 0xF8))
    lead = buf[at + 4].astype(np.int64)
    nb = np.select([lead < 0x80, lead >> 5 == 6, lead >> 4 == 14, lead >> 3 == 30, lead >> 2 == 62, lead >> 1 == 126], [1, 2, 3, 4, 5, 6], 0)
    code = buf[at + 2] >> 4
    rate = buf[at + 2] & 15
    # of the codes for block size and rate, those that name a common size or read one or two more bytes
    ok = (nb > 0) & (code > 0) & (rate < 15) & np.isin(buf[at + 3], _LAYOUTS)
    at, lead, nb, code, rate = at[ok], lead[ok], nb[ok], code[ok].astype(np.int64), rate[ok]
    number = np.where(nb == 1, lead, lead & ((1 << np.maximum(0, 6 - nb + 1)) - 1))
    for j in range(1, 6):
        own = nb > j
        number[own] = (number[own] << 6) | (buf[at[own] + 4 + j] & 0x3F)
    extra = at + 4 + nb
    size = np.select([code == 1, code <= 5, code == 6, code == 7], [192, 576 << np.clip(code - 2, 0, 3), buf[extra] + np.int64(1), (buf[extra].astype(np.int64) << 8 | buf[extra + 1]) + 1], 256 << np.maximum(code - 8, 0))
    head = 4 + nb + np.select([code == 6, code == 7], [1, 2], 0) + np.select([rate == 12, (rate == 13) | (rate == 14)], [1, 2], 0) + 1
    good = (at + head < end) & (checksum(buf, at, head - 1, wide=False) == buf[np.minimum(at + head - 1, len(buf) - 1)])
    return at[good], number[good], size[good], head[good]


def metadata(data: bytes) -> dict:
    """Bits a sample, samples, MD5, seek points and where the frames begin."""
    if data[:4] != MARKER:
        raise BadFlac("no FLAC marker")
    at, out, last = 4, {"seek": []}, False
    while not last:
        if at + 4 > len(data):
            raise BadFlac("the data end inside the metadata")
        last, kind, length = data[at] >> 7, data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        block = data[at + 4 : at + 4 + length]
        if kind == 0:
            packed = int.from_bytes(block[10:18], "big")
            out |= {"most": int.from_bytes(block[2:4], "big"), "rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bps": (packed >> 36 & 31) + 1, "samples": packed & ((1 << 36) - 1), "md5": block[18:34]}
        elif kind == 3:
            out["seek"] = [struct.unpack(">QQH", block[i : i + 18]) for i in range(0, len(block) - 17, 18)]
        at += 4 + length
    if out.get("channels") != 1 or out["bps"] not in (8, 16):
        raise BadFlac("only mono with 8 or 16 bits is read")
    return out | {"first": at}


def decode(files: Sequence[bytes], chunk_frames: int = 8192) -> list[np.ndarray]:
    """Samples of each file (signed). Every frame's CRC-8 and CRC-16 and every file's length and MD5 are verified."""
    out = decode_each(files, chunk_frames)
    for found in out:
        if isinstance(found, BadFlac):
            raise found
    return out


def decode_each(files: Sequence[bytes], chunk_frames: int = 8192) -> list[np.ndarray | BadFlac]:
    """As ``decode``, but a damaged file gives its error in place of its samples, whatever files it is decoded with.

    All places that look like frames are decoded together. A file's frames are those that follow each other without a
    gap from its first byte on; no other place has a say.
    """
    out: list = [None] * len(files)
    metas: list[dict] = []
    for i, f in enumerate(files):
        try:
            metas.append(metadata(f))
        except (BadFlac, IndexError, struct.error) as e:
            out[i] = e if isinstance(e, BadFlac) else BadFlac("the data end inside the metadata")
            metas.append({"first": len(f), "bps": 8, "samples": 0, "most": 0})
    buf = np.frombuffer(b"".join(files) + bytes(16), np.uint8)
    ends = np.cumsum([len(f) for f in files], dtype=np.int64)
    at, number, size, head = find_frames(buf, len(buf) - 16)
    owner = np.searchsorted(ends, at, side="right")
    first = ends - np.array([len(f) - m["first"] for f, m in zip(files, metas, strict=True)], np.int64)
    most = np.array([m["most"] for m in metas], np.int64)
    real = (at >= first[owner]) & (size <= most[owner]) if len(files) else np.zeros(0, bool)
    owner, at, size, head = owner[real], at[real], size[real], head[real]
    finish, problem = np.zeros(len(at), np.int64), np.zeros(len(at), np.int8)
    samples: list = [None] * len(at)
    keys = size * 32 + np.array([m["bps"] for m in metas], np.int64)[owner]
    for key in np.unique(keys):
        own = np.flatnonzero(keys == key)
        for a in range(0, len(own), chunk_frames):
            part = own[a : a + chunk_frames]
            s, finish[part], problem[part] = decode_frames(buf, at[part], size[part], head[part], int(key % 32))
            for i, row in zip(part.tolist(), s.astype(np.int16), strict=True):
                samples[i] = row
    # the chains, then the checksums of the frames on them
    bounds = np.searchsorted(owner, np.arange(len(files) + 1))
    chains: list[list[int]] = [[] for _ in files]
    for i, m in enumerate(metas):
        place, end, done = int(first[i]), int(ends[i]), 0
        for j in range(bounds[i], bounds[i + 1]) if out[i] is None else ():
            if at[j] != place:
                continue
            chains[i].append(j)
            place = int(finish[j]) + 2
            if problem[j] or place > end:
                out[i] = BadFlac(PROBLEMS[problem[j] or _ENDS])
                break
            done += int(size[j])
        if out[i] is None and (done != m["samples"] or place != end):
            out[i] = BadFlac("more samples than stated" if done > m["samples"] else f"a damaged or missing frame at sample {done}")
    whole = np.array([j for i, c in enumerate(chains) if out[i] is None for j in c], np.int64)
    crc = checksum(buf, at[whole], finish[whole] - at[whole], wide=True)
    bad = set(whole[crc != (buf[finish[whole]].astype(np.uint16) << 8 | buf[finish[whole] + 1])].tolist())
    for i, m in enumerate(metas):
        if out[i] is not None:
            continue
        done = 0
        for j in chains[i]:
            if j in bad:
                out[i] = BadFlac(f"CRC-16 of the frame at sample {done}")
                break
            done += int(size[j])
        else:
            sound = np.concatenate([samples[j] for j in chains[i]]) if chains[i] else np.zeros(0, np.int16)
            digest = hashlib.md5(sound.astype(np.int8 if m["bps"] == 8 else "<i2").tobytes()).digest()
            out[i] = sound if digest == m["md5"] else BadFlac("MD5 of the samples")
    return out
