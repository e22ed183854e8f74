"""Lossless WebP (VP8L) segments: reading of whole files, and a writer of its own for what is written here.

Reading covers what the format has: five prefix codes to a group, groups by an entropy image, LZ77 with the plane's distance codes,
the colour cache, and the transforms (prediction, colour, green taken off, palettes with several indices to a byte).  Lossy
(``VP8 ``) and animated files are ``unsupported``.  The writer predicts from the left, takes green off, and writes prefix codes with runs
of equal pixels; any reader follows.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

from ..operators.errors import Invalid, Unsupported

# fixed values: the order in which lengths of code lengths are written
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Neighbours by their distance codes: nearer ones first, of equally near ones the one more straight above, then the right one.
PLANE = sorted(((dx, dy) for dy in range(8) for dx in range(-7, 9) if dy or dx > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
HASH = 0x1E35A7BD


class _Bits:
    """Bits from the low end of each byte on."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def take(self, n: int) -> int:
        at = self.at
        self.at = at + n
        if self.at > self.end:
            raise Invalid("WebP: the stream ends early")
        return (int.from_bytes(self.data[at >> 3 : (at >> 3) + 5], "little") >> (at & 7)) & ((1 << n) - 1)


def _canonical(lengths: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, length, code with its first bit lowest) in the order of codes; a code that isn't full is refused."""
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    if len(used) == 1:
        return [(used[0][1], 0, 0)]
    if sum(1 << (15 - n) for n, _ in used) != 1 << 15:
        raise Invalid("WebP: a prefix code isn't full")
    out, code, before = [], 0, 0
    for n, s in used:
        code <<= n - before
        before = n
        out.append((s, n, int(format(code, f"0{n}b")[::-1], 2)))
        code += 1
    return out


class _Code:
    """A prefix code: eight bits looked up at once, longer codes by length."""

    def __init__(self, lengths: list[int]):
        self.near: list[int | None] = [None] * 256
        self.far: dict[tuple[int, int], int] = {}
        for s, n, code in _canonical(lengths):
            if n <= 8:
                for k in range(code, 256, 1 << n):
                    self.near[k] = s << 4 | n
            else:
                self.far[n, code] = s

    def next(self, bits: _Bits) -> int:
        at = bits.at
        word = int.from_bytes(bits.data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7)
        found = self.near[word & 255]
        if found is not None:
            n, s = found & 15, found >> 4
        else:
            for n in range(9, 16):
                s = self.far.get((n, word & ((1 << n) - 1)), -1)
                if s >= 0:
                    break
            else:
                raise Invalid("WebP: no such prefix code")
        bits.at = at + n
        if bits.at > bits.end:
            raise Invalid("WebP: the stream ends early")
        return s


def _read_code(bits: _Bits, size: int) -> _Code:
    lengths = [0] * size
    if bits.take(1):
        two = bits.take(1)
        symbols = [bits.take(8 if bits.take(1) else 1)] + ([bits.take(8)] if two else [])
        for s in symbols:
            if s >= size:
                raise Invalid("WebP: symbol beyond its alphabet")
            lengths[s] = 1
        return _Code(lengths)
    own = [0] * 19
    for k in LENGTH_ORDER[: 4 + bits.take(4)]:
        own[k] = bits.take(3)
    if not any(own):
        raise Invalid("WebP: no code lengths")
    code = _Code(own)
    left = 2 + bits.take(2 + 2 * bits.take(3)) if bits.take(1) else size
    at, before = 0, 8
    while at < size and left:
        left -= 1
        s = code.next(bits)
        if s < 16:
            lengths[at] = s
            at += 1
            before = s or before
            continue
        least, extra = ((3, 2), (3, 3), (11, 7))[s - 16]
        times, value = least + bits.take(extra), before if s == 16 else 0
        if at + times > size:
            raise Invalid("WebP: code lengths beyond the alphabet")
        lengths[at : at + times] = [value] * times
        at += times
    if not any(lengths):
        raise Invalid("WebP: an empty prefix code")
    return _Code(lengths)


def _number(bits: _Bits, symbol: int) -> int:
    """A length or distance: its class and extra bits."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.take(extra) + 1


def _entropy_image(bits: _Bits, width: int, height: int, main: bool) -> list[int]:
    """Pixels (alpha, red, green, blue from the high byte on) of an image or of one that transforms use."""
    cache_bits = bits.take(4) if bits.take(1) else 0
    if cache_bits > 11:
        raise Invalid("WebP: colour cache too large")
    cache = [0] * (1 << cache_bits) if cache_bits else []
    group_bits, groups_of, groups = 0, None, 1
    if main and bits.take(1):
        group_bits = bits.take(3) + 2
        across = (width + (1 << group_bits) - 1) >> group_bits
        groups_of = [p >> 8 & 0xFFFF for p in _entropy_image(bits, across, (height + (1 << group_bits) - 1) >> group_bits, False)]
        groups = max(groups_of) + 1
    codes = []
    for _ in range(groups):
        if bits.at >= bits.end:
            raise Invalid("WebP: the stream ends early")
        codes.append([_read_code(bits, n) for n in (LITERALS + LENGTHS + len(cache), 256, 256, 256, DISTANCES)])
    out: list[int] = []
    total, shift = width * height, 32 - cache_bits
    green, red, blue, alpha, far = codes[0]
    while len(out) < total:
        if groups_of is not None:
            y, x = divmod(len(out), width)
            green, red, blue, alpha, far = codes[groups_of[(y >> group_bits) * across + (x >> group_bits)]]
        s = green.next(bits)
        start = len(out)
        if s < LITERALS:
            r = red.next(bits)
            b = blue.next(bits)
            out.append(alpha.next(bits) << 24 | r << 16 | s << 8 | b)
        elif s < LITERALS + LENGTHS:
            n = _number(bits, s - LITERALS)
            d = _number(bits, far.next(bits))
            if d > len(PLANE):
                d -= len(PLANE)
            else:
                dx, dy = PLANE[d - 1]
                d = max(dx + dy * width, 1)
            if d > start or start + n > total:
                raise Invalid("WebP: a copy from before the image or beyond it")
            part = out[start - d : start - d + n]
            while len(part) < n:
                part += part[: n - len(part)]
            out += part
        else:
            if s - LITERALS - LENGTHS >= len(cache):
                raise Invalid("WebP: no such cached colour")
            out.append(cache[s - LITERALS - LENGTHS])
        if cache_bits:
            for p in out[start:]:
                cache[(HASH * p & 0xFFFFFFFF) >> shift] = p
    return out


def _signed(v: np.ndarray) -> np.ndarray:
    return v.astype(np.uint8).view(np.int8).astype(np.int64)


def _channels(p: np.ndarray) -> tuple[np.ndarray, ...]:
    return tuple((p >> k) & 255 for k in (24, 16, 8, 0))


def _half(a: int, b: int) -> int:
    """Mean of each channel, rounded down."""
    return (a & b) + (((a ^ b) & 0xFEFEFEFE) >> 1)


def _by_channel(f, *pixels: int) -> int:
    return sum(f(*[p >> k & 255 for p in pixels]) << k for k in (0, 8, 16, 24))


def _clamp(v: int) -> int:
    return 0 if v < 0 else 255 if v > 255 else v


def _nearer(left: int, top: int, corner: int) -> int:
    a = sum(abs((top >> k & 255) - (corner >> k & 255)) for k in (0, 8, 16, 24))  # how far the estimate is from the left pixel
    b = sum(abs((left >> k & 255) - (corner >> k & 255)) for k in (0, 8, 16, 24))
    return left if a < b else top


def _gradient(a: int, b: int) -> int:
    d = a - b
    return _clamp(a + (d // 2 if d >= 0 else -(-d // 2)))


BLACK = 0xFF000000
PREDICTORS = (
    lambda left, top, right, corner: BLACK, lambda left, top, right, corner: left, lambda left, top, right, corner: top, lambda left, top, right, corner: right,
    lambda left, top, right, corner: corner, lambda left, top, right, corner: _half(_half(left, right), top), lambda left, top, right, corner: _half(left, corner),
    lambda left, top, right, corner: _half(left, top), lambda left, top, right, corner: _half(corner, top), lambda left, top, right, corner: _half(top, right),
    lambda left, top, right, corner: _half(_half(left, corner), _half(top, right)), lambda left, top, right, corner: _nearer(left, top, corner),
    lambda left, top, right, corner: _by_channel(lambda a, b, c: _clamp(a + b - c), left, top, corner),
    lambda left, top, right, corner: _by_channel(_gradient, _half(left, top), corner),
    lambda left, top, right, corner: BLACK, lambda left, top, right, corner: BLACK,
)


def _add(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00)) & 0xFF00FF00 | ((a & 0x00FF00FF) + (b & 0x00FF00FF)) & 0x00FF00FF


def _undo_prediction(p: list[int], width: int, size: int, modes: list[int]) -> list[int]:
    across = (width + (1 << size) - 1) >> size
    out = p[:]
    for i in range(len(p)):
        if i < width:
            guess = out[i - 1] if i else BLACK
        elif i % width == 0:
            guess = out[i - width]
        else:
            y, x = divmod(i, width)
            guess = PREDICTORS[modes[(y >> size) * across + (x >> size)] >> 8 & 15](out[i - 1], out[i - width], out[i - width + 1], out[i - width - 1])
        out[i] = _add(p[i], guess)
    return out


def _undo(kind: int, p: list[int], width: int, height: int, size: int, data: list[int]) -> list[int]:
    """The image before transform ``kind``; width is that of the image it gives."""
    if kind == 0:
        return _undo_prediction(p, width, size, data)
    v = np.array(p, np.int64)
    if kind == 3:
        per = 8 >> size
        packed = v.reshape(height, -1) >> 8 & 255
        x = np.arange(width)
        index = packed[:, x >> size] >> (per * (x & ((1 << size) - 1))) & ((1 << per) - 1)
        table = np.zeros(256, np.int64)
        table[: len(data)] = data
        return table[index].reshape(-1).tolist()
    a, r, g, b = _channels(v)
    if kind == 2:
        r, b = r + g, b + g
    else:
        y, x = np.divmod(np.arange(len(p)), width)
        block = np.array(data, np.int64)[(y >> size) * ((width + (1 << size) - 1) >> size) + (x >> size)]
        _, red_to_blue, green_to_blue, green_to_red = _channels(block)
        r = (r + (_signed(green_to_red) * _signed(g) >> 5)) & 255
        b = b + (_signed(green_to_blue) * _signed(g) >> 5) + (_signed(red_to_blue) * _signed(r) >> 5)
    return (a << 24 | (r & 255) << 16 | g << 8 | b & 255).tolist()


def _lossless(data: bytes) -> bytes:
    """The VP8L chunk of a WebP file."""
    if len(data) < 20 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise Invalid("WebP: no RIFF header")
    at = 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if name == b"VP8L":
            return data[at + 8 : at + 8 + size]
        if name in (b"VP8 ", b"ANIM", b"ANMF"):
            raise Unsupported("WebP: lossy or animated")
        at += 8 + size + size % 2
    raise Invalid("WebP: no image")


def decode(data: bytes, width: int, height: int) -> np.ndarray:
    """(height, width, 4): red, green, blue, alpha of a lossless file of exactly that size."""
    stream = _lossless(data)
    bits = _Bits(stream)
    if bits.take(8) != 0x2F:
        raise Invalid("WebP: no lossless signature")
    if (bits.take(14) + 1, bits.take(14) + 1) != (width, height):
        raise Invalid("WebP: the frame isn't of the segment's size")
    with_alpha = bits.take(1)
    if bits.take(3):
        raise Invalid("WebP: unknown version")
    todo, now = [], width
    while bits.take(1):
        kind = bits.take(2)
        if any(kind == k for k, *_ in todo):
            raise Invalid("WebP: a transform twice")
        if kind in (0, 1):
            size = bits.take(3) + 2
            table = _entropy_image(bits, (now + (1 << size) - 1) >> size, (height + (1 << size) - 1) >> size, False)
            todo.append((kind, now, size, table))
        elif kind == 2:
            todo.append((kind, now, 0, []))
        else:
            n = bits.take(8) + 1
            table = _entropy_image(bits, n, 1, False)
            for i in range(1, n):
                table[i] = _add(table[i], table[i - 1])
            size = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            todo.append((kind, now, size, table))
            now = (now + (1 << size) - 1) >> size
    p = _entropy_image(bits, now, height, True)
    for kind, wide, size, table in reversed(todo):
        p = _undo(kind, p, wide, height, size, table)
    v = np.array(p, np.int64).reshape(height, width)
    a, r, g, b = _channels(v)
    return np.stack([r, g, b, a if with_alpha else np.full_like(a, 255)], axis=-1).astype(np.uint8)


# ------------------------------------------------------------------ writing


class _Out:
    def __init__(self):
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def put(self, value: int | np.ndarray, size: int | np.ndarray) -> None:
        value = np.atleast_1d(np.asarray(value, np.int64))
        self.values.append(value)
        self.sizes.append(np.broadcast_to(np.asarray(size, np.int64), value.shape))

    def bytes(self) -> bytes:
        value, size = np.concatenate(self.values), np.concatenate(self.sizes)
        start = np.cumsum(size) - size
        total = int(size.sum())
        bits = np.zeros(total, np.uint8)
        for k in range(int(size.max(initial=0))):
            own = size > k
            bits[start[own] + k] = value[own] >> k & 1
        return np.packbits(bits, bitorder="little").tobytes()


def _lengths(counts: np.ndarray, most: int = 15) -> np.ndarray:
    """Code lengths by Huffman's method; counts are flattened until none is longer than ``most``."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        out[used] = 1
        return out
    weight = counts.astype(np.int64)
    while True:
        heap = [(int(weight[s]), i, [int(s)]) for i, s in enumerate(used)]
        heapq.heapify(heap)
        out[:] = 0
        number = len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            out[a[2] + b[2]] += 1
            heapq.heappush(heap, (a[0] + b[0], number, a[2] + b[2]))
            number += 1
        if out.max() <= most:
            return out
        weight = np.where(weight > 0, weight // 2 + 1, 0)


def _write_code(out: _Out, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes the code for counts; returns (code, length) of each symbol."""
    lengths = _lengths(counts)
    used = np.flatnonzero(lengths)
    code, size = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    if len(used) <= 2 and (not len(used) or used.max() < 256):
        first = int(used[0]) if len(used) else 0
        out.put([1, int(len(used) == 2), 1, first], [1, 1, 1, 8])
        if len(used) == 2:
            out.put(int(used[1]), 8)
            code[used[1]], size[used] = 1, 1
        return code, size
    own = _lengths(np.bincount(lengths, minlength=19), 7)
    names = np.flatnonzero(own)
    out.put([0, 15], [1, 4])
    out.put(own[list(LENGTH_ORDER)], 3)
    out.put(0, 1)
    if len(names) > 1:
        table = {s: (c, n) for s, n, c in _canonical(own.tolist())}
        out.put([table[v][0] for v in lengths.tolist()], [table[v][1] for v in lengths.tolist()])
    for s, n, c in _canonical(lengths.tolist()):
        code[s], size[s] = c, n
    return code, size


def _classes(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, extra bits' value, their number) of lengths."""
    m = n - 1
    top = np.maximum(np.floor(np.log2(np.maximum(m, 1))).astype(np.int64), 0)
    extra = np.where(m < 4, 0, top - 1)
    symbol = np.where(m < 4, m, 2 * top + (m >> np.maximum(top - 1, 0) & 1))
    return symbol, np.where(m < 4, 0, m & ((1 << extra) - 1)), extra


def _write_image(out: _Out, p: np.ndarray, main: bool) -> None:
    """Pixels as prefix codes, with runs of equal ones as copies from the pixel before."""
    out.put(0, 1)  # no colour cache
    if main:
        out.put(0, 1)  # one group
    same = np.append(False, p[1:] == p[:-1])
    head = np.flatnonzero(~same)
    run = np.diff(np.append(head, len(p))) - 1
    a, r, g, b = _channels(p[head])
    long = np.flatnonzero(run >= 3)
    short = np.repeat(np.arange(len(head)), np.where(run < 3, run + 1, 1))  # runs of fewer are written out
    times = run[long]
    pieces = [(long, np.minimum(times, 4096))]
    while (times > 4096).any():  # copies have a largest length
        long, times = long[times > 4096], times[times > 4096] - 4096
        pieces.append((long, np.minimum(times, 4096)))
    at, n = np.concatenate([x for x, _ in pieces]), np.concatenate([x for _, x in pieces])
    symbol, more, extra = _classes(n)
    counts = [np.bincount(np.r_[g[short], LITERALS + symbol], minlength=LITERALS + LENGTHS), *[np.bincount(c[short], minlength=256) for c in (r, b, a)], np.bincount(np.full(len(at), 1), minlength=DISTANCES)]
    codes = [_write_code(out, c) for c in counts]
    # distance code 2 is the pixel on the left: class 1, no extra bits
    rows = len(short) + len(at)
    order = np.argsort(np.r_[short, at], kind="stable")
    value, size = np.zeros((rows, 4), np.int64), np.zeros((rows, 4), np.int64)
    for k, (channel, (code, length)) in enumerate(zip((g, r, b, a), codes[:4])):
        value[: len(short), k], size[: len(short), k] = code[channel[short]], length[channel[short]]
    value[len(short) :, 0], size[len(short) :, 0] = codes[0][0][LITERALS + symbol], codes[0][1][LITERALS + symbol]
    value[len(short) :, 1], size[len(short) :, 1] = more, extra
    value[len(short) :, 2], size[len(short) :, 2] = codes[4][0][1], codes[4][1][1]
    out.put(value[order].reshape(-1), size[order].reshape(-1))


def encode(samples: np.ndarray) -> bytes:
    """A lossless file of (height, width, 3 or 4) samples."""
    h, w, n = samples.shape
    if not (1 <= w <= 16384 and 1 <= h <= 16384):
        raise Invalid("WebP frames have sides of 1 to 16384")
    s = samples.astype(np.int64)
    v = np.concatenate([s, np.full((h, w, 1), 255)], axis=2) if n == 3 else s
    guess = np.zeros_like(v)
    guess[:, 1:] = v[:, :-1]
    guess[1:, 0] = v[:-1, 0]
    guess[0, 0] = (0, 0, 0, 255)
    d = (v - guess) & 255
    r, g, b, a = (d[..., k] for k in range(4))
    p = (a << 24 | ((r - g) & 255) << 16 | g << 8 | (b - g) & 255).reshape(-1)
    out = _Out()
    out.put([0x2F, w - 1, h - 1, int(n == 4), 0], [8, 14, 14, 1, 3])
    out.put([1, 0, 7], [1, 2, 3])  # prediction, blocks of 512: from the left everywhere
    _write_image(out, np.full(-(-w // 512) * -(-h // 512), BLACK | 1 << 8, np.int64), False)
    out.put([1, 2, 0], [1, 2, 1])  # green taken off; no more transforms
    _write_image(out, p, True)
    stream = out.bytes()
    body = b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + b"\0" * (len(stream) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body
