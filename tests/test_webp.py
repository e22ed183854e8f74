"""Lossless WebP: round trips, every feature of the format by streams built here, refused input, pages."""

import itertools

import numpy as np
import pytest

from rasterloom.functions import webp
from rasterloom.operators import decode
from rasterloom.operators.errors import Invalid, Unsupported
from rasterloom.plans.encode import Page, encode

RNG = np.random.default_rng(7)
BLACK = 0xFF000000


def pictures(h, w, n):
    y, x = np.mgrid[:h, :w]
    yield RNG.integers(0, 256, (h, w, n))
    yield np.full((h, w, n), 77)
    yield (x + y)[..., None] // 2 % 256 + np.zeros(n, int)
    yield RNG.integers(0, 2, (h, w, n)) * 200
    yield np.where(RNG.random((h, w, 1)) < 0.02, RNG.integers(0, 256, (h, w, n)), 30)


@pytest.mark.parametrize("h, w, n", [(1, 1, 3), (5, 7, 4), (64, 64, 3), (40, 600, 4), (1, 9000, 3)])
def test_round_trip(h, w, n):
    for s in pictures(h, w, n):
        got = webp.decode(webp.encode(s.astype(np.uint8)), w, h)
        assert np.array_equal(got[..., :n], s) and (n == 4 or (got[..., 3] == 255).all())


def argb(s):
    r, g, b, a = (s[..., k].astype(np.int64) for k in range(4))
    return (a << 24 | r << 16 | g << 8 | b).reshape(-1)


def file_of(w, h, transforms, body):
    """transforms: functions that write theirs; body: one that writes the image."""
    out = webp._Out()
    out.put([0x2F, w - 1, h - 1, 1, 0], [8, 14, 14, 1, 3])
    for t in transforms:
        out.put(1, 1)
        t(out)
    out.put(0, 1)
    body(out)
    stream = out.bytes()
    data = b"WEBPVP8L" + len(stream).to_bytes(4, "little") + stream + b"\0" * (len(stream) % 2)
    return b"RIFF" + len(data).to_bytes(4, "little") + data


def plain(p):
    return lambda out: webp._write_image(out, np.asarray(p, np.int64), True)


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 256])
def test_palettes(colours):
    """Several indices to a byte, lowest bits first; colours are sums of differences."""
    h, w = 6, 13
    table = RNG.integers(0, 1 << 32, colours)
    index = RNG.integers(0, colours, (h, w))
    size = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    per, many = 8 >> size, 1 << size
    packed = np.zeros((h, -(-w // many)), np.int64)
    for y, x in itertools.product(range(h), range(w)):
        packed[y, x // many] |= int(index[y, x]) << (per * (x % many))

    def transform(out):
        out.put([3, colours - 1], [2, 8])
        channels = np.stack([table >> k & 255 for k in (24, 16, 8, 0)])
        steps = np.diff(channels, axis=1, prepend=0) & 255
        webp._write_image(out, steps[0] << 24 | steps[1] << 16 | steps[2] << 8 | steps[3], False)

    got = webp.decode(file_of(w, h, [transform], plain((packed << 8 | BLACK).reshape(-1))), w, h)
    assert np.array_equal(argb(got), table[index].reshape(-1))


def byte(v):
    return v - 256 if v > 127 else v


def test_colour_transform():
    h, w, size = 9, 11, 2
    s = RNG.integers(0, 256, (h, w, 4))
    across, down = -(-w // 4), -(-h // 4)
    block = RNG.integers(0, 256, (down, across, 3))  # red to blue, green to blue, green to red
    coded = s.copy()
    for y, x in itertools.product(range(h), range(w)):
        rb, gb, gr = (byte(int(v)) for v in block[y // 4, x // 4])
        r, g, b, _ = (int(v) for v in s[y, x])
        coded[y, x, 0] = (r - (gr * byte(g) >> 5)) & 255
        coded[y, x, 2] = (b - (gb * byte(g) >> 5) - (rb * byte(r) >> 5)) & 255

    def transform(out):
        out.put([1, size - 2], [2, 3])
        webp._write_image(out, (BLACK | block[..., 0] << 16 | block[..., 1] << 8 | block[..., 2]).reshape(-1), False)

    assert np.array_equal(webp.decode(file_of(w, h, [transform], plain(argb(coded))), w, h), s)


def guess(mode, left, top, right, corner):
    """One channel's prediction, or with tuples all four (modes that look at whole pixels)."""
    mean = lambda a, b: tuple((p + q) // 2 for p, q in zip(a, b))
    clamp = lambda v: max(0, min(255, v))
    if mode in (0, 14, 15):
        return 0, 0, 0, 255
    if mode <= 4:
        return (left, top, right, corner)[mode - 1]
    if mode == 11:
        to_left = sum(abs(a + b - c - a) for a, b, c in zip(left, top, corner))
        to_top = sum(abs(a + b - c - b) for a, b, c in zip(left, top, corner))
        return left if to_left < to_top else top
    if mode == 12:
        return tuple(clamp(a + b - c) for a, b, c in zip(left, top, corner))
    if mode == 13:
        return tuple(clamp(a + int((a - c) / 2)) for a, c in zip(mean(left, top), corner))
    return {5: mean(mean(left, right), top), 6: mean(left, corner), 7: mean(left, top), 8: mean(corner, top), 9: mean(top, right), 10: mean(mean(left, corner), mean(top, right))}[mode]


def test_predictions():
    """All sixteen modes in blocks of four, borders and the last column included."""
    h, w = 17, 18
    s = np.clip(np.cumsum(RNG.integers(-40, 41, (h, w, 4)), axis=1) + 128, 0, 255)
    modes = RNG.permutation(np.arange(25) % 16).reshape(5, 5)
    flat = [tuple(int(c) for c in p) for p in s.reshape(-1, 4)]
    coded = np.zeros_like(s).reshape(-1, 4)
    for i, p in enumerate(flat):
        y, x = divmod(i, w)
        if y == 0:
            g = flat[i - 1] if x else (0, 0, 0, 255)
        elif x == 0:
            g = flat[i - w]
        else:
            g = guess(int(modes[y // 4, x // 4]), flat[i - 1], flat[i - w], flat[i - w + 1], flat[i - w - 1])
        coded[i] = [(a - b) & 255 for a, b in zip(p, g)]

    def transform(out):
        out.put([0, 0], [2, 3])
        webp._write_image(out, (BLACK | modes << 8).reshape(-1), False)

    assert np.array_equal(webp.decode(file_of(w, h, [transform], plain(argb(coded.reshape(h, w, 4)))), w, h), s)


def test_cache_copies_and_groups():
    """Two groups of codes by an entropy image, cached colours, copies by plane and by plain distances."""
    w, h, cache_bits = 8, 8, 3
    colours = RNG.integers(0, 1 << 32, 12).tolist()
    cache, want, ops = [0] * 8, [], []

    def emit(p):
        want.append(p)
        cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> 29] = p

    while len(want) < w * h:
        kind, left = RNG.integers(0, 4), w * h - len(want)
        group = len(want) // w // 4 % 2
        if kind == 0 and want:
            n = int(min(RNG.integers(1, 9), left))
            code = int(RNG.integers(1, 140))
            if code <= 120:
                dx, dy = webp.PLANE[code - 1]
                d = max(dx + dy * w, 1)
            else:
                d = code - 120
            if d > len(want):
                continue
            ops.append((group, "copy", n, code))
            for _ in range(n):
                emit(want[-d])
        elif kind == 1:
            slot = int(RNG.integers(0, 8))
            ops.append((group, "cache", slot, 0))
            emit(cache[slot])
        else:
            p = int(RNG.choice(colours))
            ops.append((group, "pixel", p, 0))
            emit(p)

    def body(out):
        out.put([1, cache_bits], [1, 4])
        out.put([1, 0], [1, 3])  # groups by blocks of four
        webp._write_image(out, np.array([BLACK, BLACK, BLACK | 1 << 8, BLACK | 1 << 8]), False)
        codes = []
        for group in (0, 1):
            own = [o for o in ops if o[0] == group]
            counts = [np.zeros(n, np.int64) for n in (280 + 8, 256, 256, 256, 40)]
            for _, kind, a, b in own:
                if kind == "pixel":
                    for c, k in zip(counts[:4], (8, 16, 0, 24)):
                        c[a >> k & 255] += 1
                elif kind == "cache":
                    counts[0][280 + a] += 1
                else:
                    counts[0][256 + webp._classes(np.array([a]))[0][0]] += 1
                    counts[4][webp._classes(np.array([b]))[0][0]] += 1
            codes.append([webp._write_code(out, c) for c in counts])
        for group, kind, a, b in ops:
            put = lambda k, s, g=group: out.put(codes[g][k][0][s], codes[g][k][1][s])
            if kind == "pixel":
                for k, shift in enumerate((8, 16, 0, 24)):
                    put(k, a >> shift & 255)
            elif kind == "cache":
                put(0, 280 + a)
            else:
                for k, base, v in ((0, 256, a), (4, 0, b)):
                    symbol, more, extra = (int(x[0]) for x in webp._classes(np.array([v])))
                    put(k, base + symbol)
                    out.put(more, extra)

    assert argb(webp.decode(file_of(w, h, [], body), w, h)).tolist() == want


def test_plane_codes():
    """All near places once; the list's ends as the format has them."""
    assert len(webp.PLANE) == len(set(webp.PLANE)) == 120
    assert webp.PLANE[:6] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0)] and webp.PLANE[-4:] == [(7, 7), (-7, 7), (8, 6), (8, 7)]


def test_refused():
    good = webp.encode(RNG.integers(0, 256, (6, 5, 3)).astype(np.uint8))
    for bad, error in ((good[:12], Invalid), (b"RIFX" + good[4:], Invalid), (good[:12] + b"VP8 " + good[16:], Unsupported), (good[:40], Invalid), (good[:20] + b"\x2e" + good[21:], Invalid)):
        with pytest.raises(error):
            webp.decode(bad, 5, 6)
    with pytest.raises(Invalid, match="size"):
        webp.decode(good, 6, 5)
    for _ in range(300):
        b = bytearray(good)
        for _ in range(RNG.integers(1, 5)):
            b[RNG.integers(20, len(b))] = RNG.integers(0, 256)
        assert decode.guarded(webp.decode, bytes(b), 5, 6)[1] in (None, "invalid", "unsupported")


@pytest.mark.parametrize("layout", [{}, {"rows_per_strip": 5}, {"tile": (16, 16)}, {"tile": (32, 16), "big": True}])
def test_pages(layout):
    for kind, n in (("rgb24", 3), ("rgba32", 4)):
        s = RNG.integers(0, 256, (21, 37, n)).astype(np.uint8)
        image = decode.decode_at(encode([Page(s, kind, "webp", **layout)]))[0]
        assert np.array_equal(np.frombuffer(image.data, np.uint8).reshape(21, 37, 3), s[..., :3])
    for kind, n, more in (("gray8", 1, {}), ("rgb24", 3, {"planar": True}), ("rgb24", 3, {"predictor": True}), ("rgb48", 3, {})):
        with pytest.raises(Invalid):
            encode([Page(np.zeros((4, 4, n)), kind, "webp", **more)])
