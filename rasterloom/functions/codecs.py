"""Byte codecs of strips and tiles.  Each works on one segment, so segments run in parallel."""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from operator import length_hint

import numpy as np

from ..operators.errors import Invalid

OUTPUT_CAP = 64 << 20  # most bytes a Deflate or Zstandard segment may decode to


# ------------------------------------------------------------------ PackBits


def packbits_decode(data: bytes, expected: int) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while len(out) < expected and i < n:
        head = data[i]
        i += 1
        if head < 128:
            if i + head + 1 > n:
                raise Invalid("PackBits: literal run beyond the end of the data")
            out += data[i : i + head + 1]
            i += head + 1
        elif head > 128:
            if i >= n:
                raise Invalid("PackBits: repeat run beyond the end of the data")
            out += data[i : i + 1] * (257 - head)
            i += 1
    return bytes(out)


_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more bytes are repeats of at most 128, all else literals of at most 128."""
    out, start = bytearray(), 0

    def literals(stop: int) -> None:
        for a in range(start, stop, 128):
            part = data[a : min(a + 128, stop)]
            out.append(len(part) - 1)
            out.extend(part)

    for run in _RUN.finditer(data):
        begin, end = run.span()
        literals(begin)
        out += bytes((257 - (end - begin), data[begin]))
        start = end
    literals(len(data))
    return bytes(out)


# ------------------------------------------------------------------ LZW

CLEAR, END = 256, 257
FULL = 4095 - 258  # strings that the writer gives a table before it is cleared
# bits of the code at each place after a clear: 9 until 512 codes are in use, and so on up to 12
WIDTHS = np.minimum(12, 1 + np.floor(np.log2(np.maximum(258 + np.arange(FULL + 260), 256))).astype(np.int64))
TRIED, LONG = 64, 2  # a table whose first TRIED strings are LONG bytes on average is searched by length


def lzw_decode(data: bytes, expected: int) -> bytes:
    """MSB-first codes of 9 to 12 bits; the width grows one code early.

    A code's width follows from its place after the last clear, so codes are cut out of the bits by the thousand.
    """
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    out: list[bytes] = []
    have, bit, place, total = 0, 0, 0, 8 * len(data)
    table, last = list(base), b""
    while have < expected:
        some = min(4096, (total - bit) // 9)
        widths = WIDTHS[np.minimum(np.arange(place, place + some), len(WIDTHS) - 1)]
        ends = bit + np.cumsum(widths)
        ends = ends[ends <= total]
        if not len(ends):
            break
        widths = widths[: len(ends)]
        begin = ends - widths
        at = begin >> 3
        codes = (((raw[at] << 16) | (raw[at + 1] << 8) | raw[at + 2]) >> (24 - widths - (begin & 7))) & ((1 << widths) - 1)
        stop = np.flatnonzero((codes == CLEAR) | (codes == END))
        used = int(stop[0]) if len(stop) else len(codes)
        size, add, say = len(table), table.append, out.append
        for code in codes[:used].tolist():
            if code < size:
                word = table[code]
            elif not last:
                raise Invalid("LZW: the first code after a clear isn't a literal")
            elif code == size and size < 4096:
                word = last + last[:1]
            else:
                raise Invalid("LZW: code beyond the table")
            if last and size < 4096:
                add(last + word[:1])
                size += 1
            say(word)
            last = word
            have += len(word)
            if have >= expected:
                break
        if len(stop) and codes[used] == END:
            break
        if len(stop):
            bit, place, table, last = int(ends[used]), 0, list(base), b""
        else:
            bit, place = int(ends[-1]), place + used
    return b"".join(out)


def _codes_by_byte(data: bytes, i: int) -> tuple[list[int], int] | None:
    """Codes of one table from byte i on, and where they end; each byte is a step to a longer string.

    None if the first strings are long: then a search on their length is faster.
    """
    codes: list[int] = []
    table: dict[int, int] = {}  # (code of the string's head) * 256 + last byte -> code * 256
    get, add = table.get, codes.append
    rest = iter(data)
    rest.__setstate__(i + 1)  # the iterator knows its place, so bytes needn't be counted one by one
    free, start, pause = 258 << 8, i, (258 + TRIED) << 8
    head = data[i] << 8
    for byte in rest:
        key = head + byte
        longer = get(key)
        if longer is not None:
            head = longer
            continue
        add(head >> 8)
        table[key] = free
        free += 256
        head = byte << 8
        if free == pause:
            i = len(data) - length_hint(rest) - 1
            if len(codes) == FULL:
                return codes, i
            if i - start > TRIED * LONG:
                return None
            pause = (258 + FULL) << 8
    return [*codes, head >> 8], len(data)


def _codes_by_length(data: bytes, i: int) -> tuple[list[int], int]:
    """The same codes; the longest string is found by doubling and halving a length (each head of a string is in the table)."""
    codes: list[int] = []
    table: dict[bytes, int] = {}
    n, good = len(data), 1
    while i < n and len(table) < FULL:
        # strings differ little in length from one to the next: try that length and its neighbours first
        guess = good if good > 1 else 2
        if i + guess <= n and data[i : i + guess] in table:
            good, step = guess, 1
            while i + good + step <= n and data[i : i + good + step] in table:
                good += step
                step *= 2
            bad = min(good + step, n - i + 1)
        else:
            bad, step = min(guess, n - i + 1), 1
            good = bad - 1
            while good > 1 and data[i : i + good] not in table:
                bad = good
                step *= 2
                good = max(1, good - step)
            good = max(good, 1)
        while bad - good > 1:
            middle = (good + bad) >> 1
            if data[i : i + middle] in table:
                good = middle
            else:
                bad = middle
        codes.append(table[data[i : i + good]] if good > 1 else data[i])
        if i + good < n:
            table[data[i : i + good + 1]] = 258 + len(table)
        i += good
    return codes, i


def lzw_encode(data: bytes) -> bytes:
    """Longest matches; the table is cleared before code 4095 is needed.  Codes are packed into bits at the end."""
    codes, widths, i = [CLEAR], [WIDTHS[:1]], 0
    while i < len(data):
        own, i = _codes_by_byte(data, i) or _codes_by_length(data, i)
        codes += own
        codes.append(CLEAR if i < len(data) else END)
        widths.append(WIDTHS[: len(own) + 1])
    if not data:
        codes.append(END)
        widths.append(WIDTHS[:1])
    return pack_codes(codes, np.concatenate(widths))


def pack_codes(codes: list[int], widths: np.ndarray) -> bytes:
    """Codes of up to 12 bits, most significant bit first."""
    c, w = np.asarray(codes, np.int64), widths
    start = np.cumsum(w) - w
    size = -(-int(w.sum()) // 8)
    window = c << (24 - w - (start & 7))  # three bytes from the byte in which the code begins
    out = np.zeros(size + 3, np.int64)
    for k in range(3):
        np.add.at(out, (start >> 3) + k, (window >> (16 - 8 * k)) & 255)
    return out[:size].astype(np.uint8).tobytes()


# ------------------------------------------------------------------ Deflate, Zstandard


def deflate_decode(data: bytes, expected: int, cap: int = OUTPUT_CAP) -> bytes:
    most = min(expected, cap)
    coder = zlib.decompressobj()
    try:
        out = coder.decompress(data, most + 1)
        if len(out) <= most and not coder.eof:
            out += coder.flush()
    except zlib.error as e:
        raise Invalid(f"Deflate: {e}") from e
    if len(out) > most:
        raise Invalid("Deflate: more bytes than the segment holds")
    return out


def deflate_encode(data: bytes) -> bytes:
    return zlib.compress(data, 6)


@lru_cache(maxsize=1)
def _zstd() -> tuple:
    """Compressor and decompressor of this process: their tables and windows are made once, not for each segment."""
    import zstandard

    return zstandard.ZstdCompressor(level=3, write_checksum=False), zstandard.ZstdDecompressor()


def zstd_decode(data: bytes, expected: int, cap: int = OUTPUT_CAP) -> bytes:
    import zstandard

    most = min(expected, cap)
    try:
        reader = _zstd()[1].stream_reader(data)
        out = reader.read(most + 1)
    except zstandard.ZstdError as e:
        raise Invalid(f"Zstandard: {e}") from e
    if len(out) > most:
        raise Invalid("Zstandard: more bytes than the segment holds")
    return out


def zstd_encode(data: bytes) -> bytes:
    return _zstd()[0].compress(data)


# ------------------------------------------------------------------ bit order

REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def reverse_bits(data: bytes) -> bytes:
    return data.translate(REVERSED)
