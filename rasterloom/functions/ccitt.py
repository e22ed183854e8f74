"""CCITT bilevel codecs: Modified Huffman, T.4 one- and two-dimensional, T.6.

Rows are handled as lists of changing elements (columns where the colour changes, white first), so
run coding and the search for b1 and b2 are list operations; bits are packed by NumPy.  A 1 bit is
black.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np

from ..operators.errors import Invalid

# Run length codes of white and black runs (terminating 0-63, then make-up 64-1728),
# make-up codes of both colours (1792-2560), and codes of two-dimensional modes.
WHITE_TERMINATING = """00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101
101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011
00011010 00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100
00101101 00000100 00000101 00001010 00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001
01011010 01011011 01001010 01001011 00110010 00110011 00110100""".split()
WHITE_MAKEUP = """11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101
011010010 011010011 011010100 011010101 011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001
010011010 011000 010011011""".split()
BLACK_TERMINATING = """0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111
000011000 0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111
00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001 000001101010 000001101011
000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010
000011011011 000001010100 000001010101 000001010110 000001010111 000001100100 000001100101 000001010010 000001010011
000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100
000001011010 000001100110 000001100111""".split()
BLACK_MAKEUP = """0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100
0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010 0000001110011 0000001110100
0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010
0000001011011 0000001100100 0000001100101""".split()
COMMON_MAKEUP = """00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110
000000010111 000000011100 000000011101 000000011110 000000011111""".split()
EOL = "000000000001"
VERTICAL = {0: "1", 1: "011", 2: "000011", 3: "0000011", -1: "010", -2: "000010", -3: "0000010"}
PASS, HORIZONTAL, UNCOMPRESSED, ONE_D = "0001", "001", "0000001111", "000000001"


def _runs(terminating: list[str], makeup: list[str]) -> tuple[dict[str, int], list[str], dict[int, str]]:
    more = {64 * (i + 1): c for i, c in enumerate(makeup)} | {1792 + 64 * i: c for i, c in enumerate(COMMON_MAKEUP)}
    return {c: i for i, c in enumerate(terminating)} | {c: n for n, c in more.items()}, terminating, more


CODES = (_runs(WHITE_TERMINATING, WHITE_MAKEUP), _runs(BLACK_TERMINATING, BLACK_MAKEUP))
MODES = {c: ("V", d) for d, c in VERTICAL.items()} | {PASS: ("P", 0), HORIZONTAL: ("H", 0), UNCOMPRESSED: ("U", 0), ONE_D: ("X", 0)}


def _lookup(codes: dict[str, object], width: int) -> list:
    table: list = [None] * (1 << width)
    for code, value in codes.items():
        first = int(code, 2) << (width - len(code))
        for i in range(first, first + (1 << (width - len(code)))):
            table[i] = (len(code), value)
    return table


RUN_TABLE = tuple(_lookup(c[0], 13) for c in CODES)
MODE_TABLE = _lookup(MODES, 10)


class Bits:
    def __init__(self, data: bytes):
        self.value, self.size, self.at = int.from_bytes(data + bytes(8), "big"), len(data) * 8, 0
        self.data = data + bytes(8)

    def peek(self, n: int) -> int:
        first = self.at >> 3
        word = int.from_bytes(self.data[first : first + 4], "big")
        return (word >> (32 - (self.at & 7) - n)) & ((1 << n) - 1)

    def take(self, n: int) -> int:
        if self.at + n > self.size:
            raise Invalid("CCITT: the data end inside a row")
        v = self.peek(n)
        self.at += n
        return v


def _read_run(bits: Bits, colour: int) -> int:
    total = 0
    while True:
        found = RUN_TABLE[colour][bits.peek(13)]
        if found is None or bits.at + found[0] > bits.size:
            raise Invalid("CCITT: no such run code, or the data end inside one")
        bits.at += found[0]
        total += found[1]
        if found[1] < 64:
            return total


def _one_d(bits: Bits, width: int) -> list[int]:
    changes, at, colour = [], 0, 0
    while at < width:
        at += _read_run(bits, colour)
        if at > width:
            raise Invalid("CCITT: a run passes the end of the row")
        changes.append(at)
        colour ^= 1
    return changes


def _b1(reference: list[int], a0: int, colour: int, start: bool) -> int:
    """Index of the first changing element right of a0 (at it, for the row's start) to the other colour.

    Entry i of ``reference`` changes to black if i is even, so it must have the parity of ``colour``.
    """
    i = bisect_right(reference, a0) if not start else 0
    while i < len(reference) and i % 2 != colour:
        i += 1
    return i


def _two_d(bits: Bits, reference: list[int], width: int) -> list[int]:
    changes: list[int] = []
    a0, colour, start = 0, 0, True

    def get(i: int) -> int:
        return reference[i] if i < len(reference) else width

    while a0 < width:
        found = MODE_TABLE[bits.peek(10)]
        if found is None or bits.at + found[0] > bits.size:
            raise Invalid("CCITT: no such mode code, or the data end inside a row")
        bits.at += found[0]
        mode, shift = found[1]
        if mode == "V":
            a1 = get(_b1(reference, a0, colour, start)) + shift
            if not a0 <= a1 <= width:
                raise Invalid("CCITT: vertical mode leaves the row")
            changes.append(a1)
            a0, colour = a1, colour ^ 1
        elif mode == "P":
            a0 = get(_b1(reference, a0, colour, start) + 1)
        elif mode == "H":
            for c in (colour, colour ^ 1):
                a0 += _read_run(bits, c)
                if a0 > width:
                    raise Invalid("CCITT: a run passes the end of the row")
                changes.append(a0)
        elif mode == "U":
            a0, colour, changes = _uncompressed(bits, changes, a0, colour, width)
        else:
            raise Invalid("CCITT: one-dimensional extension inside a two-dimensional row")
        start = False
    return changes


def _uncompressed(bits: Bits, changes: list[int], a0: int, colour: int, width: int) -> tuple[int, int, list[int]]:
    """Patterns 0^z 1: z <= 4 white pixels and a black one, z = 5 five white, z >= 6 ends the mode after z - 6 white."""

    def put(n: int, black: int) -> None:
        nonlocal a0, colour
        if a0 + n > width:
            raise Invalid("CCITT: uncompressed pixels pass the end of the row")
        if n and black != colour:
            changes.append(a0)
            colour = black
        a0 += n

    while True:
        zeros = 0
        while not bits.take(1):
            zeros += 1
            if zeros > 10:
                raise Invalid("CCITT: no such uncompressed pattern")
        if zeros <= 4:
            put(zeros, 0)
            put(1, 1)
        elif zeros == 5:
            put(5, 0)
        else:
            put(zeros - 6, 0)
            black = bits.take(1)
            if black != colour:
                changes.append(a0)
                colour = black
            return a0, colour, changes


def _skip_eol(bits: Bits, aligned: bool = False) -> None:
    """Zeros (fill, also that which aligns the code to a byte), then a 1; aligned: the code has to end with a byte."""
    zeros = 0
    while not bits.take(1):
        zeros += 1
        if zeros > 1024:
            raise Invalid("CCITT: fill before an end of line is too long")
    if zeros < 11:
        raise Invalid("CCITT: end of line expected")
    if aligned and bits.at % 8:
        raise Invalid("CCITT: end of line isn't aligned to a byte")


def _paint(rows: list[list[int]], width: int) -> bytes:
    stride = (width + 7) // 8
    pixels = np.zeros((len(rows), stride * 8 + 1), np.int8)
    for y, changes in enumerate(rows):
        if changes:
            np.add.at(pixels[y], np.minimum(changes, stride * 8), np.where(np.arange(len(changes)) % 2 == 0, 1, -1))
    black = np.cumsum(pixels, axis=1)[:, : stride * 8] > 0
    black[:, width:] = False
    return np.packbits(black, axis=1).tobytes()


def decode(data: bytes, width: int, rows: int, kind: str, aligned: bool = False) -> bytes:
    """kind: mh, t4 (one-dimensional), t4-2d or t6.  Packed rows, 1 is black."""
    bits, out, before = Bits(data), [], []
    for _ in range(rows):
        two = kind == "t6"
        if kind in ("t4", "t4-2d"):
            _skip_eol(bits, aligned)
            two = kind == "t4-2d" and not bits.take(1)
        before = _two_d(bits, before, width) if two else _one_d(bits, width)
        if kind == "mh":
            bits.at = (bits.at + 7) // 8 * 8
        # equal neighbours are runs of length 0: drop them in pairs so that entries rise
        clean: list[int] = []
        for c in before:
            if clean and clean[-1] == c:
                clean.pop()
            else:
                clean.append(c)
        while clean and clean[-1] >= width:
            clean.pop()
        out.append(before)
        before = clean
    return _paint(out, width)


def _put_run(out: list[str], run: int, colour: int) -> None:
    _, terminating, makeup = CODES[colour]
    while run >= 2624:
        out.append(makeup[2560])
        run -= 2560
    if run >= 64:
        out.append(makeup[run // 64 * 64])
        run %= 64
    out.append(terminating[run])


def _changes(row: np.ndarray) -> list[int]:
    return np.flatnonzero(np.diff(row.astype(np.int8), prepend=np.int8(0))).tolist()


def encode(data: bytes, width: int, rows: int, kind: str, aligned: bool = False) -> bytes:
    stride = (width + 7) // 8
    pixels = np.unpackbits(np.frombuffer(data, np.uint8).reshape(rows, stride), axis=1)[:, :width]
    out: list[str] = []
    size = 0
    before: list[int] = []
    for y in range(rows):
        now = _changes(pixels[y])
        line: list[str] = []
        two = kind == "t6" or kind == "t4-2d" and y > 0
        if kind in ("t4", "t4-2d"):
            if aligned:
                line.append("0" * (-(size + 12) % 8))
            line.append(EOL)
            if kind == "t4-2d":
                line.append("0" if two else "1")
        if two:
            _encode_two_d(line, now, before, width)
        else:
            edges = [0, *now, width]
            for i, (a, b) in enumerate(zip(edges, edges[1:])):
                _put_run(line, b - a, i % 2)
        text = "".join(line)
        if kind == "mh":
            text += "0" * (-len(text) % 8)
        size += len(text)
        out.append(text)
        before = now
    bits = "".join(out)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big") if bits else b""


def _encode_two_d(line: list[str], now: list[int], reference: list[int], width: int) -> None:
    a0, colour, start = 0, 0, True
    get = lambda seq, i: seq[i] if i < len(seq) else width
    while a0 < width:
        k = 0 if start else bisect_right(now, a0)
        while k < len(now) and k % 2 != colour:
            k += 1
        a1, a2 = get(now, k), get(now, k + 1)
        i = _b1(reference, a0, colour, start)
        b1, b2 = get(reference, i), get(reference, i + 1)
        if b2 < a1:
            line.append(PASS)
            a0 = b2
        elif abs(a1 - b1) <= 3:
            line.append(VERTICAL[a1 - b1])
            a0, colour = a1, colour ^ 1
        else:
            line.append(HORIZONTAL)
            _put_run(line, a1 - a0, colour)
            _put_run(line, a2 - a1, colour ^ 1)
            a0 = a2
        start = False
