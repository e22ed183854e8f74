"""Baseline sequential JPEG: entropy decoding in Python, dequantisation and inverse DCT for all blocks at once in NumPy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..operators.errors import Invalid, Unsupported


def _zigzag() -> np.ndarray:
    """Raster place of each coefficient in zig-zag order: diagonals, in turn down and up."""
    cells = sorted(((x + y, y if (x + y) % 2 else x, y * 8 + x) for y in range(8) for x in range(8)))
    return np.array([c[2] for c in cells])


ZIGZAG = _zigzag()
_K = np.arange(8)
DCT = np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16) * np.where(_K[:, None] == 0, np.sqrt(0.125), 0.5)


@dataclass
class Component:
    name: int
    h: int
    v: int
    quant: int
    dc: int = 0
    ac: int = 0
    blocks: list = field(default_factory=list)


@dataclass
class Picture:
    """Planes at their own resolution, the sampling factors and the transform that an Adobe marker names (None without it)."""

    width: int
    height: int
    planes: list[np.ndarray]
    factors: list[tuple[int, int]]
    adobe: int | None


def splice(tables: bytes | None, segment: bytes) -> bytes:
    """A segment that has its tables elsewhere becomes a stream of its own."""
    if segment[:2] != b"\xff\xd8":
        raise Invalid("JPEG: the segment has no start marker")
    if tables is None:
        return segment
    if tables[:2] != b"\xff\xd8" or tables[-2:] != b"\xff\xd9":
        raise Invalid("JPEG: the tables have no start or end marker")
    return b"\xff\xd8" + tables[2:-2] + segment[2:]


def _huffman(body: bytes) -> dict[tuple[int, int], list]:
    out, at = {}, 0
    while at + 17 <= len(body):
        kind, counts = body[at], body[at + 1 : at + 17]
        at += 17
        table: list = [None] * 65536
        code = 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                if at >= len(body):
                    raise Invalid("JPEG: Huffman table is cut off")
                first = code << (16 - length)
                table[first : first + (1 << (16 - length))] = [(length, body[at])] * (1 << (16 - length))
                at += 1
                code += 1
            code <<= 1
        out[kind >> 4, kind & 15] = table[:65536]
    return out


class _Scan:
    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.bits = data, 0, 0, 0

    def fill(self) -> None:
        d = self.data
        while self.bits <= 24:
            byte = 0
            if self.at < len(d):
                byte = d[self.at]
                if byte == 0xFF:
                    if self.at + 1 < len(d) and d[self.at + 1] == 0:
                        self.at += 2
                    else:
                        byte = 0  # a marker: zeros until the restart or the end
                else:
                    self.at += 1
            self.held = (self.held << 8 | byte) & 0xFFFFFFFFFF
            self.bits += 8

    def symbol(self, table: list) -> int:
        self.fill()
        found = table[(self.held >> (self.bits - 16)) & 0xFFFF]
        if found is None:
            raise Invalid("JPEG: no such Huffman code")
        self.bits -= found[0]
        return found[1]

    def receive(self, n: int) -> int:
        if not n:
            return 0
        self.fill()
        self.bits -= n
        v = (self.held >> self.bits) & ((1 << n) - 1)
        return v if v >> (n - 1) else v - (1 << n) + 1

    def restart(self) -> None:
        self.held = self.bits = 0
        d = self.data
        while self.at + 1 < len(d) and not (d[self.at] == 0xFF and 0xD0 <= d[self.at + 1] <= 0xD7):
            self.at += 1
        self.at += 2


def decode(stream: bytes) -> Picture:
    quant: dict[int, np.ndarray] = {}
    huff: dict[tuple[int, int], list] = {}
    parts: list[Component] = []
    width = height = interval = 0
    adobe = None
    at = 2
    if stream[:2] != b"\xff\xd8":
        raise Invalid("JPEG: no start marker")
    while at + 4 <= len(stream):
        if stream[at] != 0xFF:
            at += 1
            continue
        marker = stream[at + 1]
        if marker in (0xFF, 0x00, 0x01) or 0xD0 <= marker <= 0xD8:
            at += 1 if marker == 0xFF else 2
            continue
        if marker == 0xD9:
            break
        size = int.from_bytes(stream[at + 2 : at + 4], "big")
        body = stream[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            i = 0
            while i < len(body):
                wide, n = body[i] >> 4, body[i] & 15
                step = 128 if wide else 64
                values = np.frombuffer(body[i + 1 : i + 1 + step], ">u2" if wide else np.uint8)
                if len(values) != 64:
                    raise Invalid("JPEG: quantisation table is cut off")
                quant[n] = values.astype(np.int64)
                i += 1 + step
        elif marker == 0xC4:
            huff |= _huffman(body)
        elif marker in (0xC0, 0xC1):
            if len(body) < 6 or body[0] != 8:
                raise Unsupported("JPEG: only 8-bit samples")
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            if not width or not height or any(not p.h or not p.v for p in parts):
                raise Invalid("JPEG: empty frame")
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise Unsupported("JPEG: only baseline sequential streams")
        elif marker == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif marker == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
            adobe = body[11]
        elif marker == 0xDA:
            if not parts:
                raise Invalid("JPEG: scan before a frame")
            chosen = []
            for i in range(body[0]):
                part = next((p for p in parts if p.name == body[1 + 2 * i]), None)
                if part is None:
                    raise Invalid("JPEG: scan of an unknown component")
                part.dc, part.ac = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
                chosen.append(part)
            at = _scan(stream, at, chosen, parts, width, height, huff, interval)
    if not parts or any(not len(p.blocks) for p in parts):
        raise Invalid("JPEG: no picture")
    return _planes(parts, width, height, quant, adobe)


def _scan(stream: bytes, at: int, chosen: list[Component], parts: list[Component], width: int, height: int, huff: dict, interval: int) -> int:
    end = at
    while True:
        end = stream.find(b"\xff", end)
        if end < 0 or end + 1 >= len(stream):
            end = len(stream)
            break
        if stream[end + 1] != 0 and not 0xD0 <= stream[end + 1] <= 0xD7:
            break
        end += 2
    s = _Scan(stream[at:end])
    hm, vm = max(p.h for p in parts), max(p.v for p in parts)
    single = len(chosen) == 1
    if single:
        p = chosen[0]
        across, down = -(-(-(-width * p.h // hm)) // 8), -(-(-(-height * p.v // vm)) // 8)
    else:
        across, down = -(-width // (8 * hm)), -(-height // (8 * vm))
    for p in chosen:
        p.across = -(-width // (8 * hm)) * p.h
        p.blocks = np.zeros((-(-height // (8 * vm)) * p.v * p.across, 64), np.int32)
        if (0, p.dc) not in huff or (1, p.ac) not in huff:
            raise Invalid("JPEG: a scan names a table that isn't there")
    last = dict.fromkeys(range(len(chosen)), 0)
    for unit in range(across * down):
        if interval and unit and unit % interval == 0:
            s.restart()
            last = dict.fromkeys(range(len(chosen)), 0)
        uy, ux = divmod(unit, across)
        for k, p in enumerate(chosen):
            dc, ac = huff[0, p.dc], huff[1, p.ac]
            for by in range(1 if single else p.v):
                for bx in range(1 if single else p.h):
                    block = p.blocks[(uy * (1 if single else p.v) + by) * p.across + ux * (1 if single else p.h) + bx]
                    n = s.symbol(dc)
                    if n > 15:
                        raise Invalid("JPEG: DC size")
                    last[k] += s.receive(n)
                    block[0] = last[k]
                    i = 1
                    while i < 64:
                        rs = s.symbol(ac)
                        if rs & 15 == 0:
                            if rs != 0xF0:
                                break
                            i += 16
                            continue
                        i += rs >> 4
                        if i > 63:
                            raise Invalid("JPEG: run beyond the block")
                        block[i] = s.receive(rs & 15)
                        i += 1
    return end


def _planes(parts: list[Component], width: int, height: int, quant: dict, adobe: int | None) -> Picture:
    hm, vm = max(p.h for p in parts), max(p.v for p in parts)
    planes = []
    for p in parts:
        if p.quant not in quant:
            raise Invalid("JPEG: a component names a quantisation table that isn't there")
        coefficients = np.zeros((len(p.blocks), 64))
        coefficients[:, ZIGZAG] = p.blocks * quant[p.quant]
        pixels = DCT.T @ coefficients.reshape(-1, 8, 8) @ DCT
        rows = len(p.blocks) // p.across
        plane = pixels.reshape(rows, p.across, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, p.across * 8)
        w, h = -(-width * p.h // hm), -(-height * p.v // vm)
        planes.append(np.clip(np.floor(plane[:h, :w] + 128.5), 0, 255).astype(np.uint8))
    return Picture(width, height, planes, [(hm // p.h, vm // p.v) for p in parts], adobe)


def full_size(picture: Picture) -> np.ndarray:
    """Components at full resolution (nearest neighbour): rows, columns, components."""
    out = []
    for plane, (sh, sv) in zip(picture.planes, picture.factors):
        out.append(np.repeat(np.repeat(plane, sv, axis=0), sh, axis=1)[: picture.height, : picture.width])
    return np.stack(out, axis=-1)
