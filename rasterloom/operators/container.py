"""Container parsing: header, directories, entries and their values.

``content`` is bytes, or anything with a length whose slices are bytes (ranges of a file).
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

from ..functions.constants import FIELD_TYPES, UNSIGNED
from .errors import Invalid


@dataclass(frozen=True)
class Header:
    order: str  # '<' or '>'
    big: bool
    first: int

    @property
    def byte_order(self) -> str:
        return "II" if self.order == "<" else "MM"

    @property
    def variant(self) -> str:
        return "big" if self.big else "classic"


@dataclass(frozen=True)
class Entry:
    tag: int
    kind: int
    count: int
    data: bytes
    order: str

    def unsigned(self) -> tuple[int, ...]:
        if self.kind not in UNSIGNED:
            raise Invalid(f"tag {self.tag}: field type {self.kind} isn't an unsigned integer")
        return struct.unpack(f"{self.order}{self.count}{FIELD_TYPES[self.kind][2]}", self.data)

    def unsigned32(self) -> tuple[int, ...]:
        values = self.unsigned()
        if any(v > 0xFFFFFFFF for v in values):
            raise Invalid(f"tag {self.tag}: value beyond 32 bits")
        return values

    def scalar(self) -> int:
        values = self.unsigned32()
        if not values:
            raise Invalid(f"tag {self.tag}: no value")
        return values[0]

    def pairs(self) -> list[tuple[int, int]]:
        v = struct.unpack(f"{self.order}{2 * self.count}{FIELD_TYPES[self.kind][2]}", self.data)
        return list(zip(v[::2], v[1::2]))

    def floats(self) -> tuple[float, ...]:
        if self.kind in (5, 10):
            return tuple(a / b if b else 0.0 for a, b in self.pairs())
        if self.kind in (6, 8, 9, 11, 12):
            return tuple(float(v) for v in struct.unpack(f"{self.order}{self.count}{FIELD_TYPES[self.kind][2]}", self.data))
        return tuple(float(v) for v in self.unsigned())

    def text(self) -> str:
        if self.kind != 2:
            raise Invalid(f"tag {self.tag}: not text")
        return self.data.split(b"\0", 1)[0].decode("utf-8", "replace")


def _unpack(form: str, content: bytes, at: int) -> tuple:
    return struct.unpack(form, content[at : at + struct.calcsize(form)])


def parse_header(content: bytes) -> Header:
    if len(content) < 8:
        raise Invalid("shorter than a header")
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if order is None:
        raise Invalid("no byte order mark")
    (magic,) = _unpack(f"{order}H", content, 2)
    if magic == 42:
        return Header(order, False, _unpack(f"{order}I", content, 4)[0])
    if magic != 43:
        raise Invalid(f"magic number {magic}")
    if len(content) < 16:
        raise Invalid("shorter than a BigTIFF header")
    size, zero, first = _unpack(f"{order}HHQ", content, 4)
    if size != 8 or zero:
        raise Invalid("BigTIFF offset size")
    return Header(order, True, first)


def parse_directory(content: bytes, header: Header, offset: int) -> tuple[list[Entry], int]:
    """(entries in file order, offset of the next directory)."""
    o, total = header.order, len(content)
    head, slot, step, next_form = ("Q", 8, 20, "Q") if header.big else ("H", 4, 12, "I")
    head_size = struct.calcsize(f"={head}")
    if offset + head_size > total:
        raise Invalid("directory lies outside the file")
    (count,) = _unpack(f"{o}{head}", content, offset)
    start = offset + head_size
    tail = start + count * step
    if tail + slot > total:
        raise Invalid("directory is cut off")
    entries = []
    table = content[start : tail + slot]
    for k in range(count):
        at = start + k * step
        tag, kind, n = struct.unpack_from(f"{o}HH{'Q' if header.big else 'I'}", table, at - start)
        place = at + step - slot
        if kind not in FIELD_TYPES:
            entries.append(Entry(tag, kind, n, content[place : place + slot], o))
            continue
        size = FIELD_TYPES[kind][1] * n
        if size > slot:
            (place,) = struct.unpack_from(f"{o}{next_form}", table, place - start)
        if place + size > total:
            raise Invalid(f"tag {tag}: value lies outside the file")
        entries.append(Entry(tag, kind, n, content[place : place + size], o))
    return entries, struct.unpack_from(f"{o}{next_form}", table, tail - start)[0]


def walk(content: bytes) -> list[tuple[int, list[Entry]]]:
    """(offset, entries) of each directory of the main chain; a cycle or an empty chain is an error."""
    header = parse_header(content)
    out, seen, at = [], set(), header.first
    while at:
        if at in seen:
            raise Invalid("the chain of directories has a cycle")
        seen.add(at)
        entries, after = parse_directory(content, header, at)
        out.append((at, entries))
        at = after
    if not out:
        raise Invalid("no directory")
    return out


def find(entries: list[Entry], tag: int) -> Entry | None:
    return next((e for e in entries if e.tag == tag), None)


def number(entries: list[Entry], tag: int, default: int | None = None) -> int:
    e = find(entries, tag)
    if e is None:
        if default is None:
            raise Invalid(f"tag {tag} is missing")
        return default
    return e.scalar()


def numbers(entries: list[Entry], tag: int) -> tuple[int, ...] | None:
    e = find(entries, tag)
    return None if e is None else e.unsigned()


def probe(head: bytes, path: str = "") -> int:
    """100 for a known signature, 50 for a known extension, else 0."""
    if head[:4] in (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+"):
        return 100
    return 50 if path.lower().endswith((".tif", ".tiff")) else 0
