"""Writing of pages: checks, segments, directory entries, layout of the file.  Always little-endian."""

from __future__ import annotations

import re
import struct
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

from ..functions import ccitt, codecs, pixels, webp
from ..functions import constants as K
from ..operators.errors import Invalid, Unsupported

# kind -> (photometric, samples, bits, sample format)
KINDS: dict[str, tuple[int, int, int, int]] = {
    "bilevel": (K.WHITE_IS_ZERO, 1, 1, 1), "mask": (K.MASK, 1, 1, 1), "gray4": (K.BLACK_IS_ZERO, 1, 4, 1), "gray8": (K.BLACK_IS_ZERO, 1, 8, 1),
    "gray16": (K.BLACK_IS_ZERO, 1, 16, 1), "rgb24": (K.RGB, 3, 8, 1), "rgb48": (K.RGB, 3, 16, 1), "rgba32": (K.RGB, 4, 8, 1),
    "palette8": (K.PALETTE, 1, 8, 1), "palette4": (K.PALETTE, 1, 4, 1), "gray_i8": (K.BLACK_IS_ZERO, 1, 8, 2), "gray_i16": (K.BLACK_IS_ZERO, 1, 16, 2),
    "gray_f16": (K.BLACK_IS_ZERO, 1, 16, 3), "gray_f32": (K.BLACK_IS_ZERO, 1, 32, 3), "gray_f64": (K.BLACK_IS_ZERO, 1, 64, 3),
    "rgb_f16": (K.RGB, 3, 16, 3), "rgb_f32": (K.RGB, 3, 32, 3), "rgb_f64": (K.RGB, 3, 64, 3), "lab8": (K.CIELAB, 3, 8, 1), "lab_l8": (K.CIELAB, 1, 8, 1),
    "cmyk32": (K.SEPARATED, 4, 8, 1), "ycbcr24": (K.YCBCR, 3, 8, 1), "ycbcr_sub24": (K.YCBCR, 3, 8, 1),
}
MAX_DEPTH = 8


@dataclass
class Page:
    """samples: (height, width) or (height, width, components) values of the kind; floats of 16 bits as float16."""

    samples: np.ndarray
    kind: str
    compression: str = "none"
    predictor: bool = False
    planar: bool = False
    tile: tuple[int, int] | None = None
    rows_per_strip: int | None = None
    big: bool = False
    subsampling: tuple[int, int] = (2, 2)
    palette: Sequence[tuple[int, int, int]] = ()
    associated_alpha: bool = False
    t4_two_d: bool = False
    metadata: dict = field(default_factory=dict)
    exif: Sequence[tuple[int, int, int, bytes]] = ()
    gps: Sequence[tuple[int, int, int, bytes]] = ()
    children: Sequence[Page] = ()
    reduced: bool = False
    multi_page: bool = False


Slot = tuple[int, int, int, bytes]  # tag, field type, count, value bytes


def _short(tag: int, *v: int) -> Slot:
    return tag, 3, len(v), struct.pack(f"<{len(v)}H", *v)


def _long(tag: int, *v: int) -> Slot:
    return tag, 4, len(v), struct.pack(f"<{len(v)}I", *v)


def check(p: Page) -> np.ndarray:
    """The samples as (rows, columns, components), or why the page can't be written."""
    if p.kind not in KINDS:
        raise Unsupported(f"kind {p.kind}")
    photometric, n, bits, form = KINDS[p.kind]
    if p.compression not in ("none", "packbits", "lzw", "deflate", "zstd", "ccitt_mh", "ccitt_t4", "ccitt_t6", "webp"):
        raise Unsupported(f"writing {p.compression}")
    s = np.asarray(p.samples)
    s = s[:, :, None] if s.ndim == 2 else s
    if s.ndim != 3 or not s.shape[0] or not s.shape[1] or s.shape[2] != n:
        raise Invalid(f"samples of shape {s.shape} for {p.kind}")
    if p.compression == "webp" and (p.kind not in ("rgb24", "rgba32") or p.planar or p.predictor):
        raise Invalid("WebP is for RGB and RGBA of 8 bits, in one plane, without predictor")
    fax = p.compression.startswith("ccitt")
    if fax and bits != 1:
        raise Invalid("CCITT is for one bit a pixel")
    if fax and p.tile:
        raise Invalid("no CCITT in tiles")
    if p.planar and n == 1:
        raise Invalid("separate planes of one component")
    if p.predictor and (bits == 1 or fax):
        raise Invalid("no predictor on one bit a pixel")
    if p.tile and (not all(p.tile) or p.tile[0] % 16 or p.tile[1] % 16):
        raise Invalid("tile sides are multiples of 16")
    if p.rows_per_strip is not None and (p.rows_per_strip <= 0 or p.tile):
        raise Invalid("rows_per_strip is positive and not for tiles")
    if p.kind == "ycbcr_sub24":
        if p.subsampling not in ((1, 1), (2, 1), (2, 2), (4, 1), (4, 2)):
            raise Invalid(f"subsampling {p.subsampling}")
        if p.subsampling != (1, 1):
            if p.tile and p.planar:
                raise Invalid("no subsampled planes in tiles")
            if p.predictor and not p.planar:
                raise Invalid("no predictor on subsampled units")
            if p.rows_per_strip and p.rows_per_strip % p.subsampling[1]:
                raise Invalid("strips would cut chroma units")
    if p.kind.startswith("palette") and not 1 <= len(p.palette) <= 1 << bits:
        raise Invalid("palette size")
    if form != 3 and bits in (1, 4) and s.max() >> bits:
        raise Invalid("sample beyond its depth")
    return s


def _pack(p: Page, s: np.ndarray, components: int) -> bytes:
    """One segment: predictor, packing, compression."""
    _, _, bits, form = KINDS[p.kind]
    if p.predictor and form == 3:
        data = pixels.float_planes(s, bits // 8)
    else:
        if form != 3:
            s = s.astype({8: np.uint8, 16: np.uint16}.get(bits, np.uint8), copy=False) if form == 1 else s.astype(f"i{bits // 8}").view(f"u{bits // 8}")
        else:
            s = s.astype(f"f{bits // 8}")
        data = pixels.pack(pixels.difference(s, bits) if p.predictor else s, bits)
    return compress(p, data, s.shape[1], s.shape[0])


def compress(p: Page, data: bytes, width: int, rows: int) -> bytes:
    if p.compression.startswith("ccitt"):
        kind = {"ccitt_mh": "mh", "ccitt_t4": "t4-2d" if p.t4_two_d else "t4", "ccitt_t6": "t6"}[p.compression]
        return ccitt.encode(data, width, rows, kind)
    if p.compression == "webp":
        return webp.encode(np.frombuffer(data, np.uint8).reshape(rows, width, -1))
    coder = {"none": bytes, "packbits": _rows_of_packbits(len(data) // rows if rows else 0), "lzw": codecs.lzw_encode, "deflate": codecs.deflate_encode, "zstd": codecs.zstd_encode}
    return coder[p.compression](data)


def _rows_of_packbits(row: int):
    """Rows are packed one by one, as the format asks."""
    return lambda data: b"".join(codecs.packbits_encode(data[a : a + row]) for a in range(0, len(data), row)) if row else b""


def segments(p: Page, s: np.ndarray) -> list[bytes]:
    h, w, n = s.shape
    sub = p.subsampling if p.kind == "ycbcr_sub24" and p.subsampling != (1, 1) else None
    out: list[bytes] = []
    planes = [s[:, :, i : i + 1] for i in range(n)] if p.planar else [s]
    for k, plane in enumerate(planes):
        rows = p.rows_per_strip or h
        if p.planar and sub and k:
            plane = pixels.box_mean(plane[:, :, 0], *sub)[:, :, None]
            rows = -(-rows // sub[1])
        if p.tile:
            tw, th = p.tile
            ph, pw = plane.shape[:2]
            for y in range(0, ph, th):
                for x in range(0, pw, tw):
                    part = plane[np.minimum(np.arange(y, y + th), ph - 1)][:, np.minimum(np.arange(x, x + tw), pw - 1)]
                    out.append(compress(p, pixels.split_units(part, *sub), tw, th) if sub else _pack(p, part, part.shape[2]))
        else:
            for y in range(0, plane.shape[0], rows):
                part = plane[y : y + rows]
                out.append(compress(p, pixels.split_units(part, *sub), w, part.shape[0]) if sub and not p.planar else _pack(p, part, part.shape[2]))
    return out


def _text(tag: int, value: str) -> Slot:
    if not value.isascii():
        raise Invalid(f"tag {tag}: text is 7-bit")
    data = value.encode() + b"\0"
    return tag, 2, len(data), data


def metadata_slots(m: dict) -> list[Slot]:
    out: list[Slot] = []
    for name, tag in K.TEXT_FIELDS.items():
        if m.get(name) is not None:
            if name == "date_time" and not re.fullmatch(r"\d{4}:\d\d:\d\d \d\d:\d\d:\d\d", m[name]):
                raise Invalid("DateTime is YYYY:MM:DD HH:MM:SS")
            out.append(_text(tag, m[name]))
    for name, tag in (("x_resolution", K.X_RESOLUTION), ("y_resolution", K.Y_RESOLUTION)):
        if m.get(name) is not None:
            if not m[name][1]:
                raise Invalid("resolution with denominator zero")
            out.append((tag, 5, 1, struct.pack("<II", *m[name])))
    for name, tag, allowed in (("resolution_unit", K.RESOLUTION_UNIT, range(1, 4)), ("orientation", K.ORIENTATION, range(1, 9))):
        if m.get(name) is not None:
            if m[name] not in allowed:
                raise Invalid(f"{name} {m[name]}")
            out.append(_short(tag, m[name]))
    if m.get("page_number") is not None:
        out.append(_short(K.PAGE_NUMBER, *m["page_number"]))
    if m.get("xmp") is not None:
        if not m["xmp"]:
            raise Invalid("XMP is empty")
        out.append((K.XMP, 1, len(m["xmp"]), bytes(m["xmp"])))
    if (icc := m.get("icc_profile")) is not None:
        if len(icc) < 128 or int.from_bytes(icc[:4], "big") != len(icc):
            raise Invalid("ICC profile's length field")
        out.append((K.ICC_PROFILE, 7, len(icc), bytes(icc)))
    return out


def page_slots(p: Page, s: np.ndarray, count: int) -> list[Slot]:
    """Entries other than segment places and child directories."""
    photometric, n, bits, form = KINDS[p.kind]
    h, w, _ = s.shape
    subfile = int(p.reduced) | 2 * int(p.multi_page) | 4 * int(p.kind == "mask")
    out = [_long(K.NEW_SUBFILE_TYPE, subfile), _long(K.WIDTH, w), _long(K.LENGTH, h), _short(K.BITS_PER_SAMPLE, *[bits] * n), _short(K.COMPRESSION, K.CODES[p.compression]) if K.CODES[p.compression] < 65536 else _long(K.COMPRESSION, K.CODES[p.compression])]
    out += [_short(K.PHOTOMETRIC, photometric), _short(K.SAMPLES_PER_PIXEL, n), _short(K.PLANAR, 2 if p.planar else 1)]
    if p.tile:
        out += [_long(K.TILE_WIDTH, p.tile[0]), _long(K.TILE_LENGTH, p.tile[1])]
    else:
        out.append(_long(K.ROWS_PER_STRIP, p.rows_per_strip or h))
    if p.predictor:
        out.append(_short(K.PREDICTOR, 3 if form == 3 else 2))
    if form != 1:
        out.append(_short(K.SAMPLE_FORMAT, *[form] * n))
    if p.kind == "rgba32":
        out.append(_short(K.EXTRA_SAMPLES, 1 if p.associated_alpha else 2))
    if p.compression == "ccitt_t4":
        out.append(_long(K.T4_OPTIONS, int(p.t4_two_d)))
    if p.compression == "ccitt_t6":
        out.append(_long(K.T6_OPTIONS, 0))
    if p.kind.startswith("palette"):
        full = np.zeros((1 << bits, 3), np.uint16)
        full[: len(p.palette)] = np.asarray(p.palette, np.uint16) * 257
        out.append((K.COLOR_MAP, 3, 3 << bits, full.T.astype("<u2").tobytes()))
    if p.kind == "cmyk32":
        out += [_short(K.INK_SET, 1), _short(K.NUMBER_OF_INKS, 4)]
    if photometric == K.YCBCR:
        sub = p.subsampling if p.kind == "ycbcr_sub24" else (1, 1)
        white = struct.pack("<12I", *[v for a, b in ((0, 255), (128, 255), (128, 255)) for v in (a, 1, b, 1)])
        out += [_short(K.YCBCR_SUBSAMPLING, *sub), _short(K.YCBCR_POSITIONING, 1), (K.REFERENCE_BLACK_WHITE, 5, 6, white)]
    return out + metadata_slots(p.metadata)


def _aux(slots: Sequence[Slot], big: bool) -> list[Slot]:
    done = sorted(slots, key=lambda x: x[0])
    for (a, *_), (b, *_) in zip(done, done[1:]):
        if a == b:
            raise Invalid(f"tag {a} twice")
    for tag, kind, count, data in done:
        if kind not in K.FIELD_TYPES or K.FIELD_TYPES[kind][1] * count != len(data):
            raise Invalid(f"tag {tag}: type or size")
        if kind >= 16 and not big:
            raise Invalid(f"tag {tag}: 64-bit type in a classic file")
    return done


class Writer:
    def __init__(self, big: bool):
        self.big, self.base = big, 0  # base: where ``out`` begins in the file
        self.out = bytearray(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0) if big else struct.pack("<2sHI", b"II", 42, 0))
        self.link = 8 if big else 4  # where the next directory's offset goes

    def blob(self, data: bytes, align: int = 2) -> int:
        self.out += bytes(-(self.base + len(self.out)) % align)
        at = self.base + len(self.out)
        self.out += data
        return at

    def places(self, tag: int, values: Sequence[int]) -> Slot:
        return (tag, 16, len(values), struct.pack(f"<{len(values)}Q", *values)) if self.big else _long(tag, *values)

    def directory(self, slots: list[Slot]) -> tuple[int, int]:
        """(offset, where its link to the next directory is)."""
        room, body = (8 if self.big else 4), b""
        for tag, kind, count, data in sorted(slots, key=lambda x: x[0]):
            value = data.ljust(room, b"\0") if len(data) <= room else struct.pack("<Q" if self.big else "<I", self.blob(data))
            body += struct.pack("<HHQ" if self.big else "<HHI", tag, kind, count) + value
        at = self.blob(struct.pack("<Q" if self.big else "<H", len(slots)) + body + bytes(room))
        return at, self.base + len(self.out) - room

    def page(self, p: Page, depth: int = 0) -> tuple[int, int]:
        if depth > MAX_DEPTH:
            raise Invalid("directories nested too deep")
        if p.big != self.big:
            raise Invalid("pages of one file are all classic or all BigTIFF")
        s = check(p)
        parts = segments(p, s)
        slots = page_slots(p, s, len(parts))
        at = [self.blob(x) for x in parts]
        tags = (K.TILE_OFFSETS, K.TILE_BYTE_COUNTS) if p.tile else (K.STRIP_OFFSETS, K.STRIP_BYTE_COUNTS)
        slots += [self.places(tags[0], at), self.places(tags[1], [len(x) for x in parts])]
        if p.children:
            slots.append(self.places(K.SUB_IFDS, [self.page(c, depth + 1)[0] for c in p.children]))
        for tag, aux in ((K.EXIF, p.exif), (K.GPS, p.gps)):
            if aux:
                slots.append(self.places(tag, [self.directory(_aux(aux, self.big))[0]]))
        return self.directory(slots)

    def add(self, p: Page) -> None:
        at, link = self.page(p)
        self._patch(self.link, at)
        self.link = link

    def _patch(self, where: int, at: int) -> None:
        if not self.big and len(self.out) > 0xFFFFFFFF:
            raise Invalid("beyond 4 GiB: write a BigTIFF")
        struct.pack_into("<Q" if self.big else "<I", self.out, where, at)


def encode(pages: Sequence[Page]) -> bytes:
    if not pages:
        raise Invalid("no page")
    w = Writer(pages[0].big)
    for p in pages:
        w.add(p)
    return bytes(w.out)
