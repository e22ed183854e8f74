"""Decoding of one page: layout, segments, assembly, colour, orientation.  Pure functions on bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..functions import ccitt, codecs, jpeg, pixels, webp
from ..functions import constants as K
from .container import Entry, find, number, numbers, parse_directory, parse_header, walk
from .errors import Invalid, RasterError, Unsupported


@dataclass(frozen=True)
class Layout:
    width: int
    height: int
    samples: int
    bits: int
    compression: str
    photometric: int
    planar: bool
    predictor: int
    kind: str  # unsigned, signed or float
    orientation: int
    reverse: bool
    t4: int
    t6: int
    units: tuple[int, int] | None  # chroma subsampling of uncompressed-like YCbCr
    tile: tuple[int, int] | None
    rows_per_strip: int
    order: str

    @property
    def components(self) -> int:
        return 1 if self.planar else self.samples


@dataclass(frozen=True)
class Segment:
    plane: int
    index: int
    x: int
    y: int
    width: int
    height: int
    seen_width: int
    seen_height: int
    offset: int
    size: int


@dataclass(frozen=True)
class Image:
    width: int
    height: int
    pixel_format: str
    data: bytes

    @property
    def stride(self) -> int:
        return self.width * {"Gray8": 1, "Gray16Le": 2, "Rgb24": 3, "Rgb48Le": 6}[self.pixel_format]


COLOURS = {K.WHITE_IS_ZERO: (1,), K.BLACK_IS_ZERO: (1,), K.PALETTE: (1,), K.MASK: (1,), K.RGB: (3,), K.YCBCR: (3,), K.SEPARATED: (4,), K.CIELAB: (3, 1)}


def read_layout(entries: list[Entry], order: str) -> Layout:
    """The page's parameters, checked in the order in which a reader meets them."""
    width, height = number(entries, K.WIDTH), number(entries, K.LENGTH)
    if not width or not height:
        raise Invalid("width or height is zero")
    if width * height > K.MAX_PIXELS:
        raise Invalid("more pixels than allowed")
    code = number(entries, K.COMPRESSION, 1)
    photometric = number(entries, K.PHOTOMETRIC)
    samples = number(entries, K.SAMPLES_PER_PIXEL, 1)
    if not 1 <= samples <= 0xFFFF:
        raise Invalid("SamplesPerPixel out of range")
    planar = number(entries, K.PLANAR, 1)
    if planar not in (1, 2):
        raise Invalid(f"PlanarConfiguration {planar}")
    predictor = number(entries, K.PREDICTOR, 1)
    if predictor not in (1, 2, 3):
        raise Unsupported(f"Predictor {predictor}")
    formats = numbers(entries, K.SAMPLE_FORMAT) or (1,)
    if len(formats) not in (1, samples) or len(set(formats)) > 1 or formats[0] not in (1, 2, 3, 4):
        raise Invalid("SampleFormat")
    kind = {1: "unsigned", 2: "signed", 3: "float", 4: "unsigned"}[formats[0]]
    orientation = number(entries, K.ORIENTATION, 1)
    if not 1 <= orientation <= 8:
        raise Invalid(f"Orientation {orientation}")
    if find(entries, K.RESOLUTION_UNIT) and number(entries, K.RESOLUTION_UNIT) not in (1, 2, 3):
        raise Invalid("ResolutionUnit")
    extra = numbers(entries, K.EXTRA_SAMPLES)
    if extra is not None:
        colours = COLOURS.get(photometric)
        if colours and not any(samples == c + len(extra) for c in colours):
            raise Invalid("ExtraSamples don't fit SamplesPerPixel")
        if any(v > 2 for v in extra):
            raise Invalid("unknown ExtraSamples")
    depths = numbers(entries, K.BITS_PER_SAMPLE)
    if depths is None:
        depths = (1,) * samples
    if len(depths) != samples:
        raise Invalid("BitsPerSample count isn't SamplesPerPixel")
    if len(set(depths)) > 1:
        raise Unsupported("samples of different depth")
    bits = depths[0]
    if bits not in (1, 4, 8, 16) and not (kind == "float" and bits in (32, 64)):
        raise Unsupported(f"{bits} bits per sample")
    if predictor == 3 and not (kind == "float" and bits in (16, 32, 64)):
        raise Invalid("floating-point predictor without floats")
    fill = number(entries, K.FILL_ORDER, 1)
    if fill not in (1, 2):
        raise Invalid(f"FillOrder {fill}")
    compression = K.COMPRESSIONS.get(code)
    if compression is None:
        raise Unsupported(f"Compression {code}")
    if fill == 2 and not (bits == 1 and (compression == "none" or compression.startswith("ccitt"))):
        raise Unsupported("FillOrder 2 with this compression or depth")
    planar = planar == 2 and samples > 1
    if compression in ("jpeg", "jpeg_old") and planar:
        raise Unsupported("JPEG in separate planes")
    if compression == "webp":
        if photometric != K.RGB or bits != 8 or samples not in (3, 4) or planar or predictor != 1 or kind != "unsigned":
            raise Invalid("WebP segments with this layout")
    if kind == "signed" and not (bits in (8, 16) and samples == 1 and photometric in (0, 1)):
        raise Unsupported("signed samples other than one channel of 8 or 16 bits")
    if kind == "float":
        if not (photometric in (0, 1) and samples == 1 or photometric == K.RGB and samples == 3) or bits not in (16, 32, 64):
            raise Unsupported("float samples other than gray or RGB")
        if predictor == 2:
            raise Invalid("horizontal predictor on floats")
    if compression.startswith("ccitt") and (bits != 1 or samples != 1):
        raise Invalid("CCITT with other than one bit a pixel")
    t6 = number(entries, K.T6_OPTIONS, 0)
    if compression == "ccitt_t6" and t6 & ~2:
        raise Unsupported("T6Options")
    if predictor == 2 and bits == 1:
        raise Invalid("horizontal predictor on 1-bit samples")
    units = None
    if photometric == K.YCBCR and bits == 8 and samples == 3 and not compression.startswith("jpeg"):
        sub = numbers(entries, K.YCBCR_SUBSAMPLING) or (2, 2)
        if len(sub) < 2:
            raise Invalid("YCbCrSubSampling")
        if sub[:2] not in ((1, 1), (2, 1), (2, 2), (1, 2), (4, 1), (4, 2)):
            raise Unsupported(f"YCbCrSubSampling {sub[:2]}")
        units = None if sub[:2] == (1, 1) else tuple(sub[:2])
    tile = None
    if find(entries, K.TILE_WIDTH) or find(entries, K.TILE_OFFSETS):
        tile = number(entries, K.TILE_WIDTH), number(entries, K.TILE_LENGTH)
        if not all(tile):
            raise Invalid("a tile side is zero")
        if tile[0] * tile[1] > K.MAX_PIXELS:
            raise Invalid("more pixels in a tile than allowed")
        if tile[0] * bits * (1 if planar else samples) % 8:
            raise Unsupported("tile rows don't fill whole bytes")
    rows = number(entries, K.ROWS_PER_STRIP, height)
    if rows == 0:
        raise Invalid("RowsPerStrip is zero")
    if units:
        if planar and tile:
            raise Unsupported("subsampled YCbCr in planar tiles")
        if predictor != 1 and not planar:
            raise Unsupported("predictor on subsampled units")
        sides = tile or (units[0], min(rows, height))
        if sides[0] % units[0] or (sides[1] % units[1] and sides[1] < height):
            raise Invalid("segments cut chroma units")
    if planar and bits < 8:
        raise Unsupported("separate planes of less than 8 bits")
    return Layout(width, height, samples, bits, compression, photometric, planar, predictor, kind, orientation, fill == 2, number(entries, K.T4_OPTIONS, 0), t6, units, tile, min(rows, height), order)


def list_segments(entries: list[Entry], lay: Layout, total: int) -> list[Segment]:
    offsets = numbers(entries, K.TILE_OFFSETS if lay.tile else K.STRIP_OFFSETS)
    sizes = numbers(entries, K.TILE_BYTE_COUNTS if lay.tile else K.STRIP_BYTE_COUNTS)
    if offsets is None or sizes is None or len(offsets) != len(sizes):
        raise Invalid("segment offsets and sizes are missing or differ in number")
    out: list[Segment] = []
    k = 0
    for plane in range(lay.samples if lay.planar else 1):
        w, h = lay.width, lay.height
        step_x, step_y = lay.tile or (w, lay.rows_per_strip)
        if lay.planar and lay.units and plane:
            w, h = -(-w // lay.units[0]), -(-h // lay.units[1])
            step_x, step_y = w, -(-step_y // lay.units[1])
        for y in range(0, h, step_y):
            for x in range(0, w, step_x):
                if k >= len(offsets):
                    raise Invalid("segments don't cover the image")
                if offsets[k] + sizes[k] > total:
                    raise Invalid("a segment lies outside the file")
                tall = step_y if lay.tile else min(step_y, h - y)
                out.append(Segment(plane, k, x, y, step_x, tall, min(step_x, w - x), min(tall, h - y), offsets[k], sizes[k]))
                k += 1
    if lay.tile and k != len(offsets):
        raise Invalid("more tiles than the grid has")
    return out


def expected_size(lay: Layout, seg: Segment) -> int:
    if lay.units and not lay.planar:
        return -(-seg.width // lay.units[0]) * -(-seg.height // lay.units[1]) * (lay.units[0] * lay.units[1] + 2)
    return (seg.width * lay.components * lay.bits + 7) // 8 * seg.height


def decompress(lay: Layout, seg: Segment, raw: bytes) -> bytes:
    size = expected_size(lay, seg)
    name = lay.compression
    if name.startswith("ccitt"):
        kind = {"ccitt_mh": "mh", "ccitt_t4": "t4-2d" if lay.t4 & 1 else "t4", "ccitt_t6": "t6"}[name]
        data = ccitt.decode(codecs.reverse_bits(raw) if lay.reverse else raw, seg.width, seg.height, kind, bool(lay.t4 & 4))
    else:
        if name == "none":
            data = codecs.reverse_bits(raw) if lay.reverse else raw
        elif name == "packbits":
            data = codecs.packbits_decode(raw, size)
        elif name == "lzw":
            data = codecs.lzw_decode(raw, size)
        elif name == "deflate":
            data = codecs.deflate_decode(raw, size)
        elif name == "zstd":
            data = codecs.zstd_decode(raw, size)
        elif name == "webp":
            data = webp.decode(raw, seg.width, seg.height)[..., : lay.samples].tobytes()
        else:
            raise Unsupported(f"compression {name}")
    if len(data) < size:
        raise Invalid("a segment decodes to too few bytes")
    return data[:size]


def segment_samples(lay: Layout, seg: Segment, raw: bytes) -> np.ndarray:
    """(rows, columns, components) of a whole segment, un-predicted."""
    data = decompress(lay, seg, raw)
    if lay.units and not lay.planar:
        return pixels.join_units(data, seg.width, seg.height, *lay.units)
    if lay.predictor == 3:
        return pixels.undo_float_planes(data, seg.height, seg.width * lay.components, lay.bits // 8).reshape(seg.height, seg.width, lay.components)
    s = pixels.unpack(data, seg.height, seg.width, lay.components, lay.bits, lay.order, lay.kind == "float")
    return pixels.undo_difference(s, lay.bits) if lay.predictor == 2 else s


def assemble(content: bytes, entries: list[Entry], lay: Layout) -> np.ndarray:
    """(height, width, samples) of the page."""
    planes: list[np.ndarray | None] = [None] * (lay.samples if lay.planar else 1)
    for seg in list_segments(entries, lay, len(content)):
        s = segment_samples(lay, seg, content[seg.offset : seg.offset + seg.size])
        if planes[seg.plane] is None:
            w, h = lay.width, lay.height
            if lay.planar and lay.units and seg.plane:
                w, h = -(-w // lay.units[0]), -(-h // lay.units[1])
            planes[seg.plane] = np.zeros((h, w, s.shape[2]), s.dtype.newbyteorder("="))
        planes[seg.plane][seg.y : seg.y + seg.seen_height, seg.x : seg.x + seg.seen_width] = s[: seg.seen_height, : seg.seen_width]
    if lay.planar and lay.units:
        sh, sv = lay.units
        planes = [p if not i else np.repeat(np.repeat(p, sv, axis=0), sh, axis=1)[: lay.height, : lay.width] for i, p in enumerate(planes)]
    return np.concatenate(planes, axis=2) if len(planes) > 1 else planes[0]


def tagged_bounds(entries: list[Entry]) -> tuple[float | None, float | None]:
    """Display bounds that the page's tags give; None where there is none or it isn't finite."""
    found = [next(iter(e.floats()), None) if e else None for e in (find(entries, t) for t in (K.S_MIN, K.S_MAX))]
    return tuple(v if v is not None and np.isfinite(v) else None for v in found)


def colour(s: np.ndarray, lay: Layout, entries: list[Entry], bounds: tuple[float | None, float | None] | None = None) -> tuple[str, np.ndarray]:
    """(pixel format, values) of assembled samples.  bounds: those of the page, if s is a part of it."""
    p, n, bits = lay.photometric, lay.samples, lay.bits
    invert = p == K.WHITE_IS_ZERO
    if lay.kind == "float":
        g = pixels.float_to_gray(s, *(bounds or tagged_bounds(entries)))
        return ("Rgb24", g) if n == 3 else ("Gray8", 255 - g if invert else g)
    if p in (K.WHITE_IS_ZERO, K.BLACK_IS_ZERO, K.MASK) and n == 1:
        if p == K.MASK and bits != 1:
            raise Invalid("a transparency mask has one bit")
        if bits == 16:
            v = s ^ np.uint16(0x8000) if lay.kind == "signed" else s
            return "Gray16Le", 65535 - v if invert else v
        v = s * np.uint8({1: 255, 4: 17, 8: 1}[bits])
        if lay.kind == "signed":
            v = v ^ np.uint8(0x80)
        return "Gray8", 255 - v if invert else v
    if p == K.RGB and bits == 8 and n >= 3:
        return "Rgb24", s[..., :3]
    if p == K.RGB and bits == 16 and n == 3:
        return "Rgb48Le", s
    if p == K.PALETTE and n == 1 and bits in (4, 8):
        words = numbers(entries, K.COLOR_MAP)
        if words is None or len(words) < 3 << bits:
            raise Invalid("ColorMap is missing or too short")
        return "Rgb24", pixels.colormap(np.asarray(words, np.int64), bits)[s[..., 0]]
    if p == K.SEPARATED and n == 4 and bits == 8:
        return "Rgb24", pixels.cmyk_to_rgb(s)
    if p == K.YCBCR and n == 3 and bits == 8:
        return "Rgb24", pixels.ycbcr_to_rgb(s[..., 0], s[..., 1], s[..., 2])
    if p == K.CIELAB and bits == 8 and n in (1, 3):
        return ("Rgb24", pixels.lab_to_rgb(s)) if n == 3 else ("Gray8", pixels.lab_light_to_gray(s))
    raise Invalid(f"no image with photometric {p}, {n} samples of {bits} bits")


# ------------------------------------------------------------------ JPEG pages


def _jpeg_colour(picture: jpeg.Picture, lay: Layout) -> np.ndarray:
    n = len(picture.planes)
    full = jpeg.full_size(picture)
    if lay.photometric in (K.WHITE_IS_ZERO, K.BLACK_IS_ZERO):
        return 255 - full[..., :1] if lay.photometric == K.WHITE_IS_ZERO else full[..., :1]
    if n == 3:
        stored_as_rgb = picture.adobe == 0 or lay.photometric == K.RGB and picture.adobe is None
        return full if stored_as_rgb else pixels.ycbcr_to_rgb(full[..., 0], full[..., 1], full[..., 2])
    if n == 4:
        if picture.adobe == 2:
            full = np.concatenate([pixels.ycbcr_to_rgb(full[..., 0], full[..., 1], full[..., 2]), full[..., 3:]], axis=-1)
        if picture.adobe is not None:
            full = 255 - full
        return pixels.cmyk_to_rgb(full)
    raise Unsupported(f"JPEG of {n} components as photometric {lay.photometric}")


def _jpeg_page(content: bytes, entries: list[Entry], lay: Layout) -> tuple[str, np.ndarray]:
    if lay.bits != 8:
        raise Unsupported("JPEG of other than 8 bits")
    table_entry = find(entries, K.JPEG_TABLES)
    tables = table_entry.data if table_entry else None
    gray = lay.photometric in (K.WHITE_IS_ZERO, K.BLACK_IS_ZERO)
    out = np.zeros((lay.height, lay.width, 1 if gray else 3), np.uint8)
    for seg in list_segments(entries, lay, len(content)):
        picture = jpeg.decode(jpeg.splice(tables, content[seg.offset : seg.offset + seg.size]))
        if picture.width < seg.seen_width or picture.height < seg.seen_height:
            raise Invalid("a JPEG segment is smaller than its place")
        out[seg.y : seg.y + seg.seen_height, seg.x : seg.x + seg.seen_width] = _jpeg_colour(picture, lay)[: seg.seen_height, : seg.seen_width]
    return ("Gray8" if gray else "Rgb24"), out


def old_jpeg_stream(entries: list[Entry], total: int) -> tuple[int, int]:
    """(offset, size) of an old-style page's one interchange stream; the form with separate tables is recognised and refused."""
    process = number(entries, K.JPEG_PROC, 1)
    if process not in (1, 14):
        raise Invalid(f"JPEGProc {process}")
    start = number(entries, K.JPEG_START, 0)
    if not start:
        missing = [t for t in (K.JPEG_Q_TABLES, K.JPEG_DC_TABLES, *((K.JPEG_AC_TABLES,) if process == 1 else ())) if find(entries, t) is None]
        if missing:
            raise Invalid(f"old-style JPEG without tables {missing}")
        raise Unsupported("old-style JPEG with separate tables")
    if process == 14:
        raise Unsupported("lossless JPEG")
    size = number(entries, K.JPEG_LENGTH, total - start)
    if start + size > total or size < 4:
        raise Invalid("the JPEG stream lies outside the file")
    return start, size


def old_jpeg_colour(stream: bytes, lay: Layout) -> tuple[str, np.ndarray]:
    last = stream.rfind(b"\xff\xd9")
    if stream[:2] != b"\xff\xd8" or last < 0:
        raise Invalid("the JPEG stream has no start or end marker")
    picture = jpeg.decode(stream[: last + 2])
    if picture.width < lay.width or picture.height < lay.height:
        raise Invalid("the JPEG stream is smaller than the image")
    gray = lay.photometric in (K.WHITE_IS_ZERO, K.BLACK_IS_ZERO)
    return ("Gray8" if gray else "Rgb24"), _jpeg_colour(picture, lay)[: lay.height, : lay.width]


def decode_page(content: bytes, entries: list[Entry], order: str) -> Image:
    lay = read_layout(entries, order)
    if lay.compression == "jpeg":
        name, v = _jpeg_page(content, entries, lay)
    elif lay.compression == "jpeg_old":
        start, size = old_jpeg_stream(entries, len(content))
        name, v = old_jpeg_colour(content[start : start + size], lay)
    else:
        name, v = colour(assemble(content, entries, lay), lay, entries)
    v = pixels.orient(v, lay.orientation)
    kind = "<u2" if name in ("Gray16Le", "Rgb48Le") else "u1"
    return Image(v.shape[1], v.shape[0], name, np.ascontiguousarray(v, kind).tobytes())


# ------------------------------------------------------------------ a page by its segments

PAGE_TAGS = (K.WIDTH, K.LENGTH, K.BITS_PER_SAMPLE, K.COMPRESSION, K.PHOTOMETRIC, K.FILL_ORDER, K.ORIENTATION, K.SAMPLES_PER_PIXEL, K.ROWS_PER_STRIP, K.PLANAR, K.T4_OPTIONS, K.T6_OPTIONS)
PAGE_TAGS += (K.PREDICTOR, K.COLOR_MAP, K.TILE_WIDTH, K.TILE_LENGTH, K.EXTRA_SAMPLES, K.SAMPLE_FORMAT, K.S_MIN, K.S_MAX, K.JPEG_TABLES, K.YCBCR_SUBSAMPLING)


@dataclass(frozen=True)
class Block:
    """What one task decodes: the segments of all planes at one place of a page."""

    index: int
    x: int
    y: int
    width: int
    height: int
    parts: list[Segment]


def list_blocks(entries: list[Entry], lay: Layout, total: int) -> list[Block]:
    """The page's blocks: a strip or tile each, with its segment of every plane."""
    if lay.compression == "jpeg_old":
        start, size = old_jpeg_stream(entries, total)
        return [Block(0, 0, 0, lay.width, lay.height, [Segment(0, 0, 0, 0, lay.width, lay.height, lay.width, lay.height, start, size)])]
    segments = list_segments(entries, lay, total)
    places = sum(s.plane == 0 for s in segments)
    return [Block(s.index, s.x, s.y, s.seen_width, s.seen_height, [o for o in segments[s.index :: places]]) for s in segments[:places]]


def block_samples(lay: Layout, parts: list[Segment], raw: list[bytes]) -> np.ndarray:
    """(rows, columns, samples) of a block: what of it lies inside the page."""
    planes = []
    for part, data in zip(parts, raw):
        s = segment_samples(lay, part, data)[: part.seen_height, : part.seen_width]
        if lay.planar and lay.units and part.plane:
            s = np.repeat(np.repeat(s, lay.units[1], axis=0), lay.units[0], axis=1)[: parts[0].seen_height, : parts[0].seen_width]
        planes.append(s)
    return np.concatenate(planes, axis=2) if len(planes) > 1 else planes[0]


def block_image(lay: Layout, entries: list[Entry], parts: list[Segment], raw: list[bytes], bounds: tuple[float | None, float | None] | None = None) -> tuple[str, int, int, np.ndarray]:
    """(pixel format, x, y, values) of a block in display order."""
    first = parts[0]
    gray = lay.photometric in (K.WHITE_IS_ZERO, K.BLACK_IS_ZERO)
    if lay.compression == "jpeg_old":
        name, v = old_jpeg_colour(raw[0], lay)
    elif lay.compression == "jpeg":
        if lay.bits != 8:
            raise Unsupported("JPEG of other than 8 bits")
        tables = find(entries, K.JPEG_TABLES)
        picture = jpeg.decode(jpeg.splice(tables.data if tables else None, raw[0]))
        if picture.width < first.seen_width or picture.height < first.seen_height:
            raise Invalid("a JPEG segment is smaller than its place")
        name, v = ("Gray8" if gray else "Rgb24"), _jpeg_colour(picture, lay)[: first.seen_height, : first.seen_width]
    else:
        name, v = colour(block_samples(lay, parts, raw), lay, entries, bounds)
    h, w = v.shape[:2]
    o = lay.orientation
    x = lay.width - first.x - w if o in (2, 3) else first.x
    y = lay.height - first.y - h if o in (3, 4) else first.y
    if o >= 5:  # sides are swapped: stored rows run across
        x = lay.height - first.y - h if o in (6, 7) else first.y
        y = lay.width - first.x - w if o in (7, 8) else first.x
    return name, x, y, pixels.orient(v, o)


def decode_at(content: bytes, offset: int | None = None) -> tuple[Image, list[Entry]]:
    """The first page, or that whose directory is at ``offset``."""
    header = parse_header(content)
    entries, _ = parse_directory(content, header, header.first if offset is None else offset)
    return decode_page(content, entries, header.order), entries


def decode_all(content: bytes) -> list[Image]:
    order = parse_header(content).order
    return [decode_page(content, entries, order) for _, entries in walk(content)]


def guarded(f, *args):
    """(result, None, None), or (None, status, message) for input that is refused."""
    try:
        return f(*args), None, None
    except RasterError as e:
        return None, e.status, str(e)
    except (ValueError, IndexError, OverflowError, MemoryError, ArithmeticError) as e:
        return None, "invalid", f"{type(e).__name__}: {e}"
