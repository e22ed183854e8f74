"""Metadata and structure of a page: total functions, malformed values are null."""

from __future__ import annotations

from ..functions import constants as K
from .container import Entry, find
from .errors import RasterError


def _soft(f, default=None):
    try:
        return f()
    except (RasterError, ArithmeticError, ValueError, IndexError):
        return default


def _text(entries: list[Entry], tag: int) -> str | None:
    e = find(entries, tag)
    return (_soft(e.text) or None) if e else None


def _number(entries: list[Entry], tag: int, default: int | None = None) -> int | None:
    e = find(entries, tag)
    return default if e is None else _soft(e.scalar)


def _numbers(entries: list[Entry], tag: int) -> list[int] | None:
    e = find(entries, tag)
    return None if e is None else _soft(lambda: list(e.unsigned32()))


def _ratio(entries: list[Entry], tag: int) -> tuple[int, int] | None:
    e = find(entries, tag)
    if e is None or not e.count:
        return None
    if e.kind == 5:
        return e.pairs()[0]
    return (e.unsigned()[0], 1) if e.kind in (3, 4) else None


def _payload(entries: list[Entry], tag: int) -> bytes | None:
    e = find(entries, tag)
    return e.data if e is not None and e.kind in (1, 7) and e.data else None


def icc_profile(entries: list[Entry]) -> bytes | None:
    """The profile if its own length field agrees (128 bytes at least)."""
    data = _payload(entries, K.ICC_PROFILE)
    return data if data and len(data) >= 128 and int.from_bytes(data[:4], "big") == len(data) else None


def metadata(entries: list[Entry]) -> dict:
    pages = _numbers(entries, K.PAGE_NUMBER)
    out: dict = {name: _text(entries, tag) for name, tag in K.TEXT_FIELDS.items()}
    out |= {"x_resolution": _ratio(entries, K.X_RESOLUTION), "y_resolution": _ratio(entries, K.Y_RESOLUTION)}
    out |= {"resolution_unit": _number(entries, K.RESOLUTION_UNIT), "orientation": _number(entries, K.ORIENTATION)}
    out |= {"page_number": pages[:2] if pages and len(pages) >= 2 else None}
    out |= {"new_subfile_type": _number(entries, K.NEW_SUBFILE_TYPE), "subfile_type": _number(entries, K.SUBFILE_TYPE)}
    return out | {"xmp": _payload(entries, K.XMP), "icc_profile": icc_profile(entries)}


def structure(entries: list[Entry]) -> dict:
    return {
        "width": _number(entries, K.WIDTH),
        "height": _number(entries, K.LENGTH),
        "bits_per_sample": _numbers(entries, K.BITS_PER_SAMPLE) if find(entries, K.BITS_PER_SAMPLE) else [1],
        "compression": _number(entries, K.COMPRESSION, 1),
        "photometric": _number(entries, K.PHOTOMETRIC),
        "samples_per_pixel": _number(entries, K.SAMPLES_PER_PIXEL, 1),
        "planar": _number(entries, K.PLANAR),
        "predictor": _number(entries, K.PREDICTOR),
        "sample_format": _numbers(entries, K.SAMPLE_FORMAT),
        "fill_order": _number(entries, K.FILL_ORDER),
        "extra_samples": _numbers(entries, K.EXTRA_SAMPLES),
    }
