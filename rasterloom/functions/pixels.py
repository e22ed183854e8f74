"""Sample functions on NumPy arrays, for packed rasters inside the data source.

``samples.py`` has the same functions as Spark columns; the tests hold one against the other.
Arrays are (rows, columns, components); 1- and 4-bit samples are one to a byte here.
"""

from __future__ import annotations

import numpy as np


def unpack(data: bytes, rows: int, columns: int, components: int, bits: int, order: str, is_float: bool = False) -> np.ndarray:
    """Packed rows, each starting at a byte, to samples."""
    per_row = columns * components
    if bits in (1, 4):
        stride = (per_row * bits + 7) // 8
        raw = np.frombuffer(data, np.uint8, rows * stride).reshape(rows, stride)
        flat = np.unpackbits(raw, axis=1) if bits == 1 else np.stack([raw >> 4, raw & 15], axis=2).reshape(rows, -1)
        return flat[:, :per_row].reshape(rows, columns, components)
    kind = f"{order}f{bits // 8}" if is_float else f"{order}u{bits // 8}"
    return np.frombuffer(data, kind, rows * per_row).reshape(rows, columns, components)


def pack(samples: np.ndarray, bits: int) -> bytes:
    """Samples to packed little-endian rows."""
    rows = samples.reshape(samples.shape[0], -1)
    if bits == 1:
        return np.packbits(rows.astype(np.uint8), axis=1).tobytes()
    if bits == 4:
        even = np.pad(rows, ((0, 0), (0, rows.shape[1] % 2))).astype(np.uint8)
        return (even[:, ::2] << 4 | even[:, 1::2]).tobytes()
    return np.ascontiguousarray(samples, samples.dtype.newbyteorder("<")).tobytes()


# ------------------------------------------------------------------ predictors


def undo_difference(samples: np.ndarray, bits: int) -> np.ndarray:
    kind = np.uint8 if bits <= 8 else np.dtype(f"u{bits // 8}")
    total = np.cumsum(samples.astype(kind), axis=1, dtype=kind)
    return total & 15 if bits == 4 else total


def difference(samples: np.ndarray, bits: int) -> np.ndarray:
    kind = np.uint8 if bits <= 8 else np.dtype(f"u{bits // 8}")
    s = samples.astype(kind)
    out = s.copy()
    out[:, 1:] = s[:, 1:] - s[:, :-1]
    return out & 15 if bits == 4 else out


def undo_float_planes(data: bytes, rows: int, values: int, size: int) -> np.ndarray:
    """Rows of byte planes (most significant first) that were differenced: big-endian floats."""
    planes = np.cumsum(np.frombuffer(data, np.uint8, rows * values * size).reshape(rows, values * size), axis=1, dtype=np.uint8)
    mixed = np.ascontiguousarray(planes.reshape(rows, size, values).transpose(0, 2, 1))
    return mixed.view(f">f{size}").reshape(rows, values)


def float_planes(values: np.ndarray, size: int) -> bytes:
    rows = values.shape[0]
    flat = values.reshape(rows, -1)
    raw = np.ascontiguousarray(flat, f">f{size}").view(np.uint8).reshape(rows, -1, size).transpose(0, 2, 1).reshape(rows, -1)
    out = raw.copy()
    out[:, 1:] = raw[:, 1:] - raw[:, :-1]
    return out.tobytes()


# ------------------------------------------------------------------ colour


def clamp8(v: np.ndarray) -> np.ndarray:
    return np.clip(v, 0, 255).astype(np.uint8)


def ycbcr_to_rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    """Full-range BT.601 in 16-bit fixed point."""
    y, cb, cr = (v.astype(np.int64) for v in (y, cb, cr))
    cb, cr = cb - 128, cr - 128
    r = y + ((91881 * cr + 32768) >> 16)
    g = y - ((22554 * cb + 46802 * cr + 32768) >> 16)
    b = y + ((116130 * cb + 32768) >> 16)
    return np.stack([clamp8(r), clamp8(g), clamp8(b)], axis=-1)


def cmyk_to_rgb(s: np.ndarray) -> np.ndarray:
    v = 255 - s[..., :4].astype(np.int64)
    return (v[..., :3] * v[..., 3:] // 255).astype(np.uint8)


def _display(v: np.ndarray) -> np.ndarray:
    c = np.clip(v, 0.0, 1.0)
    e = np.where(c <= 0.0031308, 12.92 * c, 1.055 * np.power(c, 1 / 2.4) - 0.055)
    return clamp8(np.floor(e * 255 + 0.5))


def _luminance(light: np.ndarray) -> np.ndarray:
    return np.where(light > 7.999625, ((light + 16) / 116) ** 3, light / 903.3)


def lab_to_rgb(s: np.ndarray) -> np.ndarray:
    """8-bit CIELab (a, b signed) at D65, through the inverse of the NTSC matrix, to display values."""
    light = s[..., 0].astype(float) * 100 / 255
    a, b = (s[..., i].astype(np.uint8).view(np.int8).astype(float) for i in (1, 2))
    fy = (light + 16) / 116
    x, z = (np.where(f**3 > 0.008856, f**3, (f - 16 / 116) / 7.787) for f in (a / 500 + fy, fy - b / 200))
    x, y, z = x * 0.95047, _luminance(light), z * 1.08883
    # fixed values: inverse of the NTSC tristimulus matrix
    red = 1.9103738257 * x - 0.5337689371 * y - 0.2891315088 * z
    green = -0.9844441268 * x + 1.9985203510 * y - 0.0278510303 * z
    blue = 0.0584818293 * x - 0.1187239812 * y + 0.9017445257 * z
    return np.stack([_display(red), _display(green), _display(blue)], axis=-1)


def lab_light_to_gray(s: np.ndarray) -> np.ndarray:
    return _display(_luminance(s.astype(float) * 100 / 255))


def float_to_gray(v: np.ndarray, low: float | None, high: float | None) -> np.ndarray:
    """Linear display map over [low, high]; a bound that is None is that of the finite values."""
    v = v.astype(np.float64)
    finite = v[np.isfinite(v)]
    low = low if low is not None and np.isfinite(low) else (finite.min() if finite.size else 0.0)
    high = high if high is not None and np.isfinite(high) else (finite.max() if finite.size else 0.0)
    span = high - low
    if not span > 0:
        return np.zeros(v.shape, np.uint8)
    with np.errstate(invalid="ignore", over="ignore"):
        t = np.clip((v - low) / span, 0.0, 1.0)
        return np.where(np.isfinite(v), np.floor(t * 255 + 0.5), 0).astype(np.uint8)


def colormap(words: np.ndarray, bits: int) -> np.ndarray:
    """Planar 16-bit map to rows of 8-bit RGB."""
    n = 1 << bits
    return (words[: 3 * n].reshape(3, n).T >> 8).astype(np.uint8)


def orient(a: np.ndarray, orientation: int) -> np.ndarray:
    """Stored rows and columns to display order (1 to 8; 5 to 8 swap the sides)."""
    if orientation >= 5:
        a = a.swapaxes(0, 1)
    if orientation in (3, 4, 7, 8):
        a = a[::-1]
    if orientation in (2, 3, 6, 7):
        a = a[:, ::-1]
    return a


# ------------------------------------------------------------------ chroma


def box_mean(plane: np.ndarray, sh: int, sv: int) -> np.ndarray:
    """Block means, rounded half up; blocks at the right and bottom repeat the edge."""
    h, w = plane.shape
    p = np.pad(plane, ((0, -h % sv), (0, -w % sh)), mode="edge").astype(np.int64)
    n = sh * sv
    return ((p.reshape(p.shape[0] // sv, sv, p.shape[1] // sh, sh).sum(axis=(1, 3)) + n // 2) // n).astype(np.uint8)


def join_units(data: bytes, width: int, rows: int, sh: int, sv: int) -> np.ndarray:
    """(sh x sv luma, Cb, Cr) units to full-size YCbCr samples; what lies outside is dropped."""
    across, down = -(-width // sh), -(-rows // sv)
    size = sh * sv + 2
    u = np.frombuffer(data, np.uint8, across * down * size).reshape(down, across, size)
    y = u[..., : sh * sv].reshape(down, across, sv, sh).transpose(0, 2, 1, 3).reshape(down * sv, across * sh)
    cb, cr = (np.repeat(np.repeat(u[..., sh * sv + i], sv, axis=0), sh, axis=1) for i in (0, 1))
    return np.stack([y, cb, cr], axis=-1)[:rows, :width]


def split_units(s: np.ndarray, sh: int, sv: int) -> bytes:
    h, w, _ = s.shape
    y = np.pad(s[..., 0], ((0, -h % sv), (0, -w % sh)), mode="edge")
    down, across = y.shape[0] // sv, y.shape[1] // sh
    luma = y.reshape(down, sv, across, sh).transpose(0, 2, 1, 3).reshape(down, across, sh * sv)
    cb, cr = (box_mean(s[..., i], sh, sv)[..., None] for i in (1, 2))
    return np.concatenate([luma, cb, cr], axis=-1).astype(np.uint8).tobytes()


# ------------------------------------------------------------------ half floats


def half_to_float(bits: np.ndarray) -> np.ndarray:
    return np.asarray(bits, np.uint16).view(np.float16).astype(np.float32)


def float_to_half(values: np.ndarray) -> np.ndarray:
    """Round to nearest even; overflow to infinity; NaN quiet with the top bits of its payload."""
    v = np.asarray(values, np.float32)
    with np.errstate(over="ignore", invalid="ignore"):
        out = v.astype(np.float16).view(np.uint16).copy()
    raw = v.view(np.uint32)
    nan = np.isnan(v)
    out[nan] = ((raw[nan] >> 16) & 0x8000 | 0x7E00 | (raw[nan] >> 13) & 0x3FF).astype(np.uint16)
    return out
