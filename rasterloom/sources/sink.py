"""Writing raster files: pages as rows, one file for each path."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators.errors import Invalid
from ..plans import encode

PAGE = "path string, page_index int, parent int, width int, height int, kind string, compression string, predictor boolean, planar boolean, tile_w int, tile_h int, rows_per_strip int, big boolean, samples binary, palette array<int>, metadata map<string, string>, "
PAGE += "xmp binary, icc_profile binary, x_resolution struct<num:bigint,den:bigint>, y_resolution struct<num:bigint,den:bigint>, page_number array<int>, "
PAGE += "t4_two_d boolean, associated_alpha boolean, subsampling array<int>, reduced boolean, multi_page boolean, "
PAGE += "exif array<struct<tag:int,field_type:int,count:bigint,data:binary>>, gps array<struct<tag:int,field_type:int,count:bigint,data:binary>>"
FILE = "path string, content binary, _status string, _error string"


def page_of(row: dict) -> encode.Page:
    photometric, n, bits, form = encode.KINDS[row["kind"]]
    kind = {1: f"<u{max(bits, 8) // 8}", 2: f"<i{bits // 8}", 3: f"<f{bits // 8}"}[form]
    s = np.frombuffer(row["samples"], kind).reshape(row["height"], row["width"], n)
    palette = row.get("palette") or []
    text = dict(row.get("metadata") or {})
    for k in ("orientation", "resolution_unit"):
        if k in text:
            text[k] = int(text[k])
    unknown = set(text) - set(K.TEXT_FIELDS) - {"orientation", "resolution_unit"}
    if unknown:
        raise Invalid(f"metadata {sorted(unknown)} has columns of its own or isn't known")
    text |= {k: row[k] for k in ("xmp", "icc_profile", "page_number") if row.get(k) is not None}
    text |= {k: (row[k]["num"], row[k]["den"]) for k in ("x_resolution", "y_resolution") if row.get(k) is not None}
    slots = {k: [(e["tag"], e["field_type"], e["count"], e["data"] or b"") for e in row.get(k) or ()] for k in ("exif", "gps")}
    more = {k: True for k in ("t4_two_d", "associated_alpha", "reduced", "multi_page") if row.get(k)}
    if row.get("subsampling"):
        more["subsampling"] = tuple(row["subsampling"])
    tile = (row["tile_w"], row["tile_h"]) if row.get("tile_w") else None
    return encode.Page(s, row["kind"], row.get("compression") or "none", bool(row.get("predictor")), bool(row.get("planar")), tile, row.get("rows_per_strip"), bool(row.get("big")), palette=[tuple(palette[i : i + 3]) for i in range(0, len(palette), 3)], metadata=text, **slots, **more)


def nested(rows: list[dict]) -> list[encode.Page]:
    """Pages of one file: rows with a ``parent`` (its page_index) are SubIFDs of that page, in the order of page_index.

    Folded from the deepest level up.  Parents that don't exist, cycles and more than ``MAX_DEPTH`` levels are refused.
    """
    by_index = {r["page_index"] or 0: r for r in rows}
    parent = {k: r.get("parent") for k, r in by_index.items()}
    if len(by_index) < len(rows) and any(p is not None for p in parent.values()):
        raise Invalid("a page_index twice in a file with SubIFDs")
    if len(by_index) < len(rows):
        return [page_of(r) for r in rows]
    depth: dict[int, int] = {}
    for k in parent:
        seen, at = [], k
        while at is not None and at not in depth:
            if at not in parent:
                raise Invalid(f"page {k}: no parent {at}")
            if at in seen:
                raise Invalid(f"page {k} is its own ancestor")
            seen.append(at)
            at = parent[at]
        below = -1 if at is None else depth[at]
        for page in reversed(seen):
            below += 1
            depth[page] = below
    if max(depth.values(), default=0) > encode.MAX_DEPTH:
        raise Invalid("directories nested too deep")
    pages = {k: page_of(r) for k, r in by_index.items()}
    for k in sorted(pages, key=lambda k: (-depth[k], k)):
        if parent[k] is not None:
            pages[parent[k]].children = [*pages[parent[k]].children, pages[k]]
    return [pages[k] for k in sorted(pages) if parent[k] is None]


def _encode(group: pa.Table) -> pa.Table:
    rows = group.to_pylist()
    try:
        rows.sort(key=lambda r: r["page_index"] or 0)
        content, status, error = encode.encode(nested(rows)), "ok", None
    except Exception as e:  # noqa: BLE001  whatever a bad row raises is that file's status, not the job's end
        content, status, error = None, getattr(e, "status", "invalid"), str(e) or type(e).__name__
    return pa.table({"path": [rows[0]["path"]], "content": pa.array([content], pa.binary()), "_status": [status], "_error": pa.array([error], pa.string())})


def encode_files(pages: DataFrame) -> DataFrame:
    """(path, content, _status, _error): the pages of each path as one file, ordered by page_index; ``parent`` makes SubIFDs.

    One shuffle by path brings a file's pages together; a file is built in one task, as it must fit
    in one cell anyway.  Columns missing from ``pages`` take their defaults (null).
    """
    have = set(pages.columns)
    full = pages.select(*[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in (f.split(" ", 1) for f in _fields())])
    return full.groupBy("path").applyInArrow(_encode, FILE)


def _fields() -> list[str]:
    """name type of each page column; commas inside brackets don't part columns."""
    out, depth = [""], 0
    for c in PAGE.replace("map<string, string>", "map<string,string>"):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [f.strip() for f in out]
