"""``spark.read.format("tiff")`` and its relatives, and ``df.write.format("tiff")``.

    spark.dataSource.register(TiffSource)
    spark.read.format("tiff").option("relation", "pages").load("/folder")

relation: pages (default), meta, ifds, segments or plan (blocks without their bytes, for ``relations.tiles``).  Options: pages
(all, first), ifd_offset, mode.  A filter on ``path`` or ``page_index`` reaches the reader.  Files are read by ranges: a relation costs the
header, the directories and what it decodes.  Paths are those that every executor sees; for stores that only Spark
reads use ``relations.files``.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, InputPartition, WriterCommitMessage

from . import relations as R
from .page_stream import PageStreamReader
from .ranges import RangeBytes, listing

FILES_PER_TASK = 16
EXTENSIONS = (".tif", ".tiff")


@dataclass
class FileGroup(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class TiffReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.path_is: str | None = None
        self.page_is: int | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("path",):
                self.path_is = f.value
            elif isinstance(f, EqualTo) and f.attribute == ("page_index",):
                self.page_is = f.value
            yield f  # Spark checks again, so the reader may also read too much

    def partitions(self) -> list[FileGroup]:
        paths = [p for p in listing(self.options["path"], EXTENSIONS) if self.path_is is None or p == self.path_is.removeprefix("file://")]
        return [FileGroup(paths[a : a + FILES_PER_TASK]) for a in range(0, len(paths), FILES_PER_TASK)]

    def read(self, partition: FileGroup) -> Iterator[pa.RecordBatch]:
        o = self.options
        which = "first" if self.page_is == 0 else o.get("pages", "all")
        offset = int(o["ifd_offset"]) if "ifd_offset" in o else None
        rows_of, ddl = {
            "pages": (lambda p, c: R.page_rows(p, c, which, offset), R.PAGES),
            "meta": (lambda p, c: R.page_rows(p, c, which, offset, pixels=False), R.META),
            "ifds": (R.ifd_rows, R.IFDS),
            "segments": (R.segment_rows, R.SEGMENTS),
            "plan": (lambda p, c: R.plan_rows(p, c, raw=False), R.PLAN),
        }[o.get("relation", "pages")]
        mode = o.get("mode", "PERMISSIVE").upper()
        for path in partition.paths:
            for out in self._rows(path, rows_of, ddl):
                bad = [s != "ok" for s in out.column("_status").to_pylist()]
                if any(bad) and mode == "FAILFAST":
                    raise ValueError(f"{path}: {out.column('_error').to_pylist()[bad.index(True)]}")
                yield out.filter(pa.array([not b for b in bad])) if mode == "DROPMALFORMED" else out


    @staticmethod
    def _rows(path: str, rows_of, ddl: str) -> Iterator[pa.RecordBatch]:
        with RangeBytes(path) as content:
            yield from R.arrow_rows(rows_of(path, content), ddl)


class TiffWriter(DataSourceWriter):
    """Rows (path, content): each file is written under a temporary name and renamed when all tasks are done.  ``append`` refuses names that exist."""

    def __init__(self, options: dict, overwrite: bool = False):
        self.folder = options["path"].removeprefix("file://")
        self.overwrite = overwrite

    def write(self, iterator) -> Written:
        moves = []
        for row in iterator:
            if row["content"] is None:
                raise ValueError(f"{row['path']}: no content (a page that couldn't be encoded); leave such rows out")
            target = os.path.join(self.folder, os.path.basename(row["path"]))
            os.makedirs(self.folder, exist_ok=True)
            part = os.path.join(self.folder, f"._{uuid.uuid4().hex}")
            with open(part, "wb") as f:
                f.write(row["content"])
            moves.append((part, target))
        return Written(moves)

    def commit(self, messages: list) -> None:
        names = [target for m in messages for _, target in (m.moves if m else ())]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError(f"several rows would be written to {next(n for n in names if names.count(n) > 1)}")
        there = [n for n in names if os.path.exists(n)]
        if there and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{there[0]} exists already")
        for m in messages:
            for part, target in m.moves if m else ():
                os.replace(part, target)
        if self.overwrite and os.path.isdir(self.folder):  # what isn't replaced goes last, so that no moment has neither
            new = {os.path.basename(n) for n in names}
            for name in os.listdir(self.folder):
                if name.lower().endswith((".tif", ".tiff")) and not name.startswith("._") and name not in new:
                    os.remove(os.path.join(self.folder, name))

    def abort(self, messages: list) -> None:
        for m in messages:
            for part, _ in m.moves if m else ():
                if os.path.exists(part):
                    os.remove(part)


class TiffSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiff"

    def schema(self) -> str:
        return {"pages": R.PAGES, "meta": R.META, "ifds": R.IFDS, "segments": R.SEGMENTS, "plan": R.PLAN}[self.options.get("relation", "pages")]

    def reader(self, schema) -> TiffReader:
        return TiffReader(dict(self.options))

    def streamReader(self, schema) -> PageStreamReader:
        if self.options.get("relation", "pages") not in ("pages", "meta"):
            raise ValueError("a stream gives the relation pages or meta")
        return PageStreamReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> TiffWriter:
        return TiffWriter(dict(self.options), overwrite)


def register(spark) -> None:
    """Makes the format known to the session, with filters pushed to the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TiffSource)
