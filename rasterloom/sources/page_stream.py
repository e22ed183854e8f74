"""Pages of new raster files as a stream: ``spark.readStream.format("tiff").option("log", folder).load(path)``.

A batch is bounded by pages, not by files, so a file of many pages comes in parts.  What belongs to which batch is
decided once and written down: the log folder holds numbered extents, each a list of shares (a file and some of its directories),
and a stream offset is a number of extents.  Offsets only grow, a batch repeated after a failure reads the same shares, and a
query that restarts goes on in the middle of a file.  Files are recognised by path, whatever their times or the order in
which they appear; as in Spark's file sources, a file is complete when its name appears and doesn't change.

The driver lists names when the files of its last list are used up, so not once a batch, and reads directories by ranges, of no more
files than a batch has pages; tasks jump to their own directories and decode no other page.  A task has up to ``pages_per_task`` pages, of several
files if these are small.  A file that can't be parsed is one row with its error.  The log folder belongs to one query, as its checkpoint does.
"""

from __future__ import annotations

import json
import os
import uuid
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql.datasource import DataSourceStreamReader, InputPartition

from ..operators import container
from ..operators.errors import RasterError
from . import relations as R
from .ranges import RangeBytes, listing

EXTENSIONS = (".tif", ".tiff")
PAGES_PER_BATCH = 256
PAGES_PER_TASK = 16


@dataclass
class Share(InputPartition):
    """Some pages of a file: (page_index, place of its directory); a place of None stands for a file that can't be parsed.  ``more``: shares that the same task reads."""

    path: str
    pages: list[tuple[int, int | None]]
    more: list[Share] = field(default_factory=list)


class Extents:
    """Numbered files of shares in a folder, written once each."""

    def __init__(self, folder: str):
        from pyarrow import fs

        local = folder.removeprefix("file://") if folder.startswith("file://") else folder.removeprefix("file:")
        self._fs, self._root = fs.FileSystem.from_uri(folder) if "://" in local else (fs.LocalFileSystem(), os.path.abspath(local))
        self._fs.create_dir(self._root, recursive=True)

    def _name(self, number: int) -> str:
        return f"{self._root}/{number:012d}.json"

    def count(self) -> int:
        from pyarrow import fs

        names = [i.base_name for i in self._fs.get_file_info(fs.FileSelector(self._root)) if i.base_name.endswith(".json") and not i.base_name.startswith("_")]
        return max((int(n.removesuffix(".json")) + 1 for n in names), default=0)

    def read(self, number: int) -> dict:
        with self._fs.open_input_stream(self._name(number)) as f:
            return json.loads(f.read())

    def write(self, number: int, extent: dict) -> None:
        part = f"{self._root}/_{uuid.uuid4().hex}"
        with self._fs.open_output_stream(part) as f:
            f.write(json.dumps(extent).encode())
        self._fs.move(part, self._name(number))


def directory_places(path: str) -> list[int | None]:
    """Places of a file's directories by small range reads; [None] if it can't be parsed."""
    try:
        with RangeBytes(path) as content:
            return [at for at, _ in container.walk(content)]
    except RasterError:
        return [None]


class PageStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        if "log" not in options:
            raise ValueError("set option log to a folder of this query's own, which must outlive it as its checkpoint does")
        self.options = options
        self.per_batch, self.per_task = (int(options.get(n, d)) for n, d in (("pages_per_batch", PAGES_PER_BATCH), ("pages_per_task", PAGES_PER_TASK)))
        if self.per_batch < 1 or self.per_task < 1:
            raise ValueError("pages_per_batch and pages_per_task must be 1 or more")
        self._extents: Extents | None = None
        self._waiting: deque[str] = deque()  # files of the last list that no extent has

    def _load(self) -> None:
        self._extents = Extents(self.options["log"])
        self._count, self._seen, self._open = self._extents.count(), set(), None
        for k in range(self._count):
            extent = self._extents.read(k)
            self._seen |= {path for path, _ in extent["shares"]}
            self._open = extent["open"]

    def initialOffset(self) -> dict:
        return {"extents": 0}

    def latestOffset(self) -> dict:
        """One more extent of up to ``pages_per_batch`` pages, if there are pages that no extent has."""
        if self._extents is None:
            self._load()
        shares, left, still, listed = [], self.per_batch, self._open, False
        while left:
            if not still and not self._waiting and not listed:
                own, listed = {path for path, _ in shares}, True
                self._waiting.extend(p for p in listing(self.options["path"], EXTENSIONS) if p not in self._seen and p not in own)
            if not still and not self._waiting:
                break
            path, first = still or (self._waiting[0], 0)
            places = list(enumerate(directory_places(path)))[first:]
            if not still:
                self._waiting.popleft()
            taken, rest = places[:left], places[left:]
            left -= len(taken)
            shares += [(path, taken[a : a + self.per_task]) for a in range(0, len(taken), self.per_task)]
            still = (path, rest[0][0]) if rest else None
        if shares:
            self._extents.write(self._count, {"shares": shares, "open": still})
            self._count, self._open = self._count + 1, still
            self._seen |= {path for path, _ in shares}
        return {"extents": self._count}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        log = self._extents or Extents(self.options["log"])
        tasks: list[Share] = []
        for k in range(start["extents"], end["extents"]):
            room = 0
            for path, pages in log.read(k)["shares"]:
                pages = [tuple(p) for p in pages]
                if 0 < room:
                    tasks[-1].more.append(Share(path, pages[:room]))
                    pages, room = pages[room:], max(room - len(pages), 0)
                if pages:
                    tasks.append(Share(path, pages))
                    room = self.per_task - len(pages)
        return tasks

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        pixels = self.options.get("relation", "pages") == "pages"
        mode = self.options.get("mode", "PERMISSIVE").upper()

        def rows() -> Iterator[dict]:
            for share in (partition, *partition.more):
                with RangeBytes(share.path) as content:
                    for k, at in share.pages:
                        for row in R.page_rows(share.path, content, "all", at, pixels):
                            yield row | {"page_index": k}

        for out in R.arrow_rows(rows(), R.PAGES if pixels else R.META):
            bad = [s != "ok" for s in out.column("_status").to_pylist()]
            if any(bad) and mode == "FAILFAST":
                first = bad.index(True)
                raise ValueError(f"{out.column('path')[first].as_py()}: {out.column('_error')[first].as_py()}")
            yield out.filter(pa.array([not b for b in bad])) if mode == "DROPMALFORMED" else out
