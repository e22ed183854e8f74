"""Byte ranges of files in place of whole files.

``RangeBytes`` looks like bytes to the container parser (a length and slices) and reads only what is sliced: small
slices (header, directories, values) through a few blocks of ``BLOCK`` bytes, larger ones as one read of just that range.  So the
metadata of a file costs some blocks whatever its size, and a strip or tile costs its own bytes.

Paths are opened by the machine's file system, or, with a scheme such as ``s3://`` or ``hdfs://``, by Arrow's file systems; executors
must see them under the same name.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

BLOCK = 16_384
KEPT = 64  # blocks remembered for a file


class RangeBytes:
    """Bytes of a file, read when they are sliced.  ``read_bytes`` and ``reads`` count what came from the store."""

    def __init__(self, path: str):
        self.path, self.read_bytes, self.reads = path, 0, 0
        self._blocks: dict[int, bytes] = {}
        local = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
        if "://" in local:
            from pyarrow import fs

            system, inner = fs.FileSystem.from_uri(path)
            self._file = system.open_input_file(inner)
            self._size = self._file.size()
            self._at = lambda offset, size: self._file.read_at(size, offset)
        else:
            self._file = open(local, "rb")  # noqa: SIM115  closed by close()
            self._size = os.fstat(self._file.fileno()).st_size
            self._at = lambda offset, size: os.pread(self._file.fileno(), size, offset)

    def __len__(self) -> int:
        return self._size

    def __enter__(self) -> RangeBytes:
        return self

    def __exit__(self, *_: object) -> None:
        self._file.close()

    def read(self, offset: int, size: int) -> bytes:
        """One read of a range."""
        out = b""
        while len(out) < size:  # a store may give less than was asked for
            more = self._at(offset + len(out), size - len(out))
            self.reads += 1
            self.read_bytes += len(more)
            if not more:
                break
            out += more
        return out

    def _block(self, k: int) -> bytes:
        if k not in self._blocks:
            if len(self._blocks) >= KEPT:
                self._blocks.pop(next(iter(self._blocks)))
            self._blocks[k] = self.read(k * BLOCK, min(BLOCK, self._size - k * BLOCK))
        return self._blocks[k]

    def __getitem__(self, part: slice) -> bytes:
        start, stop, step = part.indices(self._size)
        if step != 1 or stop <= start:
            return b""
        if stop - start > BLOCK:
            return self.read(start, stop - start)
        first, last = start // BLOCK, (stop - 1) // BLOCK
        data = b"".join(self._block(k) for k in range(first, last + 1))
        return data[start - first * BLOCK : stop - first * BLOCK]


def listing(path: str, extensions: tuple[str, ...]) -> Iterator[str]:
    """Files below a folder, or the file itself, by name."""
    local = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
    if "://" in local:
        from pyarrow import fs

        scheme = path.split("://")[0]
        system, inner = fs.FileSystem.from_uri(path)
        if system.get_file_info(inner).type == fs.FileType.File:
            yield path
            return
        for info in sorted(system.get_file_info(fs.FileSelector(inner, recursive=True)), key=lambda i: i.path):
            if info.type == fs.FileType.File and info.path.lower().endswith(extensions):
                yield f"{scheme}://{info.path}"
        return
    if os.path.isfile(local):
        yield local
        return
    yield from sorted(os.path.join(d, f) for d, _, names in os.walk(local) for f in names if f.lower().endswith(extensions) and not f.startswith(("_", ".")))
