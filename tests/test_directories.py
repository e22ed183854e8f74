"""Directories by Spark expressions against the parser: whole files, linked directories, damaged files."""

import random
import struct

import pytest

from rasterloom.functions import constants as K
from rasterloom.sources import relations


def chained(rnd: random.Random, order: str, big: bool) -> bytes:
    """A file of some directories with entries of any type; SubIFD, Exif and GPS entries lead to others of them, or to directories of their own."""
    place, slot, step, head = ("Q", 8, 20, "Q") if big else ("I", 4, 12, "H")
    main, loose = rnd.randrange(1, 4), rnd.randrange(0, 5)
    kinds = []
    for _ in range(main + loose):
        tags = rnd.sample(range(254, 320), rnd.randrange(0, 5)) + [t for t in (K.SUB_IFDS, K.EXIF, K.GPS) if rnd.random() < 0.4]
        kinds.append([(t, rnd.choice([*K.FIELD_TYPES, 99]), rnd.choice([0, 1, 1, 2, 3, 9])) if t < 320 else (t, rnd.choice([4, 4, 4, 13, 16]), rnd.choice([1, 1, 2, 3])) for t in tags])
    start = 16 if big else 8
    at = [start + sum(struct.calcsize(f"={head}") + len(k) * step + slot for k in kinds[:i]) for i in range(len(kinds) + 1)]
    beyond, extra, out = at.pop(), b"", b""
    for i, entries in enumerate(kinds):
        out += struct.pack(f"{order}{head}", len(entries))
        for tag, kind, n in entries:
            size = K.FIELD_TYPES.get(kind, ("", 0, ""))[1] * n
            raw = struct.pack(f"{order}{n}{K.FIELD_TYPES[kind][2]}", *[rnd.choice(at) for _ in range(n)]) if tag > 320 else rnd.randbytes(size)
            out += struct.pack(f"{order}HH{place}", tag, kind, n)
            if size <= slot:
                out += raw.ljust(slot, b"\7")
            else:
                out += struct.pack(f"{order}{place}", beyond + len(extra))
                extra += raw
        out += struct.pack(f"{order}{place}", at[i + 1] if i + 1 < main else 0)
    mark = b"II" if order == "<" else b"MM"
    return struct.pack(f"{order}2sHHHQ", mark, 43, 8, 0, at[0]) + out + extra if big else struct.pack(f"{order}2sHI", mark, 42, at[0]) + out + extra


def compared(spark, files):
    src = spark.createDataFrame([(f"{i:05d}", c) for i, c in enumerate(files)], "path string, content binary").repartition(4).cache()
    got, want = {}, {}
    for out, df in ((got, relations.directories(src)), (want, relations.ifds(src))):
        for r in df.collect():
            out.setdefault(r.path, []).append(r)
    src.unpersist()
    assert [(p, got.get(p), want[p]) for p in want if got.get(p) != want[p]] == []
    assert set(got) == set(want)
    return want


def test_whole_files(spark):
    rnd = random.Random(1)
    found = compared(spark, [chained(rnd, order, big) for order in "<>" for big in (False, True) for _ in range(60)])
    rows = [r for rs in found.values() for r in rs]
    assert {r.link for r in rows} == {"chain", "sub", "exif", "gps", None} - ({None} if all(r.link for r in rows) else set())
    assert max(r.depth or 0 for r in rows) >= 3


def test_damaged_files(spark):
    """Any bytes changed, files cut anywhere: the same rows up to the same error."""
    rnd = random.Random(2)
    files = []
    for _ in range(400):
        data = bytearray(chained(rnd, rnd.choice("<>"), False))
        for _ in range(rnd.randrange(1, 4)):
            data[rnd.randrange(len(data))] = rnd.choice([0, 1, 2, 4, 8, 13, 74, 255, rnd.randrange(256)])
        files.append(bytes(data[: rnd.randrange(len(data))] if rnd.random() < 0.3 else data))
    errors = {r._error.split(":")[-1].strip() for rs in compared(spark, files).values() for r in rs if r._error}
    assert {"directory lies outside the file", "directory is cut off", "value lies outside the file"} <= errors


def test_odd_headers(spark):
    big = struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16)
    files = [b"", b"II*", b"XX*\0\0\0\0\0", b"II\1\0\0\0\0\0", b"II*\0\0\0\0\0", b"II+\0\x08\0\0\0", big, big[:4] + b"\4\0" + big[6:], big[:6] + b"\1\0" + big[8:], big[:8] + b"\xff" * 8, b"MM\0*\0\0\0\x08\0\0\0\0\0\x08"]
    errors = [rs[-1]._error for _, rs in sorted(compared(spark, files).items())]
    assert errors[0] == "shorter than a header" and errors[-1] == "the chain of directories has a cycle"
    none = spark.createDataFrame([("a", None)], "path string, content binary")
    assert [r._status for r in relations.directories(none).collect()] == ["invalid"]
    assert relations.directories(none.limit(0)).count() == 0
    assert relations.directories(none, "DROPMALFORMED").count() == 0
    with pytest.raises(Exception, match="shorter"):
        relations.directories(none, "FAILFAST").collect()


def test_a_long_chain_and_no_python(spark):
    """3,000 directories, followed to the end; the plan has no Python worker and no shuffle."""
    n = 3000
    data = struct.pack("<2sHI", b"II", 42, 8) + b"".join(struct.pack("<HHHII", 1, 256, 3, 1, k) + struct.pack("<I", 8 + 18 * (k + 1) if k + 1 < n else 0) for k in range(n))
    df = relations.directories(spark.createDataFrame([("a", data)], "path string, content binary"))
    rows = df.collect()
    assert [r.page_index for r in rows] == list(range(n)) and int.from_bytes(rows[-1].entries[0].data, "little") == n - 1
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan and "Exchange" not in plan
