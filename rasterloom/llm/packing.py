"""Best-fit packing with a swap-based local search.

Documents become token ids (byte-level BPE, then id 0).  Only documents longer than a sequence are
cut: the first piece takes the remainder, the others are full.  Full pieces are sequences of their
own.  The others are dealt by row number into groups of about ``group_pieces`` and each group is
packed on its own: pieces in falling length go to the fullest bin that holds them; then, while
there are more bins than the tokens need, pieces of the emptiest bin are moved to bins with room
or exchanged, one for one and two for one, for shorter ones of other underfull bins, which raises
the sum of squared fills, until the bin is empty or no bin has an exchange left.

A group's work doesn't grow with the input, and what a group leaves open is about one sequence.
Pieces (without ids) go through a scratch table, so texts are cut into tokens once.

Null texts are empty: one piece of id 0.  Repeated rows give pieces of their own.  An empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..batches import bounded
from .common import scratch, slices

SLICE = 1_000_000  # bytes of text worked on at once
SPECIAL = {"<|endoftext|>": 50256}  # added to the vocabulary by byte_bpe_50k.json; a mark inside a text is this one id


@lru_cache(maxsize=4)
def encoder(path: str):
    """text -> ids (uint32).  path: a .tiktoken file, or a .json file of the tokenizers library."""
    if path.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
        return lambda text: coder.encode_to_numpy(text, allowed_special="all")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


def _pieces(path: str, capacity: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch, texts in slices(batches, "_text", SLICE):
            known: dict[bytes, list[tuple[int, int, int]]] = {}
            rows, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(texts):
                cut = known.get(text)
                if cut is None:
                    ids = np.append(encode(text.decode("utf-8", "replace")), 0).astype("<u4")
                    n, rest = len(ids), len(ids) % capacity
                    edges = [0, n] if n <= capacity else [*([0] if rest else []), *range(rest, n + 1, capacity)]
                    cut = known[text] = [(a, b - a, zlib.crc32(ids[a:b].tobytes())) for a, b in zip(edges, edges[1:])]
                for k, (a, size, c) in enumerate(cut):
                    rows.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(size)
                    crc.append(c)
            yield pa.record_batch([batch.column("doc_id").take(pa.array(rows, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return each


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: items in falling size, each into the fullest bin that holds it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r is set if a bin has room r
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[item]
        above = open_rooms >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(item)
        room -= size
        if room:
            by_room[room].append(b)
            open_rooms |= 1 << room
    return bins


def local_search(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Empties underfull bins by moves and exchanges; each one raises the sum of squared fills.

    The emptiest bin gives: an item that fits moves into the tightest room of another underfull bin at least as full; else
    one or two items go for a smaller one, the pair with the largest gain over all such bins (found by
    search among the sorted sums of one and two of its items).  A bin without an exchange gives way to the next;
    the search ends when the number of bins is the least possible or no bin has an exchange.
    Fills are whole numbers and their squares only rise, so it ends.
    """
    need = -(-sum(sizes) // capacity)
    size = np.asarray(sizes, np.int64)
    where = np.full(len(size), -1, np.int64)
    for b, items in enumerate(bins):
        where[items] = b
    room = capacity - np.bincount(where, weights=size, minlength=len(bins)).astype(np.int64)
    alive = int((room < capacity).sum())
    stuck = np.zeros(len(bins), bool)
    while alive > need:
        open_to = (room > 0) & (room < capacity)
        victims = np.flatnonzero(open_to & ~stuck)
        if not len(victims):
            break
        v = victims[room[victims].argmax()]
        mine = np.flatnonzero(where == v)
        others = open_to & (room <= room[v])
        others[v] = False
        rooms = np.where(others, room, 0)
        fits = mine[size[mine] <= rooms.max()] if len(rooms) else mine[:0]
        if len(fits):
            p = fits[size[fits].argmax()]
            b = np.where(rooms >= size[p], rooms, capacity + 1).argmin()
            where[p] = b
            room[b] -= size[p]
            room[v] += size[p]
        else:
            theirs = np.flatnonzero(others[where])
            one = size[mine]
            x, y = np.triu_indices(len(mine), 1)
            sums, first = np.unique(np.r_[one, one[x] + one[y]], return_index=True)
            at = np.searchsorted(sums, size[theirs] + room[where[theirs]], side="right") - 1
            gain = np.where(at >= 0, sums[at] - size[theirs], 0)
            if not len(gain) or gain.max() <= 0:
                stuck[v] = True
                continue
            k = gain.argmax()
            b, f = where[theirs[k]], first[at[k]]
            give = mine[[f]] if f < len(mine) else mine[[x[f - len(mine)], y[f - len(mine)]]]
            where[give], where[theirs[k]] = b, v
            room[b] -= gain[k]
            room[v] += gain[k]
        stuck[:] = False
        alive -= int(room[v] == capacity)
    order = np.argsort(where, kind="stable")
    return [part.tolist() for part in np.split(order, np.flatnonzero(np.diff(where[order])) + 1)] if len(order) else []


def _pack(capacity: int):
    def each(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("_row", "ascending")])
        sizes = group.column("length").to_pylist()
        bins = local_search(best_fit(sizes, capacity), sizes, capacity)
        place, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for b, items in enumerate(bins):
            at = 0
            for i in items:
                place[i], offset[i] = b, at
                at += sizes[i]
        base = group.column("_group").to_numpy() * (1 << 32)
        return group.select(["doc_id", "piece", "start", "length", "ids_crc32"]).append_column("sequence_id", pa.array(base + place)).append_column("offset", pa.array(offset))

    return each


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, group_pieces: int = 8192) -> DataFrame:
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    pieces = scratch(rows.mapInArrow(_pieces(vocabulary, capacity), PIECE), "pieces").withColumn("_row", F.monotonically_increasing_id())
    whole = pieces.where(F.col("length") == capacity).select("doc_id", "piece", "start", "length", "ids_crc32", (-F.col("_row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group_pieces))
    rest = rest.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    packed = rest.groupBy("_group").applyInArrow(_pack(capacity), PIECE + ", sequence_id long, offset long")
    return whole.unionByName(packed)


def op9(docs: DataFrame) -> DataFrame:
    """byte_bpe_50k: the .tiktoken file holds the .json file's vocabulary as ranks and gives the same ids, faster."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
