"""Substring dedup by seed and extend.

Seeds: in every document the hashes of all runs of ``seed_words`` words are winnowed; the smallest
hash of each ``window`` words is their anchor, so any repeat of ``window`` words or more has an
anchor in common with its other occurrence.  Documents meet on anchors.  Anchors found in one
document only are dropped there.  At the others the match is extended both ways: neighbouring runs
of ``window`` words with one anchor form a stretch, and a stretch found word for word in a document
with a smaller id is a repeat as a whole.  Only of one document for each different stretch (that
with the smallest id) are the runs looked up one by one.  Overlapping repeats join into maximal
ones, which are removed from the later document.

What is shuffled: anchors (about 2 per ``window - seed_words`` words), stretches at shared anchors,
the runs of different stretches, and texts once (both joins with texts use one exchange).  Anchors,
stretches and runs shared by very many documents are only summed map-side and joined, never
gathered.

Null texts have no words.  A row without id counts as after all others.  Repeated rows don't
remove anything from each other.  Texts shorter than a run keep all words.  An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, run_hash, signed, slices, span_hash



def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours, by doubling."""
    have, done = x, 1
    while done * 2 <= width:
        have = np.minimum(have[:-done], have[done:])
        done *= 2
    rest = width - done
    return np.minimum(have[:-rest], have[rest:]) if rest else have


def runs(words: Words, window: int, seed_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the first word, anchor hash, hash of all words) of each run of ``window`` words within a document."""
    hashes = words.hashes()
    n = len(hashes)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    seeds = run_hash(hashes, seed_words, 3)  # those across documents lie in no run
    least = _sliding_min(seeds, window - seed_words + 1)
    at, whole = words.windows(hashes, window)
    return at, least[at], whole


def _anchors(window: int, seed_words: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "_text"):
            words = Words(texts)
            at, anchor, _ = runs(words, window, seed_words)
            if len(at):
                doc = words.doc_of()[at]
                new = np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]
                yield pa.record_batch([batch.column("_id").take(pa.array(doc[new])), pa.array(signed(anchor[new]))], ["_id", "_anchor"])

    return each


def _extended(window: int, seed_words: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "_text"):
            shared = batch.column("_shared")
            live = [i for i, ok in enumerate(shared.is_valid().to_pylist()) if ok]
            if not live:
                continue
            seeds = np.unique(shared.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            words = Words([texts[i] for i in live])
            at, anchor, whole = runs(words, window, seed_words)
            found = np.isin(signed(anchor), seeds)
            at, anchor, whole = at[found], anchor[found], whole[found]
            if len(at):
                doc = words.doc_of()[at]
                head = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)])
                edges = np.r_[head, len(at)]
                stretch = span_hash(words.hashes(), at[head], at[edges[1:] - 1] + window, 9)
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(signed(whole)))
                rows = pa.array(np.asarray(live)[doc[head]])
                own = batch.column("_h").take(rows).to_numpy().astype(np.int64) << 32  # text hash << 32 | place of the first word
                yield pa.record_batch([batch.column("_id").take(rows), pa.array(own | (at[head] - words.first[doc[head]])), pa.array(signed(stretch)), lists], ["_id", "_at", "_stretch", "_runs"])

    return each


def _cut(window: int, with_text: bool):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "_text"):
            words = Words(texts)
            lists = batch.column("_covered").fill_null([]) if batch.column("_covered").null_count else batch.column("_covered")
            mine = batch.column("_h").to_pylist()
            lists = [[(c["_at"] & 0xFFFFFFFF, c["_n"]) for c in x if c["_at"] >> 32 == h] for x, h in zip(lists.to_pylist(), mine)]
            out_n, out_removed, out_sha, out_text = [], [], [], []
            raw = words.buf.tobytes()
            for d, starts in enumerate(lists):
                lo, hi = int(words.first[d]), int(words.first[d + 1])
                keep = np.ones(hi - lo, bool)
                if starts:
                    edge = np.zeros(hi - lo + 1, np.int64)
                    begin, number = np.asarray(starts, np.int64).T
                    np.add.at(edge, begin, 1)
                    np.add.at(edge, begin + number - 1 + window, -1)
                    keep = np.cumsum(edge[:-1]) == 0
                kept = lo + np.flatnonzero(keep)
                joined = b" ".join([raw[b:e] for b, e in zip(words.begin[kept].tolist(), words.end[kept].tolist())]) if starts else b" ".join(raw[words.doc_at[d] : words.doc_at[d + 1]].split())
                out_n.append(hi - lo)
                out_removed.append(hi - lo - len(kept))
                out_sha.append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    out_text.append(joined.decode("utf-8", "replace"))
            columns = [batch.column("doc_id"), pa.array(out_n, pa.int64()), pa.array(out_removed, pa.int64()), pa.array(out_sha, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array(out_text, pa.string())], [*names, "kept_text"]
            yield pa.record_batch(columns, names)

    return each


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, seed_words: int = 16, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and the kept words as ``kept_text`` if asked for."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("_id"), F.hash(text).alias("_h"), text.alias("_text"))

    anchors = rows.select("_id", "_text").mapInArrow(_anchors(window, seed_words), "_id long, _anchor long")
    shared = anchors.groupBy("_anchor").agg(F.min("_id").alias("_lo"), F.max("_id").alias("_hi")).where("_lo < _hi").select("_anchor")
    by_doc = anchors.join(shared, "_anchor").groupBy("_id").agg(F.collect_set("_anchor").alias("_shared"))

    found = rows.join(by_doc, "_id", "left").mapInArrow(_extended(window, seed_words), "_id long, _at long, _stretch long, _runs array<long>")
    first = found.groupBy("_stretch").agg(F.min(F.struct("_id", "_at")).alias("_first"), F.first("_runs").alias("_runs"), F.max("_id").alias("_hi"))
    # both uses of ``first`` read all its columns, so that it is computed once
    copied = first.where(F.col("_first._id") < F.col("_hi")).select("_stretch", F.col("_first._id").alias("_lo"), F.size("_runs").alias("_number"))
    whole = found.join(copied, "_stretch").where("_lo < _id").select("_id", "_at", F.col("_number").alias("_n"))
    single = first.where(F.col("_first._id") <= F.col("_hi")).select("_first.*", F.posexplode("_runs").alias("_i", "_run")).select("_id", (F.col("_at") + F.col("_i")).alias("_at"), "_run")
    again = single.groupBy("_run").agg(F.min("_id").alias("_lo"), F.max("_id").alias("_hi")).where("_lo < _hi").select("_run", "_lo")
    part = single.join(again, "_run").where("_lo < _id").select("_id", "_at", F.lit(1).alias("_n"))
    covered = whole.unionByName(part).groupBy("_id").agg(F.collect_list(F.struct("_at", "_n")).alias("_covered"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return rows.join(covered, "_id", "left").mapInArrow(_cut(window, with_text), schema)


def op8(docs: DataFrame) -> DataFrame:
    return substring_dedup(docs)


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, ws FROM w),
runs AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS h FROM p WHERE i + 49 <= len(ws)),
firsts AS (SELECT h, min(doc_id) AS lo FROM runs GROUP BY h HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT r.doc_id, r.i FROM runs r JOIN firsts f USING (h) WHERE f.lo < r.doc_id),
words AS (SELECT p.doc_id, p.i, p.ws[p.i] AS word,
                 max(CASE WHEN hit.i IS NOT NULL THEN p.i END) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
          FROM p LEFT JOIN hit ON p.doc_id = hit.doc_id AND p.i = hit.i),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS t FROM words GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
