"""Quality rules: base rules on words and lines, then tokeniser fertility.

Public vocabularies cut each word (with the blank before it) into tokens.  A document's measures,
for each vocabulary: characters per token, share of byte tokens (pieces smaller than a code point:
byte fallback) and entropy of its tokens in bits.  A document belongs to the band of its language
(one of ``LIMITS``), else of the script of most of its letters.  A band has fixed limits (those of ``other``
admit any share of byte tokens) and is narrowed around the median of all its documents that pass the base rules:
characters per token, and entropy as a share of the most that so many tokens can have, may differ by
``width`` median absolute deviations (a deviation counts as a hundredth of the median at least) times
sqrt(1 + ``scatter`` / tokens), as figures of few tokens scatter more.  One rule holds for all lengths: a
document with a measure outside its band is rejected.

Words are cut apart, each with the blank before it; line feeds, indentation and double blanks are not tokenised.

One pass over the texts without a shuffle; its figures (no text) go to a scratch table, from which
medians (of values rounded to 0.001, so what a task holds is bounded) and verdicts come.  Bands are
few by definition and are broadcast.  Each word is cut once per worker: a table keyed by 64-bit
word hashes (bounded by ``CACHE_WORDS``, then started anew, which changes no result) maps it to its
tokens.  Repeats (lines, windows of words) are found by sorting hashes.

Null texts have no words: all counts 0, base_failed true, kept false.  Null or unknown languages go
by script.  Repeated rows give repeated rows.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix, scratch, slices, span_hash, word_texts

CACHE_WORDS = 1_000_000
VOCABULARIES = ("piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken")
# fixed limits (least, most) of characters per token, share of byte tokens, entropy in bits
LIMITS: dict[str, dict[str, tuple[float, float]]] = {
    "en": {"chars_per_token": (1.2, 12.0), "byte_share": (0.0, 0.25), "entropy": (2.5, 16.0)},
    "de": {"chars_per_token": (1.1, 12.0), "byte_share": (0.0, 0.30), "entropy": (2.5, 16.0)},
    "fr": {"chars_per_token": (1.1, 12.0), "byte_share": (0.0, 0.30), "entropy": (2.5, 16.0)},
    "es": {"chars_per_token": (1.1, 12.0), "byte_share": (0.0, 0.30), "entropy": (2.5, 16.0)},
    "Latin": {"chars_per_token": (1.0, 12.0), "byte_share": (0.0, 0.50), "entropy": (2.5, 16.0)},
    "Greek": {"chars_per_token": (0.4, 10.0), "byte_share": (0.0, 0.90), "entropy": (2.5, 16.0)},
    "Cyrillic": {"chars_per_token": (0.4, 10.0), "byte_share": (0.0, 0.90), "entropy": (2.5, 16.0)},
    "other": {"chars_per_token": (0.2, 12.0), "byte_share": (0.0, 1.0), "entropy": (2.0, 16.0)},
}
MEASURES = ("chars_per_token", "byte_share", "entropy")
# first code points of the ranges that decide the script
SCRIPT_FROM = (0x0041, 0x0250, 0x0370, 0x0400, 0x0530)
SCRIPTS = ("other", "Latin", "other", "Greek", "Cyrillic", "other")


def _by_blank(words: list[str], encode, begins: np.ndarray, together: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(ids, tokens per word): words cut ``together`` at a time, where the pieces that begin a word tell them apart."""
    all_ids, all_sizes = [], []
    for k in range(0, len(words), together):
        part = words[k : k + together]
        ids = np.array(encode(" ".join(part)), np.int32)
        head = np.flatnonzero(begins[ids])
        if len(head) == len(part) and head[0] == 0:
            sizes = np.diff(np.r_[head, len(ids)])
        else:  # a word holds the mark itself, or is dropped by the model's normalisation
            cut = [encode(w) for w in part]
            ids, sizes = np.array([i for c in cut for i in c], np.int32), np.array([len(c) for c in cut], np.int64)
        all_ids.append(ids)
        all_sizes.append(sizes)
    return np.concatenate(all_ids), np.concatenate(all_sizes)


class Cutter:
    """Cuts words with one vocabulary; remembers the words it has seen.

    keys    sorted word hashes; row: where a key's tokens are in the arrays below
    start   token offsets, ids: token ids, part: whether an id is a byte token
    """

    def __init__(self, path: str):
        name = path.rsplit("/", 1)[-1]
        if name.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = range(model.get_piece_size())
            self.part = np.array([model.is_byte(i) for i in pieces])
            begins = np.array([model.id_to_piece(i).startswith("\u2581") for i in pieces])

            def cut(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
                return _by_blank(words, lambda text: model.encode(text, num_threads=1), begins)
        else:
            import public_tokenizers
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            coder = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.part = np.zeros(max(ranks.values()) + 1, bool)
            length = np.zeros(len(self.part), np.int64)
            for token, i in ranks.items():
                length[i] = len(token)
                try:
                    token.decode()
                except UnicodeDecodeError:
                    self.part[i] = True

            def cut(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
                # no token reaches over a blank, so the words are cut together and told apart by bytes
                ids = np.array(coder.encode_ordinary(" " + " ".join(words)), np.int32)
                ends = np.cumsum(np.fromiter((len(w.encode()) + 1 for w in words), np.int64, len(words)))
                stop = np.searchsorted(np.cumsum(length[ids]), ends) + 1
                return ids, np.diff(stop, prepend=0)

        self.cut = cut
        self.forget()

    def forget(self) -> None:
        self.keys, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.start, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def rows(self, keys: np.ndarray, text_of) -> np.ndarray:
        """The row of each of the sorted, distinct ``keys``; text_of(indexes) gives the words of new ones."""
        if len(self.keys) > CACHE_WORDS:
            self.forget()
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        new = np.flatnonzero(~known)
        if len(new):
            ids, sizes = self.cut(text_of(new))
            rows = len(self.start) - 1 + np.arange(len(new))
            self.start = np.r_[self.start, self.start[-1] + np.cumsum(sizes)]
            self.ids = np.r_[self.ids, ids]
            place = np.searchsorted(self.keys, keys[new])
            self.keys, self.row = np.insert(self.keys, place, keys[new]), np.insert(self.row, place, rows)
            at = np.searchsorted(self.keys, keys)
        return self.row[at]


@lru_cache(maxsize=8)
def cutter(path: str) -> Cutter:
    return Cutter(path)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def _again(key: np.ndarray) -> np.ndarray:
    """Of each item: is its key another item's too?"""
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(key), bool)
    out[order] = np.r_[False, same] | np.r_[same, False] if len(key) else out
    return out


def base_counts(w: Words, hashes: np.ndarray) -> dict[str, np.ndarray]:
    n = len(w.first) - 1
    point = (w.buf & 0xC0) != 0x80
    mark = np.zeros(256, bool)
    mark[list(b"#*$%&|<>")] = True
    out = {"n_words": w.counts, "word_chars": _sums(point & w.solid, w.doc_at), "n_symbols": _sums(mark[w.buf], w.doc_at)}
    # lines: the text between line feeds, and the blank after each text ends its last line
    last = np.zeros(len(w.buf), bool)
    last[w.doc_at[1:] - 1] = True
    stop = np.flatnonzero((w.buf == 10) | last)
    start = np.r_[0, stop[:-1] + 1] if len(stop) else stop
    live = np.zeros(len(w.buf) + 1, np.int64)
    np.cumsum(w.solid, out=live[1:])
    full = live[stop] > live[start]
    start, stop = start[full], stop[full]
    doc = np.searchsorted(w.doc_at, start, "right") - 1
    key = mix(span_hash(w.buf, start, stop) ^ mix(doc.astype(np.uint64), 3))
    order = np.argsort(key, kind="stable")
    dup = np.zeros(len(key), bool)
    if len(key):
        dup[order[1:]] = key[order[1:]] == key[order[:-1]]
    out["n_dup_lines"] = np.bincount(doc[dup], minlength=n)
    at, window = w.windows(hashes, 8)
    owner = w.doc_of()
    repeated = at[_again(mix(window ^ mix(owner[at].astype(np.uint64), 5)))]
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, repeated, 1)
    np.add.at(edge, repeated + 8, -1)
    out["n_repeat_words"] = _sums(np.cumsum(edge[:-1]) > 0, w.first)
    return out


def token_measures(w: Words, rows: np.ndarray, c: Cutter, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, characters per token, byte share, entropy in bits) of each document."""
    n = len(w.first) - 1
    size = c.start[rows + 1] - c.start[rows]
    owner = np.repeat(w.doc_of(), size)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(c.start[rows], size)
    ids = c.ids[at].astype(np.int64)
    tokens = _sums(size, w.first)
    byte = np.bincount(owner, weights=c.part[ids], minlength=n)
    pair = np.sort(owner * (len(c.part) + 1) + ids)
    head = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, np.int64)
    count = np.diff(np.r_[head, len(pair)]).astype(float)
    summed = np.bincount(pair[head] // (len(c.part) + 1), weights=count * np.log2(np.maximum(count, 1)), minlength=n) if len(pair) else np.zeros(n)
    some = np.maximum(tokens, 1)
    return tokens, chars / some, byte / some, np.where(tokens > 0, np.log2(some) - summed / some, 0.0)


def script_of(text: bytes) -> str:
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    kind = np.searchsorted(np.asarray(SCRIPT_FROM), points, "right")
    votes = np.bincount(kind[points >= 0x41], minlength=len(SCRIPTS))
    return SCRIPTS[int(votes.argmax())] if votes.any() else "other"


def _measure(paths: tuple[str, ...], limits: Mapping[str, Mapping[str, tuple[float, float]]]):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "_text"):
            w = Words(texts)
            hashes = w.hashes()
            base = base_counts(w, hashes)
            keys, index, back = np.unique(hashes, return_index=True, return_inverse=True)

            def text_of(new: np.ndarray, w: Words = w, index: np.ndarray = index) -> list[str]:
                return word_texts(w, index[new])

            names = [lang if lang in limits else script_of(t) for lang, t in zip(batch.column("_lang").to_pylist(), texts)]
            more: list[pa.Array] = []
            for path in paths:
                c = cutter(path)
                rows = c.rows(keys, text_of)[back] if len(keys) else np.zeros(0, np.int64)
                tokens, *measures = token_measures(w, rows, c, base["word_chars"])
                more += [pa.array(tokens, pa.int64()), *[pa.array(v, pa.float64()) for v in measures]]
            counts = [pa.array(base[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            yield pa.record_batch([batch.column("_id"), *counts, pa.array(names, pa.string()), *more], _names(paths))

    return each


def _names(paths: tuple[str, ...]) -> list[str]:
    return ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "band"] + [f"{m}_{i}" for i in range(len(paths)) for m in ("tokens", *MEASURES)]


def measure(docs: DataFrame, vocabularies: tuple[str, ...], limits: Mapping = LIMITS, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    types = ["long"] * 6 + ["string"] + ["long", "double", "double", "double"] * len(vocabularies)
    schema = ", ".join(f"{n} {t}" for n, t in zip(_names(vocabularies), types))
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), lang.alias("_lang"))
    return rows.mapInArrow(_measure(tuple(vocabularies), limits), schema)


def fertility_rules(docs: DataFrame, vocabularies: tuple[str, ...], limits: Mapping = LIMITS, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", width: float = 8.0, scatter: float = 100.0) -> DataFrame:
    """vocabularies: paths of .model (sentencepiece) or .tiktoken files, the same on every executor."""
    figures = scratch(measure(docs, vocabularies, limits, id_col, text_col, lang_col), "fertility")
    evenness = lambda i: F.col(f"entropy_{i}") / F.log2(F.greatest(F.col(f"tokens_{i}"), F.lit(2)).cast("double"))
    inner = {f"chars_{i}": F.col(f"chars_per_token_{i}") for i in range(len(vocabularies))} | {f"even_{i}": evenness(i) for i in range(len(vocabularies))}
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    passed = figures.where(~failed)
    middle = F.broadcast(passed.groupBy("band").agg(*[F.median(F.round(v, 3)).alias(f"_mid_{c}") for c, v in inner.items()]))
    spread = F.broadcast(passed.join(middle, "band").groupBy("band").agg(*[F.median(F.round(F.abs(v - F.col(f"_mid_{c}")), 3)).alias(f"_mad_{c}") for c, v in inner.items()]))
    out = figures.join(middle, "band", "left").join(spread, "band", "left")
    kept = ~failed
    for i in range(len(vocabularies)):
        for m in MEASURES:
            low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
            for band, limit in limits.items():
                low, high = F.when(F.col("band") == band, F.lit(limit[m][0])).otherwise(low), F.when(F.col("band") == band, F.lit(limit[m][1])).otherwise(high)
            kept = kept & (F.col(f"{m}_{i}") >= low) & (F.col(f"{m}_{i}") <= high)
        for c in (f"chars_{i}", f"even_{i}"):
            mid = F.col(f"_mid_{c}")
            room = F.greatest(F.col(f"_mad_{c}"), mid * 0.01) * F.lit(width) * F.sqrt(1 + F.lit(scatter) / F.greatest(F.col(f"tokens_{i}"), F.lit(1)))
            kept = kept & F.coalesce(F.abs(inner[c] - mid) <= room, F.lit(True))
    figures_first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select(*figures_first, failed.alias("base_failed"), kept.alias("kept"), *[c for c in figures.columns if c not in figures_first])


def op1(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return fertility_rules(docs, tuple(public_tokenizers.path(v) for v in VOCABULARIES))
