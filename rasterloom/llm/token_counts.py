"""Token counts by a whole-token shortcut.

A byte-level vocabulary cuts a text into pre-tokens by a pattern and merges each on its own.  Before the corpus is
read, every vocabulary string is put through the library's own merges: those that come out as one token
and nothing else are *proved*.  A pre-token that equals a proved string counts as one token at once; only the rest is merged, by
the library's model, and what it gives is remembered (``REMEMBERED`` pre-tokens a worker, then the memory starts
afresh; this changes no count).  The proof is one set of the vocabulary's size, broadcast.

Strings of special tokens inside a text are tokens of their own, as the library has it by default; the text between
is cut on its own.  The pattern's classes come from the ``regex`` module, which knows other code points than the library does:
a text with a code point that ``unicodedata`` doesn't list as assigned goes through the library as a whole, so do all texts
of vocabularies whose file asks for anything but the byte-level pattern (normaliser, prefix space, other models).

Null texts count as empty (0 bytes, 0 tokens).  Repeated rows give repeated rows.  A text is taken as a whole, however
long.  An empty table gives an empty result.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

# fixed values: the pattern by which byte-level vocabularies cut texts
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED = 500_000
LIMIT = 512


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The character that stands for each byte: itself if it can be seen, else the next one from 256 on."""
    seen = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def library(path: str):
    """(token count of a text, model, special strings, whether pre-tokens can be cut here)."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return (lambda text: len(pieces.encode(text))), None, (), False
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    cut = made.get("pre_tokenizer") or {}
    plain = made.get("normalizer") is None and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    model = made["model"]
    plain = plain and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    added = made.get("added_tokens") or []
    plain = plain and not any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return (lambda text: len(tokenizer.encode(text, add_special_tokens=False))), tokenizer.model, tuple(a["content"] for a in added), plain


@lru_cache(maxsize=4)
def proved(path: str) -> frozenset[str]:
    """Vocabulary strings, as text, that the library's merges leave as the one token they are."""
    _, model, special, plain = library(path)
    if not plain:
        return frozenset()
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    back = {c: b for b, c in byte_letters().items()}
    out = set()
    for letters, number in vocabulary.items():
        if letters in special or any(c not in back for c in letters):
            continue
        try:
            text = bytes(back[c] for c in letters).decode("utf-8")
        except UnicodeDecodeError:  # part of a character: never a whole pre-token
            continue
        tokens = model.tokenize(letters)
        if len(tokens) == 1 and tokens[0].id == number:
            out.add(text)
    return frozenset(out)


@lru_cache(maxsize=1)
def unsettled() -> np.ndarray:
    """Code points that aren't assigned in ``unicodedata``: their class may differ between libraries."""
    return np.fromiter((unicodedata.category(chr(c)) in ("Cn", "Cs") for c in range(0x110000)), bool, 0x110000)


class Counter:
    """Token counts of texts for one vocabulary."""

    def __init__(self, path: str, whole: frozenset[str]):
        self.count, self.model, special, self.plain = library(path)
        self.whole = whole
        self.special = special
        self.marks = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.cut = regex.compile(PATTERN)
        self.letters = {b: c for b, c in byte_letters().items()}
        self.known: dict[str, int] = {}
        self.merged = 0  # pre-tokens that went through merges

    def rest(self, piece: str) -> int:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.merged += 1
        n = len(self.model.tokenize("".join([self.letters[b] for b in piece.encode("utf-8")])))
        if len(piece) <= 64:
            self.known[piece] = n
        return n

    def part(self, text: str) -> int:
        whole, known = self.whole, self.known
        pieces = self.cut.findall(text)
        others = [p for p in pieces if p not in whole]
        n = len(pieces) - len(others)
        for p in others:
            c = known.get(p)
            n += self.rest(p) if c is None else c
        return n

    def __call__(self, text: str) -> int:
        if not self.plain:
            return self.count(text)
        if not text.isascii() and unsettled()[np.frombuffer(text.encode("utf-32-le"), "<u4")].any():
            return self.count(text)
        if self.marks is None or not any(s in text for s in self.special):
            return self.part(text)
        parts = self.marks.split(text)
        return len(parts) - 1 + sum(map(self.part, parts))


def _counted(path: str, shared):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(path, shared.value)
        for batch, texts in slices(batches, "_text"):
            n = [count(t.decode("utf-8", "replace")) for t in texts]
            yield pa.record_batch([*[batch.column(i) for i, c in enumerate(batch.schema.names) if c != "_text"], pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64())], [*[c for c in batch.schema.names if c != "_text"], "n_bytes", "n_tokens"])

    return each


def token_counts(docs: DataFrame, vocabulary: str, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry``, n_bytes (UTF-8) and n_tokens.  vocabulary: a .json file of tokenizers or a sentencepiece .model."""
    rows = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)], F.col(text_col).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(proved(vocabulary))  # of the vocabulary's size at most
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return rows.mapInArrow(_counted(vocabulary, shared), schema).withColumnsRenamed({f"_c{i}": c for i, c in enumerate(carry)})


def op12(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
