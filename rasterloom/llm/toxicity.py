"""Toxicity by class-conditional Kneser-Ney models of words.

A word is a run of letters and digits (bytes beyond ASCII are letters but for blanks and punctuation there; ASCII in
lower case); in scripts without blanks, two neighbouring characters.  The models are Kneser-Ney models over the word as a history:
a word backs off to its beginning of ``LEVELS[-1]`` letters, that to the next shorter one, and so on.

* A word is counted in documents: in how many labelled documents of the class it is found.
* A beginning is counted in continuations, as Kneser and Ney have it: in how many different words of the class it
  goes on.  A beginning that one word only has is no evidence, so ``idiom`` isn't ``idiot`` and ``path`` isn't ``pathetic``; a
  stem with many endings is.
* Every count is discounted by ``DISCOUNT`` (continuation counts of one wholly); what is taken off goes to the counts that the classes share: of
  words, in how many of all documents they are found; of beginnings, the continuations of both classes together.
* With n' discounted counts where e are expected by the shared counts, the class's probability is the shared one times
  (n' + t b) / (e + t), b being the same quotient of the shorter expression and 1 at the root, t ``TRUST_WORD`` or ``TRUST_STEM``.  A
  word without labelled documents has the quotient of its longest known beginning.

A word's term is log p(word | toxic) - log p(word | ordinary).  A text's two log-likelihoods are compared by length: by the mean
of its words' likelihood ratios of order ``ORDER``, log(mean(exp(ORDER term))) / ORDER.  Order 0 would be their plain difference divided by the
number of words; a higher order lets a few strong words speak through many ordinary ones.  A logistic curve over
this difference gives the score, so that it never falls as evidence grows; it is fitted to differences of labelled documents by models
without their own fold (``FOLDS`` folds), so all labelled rows serve for counts and curve.

Every word of every labelled document counts, in both classes, and its shared count comes from one pass over all
documents.  Labelled rows: at most ``max_labelled``, the first by a hash of the id; this is the only sample.  The table
of words and beginnings is broadcast if it has ``broadcast_rows`` rows at most; beyond that texts meet it in a shuffled join, with the same scores.

Null texts count as empty; a text without words has differences of 0.  Of several labels of one id the
largest counts.  Labels that are null are left out.  Without labels of both classes every score is
0.5.  Repeated rows give repeated rows.  Columns of any name are kept; the two new ones come last and
get underscores where their names are taken.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import gc
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..batches import bounded
from .common import LOWER, _at, mix, scratch, signed, slices

LEVELS = (3, 4, 5, 6, 7, 8)  # letters of the beginnings
DISCOUNT, TRUST_WORD, TRUST_STEM = 0.75, 1.0, 4.0
ORDER = 3.0
FOLDS = 4
SLICE = 1_000_000  # bytes of text worked on at once
EVIDENCE, SCORE = "toxicity_evidence", "toxicity_score"
_MEAN = "_m"


def _letters(buf: np.ndarray) -> np.ndarray:
    """Which bytes belong to words: ASCII letters and digits, and beyond ASCII all but Latin-1 signs and the general and CJK punctuation blocks."""
    solid = ((buf >= 97) & (buf <= 122)) | ((buf >= 48) & (buf <= 57)) | (buf >= 128)
    one, two = np.append(buf[1:], 32), np.append(buf[2:], [32, 32])[: len(buf)]
    short = (buf == 0xC2) & (one >= 0xA0) & (one <= 0xBF)
    long = ((buf == 0xE2) & (one <= 0x81) & (one >= 0x80) & (two >= 0x80)) | ((buf == 0xE3) & (one == 0x80))
    for at, size in ((np.flatnonzero(short), 2), (np.flatnonzero(long), 3)):
        for k in range(size):
            solid[np.minimum(at + k, len(buf) - 1)] = False
    return solid


def _unspaced(buf: np.ndarray) -> np.ndarray:
    """Which bytes begin a character of a script that sets no blanks (Thai, Lao, Burmese, Khmer, kana, Chinese)."""
    one = np.append(buf[1:], 32)
    thai = (buf == 0xE0) & (one >= 0xB8) & (one <= 0xBB)
    khmer = (buf == 0xE1) & ((one >= 0x80) & (one <= 0x82) | (one >= 0x9E) & (one <= 0x9F))
    return thai | khmer | (buf == 0xE2) & (one >= 0xBA) | (buf >= 0xE3) & (buf <= 0xE9) | (buf == 0xEF) & (one >= 0xA4) & (one <= 0xAB) | (buf == 0xF0) & (one >= 0xA0)


class Expressions:
    """The words of some texts: ``text`` and ``word`` number each place, ``keys`` has for each different word its own key and those of its beginnings (0: none)."""

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        ends = np.append(0, np.cumsum(sizes))
        buf = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)] if texts else np.zeros(0, np.uint8)
        solid = _letters(buf)
        start = (buf & 0xC0) != 0x80  # of characters
        lone = _unspaced(buf) & solid
        after = np.zeros(len(buf), bool)  # the character after one of those is no part of its word
        at = np.flatnonzero(start)
        after[at[1:][lone[at[:-1]]]] = True
        begins = solid & (np.append(True, ~solid[:-1])[: len(buf)] | (lone | after) & start)
        begin = np.flatnonzero(begins)
        stops = np.append(~solid[1:] | begins[1:], True)[: len(buf)] & solid
        end = np.flatnonzero(stops) + 1
        place = np.flatnonzero(solid)
        rank = np.cumsum(solid) - solid  # of a byte among the bytes of words
        total = np.zeros(len(place) + 1, np.uint64)
        np.cumsum(_at(buf[place], place - np.repeat(begin, end - begin), 31), out=total[1:], dtype=np.uint64)
        first, size = (rank[begin] if len(begin) else begin), end - begin
        key = mix(total[first + size] - total[first] + size.astype(np.uint64), 31)
        alone = lone[begin] if len(begin) else np.zeros(0, bool)
        pair = np.append(alone[:-1] & alone[1:] & (end[:-1] == begin[1:]), False)[: len(begin)]
        behind = np.append(False, pair[:-1])[: len(begin)]
        key[:-1] = np.where(pair[:-1], mix(key[:-1] + key[1:] * np.uint64(0xD6E8FEB86659FD93), 32), key[:-1]) if len(key) else key[:-1]
        kept = np.flatnonzero(pair | ~behind)  # the last of a run is in the pair before it
        begin, end, first, size, alone = begin[kept], end[kept], first[kept], size[kept], alone[kept]
        found, where, self.word = np.unique(key[kept], return_index=True, return_inverse=True)
        self.text = np.searchsorted(ends, begin, side="right") - 1
        self.length = np.bincount(self.text, minlength=len(texts))
        letter = np.flatnonzero(start & solid)
        index = np.searchsorted(letter, begin[where])
        self.keys = np.zeros((1 + len(LEVELS), len(found)), np.int64)
        self.keys[0] = signed(found)
        for i, n in enumerate(LEVELS):
            cut = letter[np.minimum(index + n, max(len(letter) - 1, 0))] if len(letter) else begin[where]
            has = np.flatnonzero((index + n < len(letter)) & (cut < end[where]) & ~alone[where])
            part = cut[has] - begin[where][has]
            a = first[where][has]
            self.keys[1 + i, has] = signed(mix(total[a + part] - total[a] + part.astype(np.uint64), 40 + n))

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, word) once for each text that has the word."""
        both = np.unique(self.text * max(self.keys.shape[1], 1) + self.word)
        return both // max(self.keys.shape[1], 1), both % max(self.keys.shape[1], 1)


class Table:
    """Sorted keys with the log-ratios of all folds, then without each fold."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order] if values.shape[1] else values

    def find(self, key: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where there is none."""
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        return np.where(self.keys[at] == key, at, -1) if len(self.keys) else np.full(len(key), -1)

    def longest(self, keys: np.ndarray) -> np.ndarray:
        """The row of each word, or of its longest beginning."""
        row = self.find(keys[0])
        for level in keys[:0:-1]:
            open_ = np.flatnonzero((row < 0) & (level != 0))
            row[open_] = self.find(level[open_])
        return row


_CLASSES = [*[f"_t{f}" for f in range(FOLDS)], *[f"_o{f}" for f in range(FOLDS)]]
_STEMS = [f"_k{n}" for n in LEVELS]
_WORDS = "_key long, " + ", ".join(f"{c} long" for c in [*_STEMS, *_CLASSES])


def _merged(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Rows of equal key added up; the columns between key and counts are the same for a key."""
    keys, where, back = np.unique(np.concatenate([h[0] for h in held]), return_index=True, return_inverse=True)
    counts = np.zeros((len(keys), held[0][-1].shape[1]), np.int64)
    np.add.at(counts, back, np.concatenate([h[-1] for h in held]))
    return keys, *[np.concatenate([h[i] for h in held])[where] for i in range(1, len(held[0]) - 1)], counts


def _labelled_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of labelled documents with their beginnings, and in how many documents of each class and fold they are.  What a task holds is passed on beyond a million rows."""
    held: list[tuple[np.ndarray, ...]] = []

    def rows() -> Iterator[pa.RecordBatch]:
        keys, stems, counts = _merged(held)
        for a in range(0, len(keys), 100_000):
            b = slice(a, a + 100_000)
            yield pa.record_batch([pa.array(keys[b]), *[pa.array(c) for c in stems[b].T.copy()], *[pa.array(c) for c in counts[b].T.copy()]], ["_key", *_STEMS, *_CLASSES])

    for batch, texts in slices(batches, "_text", SLICE):
        fold = batch.column("_fold").to_numpy(zero_copy_only=False) + np.where(batch.column("_class").to_numpy(zero_copy_only=False) == 1, 0, FOLDS)
        x = Expressions(texts)
        text, word = x.distinct()
        counts = np.bincount(word * 2 * FOLDS + fold[text], minlength=x.keys.shape[1] * 2 * FOLDS).reshape(-1, 2 * FOLDS)
        held.append((x.keys[0], x.keys[1:].T, counts))
        if sum(len(h[0]) for h in held) > 500_000:
            held = [_merged(held)]
            if len(held[0][0]) > 1_000_000:
                yield from rows()
                held = []
    if held:
        yield from rows()


def _shared(chosen):
    """(_key, _all): in how many documents each word is found; the row without key has the sum over all words.

    chosen: a broadcast Table of the words that are counted, or None for all.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        total = 0
        for batch, texts in slices(batches, "_text", SLICE):
            x = Expressions(texts)
            _, word = x.distinct()
            times = np.bincount(word, minlength=x.keys.shape[1])
            total += len(word)
            at = np.arange(len(times)) if chosen is None else np.flatnonzero(chosen.value.find(x.keys[0]) >= 0)
            held.append((x.keys[0][at], times[at][:, None]))
            if sum(len(h[0]) for h in held) > 1_000_000:
                held = [_merged(held)]
                if len(held[0][0]) > 2_000_000:
                    yield pa.record_batch([pa.array(held[0][0]), pa.array(held[0][1][:, 0])], ["_key", "_all"])
                    held = []
        if held:
            keys, counts = _merged(held)
            yield pa.record_batch([pa.array(keys), pa.array(counts[:, 0])], ["_key", "_all"])
        yield pa.record_batch([pa.array([None], pa.int64()), pa.array([total], pa.int64())], ["_key", "_all"])

    return each


_VARIANTS: dict[str, int | None] = {"": None} | {str(f): f for f in range(FOLDS)}  # models with all folds, and without fold f
_RATIOS = [f"_r{v}" for v in _VARIANTS]


def _class_count(c: str, out: int | None) -> Column:
    return sum((F.col(f"_{c}{f}") for f in range(FOLDS) if f != out), F.lit(0))


def _constant(values: list[float]) -> Column:
    """Numbers as one array: a value that plans refer to, so that the code made for them is the same in every run."""
    return F.array(*[F.lit(float(v)) for v in values])


def _discounted(n: Column, ones: bool) -> Column:
    rest = F.greatest(n - F.lit(DISCOUNT), F.lit(0.0))
    return F.when(n <= 1, F.lit(0.0)).otherwise(rest) if ones else rest


_PLACES = range(2 * len(_VARIANTS))


def _sums(ones: bool) -> list[Column]:
    """Sums over rows with class counts _n and shared counts _all; what ``_quotients`` needs of them."""
    return [F.sum("_all").alias("_all"), *[F.sum(F.col("_n")[i]).alias(f"n{i}") for i in _PLACES], *[F.sum(_discounted(F.col("_n")[i], ones)).alias(f"k{i}") for i in _PLACES]]


def _quotients(rows: DataFrame, sums: dict, total: float | None, ones: bool) -> DataFrame:
    """_key and _q, the class quotients of rows with class counts _n, shared counts _all and the quotients _b that they back off to.

    Arrays have a place for each class and variant.  sums: ``_sums`` of the rows.  total: sum of all shared counts, those of
    expressions outside the rows included.  ones: counts of one are discounted wholly (continuation counts).
    """
    trust = TRUST_STEM if ones else TRUST_WORD
    n = _constant([sums[f"n{i}"] or 0 for i in _PLACES])
    freed = _constant([(sums[f"n{i}"] or 0) - (sums[f"k{i}"] or 0) for i in _PLACES])
    inside = _constant([sums["_all"] or 1, max(total or sums["_all"] or 1, 1.0)])
    part, expected = F.col("_all") / inside[0], F.col("_all") / inside[1]
    up = F.zip_with(F.zip_with("_n", freed, lambda v, f: _discounted(v, ones) + f * part), "_b", lambda v, b: v + b * trust)
    return rows.select("_key", F.zip_with(up, n, lambda v, c: v / (c * expected + trust)).alias("_q"))


def _beginnings(words: DataFrame, counts: list[Column]) -> DataFrame:
    """_level, _key, _parent (0: none), _all and _n of all beginnings of all levels, counted in one exchange."""
    flags = [(n > 0).cast("long").alias(f"_n{i}") for i, n in enumerate(counts)]
    own = [F.struct(F.lit(i).alias("_level"), F.col(stem).alias("_key"), (F.col(_STEMS[i - 1]) if i else F.lit(0)).cast("long").alias("_parent")) for i, stem in enumerate(_STEMS)]
    each = words.select(*flags, F.explode(F.array(*own)).alias("_s")).where("_s._key != 0").select("_s.*", *[f"_n{i}" for i in _PLACES])
    found = each.groupBy("_level", "_key").agg(F.first("_parent").alias("_parent"), F.count(F.lit(1)).alias("_all"), *[F.sum(f"_n{i}").alias(f"_n{i}") for i in _PLACES])
    return found.select("_level", "_key", "_parent", "_all", F.array(*[f"_n{i}" for i in _PLACES]).alias("_n"))


def log_ratios(words: DataFrame, shared: DataFrame) -> DataFrame:
    """_key and log p(toxic) - log p(ordinary) of words and beginnings, by all folds (_r) and without fold f (_r0, ...).

    Beginnings of all levels are counted and summed up at once; only their quotients follow level by level, each by one join with the level
    before it (a beginning backs off to none but that), so that the driver's plans stay small.
    """
    total = float(shared.where("_key IS NULL").agg(F.sum("_all")).first()[0] or 0)
    counts = [_class_count(c, out) for out in _VARIANTS.values() for c in "to"]
    stems = scratch(_beginnings(words, counts), "stems")
    sums = {r["_level"]: r.asDict() for r in stems.groupBy("_level").agg(*_sums(True)).collect()}  # a row for each of LEVELS
    levels: list[DataFrame] = []
    for i in sorted(sums):
        rows = stems.where(F.col("_level") == i)
        levels.append(scratch(_quotients(_backed(rows, levels[-1] if levels else None), sums[i], None, True), f"stems-{i}"))
    done = functools.reduce(DataFrame.unionByName, levels) if levels else None
    rows = words.select("_key", F.coalesce(*[F.nullif(F.col(s), F.lit(0)) for s in reversed(_STEMS)], F.lit(0)).alias("_parent"), F.array(*counts).alias("_n")).join(shared, "_key")
    every = _quotients(_backed(rows, done), rows.agg(*_sums(False)).first().asDict(), total, False)
    every = every.unionByName(done) if levels else every
    return every.select("_key", *[(F.log(F.col("_q")[2 * i]) - F.log(F.col("_q")[2 * i + 1])).cast("float").alias(f"_r{v}") for i, v in enumerate(_VARIANTS)])


def _backed(rows: DataFrame, done: DataFrame | None) -> DataFrame:
    """rows with _b, the quotients of their _parent (1 at the root)."""
    one = _constant([1.0] * (2 * len(_VARIANTS)))
    if done is None:
        return rows.withColumn("_b", one)
    above = done.select(F.col("_key").alias("_parent"), F.col("_q").alias("_above"))
    return rows.join(above, "_parent", "left").withColumn("_b", F.coalesce("_above", one)).drop("_above")


def differences(term: np.ndarray, x: Expressions) -> np.ndarray:
    """The difference of the two log-likelihoods of each text, by length: the mean of order ``ORDER`` of its words' ratios."""
    n = np.maximum(x.length, 1)
    return np.log1p(np.bincount(x.text, weights=np.expm1(ORDER * term), minlength=len(n)) / n) / ORDER


def _arrays(df: DataFrame, kinds: list[str]) -> list[np.ndarray]:
    """A bounded table's columns on the driver, without what Arrow holds of it."""
    rows = df.toArrow()
    out = [rows.column(i).to_numpy().astype(kind) for i, kind in enumerate(kinds)]
    del rows
    gc.collect()
    pa.default_memory_pool().release_unused()
    return out


def _model(table: DataFrame, ratios: list[str]):
    """Broadcast Table of the given log-ratios."""
    keys, *values = _arrays(table.select("_key", *ratios), ["i8", *["f4"] * len(ratios)])
    return table.sparkSession.sparkContext.broadcast(Table(keys, np.stack(values, axis=1) if values else np.zeros((len(keys), 0), np.float32)))


def _score(table, text: int, fold: int | None = None):
    """All columns and, after them, the difference of the text in column number ``text``; by models without the fold in column ``fold``, if that is given."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        for batch, texts in slices(batches, text, SLICE):
            x = Expressions(texts)
            row = t.longest(x.keys)[x.word]
            column = 0 if fold is None else batch.column(fold).to_numpy(zero_copy_only=False)[x.text]
            term = np.where(row >= 0, t.values[row, column], 0.0).astype(float) if len(t.keys) else np.zeros(len(row))
            yield pa.record_batch([*batch.columns, pa.array(differences(term, x))], [*batch.schema.names, _MEAN])

    return each


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All columns but the text, with the keys of each different word of each text: for the shuffled join."""
    for batch, texts in slices(batches, "_text", SLICE):
        x = Expressions(texts)
        width = max(x.keys.shape[1], 1)
        both, times = np.unique(x.text * width + x.word, return_counts=True)
        text, word = both // width, both % width
        for level, key in enumerate(x.keys):
            at = np.flatnonzero(key[word] != 0) if len(word) else word
            rest = batch.drop_columns(["_text"]).take(pa.array(text[at]))
            long = np.full(len(at), len(LEVELS) + 1 if level == 0 else level)
            yield pa.record_batch([*rest.columns, pa.array(word[at]), pa.array(long), pa.array(key[word[at]] if len(at) else key[:0]), pa.array(times[at]), pa.array(x.length[text[at]])], [*rest.schema.names, "_word", "_level", "_key", "_times", "_length"])


def logistic_regression(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """(weights, intercept) by Newton's method with halved steps, on standardised columns."""
    if not len(x) or y.min() == y.max():
        return np.zeros(x.shape[1]), 0.0
    mid, scale = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    z = np.c_[(x - mid) / scale, np.ones(len(x))]
    w, hold = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], ridge * len(x)), 1e-9]

    def loss(w: np.ndarray) -> float:
        m = z @ w
        return float(np.logaddexp(0, m).sum() - y @ m + 0.5 * (hold * w * w).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(hold + 1e-9), z.T @ (y - p) - hold * w)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w[:-1] / scale, float(w[-1] - (w[:-1] * mid / scale).sum())


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope (0 at least) and intercept of p = 1 / (1 + exp(-(a x + b))); warns where the slope has to be 0."""
    a, b = logistic_regression(x.reshape(-1, 1), y, ridge)
    if len(x) and a[0] <= 0 and 0 < y.mean() < 1:
        warnings.warn("values don't rise with the label: all scores are the label's share", stacklevel=2)
        return 0.0, float(np.log(y.mean() / (1 - y.mean())))
    return float(a[0]), b


def held_out(id_col: str, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % folds == fold


def labelled_sample(labels: DataFrame, label: str, id_col: str, folds: int, fold: int, most: int) -> DataFrame:
    """At most ``most`` rows (_lid, _label) outside the held-out fold, the first by a hash of the id; one row an id."""
    own = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(id_col, folds, fold))
    own = own.groupBy(F.col(id_col).cast("long").alias("_lid")).agg(F.max(F.col(label).cast("int")).alias("_label"))
    return own.orderBy(F.xxhash64("_lid"), "_lid").limit(most)


def calibration() -> Column:
    return F.pmod(F.xxhash64(F.col("_lid"), F.lit(99)), F.lit(4)) == 0


def curve(x: Column, slope: float, intercept: float) -> Column:
    return F.lit(1.0) / (F.exp(-(x * F.lit(slope) + F.lit(intercept))) + 1)


def _joined(rows: DataFrame, table: DataFrame, ratio: Column, extra: tuple[str, ...] = ()) -> DataFrame:
    """Differences by a shuffled join of the texts' words with the table.  rows: a column _text among others."""
    numbered = scratch(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    small = numbered.select("_row", *extra, "_text")
    more = [T.StructField(c, T.LongType()) for c in ("_word", "_level", "_key", "_times", "_length")]
    found = small.mapInArrow(_candidates, T.StructType([*[f for f in small.schema.fields if f.name != "_text"], *more]))
    words = found.join(table, "_key").groupBy("_row", "_word").agg(F.max_by(ratio.cast("double"), "_level").alias("_v"), F.first("_times").alias("_times"), F.first("_length").alias("_length"))
    part = F.col("_times") / F.col("_length")
    sums = words.groupBy("_row").agg((F.log1p(F.sum(part * F.expm1(F.col("_v") * ORDER))) / ORDER).alias(_MEAN))
    return numbered.join(sums, "_row", "left").drop("_row").na.fill(0.0, [_MEAN])


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in (t.lower() for t in taken):
        name += "_"
    return name


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, fold: int = 1, max_labelled: int = 65_536, broadcast_rows: int = 8_000_000) -> DataFrame:
    """All columns of ``docs``, then EVIDENCE (log odds) and SCORE."""
    names = docs.columns
    docs = bounded(docs).toDF(*[f"_s{i}" for i in range(len(names))])
    text = names.index(text_col)
    sample = labelled_sample(labels, label_col, id_col, folds, fold, max_labelled)
    sample = scratch(sample.select("_lid", F.col("_label").alias("_class"), F.pmod(F.xxhash64("_lid", F.lit(99)), F.lit(FOLDS)).cast("int").alias("_fold")), "labelled")
    rows = docs.select(F.col(f"_s{names.index(id_col)}").cast("long").alias("_lid"), F.col(f"_s{text}").alias("_text"))
    known = rows.join(F.broadcast(sample), "_lid").select("_lid", "_class", "_fold", "_text")  # max_labelled ids at most
    words = known.select("_text", "_class", "_fold").mapInArrow(_labelled_words, _WORDS)
    words = scratch(words.groupBy("_key").agg(*[F.first(c).alias(c) for c in _STEMS], *[F.sum(c).alias(c) for c in _CLASSES]), "words")
    size = words.count()
    if size <= broadcast_rows:
        chosen = _model(words, [])
        shared = rows.select("_text").mapInArrow(_shared(chosen), "_key long, _all long")
    else:
        every = rows.select("_text").mapInArrow(_shared(None), "_key long, _all long")
        shared = every.join(words.select("_key"), "_key", "left_semi").unionByName(every.where("_key IS NULL"))
    shared = scratch(shared.groupBy("_key").agg(F.sum("_all").alias("_all")), "shared")
    both = words.agg(*[F.sum(_class_count(c, None)).alias(c) for c in "to"]).first()
    fits = bool(both["t"]) and bool(both["o"])
    table = log_ratios(words, shared) if fits else words.select("_key", *[F.lit(0.0).cast("float").alias(r) for r in _RATIOS])
    table = scratch(table, "log-ratios")
    if size <= broadcast_rows:
        chosen.destroy()  # on the driver too
    if table.count() <= broadcast_rows:
        more = [T.StructField(_MEAN, T.DoubleType())]
        without = _model(table, _RATIOS[1:])
        seen = known.mapInArrow(_score(without, 3, 2), T.StructType([*known.schema.fields, *more])).groupBy("_lid").agg(F.first("_class").alias("_class"), F.max(_MEAN).alias(_MEAN))
        mean, kind = _arrays(seen.select(_MEAN, "_class"), ["f8", "f8"])  # max_labelled rows at most
        without.destroy()
        scored = docs.mapInArrow(_score(_model(table, _RATIOS[:1]), text), T.StructType([*docs.schema.fields, *more]))
    else:
        seen = _joined(known, table, F.element_at(F.array(*[F.col(r) for r in _RATIOS[1:]]), F.col("_fold") + 1), ("_fold",))
        seen = seen.groupBy("_lid").agg(F.first("_class").alias("_class"), F.max(_MEAN).alias(_MEAN))
        mean, kind = _arrays(seen.select(_MEAN, "_class"), ["f8", "f8"])
        scored = _joined(docs.withColumn("_text", F.col(f"_s{text}")), table, F.col("_r")).drop("_text")
    slope, intercept = logistic_fit(mean, kind, ridge=1e-4)
    scored = scored.withColumn("_evidence", F.col(_MEAN) * F.lit(slope) + F.lit(intercept)).withColumn("_score", F.lit(1.0) / (F.exp(-F.col("_evidence")) + 1)).drop(_MEAN)
    last = [*names, _free(EVIDENCE, names)]
    return scored.toDF(*last, _free(SCORE, last))


def op10(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_documents(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= 0.7).cast("int").alias("predicted"), F.col(EVIDENCE).alias("evidence"))
