"""Quality classifier learnt from trusted positives and unlabelled text (non-negative PU risk).

Texts become 16 figures (lengths, shares of kinds of characters and words, repeats), and each figure
a piecewise linear basis over fixed knots, so that the model f is a sum of one curve a figure.  With
squared loss the unbiased PU risk

    pi E_P[l(f, 1)] + E_U[l(f, -1)] - pi E_P[l(f, -1)]

depends on first and second moments of the basis only.  Those of U are summed over all documents,
those of P over the trusted positives, so every step of the descent sees the whole corpus.  Where
the last two terms together would fall below zero, a step goes against them alone (the non-negative
correction).  The class prior pi is the ratio of U's to P's share above a threshold of a first model's
values (held-back positives, values in fixed bins, all documents), the one with the least upper bound.  A logistic curve
fitted to a held-back quarter of the labelled rows sets the scale of the score; no label is used
otherwise.

Labelled rows: at most ``max_labelled``, the first by a hash of the id.  Figures (no text) go
through a scratch table.  What reaches the driver is one row for each pair of basis functions.

Null texts count as empty.  Labels that are null are left out; without positives every score is the
share of positives (0.5 without labels).  Repeated rows give repeated rows.  An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix, scratch, slices
from .fertility import _again, _sums, base_counts
from .toxicity import calibration, curve, held_out, labelled_sample, logistic_fit

SHARE = (0.0, 0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0)
KNOTS: dict[str, tuple[float, ...]] = {
    "log_words": (0, 2, 3, 4, 5, 6, 7, 8, 10),
    "word_length": (1, 2, 3, 4, 5, 6, 7, 9, 12, 20),
    "upper": SHARE,
    "digits": SHARE,
    "symbols": SHARE,
    "shouts": SHARE,
    "points": SHARE,
    "stutter": SHARE,
    "distinct": SHARE,
    "repeats": SHARE,
    "same_lines": SHARE,
    "lines": SHARE,
    "beyond_ascii": SHARE,
    "sentence_ends": SHARE,
    "capitals": SHARE,
    "single": SHARE,
}
BINS = 128  # of model values, over [-2, 2]


def figures(texts: list[bytes]) -> np.ndarray:
    """One row of ``KNOTS`` figures for each text."""
    w = Words(texts)
    h = w.hashes()
    base = base_counts(w, h)
    n, words = len(texts), np.maximum(w.counts, 1)
    kind = np.zeros((256,), np.int8)
    kind[65:91], kind[97:123], kind[48:58] = 1, 2, 3
    for c in b"!?":
        kind[c] = 4
    for c in b".,;:'\"()-":
        kind[c] = 5
    k = kind[w.buf]
    chars = np.maximum(base["word_chars"], 1)
    count = lambda mask: _sums(mask, w.doc_at)
    upper, lower = count(k == 1), count(k == 2)
    doc = w.doc_of()
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    once = ~_again(mix(h ^ mix(doc.astype(np.uint64), 11)))
    last, first = w.buf[np.maximum(w.end - 1, 0)] if len(h) else h, w.buf[w.begin] if len(h) else h
    per_word = lambda mask: _sums(mask, w.first) / words
    size = w.end - w.begin
    columns = [
        np.log1p(w.counts),
        base["word_chars"] / words,
        upper / np.maximum(upper + lower, 1),
        count(k == 3) / chars,
        base["n_symbols"] / chars,
        count(k == 4) / chars,
        count(k == 5) / chars,
        per_word(same),
        per_word(once),
        base["n_repeat_words"] / words,
        base["n_dup_lines"] / np.maximum(count(w.buf == 10) + 1, 1),
        np.minimum(count(w.buf == 10) / words, 1.0),
        count(w.buf >= 0xC0) / chars,
        per_word(np.isin(last, list(b".!?"))),
        per_word((first >= 65) & (first <= 90)),
        per_word(size == 1),
    ]
    return np.stack([np.asarray(c, float) for c in columns], axis=1).reshape(n, len(KNOTS))


def basis(x: np.ndarray) -> np.ndarray:
    """Hat functions over the knots of each figure; they add up to 1 for each figure."""
    parts = []
    for j, knots in enumerate(KNOTS.values()):
        t = np.asarray(knots, float)
        v = np.clip(x[:, j], t[0], t[-1])
        i = np.clip(np.searchsorted(t, v, "right") - 1, 0, len(t) - 2)
        right = (v - t[i]) / (t[i + 1] - t[i])
        b = np.zeros((len(v), len(t)))
        rows = np.arange(len(v))
        b[rows, i], b[rows, i + 1] = 1 - right, right
        parts.append(b)
    return np.concatenate(parts, axis=1)


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches, "_text"):
        x = figures(texts)
        yield pa.record_batch([batch.column("_lid"), *[pa.array(x[:, j]) for j in range(x.shape[1])]], ["_lid", *[f"_x{j}" for j in range(x.shape[1])]])


def _read(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(f"_x{j}").to_numpy() for j in range(len(KNOTS))], axis=1)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over a task: rows (i, j, sum over all, sum over positives) of products of basis functions; row (-1, -1) has the numbers."""
    size = sum(map(len, KNOTS.values()))
    u, p, n = np.zeros((size, size)), np.zeros((size, size)), np.zeros(2)
    for batch in batches:
        for a in range(0, batch.num_rows, 20_000):
            part = batch.slice(a, 20_000)
            b = basis(_read(part))
            own = part.column("_positive").fill_null(0).to_numpy(zero_copy_only=False) == 1
            u += b.T @ b
            p += b[own].T @ b[own]
            n += [len(b), own.sum()]
    i, j = np.nonzero(np.triu(u))
    yield pa.record_batch([pa.array(np.r_[-1, i].astype(np.int32)), pa.array(np.r_[-1, j].astype(np.int32)), pa.array(np.r_[n[0], u[i, j]]), pa.array(np.r_[n[1], p[i, j]])], ["_i", "_j", "_u", "_p"])


def descend(a_u: np.ndarray, a_p: np.ndarray, m_u: np.ndarray, m_p: np.ndarray, prior: float, ridge: float = 1e-3, steps: int = 200, rate: float = 0.2) -> np.ndarray:
    """Weights of f that minimise the non-negative PU risk with squared loss (scaled by 4)."""
    size = len(m_u)
    scale = a_u + ridge * np.eye(size)
    w = np.zeros(size)
    for _ in range(steps):
        negative = (1 + 2 * m_u @ w + w @ a_u @ w) - prior * (1 + 2 * m_p @ w + w @ a_p @ w)
        grad_negative = 2 * (m_u + a_u @ w) - 2 * prior * (m_p + a_p @ w)
        if negative < 0:
            step = -grad_negative  # towards zero from below
        else:
            step = grad_negative + 2 * prior * (a_p @ w - m_p) + 2 * ridge * w
        w -= rate / 2 * np.linalg.solve(scale, step)
    return w


def _values(weights: np.ndarray):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 20_000):
                part = batch.slice(a, 20_000)
                yield pa.record_batch([part.column("_lid"), pa.array(basis(_read(part)) @ weights)], ["_lid", "_f"])

    return each


def class_prior(bins: np.ndarray, everyone: np.ndarray, positives: np.ndarray, risk: float = 0.1) -> float:
    """Ratio of the shares of all documents and of positives above the threshold where an upper bound of it is least.

    The bound holds with probability 1 - ``risk``; it keeps off thresholds that few positives pass, where the ratio is noise.
    """
    n_u, n_p = everyone.sum(), positives.sum()
    if not n_p:
        return 0.5
    order = np.argsort(-bins)
    u, p = np.cumsum(everyone[order]) / n_u, np.cumsum(positives[order]) / n_p
    u, p = u[p > 0], p[p > 0]
    doubt = np.sqrt(np.log(4 / risk) / 2) * (n_u**-0.5 + n_p**-0.5)
    best = int(((u + doubt) / p).argmin())
    return float(np.clip(u[best] / p[best], 0.02, 0.98))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 4, fold: int = 2, max_labelled: int = 65_536) -> DataFrame:
    """doc_id, value (f) and score of each row."""
    xs = [f"_x{j}" for j in range(len(KNOTS))]
    rows = docs.select(F.col(id_col).cast("long").alias("_lid"), F.col(text_col).alias("_text"))
    x = scratch(rows.mapInArrow(_figures, "_lid long, " + ", ".join(f"{c} double" for c in xs)), "figures")
    sample = labelled_sample(labels, label_col, id_col, folds, fold, max_labelled)  # max_labelled rows at most
    trusted = F.broadcast(sample.where((F.col("_label") == 1) & ~calibration()).select("_lid", F.lit(1).alias("_positive")))
    sums = x.join(trusted, "_lid", "left").select("_positive", *xs).mapInArrow(_moments, "_i int, _j int, _u double, _p double").groupBy("_i", "_j").agg(F.sum("_u").alias("_u"), F.sum("_p").alias("_p")).toArrow()
    i, j, u, p = (sums.column(c).to_numpy() for c in ("_i", "_j", "_u", "_p"))
    n_u, n_p = (float(v[i < 0].sum()) for v in (u, p))
    size = sum(map(len, KNOTS.values()))
    weights, slope, intercept = np.zeros(size), 0.0, 0.0
    if n_p:
        a_u, a_p = np.zeros((size, size)), np.zeros((size, size))
        live = i >= 0
        for a, v, n in ((a_u, u, n_u), (a_p, p, n_p)):
            a[i[live], j[live]] = a[j[live], i[live]] = v[live] / n
        block = slice(0, len(next(iter(KNOTS.values()))))  # hats of one figure add up to 1: means are row sums of a block
        m_u, m_p = a_u[:, block].sum(axis=1), a_p[:, block].sum(axis=1)
        first = x.mapInArrow(_values(descend(a_u, a_p, m_u, m_p, 0.5)), "_lid long, _f double")
        held = F.broadcast(sample.where((F.col("_label") == 1) & calibration()).select("_lid", F.lit(1).alias("_positive")))
        bins = first.join(held, "_lid", "left").groupBy(F.floor((F.least(F.greatest(F.col("_f"), F.lit(-2.0)), F.lit(2.0)) + 2) * (BINS / 4)).alias("_bin")).agg(F.count(F.lit(1)).alias("_u"), F.sum(F.coalesce("_positive", F.lit(0))).alias("_p")).toArrow()
        prior = class_prior(*(bins.column(c).to_numpy() for c in ("_bin", "_u", "_p")))
        weights = descend(a_u, a_p, m_u, m_p, prior)
    scored = x.mapInArrow(_values(weights), "_lid long, _f double")
    known = scored.join(F.broadcast(sample.where(calibration())), "_lid").groupBy("_lid").agg(F.first("_f").alias("_f"), F.first("_label").alias("_label")).toArrow()  # max_labelled ids at most
    slope, intercept = logistic_fit(known.column("_f").to_numpy(), known.column("_label").to_numpy().astype(float))
    return scored.select(F.col("_lid").alias("doc_id"), F.col("_f").alias("value"), curve(F.col("_f"), slope, intercept).alias("score"))


def op4(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_quality(docs.select("doc_id", "text"), labels.select("doc_id", "quality"))
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "value")
