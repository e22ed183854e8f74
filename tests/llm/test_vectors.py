"""Whitening, token counts and centroid clustering against plain loops, on rows with every oddity."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from rasterloom.llm import centroids, token_counts, whitening

VECTORS = "vec_id long, embedding array<float>, label int, _x string, _id string, n int, cluster int"


def vectors(d, n=90):
    rnd = random.Random(d)
    rows = [(i, [rnd.gauss(0.1 * (i % 5), 0.3) for _ in range(d)]) for i in range(n)]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in rows]
    odd = [(900, None), (901, []), (902, [None] * d), (903, [0.5] * (d - 1) + [None]), (904, [float("nan")] + [0.1] * (d - 1)), (905, [float("inf")] * d), (906, [0.1] * (d + 1)), (907, [-float("inf")] + [0.0] * (d - 1))]
    good = [*rows, rows[3], rows[3], (None, rows[7][1]), (None, [0.25] * d), (5, [0.0] * d)]
    return good, [(i, v, 1, "x", "y", 2, 3) for i, v in [*good, *odd]]


@pytest.mark.parametrize("d", [3, 64])
def test_whitening(spark, d):
    good, rows = vectors(d)
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = whitening.op11(df).collect()
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in good]
    n, k = len(x), min(8, d)
    s = [sum(c) for c in zip(*x)]
    v = np.array([[float(Fraction(sum((n * a[i] - s[i]) * (n * a[j] - s[j]) for a in x), n**3)) for j in range(d)] for i in range(d)])
    value, axes = np.linalg.eigh(v)
    value, axes = value[::-1][:k], axes[:, ::-1][:, :k]
    want = [(i, sum((n * c - t) ** 2 for c, t in zip(a, s)), (np.array([float(Fraction(n * c - t, n)) for c, t in zip(a, s)]) @ axes) / np.sqrt(value)) for (i, _), a in zip(good, x)]
    assert len(got) == n * k and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, k + 1))
    assert all(abs(r.explained - value[r.component - 1] / v.trace()) < 1e-12 for r in got)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    key = lambda i, dev, w: (i is None, i or 0, dev, round(abs(w), 6))
    for c in range(1, k + 1):
        mine = sorted((r for r in got if r.component == c), key=lambda r: key(r.vec_id, r.deviation, r.whitened))
        other = sorted(((i, dev, w[c - 1]) for i, dev, w in want), key=lambda r: key(*r))
        sign = math.copysign(1, sum(a.whitened * b[2] for a, b in zip(mine, other)))
        assert all(a.vec_id == b[0] and a.deviation == b[1] and abs(a.whitened - sign * b[2]) < 1e-8 for a, b in zip(mine, other))


def test_whitening_without_variance_and_empty(spark):
    df = spark.createDataFrame([(1, [0.5, 1.0], 0, "", "", 0, 0)] * 3, VECTORS)
    got = whitening.op11(df).collect()
    assert len(got) == 6 and all(r.deviation == 0 and r.whitened == 0 and r.explained == 0 and r.identity_error == 1 for r in got)
    flat = spark.createDataFrame([(i, [float(i), 2.0], 0, "", "", 0, 0) for i in range(5)], VECTORS)
    assert {(r.component, round(r.explained, 9)) for r in whitening.op11(flat).collect()} == {(1, 1.0), (2, 0.0)}
    nothing = whitening.op11(df.limit(0))
    assert nothing.count() == 0 and nothing.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.op11(spark.createDataFrame([(1, None, 0, "", "", 0, 0)], VECTORS)).count() == 0
    with pytest.raises(ValueError, match="2\\^50"):
        whitening.op11(spark.createDataFrame([(1, [1e30], 0, "", "", 0, 0)], VECTORS))


def test_double_doubles_are_exact(spark):
    """The covariance of values far from zero, in many tasks, to 28 digits: plain doubles keep about 8."""
    rnd = random.Random(2)
    x = [[10**9 + rnd.randrange(50), 10**9 + rnd.randrange(50), -(10**8) + rnd.randrange(9)] for _ in range(700)]
    n = len(x)
    s = [sum(c) for c in zip(*x)]
    df = spark.createDataFrame([(v,) for v in x], "_x array<long>").repartition(9)
    high, low = whitening.covariance(df, "_x", n, whitening.exact_mean(s, n))
    for i in range(3):
        for j in range(3):
            want = Fraction(sum((n * v[i] - s[i]) * (n * v[j] - s[j]) for v in x), n**3)
            assert abs(Fraction(high[i, j]) + Fraction(low[i, j]) - want) <= abs(want) * Fraction(1, 10**25)
    a, b = np.array([1e16, 0.1, -3.7e200]), np.array([1.0, 1e17 / 3, 1e-30])
    for f, exact in ((whitening.two_sum, lambda p, q: Fraction(p) + Fraction(q)), (whitening.two_product, lambda p, q: Fraction(p) * Fraction(q))):
        r, e = f(a, b)
        assert all(Fraction(float(r[k])) + Fraction(float(e[k])) == exact(float(a[k]), float(b[k])) for k in range(3))


def test_eigenvectors_are_refined():
    """Residuals of the solver's result at the level of one rounding, also where eigenvalues nearly tie."""
    rnd = np.random.default_rng(3)
    q, _ = np.linalg.qr(rnd.normal(size=(40, 40)))
    value = np.r_[[1e6, 1e6 - 1e-3, 5.0, 5.0], rnd.uniform(0, 4, 36)]
    v = (q * value) @ q.T
    v = (v + v.T) / 2
    got, x = whitening.eigen((v, np.zeros_like(v)))
    assert np.allclose(got, np.sort(value)[::-1], atol=1e-8) and np.abs(x.T @ x - np.eye(40)).max() < 1e-14
    assert np.abs(v @ x - x * got).max() < 1e-8


def brute_clusters(good, k=16, rounds=3):
    x = [(i, tuple(math.floor(64 * c) for c in v)) for i, v in good]
    start = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in x if i is not None)[:k]
    c = [v for _, v in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in x]
        for j in range(len(c)):
            own = [v for (_, v), a in zip(x, at) if a == j]
            if own:
                c[j] = tuple(sum(t) // len(own) for t in zip(*own))
    found = [(i, *near(v)) for i, v in x]
    total = [sum(d for _, d, a in found if a == j) for j in range(len(c))]
    return sorted(((i is None, i or 0), a, d, total[a], sum(total), hashlib.sha256(",".join(map(str, c[a])).encode()).hexdigest()) for i, d, a in found)


@pytest.mark.parametrize("n", [4, 90, 400])
def test_centroids(spark, n):
    good, rows = vectors(64, n + 4)
    if n == 400:  # well parted groups, ties and one that holds a third of all rows
        rnd = random.Random(1)
        centre = [[rnd.choice([-8.0, 0.0, 8.0]) for _ in range(64)] for _ in range(12)]
        good = [(i, [c + rnd.choice([-0.25, 0.0, 0.25]) for c in centre[min(i % 18, 11)]]) for i in range(n)]
        rows = [(i, v, 1, "x", "y", 2, 3) for i, v in good]
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    got = sorted(((r.vec_id is None, r.vec_id or 0), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroids.op13(df).collect())
    assert got == brute_clusters(good)
    scans = centroids.cluster_vectors(df)[2]
    assert scans[0] == len(good) and (n < 400 or scans[-1] < len(good) / 2)  # bounds settle most vectors there


def test_centroids_empty_and_short(spark):
    empty = spark.createDataFrame([], VECTORS)
    want = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert centroids.op13(empty).columns == want and centroids.op13(empty).count() == 0
    other = spark.createDataFrame([(1, [0.5] * 63, 0, "", "", 0, 0), (2, None, 0, "", "", 0, 0), (None, [0.5] * 64, 0, "", "", 0, 0)], VECTORS)
    assert centroids.op13(other).count() == 0
    with pytest.raises(ValueError, match="2\\^26"):
        centroids.op13(spark.createDataFrame([(1, [1e9] * 64, 0, "", "", 0, 0)], VECTORS))


def test_bounds_hold():
    """Bounds after many moves are true bounds, and clusters are those of full scans."""
    rnd = np.random.default_rng(5)
    x = rnd.integers(-50, 50, (500, 6))
    c = x[:7].astype(np.int64)
    cluster, _, upper, lower = centroids.scan(x, c)
    for _ in range(12):
        before, c = c, c + rnd.integers(-6, 7, c.shape) * (rnd.random((7, 1)) < 0.5)
        cluster, upper, lower, _ = centroids.reassign(x, cluster, upper, lower, c, before)
        d = centroids.distances(x, c)
        assert (cluster == d.argmin(axis=1)).all()
        own = d[np.arange(500), cluster].copy()
        d[np.arange(500), cluster] = 1 << 60
        assert (upper**2 >= own).all() and (lower <= np.sqrt(d.min(axis=1)) + 1e-12).all()


def test_token_counts(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rnd = random.Random(9)
    letters = "abcdefgh 'sTREvellm\n\t  0123.,!?éßñ漢字かなกข😀​ \u0085 ͸\U00010940\x00"
    texts = [None, "", " ", "\n\n", "a", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext", "it's we'll I'd", "word " * 30_000, "x" * 70_000, "日本語" * 9_000]
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 60))) for _ in range(600)] + ["a<|endoftext|>\U00010940 b"] * 2
    df = spark.createDataFrame([(i, t, "x", 1, "clash") for i, t in enumerate(texts)] + [(None, "no id", "", 0, "")], "doc_id long, text string, _text string, n_tokens int, _c0 string").repartition(3)
    got = {r.doc_id: r for r in token_counts.op12(df).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        want = len(library.encode(t or "", add_special_tokens=False))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), want, want > 512), t
    assert token_counts.op12(df.limit(0)).count() == 0
    one = [letters * 3, "x" * 300]
    want = [len(library.encode(t, add_special_tokens=False)) for t in one]
    counter = token_counts.Counter(path, frozenset())  # without the shortcut: the merges alone
    assert [counter(t) for t in one] == want


def test_whole_tokens_are_proved():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    whole = sorted(token_counts.proved(path))
    assert len(whole) > 40_000 and " the" in whole
    pieces = [w for w in whole if token_counts.regex.fullmatch(token_counts.PATTERN, w)][::37]
    assert all(len(library.encode(w, add_special_tokens=False)) == 1 for w in pieces)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_of_other_vocabularies(spark, name):
    """Files that ask for more than the byte-level pattern go through their library as a whole."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    count = token_counts.library(public_tokenizers.path(name))[0]
    texts = ["Hello, World!  It's", "", "naïve 漢字"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, public_tokenizers.path(name)).collect()} == {i: count(t) for i, t in enumerate(texts)}
