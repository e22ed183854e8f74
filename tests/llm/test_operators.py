"""Operators against brute force on a small table with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from rasterloom.llm import exact_dedup, fertility, mixing, near_dedup, packing, pu_classifier, sharding, substring_dedup, toxicity, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, _text string, size int"


def table():
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(400)] + ["Été", "naïve", "ß"]
    words = lambda n: [rnd.choice(vocab) for _ in range(n)]
    base, passage = words(120), words(70)
    rows = [(0, None), (1, ""), (2, "  \n\t "), (3, "one"), (4, "one"), (5, "One"), (6, "two words"), (7, " ".join(base)), (8, " ".join(base)), (9, " ".join(base).upper())]
    for i in range(10, 40):  # near copies of base
        w = list(base)
        for _ in range(rnd.randint(0, 12)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        rows.append((i, " ".join(w)))
    for i in range(40, 60):  # share a passage
        w = words(rnd.randint(0, 90))
        k = rnd.randint(0, len(w))
        rows.append((i, "\n".join([" ".join(w[:k]), " ".join(passage[: rnd.randint(45, 70)]), " ".join(w[k:])])))
    rows += [(60, "word " * 3000), (61, " ".join(words(6000))), (62, "line a\nline a\n\nline b\nline a " * 9)]
    rows += [(7, " ".join(base)), (63, "twice"), (63, "twice"), (None, "no id"), (None, "no id either")]
    return [(i, t, rnd.choice(["en", "fr", None, "xx"]), rnd.choice(["s1", "s2", "S", None]), 0, "clash", "clash", 1) for i, t in rows]


@pytest.fixture(scope="module")
def rows():
    return table()


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(t):
    return WORD.findall(t or "")


def test_exact_dedup(docs, rows, empty):
    got = exact_dedup.op5(docs).collect()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    assert len(got) == len(rows)
    kept = Counter()
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}
    one = hashlib.sha256(b"one").hexdigest()
    for lanes in (1, 2, 5, 16):
        smallest = exact_dedup.exact_dedup(docs, keep="min", lanes=lanes, carry=("size",)).where(f"kept and text_sha256 = '{one}'").collect()
        assert [(r.doc_id, r.size) for r in smallest] == [(3, 1)]
    assert exact_dedup.op5(empty).count() == 0


def test_sharding(docs, rows, empty):
    got = sharding.op6(docs).collect()
    assert len(got) == len(rows)
    for s in range(16):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 16) for r in got)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    shard = {r.doc_id: r.shard for r in got}
    assert all(shard[r.doc_id] == r.shard for r in got)
    heavy = sharding.shard_records(docs.sparkSession.range(4000).selectExpr("id as doc_id", "'x' as text"), weights=(3.0, 1.0)).groupBy("shard").count().collect()
    share = {r.shard: r["count"] / 4000 for r in heavy}
    assert abs(share[0] - 0.75) < 0.03
    assert sharding.op6(empty).count() == 0


def fair_targets(sizes, budget=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, out, live = budget * sum(sizes.values()), {}, set(names)
    while live:
        left = total - sum(out.values())
        over = [s for s in live if left * w[s] / sum(w[x] for x in live) > most * sizes[s]]
        if not over:
            return out | {s: left * w[s] / sum(w[x] for x in live) for s in live}
        for s in over:
            out[s] = most * sizes[s]
            live.discard(s)
    return out


def test_mixing(docs, rows, empty):
    got = mixing.op7(docs).collect()
    again = mixing.op7(docs).collect()
    assert Counter(got) == Counter(again) and len(got) == len(rows)
    sizes = Counter()
    for _, t, _, source, *_ in rows:
        sizes[source] += len(words_of(t))
    want = fair_targets(sizes)
    by_size = {v: k for k, v in sizes.items()}
    taken = Counter()
    for r in got:
        s = by_size[r.source_size]
        assert r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    for ranges in (1, 3, 40):  # the cut of the global order against the closed form for each source
        copies = mixing.mix(mixing.queue(docs), ranges=ranges).where("taken > 0").collect()
        assert all(r.finish <= 1 for r in copies)
        served = Counter()
        for r in copies:
            served[r.doc_id, r["size"], r.copy, r._seq, r._src] += r.taken
        for r in mixing.queue(docs).collect():
            for copy in (0, 1):
                closed = min(max(int(r.target) - r._start - copy * r.source_size, 0), r["size"])
                assert served[r.doc_id, r["size"], copy, r._seq, r._src] == closed
    queued = mixing.queue(docs)
    whole = mixing.mix(queued, cut="whole").collect()
    assert all(r.taken in (0, r["size"]) for r in whole)
    longest = max(r["size"] for r in whole)
    took = Counter()
    for r in whole:
        took[r._source] += r.taken
    assert all(abs(took[s] - want[s]) <= longest for s in want) and abs(sum(took.values()) - sum(want.values())) <= longest
    assert mixing.op7(empty).count() == 0
    for trial in range(20):
        rnd = random.Random(trial)
        sizes = {f"s{i}": rnd.randint(0, 1000) for i in range(rnd.randint(1, 9))}
        df = docs.sparkSession.createDataFrame([(k, v) for k, v in sizes.items()], "_source string, source_size long")
        if trial < 4:
            got = {r._source: r.target for r in mixing.source_targets(df).collect()}
            assert got == pytest.approx(fair_targets(sizes))


def test_substring_dedup(docs, rows, empty):
    texts = sorted(((i if i is not None else 2**63 - 1, words_of(t)) for i, t, *_ in rows), key=lambda x: x[0])
    first = {}
    for i, ws in texts:
        for k in range(len(ws) - 49):
            first.setdefault(tuple(ws[k : k + 50]), i)
    want = Counter()
    for i, t, *_ in rows:
        ws, me = words_of(t), i if i is not None else 2**63 - 1
        gone = set()
        for k in range(len(ws) - 49):
            if first[tuple(ws[k : k + 50])] < me:
                gone.update(range(k, k + 50))
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        want[i, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.op8(docs).collect())
    assert got == want and any(k[2] for k in want)
    assert substring_dedup.op8(empty).count() == 0


def shingles_of(t, width):
    ws = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[k : k + width]) for k in range(len(ws) - width + 1)) or frozenset([tuple(ws)])


def near_by_hand(rows, width):
    """(id, set size, component name, kept or None) of each row: nodes are sets, ids name them."""
    sets = [shingles_of(t, width) for _, t in rows]
    nodes = sorted({x for x in sets if x}, key=lambda x: sorted(x))
    reach = list(range(len(nodes)))

    def root(i):
        while reach[i] != i:
            i = reach[i]
        return i

    for a, x in enumerate(nodes):
        for b in range(a):
            if 100 * len(x & nodes[b]) >= 80 * len(x | nodes[b]):
                reach[root(a)] = root(b)
    of = {x: root(i) for i, x in enumerate(nodes)}
    name = defaultdict(list)
    for (i, _), x in zip(rows, sets):
        if x and i is not None:
            name[of[x]].append(i)
    out = []
    for (i, _), x in zip(rows, sets):
        own = min(name[of[x]], default=None) if x else i
        out.append((i, len(x), own, None if x and own is None else not x or i == own))
    return out


@pytest.mark.parametrize("width", [2, 5])
def test_near_dedup(docs, rows, empty, width):
    got = near_dedup.near_duplicates(docs, width=width).collect()
    want = Counter(near_by_hand([r[:2] for r in rows], width))
    nameless = {r.n_shingles for r in got if r.component is not None and r.component_id is None}
    assert Counter((r.doc_id, r.n_shingles, r.component_id, None if r.component is not None and r.component_id is None else r.kept) for r in got) == want and nameless
    if width == 2:
        assert near_dedup.op2(empty).count() == 0


def test_near_dedup_null_ids_join_nothing(spark):
    """Rows without id, and different texts of one id, are no bridge between strangers."""
    rnd = random.Random(8)
    a, b = ([f"{p}{rnd.randrange(10**6)}" for _ in range(60)] for p in "ab")
    near = lambda w: " ".join([*w[:59], "z"])
    rows = [(1, " ".join(a)), (2, " ".join(b)), (None, near(a)), (None, near(b)), (5, "only " + " ".join(a[:9])), (5, "other " + " ".join(b[:9])), (None, "lone words here"), (None, "lone words here")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id in (1, 2, 5)} == {1: 1, 2: 2, 5: 5}
    assert sorted(r.kept for r in got if r.doc_id is None and r.component_id is None) == [True, True]
    assert not any(r.kept for r in got if r.doc_id is None and r.component_id is not None)


def test_hashes_are_no_polynomials():
    """Words that defeat any polynomial modulo 2**64 (a Thue-Morse word and its complement) stay apart."""
    from rasterloom.llm.common import Words, run_hash, span_hash

    bits = ["ab"[bin(i).count("1") & 1] for i in range(2048)]
    one, two = "".join(bits), "".join("ba"[c == "b"] for c in bits)
    h = Words([one.encode(), two.encode(), one.encode()]).hashes()
    assert h[0] == h[2] != h[1]
    words = Words([" ".join(bits).encode(), " ".join("ba"[c == "b"] for c in bits).encode()])
    a = span_hash(words.hashes(), words.first[:-1], words.first[1:])
    assert a[0] != a[1]
    import numpy as np

    values = np.random.default_rng(1).integers(0, 5, 400).astype(np.uint64)
    for width in (1, 2, 5, 8, 16, 50):
        h, seen = run_hash(values, width), {}
        assert len(h) == 400 - width + 1
        for i, x in enumerate(h.tolist()):
            assert seen.setdefault(x, tuple(values[i : i + width])) == tuple(values[i : i + width])
        assert len(seen) == len({tuple(values[i : i + width]) for i in range(400 - width + 1)})


def test_near_dedup_long_lists(spark):
    """A group larger than a short list, some of it not linked to its smallest document."""
    rnd = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rnd.randint(0, 14)):
            w[rnd.randrange(60)] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()}
    sets = [shingles_of(t, 2) for _, t in rows]
    comp = list(range(150))
    for _ in range(150):
        new = [min([comp[b] for b in range(150) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]) for a in range(150)]
        if new == comp:
            break
        comp = new
    assert got == dict(enumerate(comp))


def test_components(spark):
    rnd = random.Random(9)
    links = [(i, i + 1) for i in range(200, 260)] + [(rnd.randrange(100), rnd.randrange(100)) for _ in range(70)]
    got = {r.id: r.comp for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    reach = {i: i for p in links for i in p}
    for _ in range(300):
        for a, b in links:
            reach[a] = reach[b] = min(reach[a], reach[b])
    assert got == {i: c for i, c in reach.items() if any(i in p and p[0] != p[1] for p in links)}


def test_fertility(docs, rows, empty):
    got = fertility.op1(docs).collect()
    want = Counter()
    for i, t, *_ in rows:
        ws, t = words_of(t), t or ""
        runs = Counter(tuple(ws[k : k + 8]) for k in range(len(ws) - 7))
        cover = {j for k in range(len(ws) - 7) if runs[tuple(ws[k : k + 8])] > 1 for j in range(k, k + 8)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if words_of(line):
                dup += line in seen
                seen.add(line)
        want[i, len(ws), sum(map(len, ws)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(cover), len(ws) < 20 or 100 * len(cover) > 30 * len(ws)] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    assert fertility.op1(empty).count() == 0


def test_fertility_tokens():
    """Words cut together have the tokens that they have alone, and measures are those of the text's words."""
    import numpy as np
    import public_tokenizers as p

    from rasterloom.llm.common import Words

    text = "Plain words, naïve Übung 中文 ▁odd don't   x y 1234567 ..."
    for name in fertility.VOCABULARIES:
        c = fertility.Cutter(p.path(name))
        ws = words_of(text)
        ids, sizes = c.cut(ws)
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        assert [list(a) for a in parts] == [list(c.cut([w])[0]) for w in ws]
        w = Words([text.encode()])
        h = w.hashes()
        keys, index, back = np.unique(h, return_index=True, return_inverse=True)
        rows = c.rows(keys, lambda new, index=index, w=w: fertility.word_texts(w, index[new]))[back]
        tokens, cpt, share, entropy = fertility.token_measures(w, rows, c, np.array([sum(map(len, ws))]))
        count = Counter(int(i) for i in ids)
        assert tokens[0] == len(ids) and cpt[0] == pytest.approx(sum(map(len, ws)) / len(ids))
        assert share[0] == pytest.approx(sum(bool(c.part[i]) for i in ids) / len(ids))
        assert entropy[0] == pytest.approx(-sum(v / len(ids) * np.log2(v / len(ids)) for v in count.values()))


def test_fertility_bands(spark, rows):
    """Measures, medians of bands and verdicts by plain loops, each word cut on its own."""
    import base64
    import math
    from statistics import median

    import public_tokenizers as p
    import sentencepiece
    import tiktoken

    rnd = random.Random(8)
    made = lambda letters, n, size: " ".join("".join(rnd.choice(letters) for _ in range(size)) for _ in range(n))
    odd = [(made("αβγδεζηθ", 40, 6), "el"), (made("zqxjkvw", 60, 9), "en"), (made("☃☂☀", 50, 3), "en"), (made("0123456789abcdef", 50, 32), "fr"), (made("абвгд", 30, 5), None)]
    texts = [(k, t, lang) for k, (t, lang) in enumerate([(t, lang) for _, t, lang, *_ in rows] + odd)]
    got = {r.doc_id: r for r in fertility.op1(spark.createDataFrame(texts, "doc_id long, text string, lang string")).collect()}

    model = sentencepiece.SentencePieceProcessor(model_file=p.path(fertility.VOCABULARIES[0]))
    with open(p.path(fertility.VOCABULARIES[1]), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("plain", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    broken = {i for t, i in ranks.items() if "\ufffd" in t.decode("utf-8", "replace") and b"\xef\xbf\xbd" not in t}
    cuts = [(model.encode, model.is_byte), (lambda w: coder.encode_ordinary(" " + w), broken.__contains__)]

    def script(text):
        votes = Counter("Latin" if c < "\u0250" else "Greek" if "\u0370" <= c < "\u0400" else "Cyrillic" if "\u0400" <= c < "\u0530" else "other" for c in text if c >= "A")
        return votes.most_common(1)[0][0] if votes else "other"

    rounded = lambda v: math.floor(v * 1000 + 0.5) / 1000
    plain, bands = {}, defaultdict(lambda: defaultdict(list))
    for k, t, lang in texts:
        ws, figures = words_of(t), []
        for cut, is_part in cuts:
            ids = [i for w in ws for i in cut(w)]
            n, seen = max(len(ids), 1), Counter(ids)
            figures.append((len(ids), sum(map(len, ws)) / n, sum(map(bool, map(is_part, ids))) / n, -sum(c / n * math.log2(c / n) for c in seen.values())))
        band = lang if lang in ("en", "de", "fr", "es") else script(t or "")
        plain[k] = band, figures
        assert got[k].band == band
        for v, (tokens, *measures) in enumerate(figures):
            assert got[k][f"tokens_{v}"] == tokens
            assert [got[k][f"{m}_{v}"] for m in fertility.MEASURES] == pytest.approx(measures)
            if not got[k].base_failed:
                bands[band][v, "chars"].append(measures[0])
                bands[band][v, "even"].append(measures[2] / math.log2(max(tokens, 2)))
    beyond_limits = beyond_band = 0
    for k, (band, figures) in plain.items():
        inside = near = True
        for v, (tokens, *measures) in enumerate(figures):
            for m, value in zip(fertility.MEASURES, measures):
                low, high = fertility.LIMITS[band][m]
                inside &= low <= value <= high
            for name, value in (("chars", measures[0]), ("even", measures[2] / math.log2(max(tokens, 2)))):
                others = bands[band][v, name]
                if others:
                    mid = median(map(rounded, others))
                    mad = median(rounded(abs(o - mid)) for o in others)
                    near &= abs(value - mid) <= max(mad, 0.01 * mid) * 8 * math.sqrt(1 + 100 / max(tokens, 1))
        assert got[k].kept == (not got[k].base_failed and inside and near), k
        beyond_limits += not got[k].base_failed and not inside
        beyond_band += not got[k].base_failed and inside and not near
    assert beyond_limits and beyond_band


def test_packing_ids_of_a_whole_table(spark):
    """Pieces of all documents hold the ids that the tokenizers library gives by the .json file."""
    import numpy as np
    import public_tokenizers as p
    from tokenizers import Tokenizer

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    coder = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in docs.collect():
        ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        edges = [0, len(ids)] if len(ids) <= 2048 else sorted({0, *range(len(ids) % 2048, len(ids) + 1, 2048)})
        want.update((i, k, a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.ids_crc32) for r in packing.op9(docs).collect()) == want


def test_risk_by_hand(spark, tmp_path):
    """Sums over documents, the non-negative risk's minimum and the scores against loops over all documents on one machine."""
    import numpy as np

    rnd = random.Random(4)
    clean = lambda: " ".join(rnd.choice(["The", "river", "winds", "slowly", "past", "old", "mills."]) for _ in range(rnd.randint(15, 60)))
    junk = lambda: " ".join(rnd.choice(["BUY", "$$$", "win!!!", "1234", "<b>", "now"]) for _ in range(rnd.randint(3, 60)))
    good = [rnd.random() < 0.4 for _ in range(400)]
    spark.createDataFrame([(i, clean() if g else junk()) for i, g in enumerate(good)], "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    labels = spark.createDataFrame([(i, int(g)) for i, g in enumerate(good) if i % 2], "doc_id long, quality int")
    got = {r.doc_id: r for r in pu_classifier.score_quality(docs, labels).collect()}
    assert len(got) == 400

    text = dict(docs.collect())
    b = {i: pu_classifier.basis(pu_classifier.figures([t.encode()]))[0] for i, t in text.items()}
    use = [i for i in range(1, 400, 2) if zlib.crc32(str(i).encode()) % 4 != 2]
    kept_back = {r[0] for r in spark.createDataFrame([(i,) for i in use], "_lid long").where(pu_classifier.calibration()).collect()}
    trusted = [i for i in use if good[i] and i not in kept_back]
    mean = lambda ids, of: sum(of(b[i]) for i in ids) / len(ids)
    moments = [mean(b, lambda v: np.outer(v, v)), mean(trusted, lambda v: np.outer(v, v)), mean(b, lambda v: v), mean(trusted, lambda v: v)]

    def parts(w, prior):
        loss = lambda ids, sign: sum((1 - sign * (v @ w)) ** 2 for v in map(b.get, ids)) / len(ids)
        return prior * loss(trusted, 1), loss(b, -1) - prior * loss(trusted, -1)

    def risk(w, prior):
        positive, negative = parts(w, prior)
        return positive + max(negative, 0) + 1e-3 * (w @ w)

    unbiased = lambda prior: np.linalg.solve(moments[0] + 1e-3 * np.eye(len(moments[2])), 2 * prior * moments[3] - moments[2])
    w = pu_classifier.descend(*moments, 0.1)  # nothing to correct: the unbiased risk's minimum
    shake = np.random.default_rng(1)
    assert parts(w, 0.1)[1] > 0 and w == pytest.approx(unbiased(0.1), abs=1e-9)
    assert all(risk(w, 0.1) < risk(w + shake.normal(0, s, len(w)), 0.1) for s in (1e-3, 1e-2, 0.1) for _ in range(10))
    assert parts(unbiased(0.9), 0.9)[1] < -1 and parts(pu_classifier.descend(*moments, 0.9), 0.9)[1] > -0.3

    first = pu_classifier.descend(*moments, 0.5)
    bin_of = lambda i: int(np.floor((np.clip(b[i] @ first, -2, 2) + 2) * (pu_classifier.BINS / 4)))
    everyone, positives = Counter(map(bin_of, b)), Counter(bin_of(i) for i in use if good[i] and i in kept_back)
    bins = sorted(everyone)
    prior = pu_classifier.class_prior(np.array(bins), np.array([everyone[k] for k in bins]), np.array([positives[k] for k in bins]))
    assert 0.3 < prior < 0.5  # 0.4 by construction
    w = pu_classifier.descend(*moments, prior)
    value = {i: b[i] @ w for i in b}
    known = [i for i in use if i in kept_back]
    slope, intercept = pu_classifier.logistic_fit(np.array([value[i] for i in known]), np.array([float(good[i]) for i in known]))
    for i, r in got.items():
        assert r.value == pytest.approx(value[i], abs=1e-6)
        assert r.score == pytest.approx(1 / (1 + np.exp(-(slope * value[i] + intercept))), abs=1e-6)


def test_packing(docs, rows, empty):
    import numpy as np
    import public_tokenizers as p
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    got = packing.op9(docs).collect()
    want = Counter()
    for i, t, *_ in rows:
        ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        n = len(ids)
        edges = [0, n] if n <= 2048 else sorted({0, *range(n % 2048, n + 1, 2048)})
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r.length for r in got) // 2048) + 1
    assert packing.op9(empty).count() == 0


def test_packing_special_mark(spark):
    """The mark of the .json file inside texts is one id, as the tokenizers library has it by default."""
    import numpy as np
    import public_tokenizers as p
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y  <|endoftext|>\n", "<|endoftext|", "é<|endoftext|>ß <|ENDOFTEXT|>", "<|endoftext|> " * 1500]
    want = [np.array(coder.encode(t, add_special_tokens=False).ids, "<u4") for t in texts]
    assert list(want[0]) == [64, 220, 50256, 275]
    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json"):
        assert [list(packing.encoder(p.path(name))(t)) for t in texts] == [list(w) for w in want]
    got = packing.op9(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    sums = {r.doc_id: (r.length, r.ids_crc32) for r in got.where("start = 0 and piece = 0").collect()}
    for i, w in enumerate(want):
        ids = np.append(w, 0).astype("<u4")
        cut = len(ids) if len(ids) <= 2048 else len(ids) % 2048
        assert sums[i] == (cut, zlib.crc32(ids[:cut].tobytes()))


def test_local_search():
    """Bins that best fit leaves are emptied where exchanges can, and no bin overflows or loses an item."""
    for trial in range(30):
        rnd = random.Random(trial)
        sizes = [rnd.randint(200, 900) for _ in range(60)]
        bins = packing.best_fit(sizes, 2048)
        better = packing.local_search(bins, sizes, 2048)
        assert sorted(i for b in better for i in b) == list(range(60))
        assert all(sum(sizes[i] for i in b) <= 2048 for b in better) and len(better) <= len(bins)
    assert len(packing.local_search([[0, 1], [2, 3], [4]], [6, 3, 5, 4, 2], 10)) == 2


def test_url_filter(spark):
    pages = [(1, "https://A.example.NET/en/x?q#f"), (2, "http://x.example.net/fr/"), (3, "http://example.com/de/1"), (4, "http://sub.org/fr/1"), (5, "http://good.com/a?utm_source=z&b=2&a=1#t"), (6, "https://www.good.com/a/?a=1&b=2"), (7, None), (8, "no scheme"), (9, "http://badexample.net.com/"), (5, "http://good.com/a?utm_source=z&b=2&a=1#t"), (10, "http://good.com/b")]
    df = spark.createDataFrame(pages, "page_id long, url string")
    listed = spark.createDataFrame([("http://good.com/a.html?b=2&a=1",), (None,)], "url string")
    want = {1: ("a.example.net", "/en/x", "example.net/en/", "allow"), 2: ("x.example.net", "/fr/", "net/", "block"), 3: ("example.com", "/de/1", "example.com/de/", "block"), 4: ("sub.org", "/fr/1", "org/fr/", "allow"), 5: ("good.com", "/a", None, "block"), 6: ("www.good.com", "/a/", None, "block"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("badexample.net.com", "/", None, "allow"), 10: ("good.com", "/b", None, "allow")}
    for most in (64 << 20, 0):  # broadcast and shuffled filter
        got = url_filter.filter_urls(df, listed, broadcast_bytes=most).collect()
        assert len(got) == len(pages) and all((r.host, r.path, r.rule, r.verdict) == want[r.page_id] for r in got)
    none = url_filter.filter_urls(df, listed.where("url = ''"))
    assert none.where("listed").count() == 0 and url_filter.filter_urls(df.where("false"), listed).count() == 0


def test_url_query_on_odd_rows(spark):
    """op3: null URLs, none or too large a number at the end, long URLs, repeated rows, extra and clashing columns."""
    pages = [(1, None), (2, "http://a.b/no-number"), (3, "http://a.b/" + "9" * 25), (4, "http://a.b/7"), (4, "http://a.b/7"), (5, "http://A.b/7.html?utm_x=1"), (6, "http://a.b/8"), (None, "http://a.b/7/"), (7, "http://a.b/" + "x" * 300_000), (8, "://"), (9, "")]
    df = spark.createDataFrame([(i, u, "clash", "clash") for i, u in pages], "page_id long, url string, host string, _url string")
    labels = spark.createDataFrame([(7, 1), (8, 0), (None, 1)], "doc_id long, toxic int")
    got = url_filter.op3(df, labels).collect()
    assert Counter((r.page_id, r.verdict) for r in got) == Counter((i, "block" if u in ("http://a.b/7", "http://A.b/7.html?utm_x=1", "http://a.b/7/") else "allow") for i, u in pages)
    assert url_filter.op3(df.where("false"), labels).count() == 0 and url_filter.op3(df, labels.where("false")).where("verdict = 'block'").count() == 0


@pytest.mark.parametrize("op, column", [(toxicity.op10, "toxic"), (pu_classifier.op4, "quality")])
def test_classifiers_on_odd_rows(spark, docs, rows, empty, op, column):
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(0, 60)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = op(docs, labels).collect()
    assert len(got) == len(rows) and all(r.score is not None and 0 <= r.score <= 1 for r in got)
    assert all(r.predicted == int(r.score >= 0.7) for r in got)
    mod, fold = (3, 1) if column == "toxic" else (4, 2)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % mod == fold) for r in got)
    assert op(empty, labels).count() == 0
    assert op(docs, labels.where("false")).count() == len(rows)


def words_by_hand(t):
    """Runs of letters and digits (beyond ASCII all but some blanks and punctuation), and pairs of neighbours in scripts without blanks."""
    out = []
    for run in re.findall("(?:[a-z0-9]|[^\x00-\x7f\x80-\xbf\u2000-\u207f\u3000-\u303f])+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")):
        for part in re.findall("[\u0e00-\u0eff\u1000-\u10bf\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+|[^\u0e00-\u0eff\u1000-\u10bf\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+", run):
            if ord(part[0]) >= 0xE00 and part[0] > "\u0dff" and re.match("[\u0e00-\u0eff\u1000-\u10bf\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]", part[0]):
                out += [part[k : k + 2] for k in range(max(len(part) - 1, 1))]
            else:
                out.append(part)
    return out


def test_toxicity_words():
    """Words, their beginnings and lengths of texts, against plain strings; a text's words don't depend on its neighbours."""
    texts = ["One two", "", "  \n", "idiot", "x", "\u4e2d\u6587\u5f88\u597d ok", "", "caf\u00e9\u201d \u201cna\u00efve\u00a0y", "\u0e44\u0e17\u0e22abc", "\u6f22", "a_b-c" * 3, "\u3001\u65e5\u672c\u3002", "pathetic pathway path", "w" * 40_000]
    x = toxicity.Expressions([t.encode() for t in texts])
    by_key = {}
    for i, t in enumerate(texts):
        own = toxicity.Expressions([t.encode()])
        mine = x.keys[0][x.word[x.text == i]].tolist()
        assert mine == own.keys[0][own.word].tolist() and x.length[i] == len(words_by_hand(t)) == len(mine), t
        for w, k in zip(words_by_hand(t), mine):
            assert by_key.setdefault(k, w) == w
    assert len(by_key) == len({w for t in texts for w in words_by_hand(t)})
    stems = {}
    for at, k in enumerate(x.keys[0].tolist()):
        w = by_key[k]
        lone = ord(w[0]) >= 0xE00
        for level, n in enumerate(toxicity.LEVELS):
            stem = x.keys[1 + level, at]
            assert (stem != 0) == (len(w) > n and not lone), w
            if stem:
                assert stems.setdefault(int(stem), w[:n]) == w[:n]
    assert len(set(stems.values())) == len(stems)


@pytest.mark.parametrize("broadcast_rows", [10**6, 0])
def test_toxicity_by_hand(spark, tmp_path, broadcast_rows):
    """Quotients, terms and the evidence of a small corpus against plain loops; both ways of meeting the table."""
    import math

    rnd = random.Random(4)
    vocab = [f"word{i}" for i in range(30)]
    endings = ["er", "est", "ing", "ish", "ly", "ness", "ful"]
    rows = [(i, " ".join([rnd.choice(vocab) for _ in range(rnd.randint(1, 25))] + (["Vile"] * rnd.randint(1, 3) + [f"grubby{rnd.choice(endings)}"] if i % 3 == 0 and i < 36 else []))) for i in range(40)] + [(40, None), (41, ""), (41, "twice vile"), (None, "vile"), (None, "grubbyhood")]
    labels = [(i, int(i % 3 == 0)) for i in range(36)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = toxicity.score_documents(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), broadcast_rows=broadcast_rows).collect()
    known = {i: y for i, y in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    every, by_class = Counter(), {0: Counter(), 1: Counter()}
    for i, t in rows:
        for w in set(words_by_hand(t)):
            every[w] += 1
            if i in known:
                by_class[known[i]][w] += 1
    seen = set(by_class[0]) | set(by_class[1])
    quotient = {0: {"": 1.0}, 1: {"": 1.0}}

    def add(counts, shared, total, ones, trust, parent):
        """Quotients of expressions by class counts and shared counts."""
        kept = lambda n: 0.0 if ones and n <= 1 else max(n - 0.75, 0.0)
        inside = sum(shared.values())
        for c in (0, 1):
            n = sum(counts[c].values())
            freed = n - sum(kept(v) for v in counts[c].values())
            for e, s in shared.items():
                quotient[c][e] = (kept(counts[c][e]) + freed * s / inside + trust * quotient[c][parent(e)]) / (n * s / total + trust)

    for level, n in enumerate(toxicity.LEVELS):
        of = lambda words: Counter(w[:n] + "-" for w in words if len(w) > n)  # noqa: B023, E731
        shared = of(seen)
        add({c: of(by_class[c]) for c in (0, 1)}, shared, sum(shared.values()), True, toxicity.TRUST_STEM, lambda e: e[:-2] + "-" if level else "")  # noqa: B023
    longest = lambda w: next((w[:n] + "-" for n in reversed(toxicity.LEVELS) if len(w) > n), "")
    add(by_class, {w: every[w] for w in seen}, sum(every.values()), False, toxicity.TRUST_WORD, longest)
    assert max(seen, key=lambda w: quotient[1][w] / quotient[0][w]).startswith(("vile", "grubby"))

    def term(w):
        e = w if w in seen else next((w[:n] + "-" for n in reversed(toxicity.LEVELS) if len(w) > n and w[:n] + "-" in quotient[1]), "")
        return math.log(quotient[1][e] / quotient[0][e])

    def difference(t):
        ws = words_by_hand(t)
        return math.log(sum(math.exp(3 * term(w)) for w in ws) / len(ws)) / 3 if ws else 0.0

    pairs = [(difference(r.text), r[toxicity.EVIDENCE]) for r in got]
    low, high = min(pairs), max(pairs)
    slope = (high[1] - low[1]) / (high[0] - low[0])
    assert slope > 0 and len(got) == len(rows)
    assert all(abs(low[1] + slope * (x - low[0]) - y) < 1e-4 * (1 + abs(y)) for x, y in pairs)
    assert difference("grubbyhood") > difference("word1") and "grubby-" in quotient[1]


def test_beginnings_of_one_word_say_nothing(spark):
    """Words that begin like a toxic word are clean, alone and at the end of clean documents; the toxic words aren't."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    clean = ["idiom", "pathway", "a path through the woods", "this is a common idiom of the language", "scumble the paint", "Moroni river", "losing the trashcan", ""]
    toxic = ["idiot", "you idiot", "idiot scum", "stupid moron the", "what a pathetic loser"]
    good = [r[0] for r in docs.join(labels, "doc_id").where("toxic = 0 AND length(text) BETWEEN 600 AND 4000").orderBy("doc_id").limit(40).select("text").collect()]
    extra = [*clean, *good, *[f"{t} a path through idioms" for t in good]], [*toxic, *[f"{t} you pathetic idiot" for t in good]]
    rows = [(10**12 * (1 + k) + i, t, "en", "x", 0) for k, texts in enumerate(extra) for i, t in enumerate(texts)]
    scored = toxicity.score_documents(docs.unionByName(spark.createDataFrame(rows, docs.schema)), labels).where("doc_id >= 1000000000000")
    got = {r.doc_id: r[toxicity.SCORE] for r in scored.select("doc_id", toxicity.SCORE).collect()}
    assert len(got) == len(rows)
    assert [t for i, t, *_ in rows if (got[i] >= 0.7) != (i >= 2 * 10**12)] == []


def test_toxicity_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(i, f"text {i % 7}", 1.5, "own", 2, 3) for i in range(30)], "doc_id long, text string, _m double, toxicity_score string, _s0 int, _key int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    got = toxicity.score_documents(df, labels)
    assert got.columns == [*df.columns, "toxicity_evidence", "toxicity_score_"] and {r.toxicity_score for r in got.collect()} == {"own"}
    assert all(0 <= r.toxicity_score_ <= 1 for r in got.collect())


def auc(pairs):
    ranked = sorted(pairs)
    pos = [k for k, (_, y) in enumerate(ranked) if y]
    n = len(pos)
    return (sum(pos) - n * (n - 1) / 2) / (n * (len(pairs) - n))


@pytest.mark.parametrize("op, column, least", [(toxicity.op10, "toxic", 0.85), (pu_classifier.op4, "quality", 0.97)])
def test_held_out_accuracy(spark, op, column, least):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = op(docs, labels).where("held_out").join(labels, "doc_id").select("score", column).collect()
    assert auc([(r.score, r[column]) for r in got]) >= least


@pytest.mark.parametrize("scale, least, false", [("sf0.01", 0.8, 1), ("sf0.1", 0.9, 2)])
def test_toxicity_decisions_held_out(spark, scale, least, false):
    d = f"/root/testdata/{scale}"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.op10(spark.read.parquet(f"{d}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    toxic = [r.predicted for r in got if r.toxic]
    assert sum(toxic) >= least * len(toxic) and sum(r.predicted for r in got if not r.toxic) <= false


def test_row_names_last_over_passes(spark, tmp_path):
    """File and place name each row once, whatever the splits; a column called _metadata is no hindrance."""
    from rasterloom.llm.common import row_key, stored

    spark.range(1000).selectExpr("id AS doc_id", "cast(id AS string) AS _metadata").repartition(3).write.parquet(str(tmp_path / "t"))
    docs = stored(spark.read.parquet(str(tmp_path / "t")))
    before = {r.k: r.doc_id for r in docs.select(row_key(docs).alias("k"), "doc_id").collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        after = {r.k: r.doc_id for r in docs.select(row_key(docs).alias("k"), "doc_id").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(before) == 1000 and before == after


def test_derived_tables_are_stored(spark, tmp_path):
    """A file's row that comes several times, or not again, gets names of its own: explode, joins, unions, samples."""
    from pyspark.sql import functions as F

    from rasterloom.llm.common import row_key, stored

    spark.range(60).selectExpr("id AS doc_id", "concat('t', id) AS text").write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    twice = docs.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    for df, n in ((docs, 60), (docs.where("doc_id > 9").withColumn("x", F.lit(1)), 50), (twice, 120), (docs.join(spark.range(3).toDF("k")), 180), (docs.unionByName(docs), 120), (docs.sample(0.5), None), (docs.where(F.rand() < 0.5), None), (docs.distinct(), 60)):
        kept = stored(df)
        rows = kept.select(row_key(kept).alias("k"), "doc_id").collect()
        assert len({r.k for r in rows}) == len(rows) and n in (None, len(rows))
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in kept.select("doc_id").collect())
    assert stored(docs) is docs and stored(twice) is not twice


def test_near_dedup_texts_by_join(docs, monkeypatch):
    """Beyond MOST_SENT nodes texts are joined, not met by a broadcast; the result is the same."""
    names = ("doc_id", "n_shingles", "component_id", "kept")
    own = Counter(tuple(r) for r in near_dedup.near_duplicates(docs).select(*names).collect())
    monkeypatch.setattr(near_dedup, "MOST_SENT", 0)
    assert Counter(tuple(r) for r in near_dedup.near_duplicates(docs).select(*names).collect()) == own


def test_texts_larger_than_a_slice(spark):
    """A text beyond every slice limit (2 MB), once more under another id, among short ones: whole results, by plain loops."""
    from rasterloom.llm import common, token_counts

    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    rnd = random.Random(8)
    long = " ".join(rnd.choice(["alpha", "béta", "gamma", "delta"]) + str(rnd.randrange(50_000)) for _ in range(220_000))
    assert len(long.encode()) > common.SLICE_BYTES
    rows = [(0, "short text"), (1, long), (2, long), (3, "short text"), (4, None)]
    df = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string").repartition(2)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(5)], "doc_id long, quality int, toxic int")
    words, vocabulary = words_of(long), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = len(vocabulary.encode(long, add_special_tokens=False))
    base = {r.doc_id: r for r in fertility.op1(df).collect()}
    assert [base[i].n_words for i in range(5)] == [2, len(words), len(words), 2, 0] and base[1].word_chars == sum(map(len, words))
    near = {r.doc_id: r for r in near_dedup.op2(df).collect()}
    assert near[1].n_shingles == near[2].n_shingles == len(shingles_of(long, 2)) and (near[2].component_id, near[2].kept, near[3].component_id) == (1, False, 0)
    cut = {r.doc_id: r for r in substring_dedup.op8(df).collect()}
    assert (cut[1].n_words, cut[1].n_removed, cut[2].n_removed, cut[3].n_removed) == (len(words), 0, len(words), 0)
    assert cut[1].kept_sha256 == hashlib.sha256(" ".join(words).encode()).hexdigest() and cut[2].kept_sha256 == hashlib.sha256(b"").hexdigest()
    pieces = packing.op9(df).collect()
    assert sum(r.length for r in pieces if r.doc_id == 2) == tokens + 1 and max(r.length for r in pieces) == 2048
    counts = {r.doc_id: r for r in token_counts.op12(df).collect()}
    assert (counts[1].n_tokens, counts[1].n_bytes, counts[1].over_limit) == (tokens, len(long.encode()), True)
    for op in (toxicity.op10, pu_classifier.op4):
        scores = {r.doc_id: r.score for r in op(df, labels).collect()}
        assert scores[1] == scores[2] and all(0 <= v <= 1 for v in scores.values())
