"""Spelling variants, the similarity join and whitening: against brute force on whole small tables, and case by case."""

import itertools
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendframe.llm import jaccard, spelling, whiten
from lendframe.llm.queries import QUERIES
from tests.llm.helpers import DOCS, LONG, Union, edge_docs, no_docs

LOWER = str.maketrans({c: c.lower() for c in map(chr, range(65, 91))})


def slow_words(rows, least=3, every=97):
    counts = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if every and h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= least}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def slow_forms(counts):
    near = {w: set() for w in counts}
    by_length = {}
    for w in counts:
        by_length.setdefault(len(w), []).append(w)
    for n, words in by_length.items():
        for a, b in itertools.chain(itertools.combinations(words, 2), itertools.product(words, by_length.get(n + 1, []))):
            if one_apart(a, b):
                near[a].add(b)
                near[b].add(a)
    form = {}
    for w, ns in near.items():
        best = min(ns, key=lambda v: (-counts[v], v), default=None)
        if best and counts[best] >= 2 * counts[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w
    return {(w, form.get(w), root(w), counts[w], len(near[w]), counts.get(form.get(w))) for w in counts}


def found(df):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_op11(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op11_spelling_variants"](spark, sf)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert found(got) == slow_forms(slow_words(rows))


def test_spelling_runs_borders_and_ties(spark):
    r = random.Random(1)
    words = {}
    for stem in ("aaaaaa", "abcabc", "aaabbb", "ébène", "zzzzz", "ÿyÿyÿ"):
        for _ in range(60):
            w = list(stem)
            for _ in range(r.randrange(3)):
                i = r.randrange(len(w))
                w[i:i + r.randrange(2)] = r.choice(["", "a", "b", "é"])
            if len(w) >= 5:
                words["".join(w)] = r.choice([3, 3, 6, 7, 12, 24])
    words["q" * 3000] = 3
    words["q" * 3001] = 9
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert found(spelling.forms(df)) == slow_forms(words)


def test_spelling_edges(spark):
    docs = edge_docs(spark).select("doc_id", "text", *(F.lit(0).alias(c) for c in ("word", "n", "at", "form")))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for every in (None, 2):
        counts = spelling.word_counts(docs, least_length=3, least_n=1, typo_every=every)
        assert {r.word: r.n for r in counts.collect()} == {w: n for w, n in _all_words(rows, every).items() if len(w) >= 3}
    assert found(spelling.forms(spelling.word_counts(docs))) == slow_forms(slow_words(rows, every=None))
    assert spelling.forms(spelling.word_counts(no_docs(spark))).collect() == []
    broken = spark.createDataFrame([(1, bytearray(b"hello\xffworld " * 3))], "doc_id int, b binary").select(
        "doc_id", F.col("b").cast("string").alias("text"))
    assert found(spelling.forms(spelling.word_counts(broken))) == {("hello", None, "hello", 3, 0, None), ("world", None, "world", 3, 0, None)}
    with pytest.raises(ValueError):
        spelling.forms(spelling.word_counts(docs), ratio=1)


def _all_words(rows, every):
    counts = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if every and h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    return counts


def shingle_set(text, width=3):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def slow_join(rows, percent=90):
    """(id, size, component, links) of every row, all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    u, links = Union(), Counter()
    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            u.join(a, b)
            links[a] += 1
            links[b] += 1
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            r = u.find(k)
            least[r] = min(least.get(r, i), i)
    return Counter((i, len(sets[k]), least.get(u.find(k)), links[k]) for k, (i, _) in enumerate(rows))


def joined(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in df.collect())


@pytest.mark.parametrize("percent,bounds", [(90, {}), (90, {"shingles_held": 40, "sets_held": 2}), (60, {"sets_held": 3}), (100, {})])
def test_join_equals_all_pairs(spark, percent, bounds):
    r = random.Random(percent)
    rows = []
    for size in (2, 3, 9, 10, 11, 12, 13, 20, 21, 40, 41, 100, 400):
        for _ in range(4):
            base = [r.choice("abcdefghijklmnop") + str(r.randrange(40)) for _ in range(size)]
            for _ in range(9):
                w = list(base)
                for _ in range(r.choice([0, 0, 1, 1, 2, max(1, size // 40)])):
                    i = r.randrange(len(w))
                    w[i:i + r.randrange(2)] = ["x"] * r.randrange(2)
                rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert joined(jaccard.components(df, percent=percent, **bounds)) == slow_join(rows, percent)


def test_similar_pairs(spark):
    base = [f"w{i}" for i in range(50)]
    texts = [" ".join(base), " ".join(base[:49]), " ".join(base[:47]), " ".join(base), "other words of one text", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    pairs, members = jaccard.similar_pairs(df)
    cls = {}
    for m in members.collect():
        cls.setdefault(m["class"], set()).add((m.doc_id, m.n_shingles))
    got = {(frozenset([frozenset(cls[p.a]), frozenset(cls[p.b])]), p.shared, p.total) for p in pairs.collect()}
    full, less, least = frozenset({(0, 48), (3, 48)}), frozenset({(1, 47)}), frozenset({(2, 45)})
    assert got == {(frozenset({full, less}), 47, 48), (frozenset({full, least}), 45, 48), (frozenset({less, least}), 45, 47)}


def test_join_edges(spark):
    docs = edge_docs(spark).withColumns({c: F.lit(1) for c in ("id", "lo", "hi", "key", "node", "grp", "tiles")})
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert joined(jaccard.components(docs)) == slow_join(rows)
    assert jaccard.components(no_docs(spark)).collect() == []
    nulls = [(None, "a b c d"), (None, "a b c d"), (None, "x y z"), (4, "p q r s"), (4, "p q r s"), (4, "quite another text"), (9, "p q r s"),
             (3, LONG), (2, LONG + " end"), (None, LONG), (None, None)]
    df = spark.createDataFrame([(i, t, "en", None, None) for i, t in nulls], DOCS)
    assert joined(jaccard.components(df)) == slow_join(nulls)


def test_bitmap_bound_is_never_below_the_overlap():
    r = np.random.default_rng(2)
    pool = r.integers(0, 1 << 63, 60).astype(np.uint64)
    sets = sorted((np.unique(r.choice(pool, r.integers(5, 50))) for _ in range(40)), key=len)
    tile = jaccard.Tile(sets, np.zeros(40, np.int32), False, 60)
    for i, a in enumerate(sets):
        j, shared = tile.links(i)
        got = dict(zip(j.tolist(), shared.tolist(), strict=True))
        want = {k: len(np.intersect1d(a, sets[k])) for k in range(i + 1, 40)}
        assert got == {k: s for k, s in want.items() if 100 * s >= 60 * (len(a) + len(sets[k]) - s)}


def test_linked_sets_share_a_key():
    r, bands = random.Random(3), jaccard.Bands(90, 4000)
    hashes = lambda s: np.unique(jaccard.mix(np.array(sorted(s), np.uint64)))
    for size in [*range(9, 60), 99, 333, 1000]:
        for _ in range(6):
            a = set(r.sample(range(10**6), size))
            b = set(a)
            while 100 * len(a & b) >= 90 * len(a | b):
                last = set(b)
                if r.random() < 0.5:
                    b.pop()
                else:
                    b.add(r.randrange(10**6, 10**7))
            if last != a:
                assert set(jaccard.keys(hashes(a), bands).tolist()) & set(jaccard.keys(hashes(last), bands).tolist())


def slow_whitening(x):
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    e, u = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True))
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ u[:, ::-1] / np.sqrt(np.maximum(e[::-1], 1e-300)), e[::-1]


def test_op13(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = {r.vec_id: np.floor(np.array(r.embedding, float) * 256).astype(np.int64) for r in rows}
    ids = list(x)
    n, dev, white, e = slow_whitening(np.array([x[i] for i in ids]))
    got = QUERIES["op13_embedding_whitening"](spark, sf).collect()
    assert len(got) == 4 * len(ids) == len({(r.vec_id, r.component) for r in got})
    at = {i: k for k, i in enumerate(ids)}
    sign = {}
    for r in got:
        want = white[at[r.vec_id], r.component - 1]
        assert (r.n, r.deviation) == (n, dev[at[r.vec_id]]) and r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9)
        assert abs(r.whitened) == pytest.approx(abs(want), rel=1e-8, abs=1e-9) and 0 <= r.identity_error < 1e-9
        if abs(want) > 1e-6:
            assert sign.setdefault(r.component, r.whitened * want > 0) == (r.whitened * want > 0)


def test_polynomial_and_roots(spark):
    r = np.random.default_rng(4)
    for a in (r.integers(-9, 9, (7, 7)), np.diag([5, 5, 5, 2, 0]), np.zeros((3, 3), int), np.array([[4]])):
        m = np.array((a @ a.T).tolist(), object).reshape(a.shape)
        c = whiten.characteristic_polynomial(spark, m)
        top = int(sum(m[i, i] for i in range(len(m)))) + 1
        assert c[-1] == 1 and c[-2] == 1 - top
        for x in range(-3, 4):  # det(x - m) by exact elimination
            assert sum(k * x**i for i, k in enumerate(c)) == _determinant([[Fraction(int(x * (i == j) - m[i, j])) for j in range(len(m))]
                                                                           for i in range(len(m))])
        e = np.linalg.eigvalsh(m.astype(float))[::-1]
        got = [float(x) for x in whiten.largest_roots(c, 4, top)]
        assert got == pytest.approx([x for x in e[:4] if x > 1e-6], rel=1e-9)


def _determinant(m):
    m, d = [list(r) for r in m], Fraction(1)
    for k in range(len(m)):
        p = next((i for i in range(k, len(m)) if m[i][k]), None)
        if p is None:
            return Fraction(0)
        if p != k:
            m[k], m[p], d = m[p], m[k], -d
        d *= m[k][k]
        for i in range(k + 1, len(m)):
            f = m[i][k] / m[k][k]
            m[i] = [x - f * y for x, y in zip(m[i], m[k], strict=True)]
    return d


VECTORS = "vec_id bigint, embedding array<double>, n bigint, x string, component int"


def whitened(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 1, "z", 2) for i, v in rows], VECTORS)
    return whiten.whiten(df, **kw).collect()


def test_whitening_edges(spark):
    inf, nan = float("inf"), float("nan")
    good = [(1, [0.5, 0.0, 1.0]), (2, [0.25, 1.0, 0.0]), (2, [0.25, 1.0, 0.0]), (None, [0.0, 0.25, 0.25]), (5, [1.0, 0.5, 0.125])]
    bad = [(10, None), (11, [1.0, None, 1.0]), (12, [nan, 1.0, 1.0]), (13, [1.0, -inf, 1.0]), (14, []), (15, [1.0]), (16, [1.0, 2.0, 3.0, 4.0])]
    rows = whitened(spark, good + bad)
    assert Counter((r.vec_id, r.component) for r in rows) == Counter((i, c) for i, _ in good for c in (1, 2, 3))
    assert {r.n for r in rows} == {4} and max(r.identity_error for r in rows) < 1e-9
    assert sum({r.component: r.explained for r in rows}.values()) == pytest.approx(1)
    assert whitened(spark, []) == [] and whitened(spark, bad[:5]) == [] and whitened(spark, good[1:3]) == []
    # equal eigenvalues, and directions without variance
    square = [(k, [float(a), float(b), 0.0, float(a)]) for k, (a, b) in enumerate(itertools.product((0, 1), repeat=2))]
    rows = whitened(spark, square)
    assert {r.component for r in rows} == {1, 2} and max(r.identity_error for r in rows) < 1e-9
    cube = whitened(spark, list(enumerate(map(list, itertools.product((0.0, 1.0), repeat=3)))))
    assert {r.component for r in cube} == {1, 2, 3} and max(r.identity_error for r in cube) < 1e-9
    assert [r.explained for r in cube] == pytest.approx([1 / 3] * len(cube))
    # entries beyond what a long holds
    huge = whitened(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 0.5])])
    assert {r.deviation for r in huge if r.vec_id != 3} == {None} and {r.component for r in huge} == {1, 2}
