"""Whitening, collocations and the n-gram join against plain Python and numpy."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import fixtures as fx
import numpy as np
import plain
import pytest
from pyspark.sql import types as T

from clientpulse.llm import collocations, ngram_join, queries, whitening

# --- whitening -----------------------------------------------------------------------------

VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
        *(T.StructField(c, T.StringType()) for c in ("n", "component", "Vector", "size", "i")),
    ]
)


def vector_table(spark, vectors):
    return spark.createDataFrame([(i, v, "a", "b", "c", "d", "e") for i, v in vectors], VECTORS).repartition(3)


def check_whitening(vectors, got, most=32):
    x = np.array([np.floor(64 * np.array(v, dtype=np.float64)) + 1_000_000 for _, v in vectors])
    n, size = x.shape
    k = min(most, size)
    total = [sum(int(a) for a in column) for column in x.T]
    centred = x - x.mean(axis=0)
    v = centred.T @ centred / n
    want = np.linalg.eigvalsh(v)[::-1][:k]
    assert len(got) == n * k and {r.n for r in got} == {n}
    deviation = Counter((i, sum((n * int(a) - s) ** 2 for a, s in zip(row, total))) for (i, _), row in zip(vectors, x))
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == deviation
    for r in got:
        assert abs(r.explained * np.trace(v) / want[r.component - 1] - 1) < 1e-9
        assert r.identity_error < 1e-9
    z = defaultdict(dict)
    for r in got:
        z[r.vec_id][r.component] = r.whitened
    if len(z) == n:
        z = np.array([[z[i][c] for c in range(1, k + 1)] for i, _ in vectors])
        u = centred.T @ z / n / np.sqrt(want)  # the components that the values are projections on
        assert np.allclose(u.T @ u, np.eye(k), atol=1e-8)
        assert np.allclose(v @ u, u * want, atol=1e-8 * want[0])
        assert np.allclose(centred @ u / np.sqrt(want), z, atol=1e-8)


def test_whitening_of_the_sample(spark):
    rows = spark.read.parquet(f"{fx.SF}/embeddings.parquet").collect()
    check_whitening([(r.vec_id, r.embedding) for r in rows], queries.QUERIES["op11_embedding_whitening"](spark, fx.SF).collect())


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.normal(size=3).tolist()) for i in range(40)] + [(None, [1.0, 2.0, 3.0]), (5, [1.0, 2.0, 3.0]), (5, [1.0, 2.0, 3.0])]
    bad = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [float("inf"), 0.0, 1.0], [1.0, 2.0], [1.0] * 4]
    docs = vector_table(spark, good + [(100 + i, v) for i, v in enumerate(bad)])
    got = whitening.whitened_rows(docs).collect()
    check_whitening(good, got)
    two = whitening.whitened_rows(docs, components=2).collect()
    assert max(r.component for r in two) == 2 and len(two) == 2 * len(good)


def test_whitening_without_variance(spark):
    flat = whitening.whitened_rows(vector_table(spark, [(i, [0.5, 0.25]) for i in range(4)])).collect()
    assert len(flat) == 8 and all(r.whitened is None and r.explained is None and r.deviation == 0 for r in flat)
    line = whitening.whitened_rows(vector_table(spark, [(i, [float(i), 2.0 * i]) for i in range(9)])).collect()
    assert all((r.whitened is None) == (r.component == 2) and r.identity_error < 1e-9 for r in line)
    assert whitening.whitened_rows(vector_table(spark, []).limit(0)).count() == 0


def test_whitening_of_large_entries_is_exact(spark):
    vectors = [(i, [1e12 * i, -3e11 * i * i]) for i in range(5)]
    got = {r.vec_id: r.deviation for r in whitening.whitened_rows(vector_table(spark, vectors)).collect()}
    assert set(got.values()) == {None}  # beyond 64 bits
    huge = whitening.whitened_rows(vector_table(spark, [(1, [1e300]), (2, [-1e300]), (3, [0.0])])).collect()
    assert [abs(round(r.whitened, 6)) for r in sorted(huge, key=lambda r: r.vec_id)] == [1.224745, 1.224745, 0.0]


@pytest.mark.parametrize("spread", [1e-3, 1e-6, 1e-9, 0.0])
def test_eigenvectors_of_clusters(spread):
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.normal(size=(40, 40)))
    values = np.concatenate([1 + spread * np.arange(10), np.full(10, 2.0), rng.uniform(0.1, 3, 20)])
    v = (q.astype(np.longdouble) * values) @ q.T.astype(np.longdouble)
    v = (v + v.T) / 2
    found, x = whitening.eigenpairs(v)
    assert np.abs(found - np.sort(values)[::-1]).max() < 1e-14
    x = x.astype(np.longdouble)
    assert np.abs(v @ x - x * found).max() < 1e-14 and np.abs(x.T @ x - np.eye(40)).max() < 1e-14


# --- collocations ----------------------------------------------------------------------------


def plain_collocations(rows, least, top=2000):
    """lang, rank, phrase, a, l, r, n, score of (text, lang) rows."""
    count, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 6):
                count[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in count.items():
        often = {p: n for p, n in f.items() if n >= least}
        found = []
        for p, a in often.items():
            if len(p) < 2:
                continue
            longer = [q for q in often if len(q) > len(p) and often[q] >= a]
            if any(q[i : i + len(p)] == p for q in longer for i in range(len(q) - len(p) + 1)):
                continue
            score, _, left, right = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def odd_phrases():
    return [
        ("New York City, new york city. new  york\tcity!", "en"),
        ("a a a a a a a", "en"),
        ("in the end of the day\nin the end of the day; in the end", None),
        ("in the end of the night", "und"),
        (None, None),
        ("", "fr"),
        (" \t.,!? ", "fr"),
        ("ÄÖÜ naïve\xa0word 中文 naïve\xa0word 中文", "de"),
        ("one two three four five six seven. one two three four five six seven", "en"),
        ("zero one two three four five", "en"),
        ("one two three four five six eight", "en"),
        ("x" * 3000 + " y " + "x" * 3000 + " y", "en"),
        (fx.prose(4, 5000, 30), "long"),
        ("hot word " * 3000, "hot"),
    ]


@pytest.fixture(scope="module")
def phrases(spark):
    rows = [(i, t, lang, "s", 1, *(f"x{j}" for j in range(len(fx.CLASHING)))) for i, (t, lang) in enumerate(odd_phrases() * 2)]
    return spark.createDataFrame(rows, fx.SCHEMA).repartition(3).cache()


@pytest.mark.parametrize("least", [2, 3, 6])
def test_collocations_of_odd_rows(phrases, least):
    got = collocations.collocations(phrases, least=least, top=50).collect()
    assert sorted(map(tuple, got)) == plain_collocations(odd_phrases() * 2, least, 50)


def test_collocations_with_a_full_filter_and_small_packs(phrases, monkeypatch):
    want = plain_collocations(odd_phrases() * 2, 3)
    monkeypatch.setattr(collocations, "MOST_BITS", 64)
    monkeypatch.setattr(collocations, "LEAST_BITS", 64)
    monkeypatch.setattr(collocations, "PACK_WORDS", 500)
    monkeypatch.setattr(collocations, "MOST_HELD", 40)
    got = collocations.collocations(phrases, least=3).collect()
    assert sorted(map(tuple, got)) == want
    assert collocations.collocations(phrases.limit(0)).count() == 0


def test_paths_of_a_pack_weigh_what_its_grams_do():
    """Expanding the compacted paths gives each longest gram its count."""

    class All:
        def __call__(self, items):
            return np.ones(len(items), dtype=bool)

    pack = collocations.Words()
    texts = ["a b c d e f g h. a b c d e f g h", "x b c d e f y. q", "a a a a a a a", fx.prose(8, 600, 12)]
    want = Counter()
    for t in texts:
        pack.add(t, "en")
        for piece in re.split(r"[.\n]", t):
            w = piece.split()
            want.update(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    got = Counter()
    for _, words, n in collocations.pack_graph(pack, All(), All(), 5):
        w = (words or "").split()
        for i in range(len(w) - 4):
            assert tuple(w[i : i + 5]) not in got
            got[tuple(w[i : i + 5])] = n
    assert got == want


# --- the n-gram join ----------------------------------------------------------------------------


def linked(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_links_of_the_sample(spark):
    rows = [r[:2] for r in fx.sample_rows(spark)]
    assert linked(queries.QUERIES["op13_ngram_join"](spark, fx.SF)) == plain.components(rows, 80)


def test_links_of_odd_rows(spark):
    rows = [(d, t) for d, t, _ in fx.odd_rows() if d is not None and d != 17]
    want = plain.components(list(dict.fromkeys(rows)), 80)
    got = ngram_join.linked_documents(fx.odd_table(spark)).collect()
    assert len(got) == len(fx.odd_rows())
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got if r.doc_id in want)
    assert {r.component_id for r in got if r.doc_id is None and r.n_shingles > 5} == {1}
    assert {r.component_id for r in got if r.doc_id is None and r.n_shingles <= 5} == {None}
    assert ngram_join.linked_documents(fx.empty_table(spark)).count() == 0


def near_rows(n, size, edits, seed=0):
    """``n`` texts of ``size`` words, each with its own random edits of one text."""
    rng = np.random.default_rng(seed)
    base = fx.prose(seed + 60, size, 5000).split()
    rows = []
    for i in range(n):
        words = list(base)
        for at in rng.integers(0, size, rng.integers(0, edits + 1)):
            words[at] = f"e{i}x{at}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("size, edits", [(30, 2), (90, 4), (110, 6), (400, 14)])
def test_links_about_the_threshold(spark, monkeypatch, size, edits):
    monkeypatch.setattr(ngram_join, "PART_ROWS", 7)
    rows = near_rows(120, size, edits) + [(1000 + i, t + " tail" * (i % 4)) for i, t in near_rows(40, size + 20, edits, 5)]
    got = linked(ngram_join.linked_documents(fx.table(spark, [(*r, "a") for r in rows]).repartition(5)))
    want = plain.components(rows, 80)
    assert got == want
    assert 1 < len({c for _, c in want.values()}) < len(rows)


def test_other_thresholds(spark):
    rows = near_rows(60, 60, 5)
    docs = fx.table(spark, [(*r, "a") for r in rows]).cache()
    for percent in (60, 95):
        assert linked(ngram_join.linked_documents(docs, percent=percent)) == plain.components(rows, percent)


def test_a_shared_template_makes_few_pairs(spark):
    """Texts that share half of their words, all in the same places, are nowhere compared."""
    template = fx.prose(70, 100, 5000).split()
    rows = [(i, " ".join(template + fx.prose(1000 + i, 60, 5000).split())) for i in range(300)]
    join = ngram_join.Join(fx.table(spark, [(*r, "a") for r in rows]), "doc_id", "text", 80)
    sets = join.sets()
    assert sets.count() == 0
