"""Hard negatives, source divergence and substring dedup against plain Python on small tables with odd rows."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quirespark.llm import divergence, hard_negatives, substring_dedup


def negatives_by_hand(rows, positives=5, k=10):
    """rows: (row, id, label, ints, is_anchor)."""
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for row, i, label, v, is_anchor in rows:
        if not is_anchor:
            continue
        order = sorted((-dot(v, w), j, r, m) for r, j, m, w, _ in rows if r != row)
        for score, j, _, m in [x for x in order if x[3] == label][:positives]:
            p = -score
            inside = [(-s, n) for s, n, _, m2 in order if m2 != label and 30 * p <= -100 * s <= 90 * p][:k]
            out += [(i, j, rank, n, p, s) for rank, (s, n) in enumerate(inside, 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["plain", "ties", "large"])
def test_hard_negatives(spark, kind, monkeypatch):
    monkeypatch.setattr(hard_negatives, "PIECE", 64)
    rng = random.Random(kind)
    draw = {"plain": lambda: rng.gauss(0.1, 0.3), "ties": lambda: float(rng.choice([0, 0.25, 0.5])), "large": lambda: rng.gauss(1, 1) * 1e5}[kind]
    rows = [(i, [draw() for _ in range(8)], rng.randrange(4)) for i in range(300)]
    rows += [(100, [draw() for _ in range(8)], 1), (7, rows[7][1], rows[7][2]), (300, [0.5] * 5, 2), (301, [], 3)]  # repeated ids, shorter and empty vectors
    odd = [(400, None, 1), (500, [1.0] * 8, None), (None, [1.0] * 8, 1), (600, [1.0, None], 1), (700, [float("nan")], 1), (800, [float("inf")] * 8, 1)]
    df = spark.createDataFrame([(i, v, y, "x", 0) for i, v, y in rows + odd], "vec_id long, embedding array<double>, label int, anchor string, row int").repartition(3)
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, block=4)
    want = negatives_by_hand([(r, i, y, [math.floor(256 * x) for x in v], i % 50 == 0) for r, (i, v, y) in enumerate(rows)])
    assert sorted(tuple(r) for r in got.collect()) == want
    assert want


def test_hard_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.hard_negatives(empty, F.col("vec_id") % 2 == 0).count() == 0
    huge = spark.createDataFrame([(i, [3e38] * 4, i % 2) for i in range(4)], "vec_id long, embedding array<double>, label int")
    assert hard_negatives.hard_negatives(huge, F.col("vec_id") == 0).count() == 0  # every score is cut at the bound, so none lies between limits


def divergence_by_hand(docs, least, top):
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    n, seen, groups = Counter(), Counter(), set()
    for text, lang, source in docs:
        w, lang, source = words(text), lang or "", source or ""
        groups.add((lang, source))
        n.update((lang, source, t) for t in w)
        seen.update((lang, t) for t in set(w))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (x, t), c in seen.items() if x == lang and c >= least)
        own = sorted(s for x, s in groups if x == lang)
        count = {s: {t: n[lang, s, t] for t in kept} for s in own}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        p = {s: share(count[s]) for s in own}
        q = share({t: sum(count[s][t] for s in own) for t in kept})
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in own if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if count[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, "pair", o.decode(), -v, r) for r, (v, o) in enumerate(pairs, 1)]
            out += [(lang, s, "term", t.decode(), -v, r) for r, (v, t) in enumerate(terms, 1)]
    return sorted(out)


@pytest.mark.parametrize("width", [1_000_000, 40])
def test_divergence(spark, width, monkeypatch):
    monkeypatch.setattr(divergence, "CELLS", width)
    monkeypatch.setattr(divergence, "PAIRS", 100)
    monkeypatch.setattr(divergence, "HELD", 20)
    monkeypatch.setattr(divergence, "CUT", 50)
    rng = random.Random(5)
    vocabulary = [*"alpha Beta gamma ÉTÉ naïve 漢字 x yy Zz straße ſ K".split(), *(f"w{a}{b}" for a in "abcdefgh" for b in "abcdefgh")]
    draw = lambda: rng.choice([" ", ", ", "1", "\n"]).join(rng.choices(vocabulary, k=rng.randrange(40)))
    docs = [(draw(), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "Ω", "", None])) for _ in range(200)]
    docs += [(None, "en", "only null"), ("", "fr", "s1"), ("once", "fr", "s2"), (None, "xx", None), (docs[0][0], *docs[0][1:]), (" ".join(vocabulary) * 50, "en", "a")]
    df = spark.createDataFrame([(t, lang, s, "k", 1) for t, lang, s in docs], "text string, lang string, source string, term string, n long").repartition(3)
    got = divergence.audit(df, least=5, top=3)
    assert sorted(tuple(r) for r in got.collect()) == divergence_by_hand(docs, 5, 3)


def test_divergence_of_nothing_and_of_large_counts(spark):
    import numpy as np

    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
    count, whole = np.array([1, 10**15 - 7, 3 * 10**15]), np.array([3, 10**15, 3 * 10**15])
    assert divergence.shares(count, whole).tolist() == [1 + 10**9 * int(c) // int(w) for c, w in zip(count, whole)]


def removed_by_hand(docs, window):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    least = {}
    for i, w in words:
        for k in range(len(w) - window + 1 if i is not None else 0):
            g = tuple(w[k : k + window])
            least[g] = min(i, least.get(g, i))
    out = []
    for i, w in words:
        gone = {k + j for k in range(len(w) - window + 1 if i is not None else 0) if least[tuple(w[k : k + window])] < i for j in range(window)}
        out.append((-1 if i is None else i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


@pytest.mark.parametrize(("window", "base", "block"), [(13, 7, 8_000_000), (13, 7, 300), (5, 1, 200), (4, 9, 500), (20, 3, 1000)])
def test_substrings(spark, window, base, block, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    rng = random.Random(window)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "漢", " ", "a b"]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [draw(rng.randrange(3, 60)) for _ in range(6)]
    docs = []
    for i in range(80):
        w = draw(rng.randrange(30))
        for _ in range(rng.randrange(3)):
            w = w + rng.choice(passages) + draw(rng.randrange(5))
        docs.append((rng.randrange(70) if i % 7 else None, rng.choice([" ", "\n", "\t \x0b"]).join(w)))
    docs += [(90, None), (91, ""), (92, docs[1][1]), (93, docs[1][1]), (5, docs[2][1]), (5, docs[2][1]), (None, docs[1][1]), (94, "same " * 400), (95, "same " * 300), (-3, " ".join(passages[0]))]
    rng.shuffle(docs)
    df = spark.createDataFrame([(i, t, 1, "b") for i, t in docs], "doc_id long, text string, block long, bucket string").repartition(3)
    found = substring_dedup.dedup_substrings(df, window, base).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.text) for r in found)
    assert got == removed_by_hand(docs, window)
    assert all(sum(x.end - x.start for x in r.removed) == r.n_removed for r in found)
    assert any(r.n_removed for r in found)


def test_substrings_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.dedup_substrings(empty).count() == 0
    short = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in substring_dedup.dedup_substrings(short).collect()) == [(1, 2, 0, "a b"), (2, 2, 0, "a b"), (3, 0, 0, "")]


def test_levels_double_and_end_at_the_window():
    assert substring_dedup.lengths(7, 13) == [7, 13]
    assert substring_dedup.lengths(3, 20) == [3, 6, 12, 20]
    assert substring_dedup.lengths(9, 4) == [4]
