"""Ranked lexical search against scoring every document."""

import math
import random
import re

import numpy as np
import pytest

from tidewrack.llm import lexical

DOCS, ITEMS = "doc_id long, text string, item string, score int", "item_id long, text string, rank int"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(lower)


def plain(docs, items, k):
    """All scores by the formulas, sorted."""
    own = [(d, terms(t)) for d, t in docs]
    own = [(d, t) for d, t in own if t]
    n_docs, total = len(own), sum(len(t) for _, t in own)
    df = {}
    for _, t in own:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    rows = []
    for item, text in set(items):
        if text is None:
            continue
        scored = []
        for d, t in own:
            score, m = 0, 50 + 50 * len(t) * n_docs // total
            for w in set(terms(text)):
                tf = t.count(w)
                if tf:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * tf // (1000 * tf + 20 * m))
            if score > 0 and d is not None:
                scored.append((-score, d))
        rows += [(item, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(rows, key=str)


def got(spark, docs, items, **how):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS).repartition(5)
    b = spark.createDataFrame([(i, t, 2) for i, t in items], ITEMS)
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in lexical.ranked(d, b, **how).collect()), key=str)


@pytest.mark.parametrize("how", [{}, {"bucket_rows": 16, "block_bytes": 300}])
def test_rows_equal_scoring_everything(spark, how):
    rng = random.Random(5)
    words = ["the", "of", *(f"w{i}" for i in range(60)), "Straße", "été", "x9", "ÀB"]
    share = [1 / (1 + i) for i in range(len(words))]
    text = lambda n: " ".join(rng.choices(words, share, k=n)).replace("w1 ", "W1,")
    docs = [(i, text(rng.choice([3, 8, 30, 200]))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(150)]  # a large group of copies
    docs += [(3, "w40 w41"), (3, "w40 w41"), (None, "w40 w41 w42"), (2000, None), (2001, ""), (2002, "?! -"), (2003, "w5 " * 40_000)]
    items = [(i, text(12)) for i in range(25)] + [(7, "w40 w41 THE"), (7, "w40 w41 THE"), (None, "of the x9"), (31, None), (32, "unseen"), (33, "")]
    assert got(spark, docs, items, k=10, **how) == plain(docs, items, 10)


def test_empty_tables(spark):
    assert got(spark, [], [(1, "a")]) == []
    assert got(spark, [(1, "a")], []) == []
    assert got(spark, [(1, None)], [(1, "a")]) == []
    assert got(spark, [(1, "a"), (2, "b")], [(1, "A b")]) == plain([(1, "a"), (2, "b")], [(1, "A b")], 50)


def test_long_texts_are_cut_between_terms(monkeypatch):
    text = ("Abc déf," * 50 + "q" * 40 + " z").encode()
    whole = [t for strip in lexical.term_strips(text) for t in strip]
    monkeypatch.setattr(lexical, "STRIP", 13)
    assert [t for strip in lexical.term_strips(text) for t in strip] == whole
    assert whole[:2] == [b"abc", "déf".encode()] and whole[-1] == b"z"


def test_no_document_above_the_floor_is_pruned():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 9, 300)
    terms_, impacts = [], []
    for s in sizes:
        terms_ += sorted(rng.choice(20, s, replace=False).tolist())
        impacts += rng.integers(1, 10**6, s).tolist()
    terms_, impacts = np.array(terms_), np.array(impacts)
    rows = np.repeat(np.arange(300), sizes)
    length = np.sqrt(np.bincount(rows, impacts.astype(float) ** 2))
    bucket = lexical.Bucket(np.arange(300) * 3, length, sizes, terms_, impacts)
    for _ in range(50):
        own = rng.choice(22, 6, replace=False).tolist()
        weights = rng.integers(0, 9000, 6).tolist()
        exact = np.zeros(300, np.int64)
        for t, w in zip(own, weights, strict=True):
            np.add.at(exact, rows[terms_ == t], w * impacts[terms_ == t])
        for floor in (1, int(np.sort(exact)[-10]), int(exact.max()), int(exact.max()) + 1):
            floor = max(floor, 1)
            score, ids = bucket.best(own, weights, math.sqrt(sum(w * w for w in weights)), floor, 10)
            want = sorted((-s, i * 3) for i, s in enumerate(exact.tolist()) if s >= floor)[:10]
            assert sorted(zip((-score).tolist(), ids.tolist(), strict=True)) == want
