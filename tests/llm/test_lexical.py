"""Hybrid search against plain scoring of every document."""

import math
import random
import re
from collections import Counter

import pytest

from fleetlens.llm import lexical as X

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    bags = [(i, words(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in bags), sum(len(w) for _, w in bags)
    df = Counter(t for _, w in bags for t in set(w))
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        asked = set(words(text)) & set(weight)
        found = []
        for i, w in bags:
            tf = Counter(w)
            if w:
                m = 50 + 50 * len(w) * n_docs // n_terms
                s = sum(weight[t] * (10 ** 9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in asked if t in tf)
                if s > 0:
                    found.append((-s, i is None, i or 0, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def corpus(seed, n=600):
    """Zipf words, so that lists are short and long; repeated texts for ties; items made of both."""
    r = random.Random(seed)
    vocab = [f"t{i}" for i in range(900)]
    weights = [1 / (i + 1) for i in range(900)]
    text = lambda n: " ".join(r.choices(vocab, weights, k=n))
    docs = [(i, text(r.randint(1, 80))) for i in range(n)]
    docs += [(n + i, docs[i % 7][1].upper()) for i in range(60)]
    items = [(i, text(r.randint(1, 25))) for i in range(25)]
    return docs, items


def run(spark, docs, items, k, parts=3):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(x) for x in X.search(d, i, k).collect()), key=str)


@pytest.mark.parametrize("segment", [8192, 100])
def test_matches_brute_force(spark, monkeypatch, segment):
    docs, items = corpus(segment)
    monkeypatch.setattr(X, "SEGMENT_DOCS", segment)
    monkeypatch.setattr(X, "TURN", 2)
    assert run(spark, docs, items, 10) == brute(docs, items, 10)


def test_query_blocks(spark, monkeypatch):
    docs, items = corpus(2, 80)
    monkeypatch.setattr(X, "BLOCK_BYTES", 300)
    assert run(spark, docs, items, 5) == brute(docs, items, 5)


def test_defined_cases(spark):
    docs = [(1, None), (2, ""), (3, "... !"), (4, "Ünï x1 ünï"), (4, "Ünï x1 ünï"), (None, "Ünï x1 ünï"), (5, "x1 " * 5000), (6, "other words here")]
    items = [(1, "x1 X1"), (1, "x1 X1"), (2, None), (3, "--"), (4, "unknown"), (None, "ünï"), (5, "Ünï")]
    assert run(spark, docs, items, 50, 1) == brute(docs, items, 50)
    assert run(spark, [], items, 50) == [] and run(spark, docs, [], 50) == []
    d = spark.createDataFrame([(1, "a b", 3, "x")], "doc_id long, text string, n int, score string")
    i = spark.createDataFrame([("i", "b", 1)], "item_id string, text string, rank int")
    assert [tuple(r)[:3] for r in X.search(d, i).collect()] == [("i", 1, 1)]
