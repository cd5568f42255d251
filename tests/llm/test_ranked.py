"""Ranked search against brute force over all documents, with ties, odd rows, many groups and small blocks."""

import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import prose
from tiepoints.llm import ranked

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, k):
    held = [(i, Counter(t)) for i, t in ((i, terms(t)) for i, t in docs) if t]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in asked.items():
        scores = []
        for doc_id, c in held:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            score = sum(
                floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c
            )
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        for rank, (score, _, doc_id) in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:k], 1):
            out.append((item, rank, doc_id, -score))
    return sorted(out, key=repr)


def run(spark, docs, items, k=50, **options):
    docs = spark.createDataFrame([(i, t, 1, 2, "z") for i, t in docs], "doc_id long, text string, `rank` int, score int, item string")
    items = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    found = ranked.ranked_search(docs.repartition(3), items, k, **options)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


DOCS = [
    *[(i, prose(i % 40, 30 + i % 50)) for i in range(300)], (1000, None), (1001, ""), (1002, " .,"), (None, prose(3, 20)), (1003, prose(4, 5000)),
    (7, prose(1, 30)), (7, prose(1, 30)), *[(2000 + i, "Tie tie CAFÉ café") for i in range(70)], (1004, "日本語 \U0001f600x x"),
]
ITEMS = [
    (1, prose(5, 40)), (2, "tie"), (3, "TIE tie café CAFÉ É"), (4, None), (5, ""), (6, "unknown words only zzz"), (7, "日本語 \U0001f600x"),
    (8, prose(6, 10)), (8, prose(7, 10)), (None, "alpha1 tie"), (9, " ".join(prose(i, 40) for i in range(20))),
]


@pytest.mark.parametrize("options", [{}, {"group_bytes": 3000}, {"k": 3}])
def test_against_brute_force(spark, options):
    assert run(spark, DOCS, ITEMS, **options) == brute(DOCS, ITEMS, options.get("k", 50))


def test_small_blocks(spark, monkeypatch):
    build = ranked.build_index

    def small(docs, vocabulary):
        return build(docs.repartition(11), vocabulary)

    monkeypatch.setattr(ranked, "build_index", small)
    assert run(spark, DOCS, ITEMS) == brute(DOCS, ITEMS, 50)


def test_empty_tables(spark):
    assert run(spark, [], ITEMS) == run(spark, DOCS, []) == run(spark, [(1, None)], ITEMS) == []


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 900), st.integers(1, 12), st.integers(0, 400), st.integers(1, 60))
def test_hybrid_equals_a_full_sum(seed, n_docs, n_lists, short, k):
    rng = np.random.default_rng(seed)
    lists = []
    for _ in range(n_lists):
        at = np.flatnonzero(rng.random(n_docs) < rng.random() ** 3).astype(np.int32)
        lists.append((at, rng.integers(1, 6, len(at)) * rng.integers(1, 50)))
    total = np.zeros(n_docs, np.int64)
    for at, score in lists:
        total[at] += score
    order = np.lexsort((np.arange(n_docs), -total))[:k]
    order = order[total[order] > 0]
    at, score = ranked.best_of([x for x in lists if len(x[0])], n_docs, k, short)
    assert at.tolist() == order.tolist() and score.tolist() == total[order].tolist()


def test_ranges_that_cannot_matter_are_skipped():
    n = 64 * 400
    long_ = (np.arange(n, dtype=np.int32), np.full(n, 3))
    rare = (np.arange(0, 64 * 60, 64, dtype=np.int32), np.full(60, 1000))
    met = []
    at, score = ranked.best_of([long_, rare], n, 50, 100, met)
    assert at.tolist() == (np.arange(50) * 64).tolist() and set(score) == {1003}
    assert met[0] < 70
