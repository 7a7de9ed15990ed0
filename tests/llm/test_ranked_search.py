from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import EDGES, prose
from tests.llm.test_tokens import ODD, texts
from tidemart.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id bigint, text string, score string, doc_id string"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(documents, items, top=10):
    sets = [(i, Counter(terms(t))) for i, t in documents]
    sets = [(i, c) for i, c in sets if c]
    total = sum(c.total() for _, c in sets)
    df = Counter(t for _, c in sets for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in sets:
            m = 25 + (75 * c.total() * len(sets)) // total
            score = sum(
                math.floor(1000 * math.log((2 * len(sets) + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in terms(text)
                if c[t]
            )
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:top], 1)]
    return sorted(map(repr, out))


def found(spark, docs, documents, items):
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in items], ITEMS)
    return sorted(repr(tuple(r)) for r in ranked_search.search(docs(documents), frame).collect())


def test_search_equals_brute_force(spark, docs):
    documents = [*EDGES, *((100 + i, prose(60, i % 40)) for i in range(150)), (900, "Ä word, same WORD_word é2")]
    items = [(i, prose(12, i)) for i in range(25)] + [(30, "word same SAME x1 漢字"), (31, "zzz"), (32, ""), (33, None)]
    assert found(spark, docs, documents, items) == brute(documents, items)


def test_empty_tables_and_items_that_share_an_id(spark, docs):
    assert found(spark, docs, [], [(1, "a b")]) == []
    assert found(spark, docs, [(1, "a"), (2, "b")], []) == []
    assert found(spark, docs, [(1, "a"), (2, "b"), (3, "c d")], [(1, "b"), (1, "a"), (None, "b")]) == brute(
        [(1, "a"), (2, "b"), (3, "c d")], [(1, "a")]
    )


def test_terms_of_odd_texts():
    rows = [None, *texts(), ODD, ""]
    names, number, text = ranked_search.terms_of(pa.array(rows).slice(1))
    got = [[] for _ in rows[1:]]
    for t, n in zip(text.tolist(), number.tolist()):
        got[t].append(names[n].as_py())
    assert got == [terms(t) for t in rows[1:]]


@pytest.mark.parametrize("leaf, front", [(1, 1), (3, 4)])
def test_intervals_split_down_to_documents(monkeypatch, leaf, front):
    """Best-first search over small intervals finds what scoring every document finds, ties included."""
    monkeypatch.setattr(ranked_search, "LEAF", leaf)
    monkeypatch.setattr(ranked_search, "FRONT", front)
    rng = random.Random(leaf)
    for _ in range(30):
        size, n_terms = rng.randint(1, 60), rng.randint(1, 8)
        lists = [sorted(rng.sample(range(n_terms), rng.randint(0, n_terms))) for _ in range(size)]
        counts = [[rng.randint(1, 3) for _ in x] for x in lists]
        n, ids = np.array([sum(c) for c in counts]), np.array(rng.sample(range(1000), size))
        weights, mean = np.array([rng.randint(0, 3) for _ in range(n_terms)]), (size, max(1, int(n.sum())))
        ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        flat = lambda rows: np.array([v for r in rows for v in r], np.int64)
        shard = ranked_search.Shard(ids, n, ends, flat(lists), flat(counts), weights, mean)
        query = Counter({t: rng.randint(1, 2) for t in range(n_terms) if weights[t]})
        if not query or not len(shard.key):
            continue
        scores = []
        for i, x, c, k in zip(ids, lists, counts, n):
            m = 25 + 75 * int(k) * mean[0] // mean[1]
            scores.append((-sum(query[t] * int(weights[t]) * (10**9 * f // (1000 * f + 8 * m)) for t, f in zip(x, c)), int(i)))
        known = [(-5, 2000), (-3, -7)]
        got = shard.search(np.array(list(query)), np.array(list(query.values())), list(known), 4)
        assert got == sorted([s for s in scores if s[0]] + known)[:4]
