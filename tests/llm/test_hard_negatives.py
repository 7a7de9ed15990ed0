from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemart.llm import hard_negatives as h

VECTORS = "vec_id bigint, label int, embedding array<double>, score string, anchor string, key string"


@pytest.fixture(scope="module")
def vectors(spark):
    return lambda rows: spark.createDataFrame([(*r, "x", "y", "z") for r in rows], VECTORS)


def brute(rows, anchors, positives=5, negatives=5):
    rows = sorted(
        {
            (i, label, tuple(math.floor(256 * x) for x in e))
            for i, label, e in rows
            if i is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)
        }
    )
    seen, out = set(), []
    for i, label, e in rows:
        if not anchors(i) or i in seen:
            continue
        seen.add(i)
        pairs = {(-sum(a * b for a, b in zip(e, f)), j, k == label) for j, k, f in rows if len(e) == len(f)}
        for p, j, _ in sorted(x for x in pairs if x[2] and x[1] != i)[:positives]:
            near = sorted(x for x in pairs if not x[2] and 80 * -p <= 100 * -x[0] <= 100 * -p)[:negatives]
            out += [(i, j, r, n, -p, -s) for r, (s, n, _) in enumerate(near, 1)]
    return sorted(out)


def mined(frame, anchors, **kw):
    return sorted(tuple(r) for r in h.mine(frame, anchors, **kw).collect())


def test_negatives_equal_brute_force(vectors):
    rng = random.Random(11)
    rows = [(i, rng.randint(0, 2), [rng.choice([0.0, 0.25, 0.5, -0.25, 0.1]) for _ in range(6)]) for i in range(250)]
    rows += rows[20:30]  # repeated rows
    rows += [
        (None, 1, [0.5] * 6), (300, None, [0.5] * 6), (301, 1, None), (302, 1, [0.5, None]),
        (303, 1, [float("nan")] * 6), (304, 1, [float("inf")] * 6), (310, 1, [0.5] * 4), (311, 2, [0.25] * 4),
        (312, 1, [0.5] * 4), (320, 1, []), (321, 2, []), (322, 1, []), (-10, 0, [0.5] * 6), (330, 0, [1e300] * 6), (335, 1, [-1e9] * 6),
    ]
    want = brute([r for r in rows if r[0] not in (330, 335)], lambda i: i % 10 == 0)
    assert mined(vectors([r for r in rows if r[0] not in (330, 335)]), F.col("vec_id") % 10 == 0, block_size=7) == want
    h.mine(vectors(rows), F.col("vec_id") % 10 == 0).count()  # numbers beyond 64 bits do not fail


def test_empty_tables_and_lone_anchors(vectors):
    assert mined(vectors([]), h.every_hundredth()) == []
    assert mined(vectors([(100, 1, [1.0])]), h.every_hundredth()) == []
    assert mined(vectors([(100, 1, [1.0]), (1, 2, [1.0]), (2, 1, [1.0])]), h.every_hundredth()) == [(100, 2, 1, 1, 65536, 65536)]


def test_labels_move_where_ids_are_divisible_by_seven(vectors):
    got = h.relabelled(vectors([(7, 9, [1.0]), (8, 9, [1.0]), (14, None, None)])).collect()
    assert [(r.vec_id, r.label) for r in got] == [(7, 0), (8, 9), (14, None)]


def test_keys_sort_as_their_numbers():
    rng = random.Random(2)
    rows = [(rng.randint(-3, 3), rng.choice([-(2**60), -1, 0, 1, 5, 2**62]), rng.random() < 0.5, rng.randint(-5, 5)) for _ in range(500)]
    keys = sorted({h.pack(*r) for r in rows})
    assert [h.unpack(k) for k in keys] == sorted(set(rows), key=lambda r: (r[0], -r[1], r[2], r[3]))


def test_products_are_exact_beyond_double_precision():
    a, b = np.array([[2.0**40 + 1, 3.0]]), np.array([[2.0**20 + 1, 7.0]])
    assert h.products(a, b)[0, 0] == (2**40 + 1) * (2**20 + 1) + 21
