from __future__ import annotations

import random

import numpy as np
import pytest

from tests.llm.conftest import EDGES, prose
from tidemart.llm import minhash, subspace
from tidemart.llm.components import components


class Forest(dict):
    def root(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = min(a, b)


def test_components_of_chains_stars_and_noise(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    edges += [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)]
    rng.shuffle(edges)
    forest = Forest()
    for a, b in edges:
        if a != b:
            forest.join(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {n: forest.root(n) for n in list(forest)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def near_copies(seed: int, n: int, edits: int):
    rng = random.Random(seed)
    base = prose(150, seed).split()
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = "edited" + str(rng.randint(0, 9))
        yield " ".join(words)


def test_groups_equal_brute_force(docs):
    texts = [t for s in range(12) for t in near_copies(s, 12, 6)] + [prose(150, 900 + i) for i in range(30)]
    texts += ["Short one", "short  ONE\n", "short two", "Ähnlich gleich", "ähnlich gleich"]
    random.Random(1).shuffle(texts)
    rows = [*EDGES, *[(100 + i, t) for i, t in enumerate(texts)]]
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    forest = Forest()
    for k, (a, x) in enumerate(sets):
        forest.root(a)
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                forest.join(a, b)
    got = minhash.groups(docs(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == forest.root(r.doc_id) and r.kept == (r.component_id == r.doc_id)
    assert sorted(r.n_shingles for r in got) == sorted(len(shingles(t)) for _, t in rows)
    kept = minhash.kept(docs(rows))
    assert kept.columns == docs(rows).columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({forest.root(i) for i, _ in sets}) and ids.count(None) == 1
    assert minhash.groups(docs([])).count() == 0 and minhash.kept(docs([])).count() == 0


def test_tables_miss_few_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    trials, missed = 3_000, 0
    for _ in range(trials // 100):
        common = rng.integers(0, 1 << 63, (100, 150), dtype=np.uint64)
        sides = [np.concatenate([common, rng.integers(0, 1 << 63, (100, 25), dtype=np.uint64)], axis=1) for _ in (0, 1)]
        keys = [minhash.table_keys(s.ravel(), np.arange(101) * 175)[0] for s in sides]
        missed += (~(keys[0] == keys[1]).any(axis=1)).sum()
    assert missed <= 3  # at a similarity of 0.75 one in 10,000 is expected


def test_long_sketches_pass_pairs_at_the_threshold_and_few_below():
    rng = np.random.default_rng(5)

    def differing(common: int, own: int, trials: int = 300):
        shared = rng.integers(0, 1 << 63, (trials, common), dtype=np.uint64) << np.uint64(1)
        sides = [np.concatenate([shared, rng.integers(0, 1 << 63, (trials, own), dtype=np.uint64) << np.uint64(1)], axis=1) for _ in (0, 1)]
        words = [minhash.bit_sketches(s.ravel(), np.arange(trials + 1) * (common + own)) for s in sides]
        return np.bitwise_count((words[0] ^ words[1]).view(np.uint64)).sum(axis=1)

    at, below = differing(150, 25), differing(120, 45)  # similarities 0.75 and 0.57
    assert (at <= minhash.BITS_MOST).all() and (below > minhash.BITS_MOST).all()
    assert abs(at.mean() / minhash.N_BITS - 0.125) < 0.005


def test_pairs_across_components_come_once(docs, spark):
    """A group whose pairs lie just above, at and below the threshold, each node in a component of its own."""
    rows = list(enumerate(near_copies(77, 60, 9)))
    sets = [shingles(t) for _, t in rows]
    mixed = spark.createDataFrame([(k, i, i) for i, _ in rows for k in range(i % 3, 9)], "key bigint, node bigint, root bigint")
    pairs = [(r.a, r.b) for r in minhash.across(mixed, docs(rows)).collect()]
    assert len(pairs) == len(set(pairs)) and all(a < b for a, b in pairs)
    near = {(a, b) for b, y in enumerate(sets) for a, x in enumerate(sets[:b]) if 100 * len(x & y) >= 75 * len(x | y)}
    assert near and near <= set(pairs) and len(pairs) < len(rows) * (len(rows) - 1) // 2


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id bigint, embedding array<float>, node string, links int")


@pytest.mark.parametrize(("chunk", "tile"), [(subspace.CHUNK, subspace.TILE), (40, 16)])
def test_links_equal_brute_force(spark, monkeypatch, chunk, tile):
    monkeypatch.setattr(subspace, "CHUNK", chunk)
    monkeypatch.setattr(subspace, "TILE", tile)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((30, 24))
    points = np.concatenate([base, np.repeat(base[:10], 8, axis=0) + rng.standard_normal((80, 24)) * 0.33])
    points = np.concatenate([points * rng.uniform(0.1, 9, (len(points), 1)), points[:5]]).astype(np.float32)
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    odd = [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [None] * 24), (904, [float("inf")] * 24), (905, []), (906, rows[0][1][:23])]
    n = len(rows)
    unit = points.astype(float) / np.linalg.norm(points.astype(float), axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.9) & ~np.eye(n, dtype=bool)
    forest = Forest()
    for i in range(n):
        forest.root(i)
    for a, b in zip(*np.nonzero(near)):
        forest.join(int(a), int(b))
    got = {r.vec_id: r for r in subspace.groups(vectors(spark, [*rows, *odd])).collect()}
    assert len(got) == n + len(odd)
    for i in range(n):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum(), forest.root(i), forest.root(i) == i)
    for i, _ in odd:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert subspace.groups(vectors(spark, [])).count() == 0
    twice = {(r.vec_id, r.n_links) for r in subspace.groups(vectors(spark, [rows[0], rows[0], (None, rows[0][1])])).collect()}
    assert twice == {(0, 1), (None, 0)}
