from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import EDGES, prose
from tidemart.llm import common, grams, langid, toxicity

SYLLABLES = {"aa": "ba de fi go lu", "bb": "kra tsi mor wen ul", "cc": "xo zy qua jin pel", "dd": "sno vre hai lop cu"}


def fold(i: int, n: int) -> int:
    return zlib.crc32(str(i).encode()) % n


def test_windows_are_the_words_letters():
    words = pa.array(["ab", "é", "abcdefghijk"])
    keys, owner = grams.windows(words, 2)
    spelled = [k.to_bytes(2, "big") for k in keys.tolist()]
    assert spelled[:3] == [b" a", b"ab", b"b "] and owner.tolist()[:3] == [0, 0, 0]
    assert b"".join(spelled[3:6]) == b" \xc3\xc3\xa9\xa9 "
    keys, owner = grams.letter_windows(words, 3)
    code = lambda s: sum((ord(c) - 96 if c != " " else 0) << 6 * k for k, c in enumerate(reversed(s)))
    assert keys.tolist()[:3] == [code("  a"), code(" ab"), code("ab ")]
    assert np.bincount(owner).tolist() == [3, 2, 12]


def test_codewords_differ_in_many_bits():
    for n in (2, 3, 4, 5, 9, 40):
        code = langid.codewords(n)
        apart = (code[:, None, :] != code[None, :, :]).sum(axis=2) + 99 * np.eye(n, dtype=int)
        assert set(np.unique(code)) <= {-1, 1} and apart.min() >= max(1, code.shape[1] // 4)
        assert (np.abs(code.sum(axis=0)) < n).all()  # no bit is the same for all languages


def test_languages_are_told_apart_on_held_out_texts(docs):
    langs = sorted(SYLLABLES)
    rows = [(i, prose(20 + i % 60, i, SYLLABLES[langs[i % 4]]), langs[i % 4]) for i in range(400)]
    frame = docs([*rows, *((i, t) for i, t in EDGES if i is None or i < 7), (-1, "12 34 !?", "aa")])
    got = langid.predict(frame, langid.fit(frame)).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == frame.count()
    held = [r for r in got if r.held_out and (r.doc_id or 0) > 6]
    assert len(held) > 50 and all(fold(r.doc_id, 4) == 2 for r in held)
    want = {i: lang for i, _, lang in rows[7:]}
    assert np.mean([r.lang_pred == want[r.doc_id] for r in held if r.doc_id in want]) > 0.99
    for i in (-1,):
        assert (by_id[i].lang_pred, by_id[i].score, by_id[i].ambiguous) == ("und", 0.0, False)
    assert all(0 <= r.score <= 1 for r in got)


def test_held_out_languages_are_not_learned(docs):
    rows = [(i, prose(30, i), "only") for i in range(200) if fold(i, 4) == 2]
    model = langid.fit(docs(rows))
    assert model.languages == ()
    assert {r.lang_pred for r in langid.predict(docs(rows), model).collect()} == {"und"}
    assert langid.predict(docs([]), model).count() == 0


def test_kneser_ney_probabilities_sum_to_one():
    rng = random.Random(2)
    words = pa.array(["".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(300)])
    keys, _ = grams.letter_windows(words, toxicity.ORDER)
    gram, n = np.unique(keys, return_counts=True)
    history, at = np.unique(gram >> grams.LETTER_BITS, return_inverse=True)
    p, gamma = toxicity._interpolated(n.astype(float), at, len(history), np.zeros(len(gram)))
    total = np.bincount(at, np.exp(p)) + np.exp(gamma)  # what is left goes to the lower order
    assert np.allclose(total, 1)


def labelled(n: int):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        text = prose(rng.randint(20, 120), i).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randint(2, 4)):
                text[rng.randrange(len(text))] = "grumb" + rng.choice(["le", "ling", "led", "ler", "lesome", "lo"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic), "x"))
    return rows, labels


@pytest.fixture(scope="module")
def fitted(spark, docs):
    rows, labels = labelled(900)
    frame = docs(rows)
    table = spark.createDataFrame(labels + labels[:5] + [(None, 1, "x"), (7, None, "x")], "doc_id bigint, toxic int, score string")
    return frame, table, toxicity.fit(frame, table)


def test_toxic_texts_are_found_and_ordinary_ones_spared(fitted, docs):
    frame, _, model = fitted
    got = toxicity.score(frame, model).collect()
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted for r in held if r.doc_id % 6 == 0]) > 0.9
    assert np.mean([r.predicted for r in held if r.doc_id % 6]) < 0.02
    unseen = toxicity.score(docs([(1, prose(60, 1) + " grumbliest grumbles"), (2, prose(60, 2))]), model).collect()
    assert {r.doc_id: r.predicted for r in unseen} == {1: 1, 2: 0}


def test_toxicity_over_edges(spark, fitted, docs):
    frame, labels, model = fitted
    got = toxicity.score(docs(EDGES), model).collect()
    assert len(got) == len(EDGES) and not any(r.predicted for r in got)
    assert toxicity.accepted(docs(EDGES), model).count() == len(EDGES)
    assert toxicity.accepted(frame, model).columns == frame.columns
    none = toxicity.fit(frame, labels.where("toxic = 0"))
    assert {r.score for r in toxicity.score(frame, none).collect()} == {0.0}
    empty = toxicity.fit(docs([]), labels.limit(0))
    assert toxicity.score(docs([]), empty).count() == 0


def test_windows_beyond_the_broadcast_count_all_the_same(fitted, docs, monkeypatch):
    frame, labels, model = fitted
    texts = frame.union(docs([*EDGES, (9_000, prose(60, 1) + " grumbliest"), (9_001, prose(30, 2))]))

    def scores(model):
        return sorted((r.doc_id or -1, round(r.score, 9)) for r in toxicity.score(texts, model).collect())

    want, kept = scores(model), toxicity.accepted(texts, model).count()
    monkeypatch.setattr(toxicity, "MOST_GRAMS", 40)
    small = toxicity.fit(frame, labels)
    assert np.allclose(small.curve, model.curve) and np.allclose(np.array(scores(small)), np.array(want), atol=1e-6)
    assert toxicity.accepted(texts, small).count() == kept


def test_only_the_bounded_sample_is_left_out_of_the_counts(fitted, monkeypatch):
    frame, labels, _ = fitted
    monkeypatch.setattr(toxicity, "CALIBRATION_ROWS", 20)
    rows = toxicity.learning_rows(frame, labels, 1, 3)
    assert 0 < rows.where("for_curve").count() < 60 and rows.count() > 500


def test_a_text_without_words_scores_alike_beside_other_texts(fitted, docs):
    alone, beside = docs([(1, "")]), docs([(1, ""), (2, prose(50, 3)), (3, None)]).coalesce(1)
    scores = {r.doc_id: r.score for r in toxicity.score(beside, fitted[2]).collect()}
    assert scores[1] == scores[3] == toxicity.score(alone, fitted[2]).first().score


def test_texts_are_not_shuffled_for_their_rare_windows(spark, fitted, monkeypatch):
    frame, labels, _ = fitted
    monkeypatch.setattr(toxicity, "MOST_GRAMS", 40)
    scored = toxicity.score(frame, toxicity.fit(frame, labels))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "text#" not in plan


def test_toxic_texts_are_dropped_without_a_shuffle_of_the_texts(spark, fitted):
    frame, _, model = fitted
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = toxicity.accepted(frame, model)
        assert "Exchange hash" not in kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = {r.doc_id for r in toxicity.score(frame, model).where("predicted = 0").collect()}
    assert {r.doc_id for r in kept.collect()} == want


def test_arrow_memory_goes_back_behind_the_last_slice():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["x" * 1000] * 1000)})
    released, pool = [], pa.default_memory_pool
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(common.pa, "default_memory_pool", lambda: released.append(1) or pool())
        assert sum(s.num_rows for s in common.slices([batch], 100)) == 1000
    assert released == [1]
