"""Language identification by error-correcting output codes over byte n-grams.

Every language gets a codeword; for each bit a binary n-gram classifier separates the languages with that bit
from the others by the log-ratio of their mean n-gram frequencies. A text's bits are the summed log-ratios
of its n-grams; the language whose codeword has the least logistic loss wins. The loss against the next one
gives the score and, where it is small, the flag ``ambiguous``.

The classifiers are fitted on a bounded sample: about ``per_language`` labelled documents of each language,
drawn by a hash of id and text. Prediction reads every text whole.

Defined results: null texts and texts without a letter give ``und`` with score 0 and are not ambiguous. If
no language can be learned, every text gives ``und``. Null ids are not learned from. Repeated rows give
repeated results; extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemart.llm.common import pick, remainder, slices
from tidemart.llm.grams import numbered_words, summed, windows

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 16
PER_LANGUAGE = 2_000
#: Differences of loss below which the two best languages count as ambiguous.
AMBIGUOUS = 1.0
SMOOTHING = 0.1


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    codes: np.ndarray  # languages x bits, of -1 and 1
    weights: np.ndarray  # buckets x bits


def buckets(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all orders, and the words they are from."""
    keys, owners = [], []
    for n in ORDERS:
        key, word = windows(words, n)
        mixed = (key.astype(np.uint64) + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)
        keys.append((mixed >> np.uint64(48)).astype(np.int64))
        owners.append(word)
    return np.concatenate(keys), np.concatenate(owners)


def codewords(n_languages: int) -> np.ndarray:
    """The exhaustive code for up to six languages, else the best of some random codes by distance."""
    if n_languages <= 6:
        rows = np.arange(1, 2 ** max(0, n_languages - 1))
        bits = [np.ones(len(rows), int)] + [(rows >> k & 1) ^ 1 for k in range(n_languages - 1)]
        return 2 * np.stack(bits) - 1
    rng, n_bits = np.random.default_rng(7), 8 * int(np.ceil(np.log2(n_languages)))
    best, distance = None, -1
    for _ in range(50):
        code = rng.choice([-1, 1], (n_languages, n_bits))
        apart = (n_bits - (code @ code.T)) // 2 + n_bits * np.eye(n_languages, dtype=int)
        if apart.min() > distance and (np.abs(code.sum(0)) < n_languages).all():
            best, distance = code, apart.min()
    return best


def fit(docs: DataFrame, held_out: int = 2, folds: int = 4, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from documents with a language whose fold is not ``held_out``."""
    known = pick(docs, doc_id="bigint", text="string", lang="string").where(
        (remainder(F.col("doc_id"), folds) != held_out) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row for each language
    languages = tuple(sorted(sizes))
    if not languages:
        return Model((), np.zeros((0, 0)), np.zeros((BUCKETS, 0)))
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / sizes[lang]))])
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000
    code_of = {lang: i for i, lang in enumerate(languages)}

    def run(batches):
        counts = {}
        for batch in slices(batches, 1_000, 2 << 20):
            lang = np.array([code_of[x] for x in batch.column(1).to_pylist()])
            words, places, starts = numbered_words(batch.column(0))
            per_place = np.repeat(lang, np.diff(starts))
            bucket, word = buckets(words)
            for i in np.unique(lang):
                times = np.bincount(places[per_place == i], minlength=len(words))
                counts[i] = counts.get(i, 0) + np.bincount(bucket, times[word], BUCKETS)
        for i, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict(
                {"lang": pa.array(np.full(len(at), i, np.int32)), "bucket": pa.array(at.astype(np.int32)), "n": pa.array(n[at])}
            )

    counted = known.where(drawn).select("text", "lang").mapInArrow(run, "lang int, bucket int, n double")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # languages x buckets at most
    n = np.zeros((len(languages), BUCKETS))
    n[table["lang"].to_numpy(), table["bucket"].to_numpy()] = table["n"].to_numpy()
    p = (n + SMOOTHING) / (n.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
    codes = codewords(len(languages))
    weights = [np.log(p[c > 0].mean(axis=0)) - np.log(p[c < 0].mean(axis=0)) for c in codes.T]
    return Model(languages, codes, np.stack(weights, axis=1) if weights else np.zeros((BUCKETS, 0)))


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the best language, its score, and whether the next one is close; by logistic loss."""
    loss = np.logaddexp(0, -margins[:, None, :] * model.codes[None, :, :]).sum(axis=2)
    best = loss.argmin(axis=1)
    gap = loss - loss.min(axis=1, keepdims=True)
    score = 1 / np.exp(-np.minimum(gap, 50)).sum(axis=1)
    close = np.sort(gap, axis=1)[:, 1] < AMBIGUOUS if loss.shape[1] > 1 else np.zeros(len(best), bool)
    return best, score, close


def predict(docs: DataFrame, model: Model, held_out: int = 2, folds: int = 4) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        names = pa.array([*model.languages, "und"], pa.string())
        for batch in slices(batches, 2_000, 4 << 20):
            words, places, starts = numbered_words(batch.column(1))
            bucket, word = buckets(words)
            per_word = np.stack(
                [np.bincount(word, model.weights[bucket, b], len(words)) for b in range(model.codes.shape[1])] or [np.zeros(len(words))],
                axis=1,
            )[:, : model.codes.shape[1]]
            n_words = np.diff(starts)
            margins = summed(per_word[places], starts) / np.sqrt(np.maximum(1, n_words))[:, None]
            empty = n_words == 0
            if len(model.languages):
                best, score, close = decode(model, margins)
            else:
                empty = np.ones(len(n_words), bool)
                best, score, close = np.zeros(len(empty), int), np.zeros(len(empty)), empty
            best = np.where(empty, len(model.languages), best)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    names.take(pa.array(best)),
                    pa.array(np.where(empty, 0.0, score)),
                    pa.array(close & ~empty),
                ],
                ["doc_id", "lang_pred", "score", "ambiguous"],
            )

    rows = pick(docs, doc_id="bigint", text="string")
    scored = rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double, ambiguous boolean")
    out = F.coalesce(remainder(F.col("doc_id"), folds) == held_out, F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "lang_pred", "score", "ambiguous")
