"""Toxicity by two class-conditional Kneser-Ney models over the letters of words.

Both models give a letter its probability after the seven letters before it within a word, from their own
class's counts. Both back off to one model with the counts of both classes, itself smoothed by Kneser-Ney down
to single letters, so that an expression that is rare in its class is judged by shared counts and favours
none. A text's features are differences of its two log-likelihoods: per letter over the whole text, of its
most toxic word, on average of its three most toxic words, and the sum of what words have beyond ``CLEAR``;
beside them the log of its number of words, since the best of many is higher by chance. A logistic curve,
fitted on labelled documents that the counts leave out, turns them into a score.

The counts cover all labelled documents of the learning folds but those of the curve, which are one fifth and at
most about ``CALIBRATION_ROWS``. All windows are kept, as a distributed table. Counts are grouped by the three
letters before the last, so that the longer windows of a group are smoothed by themselves; the windows of up to
three letters, bounded by the alphabet, are smoothed on the driver. The model has a row for each seven letters before
a last one, its history. Texts are scored in one pass: the histories seen most often for their number of windows are
broadcast, with ``MOST_GRAMS`` windows at most, and settle nearly all words; a text's other words come out with their
open windows, which are joined to the model's other rows. Texts themselves are not shuffled for it.

Defined results: null and empty texts score by the curve with all features 0. Without labels of both classes
every score is 0. Of several labels of a document the highest counts; null labels and ids are not learned
from. Texts are scored whole; repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemart.llm.common import by_position, pick, remainder, slices, stored
from tidemart.llm.grams import LETTER_BITS, letter_windows, numbered_words, summed

#: Letters of a window; log-ratio of a word beyond which it counts as evidence.
ORDER, CLEAR = 8, 1.0
#: Letters of the longest windows that are smoothed on the driver: 64 ** 3 at most.
SHORT = 3
THRESHOLD = 0.7
#: Windows whose log-ratios are broadcast, at most; others are joined.
MOST_GRAMS = 1_000_000
#: How often a broadcast history was seen for each of its windows, at least. To join the few places of a rarer one costs
#: less than to hold it in every worker, and so the joined share does not depend on the size of the input.
LEAST_SEEN = 4
CALIBRATION_ROWS = 20_000
#: Labels, and digests of toxic texts, up to which they are broadcast (16 MB); beyond that, documents are shuffled to them.
MOST_BROADCAST = 1_000_000
#: At most one learning document in so many is left to the curve.
CALIBRATION_SHARE = 5
FEATURES = ("mean", "best", "best_three", "log_mass", "log_words")


Table = tuple[np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Model:
    """``windows`` has a row for each history, the letters before a window's last one: how often it was seen (n),
    log P(toxic) - log P(ordinary) of last letters not seen behind it (unseen), and the seen letters with their ratios.
    ``frequent`` is a :class:`Frequent` of the histories whose :func:`step` is ``least`` at least.
    ``curve`` is the intercept and a weight for each feature."""

    windows: DataFrame | None = None
    frequent: Broadcast | None = None
    least: int = 0
    curve: np.ndarray | None = None


def _sum_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, at = np.unique(keys, return_inverse=True)
    return unique, np.stack([np.bincount(at, v, len(unique)) for v in values.T], axis=1)


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted table, -1 where they are absent."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def _suffix(keys: np.ndarray, n: int) -> np.ndarray:
    return keys & ((1 << (LETTER_BITS * n)) - 1)


def counts_of_counts(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4."""
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def discounts(times: list[int]) -> np.ndarray:
    """What Kneser-Ney takes off a count of 0, 1, 2, and of 3 or more, from :func:`counts_of_counts`."""
    n1, n2, n3, n4 = (max(1, n) for n in times)
    y = n1 / (n1 + 2 * n2)
    taken = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.clip(taken, [0, 0.3, 0.5, 0.7], [0, 0.98, 1.5, 2.5])


def _interpolated(c: np.ndarray, at: np.ndarray, n_histories: int, lower: np.ndarray, taken: np.ndarray | None = None):
    """Log-probabilities of windows with counts c and history numbers at; and log backoff weights."""
    taken = discounts(counts_of_counts(c)) if taken is None else taken
    d = taken[np.minimum(c, 3).astype(int)]
    total = np.bincount(at, c, n_histories)
    gamma = np.where(total > 0, np.bincount(at, d, n_histories) / np.maximum(total, 1), 1.0)
    p = np.where(c > 0, (c - d) / np.maximum(total, 1)[at], 0.0) + gamma[at] * lower
    return np.log(np.maximum(p, 1e-30)), np.log(np.maximum(gamma, 1e-30))


def _continued(grams: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of n letters, and how many different letters stand before each."""
    return np.unique(_suffix(np.unique(_suffix(grams, n + 1)), n), return_counts=True)


def surveyed(grams: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int]]:
    """(what, key, number) of one share of the windows, to be summed over all shares.

    ``what`` is 0 for the windows of ``SHORT`` letters with the number of letters before them; the length, up to
    ``ORDER``, for :func:`counts_of_counts`; for a class's counts and their sums it is beyond ``ORDER``.
    """
    rows = [(0, int(g), int(c)) for g, c in zip(*_continued(grams, SHORT))]
    every = [(n, _continued(grams, n)[1]) for n in range(SHORT + 1, ORDER)]
    every += [(ORDER, counts.sum(axis=1)), (ORDER + 1, counts[:, 0]), (ORDER + 2, counts[:, 1])]
    rows += [(n, k, times) for n, c in every for k, times in enumerate(counts_of_counts(c))]
    return rows + [(ORDER + 3, k, int(n)) for k, n in enumerate(counts.sum(axis=0))]


def smooth_short(gram: np.ndarray, c: np.ndarray) -> Table:
    """Windows of ``SHORT`` letters and their log-probabilities, from all such windows and the letters before them."""
    keys, log_p = np.zeros(1, np.int64), np.full(1, -LETTER_BITS * np.log(2.0))
    for n in range(1, SHORT + 1):  # the shared model: lower orders count different letters before the window
        g, times = (gram, c) if n == SHORT else _continued(gram, n)
        history, at = np.unique(g >> LETTER_BITS, return_inverse=True)
        lower = np.exp(log_p[_find(keys, _suffix(g, n - 1))])
        keys, (log_p, _) = g, _interpolated(times, at, len(history), lower)
    return keys, log_p


def smooth(grams: np.ndarray, counts: np.ndarray, short: Table, taken: dict[int, np.ndarray]) -> pa.RecordBatch:
    """Interpolated Kneser-Ney models of windows: rows as in :attr:`Model.windows`.

    ``counts`` has a column for each class. Windows are all those with certain letters before the last one, ``SHORT``
    of them; ``short`` and the discounts ``taken`` (see :func:`surveyed`) are those of all windows.
    """
    keys, log_p = short
    grams, counts = _sum_by(grams, counts)
    for n in range(SHORT + 1, ORDER + 1):
        gram, c = _continued(grams, n) if n < ORDER else (grams, counts.sum(axis=1))
        history, at = np.unique(gram >> LETTER_BITS, return_inverse=True)
        lower = np.exp(log_p[_find(keys, _suffix(gram, n - 1))])
        keys, (log_p, _) = gram, _interpolated(c, at, len(history), lower, taken[n])
    pooled = np.exp(log_p)
    done = [_interpolated(counts[:, c], at, len(history), pooled, taken[ORDER + 1 + c]) for c in (0, 1)]
    ratio, unseen = ((done[1][k] - done[0][k]).astype(np.float32) for k in (0, 1))
    starts = np.searchsorted(at, np.arange(len(history) + 1)).astype(np.int32)  # windows are sorted
    columns = {
        "history": pa.array(history),
        "n": pa.array(np.bincount(at, counts.sum(axis=1), len(history)).astype(np.int64)),
        "unseen": pa.array(unseen),
        "letters": pa.ListArray.from_arrays(starts, pa.array(_suffix(grams, 1).astype(np.int8))),
        "ratios": pa.ListArray.from_arrays(starts, pa.array(ratio)),
    }
    return pa.RecordBatch.from_pydict(columns)


class Frequent:
    """Sorted histories and windows with their log-ratios, from rows as in :attr:`Model.windows`."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by("history").combine_chunks()
        self.histories, self.unseen = (rows[c].to_numpy() for c in ("history", "unseen"))
        letters = rows["letters"].combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.int8()))
        last = letters.flatten().to_numpy().astype(np.int64)
        windows = np.repeat(self.histories, letters.value_lengths().to_numpy()) << LETTER_BITS | last
        order = np.argsort(windows)
        self.windows = windows[order]
        ratios = rows["ratios"].combine_chunks().flatten().to_numpy() if rows.num_rows else np.zeros(0, np.float32)
        self.ratios = ratios[order]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-ratios of windows, and which of them are open, as other rows of the model may tell them."""
        ratio, at = np.zeros(len(keys)), _find(self.windows, keys)
        ratio[at >= 0] = self.ratios[at[at >= 0]]
        other = np.flatnonzero(at < 0)
        at = _find(self.histories, keys[other] >> LETTER_BITS)
        ratio[other[at >= 0]] = self.unseen[at[at >= 0]]
        is_open = np.zeros(len(keys), bool)
        is_open[other[at < 0]] = True
        return ratio, is_open


EIGHTHS = 8


def step() -> Column:
    """A history's place on a scale of eight steps to each double of how often it was seen for each of its windows."""
    return F.floor(F.log2(F.col("n") / F.size("letters")) * EIGHTHS)


#: What :func:`parts_of` gives of a text.
PARTS = (
    "total double, letters double, n_words bigint, top array<double>, mass double, "
    "open array<struct<n:bigint,known:double,grams:array<bigint>>>"
)


def parts_of(frequent: Frequent, texts: pa.Array) -> list[pa.Array]:
    """Per text the columns of :data:`PARTS`, from which :func:`features_of` makes the features.

    ``total`` is the log-likelihood ratio of the whole text but its open windows. ``top`` and ``mass`` are of its
    different words without open windows, so that repeated lines do not count again; ``open`` are its other words, with
    their number, what their other windows have, and their open windows.
    """
    words, places, starts = numbered_words(texts)
    keys, word = letter_windows(words, ORDER)
    ratio, is_open = frequent.find(keys)
    value, size = (np.bincount(word, w, len(words)).astype(float) for w in (ratio, None))
    open_word = np.zeros(len(words), bool)
    open_word[word[is_open]] = True
    every = np.arange(len(texts) + 1)
    doc = np.repeat(every[:-1], np.diff(starts))
    pair, times = np.unique(doc * max(1, len(words)) + places, return_counts=True)
    doc, of = np.divmod(pair, max(1, len(words)))
    n_words, later = np.bincount(doc, minlength=len(texts)), open_word[of]

    known, settled = value[of[~later]], doc[~later]
    mass = np.bincount(settled, np.maximum(0, known - CLEAR), len(texts)).astype(float)
    known = known[np.lexsort((-known, settled))]
    rank = np.arange(len(settled)) - np.searchsorted(settled, every)[settled]
    ends = np.searchsorted(settled[rank < 3], every).astype(np.int32)
    top = pa.ListArray.from_arrays(ends, pa.array(known[rank < 3]))

    doc, of, times = doc[later], of[later], times[later]
    keys, word = keys[is_open], word[is_open]
    first, beyond = np.searchsorted(word, of), np.searchsorted(word, of, "right")
    ends = np.concatenate([[0], np.cumsum(beyond - first)])
    grams = keys[np.arange(ends[-1]) + np.repeat(first - ends[:-1], beyond - first)]
    grams = pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(grams))
    entries = pa.StructArray.from_arrays([pa.array(times), pa.array(value[of]), grams], ["n", "known", "grams"])
    left = pa.ListArray.from_arrays(np.searchsorted(doc, every).astype(np.int32), entries)
    sums = [pa.array(summed(v[places], starts)) for v in (value, size)]
    return [*sums, pa.array(n_words), top, pa.array(mass), left]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic curve by Newton steps: intercept first. The rarer class counts for more."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(x.shape[1])
    share = y.mean()
    weight = np.where(y > 0, ((1 - share) / share) ** 0.5, 1.0)
    penalty = ridge * np.diag([0.0] + [1.0] * (x.shape[1] - 1)) + 1e-6 * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(slope, x.T @ (weight * (y - p)) - penalty @ w)
        w = w + step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def score_of(curve: np.ndarray) -> Column:
    """The curve's value of the columns of :data:`FEATURES`."""
    x = F.lit(float(curve[0]))
    for name, weight in zip(FEATURES, curve[1:]):
        x = x + F.col(name) * float(weight)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), x))))


def learning_rows(docs: DataFrame, labels: DataFrame, held_out: int, folds: int) -> DataFrame:
    """Labelled documents outside the held-out fold: text, toxic, and whether they are the curve's."""
    known = (
        pick(labels, doc_id="bigint", toxic="int")
        .where((remainder(F.col("doc_id"), folds) != held_out) & F.col("toxic").isNotNull())
        .groupBy("doc_id")
        .agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    )
    known = stored(known, "toxicity_labels")
    n = known.count()
    few = n <= MOST_BROADCAST  # else the join shuffles
    texts = pick(docs, doc_id="bigint", text="string").where(remainder(F.col("doc_id"), folds) != held_out)
    part = F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / folds) % CALIBRATION_SHARE
    share = min(1.0, CALIBRATION_ROWS * CALIBRATION_SHARE / max(1.0, n))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(1_000_000)) < 1e6 * share
    rows = texts.join(F.broadcast(known) if few else known, "doc_id")
    return rows.select("doc_id", "text", "toxic", ((part == 0) & drawn).alias("for_curve"))


def count_windows(rows: DataFrame) -> DataFrame:
    """Letter windows of all rows with their number in ordinary and toxic texts: one row, with a list of windows, for
    the same ``SHORT`` letters before the last."""

    def run(batches):
        keys, counts, size = [], [], 0
        for batch in slices(batches, 1_500, 3 << 20):
            toxic = batch.column(1).to_numpy().astype(bool)
            words, places, starts = numbered_words(batch.column(0))
            is_toxic = np.repeat(toxic, np.diff(starts))
            times = np.stack([np.bincount(places[is_toxic == c], minlength=len(words)) for c in (False, True)], axis=1)
            key, word = letter_windows(words, ORDER)
            key, n = _sum_by(key, times[word])
            keys, counts, size = [*keys, key], [*counts, n], size + len(key)
            if size > 1_000_000:
                yield from out(keys, counts)
                keys, counts, size = [], [], 0
        yield from out(keys, counts)

    def out(keys, counts):
        if keys:
            key, n = _sum_by(np.concatenate(keys), np.concatenate(counts))
            n = n.astype(np.int64)
            yield pa.RecordBatch.from_pydict({"gram": pa.array(key), "n0": pa.array(n[:, 0]), "n1": pa.array(n[:, 1])})

    counted = rows.select("text", "toxic").mapInArrow(run, "gram bigint, n0 bigint, n1 bigint")
    before = F.shiftright("gram", LETTER_BITS).bitwiseAND(F.lit((1 << LETTER_BITS * SHORT) - 1))
    return (
        counted.withColumn("before", before)
        .repartition("before")  # the only exchange: both groupings begin with this column
        .groupBy("before", "gram")
        .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        .groupBy("before")
        .agg(F.collect_list(F.struct("gram", "n0", "n1")).alias("windows"))
    )


def smoothed(counts: DataFrame) -> Model:
    """The model of :func:`count_windows`, without a curve; empty unless both classes have windows."""
    shares = stored(counts.select("windows"), "toxicity_counts")

    def arrays(batches):
        for batch in batches:
            windows = batch.column(0).flatten()
            if len(windows):
                yield windows.field("gram").to_numpy(), np.stack([windows.field(c).to_numpy() for c in ("n0", "n1")], axis=1)

    def survey(batches):
        for gram, n in arrays(batches):
            what, key, times = map(pa.array, zip(*surveyed(gram, n)))
            yield pa.RecordBatch.from_arrays([what, key, times], ["what", "key", "times"])

    found = (
        shares.mapInArrow(survey, "what bigint, key bigint, times bigint")
        .groupBy("what", "key")
        .agg(F.sum("times").alias("times"))
        .orderBy("what", "key")
        .toArrow()
    )
    what, key, times = (found[c].to_numpy() for c in ("what", "key", "times"))
    if not len(what) or (times[what == ORDER + 3] == 0).any():
        return Model()
    short = smooth_short(key[what == 0], times[what == 0])
    taken = {n: discounts(times[what == n].tolist()) for n in range(SHORT + 1, ORDER + 3)}
    sc = counts.sparkSession.sparkContext
    shared = sc.broadcast((short, taken))

    def run(batches):
        for gram, n in arrays(batches):
            yield smooth(gram, n.astype(float), *shared.value)

    schema = "history bigint, n bigint, unseen float, letters array<tinyint>, ratios array<float>"
    windows = stored(shares.mapInArrow(run, schema), "toxicity_windows")
    steps = windows.groupBy(step()).agg(F.sum(F.size("letters"))).collect()
    size, least = 0, 1 << 30
    for place, many in sorted(steps, reverse=True):
        size += many
        if size > MOST_GRAMS or place < EIGHTHS * math.log2(LEAST_SEEN):
            break
        least = place
    chosen = windows.where(step() >= least).select("history", "unseen", "letters", "ratios")
    return Model(windows, sc.broadcast(Frequent(chosen.toArrow())), least)


def features_of(parts: DataFrame, words: Column) -> DataFrame:
    """Rows of :data:`PARTS` with the columns of :data:`FEATURES` in their place; ``words`` (n, all, later) are the open
    words with their log-likelihood ratio and its share that is not in ``total``."""
    ranked = F.sort_array(F.concat("top", F.transform(words, lambda w: w["all"])), asc=False)
    rest = [c for c in parts.columns if c not in ("total", "letters", "n_words", "top", "mass", "open", "later")]
    add = lambda value: F.aggregate(words, F.lit(0.0), lambda sum_, w: sum_ + value(w))
    total = F.col("total") + add(lambda w: w["n"] * w["later"])
    mass = F.col("mass") + add(lambda w: F.greatest(F.lit(0.0), w["all"] - CLEAR))
    rows = parts.select(*rest, "letters", "n_words", total.alias("total"), mass.alias("mass"), ranked.alias("ranked"))
    first = [F.coalesce(F.get("ranked", F.lit(k)), F.lit(0.0)) for k in range(3)]
    features = [
        F.col("total") / F.greatest(F.lit(1.0), "letters"),
        first[0],
        (first[0] + first[1] + first[2]) / 3,
        F.log1p("mass"),
        F.when(F.col("n_words") > 0, F.log(20.0 + F.col("n_words"))).otherwise(F.lit(0.0)),
    ]
    return rows.select(*rest, *(f.alias(name) for f, name in zip(features, FEATURES)))


def with_features(rows: DataFrame, model: Model) -> DataFrame:
    """Rows of a column and ``text``: that column, called ``of``, and the texts' features."""
    frequent, of = model.frequent, rows.columns[0]

    def run(batches):
        for batch in slices(batches, 1_500, 3 << 20):
            columns = [batch.column(0), *parts_of(frequent.value, batch.column(1))]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"of {rows.schema[of].dataType.simpleString()}, {PARTS}"
    names = ["of", "total", "letters", "n_words", "top", "mass", "open"]
    parts = rows.mapInArrow(run, schema)
    parts = stored(parts.withColumn("row", F.monotonically_increasing_id()), "toxicity_parts")
    last = F.col("gram").bitwiseAND(F.lit((1 << LETTER_BITS) - 1)).cast("tinyint")
    seen = F.get("ratios", (F.array_position("letters", last) - 1).cast("int"))
    later = (
        parts.select("row", F.posexplode("open").alias("word", "entry"))
        .select("row", "word", F.explode("entry.grams").alias("gram"))
        .join(model.windows.where(step() < model.least).drop("n"), F.shiftright("gram", LETTER_BITS) == F.col("history"), "left")
        .select("row", "word", F.coalesce(seen, "unseen", F.lit(0.0)).cast("double").alias("ratio"))
        .repartition("row")  # for both groupings and the join
        .groupBy("row", "word")
        .agg(F.sum("ratio").alias("ratio"))
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("word", "ratio"))).alias("later"))
    )
    kept = F.transform("open", lambda w: F.struct(w["n"].alias("n"), w["known"].alias("known"))).alias("open")
    parts = parts.select("row", *names[:-1], kept).join(later, "row", "left").drop("row")
    words = F.zip_with(
        "open",
        F.coalesce("later", F.array().cast("array<struct<word:int,ratio:double>>")),
        lambda w, x: F.struct(w["n"].alias("n"), (w["known"] + x["ratio"]).alias("all"), x["ratio"].alias("later")),
    )
    return features_of(parts, words)


def fit(docs: DataFrame, labels: DataFrame, held_out: int = 1, folds: int = 3) -> Model:
    """Count, smooth and calibrate; the curve's documents are not among the counted ones."""
    rows = learning_rows(docs, labels, held_out, folds)
    model = smoothed(count_windows(rows.where(~F.col("for_curve"))))
    if model.windows is None:
        return model
    table = with_features(rows.where("for_curve").select("toxic", "text"), model).toArrow()
    y = table["of"].to_numpy()
    if len(np.unique(y)) < 2:
        return replace(model, curve=np.array([-6.0, 0.0, 1.0, 0.0, 0.0, 0.0]))
    x = np.stack([table[f].to_numpy() for f in FEATURES], axis=1)
    return replace(model, curve=logistic(x, y))


def score(docs: DataFrame, model: Model, held_out: int = 1, folds: int = 3) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    rows = pick(docs, doc_id="bigint", text="string")
    if model.curve is None:
        scored = rows.select("doc_id", F.lit(0.0).alias("score"))
    else:
        scored = with_features(rows, model).select(F.col("of").alias("doc_id"), score_of(model.curve).alias("score"))
    out = F.coalesce(remainder(F.col("doc_id"), folds) == held_out, F.lit(False))
    predicted = (F.col("score") >= THRESHOLD).cast("int")
    return scored.select("doc_id", out.alias("held_out"), "score", predicted.alias("predicted"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not predicted toxic; columns and rows are otherwise as they were."""
    if model.curve is None:
        return docs

    def change(rows: DataFrame, places: dict[str, int]) -> DataFrame:
        # Equal texts score alike, so a text's digest is key enough; null and empty texts have the same features.
        text = F.coalesce(F.col(rows.columns[places["text"]]).cast("string"), F.lit(""))
        digest = F.unhex(F.md5(text.cast("binary"))).alias("digest")
        scored = with_features(rows.select(digest, text.alias("text")), model)
        toxic = scored.where(score_of(model.curve) >= THRESHOLD).select(F.col("of").alias("digest")).distinct()
        toxic = stored(toxic, "toxicity_rejected")
        few = toxic.count() <= MOST_BROADCAST  # else the join shuffles
        return rows.select("*", digest).join(F.broadcast(toxic) if few else toxic, "digest", "left_anti").select(*rows.columns)

    return by_position(docs, change)
