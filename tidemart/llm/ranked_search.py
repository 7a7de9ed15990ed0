"""Ranked lexical search by range maxima over posting lists.

Documents are cut into terms once; per document the terms of the items at hand and their counts are stored. Weights
of terms follow from the counts of documents. A task then takes documents in shards of about ``SHARD_POSTINGS``
postings and builds a posting list for each term, in ascending order of documents, with the impact of each posting
and a sparse table over impacts: the place of the largest one in every range whose length is a power of two.

An item is answered by a best-first search over intervals of a shard's documents. An interval's bound is the sum of
its terms' range maxima, two table entries each. The intervals of the highest bounds are split at the document of
the largest single impact, which is scored exactly; intervals of at most ``LEAF`` documents are scored outright. It
ends when no bound reaches the tenth best score so far, that of earlier shards of the task included. The tasks'
ten best are ranked by a window. No posting and no text is shuffled.

Items are answered in blocks of a bounded number and length, which are broadcast; so are the weights of their terms.
All else is exact integer arithmetic on 64 bits.

Defined results: a null text has no terms. Texts of any length count whole. Rows of documents that share an id are
documents of their own; documents without an id count and come last among equal scores. Of items that share an id
the one of the smallest text counts; items without an id, without terms or without a matching document have no
result. Empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemart.llm.blocks import blocks
from tidemart.llm.common import pick, slices, stored

TOP = 10
#: The ranking function's numbers: share of a document's length in its damping (percent), scale, damping factor.
LENGTH_SHARE, SCALE, DAMPING = 75, 1_000_000_000, 8
#: Items of a block, and the bytes of their texts (but for a single longer one).
BLOCK_ITEMS, BLOCK_BYTES = 2_000, 2 << 20
#: Postings of a shard; documents of an interval that is scored outright; intervals split at once.
SHARD_POSTINGS, LEAF, FRONT = 1_500_000, 128, 48
_LAST = (1 << 63) - 1

#: Bytes to their lower-case form; bytes that are in no term to 0. Terms are letters, digits and all beyond ASCII.
_FORM = np.array([b if chr(b).isalnum() or b > 0x7F else 0 for b in range(256)], np.uint8)
_FORM[ord("A") : ord("Z") + 1] += 32
assert _FORM[0x80:].all()


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct terms of a batch, each occurrence's number among them, and its text."""
    texts = texts.fill_null("").cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and bounds[-1] > bounds[0] else np.empty(0, np.uint8)
    form, at = _FORM[raw], bounds - bounds[0]
    inside = form != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = at[:-1][at[:-1] < len(raw)]
    first[cut] = inside[cut]  # texts do not run into each other
    place = np.flatnonzero(first)
    length = np.diff(np.append(np.cumsum(inside)[place] - 1, inside.sum()))
    ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    flat = pa.LargeStringArray.from_buffers(len(place), pa.py_buffer(ends), pa.py_buffer(form[inside].tobytes()))
    numbered = flat.dictionary_encode()
    text = np.searchsorted(at[1:], place, side="right")
    return numbered.dictionary.cast(pa.string()), numbered.indices.to_numpy().astype(np.int64), text


def occurrences(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """Per document: doc_id, n (all its terms), and of the vocabulary's terms those in it, with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, width = shared.value, len(shared.value) + 1
        for batch in slices(batches, 8192, 8 << 20):
            names, number, text = terms_of(batch.column(1))
            term = pc.fill_null(pc.index_in(names, value_set=values), -1).to_numpy()[number] if len(number) else number
            n = np.bincount(text, minlength=batch.num_rows)
            keys, counts = np.unique((text * width + term)[term >= 0], return_counts=True)
            ends = np.searchsorted(keys, np.arange(batch.num_rows + 1) * width).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32))) for v in (keys % width, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *lists], ["doc_id", "n", "terms", "counts"])

    return pick(docs, doc_id="bigint", text="string").mapInArrow(
        run, "doc_id bigint, n bigint, terms array<int>, counts array<int>"
    )


class Shard:
    """Posting lists of some documents with sparse tables of range maxima."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, ends: np.ndarray, terms: np.ndarray, counts: np.ndarray, weights, mean):
        """``mean`` is (N, L): the documents with terms and all their terms."""
        order = np.argsort(ids, kind="stable")
        self.ids, self.size = ids[order], len(ids)
        place = np.empty(self.size, np.int64)
        place[order] = np.arange(self.size)
        doc = np.repeat(np.arange(self.size), np.diff(ends))
        damping = 100 - LENGTH_SHARE + LENGTH_SHARE * n * mean[0] // max(1, mean[1])
        impact = weights[terms] * (SCALE * counts // (1000 * counts + DAMPING * damping[doc]))
        some = impact > 0
        key = (terms * self.size + place[doc])[some]
        sort = np.argsort(key)
        #: Postings by term and document; a term's list is a range of them.
        self.key, self.impact = key[sort], impact[some][sort]
        longest = int(np.bincount(self.key // self.size).max()) if len(self.key) else 0
        best = np.arange(len(self.key), dtype=np.int32)
        self.tables = [best]
        for level in range(max(0, longest.bit_length() - 1)):
            step = 1 << level
            left, right = best[: len(best) - step], best[step:]
            best = np.where(self.impact[left] >= self.impact[right], left, right)
            self.tables.append(best)

    def largest(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of posting ranges [a, b): the largest impact (0 if empty) and its place."""
        value, place = np.zeros(a.shape, np.int64), np.zeros(a.shape, np.int64)
        width = b - a
        level = np.where(width > 0, np.frexp(np.maximum(width, 1))[1] - 1, -1)
        for k in np.unique(level[level >= 0]):
            at = level == k
            left, right = self.tables[k][a[at]], self.tables[k][b[at] - (1 << k)]
            place[at] = np.where(self.impact[left] >= self.impact[right], left, right)
            value[at] = self.impact[place[at]]
        return value, place

    def search(self, terms: np.ndarray, repeats: np.ndarray, best: list[tuple[int, int]], top: int) -> list[tuple[int, int]]:
        """The best (-score, id) of this shard and of ``best``, in order."""
        base = terms * self.size
        a, b = np.searchsorted(self.key, base)[None, :], np.searchsorted(self.key, base + self.size)[None, :]
        lo, hi = np.zeros(1, np.int64), np.full(1, self.size)
        bound = self.largest(a, b)[0] @ repeats
        while True:
            least, last = (-best[-1][0], best[-1][1]) if len(best) == top else (0, -1)
            open_ = (bound > least) | ((bound == least) & (bound > 0) & (self.ids[np.minimum(lo, self.size - 1)] < last))
            if not open_.all():
                lo, hi, a, b, bound = lo[open_], hi[open_], a[open_], b[open_], bound[open_]
            if not len(lo):
                return best
            front = np.argpartition(-bound, FRONT)[:FRONT] if len(bound) > FRONT else np.arange(len(bound))
            short = front[hi[front] - lo[front] <= LEAF]
            long = front[hi[front] - lo[front] > LEAF]
            found: list[tuple[np.ndarray, np.ndarray]] = []
            if len(short):
                width = (b[short] - a[short]).ravel()
                at = np.repeat(a[short].ravel() - (np.cumsum(width) - width), width) + np.arange(width.sum())
                doc = self.key[at] % self.size
                part = self.impact[at] * np.repeat(np.broadcast_to(repeats, a[short].shape).ravel(), width)
                docs, number = np.unique(doc, return_inverse=True)
                score = np.zeros(len(docs), np.int64)
                np.add.at(score, number, part)
                found.append((docs, score))
            pieces = []
            if len(long):
                value, place = self.largest(a[long], b[long])
                most = np.argmax(value * repeats, axis=1)
                split = self.key[place[np.arange(len(long)), most]] % self.size
                wanted = base[None, :] + split[:, None]
                at = np.searchsorted(self.key, wanted)
                hit = self.key[np.minimum(at, len(self.key) - 1)] == wanted
                score = np.where(hit, self.impact[np.minimum(at, len(self.key) - 1)], 0) @ repeats
                found.append((split, score))
                for start, end, x, y in ((lo[long], split, a[long], at), (split + 1, hi[long], at + hit, b[long])):
                    some = start < end
                    x, y = x[some], y[some]
                    pieces.append((start[some], end[some], x, y, self.largest(x, y)[0] @ repeats))
            for docs, score in found:
                some = score >= max(1, least)
                best += [(-int(s), int(self.ids[d])) for d, s in zip(docs[some], score[some])]
            best = sorted(best)[:top]
            rest = np.ones(len(lo), bool)
            rest[front] = False
            lo, hi, a, b, bound = (
                np.concatenate([old[rest], *(p[k] for p in pieces)]) for k, old in enumerate((lo, hi, a, b, bound))
            )


def _answer(found: DataFrame, items: list[tuple[int, np.ndarray, np.ndarray]], weights: np.ndarray, mean, top: int) -> DataFrame:
    """Per task and item the best documents: item_id, doc_id, score."""
    shared = found.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in items]
        held: list[pa.RecordBatch] = []

        def search() -> None:
            rows = pa.Table.from_batches(held).combine_chunks()
            lists = rows["terms"].combine_chunks(), rows["counts"].combine_chunks()
            ends = lists[0].offsets.to_numpy().astype(np.int64)
            terms, counts = (x.flatten().to_numpy().astype(np.int64) for x in lists)
            ids = pc.fill_null(rows["doc_id"], _LAST).to_numpy()
            shard = Shard(ids, rows["n"].to_numpy(), ends - ends[0], terms, counts, weights, mean)
            for i, (_, some, repeats) in enumerate(items):
                if len(shard.key):
                    best[i] = shard.search(some, repeats, best[i], top)

        postings = 0
        for batch in slices(batches, 8192, 8 << 20):
            held.append(batch)
            postings += len(batch.column(2).flatten())
            if postings >= SHARD_POSTINGS:
                search()
                held, postings = [], 0
        if held:
            search()
        rows = [(item[0], None if d == _LAST else d, -s) for item, found in zip(items, best) for s, d in found]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["item_id", "doc_id", "score"]
            )

    return found.mapInArrow(run, "item_id bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """Per item its ``top`` best documents: item_id, rank (from 1), doc_id, score."""
    one = pick(items, item_id="bigint", text="string").where("item_id IS NOT NULL").groupBy("item_id").agg(F.min("text").alias("text"))
    one = stored(one.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0))), "items")
    parts = []
    for block in blocks(one, "item_id", BLOCK_ITEMS, "size", BLOCK_BYTES):
        vocabulary, number, text = terms_of(block["text"].combine_chunks())
        found = stored(occurrences(docs, vocabulary), "occurrences")
        total = found.agg(F.sum((F.col("n") > 0).cast("bigint")), F.sum("n")).first()
        mean = (total[0] or 0, total[1] or 0)
        counted = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()
        weights = np.zeros(len(vocabulary), np.int64)
        for r in counted:
            weights[r["term"]] = math.floor(1000 * math.log((2 * mean[0] + 2) / (2 * r["df"] + 1)))
        ids = block["item_id"].to_pylist()
        by_item: list[Counter] = [Counter() for _ in ids]
        for i, t in zip(text.tolist(), number.tolist()):
            if weights[t] > 0:
                by_item[i][t] += 1
        wanted = [
            (ids[i], np.array(list(c), np.int64), np.array(list(c.values()), np.int64)) for i, c in enumerate(by_item) if c
        ]
        if wanted:
            parts.append(stored(_answer(found, wanted, weights, mean, top), "answers"))
    if not parts:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")
