"""Hard negatives by a secondary sort of packed pair scores.

Anchors are a stated query set: they are taken in blocks of a bounded number, each block is broadcast and meets all
rows once for its positives and once for its negatives. A task multiplies its rows with the block's anchors in tiles
and keeps what can still count: of each anchor its best rows of the same label, later of each positive its best rows
within the window. Those pairs are packed into (anchor, descending score, kind, id) keys of bytes that sort as the
numbers do, partitioned by anchor and sorted within the partitions by ``repartitionAndSortWithinPartitions``. An
iterator then streams over them: a positive opens a window at its score, later pairs of other labels fall into the
open windows, a window closes when it is full or its floor is passed. At most ``positives`` windows are held; the
pairs of an anchor never are.

An anchor sends at most positives + positives * negatives pairs a task, so none is hot, and nothing is dropped that
could be in a result: the first ones of all rows are among the first ones of their tasks.

Scores are exact integers: in double precision where the sums fit into 53 bits, else in Python's integers, held to
the range of 64 bits.

Defined results: rows with a null id or label, a null vector, or any null or non-finite component take no part.
Vectors of different length do not meet. Equal scores are ordered by id, a positive before negatives. Repeated rows
(same id, label and score) count once; of anchors that share an id the one of the smallest label and vector counts.
Anchors without positives have no result. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from struct import Struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.rdd import portable_hash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemart.llm.blocks import blocks
from tidemart.llm.common import pick, slices, stored
from tidemart.llm.subspace import matrix
from tidemart.session import python_tasks

#: Each component x counts as floor(SCALE * x).
SCALE = 256
POSITIVES, NEGATIVES = 5, 5
#: A negative's score lies between these shares (percent) of the positive's.
LEAST, MOST = 80, 100
#: Anchors of a block; rows and anchors of a tile.
BLOCK, ROWS, TILE = 8_192, 4_096, 512

_KEY = Struct(">QQBQ")
_SIGN, _END = 1 << 63, (1 << 63) - 1
_NONE = np.iinfo(np.int64).min


def pack(anchor: int, score: int, negative: bool, other: int) -> bytes:
    """A key whose bytes sort by anchor, descending score, positives first, id."""
    return _KEY.pack(anchor + _SIGN, _SIGN - 1 - score, negative, other + _SIGN)


def unpack(key: bytes) -> tuple[int, int, bool, int]:
    anchor, score, negative, other = _KEY.unpack(key)
    return anchor - _SIGN, _SIGN - 1 - score, bool(negative), other - _SIGN


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), held to 64 bits."""
    return np.clip(np.floor(SCALE * vectors), -(2.0**62), 2.0**62)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered rows."""
    largest = [float(np.abs(x).max(initial=0.0)) for x in (a, b)]
    if largest[0] * largest[1] * max(1, a.shape[1]) < 2.0**53:
        return (a @ b.T).astype(np.int64)
    x, y = (np.array([[int(v) for v in row] for row in m], object).reshape(m.shape) for m in (a, b))
    return np.clip(x @ y.T, -_END, _END).astype(np.int64)


def first(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of ``scores`` the first ``k`` allowed ones, by descending score, then id: (row, score, id)."""
    masked = np.where(allowed, scores, _NONE)
    if masked.shape[1] > k:  # what is above the k-th best score or ties with it
        edge = np.partition(masked, masked.shape[1] - k, axis=1)[:, masked.shape[1] - k, None]
        allowed = allowed & (masked >= edge)
    row, column = np.nonzero(allowed)
    score, other = scores[row, column], ids[column]
    order = np.lexsort((other, -score, row))
    row, score, other = row[order], score[order], other[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (score[1:] != score[:-1]) | (other[1:] != other[:-1])
    row, score, other = row[fresh], score[fresh], other[fresh]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], score[place < k], other[place < k]


class Best:
    """The first ``k`` (score, id) of each of ``n`` rows, over all tiles of a task."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.other = np.full((n, k), _NONE), np.zeros((n, k), np.int64)

    def edge(self) -> np.ndarray:
        """Scores below these cannot come in any more."""
        return self.score[:, -1]

    def add(self, row: np.ndarray, score: np.ndarray, other: np.ndarray) -> None:
        rows = np.unique(row)
        at = np.searchsorted(rows, row)
        kept = self.score[rows] > _NONE
        old_row, old_place = np.nonzero(kept)
        row = np.concatenate([at, old_row])
        score = np.concatenate([score, self.score[rows][old_row, old_place]])
        other = np.concatenate([other, self.other[rows][old_row, old_place]])
        order = np.lexsort((other, -score, row))
        row, score, other = row[order], score[order], other[order]
        fresh = np.ones(len(row), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (score[1:] != score[:-1]) | (other[1:] != other[:-1])
        row, score, other = row[fresh], score[fresh], other[fresh]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        some = place < self.k
        self.score[rows] = _NONE
        self.score[rows[row[some]], place[some]] = score[some]
        self.other[rows[row[some]], place[some]] = other[some]


def usable(vectors: DataFrame, is_anchor: Column) -> DataFrame:
    """The rows that take part: id, label, vector, anchor."""
    sound = F.coalesce(F.forall("embedding", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False))), F.lit(False))
    rows = pick(vectors, vec_id="bigint", label="bigint", embedding="array<double>").withColumn("anchor", is_anchor)
    return rows.where(sound & F.col("vec_id").isNotNull() & F.col("label").isNotNull())


def _scored(rows: DataFrame, block, windows: np.ndarray | None, k: int) -> DataFrame:
    """Packed keys of the pairs of a block's anchors with rows that may count.

    Without ``windows``: rows of the same label. With ``windows`` (anchors, positives, least and largest score): rows
    of other labels in one of them.
    """
    shared = rows.sparkSession.sparkContext.broadcast((*block, windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, anchor_label, anchor_vector, anchor_size, windows = shared.value
        lists = 1 if windows is None else windows.shape[1]
        best = [Best(len(anchor), k) for _ in range(lists)]
        for batch in slices(batches, ROWS):
            ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            size = pc.list_value_length(batch.column(2)).to_numpy()
            width = max(anchor_vector.shape[1], int(size.max()))
            vectors = whole(matrix(batch.column(2), width)[0])
            for a in range(0, len(anchor), TILE):
                tile = slice(a, a + TILE)
                x = np.pad(anchor_vector[tile], ((0, 0), (0, width - anchor_vector.shape[1])))
                scores = products(x, vectors)
                meets = anchor_size[tile, None] == size
                same = anchor_label[tile, None] == labels
                for w in range(lists):
                    if windows is None:
                        allowed = meets & same & (anchor[tile, None] != ids)
                    else:
                        low, high = windows[tile, w, 0, None], windows[tile, w, 1, None]
                        allowed = meets & ~same & (scores >= low) & (scores <= high)
                    allowed &= scores >= best[w].edge()[tile, None]
                    if allowed.any():
                        row, score, other = first(scores, allowed, ids, k)
                        best[w].add(row + a, score, other)
        keys = set()
        for found in best:
            row, place = np.nonzero(found.score > _NONE)
            values = zip(anchor[row].tolist(), found.score[row, place].tolist(), found.other[row, place].tolist())
            keys.update(pack(i, s, windows is not None, o) for i, s, o in values)
        out = sorted(keys)
        for at in range(0, len(out), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(out[at : at + 50_000], pa.binary())], ["key"])

    return rows.select("vec_id", "label", "embedding").mapInArrow(run, "key binary")


def _by_anchor(key: bytes) -> int:
    return portable_hash(bytes(key[:8]))


def sorted_keys(keys: DataFrame) -> "RDD":  # noqa: F821
    """The keys, an anchor's in one partition and in order."""
    pairs = keys.rdd.map(lambda r: (bytes(r[0]), None))
    n = python_tasks(keys)
    return pairs.repartitionAndSortWithinPartitions(n, _by_anchor).keys()


def first_of_each(keys: Iterable[bytes], k: int) -> Iterator[tuple[int, int, int]]:
    """The first ``k`` distinct (anchor, id, score) of each anchor of sorted keys."""
    last, current, n = None, None, 0
    for key in keys:
        if key == last:
            continue
        last = key
        anchor, score, _, other = unpack(key)
        if anchor != current:
            current, n = anchor, 0
        if n < k:
            n += 1
            yield anchor, other, score


def in_windows(keys: Iterable[bytes], k: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Over sorted keys: positives open windows, the first ``k`` negatives in each are emitted."""
    last, current, windows = None, None, []
    for key in keys:
        if key == last:
            continue
        last = key
        anchor, score, negative, other = unpack(key)
        if anchor != current:
            current, windows = anchor, []
        if not negative:
            windows.append([other, score, 0])
            continue
        windows = [w for w in windows if w[2] < k and LEAST * w[1] <= 100 * score]
        for w in windows:
            if 100 * score <= MOST * w[1]:
                w[2] += 1
                yield anchor, w[0], w[2], other, w[1], score


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, block_size: int = BLOCK
) -> DataFrame:
    """Per anchor and positive its first negatives: anchor_id, positive_id, rank, negative_id and both scores."""
    spark = vectors.sparkSession
    rows = usable(vectors, is_anchor)
    one = rows.where("anchor").groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("r"))
    anchors = stored(one.select("vec_id", "r.label", "r.embedding"), "anchors")
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    mined = spark.createDataFrame([], schema)
    for table in blocks(anchors, "vec_id", block_size):
        lists = table["embedding"].combine_chunks()
        size = pc.list_value_length(lists).to_numpy()
        ids = table["vec_id"].to_numpy()
        block = ids, table["label"].to_numpy(), whole(matrix(lists, int(size.max()))[0]), size
        near = sorted_keys(_scored(rows, block, None, positives)).mapPartitions(lambda keys: first_of_each(keys, positives))
        found = near.collect()  # at most ``positives`` an anchor of the block
        windows, filled = np.zeros((len(ids), positives, 2), np.int64), np.zeros(len(ids), int)
        windows[:, :, 0] = 1  # empty: no score is at least 1 and at most 0
        place = {v: i for i, v in enumerate(ids.tolist())}
        for anchor, _, score in found:
            i = place[anchor]
            if score >= 0:  # below 0 the window is empty
                windows[i, filled[i]] = -(-score * LEAST // 100), score * MOST // 100
                filled[i] += 1
        opened = spark.createDataFrame([(bytearray(pack(a, s, False, o)),) for a, o, s in found], "key binary")
        pairs = _scored(rows, block, windows, negatives).union(opened)
        mined_here = sorted_keys(pairs).mapPartitions(lambda keys: in_windows(keys, negatives))
        mined = mined.union(stored(mined_here.toDF(schema), "negatives"))
    return mined


def relabelled(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding, the labels of ids divisible by 7 moved on by one."""
    rows = pick(vectors, vec_id="bigint", label="bigint", embedding="array<double>")
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def every_hundredth() -> Column:
    return F.col("vec_id") % 100 == 0
