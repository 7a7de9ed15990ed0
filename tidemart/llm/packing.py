"""Packing of documents into fixed-length sequences by patterns of few lengths.

1. Documents become ids with an end id; longer ones than a sequence are cut into whole sequences, behind a
   shorter first piece. 2. The histogram of lengths (at most one row per length of a sequence) goes to the
   driver. There all patterns of up to three lengths that fill a sequence exactly are enumerated, repeat
   counts are fitted to the histogram by non-negative least squares and rounded down, and what remains is
   packed largest-first, many equal sequences at a time. 3. Each piece gets its rank among the pieces of its
   length, and its length's plan turns the rank into a sequence and an offset.

Ranks are counted in buckets of (length, hash), so that a frequent length is spread over many tasks.

Defined results: a null text is the empty text and gives one piece with the end id alone. Null ids are packed
like others. Repeated rows give one piece each, every one in its own place. Texts are encoded whole; extra
columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemart.llm.common import pick, slices, stored, tokenizer_json
from tidemart.llm.library_tokens import library_tokens

DEFAULT = public_tokenizers.path("byte_bpe_50k.json")
END_ID, CAPACITY = 2, 1024
#: Pieces to a bucket in which ranks are counted, on average over the lengths of a bucket number.
BUCKET_PIECES = 20_000
#: Bytes of texts that a task encodes at once. It only bounds what a worker holds beside its cache of pieces.
SLICE_BYTES = 2 << 20
PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(
    docs: DataFrame, tokenizer: str = DEFAULT, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, its ``ids``."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(tokenizer_json(tokenizer))

    def run(batches):
        encoder = library_tokens(vocabulary.value)
        for batch in slices(batches, size=SLICE_BYTES):
            offsets, ids = encoder.encode(batch.column(1))
            ids = np.insert(ids.astype("<u4"), offsets[1:], end_id)
            offsets = offsets + np.arange(len(offsets))
            n_ids = np.diff(offsets)
            n_pieces = -(-n_ids // capacity)
            doc = np.repeat(np.arange(len(n_ids)), n_pieces)
            number = np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
            head = ((n_ids - 1) % capacity + 1)[doc]
            start = np.where(number == 0, 0, head + (number - 1) * capacity)
            length = np.where(number == 0, head, capacity)
            raw = memoryview(ids.tobytes())
            at = ((offsets[doc] + start) * 4).tolist()
            crc = [zlib.crc32(raw[a : a + 4 * n]) for a, n in zip(at, length.tolist())]
            columns = {
                "doc_id": batch.column(0).take(pa.array(doc)),
                "piece": pa.array(number.astype(np.int32)),
                "start": pa.array(start),
                "length": pa.array(length),
                "ids_crc32": pa.array(crc, pa.int64()),
            }
            if with_ids:  # pieces follow each other without gaps, in the order of the ids
                ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                columns["ids"] = pa.ListArray.from_arrays(ends, ids.astype(np.int32))
            yield pa.RecordBatch.from_pydict(columns)

    rows = pick(docs, doc_id="bigint", text="string")
    return rows.mapInArrow(run, PIECE + (", ids array<int>" if with_ids else ""))


def exact_patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All patterns of one to three of the lengths that sum up to the capacity; 0 stands for no document."""
    present = np.zeros(capacity + 1, bool)
    present[lengths] = True
    present[0] = True
    found = []
    for a in np.flatnonzero(present[: capacity // 3 + 1]):
        b = np.arange(a, (capacity - a) // 2 + 1)
        c = capacity - a - b
        ok = present[b] & present[c]
        found.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], axis=1))
    return np.concatenate(found)


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray, steps: int = 300) -> np.ndarray:
    """Non-negative least squares of pattern repeats to the histogram, by accelerated projected gradients."""
    used = patterns > 0
    share = histogram / max(1, histogram.sum())

    def packed(x):
        out = np.zeros(len(share))
        for k in range(3):
            out += np.bincount(patterns[:, k], x * used[:, k], len(share))
        return out

    def back(r):
        return sum(r[patterns[:, k]] * used[:, k] for k in range(3))

    v = np.ones(len(patterns))
    for _ in range(20):  # the largest eigenvalue bounds the step
        w = back(packed(v))
        norm = np.linalg.norm(w)
        v = w / max(norm, 1e-12)
    step = 1 / (1.05 * max(norm, 1e-12))
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * back(packed(y) - share))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x * max(1, histogram.sum())


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used; together they hold exactly the histogram.

    ``histogram[n]`` is the number of pieces of length n. The work depends on the capacity alone.
    """
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[tuple[int, ...], int]] = []
    if not left.any():
        return out
    patterns = exact_patterns(np.flatnonzero(left), capacity)
    if len(patterns):
        repeats = np.floor(fit_repeats(patterns, left) + 1e-6).astype(np.int64)
        for i in np.argsort(-repeats, kind="stable"):
            if not repeats[i]:
                break
            lengths = [int(n) for n in patterns[i][::-1] if n]
            need = np.bincount(lengths, minlength=len(left))
            times = int(min(repeats[i], (left[lengths] // need[lengths]).min()))
            if times:
                out.append((tuple(lengths), times))
                left -= times * need
    while left.any():  # the residual: fill a sequence largest-first, then as many alike as there are pieces
        lengths, room, rest = [], capacity, left.copy()
        while (fit := np.flatnonzero(rest[: room + 1])).size:
            n = int(fit[-1])
            k = int(min(rest[n], room // n))
            lengths += [n] * k
            rest[n] -= k
            room -= n * k
        need = np.bincount(lengths, minlength=len(left))
        times = int((left[need > 0] // need[need > 0]).min())
        out.append((tuple(lengths), times))
        left -= times * need
    return out


def slots(patterns: list[tuple[tuple[int, ...], int]], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), ordered: where the pieces of a length go by rank."""
    rows, rank, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for lengths, times in patterns:
        offset = 0
        for n in lengths:
            rows.append((n, rank[n], sequence, offset))
            rank[n] += times
            offset += n
        sequence += times
    table = np.array(rows, np.int64).reshape(-1, 4)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


def place(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces; ``found`` is read several times, so store it first."""
    spark = found.sparkSession
    counted = found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``capacity`` rows
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counted:
        histogram[row["length"]] = row["n"]
    table = spark.sparkContext.broadcast(slots(plan(histogram, capacity), capacity))
    buckets = 1 + int(histogram.sum()) // BUCKET_PIECES
    keyed = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sizes = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        keyed.withColumn("place", F.row_number().over(within))
        .join(before, ["length", "bucket"])
        .select(*found.columns, (F.col("before") + F.col("place") - 1).alias("rank"))
    )
    names = found.columns

    def run(batches):
        t = table.value
        span = np.int64(1) << 40
        keys = t[:, 0] * span + t[:, 1]
        for batch in batches:
            rank = batch.column(len(names)).to_numpy()
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            at = np.searchsorted(keys, length * span + rank, side="right") - 1
            sequence = t[at, 2] + rank - t[at, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(sequence), pa.array(t[at, 3])],
                [*names, "sequence_id", "offset"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    return ranked.mapInArrow(run, f"{schema}, sequence_id bigint, `offset` bigint")


def pack(docs: DataFrame, **options) -> DataFrame:
    """Per piece its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place(stored(pieces(docs, **options), "pieces"), options.get("capacity", CAPACITY))


def sequences(docs: DataFrame, **options) -> DataFrame:
    """The packed sequences: sequence_id, ``ids``, and the ``lengths`` of their pieces for attention masks."""
    placed = place(stored(pieces(docs, with_ids=True, **options), "pieces"), options.get("capacity", CAPACITY))
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # bounded by the capacity
    return (
        placed.groupBy("sequence_id")
        .agg(parts.alias("parts"))
        .select(
            "sequence_id",
            F.flatten("parts.ids").alias("ids"),
            F.transform("parts.ids", lambda p: F.size(p)).alias("lengths"),
        )
    )
