"""Near-duplicate documents: MinHash with tensored banding, candidates verified on full shingle sets.

A document's set is its distinct five-word shingles. Documents of equal sets are one node. Each node gets a few
groups of two small hash collections; a table key joins one entry of the one with one of the other, so that
``SIDE * SIDE`` tables of a group need only ``2 * SIDE`` entries, about the square root of the hashing.

Nodes that share a key are candidates. To find all links between components without all pairs:
1. of every key, the smallest and the largest node are its hubs, and each node is paired with at most three
of its hubs; 2. pairs whose sizes or sketches rule a link out go; the rest is verified on full sets; 3. linked
nodes form components, and only keys that still hold several components go on, with hubs of two of them; 4.
after some rounds, all pairs of nodes in different components that share a key are compared by longer sketches
of one bit a hash, and those that these leave possible are verified, each pair under the first key it shares. So a
group of thousands of near copies costs a few pairs a node, while every candidate pair either is compared or lies
within one component already.

At a similarity of 0.75 a pair shares no key with a probability below 1 in 10,000, and less for closer ones.

Defined results: null, empty and blank texts have no shingle, stand alone and are kept. Fewer words than
five make one shingle. Texts are read whole. Rows that share an id count as one document in the graph, and
each row is returned. Rows without an id take no part: component_id is null and they are kept. Extra columns
are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemart.llm.common import by_position, checkpointed, pick, slices, stored
from tidemart.llm.components import components

WORDS = 5
#: A link needs 100 * intersection >= SIMILARITY * union.
SIMILARITY = 75
#: Groups of tables; entries of each collection in a group; hashes in an entry of the two collections.
GROUPS, SIDE, LEFT, RIGHT = 9, 3, 3, 3
N_HASHES = GROUPS * SIDE * (LEFT + RIGHT)
N_TABLES = GROUPS * SIDE * SIDE
#: Equal hashes (by their low byte) that a pair needs to be verified: 4.7 deviations below a similarity of 0.75.
SKETCH_LEAST = int(N_HASHES * 0.75 - 4.7 * (N_HASHES * 0.75 * 0.25) ** 0.5)
#: Bits of the sketches that remaining candidates are compared by, 64 to a word.
N_BITS = 2048
#: Differing bits that a pair may have to be verified: 4.7 deviations above those of a similarity of 0.75. A bit
#: differs with half the probability that the hash does.
BITS_MOST = int(N_BITS * 0.125 + 4.7 * (N_BITS * 0.125 * 0.875) ** 0.5)
#: Rounds of stars before the remaining candidates are enumerated.
ROUNDS = 2
#: Ids up to which a set of them is broadcast (16 MB); beyond that, documents are shuffled to them.
MOST_BROADCAST = 1_000_000

_RNG = np.random.default_rng(20_240_601)
_MULTIPLIERS = _RNG.integers(1, 1 << 63, N_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = _RNG.integers(0, 1 << 63, N_HASHES, dtype=np.uint64)
_WORD_PLACES = _RNG.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BIT_MULTIPLIERS = _RNG.integers(1, 1 << 31, N_BITS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BIT_ADDENDS = _RNG.integers(0, 1 << 32, N_BITS, dtype=np.uint32)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of each text in ascending order, and each text's first place."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts.fill_null(""))))
    flat = lists.flatten()
    full = np.asarray(pc.not_equal(flat, ""))
    starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    starts = np.concatenate([[0], np.cumsum(full)])[starts].astype(np.int64)
    words = flat.filter(pa.array(full)).dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
    word = _mix(hashes)[words.indices.to_numpy()]
    n_words = np.diff(starts)
    n_shingles = np.where(n_words > 0, np.maximum(1, n_words - WORDS + 1), 0)
    doc = np.repeat(np.arange(len(n_words)), n_shingles)
    at = starts[doc] + np.arange(len(doc)) - (np.cumsum(n_shingles) - n_shingles)[doc]
    end = starts[doc + 1]
    value = np.zeros(len(doc), np.uint64)
    padded = np.concatenate([word, np.zeros(1, np.uint64)])
    for k in range(WORDS):  # places behind the end of a short text add nothing
        value += np.where(at + k < end, padded[np.minimum(at + k, len(word))] * _WORD_PLACES[k], np.uint64(0))
    value = _mix(value)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[first], value[first]
    return value, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(n_words)))])


def table_keys(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sets that are not empty: keys of all tables, and the low bytes of all hashes."""
    hashes = np.empty((N_HASHES, len(starts) - 1), np.uint64)
    for k in range(N_HASHES):
        hashes[k] = np.minimum.reduceat((values * _MULTIPLIERS[k] + _ADDENDS[k]) >> np.uint64(32), starts[:-1])
    keys, at = np.empty((N_TABLES, hashes.shape[1]), np.uint64), 0
    for g in range(GROUPS):
        sides = []
        for size in (LEFT, RIGHT):
            entries = []
            for _ in range(SIDE):
                entry = np.full(hashes.shape[1], at, np.uint64)
                for k in range(size):
                    entry = _mix(entry * np.uint64(31) + hashes[at + k])
                at += size
                entries.append(entry)
            sides.append(entries)
        for i, left in enumerate(sides[0]):
            for j, right in enumerate(sides[1]):
                keys[(g * SIDE + i) * SIDE + j] = _mix(left * np.uint64(3) + right)
    return keys.T.astype(np.int64), (hashes.T & np.uint64(255)).astype(np.uint8).view(np.int8)


def bit_sketches(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For sets that are not empty: one bit of each of N_BITS smallest hashes, packed to rows of 64-bit words."""
    short = (values >> np.uint64(32)).astype(np.uint32)
    bits = np.empty((N_BITS, len(starts) - 1), bool)
    for k in range(N_BITS):
        least = np.minimum.reduceat(short * _BIT_MULTIPLIERS[k] + _BIT_ADDENDS[k], starts[:-1])
        bits[k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(31)
    return np.ascontiguousarray(np.packbits(bits, axis=0).T).view(np.int64)


def sketched(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n (size of its set), set_key, table keys, sketch. Empty sets have null keys."""

    def run(batches):
        for batch in slices(batches, 2_000, 4 << 20):
            values, starts = shingle_sets(batch.column(1))
            n = np.diff(starts)
            some = np.flatnonzero(n > 0)
            raw, ends = memoryview(values.tobytes()), (starts * 8).tolist()
            set_key = [xxhash.xxh3_128_digest(raw[a:b]) if b > a else None for a, b in zip(ends, ends[1:])]
            keys, sketch = table_keys(values, np.append(starts[some], len(values))) if len(some) else ([], [])
            full = pa.array(n > 0)
            back = pa.array(np.where(n > 0, np.cumsum(n > 0) - 1, 0), mask=~(n > 0))

            def rows(matrix, kind, width, back=back, full=full):
                if not full.true_count:
                    return pa.nulls(len(full), pa.list_(kind))
                flat = pa.array(matrix.ravel(), kind)
                return pa.ListArray.from_arrays(np.arange(len(matrix) + 1, dtype=np.int32) * width, flat).take(back)

            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n),
                    pa.array(set_key, pa.binary()),
                    rows(keys, pa.int64(), N_TABLES),
                    rows(sketch, pa.int8(), N_HASHES),
                ],
                ["doc_id", "n", "set_key", "keys", "sketch"],
            )

    return pick(docs, doc_id="bigint", text="string").mapInArrow(
        run, "doc_id bigint, n bigint, set_key binary, keys array<bigint>, sketch array<tinyint>"
    )


def _side(nodes: DataFrame, c: str) -> DataFrame:
    return nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))


def _may_link() -> Column:
    """Whether sizes and sketches (na, nb, sa, sb) leave a link possible."""
    equal = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return (100 * F.least("na", "nb") >= SIMILARITY * F.greatest("na", "nb")) & (equal >= SKETCH_LEAST)


def plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that may be links."""
    both = pairs.join(_side(nodes, "a"), "a").join(_side(nodes, "b"), "b")
    return both.where(_may_link()).select("a", "b")


def _texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents whose ids are in ``ids`` (checkpointed, distinct)."""
    few = ids.count() <= MOST_BROADCAST  # else the join shuffles
    return pick(docs, doc_id="bigint", text="string").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def verified(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the plausible pairs (a, b) whose full sets are similar enough."""
    plausible = checkpointed(candidates.select("a", "b"))
    ids = checkpointed(plausible.select(F.col("a").alias("doc_id")).union(plausible.select("b")).distinct())

    def run(batches):
        for batch in slices(batches, 2_000, 4 << 20):
            values, starts = shingle_sets(batch.column(1))
            sets = pa.ListArray.from_arrays(starts.astype(np.int32), values.astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], ["doc_id", "set"])

    sets = _texts_of(ids, docs).mapInArrow(run, "doc_id bigint, set array<bigint>")
    both = F.size(F.array_intersect("xa", "xb")).cast("bigint")
    return (
        plausible.join(sets.toDF("a", "xa"), "a")
        .join(sets.toDF("b", "xb"), "b")
        .select("a", "b", (F.size("xa") + F.size("xb")).alias("n"), both.alias("both"))
        .where(100 * F.col("both") >= SIMILARITY * (F.col("n") - F.col("both")))
        .select("a", "b")
    )


def _with_bits(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """Per document of ``ids``: node, n (size of its set) and bits (its long sketch)."""

    def run(batches):
        for batch in slices(batches, 2_000, 4 << 20):
            values, starts = shingle_sets(batch.column(1))
            n = np.diff(starts)
            some = np.flatnonzero(n > 0)
            if len(some):
                words = bit_sketches(values, np.append(starts[some], len(values)))
                ends = np.arange(len(some) + 1, dtype=np.int32) * words.shape[1]
                lists = pa.ListArray.from_arrays(ends, pa.array(words.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(some)), pa.array(n[some]), lists], ["node", "n", "bits"]
                )

    return _texts_of(ids, docs).mapInArrow(run, "node bigint, n bigint, bits array<bigint>")


def across(mixed: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of different roots that share a key and that sizes and long sketches leave possible.

    ``mixed``: key, node, root. A pair shares many keys; it comes out under the smallest of them only.
    """
    ids = checkpointed(mixed.select(F.col("node").alias("doc_id")).distinct())
    keyed = mixed.groupBy("node").agg(F.first("root").alias("root"), F.collect_set("key").alias("keys"))
    rows = _with_bits(ids, docs).join(keyed, "node").select(F.explode("keys").alias("key"), "*")
    x, y = (rows.toDF(*[f"{c}_{side}" for c in rows.columns]) for side in "ab")
    differ = sum(F.bit_count(F.col("bits_a")[i].bitwiseXOR(F.col("bits_b")[i])) for i in range(N_BITS // 64))
    pair = (
        (F.col("key_a") == F.col("key_b"))
        & (F.col("root_a") < F.col("root_b"))
        & (100 * F.least("n_a", "n_b") >= SIMILARITY * F.greatest("n_a", "n_b"))
        & (differ <= BITS_MOST)
        & (F.array_min(F.array_intersect("keys_a", "keys_b")) == F.col("key_a"))
    )
    return x.join(y, pair).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def link(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Verified links (a, b) that connect what candidates can connect; ``nodes``: node, n, keys, sketch."""
    rows = nodes.select(F.explode("keys").alias("key"), "node")
    ends = rows.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    shared = stored(rows.join(ends, "key"), "keys")
    stars = shared.select("node", F.explode(F.array("lo", "hi")).alias("hub")).where("node <> hub")
    left, links = shared.select("key", "node"), None
    for _ in range(ROUNDS):
        found = checkpointed(verified(plausible(_best(stars), nodes), docs))
        links = found if links is None else checkpointed(links.union(found))
        # What is in one component by now needs no more comparing; keys with several components do.
        named = left.join(components(links), "node", "left").select(
            "key", "node", F.coalesce("root", "node").alias("root")
        )
        one = F.struct("root", "node")
        mixed = named.groupBy("key").agg(F.min(one).alias("lo"), F.max(one).alias("hi")).where("lo.root <> hi.root")
        kept = stored(named.join(mixed, "key"), "mixed-keys")
        left = kept.select("key", "node")
        stars = (
            kept.select("node", "root", F.explode(F.array("lo", "hi")).alias("hub"))
            .where("root <> hub.root")
            .select("node", "hub.node")
            .toDF("node", "hub")
        )
    return checkpointed(links.union(verified(across(kept.select("key", "node", "root"), docs), docs)))


def _best(stars: DataFrame) -> DataFrame:
    """Pairs (a, b) of each node with the hub it shares most keys with, and with its smallest and largest one."""
    counted = stars.groupBy("node", "hub").agg(F.count(F.lit(1)).alias("keys"))
    most = counted.groupBy("node").agg(
        F.max(F.struct("keys", "hub")).alias("most"), F.min("hub").alias("lo"), F.max("hub").alias("hi")
    )
    pairs = most.select("node", F.explode(F.array("most.hub", "lo", "hi")).alias("hub"))
    return pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def groups(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    table = stored(sketched(docs), "sketches")
    nodes = (
        table.where("n > 0 AND doc_id IS NOT NULL")
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in ("n", "keys", "sketch")])
    )
    members = nodes.select("set_key", "node")
    nodes = stored(nodes.drop("set_key"), "nodes")
    rows = table.select("doc_id", "n", "set_key").join(members, "set_key", "left")
    roots = components(link(nodes, docs))
    return (
        rows.join(roots, "node", "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "node", "doc_id")))
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            "component_id",
            F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
        )
    )


def kept(docs: DataFrame) -> DataFrame:
    """The documents without all but one of each group of near-duplicates; columns stay as they are.

    Of rows that share the smallest id of a group one stays, the first in the order of texts. Rows without an
    id all stay.
    """
    drop = checkpointed(groups(docs).where(~F.col("kept")).select("doc_id").distinct())
    few = drop.count() <= MOST_BROADCAST  # else the join shuffles

    def change(rows: DataFrame, at: dict[str, int]) -> DataFrame:
        key, text = f"c{at['doc_id']}", f"c{at['text']}"
        gone = drop.select(F.col("doc_id").alias("gone"))
        left = rows.join(F.broadcast(gone) if few else gone, rows[key] == F.col("gone"), "left_anti")
        twice = left.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(f"n > 1 AND {key} IS NOT NULL")
        twice = checkpointed(twice.select(F.col(key).alias("twice")))
        if twice.isEmpty():
            return left
        first = F.min_by(F.struct(*rows.columns), F.struct(F.col(text).isNull(), F.col(text)))
        one = left.join(twice, left[key] == F.col("twice"), "left_semi").groupBy(key).agg(first.alias("row"))
        return left.join(twice, left[key] == F.col("twice"), "left_anti").union(one.select("row.*"))

    return by_position(docs, change)
