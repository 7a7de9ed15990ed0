"""Byte-level BPE over a rank file, folded by Spark's higher-order functions.

A task cuts its texts into batches and each batch into words, the matches of the pre-tokenizer's pattern. The
distinct words of a batch are merged in the JVM: a word is the list of its adjacent pairs (rank and byte places),
and a fold takes the pair of the smallest rank, the leftmost of equals, drops its boundary and looks up the ranks of
its two neighbours. Ranks come from a literal map, held as an array of small maps so that one lookup reads one of
them. Ids and decoded bytes of a document are put together from those of its words; decoding concatenates the ids'
binary pieces. Nothing is shuffled but a count of words.

So that a frequent word is not merged again in every batch, up to ``MOST_COMMON`` words that occur at least twice in
a sample of documents are merged once and broadcast. Which words these are changes no result. The fold copies
the list at each merge; words above ``LONGEST_FOLDED`` bytes are merged by a heap over the same ranks instead.

Defined results: a null text is encoded as the empty text, which has no ids. Strings of special tokens are ordinary
text. Texts of any length are encoded whole; repeated rows give repeated results, null ids stay null; extra columns
are ignored; an empty table gives an empty result. Ranks are distinct, so pairs tie only by equal bytes, and the
leftmost is merged first.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemart.llm.common import pick, remainder, slices
from tidemart.llm.library_tokens import _UNUSUAL, LETTERS, blank_pieces
from tidemart.llm.long_words import merge_by_heap

DEFAULT = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Bytes of a batch's texts, longer single texts excepted; rows of a batch.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 8192
#: Words that are merged before all others and broadcast (about 100 bytes each), and the share of documents that
#: they are looked for in: one of so many. Both only save work.
MOST_COMMON, SAMPLE = 500_000, 8
LONGEST_FOLDED = 128
_SPREAD = 1 << 13
_NONE = (1 << 31) - 1
#: White space as the library's pattern engine has it (fixed values).
_WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PLAIN, _MARKED = f"^ ?[{LETTERS}]+$", f"^ ?[{LETTERS}]+[.,;:!?)]$"
_WORD = "struct<ids string, bytes string>"


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of a base64 piece and its rank. A vocabulary has a fixed, small size."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f if line.strip())}


def word_pattern(pattern: str = public_tokenizers.PATTERN) -> regex.Pattern:
    """The pattern with its white space spelled out, as engines differ in rare control characters."""
    inside = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{_WHITE}\p{{L}}\p{{N}}]")
    return regex.compile(inside.replace(r"\s", f"[{_WHITE}]").replace(r"\S", f"[^{_WHITE}]"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The ranks as a literal: array<map<piece in hex, rank>>, a piece in the map that its crc32 names."""
    spread: list[dict[str, int]] = [{} for _ in range(_SPREAD)]
    for piece, rank in ranks.items():
        spread[zlib.crc32(piece) % _SPREAD][piece.hex().upper()] = rank
    return F.from_json(F.lit(json.dumps(spread, separators=(",", ":"))), "array<map<string,int>>")


def piece_literal(ranks: dict[bytes, int]) -> Column:
    """Per id its four little-endian bytes and its piece behind them, in hex: array<string>; gaps are null."""
    pieces: list[str | None] = [None] * (1 + max(ranks.values(), default=0))
    for piece, rank in ranks.items():
        pieces[rank] = (rank.to_bytes(4, "little") + piece).hex()
    return F.from_json(F.lit(json.dumps(pieces, separators=(",", ":"))), "array<string>")


def rank_of(piece: Column, ranks: Column) -> Column:
    """The piece's rank, or a number above all ranks."""
    one = F.get(ranks, F.crc32(piece).bitwiseAND(F.lit(_SPREAD - 1).cast("bigint")).cast("int"))
    return F.coalesce(one[F.hex(piece)], F.lit(_NONE))


def _pair(word: Column, ranks: Column, a: Column, m: Column, b: Column) -> Column:
    """The adjacent parts from a to m and from m to b in one number that sorts by rank, then by place."""
    rank = rank_of(F.substring(word, a + 1, b - a), ranks).cast("bigint")
    return F.shiftleft(rank, 24) + (a * 65536 + m * 256 + b)


def _merged(word: Column, ranks: Column) -> Column:
    """Ids of a word of 2 to 255 bytes that is no piece itself."""
    n = F.length(word)
    pairs = F.transform(F.sequence(F.lit(0), n - 2), lambda i: _pair(word, ranks, i, i + 1, i + 2))
    place = lambda x: x.bitwiseAND(F.lit(255).cast("bigint")).cast("int")
    start, middle, end = lambda p: place(F.shiftright(p, 16)), lambda p: place(F.shiftright(p, 8)), place

    def step(pairs: Column, _: Column) -> Column:
        def merge(best: Column, m: Column) -> Column:
            return F.transform(
                F.filter(pairs, lambda p: p != best),
                lambda p: F.when(end(p) == m, _pair(word, ranks, start(p), middle(p), end(best)))
                .when(start(p) == m, _pair(word, ranks, start(best), middle(p), end(p)))
                .otherwise(p),
            )

        return _let(
            F.array_min(pairs),
            lambda best: F.when(best < _NONE << 24, _let(middle(best), lambda m: merge(best, m))).otherwise(pairs),
        )

    cuts = F.transform(F.aggregate(F.sequence(F.lit(2), n), pairs, step), middle)
    return _let(
        F.concat(F.array(F.lit(0)), cuts, F.array(n)),
        lambda ends: F.transform(
            F.sequence(F.lit(1), F.size(ends) - 1),
            lambda i: rank_of(F.substring(word, F.get(ends, i - 1) + 1, F.get(ends, i) - F.get(ends, i - 1)), ranks),
        ),
    )


def word_ids(word: Column, ranks: Column) -> Column:
    """Ids (array<int>) of one word, a binary column; ``ranks`` is :func:`rank_literal`'s, best bound once."""
    none = F.array().cast("array<int>")
    return F.when(F.length(word) == 0, none).otherwise(
        _let(rank_of(word, ranks), lambda whole: F.when(whole != _NONE, F.array(whole)).otherwise(_merged(word, ranks)))
    )


def decoded(ids: Column, pieces: Column) -> Column:
    """The bytes of ids: their pieces, concatenated. ``pieces`` is :func:`piece_literal`'s."""
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.substring(F.get(pieces, i), 9, _NONE)), ""))


def _as_hex(ids: Column, pieces: Column) -> Column:
    """Ids as little-endian 32-bit integers and their decoded bytes, both in hex."""
    both = F.transform(ids, lambda i: F.get(pieces, i))
    return _let(
        both,
        lambda b: F.struct(
            F.array_join(F.transform(b, lambda p: F.substring(p, 1, 8)), "").alias("ids"),
            F.array_join(F.transform(b, lambda p: F.substring(p, 9, _NONE)), "").alias("bytes"),
        ),
    )


class Words:
    """Cuts batches of texts into words, numbered within the batch."""

    def __init__(self) -> None:
        self.pattern = word_pattern()

    def numbered(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The distinct words, and per text its words' numbers: offsets (one more than texts) and numbers.

        Arrow numbers the pieces between blanks and their words; only pieces that are neither one word nor a word
        with one mark behind it are cut in Python.
        """
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, _UNUSUAL).to_numpy(zero_copy_only=False)
        usual = texts if not odd.any() else pc.if_else(pa.array(odd), "", texts)
        lists = blank_pieces(usual)
        coded = lists.flatten().dictionary_encode()
        pieces, codes = coded.dictionary, coded.indices.to_numpy()
        plain, marked = (pc.match_substring_regex(pieces, p).to_numpy(zero_copy_only=False) for p in (_PLAIN, _MARKED))
        other = ~(plain | marked)
        with_mark = pieces.filter(pa.array(marked))
        cut = [self.pattern.findall(p) for p in pieces.filter(pa.array(other)).to_pylist()]
        whole = [self.pattern.findall(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        words = [
            pieces.filter(pa.array(plain)),
            pc.utf8_slice_codeunits(with_mark, 0, -1),
            pc.utf8_slice_codeunits(with_mark, -1),
            pa.array([w for own in cut for w in own], pa.string()),
            pa.array([w for own in whole for w in own], pa.string()),
        ]
        coded = pa.concat_arrays(words).dictionary_encode()
        single, stems, marks, parts, of_odd = np.split(coded.indices.to_numpy(), np.cumsum([len(w) for w in words])[:-1])
        # The words of the pieces, those of one piece side by side; how many they are, and where they begin.
        flat = np.concatenate([single, np.stack([stems, marks], axis=1).ravel(), parts])
        many, first = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        many[plain], many[marked], many[other] = 1, 2, [len(own) for own in cut]
        first[plain] = np.arange(len(single))
        first[marked] = len(single) + 2 * np.arange(len(stems))
        first[other] = len(single) + 2 * len(stems) + np.cumsum(many[other]) - many[other]
        ends = np.cumsum(many[codes])
        total = int(ends[-1]) if len(ends) else 0
        numbers = flat[np.repeat(first[codes] - (ends - many[codes]), many[codes]) + np.arange(total)]
        offsets = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        if odd.any():
            own = np.split(numbers, offsets[1:-1])
            for i, n in zip(np.flatnonzero(odd), np.split(of_odd, np.cumsum([len(w) for w in whole])[:-1])):
                own[i] = n
            offsets = np.concatenate([[0], np.cumsum([len(n) for n in own])])
            numbers = np.concatenate(own)
        return coded.dictionary, offsets, numbers


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> tuple[str, str]:
    """Ids and bytes in hex of a word that is too long to fold."""

    def join(a: bytes, b: bytes) -> tuple[int, bytes] | None:
        rank = ranks.get(a + b)
        return None if rank is None else (rank, a + b)

    parts = [word] if word in ranks else merge_by_heap([word[i : i + 1] for i in range(len(word))], join)
    return b"".join(ranks[p].to_bytes(4, "little") for p in parts).hex(), word.hex()


def common_words(docs: DataFrame, ranks: dict[bytes, int]) -> pa.Table:
    """Words that occur at least twice in a sample of documents, the most frequent first: word, ids, bytes (hex)."""
    sample = pick(docs, doc_id="bigint", text="string").where(F.coalesce(remainder(F.col("doc_id"), SAMPLE), F.lit(0)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in slices(batches, BATCH_ROWS, BATCH_BYTES):
            names, _, numbers = words.numbered(batch.column(1))
            counts = np.bincount(numbers, minlength=len(names))
            short = pc.less_equal(pc.binary_length(names), LONGEST_FOLDED)
            yield pa.RecordBatch.from_arrays([names.filter(short), pa.array(counts).filter(short)], ["word", "n"])

    counted = sample.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    often = counted.where("n > 1").orderBy(F.desc("n"), "word").limit(MOST_COMMON)
    tasks = 2 * docs.sparkSession.sparkContext.defaultParallelism
    return often.repartition(tasks, "word").select("word", _hex_of(F.col("word").cast("binary"), ranks).alias("h")).select(
        "word", "h.ids", "h.bytes"
    ).toArrow()


def _hex_of(word: Column, ranks: dict[bytes, int]) -> Column:
    return _let(
        rank_literal(ranks),
        lambda r: _let(piece_literal(ranks), lambda pieces: _as_hex(word_ids(word, r), pieces)),
    )


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def batched(docs: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """A row per batch of documents: ``docs`` (doc_id, numbers of its words) and ``words`` (ids and bytes in hex)."""
    sc = docs.sparkSession.sparkContext
    rank_bytes, common = sc.broadcast(ranks), sc.broadcast(_packed(common_words(docs, ranks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        known = pa.ipc.open_stream(common.value).read_all().combine_chunks()
        values = known["word"].combine_chunks() if known.num_rows else pa.array([], pa.string())
        hexes = [known[c].combine_chunks() if known.num_rows else pa.array([], pa.string()) for c in ("ids", "bytes")]
        for batch in slices(batches, BATCH_ROWS, BATCH_BYTES):
            names, offsets, numbers = words.numbered(batch.column(1))
            place = pc.index_in(names, value_set=values)
            at = pc.fill_null(place, -1).to_numpy()
            long = np.asarray(pc.greater(pc.binary_length(names), LONGEST_FOLDED), bool) & (at < 0)
            new = (at < 0) & ~long
            # Known words come first, then long ones, then those that are folded.
            order = np.concatenate([np.flatnonzero(at >= 0), np.flatnonzero(long), np.flatnonzero(new)])
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            merged = [_merge_long(w.encode(), rank_bytes.value) for w in names.filter(pa.array(long)).to_pylist()]
            found = pa.array(at[at >= 0])
            columns = [
                pa.concat_arrays([h.take(found), pa.array([m[k] for m in merged], pa.string())]) for k, h in enumerate(hexes)
            ]
            done = pa.StructArray.from_arrays(columns, ["ids", "bytes"])
            fresh = names.filter(pa.array(new)).cast(pa.binary())
            lists = pa.ListArray.from_arrays(offsets.astype(np.int32), rank[numbers])
            rows = pa.StructArray.from_arrays([batch.column(0), lists], ["doc_id", "words"])
            one = lambda a: pa.ListArray.from_arrays(np.array([0, len(a)], np.int32), a)
            yield pa.RecordBatch.from_arrays([one(rows), one(done), one(fresh)], ["docs", "done", "fresh"])

    return pick(docs, doc_id="bigint", text="string").mapInArrow(
        run, f"docs array<struct<doc_id bigint, words array<int>>>, done array<{_WORD}>, fresh array<binary>"
    )


def _assembled(docs: DataFrame, path: str, of: Callable[[Column, Callable[[str], Column]], Column]) -> DataFrame:
    """One row per document, made by ``of(document, joined)``; ``joined`` gives the hex of its ids or bytes."""
    ranks = read_ranks(path)

    def all_words(literal: Column, pieces: Column) -> Column:
        folded = F.transform("fresh", lambda w: _as_hex(word_ids(w, literal), pieces))
        return F.concat("done", folded)

    def rows(words: Column) -> Column:
        def one(doc: Column) -> Column:
            own = F.transform(doc["words"], lambda n: F.get(words, n))
            return _let(own, lambda found: of(doc, lambda name: F.array_join(found[name], "")))

        return F.transform("docs", one)

    folded = _let(rank_literal(ranks), lambda r: _let(piece_literal(ranks), lambda p: all_words(r, p)))
    return batched(docs, ranks).select(F.inline(_let(folded, rows)))


def encoded(docs: DataFrame, path: str = DEFAULT) -> DataFrame:
    """Per document: doc_id, ``ids`` (little-endian unsigned 32-bit integers) and ``decoded`` bytes."""
    return _assembled(
        docs,
        path,
        lambda doc, joined: F.struct(
            doc["doc_id"].alias("doc_id"),
            F.unhex(joined("ids")).alias("ids"),
            F.unhex(joined("bytes")).alias("decoded"),
        ),
    )


def digest(docs: DataFrame, path: str = DEFAULT) -> DataFrame:
    """Per document: number of ids, and hashes of the ids and of the decoded bytes."""
    return _assembled(
        docs,
        path,
        lambda doc, joined: _let(
            F.unhex(joined("ids")),
            lambda ids: F.struct(
                doc["doc_id"].alias("doc_id"),
                (F.length(ids) / 4).cast("bigint").alias("n_tokens"),
                F.sha2(ids, 256).alias("ids_sha256"),
                F.sha2(F.unhex(joined("bytes")), 256).alias("decoded_sha256"),
            ),
        ),
    )
