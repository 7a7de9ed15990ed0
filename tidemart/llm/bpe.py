"""BPE encoding and decoding with a contiguous rank array per word.

A word is a list of part ids and, beside it, the ranks of adjacent pairs. The smallest rank is searched
again and again; its boundary is deleted and the two neighbouring ranks are looked up anew. Words are short,
so the scan beats a heap; the rare word of more than ``LONGEST_SCANNED`` parts is merged by one. Texts are cut at white space, where the pre-tokenizer always cuts; Arrow numbers
the pieces of a batch, and only distinct ones are merged. Results are kept in bounded caches per task.

Normalising and pre-tokenizing of pieces beyond plain ASCII words are the library's, as are the file formats.

Defined results: a null text is encoded as the empty text. Strings of special tokens in a text become those
tokens. Texts of any length are encoded whole; repeated rows give repeated results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tidemart.llm.common import pick, slices, tokenizer_json
from tidemart.llm.library_tokens import LETTERS, as_bytes, encoded_lists
from tidemart.llm.long_words import merge_by_heap

DEFAULT = public_tokenizers.path("word_bpe_49k.json")
_ID_BITS = 24
_ID_MASK, _NONE = (1 << _ID_BITS) - 1, 1 << 60
#: ASCII words that need no normal form, perhaps with marks behind them.
_PLAIN = f"^[{LETTERS}]+[.,;:!?()\"-]*$"
_LETTERS = re.compile(f"[{LETTERS}]+")
#: Parts of a word up to which all ranks are scanned for each merge; above, a heap holds the pairs.
LONGEST_SCANNED = 200
#: Distinct pieces, and words, that a task keeps; about 250 bytes each.
MOST_KNOWN = 300_000


class WordBpe:
    """Encoder and decoder of a tokenizer file whose pieces between blanks are independent."""

    def __init__(self, content: str):
        spec = json.loads(content)
        self.library = Tokenizer.from_str(content)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special_at = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        #: (left id, right id) -> the pair's rank, with the id of the joined part in the low bits
        self.ranks = {
            (self.vocab[a], self.vocab[b]): rank << _ID_BITS | self.vocab[a + b] for rank, (a, b) in enumerate(merges)
        }
        self.words: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, bytes] = {}
        self.token_texts = pa.array([self.tokens.get(i, "") for i in range(max(self.tokens) + 1)], pa.string())

    def merge(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token, given in the byte alphabet and without the end-of-word mark."""
        vocab, rank_of = self.vocab, self.ranks.get
        symbols = [*word[:-1], word[-1] + self.suffix]
        parts = [vocab[s] for s in symbols if s in vocab]
        if len(parts) > LONGEST_SCANNED:
            return tuple(merge_by_heap(parts, self._join))
        ranks = [rank_of(pair, _NONE) for pair in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) != _NONE:
            at = ranks.index(best)
            parts[at : at + 2] = [best & _ID_MASK]
            del ranks[at]
            if at:
                ranks[at - 1] = rank_of((parts[at - 1], parts[at]), _NONE)
            if at < len(ranks):
                ranks[at] = rank_of((parts[at], parts[at + 1]), _NONE)
        return tuple(parts)

    def _join(self, a: int, b: int) -> tuple[int, int] | None:
        """Rank and id of a pair of ids, for words that are merged by a heap."""
        rank = self.ranks.get((a, b))
        return None if rank is None else (rank >> _ID_BITS, rank & _ID_MASK)

    def _word(self, word: str) -> tuple[int, ...]:
        ids = self.words.get(word)
        if ids is None:
            if len(self.words) >= MOST_KNOWN:
                self.words.clear()
            ids = self.words[word] = self.merge(word)
        return ids

    def _piece(self, piece: str, plain: bool) -> bytes:
        """Ids of a piece without blanks as little-endian bytes."""
        ids: list[int] = []
        if plain:
            end = _LETTERS.match(piece).end()
            ids += self._word(as_bytes(piece[:end].lower()))
            if end < len(piece):
                ids += self._word(piece[end:])
            return array("I", ids).tobytes()
        for text in self._special_at.split(piece) if self._special_at else [piece]:
            if text in self.special:
                ids.append(self.special[text])
            elif text:
                for word, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text)):
                    ids += self._word(word)
        return array("I", ids).tobytes()

    def ids_of(self, pieces: pa.Array) -> list[bytes]:
        """Ids of distinct pieces; what is known is not merged again."""
        names = pieces.to_pylist()
        out = list(map(self.pieces.get, names))
        new = [i for i, v in enumerate(out) if v is None]
        if new:
            if len(self.pieces) + len(new) > MOST_KNOWN:
                self.pieces = {n: v for n, v in zip(names, out) if v is not None}
            plain = pc.match_substring_regex(pieces.take(pa.array(new)), _PLAIN).to_pylist()
            for i, is_plain in zip(new, plain):
                out[i] = self.pieces[names[i]] = self._piece(names[i], is_plain)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (one more than texts) and ids; null texts count as empty."""
        return encoded_lists(pc.ascii_split_whitespace(texts.fill_null("")), self.ids_of)

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> pa.Array:
        """Per text the tokens of its ids, joined by blanks: what a file without a decoder asks for."""
        tokens = self.token_texts.take(pa.array(ids))
        return pc.binary_join(pa.LargeListArray.from_arrays(offsets, tokens), " ")


@lru_cache(maxsize=4)
def word_bpe(content: str) -> WordBpe:
    return WordBpe(content)


def encoded(docs: DataFrame, path: str = DEFAULT) -> DataFrame:
    """Per document: doc_id, ``ids`` (array of int) and ``decoded`` text."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(tokenizer_json(path))

    def run(batches):
        bpe = word_bpe(vocabulary.value)
        for batch in slices(batches):
            offsets, ids = bpe.encode(batch.column(1))
            lists = pa.ListArray.from_arrays(offsets.astype(np.int32), ids.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lists, bpe.decode(offsets, ids)], ["doc_id", "ids", "decoded"]
            )

    return pick(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")


def digest(docs: DataFrame, path: str = DEFAULT) -> DataFrame:
    """Per document: number of ids, and hashes of the ids and of the decoded text."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(tokenizer_json(path))

    def run(batches):
        bpe = word_bpe(vocabulary.value)
        for batch in slices(batches):
            offsets, ids = bpe.encode(batch.column(1))
            raw, ends = memoryview(ids.astype("<u4").tobytes()), (offsets * 4).tolist()
            decoded = bpe.decode(offsets, ids).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(offsets)),
                    pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(ends, ends[1:])], pa.string()),
                    pa.array([hashlib.sha256(text).hexdigest() for text in decoded], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return pick(docs, doc_id="bigint", text="string").mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
