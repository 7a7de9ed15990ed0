"""Words of Arrow text batches, numbered, and the byte n-grams within them, as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def numbered_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-cased runs of letters, the word number at each place, and each text's first place.

    Null texts have no words. The third array has one more entry than there are texts.
    """
    letters = pc.replace_substring_regex(pc.utf8_lower(texts.fill_null("")), r"[^\p{L}]+", " ")
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(letters))
    flat = lists.flatten()
    starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    full = np.asarray(pc.not_equal(flat, ""))  # an empty text is split into one empty word
    numbered = flat.filter(pa.array(full)).dictionary_encode()
    return numbered.dictionary, numbered.indices.to_numpy(), np.concatenate([[0], np.cumsum(full)])[starts]


def windows(words: pa.Array, n: int, before: str = " ", after: str = " ") -> tuple[np.ndarray, np.ndarray]:
    """Keys of all n-byte windows of the padded words, and the word that each is from; n is 7 at most.

    Keys are the bytes as one number, so that equal keys are equal windows.
    """
    padded = pc.binary_join_element_wise(before, words, after, "").cast(pa.large_binary())
    if not len(padded):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, offsets, data = padded.buffers()
    ends = np.frombuffer(offsets, np.int64)[padded.offset : padded.offset + len(padded) + 1]
    raw = np.frombuffer(data, np.uint8)
    many = np.maximum(0, np.diff(ends) - n + 1)
    word = np.repeat(np.arange(len(many)), many)
    at = np.arange(len(word)) + np.repeat(ends[:-1] - (np.cumsum(many) - many), many)
    keys = np.zeros(len(word), np.int64)
    for k in range(n):
        keys = (keys << 8) | raw[at + k]
    return keys, word


#: Bits of a letter in letter windows.
LETTER_BITS = 6


def letter_windows(words: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n letters (10 at most) that end at each letter of a word and at its end.

    A key holds six bits a letter: 0 for a blank before or behind the word, 1 to 26 for a to z, and one of
    the other 36 values for any other letter, so that rare letters may share a value.
    """
    lengths = pc.utf8_length(words).to_numpy().astype(np.int64)
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    latin = (points >= 97) & (points <= 122)
    codes = np.where(latin, points - 96, 27 + points % 36)
    # Each word stands behind n - 1 blanks; the next word's first blank is its end.
    pad = n - 1
    starts = pad + np.concatenate([[0], np.cumsum(lengths + pad)])
    row = np.zeros(starts[-1] + 1, np.int64)
    word = np.repeat(np.arange(len(lengths)), lengths)
    row[starts[word] + np.arange(len(word)) - (np.cumsum(lengths) - lengths)[word]] = codes
    many = lengths + 1
    owner = np.repeat(np.arange(len(many)), many)
    end = starts[owner] + np.arange(len(owner)) - (np.cumsum(many) - many)[owner]
    keys = np.zeros(len(owner), np.int64)
    for k in range(pad, -1, -1):
        keys = (keys << LETTER_BITS) | row[end - k]
    return keys, owner


def summed(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the rows between consecutive starts; empty stretches give 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[starts[1:]] - total[starts[:-1]]
