"""Token ids by the tokenizers library for Arrow batches of texts.

Texts are cut where the tokenizer's own pre-tokenizer cuts in any context, so that a piece's ids do not
depend on its neighbours. A batch is cut and its pieces numbered by Arrow; only distinct pieces reach
Python, where a bounded cache asks the library for new ones: its model for plain words, its full encoder for
others. Texts with runs of white space, rare white space or special tokens are encoded whole where the
pre-tokenizer attaches blanks to words.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Where a cut at single blanks and line ends could differ from the library's own.
_UNUSUAL = "[ \\t-\\r][ \\t-\\r]|^[ \\t-\\r]|[ \\t-\\r]$|[\\x00\\t\\v\\f\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|<\\|"
#: Letters that no normal form changes and that have one lower-case form.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Words whose ids may be asked of the model alone; of ASCII words also with one mark behind.
_PLAIN = f"^ ?(?:[A-Za-z]+[.,]?|[{LETTERS}]+)$"
#: The pre-tokenizers' patterns, written for ASCII: short forms, letters, digits, marks (fixed values).
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
_WORD_PARTS = re.compile(_SHORT + "|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+")
_BYTE_PARTS = re.compile(_SHORT + "| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+")
#: Distinct pieces that a task keeps, about 200 bytes each.
MOST_KNOWN = 500_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others for the characters from U+0100 on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


_BYTE = byte_alphabet()
_BLANK = _BYTE[ord(" ")]


def as_bytes(text: str) -> str:
    """The text in the byte alphabet."""
    if text.isascii() and text.isprintable() and " " not in text:
        return text
    return "".join([_BYTE[b] for b in text.encode()])


class LibraryTokens:
    """Encoder over a file with a byte-level pre-tokenizer, with or without word ends."""

    def __init__(self, content: str):
        self.library = Tokenizer.from_str(content)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(content)
        self.by_word = bool(spec["model"].get("end_of_word_suffix"))
        self.lower = "Lowercase" in json.dumps(spec["normalizer"])
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def ids_of(self, pieces: pa.Array) -> list[bytes]:
        """Ids of distinct pieces as little-endian bytes; new ones are asked for and kept."""
        names = pieces.to_pylist()
        out = list(map(self.known.get, names))
        new = [i for i, v in enumerate(out) if v is None]
        if not new:
            return out
        if len(self.known) + len(new) > MOST_KNOWN:
            self.known = {n: v for n, v in zip(names, out) if v is not None}
        known, tokenize, lower = self.known, self.library.model.tokenize, self.lower
        plain = pc.match_substring_regex(pieces.take(pa.array(new)), _PLAIN).to_pylist()
        for i, is_plain in zip(new, plain):
            name = names[i]
            if not is_plain:
                ids = self._parts(name) if name.isascii() and "<|" not in name else self._whole(name)
            elif not name.isascii():
                ids = array("I", [t.id for t in tokenize(as_bytes(name.lower() if lower else name))]).tobytes()
            else:
                word = name.lower() if lower else name.replace(" ", _BLANK)
                bare = word.rstrip(".,")
                ids = known.get(bare if lower else name[: len(bare)])
                if ids is None:
                    ids = array("I", [t.id for t in tokenize(bare)]).tobytes()
                    known[bare if lower else name[: len(bare)]] = ids
                if len(bare) < len(word):
                    ids += self._part(word[len(bare) :])
            out[i] = known[name] = ids
        return out

    def _parts(self, piece: str) -> bytes:
        """An ASCII piece, cut as the pre-tokenizer cuts ASCII."""
        cut = _WORD_PARTS if self.by_word else _BYTE_PARTS
        return b"".join([self._part(p) for p in cut.findall(piece.lower() if self.lower else piece)])

    def _part(self, part: str) -> bytes:
        ids = self.known.get(part)
        if ids is None:
            ids = array("I", [t.id for t in self.library.model.tokenize(as_bytes(part))]).tobytes()
            if len(part) < 20:
                self.known[part] = ids
        return ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (one more than texts) and ids; null texts count as empty."""
        texts = texts.fill_null("")
        if self.by_word:
            return encoded_lists(pc.ascii_split_whitespace(texts), self.ids_of)
        odd = pc.match_substring_regex(texts, _UNUSUAL).to_numpy(zero_copy_only=False)
        usual = texts if not odd.any() else pc.if_else(pa.array(odd), "", texts)
        offsets, ids = encoded_lists(blank_pieces(usual), self.ids_of)
        if not odd.any():
            return offsets, ids
        parts = np.split(ids, offsets[1:-1])
        for i in np.flatnonzero(odd):
            parts[i] = np.frombuffer(self._whole(texts[int(i)].as_py()), "<u4")
        return np.concatenate([[0], np.cumsum([len(p) for p in parts])]), np.concatenate(parts)


def blank_pieces(texts: pa.Array) -> pa.ListArray:
    """Cut before single blanks and around single line ends; pieces after a blank begin with it."""
    spaced = pc.replace_substring(pc.replace_substring(texts, " ", "\x00 "), "\n", "\x00\n\x00")
    return pc.split_pattern(spaced, "\x00")


def encoded_lists(pieces: pa.ListArray, ids_of: Callable[[pa.Array], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and ids of lists of pieces, by way of their distinct values."""
    numbered = pieces.flatten().dictionary_encode()
    codes = numbered.indices.to_numpy()
    values = ids_of(numbered.dictionary)
    n_ids = np.fromiter(map(len, values), np.int64, len(values)) // 4
    flat, first = np.frombuffer(b"".join(values), "<u4"), np.cumsum(n_ids) - n_ids
    ends = np.cumsum(n_ids[codes])
    total = int(ends[-1]) if len(ends) else 0
    ids = flat[np.repeat(first[codes] - (ends - n_ids[codes]), n_ids[codes]) + np.arange(total)]
    at = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
    return np.concatenate([[0], ends])[at], ids


@lru_cache(maxsize=4)
def library_tokens(content: str) -> LibraryTokens:
    return LibraryTokens(content)
