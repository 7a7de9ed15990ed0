from __future__ import annotations

import pyarrow as pa

from tidemart.llm import byte_bpe


class Counting:
    def __init__(self, pattern):
        self.pattern, self.cut = pattern, []

    def findall(self, text):
        self.cut.append(text)
        return self.pattern.findall(text)


def test_words_with_one_mark_are_cut_by_arrow():
    words = byte_bpe.Words()
    words.pattern = Counting(words.pattern)
    texts = ["Plain words, with marks. Again, words! ", "über (alles) it's x2", None, "", "two  blanks, here.", "ends, so."]
    names, offsets, numbers = words.numbered(pa.array(texts))
    names = names.to_pylist()
    assert len(set(names)) == len(names)
    for k, text in enumerate(texts):
        own = [names[n] for n in numbers[offsets[k] : offsets[k + 1]]]
        assert own == words.pattern.pattern.findall(text or "")
    assert not any(p in words.pattern.cut for p in (" words,", " marks.", "Again,", " words!", "ends,", " so."))
