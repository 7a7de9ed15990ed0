from __future__ import annotations

import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, score string, _row string"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (id, text) or (id, text, lang), beside extra columns with names the operators use."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", len(r[1] or ""), "x", "y", "z") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


def prose(n: int, seed: int, syllables: str = "ba de fi go lu me na po ri su ta vi") -> str:
    rng = random.Random(seed)
    parts = syllables.split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


#: Texts at the edges: null, empty, blanks only, one word, odd letters, repeats, and a very long one.
EDGES = [
    (1, None),
    (2, ""),
    (3, " \t\n \r\n"),
    (4, "word"),
    (5, "ÄÖ ſ İ ﬁ ½ 漢字 가각   x <|endoftext|> it's"),
    (6, "same same same same same same same same"),
    (6, "same same same same same same same same"),
    (7, prose(40_000, 7)),
    (None, "no id here but a few words"),
]
