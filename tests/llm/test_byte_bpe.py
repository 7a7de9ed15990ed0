from __future__ import annotations

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from tests.llm.conftest import EDGES
from tests.llm.test_tokens import ODD, texts
from tidemart.llm import byte_bpe


@pytest.fixture(scope="module")
def library():
    ranks = byte_bpe.read_ranks(byte_bpe.DEFAULT)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digest_of(library, text):
    ids = library.encode_ordinary(text or "")
    raw = np.array(ids, "<u4").tobytes()
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest()


def test_digest_equals_the_library(spark, docs, library):
    rng = random.Random(13)
    rare = ["".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0x1F00, 0x3100), 0x1F600])) for _ in range(20)) for _ in range(300)]
    long = ["ab" * 5000, " " * 3000 + "x", "z" * 300, "é" * 200, "!" * 1000]
    rows = [*EDGES, *((100 + i, t) for i, t in enumerate([*texts(), *rare, *long, ODD * 20]))]
    got = byte_bpe.digest(docs(rows)).collect()
    want = sorted((str(i), *digest_of(library, t)) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want


def test_empty_table_has_an_empty_result(docs):
    assert byte_bpe.digest(docs([])).count() == 0


def test_ids_decode_to_the_text(spark, docs):
    pieces = byte_bpe.piece_literal(byte_bpe.read_ranks(byte_bpe.DEFAULT))
    rows = byte_bpe.encoded(docs([(1, ODD), (2, None)])).collect()
    ids = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rows}
    frame = spark.createDataFrame(list(ids.items()), "doc_id bigint, ids array<int>")
    decoded = {r[0]: bytes(r[1]) for r in frame.select("doc_id", byte_bpe.decoded(F.col("ids"), pieces)).collect()}
    assert decoded == {1: ODD.encode(), 2: b""} == {r.doc_id: bytes(r.decoded) for r in rows}


def test_words_are_those_of_the_pattern():
    names, offsets, numbers = byte_bpe.Words().numbered(pa.array(texts()))
    pattern, names = byte_bpe.word_pattern(), names.to_pylist()
    for k, text in enumerate(texts()):
        assert [names[n] for n in numbers[offsets[k] : offsets[k + 1]]] == pattern.findall(text)


def test_long_words_merge_fast_and_alike(library):
    ranks = byte_bpe.read_ranks(byte_bpe.DEFAULT)
    rng = random.Random(5)
    for _ in range(200):
        word = bytes(rng.choice(b"abcdeinrst") for _ in range(rng.randint(1, 60)))
        ids, text = byte_bpe._merge_long(word, ranks)
        assert np.frombuffer(bytes.fromhex(ids), "<u4").tolist() == library.encode_ordinary(word.decode())
    start = time.time()
    byte_bpe._merge_long(b"qwert" * 40_000, ranks)
    assert time.time() - start < 10
