from __future__ import annotations

import hashlib
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import EDGES, prose
from tidemart.llm import bpe, packing, token_orc
from tidemart.llm.common import tokenizer_json
from tidemart.llm.library_tokens import LibraryTokens
from tidemart.session import scratch_dir

ODD = "abcXYZ 's't're don't I'LL 123 é Σας ΣΑΣ İ ﬁ ½ ² \x00\x1c\x1f\x85\xa0 \t\r\n\x0b<|endoftext|> <|startoftext|>x 가각 漢 \U0001f600 ... ſ K ß w. W,"


def texts() -> list[str]:
    rng = random.Random(3)
    out = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    out += ["".join(rng.choice("ab C.\n,é' s") for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    return [*out, ODD, " " + ODD, "", "   ", "a" * 3000, prose(3000, 1)]


def raw(ids) -> bytes:
    return np.array(ids, "<u4").tobytes()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_library_tokens_equal_the_library(name):
    content = tokenizer_json(public_tokenizers.path(name))
    offsets, ids = LibraryTokens(content).encode(pa.array([None, *texts()], pa.string()).slice(1))
    for k, e in enumerate(Tokenizer.from_str(content).encode_batch(texts(), add_special_tokens=False)):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == e.ids, texts()[k]


def test_rank_array_bpe_equals_the_library_both_ways():
    library, own = Tokenizer.from_file(bpe.DEFAULT), bpe.WordBpe(tokenizer_json(bpe.DEFAULT))
    offsets, ids = own.encode(pa.array(texts()))
    decoded = own.decode(offsets, ids).to_pylist()
    for k, e in enumerate(library.encode_batch(texts(), add_special_tokens=False)):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == e.ids, texts()[k]
        assert decoded[k] == library.decode(e.ids, skip_special_tokens=False)


def test_bpe_digest_over_edges(docs):
    library = Tokenizer.from_file(bpe.DEFAULT)
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digest(docs(EDGES)).collect()}
    for i, text in EDGES:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False).encode()
        assert (i, len(ids), hashlib.sha256(raw(ids)).hexdigest(), hashlib.sha256(decoded).hexdigest()) in got
    assert bpe.digest(docs([])).count() == 0


def test_orc_files_hold_all_ids_in_order(spark, docs):
    library = Tokenizer.from_file(token_orc.DEFAULT)
    rows = [*EDGES, *[(i, prose(i % 50, i)) for i in range(200, 100, -1)]]
    path = scratch_dir(spark, "orc-test")
    token_orc.write(docs(rows), path)
    got = token_orc.digest(spark, path).orderBy("start").collect()
    ids = {}
    for i, text in rows:
        ids[i] = library.encode(text or "", add_special_tokens=False).ids + [token_orc.END_ID]
    start = 0
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids[r.doc_id]), zlib.crc32(raw(ids[r.doc_id])))
        start += r.n_tokens
    one = token_orc.read(spark, path).where(F.col("doc_id") == 150)
    assert one.first().ids == ids[150]
    assert "EqualTo(doc_id,150)" in one._jdf.queryExecution().toString()
    assert token_orc.round_trip(docs([])).count() == 0


def test_plan_holds_the_histogram_and_is_near_the_bound():
    rng = np.random.default_rng(0)
    lengths = np.minimum(1024, np.maximum(1, rng.lognormal(5.5, 1.2, 60_000).astype(int)))
    histogram = np.bincount(lengths, minlength=1025)
    plan, held = packing.plan(histogram), np.zeros(1025, int)
    for pattern, times in plan:
        assert sum(pattern) <= 1024
        for n in pattern:
            held[n] += times
    assert (held == histogram).all()
    assert sum(times for _, times in plan) <= 1.002 * -(-lengths.sum() // 1024)


@pytest.mark.parametrize("buckets", [3, packing.BUCKET_PIECES])
def test_packing_places_every_piece_once(docs, monkeypatch, buckets):
    monkeypatch.setattr(packing, "BUCKET_PIECES", buckets)
    library = Tokenizer.from_file(packing.DEFAULT)
    rows = [*EDGES, *[(i, prose(i % 90, i)) for i in range(100, 200)], (200, "a" * 9000)]
    got = packing.pack(docs(rows)).collect()
    places, pieces = {}, {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append(r)
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        head = (len(ids) - 1) % 1024 + 1
        cuts = [(0, head), *((a, 1024) for a in range(head, len(ids), 1024))]
        want = [(k, a, n, zlib.crc32(raw(ids[a : a + n]))) for k, (a, n) in enumerate(cuts)]
        times = sum(j == i for j, _ in rows)
        found = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in pieces[i])
        assert found == sorted(want * times)
    assert packing.pack(docs([])).count() == 0


def test_sequences_hold_the_ids(docs):
    library = Tokenizer.from_file(packing.DEFAULT)
    rows = [(i, prose(i % 40, i)) for i in range(60)]
    got = packing.sequences(docs(rows)).collect()
    want = sorted(tuple(library.encode(t, add_special_tokens=False).ids + [2]) for _, t in rows)
    found = []
    for r in got:
        at = 0
        for n in r.lengths:
            found.append(tuple(r.ids[at : at + n]))
            at += n
        assert at == len(r.ids) <= 1024
    assert sorted(found) == want


def test_long_words_merge_fast_and_alike():
    library, own = Tokenizer.from_file(bpe.DEFAULT), bpe.WordBpe(tokenizer_json(bpe.DEFAULT))
    rng = random.Random(8)
    words = ["a" * 4001, "abc" * 700, "".join(rng.choice("abcdeinrst") for _ in range(3000)), "é" * 900]
    offsets, ids = own.encode(pa.array(words))
    for k, e in enumerate(library.encode_batch(words, add_special_tokens=False)):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == e.ids
    start = time.time()
    own.encode(pa.array(["".join(rng.choice("abcdefghijk") for _ in range(1_000_000))]))
    assert time.time() - start < 20
