from __future__ import annotations

import pyarrow as pa

from tidemart.llm import packing


def test_a_task_encodes_a_few_megabytes_at_once(spark, docs, monkeypatch):
    found, sizes = {}, []

    class Rows:
        def mapInArrow(self, run, schema):
            found["run"] = run

    class Encoder:
        def __init__(self, inner):
            self.inner = inner

        def encode(self, texts):
            sizes.append(texts.nbytes)
            return self.inner.encode(texts)

    real = packing.library_tokens
    monkeypatch.setattr(packing, "pick", lambda docs, **types: Rows())
    monkeypatch.setattr(packing, "library_tokens", lambda content: Encoder(real(content)))
    packing.pieces(docs([]))
    texts = [f"some words of text {i % 97} " * 100 for i in range(7000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7000)), pa.array(texts)], ["doc_id", "text"])
    rows = sum(out.num_rows for out in found["run"](iter([batch])))
    assert rows >= 7000 and sum(sizes) >= 12 << 20
    assert max(sizes) <= 3 << 20
