from __future__ import annotations

import pytest

from tidemart.search.bm25 import SearchIndex, search

DOCS = "doc_id string, title string, category string, content string"


@pytest.fixture
def docs(spark):
    return lambda *rows: spark.createDataFrame([(i, "t", "c", text) for i, text in rows], DOCS)


def found(index, query="refund"):
    return [(r.doc_id, r.score) for r in index.search(query, attributes={"category": "c"}).collect()]


def scanned(frame, query="refund"):
    return [(r.doc_id, r.score) for r in search(frame, query, attributes={"category": "c"}).collect()]


def test_a_crash_between_both_writes_loses_nothing(docs, spark, tmp_path, monkeypatch):
    index = SearchIndex(spark, str(tmp_path))
    first = docs(("a", "refund now"), ("b", "no refund refund"), ("c", "else"))
    index.refresh(first)
    before = found(index)
    for name in ("_commit", "_write"):
        with monkeypatch.context() as m:

            def crash(self, run, heads, postings=None, *_):
                if name == "_write":
                    heads.write.parquet(f"{self.path}/segments/{run}/docs")
                raise RuntimeError("crash")

            m.setattr(SearchIndex, name, crash)
            with pytest.raises(RuntimeError):
                index.refresh(docs(("a", "other text"), ("b", "refund")))
        assert found(index) == before == scanned(first)
    index.refresh(docs(("a", "other text"), ("b", "refund")))
    assert found(index) == scanned(docs(("a", "other text"), ("b", "refund"), ("c", "else")))


def test_merging_keeps_results_and_drops_old_rows(docs, spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path))
    index.compact()  # nothing is stored yet
    index.refresh(docs(("a", "refund now"), ("b", "no refund refund"), ("c", "else"), ("d", "refund")))
    index.refresh(docs(("b", "now refund")), deleted=docs(("d", "")).select("doc_id"))
    live = docs(("a", "refund now"), ("b", "now refund"), ("c", "else"))
    assert found(index) == scanned(live)
    index.compact()
    assert found(index) == scanned(live) and len(index.segments()) == 1
    (run,) = index.segments()
    assert spark.read.parquet(f"{tmp_path}/segments/{run}/docs").count() == 3
    assert spark.read.parquet(f"{tmp_path}/segments/{run}/postings").where("doc_id = 'b'").count() == 2
    assert index.next_version() == 2
    index.refresh(docs(("d", "refund again")))  # a deleted document may come back
    assert found(index) == scanned(live.union(docs(("d", "refund again"))))


def test_a_merge_leaves_what_arrived_meanwhile(docs, spark, tmp_path, monkeypatch):
    index = SearchIndex(spark, str(tmp_path))
    index.refresh(docs(("a", "refund")))
    index.refresh(docs(("b", "refund refund")))
    write = SearchIndex._write

    def slow(self, *args):
        write(self, *args)
        monkeypatch.setattr(SearchIndex, "_write", write)
        index.refresh(docs(("a", "late text"), ("c", "refund")))

    monkeypatch.setattr(SearchIndex, "_write", slow)
    index.compact()
    assert found(index) == scanned(docs(("a", "late text"), ("b", "refund refund"), ("c", "refund")))


def test_a_stated_version_is_replaced(docs, spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path))
    index.refresh(docs(("a", "refund"), ("b", "refund")), 4)
    index.refresh(docs(("a", "refund")), 4)
    assert [d for d, _ in found(index)] == ["a"] and index.next_version() == 5
