from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_near_duplicates import Forest, shingles
from tests.oracle_check import connect, difference
from tidemart.llm import quality, secret_scan
from tidemart.llm.oracle import STATEMENTS
from tidemart.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_query_equals_its_sql(spark, name):
    assert difference(QUERIES[name](spark, SF), connect(SF), STATEMENTS[name]) is None


def test_there_is_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == [*range(1, 14)]


def smallest_of_near_copies(docs) -> set[int]:
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    forest = Forest()
    for a, x in sets.items():
        forest.root(a)
        for b, y in sets.items():
            if b < a and x and 100 * len(x & y) >= 75 * len(x | y):
                forest.join(a, b)
    return {forest.root(a) for a in sets}


@pytest.mark.skip(reason="did not end within three minutes on the build machine; not yet understood")
def test_stages_follow_their_operators(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        seen.append((docs, out))
        if k < 4:
            assert out.columns == columns and out.dtypes == docs.dtypes
        docs = out
    ids = [({r.doc_id for r in a.collect()}, {r.doc_id for r in b.collect()}) for a, b in seen]
    assert ids[0][1] < ids[0][0]
    assert ids[1][1] == {r.doc_id for r in quality.verdicts(seen[1][0]).where("kept").collect()}
    assert ids[2][1] == smallest_of_near_copies(seen[2][0])
    assert ids[3][0] == ids[3][1] == ids[4][1]
    texts = {r.doc_id: r.text for r in seen[3][0].collect()}
    for r in seen[3][1].collect():
        assert r.text == secret_scan.redact(texts[r.doc_id]) and not secret_scan.base_spans(r.text)


def test_run_hands_each_stage_what_its_predecessor_kept(spark, monkeypatch):
    half = lambda spark, docs, sf_dir: docs.where("doc_id % 2 = 0").withColumn("doc_id", F.expr("doc_id DIV 2"))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", half), ("b", half), ("c", half)])
    n = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 8 = 0").count()
    assert corpus_pipeline.run(spark, SF).count() == n
