from __future__ import annotations

import pytest

from tidemart.sources import documents

HEADER = '---\ntitle: "T"\ncategory: c\nupdated_at: 2024-05-06\n---\n'


def written(spark, folder, rows, tasks=1):
    files = spark.createDataFrame([(i, t if t is None else HEADER + t) for i, t in rows], "doc_id string, value string")
    documents.write_documents(files.coalesce(1).repartition(tasks, "doc_id"), folder)
    return sorted((str(r.doc_id), r.title, r.content) for r in documents.load_documents(spark, folder, "*.txt").collect())


def test_documents_share_a_folder_a_task(tmp_path, spark):
    """A folder an id, as before, takes longer to make, move and list than all texts to write and read."""
    rows = [(f"doc-{i}", f"text {i}") for i in range(300)]
    assert written(spark, str(tmp_path / "d"), rows, 3) == sorted((i, "T", t) for i, t in rows)
    files = [f for f in (tmp_path / "d").rglob("doc-*.txt")]
    assert sorted(f.stem for f in files) == sorted(i for i, _ in rows)
    assert len({f.parent for f in files}) <= 3


def test_any_id_and_text_comes_back(tmp_path, spark):
    rows = [("a/b", "x"), ("a%2Fb", " é --- ü\n\n"), (".e", "---"), ("1.5", "1"), ("..", ""), ("用 = 户", "x" * 100_000)]
    found = written(spark, str(tmp_path / "d"), [*rows, (None, "n"), ("empty", None)], 2)
    assert found == sorted([*((i, "T", t.strip()) for i, t in rows), ("None", "T", "n"), ("empty", None, None)], key=str)


def test_rows_of_an_id_in_one_task_share_a_file(tmp_path, spark):
    assert written(spark, str(tmp_path / "d"), [("a", "one"), ("b", "two"), ("a", "one")]) == [("a", "T", f"one\n{HEADER}one"), ("b", "T", "two")]


def test_no_documents(tmp_path, spark):
    assert written(spark, str(tmp_path / "d"), []) == []


def test_only_files_of_the_manifest_and_pattern_are_loaded(tmp_path, spark):
    folder = tmp_path / "d"
    assert len(written(spark, str(folder), [("a", "x"), ("b", "y")])) == 2
    (folder / "failed-attempt").mkdir()
    (folder / "failed-attempt" / "c.txt").write_text(HEADER + "z")
    load = lambda pattern: sorted(r.doc_id for r in documents.load_documents(spark, str(folder), pattern).collect())
    assert (load("*.txt"), load("{a,c}.txt"), load("*.md")) == (["a", "b"], ["a"], [])
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        written(spark, str(folder), [("a", "x")])


def test_a_store_that_only_spark_reaches(tmp_path, spark, monkeypatch):
    monkeypatch.setattr(documents, "_store", lambda *_: None)
    assert written(spark, str(tmp_path / "d"), [("a", "x"), ("b", "y")]) == [("a", "T", "x"), ("b", "T", "y")]
    assert (tmp_path / "d" / "doc_id=a").is_dir()
