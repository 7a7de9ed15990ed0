"""Markdown documents with front matter as a table."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemart.schemas import DOCUMENT_SCHEMA
from tidemart.session import python_tasks

MANIFEST = "path string, n_bytes bigint"
#: Bytes of files that a task reads, and of texts that it holds at once, about.
TASK_BYTES, BATCH_BYTES = 64 << 20, 8 << 20
#: The name of the file without an id, as of Spark's folders.
NO_ID = "__HIVE_DEFAULT_PARTITION__"


def _field(header: Column, name: str) -> Column:
    value = F.regexp_extract(header, rf"(?m)^{name}:[ \t]*(.*?)[ \t]*$", 1)
    return F.regexp_replace(value, "^([\"'])(.*)\\1$", "$2")


def parse_documents(files: DataFrame) -> DataFrame:
    """``(file_name, value)`` rows of whole files to ``(doc_id, title, category, content, updated_at)``.

    The text before the second ``---`` is the front matter; the id is the file name without its
    extension. A file without front matter gives NULLs, which the corpus checks report.
    """
    parts = F.split("value", "---", 3)
    return files.select(F.col("file_name"), F.get(parts, F.lit(1)).alias("header"), F.get(parts, F.lit(2)).alias("body")).select(
        F.regexp_replace("file_name", r"\.[^.]*$", "").alias("doc_id"),
        _field(F.col("header"), "title").alias("title"),
        _field(F.col("header"), "category").alias("category"),
        F.regexp_replace("body", r"^\s+|\s+$", "").alias("content"),
        _field(F.col("header"), "updated_at").try_cast("date").alias("updated_at"),
    )


def load_documents(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """All Markdown files of a folder in one job; the id is the file's name, or ``<id>`` of a folder ``doc_id=<id>``."""
    written = _written(spark, folder, pattern)
    if written is not None:
        return parse_documents(written).select(*DOCUMENT_SCHEMA.names)
    files = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
    name = F.col("doc_id").cast("string") if "doc_id" in files.columns else F.col("_metadata.file_name")
    return parse_documents(files.select(name.alias("file_name"), "value")).select(*DOCUMENT_SCHEMA.names)


def write_documents(files: DataFrame, folder: str) -> None:
    """One file ``<id>.txt`` a row of (doc_id, value), in a folder a task; ``_manifest`` names the files of all tasks.

    Tasks write them side by side and Spark commits only the manifest, as its own writer makes, lists and moves a folder
    for each id. What a failed or second attempt has written is in no manifest. Rows of one id within a task share a
    file, line after line. A store that only Spark reaches gets Spark's folders ``doc_id=<id>``.
    """
    rows = files.select("doc_id", "value")
    store = _store(files.sparkSession, folder)
    if store is None:
        rows.write.partitionBy("doc_id").text(folder)
        return
    named = rows.select(F.when(F.col("doc_id") != "", F.col("doc_id")).alias("doc_id"), F.col("value").cast("binary").alias("value"))
    named.sortWithinPartitions("doc_id").mapInArrow(_writer(*store), MANIFEST).write.parquet(f"{folder}/_manifest")


def _store(spark: SparkSession, folder: str) -> tuple[fs.FileSystem, str] | None:
    """The file system of a folder as Python tasks open it, and the path there; None if only Spark reaches it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    if uri.getScheme() == "file":
        return fs.LocalFileSystem(), uri.getPath()
    try:
        files, path = fs.FileSystem.from_uri(uri.toString())
        files.create_dir(path)
    except (pa.ArrowInvalid, NotImplementedError, OSError):
        return None
    return files, path


def _writer(files: fs.FileSystem, root: str):
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = f"{root}/{(task := uuid.uuid4().hex)}"
        files.create_dir(folder)
        paths, sizes, last, out = [], [], NO_ID, None
        for batch in batches:
            for doc_id, value in zip(batch["doc_id"], batch["value"]):
                name = doc_id.as_py() or NO_ID
                if out is None or name != last:
                    if out is not None:
                        sizes.append(out.tell())
                        out.close()
                    path = re.sub(r"[%/\x00]", lambda m: f"%{ord(m[0]):02X}", name) + ".txt"
                    out, last = files.open_output_stream(f"{folder}/{path}", compression=None), name
                    paths.append(f"{task}/{path}")
                out.write((value.as_py() or b"") + b"\n")
        if out is not None:
            sizes.append(out.tell())
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "n_bytes"])

    return write


def _reader(files: fs.FileSystem, root: str):
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, values, held = [], [], 0

        def taken() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.binary())], ["file_name", "value"])

        for batch in batches:
            for path in batch["path"].to_pylist():
                with files.open_input_stream(f"{root}/{path}", compression=None) as f:
                    value = f.read()
                name = unquote(path.split("/", 1)[1])
                names.append(None if name == f"{NO_ID}.txt" else name)
                values.append(value)
                held += len(value)
                if held >= BATCH_BYTES:
                    yield taken()
                    names, values, held = [], [], 0
        yield taken()

    return read


def _written(spark: SparkSession, folder: str, pattern: str) -> DataFrame | None:
    """``(file_name, value)`` of the files that :func:`write_documents` names; None for any other folder.

    Files are dealt over tasks by number, so that neither a listing nor a file's status reaches the driver.
    """
    try:
        manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    store = _store(spark, folder)
    matches = spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()
    paths = manifest.where(F.substring_index("path", "/", -1).rlike(f"(?s)^(?:{matches})$"))
    n_bytes = paths.agg(F.sum("n_bytes")).first()[0] or 0
    tasks = max(python_tasks(paths), n_bytes // TASK_BYTES)
    return paths.select("path").repartition(tasks).mapInArrow(_reader(*store), "file_name string, value binary").select(
        "file_name", F.col("value").cast("string").alias("value")
    )
