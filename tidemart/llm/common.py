"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemart.session import freed_shuffles, scratch_dir

#: Rows that a Python task turns into Python objects at once; long texts make a slice shorter.
SLICE_ROWS, SLICE_BYTES = 8192, 12 << 20


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` into the shared folder; sets a folder only where the session has none."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(scratch_dir(spark, "checkpoints"))
    with freed_shuffles(spark):
        return df.select("*").checkpoint()  # a frame takes the setting when it is made


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame to the scratch folder and read it back: outlives executors and is compressed."""
    path = scratch_dir(df.sparkSession, purpose)
    with freed_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pick(df: DataFrame, **types: str) -> DataFrame:
    """The named columns, cast; by exact name and position, so that clashing extra columns do no harm.

    A missing column gives nulls. Of columns of the same name the first counts.
    """
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    at = {name: i for i, name in reversed(list(enumerate(df.columns)))}
    return plain.select(*[(F.col(f"c{at[n]}") if n in at else F.lit(None)).cast(t).alias(n) for n, t in types.items()])


def by_position(df: DataFrame, change: Callable[[DataFrame, dict[str, int]], DataFrame]) -> DataFrame:
    """Apply ``change`` to the frame with columns c0, c1, ... and the places of its names; names come back after.

    So extra columns may be called anything. ``change`` has to keep the columns and their order.
    """
    places = {name: i for i, name in reversed(list(enumerate(df.columns)))}
    return change(df.toDF(*[f"c{i}" for i in range(len(df.columns))]), places).toDF(*df.columns)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(doc_id, divisor: int):
    """crc32 of the id as text, modulo the divisor: the fold of a document. Null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def fold(doc_id: int | None, divisor: int) -> int | None:
    """:func:`remainder` on plain values."""
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % divisor


def slices(
    batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice has bounded rows and, but for single rows, about bounded bytes.

    Behind the last one Arrow's free memory goes back: workers live on, and later stages need it.
    """
    for batch in batches:
        if batch.num_rows:
            step = max(1, min(rows, size * batch.num_rows // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                yield batch.slice(at, step)
    pa.default_memory_pool().release_unused()


def tokenizer_json(path: str) -> str:
    """The tokenizer file's content, to be broadcast: a vocabulary has a fixed, small size."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    json.loads(text)
    return text
