"""Token ids as ORC files: integer run-length encoding, row indexes, Bloom filters on document ids.

``write`` range-partitions the documents by id, so that file order is id order and a lookup touches one file
and, by row index and Bloom filter, few row groups of it. Stripes are read in parallel. Each row holds its
ids, the number of its file (``part``) and the ids before it in that file (``before``); the start of a
document over all files is the sum of the earlier files' totals and ``before``.

Defined results: a null text is the empty text. Null ids come first. Rows of the same id are ordered by a
hash of their text; repeated rows are all written. Texts are encoded whole; extra columns are left out; an
empty table gives an empty folder of files that still can be read.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemart.llm.common import pick, slices, tokenizer_json
from tidemart.llm.library_tokens import library_tokens
from tidemart.session import scratch_dir

DEFAULT = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
SCHEMA = "doc_id bigint, part int, before bigint, ids array<int>"
#: Writer settings of the format.
ORC = {
    "compression": "zstd",
    "orc.stripe.size": str(64 << 20),
    "orc.row.index.stride": "2000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def write(docs: DataFrame, path: str, tokenizer: str = DEFAULT, end_id: int = END_ID) -> None:
    """Encode every text, append the end id, and write the files in ascending order of document ids."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(tokenizer_json(tokenizer))

    def run(batches):
        encoder, before = library_tokens(vocabulary.value), 0
        for batch in slices(batches):
            offsets, ids = encoder.encode(batch.column(1))
            ids = np.insert(ids.astype(np.int32), offsets[1:], end_id)
            offsets = offsets + np.arange(len(offsets))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(before + offsets[:-1]),
                    pa.ListArray.from_arrays(offsets.astype(np.int32), ids),
                ],
                ["doc_id", "part", "before", "ids"],
            )
            before += int(offsets[-1])

    rows = pick(docs, doc_id="bigint", text="string").withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    numbered = ordered.select("doc_id", "text", F.spark_partition_id().alias("part"))
    numbered.mapInArrow(run, SCHEMA).write.options(**ORC).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows; conditions on doc_id reach the row indexes and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path)


def digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: start over all files, number of ids, and their crc32."""

    def run(batches):
        for batch in slices(batches):
            lists = batch.column(3)
            raw = memoryview(pc.list_flatten(lists).to_numpy().astype("<u4").tobytes())
            ends = ((lists.offsets.to_numpy() - lists.offsets[0].as_py()) * 4).tolist()
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(ends, ends[1:])]
            n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(n), pa.array(crc, pa.int64())],
                ["doc_id", "part", "before", "n_tokens", "ids_crc32"],
            )

    rows = read(spark, path).mapInArrow(run, "doc_id bigint, part int, before bigint, n_tokens bigint, ids_crc32 bigint")
    # One row per file: the files' totals, summed up in their order.
    totals = read(spark, path).groupBy("part").agg(F.sum(F.size("ids").cast("bigint")).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    return rows.join(first, "part").select(
        "doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def round_trip(docs: DataFrame) -> DataFrame:
    """Write the documents' ids to a new scratch folder and digest what the files hold."""
    spark = docs.sparkSession
    path = scratch_dir(spark, "token-orc")
    write(docs, path)
    return digest(spark, path)
