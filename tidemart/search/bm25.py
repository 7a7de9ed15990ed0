"""Ranked full-text search over whole documents with attribute filters (BM25).

``search`` scans the corpus; it needs no exchange but the final top-k. ``SearchIndex`` keeps
postings in a table, for many queries over a corpus that changes a little at a time.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The usual BM25 constants.
K1 = 1.2
B = 0.75

# Scores are rounded before ranking, so copies of a document tie however their sums were ordered.
SCORE_DIGITS = 9

TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: str | Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def query_terms(query: str) -> list[str]:
    terms = list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))
    if not terms:
        raise ValueError("the query holds no word")
    return terms


def inverse_frequency(n_docs: Column, with_term: Column) -> Column:
    return F.log(1 + (n_docs - with_term + 0.5) / (with_term + 0.5))


def term_weight(tf: Column, length: Column, mean_length: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))


def _occurrences(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda word: word == F.lit(term)))


def _where(df: DataFrame, attributes: dict[str, str]) -> DataFrame:
    return reduce(lambda d, item: d.where(F.col(item[0]) == item[1]), attributes.items(), df)


def search(
    docs: DataFrame, query: str, k: int = 10, attributes: dict[str, str] | None = None, text: str = "content"
) -> DataFrame:
    """The ``k`` best documents as ``(doc_id, score)`` plus the attribute columns.

    Corpus statistics cover all documents; the attributes only restrict which may be returned.
    Term counts are taken inside each row, so no posting is ever shuffled.
    """
    attributes = attributes or {}
    terms = query_terms(query)
    words = docs.select("doc_id", *attributes, tokens(text).alias("_words"))
    counts = [_occurrences("_words", term).alias(f"_tf{i}") for i, term in enumerate(terms)]
    counted = words.select("doc_id", *attributes, F.size("_words").alias("_len"), *counts)
    stats = counted.agg(
        F.struct(
            F.count("*").alias("n"),
            F.avg("_len").alias("mean_length"),
            *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))],
        ).alias("stats")
    ).scalar()
    parts = [
        inverse_frequency(stats["n"], stats[f"df{i}"])
        * term_weight(F.col(f"_tf{i}"), F.col("_len"), stats["mean_length"])
        for i in range(len(terms))
    ]
    found = reduce(lambda a, b: a | b, [F.col(f"_tf{i}") > 0 for i in range(len(terms))])
    return (
        _where(counted, attributes)
        .where(found)
        .select("doc_id", *attributes, F.round(reduce(lambda a, b: a + b, parts), SCORE_DIGITS).alias("score"))
        .orderBy(F.desc("score"), "doc_id")
        .limit(k)
    )


MANIFEST = "version bigint, run string, replaces array<string>"


@dataclass(frozen=True)
class SearchIndex:
    """Index of segments: a refresh writes documents and postings into a folder of its own and then commits both.

    The commit is one file appended to ``manifest``; until then nothing of the segment is seen, so documents and
    postings never get out of step and a crash between them loses nothing. A document's live row is that of its newest
    version; a deleted one has a tombstone. :meth:`compact` merges segments into one without old versions and
    tombstones. Refreshes and a compaction may run at the same time: a compaction takes the place of those segments
    alone that it has read.
    """

    spark: SparkSession
    path: str
    attributes: tuple[str, ...] = ("title", "category")
    text: str = "content"

    def _manifest(self) -> list:
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest").collect()
        except AnalysisException as e:  # nothing is stored yet
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def segments(self) -> dict[str, int]:
        """Committed segments that none has replaced, and their versions."""
        rows = self._manifest()
        gone = {run for r in rows for run in r.replaces}
        return {r.run: r.version for r in rows if r.run not in gone}

    def next_version(self) -> int:
        """One more than the newest version; 0 for a new index."""
        return max([r.version for r in self._manifest()], default=-1) + 1

    def _commit(self, version: int, run: str, replaces: list[str]) -> None:
        row = self.spark.createDataFrame([(version, run, replaces)], MANIFEST)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _write(self, run: str, heads: DataFrame, postings: DataFrame) -> None:
        heads.write.parquet(f"{self.path}/segments/{run}/docs")
        postings.sortWithinPartitions("term").write.parquet(f"{self.path}/segments/{run}/postings")

    def refresh(self, changed: DataFrame, version: int | None = None, deleted: DataFrame | None = None) -> None:
        """Index the changed documents and put tombstones on the deleted ids.

        A changed document without text drops out of the results. A repeated refresh of a stated version replaces
        that version.
        """
        run = uuid.uuid4().hex
        replaces = [r for r, v in self.segments().items() if v == version] if version is not None else []
        version = self.next_version() if version is None else version
        number = F.lit(version).cast("bigint").alias("version")
        words = changed.select("doc_id", *self.attributes, tokens(self.text).alias("words"))
        heads = words.select(
            "doc_id", *self.attributes, F.size("words").alias("length"), F.lit(False).alias("deleted"), number
        )
        if deleted is not None:
            stones = deleted.select("doc_id", F.lit(0).alias("length"), F.lit(True).alias("deleted"), number)
            heads = heads.unionByName(stones, allowMissingColumns=True)
        postings = (
            words.select("doc_id", F.explode("words").alias("term"))
            .groupBy("doc_id", "term")
            .agg(F.count("*").alias("tf"))
            .select("doc_id", "term", "tf", number)
        )
        self._write(run, heads, postings)
        self._commit(version, run, replaces)

    def refresh_stream(self, docs: DataFrame, checkpoint: str):
        """Start a stream that indexes each arriving batch of documents as a new version.

        A batch that is run again becomes one more version of the same documents.
        """
        return (
            docs.writeStream.foreachBatch(lambda batch, _: self.refresh(batch))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )

    def _read(self, name: str, runs: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/segments/{run}/{name}" for run in runs])

    def _live(self, runs: list[str]) -> DataFrame:
        docs = self._read("docs", runs)
        if len(runs) > 1:
            row = F.struct("version", "length", "deleted", *self.attributes)
            docs = docs.groupBy("doc_id").agg(F.max_by(row, "version").alias("d")).select("doc_id", "d.*")
        return docs.where(~F.col("deleted"))

    def live_docs(self) -> DataFrame:
        return self._live(sorted(self.segments())).drop("deleted")

    def compact(self) -> None:
        """Merge all segments into one that holds each live document once; results stay the same."""
        segments = self.segments()
        runs, run = sorted(segments), uuid.uuid4().hex
        if not runs:
            return
        docs = self._live(runs)
        live = docs.select("doc_id", "version")
        self._write(run, docs, self._read("postings", runs).join(live, ["doc_id", "version"], "left_semi"))
        self._commit(max(segments.values()), run, runs)

    def search(self, query: str, k: int = 10, attributes: dict[str, str] | None = None) -> DataFrame:
        attributes = attributes or {}
        terms = query_terms(query)
        runs = sorted(self.segments())
        docs = self._live(runs).where(F.col("length") > 0)
        postings = self._read("postings", runs).where(F.col("term").isin(terms))
        hits = postings.join(docs, ["doc_id", "version"])
        corpus = docs.agg(F.struct(F.count("*").alias("n"), F.avg("length").alias("mean_length")).alias("s")).scalar()
        # One entry per query term.
        spread = (
            hits.groupBy("term")
            .agg(F.count("*").alias("df"))
            .agg(F.map_from_entries(F.collect_list(F.struct("term", "df"))).alias("m"))
            .scalar()
        )
        weight = inverse_frequency(corpus["n"], F.element_at(spread, F.col("term"))) * term_weight(
            F.col("tf"), F.col("length"), corpus["mean_length"]
        )
        return (
            _where(hits, attributes)
            .groupBy("doc_id", *attributes)
            .agg(F.round(F.sum(weight), SCORE_DIGITS).alias("score"))
            .orderBy(F.desc("score"), "doc_id")
            .limit(k)
        )
