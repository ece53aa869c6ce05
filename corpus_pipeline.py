"""The corpus pipeline: quality rules, line de-duplication, near-duplicate removal,
benchmark decontamination, then mixing to target weights.

Every stage decides row by row. Null and repeated ids are rows like any others (the rows are
then numbered first); null and empty texts fail the base rules of the first stage; texts of
any length are used whole; an empty table gives an empty result; the first four stages give
back the columns they get."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.llm import decontamination, line_dedup, mixing, near_dedup, quality
from twinsieve.runtime import drop_materialised, materialise, table

#: Words as in the operators: runs of anything but the six blanks.
_WORD = r"[^\x20\x09-\x0D]"


def _row_wise(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work(docs)``, where each row has an id of its own.

    The operators tell rows apart by id. If ids are null or repeated, the rows get their
    number in the order of all columns (null ids last) as ``doc_id`` and keep their own id
    in ``__id``, which stands in ``doc_id`` again in the result.
    """
    if docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").isEmpty():
        return work(docs)
    order = [F.asc_nulls_last("doc_id"), *[c for c in docs.columns if c != "doc_id"]]
    apart = docs.orderBy(*order).withColumns({"__id": F.col("doc_id"), "doc_id": F.monotonically_increasing_id()})
    done = work(materialise(apart, "pipeline-rows"))
    return done.select(*[F.col("__id" if c == "doc_id" else c).alias(c) for c in docs.columns])


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the ids listed."""
    gone = ids.select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the rules or the forest reject."""
    labels = table(spark, sf_dir, "labels")

    def work(rows: DataFrame) -> DataFrame:
        mine = labels
        if "__id" in rows.columns:
            mine = labels.withColumnRenamed("doc_id", "__id").join(rows.select("__id", "doc_id"), "__id")
        return _without(rows, quality.quality_rules(rows, mine).where(~F.col("kept")))

    return _row_wise(docs, work)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated line runs; a document that had words and has none left goes."""

    def work(rows: DataFrame) -> DataFrame:
        cut = line_dedup.dedup_lines(rows).where((F.col("n_removed") == 0) | F.col("text").rlike(_WORD))
        return cut.withColumn("n_chars", F.length("text").cast("long")).select(rows.columns)

    return _row_wise(docs, work)


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least id of each near-duplicate group (of a repeated row, one)."""
    return _row_wise(docs, lambda rows: _without(rows, near_dedup.near_duplicates(rows).where(~F.col("kept"))))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    items = table(spark, sf_dir, "benchmark")
    return _row_wise(docs, lambda rows: _without(rows, decontamination.contaminated(rows, items)))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training positions and word counts of the mix."""
    return mixing.mix_sources(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_deduplication),
    ("near dedup", near_duplicate_removal),
    ("benchmark decontamination", benchmark_decontamination),
    ("source mixing", source_mixing),
]

#: The isolation forest and SimHash stages are beyond SQL; tests use brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each is written as Parquet and read again."""
    docs, former = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        if former is not None:
            drop_materialised(former)
        former = docs
    return STAGES[-1][1](spark, docs, sf_dir)
