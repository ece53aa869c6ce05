"""Records from the supplied Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.functions.identity import pack_bits, split_by_number, stable_id
from twinsieve.runtime import table

#: Thresholds of the queries over these tables.
RADIUS, COSINE, NEIGHBOURS = 16, 0.40, 10


def doc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: content hash of the text, split by id, label = source."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        stable_id("doc", F.col("doc_id").cast("string")).alias("id"), F.col("doc_id").alias("number"),
        split_by_number(F.col("doc_id")).alias("split"), F.col("source").alias("label"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("byte_sha256"), F.octet_length("text").cast("long").alias("byte_size"),
    )


def vector_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as records: fingerprint packed from the vector, split by id, label."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(
        stable_id("vec", F.col("vec_id").cast("string")).alias("id"), F.col("vec_id").alias("number"),
        split_by_number(F.col("vec_id")).alias("split"), F.concat(F.lit("class_"), F.col("label").cast("string")).alias("label"),
        F.lit(None).cast("string").alias("byte_sha256"), F.lit(0).cast("long").alias("byte_size"),
        pack_bits(F.col("embedding")).alias("fp"), F.col("embedding").alias("vec"),
    )


def all_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both kinds in one table, without the vectors."""
    common = ["id", "number", "split", "label", "byte_sha256", "byte_size"]
    return doc_records(spark, sf_dir).select(*common).unionByName(vector_records(spark, sf_dir).select(*common))
