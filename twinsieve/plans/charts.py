"""The data of charts and of a report's further tables, and thumbnails."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.functions.images import ImageProblem, decode, encode_png, on_white, resize
from twinsieve.operators.cohorts import seed_means
from twinsieve.sources.images import read_within

DASH = "—"


def shown(column: str, digits: int = 6) -> F.Column:
    """A number as text, a missing one as a dash."""
    return F.coalesce(F.format_number(F.col(column).cast("double"), digits), F.lit(DASH)).alias(column)


# ------------------------------------------------------------------ chart frames


def detection_frame(rows: DataFrame) -> DataFrame:
    """``detector, threshold, precision, recall``: all corruptions together, by threshold."""
    sums = rows.groupBy("detector", "threshold").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    part = lambda b: F.when(b == 0, 0.0).otherwise(F.col("tp") / b)
    return sums.select(
        "detector", "threshold", part(F.col("tp") + F.col("fp")).alias("precision"), part(F.col("tp") + F.col("fn")).alias("recall")
    ).orderBy("detector", F.asc_nulls_first("threshold"))


def scaling_frame(rows: DataFrame) -> DataFrame:
    """``stage, mode, dataset_size, duration_seconds`` in drawing order."""
    return rows.select("stage", "mode", "dataset_size", "duration_seconds").orderBy("stage", "mode", "dataset_size")


def split_frame(assignments: DataFrame) -> DataFrame:
    """``split, before, after`` of a repair."""
    count = lambda c, name: assignments.groupBy(F.col(c).alias("split")).agg(F.count(F.lit(1)).alias(name))
    met = count("original_split", "before").join(count("repaired_split", "after"), "split", "full_outer")
    return met.select("split", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("before", "after")]).orderBy("split")


def evaluation_frame(runs: DataFrame) -> DataFrame:
    """``condition, cohort, n_seeds, mean_accuracy``."""
    return seed_means(runs).orderBy("condition", "cohort")


# ------------------------------------------------------------------ report rows


def detection_rows(rows: DataFrame) -> DataFrame:
    """Metric rows for display, in the order of detector, corruption and threshold."""
    ordered = rows.orderBy("detector", "corruption", F.asc_nulls_first("threshold"))
    return ordered.select("detector", "corruption", *[shown(c) for c in ("threshold", "precision", "recall", "f1")], "tp", "fp", "fn")


def provenance_rows(spark: SparkSession, provenance: dict) -> DataFrame:
    """What made the vectors, as name and value."""
    names = {
        "Backend": provenance["backend"], "Model identity": provenance["model_identity"],
        "Model revision": provenance["model_revision"] or "none", "Preprocessing": provenance["preprocessing_version"],
        "Device": provenance["device"], "Synthetic": "yes" if provenance["is_synthetic"] else "no",
    }
    return spark.createDataFrame(list(names.items()), "name string, value string")


def scaling_rows(rows: DataFrame) -> DataFrame:
    ordered = rows.orderBy("dataset_size", "stage", "mode")
    scope = F.coalesce("memory_measurement_scope", F.lit(DASH)).alias("memory_measurement_scope")
    return ordered.select("dataset_size", "stage", "mode", shown("duration_seconds"), shown("peak_memory_bytes", 0), scope, shown("recall_at_k"))


def training_rows(runs: DataFrame) -> DataFrame:
    """Runs by condition, seed and cohort, all classes together."""
    sums = runs.groupBy("condition", "seed", "cohort").agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"))
    share = F.when(F.col("total") == 0, 0.0).otherwise(F.col("correct") / F.col("total"))
    return sums.withColumn("accuracy", share).orderBy("condition", "seed", "cohort").select("condition", "seed", "cohort", "correct", "total", shown("accuracy"))


def condition_rows(splits: DataFrame) -> DataFrame:
    """Rows per condition and split, with the injected ones."""
    parts = [
        splits.groupBy(F.lit(c).alias("condition"), F.col(c).alias("split")).agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(F.col("role") == "derived").alias("injected")
        )
        for c in ("contaminated", "repaired")
    ]
    return parts[0].unionByName(parts[1]).orderBy("condition", "split")


def truth_rows(splits: DataFrame) -> DataFrame:
    """Injected pairs: source, derivative and where each stands in both conditions."""
    source = splits.select(F.col("id").alias("source_id"), F.col("repaired").alias("source_repaired"))
    return splits.where("source_id IS NOT NULL").join(source, "source_id").select(
        "source_id", F.col("id").alias("derived_id"), "label", "contaminated", "repaired", "source_repaired"
    ).orderBy("source_id")


def artifact_rows(spark: SparkSession, artifacts: dict[str, dict]) -> DataFrame:
    """One row for each artifact: kind, time, commit, hashes, seeds and packages."""
    rows = []
    for kind in sorted(artifacts):
        m = artifacts[kind]["metadata"]
        versions = ", ".join(f"{p['name']}=={p['version']}" for p in m["package_versions"]) or "none recorded"
        seeds = ", ".join(map(str, m["random_seeds"])) or DASH
        rows.append((kind, m["timestamp"], m["git_commit_sha"] or DASH, m["configuration_sha256"], m["dataset_manifest_sha256"], seeds, versions))
    return spark.createDataFrame(
        rows, "artifact string, timestamp string, commit string, configuration_sha256 string, dataset_sha256 string, seeds string, packages string"
    )


# ------------------------------------------------------------------ thumbnails


def representative_ids(records: DataFrame, groups: list[tuple[DataFrame, str, str]], most: int) -> DataFrame:
    """``id, place``: the first ``most`` records, each once: members of the groups in turn
    (tables with an order column and a column of ids), then all records by id."""
    parts = [df.select(F.col(ids).alias("id"), F.lit(k).alias("k"), F.col(order).cast("string").alias("o")) for k, (df, order, ids) in enumerate(groups)]
    every = records.select("id", F.lit(len(groups)).alias("k"), F.lit("").alias("o"))
    for part in parts:
        every = every.unionByName(part.join(records.select("id"), "id", "left_semi"))
    first = every.groupBy("id").agg(F.min(F.struct("k", "o", "id")).alias("f"))
    ordered = first.orderBy("f").limit(most).collect()  # a report's few pictures
    return records.sparkSession.createDataFrame([(r.id, n) for n, r in enumerate(ordered)], "id string, place int")


def thumbnail(data: bytes, size: int) -> bytes:
    """A PNG with at most ``size`` pixels a side, upright and on white."""
    pixels = on_white(decode(data))
    scale = min(1.0, size / max(pixels.shape[:2]))
    height, width = (max(1, round(n * scale)) for n in pixels.shape[:2])
    return encode_png(np.ascontiguousarray(resize(pixels, width, height)))


def thumbnails(records: DataFrame, ids: DataFrame, root: str, *, size: int = 160) -> tuple[dict[str, str], int]:
    """``id -> data URI`` of the chosen records, and how many were skipped: those that cannot be
    read or decoded, or whose content is no longer the recorded one. ``ids`` are few."""
    made, skipped = {}, 0
    for r in records.join(ids, "id").orderBy("place").collect():
        try:
            data = read_within(root, r.path)
            if hashlib.sha256(data).hexdigest() != r.byte_sha256:
                raise ImageProblem("io_error")
            made[r.id] = "data:image/png;base64," + base64.b64encode(thumbnail(data, size)).decode()
        except ImageProblem:
            skipped += 1
    return made, skipped
