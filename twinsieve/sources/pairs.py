"""Labelled image pairs in two folds: loading with its rules, calibration, held-out scores."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.functions.identity import hamming
from twinsieve.operators.metrics import select_radius, sweep
from twinsieve.runtime import materialise
from twinsieve.sources.images import ManifestError, entries_of, scan, strict_path

# Fixed value: the header of a fold.
HEADER = ["left", "right", "label", "left_group", "right_group"]
MOST_BYTES = 100 << 20  # of one file


def read_pairs(path: str) -> list[tuple[str, str, int, str, str]]:
    """Rows of a fold's CSV (labelled by hand, so the driver holds them); raises on anything that
    the rules forbid."""
    with open(path, encoding="utf-8-sig", newline="") as file:
        lines = list(csv.reader(file))
    if not lines or lines[0] != HEADER:
        raise ManifestError("the header must be " + ",".join(HEADER))
    rows, seen, group_of = [], set(), {}
    for number, cells in enumerate(lines[1:], start=2):
        if len(cells) != 5 or not all(c.strip() for c in cells):
            raise ManifestError(f"row {number} needs five values")
        left, right = strict_path(cells[0].strip()), strict_path(cells[1].strip())
        label, groups = cells[2].strip(), (cells[3].strip(), cells[4].strip())
        if label not in ("0", "1") or (label == "1") != (groups[0] == groups[1]):
            raise ManifestError(f"row {number}: the label must say whether the groups are equal")
        pair = frozenset((left, right))
        if len(pair) < 2 or pair in seen:
            raise ManifestError(f"row {number} repeats a pair or pairs an image with itself")
        seen.add(pair)
        for image, group in zip((left, right), groups):
            if group_of.setdefault(image, group) != group:
                raise ManifestError(f"row {number}: an image has two groups")
        rows.append((left, right, int(label), *groups))
    if {r[2] for r in rows} != {0, 1}:
        raise ManifestError("a fold needs pairs of both labels")
    return rows


def load_fold(spark: SparkSession, path: str, root: str, *, max_pixels: int = 50_000_000) -> DataFrame:
    """``left, right, left_group, right_group, left_sha, right_sha, left_pixels, right_pixels,
    is_duplicate, distance``; the distance of equal contents is -1, so that radius -1 means
    equal content alone."""
    rows = read_pairs(path)
    paths = sorted({p for r in rows for p in r[:2]})
    manifest = entries_of(spark, [(p, "custom", None) for p in paths])
    seen = materialise(scan(manifest, root, max_pixels=max_pixels), "pair-images")
    if not seen.where(F.col("issue").isNotNull() | (F.col("byte_size") > MOST_BYTES)).isEmpty():
        raise ManifestError("an image of a pair cannot be read or is too large")
    one = seen.select("path", "byte_sha256", "pixel_sha256", "fp")
    pairs = spark.createDataFrame(rows, "left string, right string, label int, left_group string, right_group string")
    met = pairs.join(one.toDF("left", "left_sha", "left_pixels", "f1"), "left")
    met = met.join(one.toDF("right", "right_sha", "right_pixels", "f2"), "right")
    for kind in ("sha", "pixels"):
        groups = met.select(F.col(f"left_{kind}").alias("s"), F.col("left_group").alias("g"))
        groups = groups.union(met.select(f"right_{kind}", "right_group")).distinct()
        if not groups.groupBy("s").count().where("count > 1").isEmpty():
            raise ManifestError("equal contents or equal pixels stand in two groups")
    distance = F.when(F.col("left_sha") == F.col("right_sha"), -1).otherwise(hamming(F.col("f1"), F.col("f2")).cast("int"))
    return met.select(
        "left", "right", "left_group", "right_group", "left_sha", "right_sha", "left_pixels", "right_pixels", (F.col("label") == 1).alias("is_duplicate"),
        distance.alias("distance"),
    )


def shared_between(a: DataFrame, b: DataFrame) -> DataFrame:
    """``what, n``: groups, paths, contents and pixels that stand in both folds (all must be 0)."""
    both = lambda df, x, y: df.select(F.col(x).alias("v")).union(df.select(y))
    ends = (("groups", "left_group", "right_group"), ("paths", "left", "right"), ("contents", "left_sha", "right_sha"), ("pixels", "left_pixels", "right_pixels"))
    counts = [
        both(a, x, y).intersect(both(b, x, y)).agg(F.lit(name).alias("what"), F.count(F.lit(1)).alias("n"))
        for name, x, y in ends
    ]
    return reduce(DataFrame.unionByName, counts)


def evaluate_pairs(calibration: DataFrame, evaluation: DataFrame, *, minimum_precision: float = 0.95) -> dict:
    """The radius chosen on the calibration fold alone, and its scores on the other fold."""
    if not 0 < minimum_precision <= 1:
        raise ManifestError("the minimum precision must lie in (0, 1]")
    if not shared_between(calibration, evaluation).where("n > 0").isEmpty():
        raise ManifestError("the folds share groups, paths or contents")
    hit = lambda t: F.col("distance") <= t
    chosen = select_radius(sweep(calibration, list(range(-1, 65)), hit), minimum_precision).first()
    if chosen is None:
        raise ManifestError("no calibration threshold meets the minimum precision")
    held_out = sweep(evaluation, [chosen.threshold], hit).first()
    return {"radius": chosen.threshold, "calibration": chosen.asDict(), "evaluation": held_out.asDict()}
