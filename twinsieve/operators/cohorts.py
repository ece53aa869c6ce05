"""Controlled contamination of a split, its repair, and the cohorts that an experiment compares."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.functions.identity import stable_id
from twinsieve.operators import balance
from twinsieve.runtime import materialise

# The conditions of an experiment.
CONDITIONS = ("contaminated", "repaired")
SPLIT_OF = {"train": "train", "val": "val", "test": "test", "derived": "test"}


@dataclass(frozen=True)
class Sizes:
    """Rows per class."""

    train: int
    val: int
    test: int
    contamination: int

    def __post_init__(self):
        if min(self.train, self.val, self.test, self.contamination) < 1 or self.contamination > self.train:
            raise ValueError("counts per class must be positive, and no more rows contaminated than trained on")


def chosen_rows(rows: DataFrame, sizes: Sizes, *, seed: int) -> DataFrame:
    """``rows`` (``id, label, digest, ...``) dealt per class to ``role`` train, val and test in seeded
    order, with their ``rank``. Rows without a label, and classes with too few rows, are refused."""
    labelled = rows.where("label IS NOT NULL")
    need = sizes.train + sizes.val + sizes.test
    short = labelled.groupBy("label").count().where(F.col("count") < need).first()
    if short is not None:
        raise ValueError(f"class {short.label!r} has {short['count']} rows of the {need} needed")
    dealt = balance.stratified_buckets(labelled, {"train": sizes.train, "val": sizes.val, "test": sizes.test}, seed=seed)
    return dealt.withColumnRenamed("bucket", "role")


def contamination_sources(chosen: DataFrame, sizes: Sizes) -> DataFrame:
    """The first training rows of each class."""
    return chosen.where((F.col("role") == "train") & (F.col("rank") <= sizes.contamination))


def derivatives(sources: DataFrame, kind: str, derive) -> DataFrame:
    """A derivative of each source: ``derive`` gives its content column from that of the source,
    its digest is that of the new content."""
    content = derive(F.col("content"))
    digest = F.sha2(content.cast("string"), 256)
    return sources.withColumns({
        "source_id": F.col("id"), "id": stable_id("derived", F.lit(kind), F.col("id"), digest), "content": content,
        "digest": digest, "role": F.lit("derived"),
    })


def collisions(clean: DataFrame, derived: DataFrame) -> DataFrame:
    """Digests that stand twice among clean rows, or among derived rows and all others (no rows if
    all is well)."""
    both = clean.select("digest", F.lit(0).alias("d")).unionByName(derived.select("digest", F.lit(1).alias("d")))
    met = both.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("n_derived"))
    return met.where("n > 1")


def controlled_splits(
    rows: DataFrame, sizes: Sizes, *, kind: str, derive, seed: int, size_weight: float = 1.0, class_weight: float = 1.0,
    repair_seed: int = 271828, iterations: int = 250,
) -> tuple[DataFrame, balance.Plan]:
    """``id, label, digest, content, role, source_id, contaminated, repaired``: the split of each
    row in both conditions, and the repair's plan.

    Contaminated: a derivative of each source stands in the test split. Validation and clean
    test rows are holdouts and never move; the repair works on the pool of training rows and
    derivatives, each pair of source and derivative being one family, with ratios that
    give both conditions the same sizes."""
    chosen = materialise(chosen_rows(rows, sizes, seed=seed), "chosen")
    made = materialise(derivatives(contamination_sources(chosen, sizes), kind, derive), "derived")
    was = chosen.select(F.col("id").alias("source_id"), F.col("content").cast("string").alias("was"))
    same = made.join(was, "source_id").where(F.col("content").cast("string") == F.col("was"))
    if not same.isEmpty() or not collisions(chosen, made).isEmpty():
        raise ValueError("contents must be unique, and no derivative may equal its source or another row")
    columns = ["id", "label", "digest", "content", "role"]
    every = chosen.select(*columns, F.lit(None).cast("string").alias("source_id")).unionByName(made.select(*columns, "source_id"))
    split = F.element_at(F.create_map(*[F.lit(x) for pair in SPLIT_OF.items() for x in pair]), F.col("role"))
    every = materialise(every.withColumn("contaminated", split), "cohort")
    pool = every.where(F.col("role").isin("train", "derived")).select("id", F.col("contaminated").alias("split"), "label")
    members = made.select("id", F.col("source_id").alias("root")).union(made.select("source_id", "source_id"))
    n, n_derived = pool.count(), made.count()
    moved, plan = balance.repair_splits(
        pool, members, {"train": (n - n_derived) / n, "val": 0.0, "test": n_derived / n}, size_weight=size_weight,
        class_weight=class_weight, seed=repair_seed, iterations=iterations,
    )
    met = every.join(moved.select(F.col("record_id").alias("id"), "repaired_split"), "id", "left")
    out = met.withColumn("repaired", F.coalesce("repaired_split", "contaminated")).drop("repaired_split")
    return materialise(out, "controlled"), plan


def cohort(splits: DataFrame, condition: str, name: str) -> DataFrame:
    """Rows of the test split in a condition: ``injected`` derivatives that still stand in it, the
    ``not_injected`` rows, or ``all``."""
    if condition not in CONDITIONS:
        raise ValueError(f"unknown condition {condition!r}")
    test = splits.where(F.col(condition) == "test")
    if name == "all":
        return test
    if name not in ("injected", "not_injected"):
        raise ValueError(f"unknown cohort {name!r}")
    mine = F.col("role") == "derived"
    return test.where(mine if name == "injected" else ~mine)


def split_rows(splits: DataFrame, condition: str, split: str) -> DataFrame:
    """The rows of one split in a condition."""
    return splits.where(F.col(condition) == split)


def virtual_records(rows: DataFrame, *, split: Column, height: int, width: int) -> DataFrame:
    """Records of arrays that have no file: label as text, format ``rgbarray``."""
    return rows.select(
        "id", F.concat(F.lit("virtual/"), F.col("id"), F.lit(".rgb")).alias("path"), split.alias("split"), F.col("label").cast("string").alias("label"),
        F.col("digest").alias("byte_sha256"), F.lit(3 * height * width).cast("long").alias("byte_size"),
        F.lit(width).alias("width"), F.lit(height).alias("height"), F.lit("rgbarray").alias("format"),
    )


def violations(splits: DataFrame) -> DataFrame:
    """``constraint, n`` of a controlled split (0 everywhere)."""
    pairs = splits.where("source_id IS NOT NULL").select("id", "source_id", "contaminated", "repaired")
    source = splits.select(F.col("id").alias("source_id"), F.col("contaminated").alias("c"), F.col("repaired").alias("r"))
    met = pairs.join(source, "source_id", "left")
    sizes = splits.groupBy("label").agg(*[
        F.abs(F.count_if(F.col("contaminated") == s) - F.count_if(F.col("repaired") == s)).alias(s) for s in ("train", "val", "test")
    ])
    total = splits.agg(*[(F.count_if(F.col("contaminated") == s) - F.count_if(F.col("repaired") == s)).alias(s) for s in ("train", "val", "test")])
    parts = splits.select(F.when(F.col("role") == "derived", 1).otherwise(0).alias("injected"), "id")
    checks: dict[str, DataFrame] = {
        "cohorts_partition_the_test": parts.groupBy("id").count().where("count <> 1"),
        "sizes_are_equal": total.where("train <> 0 OR val <> 0 OR test <> 0"),
        "classes_stay_in_holdouts": sizes.where("val <> 0"),
        "every_pair_leaks_before": met.where("c IS NULL OR c <> 'train' OR contaminated <> 'test'"),
        "no_pair_leaks_after": met.where("r IS NULL OR r <> repaired"),
        "holdouts_never_move": splits.where("role IN ('val', 'test') AND contaminated <> repaired"),
        "contents_are_unique": splits.groupBy("digest").count().where("count > 1"),
        "splits_differ": splits.agg(F.count_if(F.col("contaminated") != F.col("repaired")).alias("n")).where("n = 0"),
    }
    counted = [df.agg(F.lit(name).alias("constraint"), F.count(F.lit(1)).alias("n")) for name, df in checks.items()]
    return reduce(DataFrame.unionByName, counted)


CONSTRAINTS = (
    "cohorts_partition_the_test", "sizes_are_equal", "classes_stay_in_holdouts", "every_pair_leaks_before", "no_pair_leaks_after",
    "holdouts_never_move", "contents_are_unique", "splits_differ",
)


def array_rows(spark, arrays, labels, *, name: str) -> DataFrame:
    """``id, label, content, digest`` of images that are arrays (n, height, width, 3) of uint8 with
    integer labels, as an experiment's rows; contents are pixel values from 0 to 1."""
    import hashlib

    import numpy as np

    arrays, labels = np.asarray(arrays), np.asarray(labels)
    if arrays.dtype != np.uint8 or arrays.ndim != 4 or arrays.shape[3] != 3 or labels.shape != (len(arrays),):
        raise ValueError("arrays must be uint8 of shape (n, height, width, 3) with a label each")
    if not np.issubdtype(labels.dtype, np.integer) or (labels < 0).any():
        raise ValueError("labels must be integers from 0 on")
    rows = []
    for i, (pixels, label) in enumerate(zip(arrays, labels)):
        size = pixels.shape[1].to_bytes(8, "big") + pixels.shape[0].to_bytes(8, "big")
        digest = hashlib.sha256(size + np.ascontiguousarray(pixels).tobytes()).hexdigest()
        rows.append((f"{name}_{i:08d}", str(int(label)), (pixels.reshape(-1) / 255).tolist(), digest))
    return spark.createDataFrame(rows, "id string, label string, content array<double>, digest string")


# ------------------------------------------------------------------ training


def trained_accuracy(splits: DataFrame, condition: str, seed: int, *, epochs: int = 60, hidden: int = 32) -> DataFrame:
    """``condition, seed, cohort, label, total, correct, accuracy`` of a small network (Spark ML, one
    hidden layer) trained on the condition's training rows and judged on its test cohorts.

    ``content`` must be an array of numbers. It stands for the image network of an experiment,
    whose figures it does not reproduce."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    names = sorted(r.label for r in splits.select("label").distinct().collect())  # classes are few
    index = F.array_position(F.array(*map(F.lit, names)), F.col("label")) - 1
    rows = splits.select("id", "label", "role", condition, array_to_vector(F.col("content").cast("array<double>")).alias("features"), index.cast("double").alias("target"))
    train = materialise(split_rows(rows, condition, "train"), "training")
    size = train.first()["features"].size
    network = MultilayerPerceptronClassifier(
        layers=[size, hidden, len(names)], seed=seed, maxIter=epochs, featuresCol="features", labelCol="target", predictionCol="predicted"
    )
    judged = materialise(network.fit(train).transform(cohort(rows, condition, "all")).select("label", "role", "target", "predicted"), "judged")
    parts = []
    for name in ("all", "injected", "not_injected"):
        mine = judged if name == "all" else judged.where((F.col("role") == "derived") == F.lit(name == "injected"))
        parts.append(mine.select(F.lit(name).alias("cohort"), "label", (F.col("target") == F.col("predicted")).alias("hit")))
    every = reduce(DataFrame.unionByName, parts)
    counts = every.groupBy("cohort", "label").agg(F.count(F.lit(1)).alias("total"), F.count_if("hit").alias("correct"))
    share = F.when(F.col("total") == 0, 0.0).otherwise(F.col("correct") / F.col("total"))
    return counts.select(F.lit(condition).alias("condition"), F.lit(seed).alias("seed"), "cohort", "label", "total", "correct", share.alias("accuracy"))


def run_experiment(splits: DataFrame, seeds: tuple[int, ...], **options) -> DataFrame:
    """``trained_accuracy`` of both conditions for every seed."""
    runs = [materialise(trained_accuracy(splits, c, s, **options), "run") for s in seeds for c in CONDITIONS]
    return reduce(DataFrame.unionByName, runs)


def seed_means(runs: DataFrame) -> DataFrame:
    """``condition, cohort, n_seeds, mean_accuracy``: the mean over seeds of the accuracy of all rows."""
    per = runs.groupBy("condition", "cohort", "seed").agg((F.sum("correct") / F.sum("total")).alias("accuracy"))
    return per.groupBy("condition", "cohort").agg(F.count(F.lit(1)).alias("n_seeds"), F.avg("accuracy").alias("mean_accuracy"))


def run_violations(runs: DataFrame, seeds: tuple[int, ...]) -> DataFrame:
    """``constraint, n`` of experiment runs (0 everywhere)."""
    spark = runs.sparkSession
    want = spark.createDataFrame([(s, c) for s in seeds for c in CONDITIONS], "seed int, condition string")
    have = runs.select("seed", "condition").distinct()
    parts = runs.groupBy("condition", "seed", "label").agg(
        F.sum(F.when(F.col("cohort") == "all", F.col("total")).otherwise(-F.col("total"))).alias("t"),
        F.sum(F.when(F.col("cohort") == "all", F.col("correct")).otherwise(-F.col("correct"))).alias("c"),
    )
    share = F.when(F.col("total") == 0, 0.0).otherwise(F.col("correct") / F.col("total"))
    checks = {
        "every_seed_has_each_condition": want.exceptAll(have).unionByName(have.exceptAll(want)),
        "correct_within_total": runs.where("correct > total OR correct < 0"),
        "accuracy_matches_counts": runs.where(F.abs(F.col("accuracy") - share) > 1e-12),
        "cohorts_sum_to_all": parts.where("t <> 0 OR c <> 0"),
        "class_once_per_run": runs.groupBy("condition", "seed", "cohort", "label").count().where("count > 1"),
    }
    counted = [df.agg(F.lit(name).alias("constraint"), F.count(F.lit(1)).alias("n")) for name, df in checks.items()]
    return reduce(DataFrame.unionByName, counted)


RUN_CONSTRAINTS = ("every_seed_has_each_condition", "correct_within_total", "accuracy_matches_counts", "cohorts_sum_to_all", "class_once_per_run")
