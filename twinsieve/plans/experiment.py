"""Queries of the controlled experiment, over the vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinsieve.operators import cohorts as C
from twinsieve.operators import metrics as M
from twinsieve.plans.queries import LEVELS, _truth
from twinsieve.sources.tables import vector_records

SEED = 314159
SIZES = C.Sizes(train=8, val=2, test=3, contamination=2)
SEEDS = (7, 42)


def _rows(spark, sf_dir):
    r = vector_records(spark, sf_dir)
    enough = r.groupBy("label").count().where(F.col("count") >= SIZES.train + SIZES.val + SIZES.test).select("label")
    r = r.join(enough, "label", "left_semi")
    return r.select("id", "label", F.col("vec").alias("content"), F.sha2(F.col("vec").cast("string"), 256).alias("digest"))


def _splits(spark, sf_dir):
    nudged = lambda v: F.transform(v, lambda x: (x * 0.9 + 0.01).cast("float"))
    return C.controlled_splits(_rows(spark, sf_dir), SIZES, kind="scaled", derive=nudged, seed=SEED)[0]


def cohort_rows(spark, sf_dir):
    """The rows that the experiment chooses, per class."""
    return C.chosen_rows(_rows(spark, sf_dir), SIZES, seed=SEED).select("id", "label", "role", "rank")


def cohort_sources(spark, sf_dir):
    """The training rows of which a derivative goes to the test split."""
    chosen = C.chosen_rows(_rows(spark, sf_dir), SIZES, seed=SEED)
    return C.contamination_sources(chosen, SIZES).select("id", "label", "rank")


def cohort_sizes(spark, sf_dir):
    """Rows per condition and split, with the injected ones: equal sizes, other contents."""
    s = _splits(spark, sf_dir)
    each = [s.groupBy(F.lit(c).alias("condition"), F.col(c).alias("split")).agg(F.count(F.lit(1)).alias("n")) for c in C.CONDITIONS]
    return each[0].unionByName(each[1])


def cohort_constraints(spark, sf_dir):
    return C.violations(_splits(spark, sf_dir))


def experiment_constraints(spark, sf_dir):
    """Contracts of the runs of a network on both conditions."""
    return C.run_violations(C.run_experiment(_splits(spark, sf_dir), SEEDS, epochs=5), SEEDS)


def metric_constraints(spark, sf_dir):
    """Rates that do not follow from their counts (0 everywhere)."""
    rows = M.sweep(_truth(spark, sf_dir), LEVELS, lambda t: F.col("level") >= 0, "corruption")
    part = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    p, r = part(F.col("tp"), F.col("tp") + F.col("fp")), part(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = part(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    wrong = lambda c, want: F.count_if(F.abs(F.col(c) - want) > 1e-12).alias(c)
    counts = rows.agg(wrong("precision", p), wrong("recall", r), wrong("f1", f1))
    return counts.unpivot([], ["precision", "recall", "f1"], "constraint", "n")


QUERIES = {f.__name__: f for f in (cohort_rows, cohort_sources, cohort_sizes, cohort_constraints, experiment_constraints, metric_constraints)}
_ROLE = f"CASE WHEN rank <= {SIZES.train} THEN 'train' WHEN rank <= {SIZES.train + SIZES.val} THEN 'val' ELSE 'test' END"
_RANKED = f"SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY sha256('{SEED}:' || id), id) AS rank, count(*) OVER (PARTITION BY label) AS n FROM vecs WHERE label IS NOT NULL"
_NEED = SIZES.train + SIZES.val + SIZES.test
_ZEROS = lambda names: "SELECT unnest([" + ", ".join(f"'{c}'" for c in names) + "]) AS \"constraint\", 0::BIGINT AS n"
BODIES = {
    "cohort_rows": f"SELECT id, label, {_ROLE} AS role, rank::INTEGER AS rank FROM ({_RANKED}) WHERE n >= {_NEED} AND rank <= {_NEED}",
    "cohort_sources": f"SELECT id, label, rank::INTEGER AS rank FROM ({_RANKED}) WHERE n >= {_NEED} AND rank <= {SIZES.contamination}",
    "cohort_sizes": f"SELECT condition, split, (k * n)::BIGINT AS n FROM (VALUES ('contaminated'), ('repaired')) c(condition), (VALUES ('train', {SIZES.train}), ('val', {SIZES.val}), ('test', {SIZES.test + SIZES.contamination})) s(split, k), (SELECT count(DISTINCT label) AS n FROM ({_RANKED}) WHERE n >= {_NEED})",
    "cohort_constraints": _ZEROS(C.CONSTRAINTS),
    "experiment_constraints": _ZEROS(C.RUN_CONSTRAINTS),
    "metric_constraints": _ZEROS(("precision", "recall", "f1")),
}
