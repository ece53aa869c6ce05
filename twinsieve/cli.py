"""Command line: ``version``, ``scan``, ``audit``, ``repair``, ``materialize``, ``report``,
``evaluate-labeled-pairs``, ``benchmark-detection``, ``benchmark-scale``, ``experiment``, ``demo``.

Each prints one line of JSON. ``repair``, ``materialize`` and ``report`` work on artifacts."""

from __future__ import annotations

import argparse
import json
import os
import sys

VERSION = "0.2.0"


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="twinsieve", description="Dataset integrity on Spark")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("version")
    for name in ("scan", "audit"):
        one = commands.add_parser(name)
        one.add_argument("dataset", help="image folder (split/class/file) or CSV manifest")
        one.add_argument("--config", help="YAML configuration")
        one.add_argument("--dataset-root", help="root of the paths of a CSV manifest")
        one.add_argument("--no-embeddings", action="store_true")
        one.add_argument("--output", help="audit artifact")
    one = commands.add_parser("repair")
    one.add_argument("audit", help="audit artifact")
    one.add_argument("--ratios", required=True, help="train,val,test")
    one.add_argument("--output", help="repair artifact")
    one.add_argument("--manifest", help="repaired CSV manifest")
    one.add_argument("--seed", type=int, default=42)
    one.add_argument("--iterations", type=int, default=250)
    one.add_argument("--size-weight", type=float, default=1.0)
    one.add_argument("--class-weight", type=float, default=1.0)
    one = commands.add_parser("materialize")
    one.add_argument("audit", help="audit artifact")
    one.add_argument("repair", help="repair artifact")
    one.add_argument("root", help="dataset root")
    one.add_argument("--output", required=True)
    one.add_argument("--mode", choices=("copy", "symlink"), default="copy")
    one = commands.add_parser("report")
    one.add_argument("audit", help="audit artifact")
    for name in ("repair", "detection", "scaling", "training"):
        one.add_argument(f"--{name}", help=f"{name} artifact")
    one.add_argument("--root", help="dataset root, for thumbnails")
    one.add_argument("--output", required=True, help="folder of the report")
    one = commands.add_parser("evaluate-labeled-pairs")
    for name in ("calibration", "evaluation", "root"):
        one.add_argument(name)
    one.add_argument("--minimum-precision", type=float, default=0.95)
    for name in ("benchmark-detection", "benchmark-scale"):
        one = commands.add_parser(name)
        one.add_argument("--config", help="YAML configuration")
        one.add_argument("--output", help="artifact")
        one.add_argument("--folder", help="work folder that all executors see")
    commands.choices["benchmark-detection"].add_argument("--sources", type=int)
    one = commands.add_parser("experiment")
    one.add_argument("rows", help="Parquet table: id, label, content (array of numbers)")
    one.add_argument("--config", help="YAML configuration")
    one.add_argument("--output", help="training artifact")
    commands.add_parser("demo").add_argument("folder")
    return parser


def _config(cls, path: str | None):
    from twinsieve.config import load_config

    return load_config(cls, path) if path else cls()


def _scan(spark, given) -> dict:
    from twinsieve.config import AuditConfig
    from twinsieve.sources.images import load_manifest, scan

    limit = _config(AuditConfig, given.config).io.max_image_pixels
    rows = scan(*load_manifest(spark, given.dataset, dataset_root=given.dataset_root), max_pixels=limit)
    found = rows.groupBy("issue").count().collect()
    return {"records": sum(r["count"] for r in found if r.issue is None), "issues": {r.issue: r["count"] for r in found if r.issue is not None}}


def _audit(spark, given) -> dict:
    from dataclasses import replace

    from twinsieve.config import AuditConfig, plain
    from twinsieve.plans.artifacts import write_audit
    from twinsieve.plans.audit import configured

    config = _config(AuditConfig, given.config)
    if given.no_embeddings:
        config = replace(config, embeddings=replace(config.embeddings, enabled=False))
    tables = configured(spark, given.dataset, config, dataset_root=given.dataset_root)
    out = tables["summary"].first().asDict()
    if given.output:
        out["sha256"] = write_audit(given.output, tables, plain(config), seeds=[config.repair.random_seed])
    return out


def _repair(spark, given) -> dict:
    from pyspark.sql import functions as F

    from twinsieve.operators.balance import normalise_ratios, repair_splits
    from twinsieve.plans import artifacts as A
    from twinsieve.sources.sinks import write_repaired_manifest

    audit = A.load_artifact(given.audit, "audit")
    records, members = A.records_of(spark, audit)
    ratios = normalise_ratios([float(x) for x in given.ratios.split(",")])
    weights = {"size_weight": given.size_weight, "class_weight": given.class_weight, "seed": given.seed}
    moved, plan = repair_splits(records, members, ratios, iterations=given.iterations, **weights)
    out = {"targets": plan.targets, "objective": plan.objective, "warnings": plan.warnings}
    out["moved"] = moved.where(F.col("original_split") != F.col("repaired_split")).count()
    if given.output:
        out["sha256"] = A.write_repair(given.output, audit, moved, plan, ratios, **weights)
    if given.manifest:
        out["manifest_sha256"] = write_repaired_manifest(given.manifest, records, moved)
    return out


def _materialize(spark, given) -> dict:
    from twinsieve.plans import artifacts as A
    from twinsieve.sources.sinks import materialise_dataset

    audit, repair = A.load_artifact(given.audit, "audit"), A.load_artifact(given.repair, "repair")
    A.check_pair(audit, repair)
    records, _ = A.records_of(spark, audit)
    names = ("record_id", "family_id", "original_split", "repaired_split")
    moved = spark.createDataFrame([tuple(x[n] for n in names) for x in repair["assignments"]], ", ".join(f"{n} string" for n in names))
    return materialise_dataset(given.root, records, moved, given.output, link=given.mode == "symlink")


def _report(spark, given) -> dict:
    from twinsieve.plans import artifacts as A
    from twinsieve.plans.report import write_artifact_report

    kinds = {"audit": "audit", "repair": "repair", "detection": "detection_benchmark", "scaling": "scaling_benchmark", "training": "training"}
    paths = {k: getattr(given, n) for n, k in kinds.items() if getattr(given, n)}
    places = {os.path.realpath(p) for p in paths.values()}
    if len(places) < len(paths) or any(os.path.dirname(p) == os.path.realpath(given.output) and p.endswith(("report.md", "report.html")) for p in places):
        raise A.ArtifactError("artifacts and report files must be different files")
    return write_artifact_report(spark, given.output, {k: A.load_artifact(p, k) for k, p in paths.items()}, root=given.root)


def _pairs(spark, given) -> dict:
    from twinsieve.sources.pairs import evaluate_pairs, load_fold

    folds = [load_fold(spark, path, given.root) for path in (given.calibration, given.evaluation)]
    return evaluate_pairs(*folds, minimum_precision=given.minimum_precision)


def _detection(spark, given) -> dict:
    from twinsieve.config import BenchmarkConfig, plain
    from twinsieve.operators.hashes import content_hash
    from twinsieve.operators.synthetic import PROVENANCE, detection_benchmark
    from twinsieve.plans import artifacts as A

    config = _config(BenchmarkConfig, given.config)
    n = given.sources or config.detection.source_count
    rows = detection_benchmark(
        spark, n, seed=config.seed, radius=config.detection.combined_phash_threshold, cosine=config.detection.combined_cosine_threshold,
        radii=list(config.detection.phash_thresholds), cosines=sorted(config.detection.cosine_thresholds),
    ).orderBy("detector", "corruption", "threshold")
    out: dict = {"rows": [r.asDict() for r in rows.collect()]}
    if given.output:
        meta = A.run_metadata(plain(config), content_hash({"seed": config.seed, "sources": n}), [config.seed])
        out["sha256"] = A.write_rows(given.output, "detection_benchmark", rows, meta, embedding_provenance=PROVENANCE)
    return out


def _scale(spark, given) -> dict:
    from twinsieve.config import BenchmarkConfig, plain
    from twinsieve.operators.hashes import content_hash
    from twinsieve.plans import artifacts as A
    from twinsieve.plans.scaling import scaling_benchmark

    config = _config(BenchmarkConfig, given.config)
    rows = scaling_benchmark(spark, config.scaling, folder=given.folder, seed=config.seed)
    out: dict = {"rows": [r.asDict() for r in rows.collect()]}
    if given.output:
        fixture = content_hash({"seed": config.seed, "sizes": list(config.scaling.dataset_sizes)})
        out["sha256"] = A.write_rows(given.output, "scaling_benchmark", rows, A.run_metadata(plain(config), fixture, [config.seed]))
    return out


def _experiment(spark, given) -> dict:
    from pyspark.sql import functions as F

    from twinsieve.config import ExperimentConfig, plain
    from twinsieve.operators import cohorts as C
    from twinsieve.operators.hashes import content_hash
    from twinsieve.plans import artifacts as A
    from twinsieve.runtime import materialise

    config = _config(ExperimentConfig, given.config)
    d = config.data
    rows = spark.read.parquet(given.rows).select("id", "label", "content")
    rows = rows.withColumn("digest", F.sha2(F.col("content").cast("string"), 256))
    nudged = lambda v: F.transform(v, lambda x: x * 0.9 + 0.01)
    sizes = C.Sizes(d.train_per_class, d.validation_per_class, d.test_per_class, d.contamination_per_class)
    splits, plan = C.controlled_splits(
        rows, sizes, kind="scaled", derive=nudged, seed=d.sampling_seed, size_weight=config.repair.split_size_weight,
        class_weight=config.repair.class_balance_weight, repair_seed=config.repair.seed, iterations=config.repair.local_iterations,
    )
    runs = materialise(C.run_experiment(splits, config.training.seeds), "runs")
    truth = [r.asDict() for r in splits.where("source_id IS NOT NULL").select("id", "source_id", "label").orderBy("id").collect()]
    out: dict = {"means": [r.asDict() for r in C.seed_means(runs).orderBy("condition", "cohort").collect()], "warnings": plan.warnings}
    if given.output:
        meta = A.run_metadata(plain(config), content_hash(sorted(r.id for r in splits.select("id").collect())), config.training.seeds)
        ordered = runs.orderBy("condition", "seed", "cohort", "label")
        out["sha256"] = A.write_rows(given.output, "training", ordered, meta, ground_truth_sha256=content_hash(truth))
    return out


def _demo(spark, given) -> dict:
    from twinsieve.plans.demo import run_demo

    return run_demo(spark, given.folder)


COMMANDS = {
    "scan": _scan, "audit": _audit, "repair": _repair, "materialize": _materialize, "report": _report, "evaluate-labeled-pairs": _pairs,
    "benchmark-detection": _detection, "benchmark-scale": _scale, "experiment": _experiment, "demo": _demo,
}


def main(arguments: list[str] | None = None) -> int:
    given = _parser().parse_args(arguments)
    if given.command == "version":
        print(VERSION)
        return 0
    from pyspark.sql import SparkSession

    from twinsieve.plans.artifacts import ArtifactError
    from twinsieve.plans.demo import DemoError
    from twinsieve.plans.report import scrubbed

    spark = SparkSession.builder.appName("twinsieve").getOrCreate()
    try:
        out = COMMANDS[given.command](spark, given)
    except (ValueError, OSError, ArtifactError, DemoError) as problem:
        print(f"error: {scrubbed(str(problem))}", file=sys.stderr)
        return 2
    print(json.dumps(out, sort_keys=True, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
