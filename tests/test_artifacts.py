"""Artifacts, configurations, reports, cohorts, scaling and the demo."""

import copy
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinsieve import config as C
from twinsieve.functions import images
from twinsieve.operators import cohorts, duplicates, hashes, synthetic
from twinsieve.operators.embedding import PixelEmbedder, embed_counted, embedder_of
from twinsieve.plans import artifacts as A
from twinsieve.plans import charts, scaling
from twinsieve.plans.demo import DemoError, run_demo
from twinsieve.sources import images as sources


@pytest.fixture(scope="module")
def demo(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("demo") / "out")
    return folder, run_demo(spark, folder)


# ---------------------------------------------------------------- artifacts


def test_demo_finds_what_it_planted(spark, demo):
    folder, out = demo
    assert out["files"] == 5 and out["summary"]["leakage_group_count"] == 1
    page = open(f"{folder}/report/report.html").read()
    assert page.count("<figure>") == 5 and folder not in page
    with pytest.raises(DemoError):
        run_demo(spark, folder)
    audit = A.load_artifact(f"{folder}/audit.json", "audit")
    assert {e["classification"] for e in audit["edges"]} == {"exact", "transformed_duplicate"}
    assert [i["code"] for i in audit["invalid_records"]] == ["malformed_image"]
    raw = open(f"{folder}/audit.json", "rb").read()
    assert raw == json.dumps(audit, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode() + b"\n"


def broken(body, path, value):
    out = copy.deepcopy(body)
    at = out
    for key in path[:-1]:
        at = at[key]
    if value is ...:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return out


AUDIT_FAULTS = [
    (("schema_version",), "2.0"), (("artifact_type",), "repair"), (("summary",), ...), (("records", 0, "extra"), 1), (("records", 0, "byte_sha256"), "x"),
    (("records", 0, "split"), "other"), (("edges", 0, "left_id"), "zzz"), (("edges", 0, "classification"), "semantic_candidate"),
    (("edges", 0, "confidence"), 2.0), (("families", 0, "member_ids"), ["b", "a"]), (("families", 0, "edge_count"), 0),
    (("leakage_groups", 0, "boundaries"), []), (("leakage_groups", 0, "label_conflict"), False), (("leakage_groups", 0, "splits"), ["train"]),
    (("label_conflicts", 0, "labels"), ["cat"]), (("summary", "valid_image_count"), 6), (("summary", "contaminated_evaluation_fraction"), 0.5),
    (("metadata", "timestamp"), "2020-01-01T00:00:00"), (("metadata", "dataset_manifest_sha256"), "x"), (("metadata", "random_seeds"), [2, 1]),
    (("metadata", "gpu_model"), "some"), (("records", 0), None), (("invalid_records", 0, "code"), "other"),
]


def test_audit_contracts(demo, tmp_path):
    audit = A.load_artifact(f"{demo[0]}/audit.json", "audit")
    for path, value in AUDIT_FAULTS:
        with pytest.raises(A.ArtifactError):
            A.check_artifact(broken(audit, path, value), "audit")
    with pytest.raises(A.ArtifactError):
        A.check_artifact(broken(audit, ("records",), audit["records"][::-1]), "audit")
    for text in ("", "[]", '{"a":1,"a":2}', '{"a":NaN}', "﻿{}"):
        (tmp_path / "a.json").write_text(text)
        with pytest.raises(A.ArtifactError) as problem:
            A.load_artifact(str(tmp_path / "a.json"), "audit")
        assert str(tmp_path) not in str(problem.value)


def test_repair_contracts(demo):
    audit, repair = (A.load_artifact(f"{demo[0]}/{n}.json", n) for n in ("audit", "repair"))
    A.check_pair(audit, repair)
    for path, value in (
        (("requested_ratios", 0, "ratio"), 0.9), (("requested_ratios", 0, "split"), "val"), (("integer_targets", 0), ["train", 1]),
        (("assignments", 0, "repaired_split"), "custom"), (("assignments", 0, "repaired_split"), "val"), (("split_size_weight",), -1),
        (("infeasibility_warnings",), ["b", "a"]), (("assignments", 0, "record_id"), "zzz"),
    ):
        with pytest.raises(A.ArtifactError):
            A.check_artifact(broken(repair, path, value), "repair")
    with pytest.raises(A.ArtifactError, match="another dataset"):
        A.check_pair(audit, broken(repair, ("metadata", "dataset_manifest_sha256"), "0" * 64))
    with pytest.raises(A.ArtifactError):
        A.check_pair(audit, broken(repair, ("assignments", 0, "original_split"), "custom"))


def test_row_contracts():
    meta = A.run_metadata({}, "0" * 64, [1])
    head = {"schema_version": "1.0", "metadata": meta}
    row = {"detector": "phash_hamming", "corruption": "resize", "threshold": 8.0, "tp": 3, "fp": 1, "fn": 0, "tn": 4, "precision": 0.75, "recall": 1.0, "f1": 6 / 7}
    detection = head | {"artifact_type": "detection_benchmark", "embedding_provenance": synthetic.PROVENANCE, "rows": [row]}
    A.check_artifact(detection, "detection_benchmark")
    for path, value in ((("rows", 0, "precision"), 0.7), (("rows", 0, "tp"), -1), (("rows", 0, "detector"), "fake_embedding"),
                        (("embedding_provenance", "backend"), "fake"), (("embedding_provenance", "model_identity"), "")):
        with pytest.raises(A.ArtifactError):
            A.check_artifact(broken(detection, path, value), "detection_benchmark")
    for bad in ({"backend": "dinov2", "is_synthetic": True}, {"backend": "dinov2", "is_synthetic": False, "model_revision": "main"}):
        with pytest.raises(A.ArtifactError):
            A.check_provenance(synthetic.PROVENANCE | bad)
    scale = {"dataset_size": 10, "stage": "s", "mode": "m", "duration_seconds": 1.0, "peak_memory_bytes": 5, "memory_measurement_scope": scaling.SCOPE, "recall_at_k": None}
    whole = head | {"artifact_type": "scaling_benchmark", "rows": [scale]}
    A.check_artifact(whole, "scaling_benchmark")
    for path, value in ((("rows", 0, "peak_memory_bytes"), None), (("rows", 0, "recall_at_k"), 1.5), (("rows", 0, "dataset_size"), 0)):
        with pytest.raises(A.ArtifactError):
            A.check_artifact(broken(whole, path, value), "scaling_benchmark")
    runs = [{"condition": c, "seed": 1, "cohort": k, "label": "a", "total": t, "correct": 1, "accuracy": 1 / t}
            for c in cohorts.CONDITIONS for k, t in (("all", 4), ("injected", 2), ("not_injected", 2))]
    for r in runs[::3]:
        r["correct"], r["accuracy"] = 2, 0.5
    training = head | {"artifact_type": "training", "rows": runs, "ground_truth_sha256": "0" * 64}
    A.check_artifact(training, "training")
    for path, value in ((("rows", 0, "accuracy"), 0.4), (("rows", 0, "correct"), 9), (("rows",), runs[:3]), (("ground_truth_sha256",), "x"), (("rows", 1, "total"), 3)):
        with pytest.raises(A.ArtifactError):
            A.check_artifact(broken(training, path, value), "training")


def test_snapshot_hash_is_of_the_canonical_rows(spark):
    rows = [("b", "p/é.png", "train", None, "s2", 3), ("a", 'q"\\\n.png', "val", "x", "s1", 2)]
    df = spark.createDataFrame(rows, "id string, path string, split string, label string, byte_sha256 string, byte_size long")
    issues = spark.createDataFrame([(None, "z.png", "test", None, "missing_path")], "record_id string, path string, split string, label string, code string")
    names = ("id", "path", "split", "label", "byte_sha256", "byte_size")
    plain = [dict(zip(names, r)) | {"width": None, "height": None, "format": None} for r in sorted(rows)]
    whole = {"schema": hashes.SCHEMA, "records": plain, "issues": [{"record_id": None, "path": "z.png", "split": "test", "label": None, "code": "missing_path"}]}
    assert hashes.snapshot_hash(df, issues) == hashes.content_hash(whole)


# ---------------------------------------------------------------- configurations


def test_configurations(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("phash:\n  hamming_threshold: 4\nneighbors:\n  index: flat\n  k: 500\n")
    found = C.load_config(C.AuditConfig, str(path))
    assert found.phash.hamming_threshold == 4 and found.neighbors.k == 500 and found.repair.train_ratio == 0.8
    path.write_text("")
    assert C.load_config(C.BenchmarkConfig, str(path)) == C.BenchmarkConfig()
    bad = {
        C.AuditConfig: [
            "other: 1", "phash: 3", "phash:\n  hamming_threshold: 65", "phash:\n  hamming_threshold: 1.5", "phash:\n  enabled: 1", "neighbors:\n  k: 65",
            "neighbors:\n  hnsw_m: 300", "repair:\n  train_ratio: 0.7", "repair:\n  split_size_weight: 0\n  class_balance_weight: 0",
            "repair:\n  local_improvement_patience: 251", "io:\n  cache_dir: /abs", "io:\n  cache_dir: a\\\\b", "1: 2", "[1]", "phash: {}\nphash: {}", "a: [",
            "report:\n  output_dir: ../x",
        ],
        C.BenchmarkConfig: [
            "detection:\n  phash_thresholds: [2, 1]", "detection:\n  cosine_thresholds: [0.1, 0.2]", "detection:\n  phash_thresholds: []",
            "detection:\n  embedding_backend: dinov2", "scaling:\n  dataset_sizes: [5, 5]", "scaling:\n  k: 65", "seed: -1", "detection:\n  source_count: 1",
        ],
        C.ExperimentConfig: ["data:\n  contamination: blur", "data:\n  contamination_per_class: 301", "training:\n  seeds: [1, 1]", "training:\n  seeds: []"],
    }
    for cls, texts in bad.items():
        for text in texts:
            path.write_text(text)
            with pytest.raises(C.ConfigError):
                C.load_config(cls, str(path))
    with pytest.raises(C.ConfigError):
        C.load_config(C.AuditConfig, str(tmp_path / "absent.yaml"))
    seen = C.from_environment(C.AuditConfig, {"TWINSIEVE_PHASH__HAMMING_THRESHOLD": "3", "TWINSIEVE_PHASH__ENABLED": "false", "OTHER": "1"})
    assert seen.phash == C.Phash(False, 3)
    with pytest.raises(C.ConfigError):
        C.from_environment(C.AuditConfig, {"TWINSIEVE_PHASH__HAMMING_THRESHOLD": "x"})


# ---------------------------------------------------------------- guards


def test_argument_guards(spark):
    df = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [0.0, 1.0])], "id string, vec array<float>")
    for radius in (-1, 65, 1.5, True):
        with pytest.raises(ValueError):
            duplicates.checked_radius(radius)
    for k in (0, -1, 2.0, True):
        with pytest.raises(ValueError):
            duplicates.nearest_neighbors(df, df, k)
    for threshold in (-1.1, 2, float("nan")):
        with pytest.raises(ValueError):
            duplicates.cosine_pairs(df, threshold)
    assert [round(x, 6) for x in duplicates.normalised(df).where("id = 'a'").first().vec] == [0.6, 0.8]
    for vec in ([0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], None, [1.0]):
        bad = spark.createDataFrame([("a", vec)], "id string, vec array<float>")
        with pytest.raises(Exception, match="vector"):
            duplicates.normalised(bad, dimension=2).collect()
    duplicates.refuse_repeated_ids(df)
    with pytest.raises(ValueError):
        duplicates.refuse_repeated_ids(df.union(df))
    exact = spark.createDataFrame([("a", "b"), ("a", "c")], "left_id string, right_id string")
    assert duplicates.recall_at_k(exact, exact.limit(1)).first().recall == 0.5
    assert duplicates.recall_at_k(exact.limit(0), exact).first().recall == 1.0
    with pytest.raises(Exception, match="stands twice"):
        duplicates.recall_at_k(exact, exact.union(exact)).collect()


# ---------------------------------------------------------------- corruptions as files


def test_corruption_tree(spark, tmp_path):
    root, out = tmp_path / "in", tmp_path / "out"
    synthetic.write_collection(spark, str(root), 12, seed=4)
    manifest = sources.image_folder(spark, str(root))
    seen = sources.scan(manifest, str(root)).where("split <> 'train'").persist()
    assert seen.count() == 2 and seen.where("issue IS NOT NULL").count() == 0 and sources.unaccounted(manifest.where("split <> 'train'"), seen).count() == 0
    truth = synthetic.write_corruptions(seen, str(root), str(out), seed=9)
    rows = truth.collect()
    assert len(rows) == 2 * 9 and {r.relationship for r in rows} == {"exact_duplicate", "transformed_duplicate", "invalid_image"}
    for r in rows:
        assert r.exact_bytes == (r.source_sha256 == r.derived_sha256) and os.path.exists(out / r.derived_path)
        assert (r.corruption == "cross_split_copy") == (r.source_split != r.target_split)
        assert (r.corruption == "cross_label_duplicate") == (r.source_label != r.target_label)
    entries = truth.select(F.col("derived_id").alias("id"), F.col("derived_path").alias("path"), F.col("target_split").alias("split"), F.col("target_label").alias("label"))
    derived = sources.scan(entries, str(out)).persist()
    assert {r.path.split(".")[-1] for r in derived.where("issue IS NOT NULL").collect()} == {"corrupt"}
    vectors = seen.select("id", "vec").union(derived.where("issue IS NULL").select("id", "vec"))
    observed = synthetic.observe_tree(truth, seen, derived, vectors).persist()
    assert observed.count() == 2 * 2 * 8 and synthetic.truth_mismatches(truth, observed).count() == 0
    assert synthetic.truth_mismatches(truth, observed.limit(31)).count() == 1
    for r in observed.collect():
        assert not (r.exact_match and not r.is_duplicate) and r.exact_match == (r.is_duplicate and r.corruption in synthetic.SAME_BYTES)
        if r.exact_match:
            assert r.distance == 0 and r.cosine > 0.999
    (root / seen.first().path).write_bytes(images.encode_png(synthetic.source_image(8, 8)))
    with pytest.raises(Exception, match="content changed"):
        sources.verified_contents(seen, str(root)).collect()


def test_contaminants_and_helpers():
    p = synthetic.source_image(2, 3, 32)
    for kind in ("resize", "jpeg"):
        out = synthetic.contaminant(p, kind)
        assert out.shape == p.shape and 0 < np.abs(out.astype(int) - p).mean() < 30
    assert [synthetic.next_split(s) for s in ("train", "val", "test", "custom")] == ["val", "test", "train", "train"]
    assert synthetic.other_label("conflicting_label") != "conflicting_label" and synthetic.other_label(None)
    flat = images.resize(np.full((9, 9, 3), 77, np.uint8), 5, 13, "bicubic")
    assert (flat == 77).all()


def test_generators(spark):
    v = np.array([r.vec for r in synthetic.unit_vectors(spark, 50, 8, seed=1).collect()])
    assert v.shape == (50, 8) and np.allclose(np.linalg.norm(v, axis=1), 1, atol=1e-6)
    again = np.array([r.vec for r in synthetic.unit_vectors(spark.newSession(), 50, 8, seed=1).orderBy("id").collect()])
    assert (again == v).all()
    prints = {r.number: r.fp for r in synthetic.chained_fingerprints(spark, 200).collect()}
    for i in range(1, 200):
        gap = bin((prints[i] ^ prints[i - 1]) & (1 << 64) - 1).count("1")
        assert (gap == 1) == (i % 23 == 1)


def test_embedding_counts(spark, tmp_path):
    contents = [(c, images.encode_png(synthetic.source_image(1, i, 8))) for c, i in (("a", 1), ("b", 1), ("c", 2))]
    df = spark.createDataFrame(contents, "id string, content binary").withColumn("byte_sha256", F.sha2("content", 256))
    e = embedder_of("fake", dimension=8)
    options = {"model": e.model_identity, "preprocessing": e.preprocessing_version, "dimension": 8}
    rows, counts = embed_counted(df, str(tmp_path / "c"), PixelEmbedder(8), **options)
    assert counts == {"records": 3, "distinct_contents": 2, "cache_misses": 2, "cache_hits": 0} and rows.count() == 3
    assert embed_counted(df, str(tmp_path / "c"), e, **options)[1]["cache_hits"] == 2
    with pytest.raises(ValueError):
        embedder_of("dinov2")


# ---------------------------------------------------------------- cohorts, charts, scaling


def test_experiment(spark):
    rng = np.random.default_rng(3)
    arrays, labels = rng.integers(0, 256, (60, 4, 4, 3)).astype(np.uint8), np.arange(60) % 3
    rows = cohorts.array_rows(spark, arrays, labels, name="x")
    sizes = cohorts.Sizes(train=9, val=3, test=5, contamination=2)
    halved = lambda v: F.transform(v, lambda x: x / 2)
    splits, plan = cohorts.controlled_splits(rows, sizes, kind="halved", derive=halved, seed=5)
    assert plan.targets["val"] == 0 and all(r.n == 0 for r in cohorts.violations(splits).collect())
    assert cohorts.cohort(splits, "contaminated", "injected").count() == 6
    assert cohorts.cohort(splits, "contaminated", "not_injected").count() == 15
    n_all = {c: cohorts.cohort(splits, c, "all").count() for c in cohorts.CONDITIONS}
    assert n_all["contaminated"] == n_all["repaired"] == 21
    runs = cohorts.run_experiment(splits, (1, 2), epochs=3, hidden=4).persist()
    assert all(r.n == 0 for r in cohorts.run_violations(runs, (1, 2)).collect())
    assert [r.n for r in cohorts.run_violations(runs, (1, 2, 3)).where("constraint = 'every_seed_has_each_condition'").collect()] == [2]
    means = {(r.condition, r.cohort): r for r in charts.evaluation_frame(runs).collect()}
    assert means["contaminated", "all"].n_seeds == 2 and 0 <= means["repaired", "all"].mean_accuracy <= 1
    assert charts.training_rows(runs).count() == len({(r.condition, r.seed, r.cohort) for r in runs.collect()})
    assert {(r.condition, r.injected) for r in charts.condition_rows(splits).collect() if r.split == "test"} >= {("contaminated", 6)}
    assert charts.truth_rows(splits).where("repaired <> source_repaired").count() == 0 and charts.truth_rows(splits).count() == 6
    virtual = cohorts.virtual_records(rows, split=F.lit("train"), height=4, width=4).first()
    assert virtual.format == "rgbarray" and virtual.byte_size == 48
    with pytest.raises(ValueError):
        cohorts.controlled_splits(rows, sizes, kind="same", derive=lambda v: v, seed=5)
    with pytest.raises(ValueError):
        cohorts.chosen_rows(rows, cohorts.Sizes(50, 3, 5, 2), seed=5)
    with pytest.raises(ValueError):
        cohorts.array_rows(spark, arrays.astype(float), labels, name="x")


def test_scaling_harness(spark):
    rows = scaling.scaling_benchmark(spark, C.Scaling(dataset_sizes=(30,), embedding_dimension=8, k=3), seed=2).collect()
    stages = {(r.stage, r.mode): r for r in rows}
    assert {r.stage for r in rows} == {*scaling.AUDIT_STAGES, "total_local_audit"} - {"phash_computation", "image_embedding"}
    parts = [r.duration_seconds for r in rows if r.stage in scaling.AUDIT_STAGES and r.mode != scaling.BRUTE]
    assert stages["total_local_audit", "sum_of_audit_stages"].duration_seconds == pytest.approx(sum(parts))
    assert stages["embedding_query", "codes"].recall_at_k >= 0.9 and ("phash_query", scaling.BRUTE) in stages
    shown = charts.scaling_rows(spark.createDataFrame(rows, scaling.ROW)).collect()
    assert len(shown) == len(rows) and any(r.recall_at_k == charts.DASH for r in shown)


def test_detection_frames(spark):
    rows = synthetic.detection_benchmark(spark, 3)
    frame = {(r.detector, r.threshold): r for r in charts.detection_frame(rows).collect()}
    assert frame["sha256_exact", None].recall == pytest.approx(3 / 8)
    shown = charts.detection_rows(rows).collect()
    assert [r.detector for r in shown] == sorted(r.detector for r in shown) and shown[-1].threshold == charts.DASH
    assert charts.provenance_rows(spark, synthetic.PROVENANCE).count() == 6


def test_representatives(spark):
    records = spark.createDataFrame([(c,) for c in "abcdef"], "id string")
    first = spark.createDataFrame([("1", "e"), ("2", "c"), ("2", "zz")], "o string, m string")
    second = spark.createDataFrame([("1", "c"), ("1", "d")], "o string, m string")
    got = [r.id for r in charts.representative_ids(records, [(first, "o", "m"), (second, "o", "m")], 5).orderBy("place").collect()]
    assert got == ["e", "c", "d", "a", "b"]
