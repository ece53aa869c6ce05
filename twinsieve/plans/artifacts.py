"""Artifacts as canonical JSON: run metadata, writing as a stream, strict reading, constraints."""

from __future__ import annotations

import datetime
import json
import math
import os
import platform
import re
import subprocess
from collections.abc import Iterator
from importlib import metadata as packages

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.functions.identity import BOUNDARIES, CLASSES, KINDS, SPLITS, TARGETS
from twinsieve.operators.hashes import content_hash, snapshot_hash
from twinsieve.sources.images import ISSUE_CODES
from twinsieve.sources.sinks import canonical_json, publish

VERSION = "1.0"
PACKAGES = ("numpy", "pandas", "pyarrow", "pyspark")
_SHA = re.compile("[0-9a-f]{64}")


class ArtifactError(ValueError):
    pass


def need(ok: bool, message: str) -> None:
    if not ok:
        raise ArtifactError(message)


# ------------------------------------------------------------------ metadata


def _git(*words: str) -> str | None:
    try:
        done = subprocess.run(["git", *words], capture_output=True, text=True, timeout=10, cwd=os.path.dirname(os.path.abspath(__file__)))
    except (OSError, subprocess.SubprocessError):
        return None
    return done.stdout.strip() if done.returncode == 0 else None


def safe_component(text: str) -> str:
    """A part of a provenance without blanks at its ends, control characters or host paths."""
    plain = re.sub(r"[\x00-\x1f\x7f]+", " ", text).strip()
    return "[private path]" if re.match(r"/|[A-Za-z]:[\\/]", plain) else plain[:512] or "unknown"


def run_metadata(configuration, dataset_sha256: str, seeds=()) -> dict:
    """Where, when and with what a run was made. No host path has a part in it."""
    versions = []
    for name in PACKAGES:
        try:
            versions.append({"name": name, "version": packages.version(name)})
        except packages.PackageNotFoundError:
            continue
    commit = _git("rev-parse", "HEAD")
    return {
        "timestamp": datetime.datetime.now(datetime.UTC).isoformat(),
        "git_commit_sha": commit if commit and re.fullmatch("[0-9a-f]{7,64}", commit) else None,
        "git_dirty": bool(_git("status", "--porcelain")) if commit else None,
        "python_version": platform.python_version(), "os": safe_component(platform.platform()),
        "cpu": safe_component(platform.processor() or platform.machine()), "cuda_available": False, "gpu_model": None,
        "package_versions": versions, "configuration_sha256": content_hash(configuration), "dataset_manifest_sha256": dataset_sha256,
        "random_seeds": sorted(set(seeds)),
    }


def check_metadata(m: dict) -> None:
    need(set(m) == set(run_metadata({}, "0" * 64)), "metadata fields")
    need(datetime.datetime.fromisoformat(m["timestamp"]).tzinfo is not None, "timestamp must include a timezone")
    for name in ("configuration_sha256", "dataset_manifest_sha256"):
        need(_SHA.fullmatch(m[name]) is not None, f"{name} must be a SHA-256")
    names = [p["name"] for p in m["package_versions"]]
    need(names == sorted(set(names), key=str.casefold), "packages must be unique and in order")
    need(m["random_seeds"] == sorted(set(m["random_seeds"])), "seeds must be unique and in order")
    need(m["cuda_available"] or m["gpu_model"] is None, "a GPU needs CUDA")
    need(m["git_commit_sha"] is None or re.fullmatch("[0-9a-f]{7,64}", m["git_commit_sha"]) is not None, "commit")


# ------------------------------------------------------------------ the audit


def audit_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The lists of an audit artifact as tables in their canonical order, one row an item."""
    members = tables["members"].groupBy("root").agg(F.array_sort(F.collect_set("id")).alias("member_ids"))
    evidence = F.struct("exact_match", "phash_distance", "cosine_similarity")
    ids = tables["families"].select("root", "family_id", "edge_count")
    pair = lambda b: F.struct(F.split(b, "-")[0].alias("left"), F.split(b, "-")[1].alias("right"))
    sure = tables["conflicts"].join(ids, "root").join(members, "root").select("family_id", "member_ids", F.split("labels", ",").alias("labels"), "kind")
    review = tables["semantic_conflicts"].select("family_id", F.split("members", ",").alias("member_ids"), F.split("labels", ",").alias("labels"), "kind")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    leaks = tables["leaks"].join(ids, "root").join(members, "root")
    fields = ["id", "path", "split", "label", "byte_sha256", "byte_size", "width", "height", "format"]
    return {
        "records": tables["records"].select(*fields, F.col("fp").alias("phash")).orderBy("id"),
        "invalid_records": tables["issues"].select(F.col("id").alias("record_id"), "path", "split", "label", "code").orderBy("record_id", "path", "split", "label", "code"),
        "edges": tables["edges"].select("left_id", "right_id", evidence.alias("evidence"), "classification", "decision", "confidence").orderBy("left_id", "right_id"),
        "families": ids.join(members, "root").select("family_id", "member_ids", "edge_count").orderBy("family_id"),
        "leakage_groups": leaks.select(
            "family_id", "member_ids", F.split("splits", ",").alias("splits"), F.transform("crossed", pair).alias("boundaries"),
            F.split("evidence", ",").alias("evidence_types"), F.col("strongest").alias("strongest_evidence"),
            F.when(F.col("labels") == "", F.array().cast("array<string>")).otherwise(F.split("labels", ",")).alias("labels"), "label_conflict",
        ).orderBy("family_id"),
        "label_conflicts": sure.unionByName(review).orderBy(rank, "family_id"),
    }


def audit_summary(tables: dict[str, DataFrame], reviews: DataFrame) -> dict:
    one = tables["summary"].first()
    return {
        "valid_image_count": tables["records"].count(), "invalid_image_count": tables["issues"].count(),
        "leakage_group_count": tables["leaks"].count(), "contaminated_image_count": one.contaminated_records,
        "evaluation_image_count": one.evaluation_records, "contaminated_evaluation_fraction": one.contaminated_fraction,
        "exact_leakage_group_count": one.exact_groups, "perceptual_leakage_group_count": one.transformed_groups,
        "embedding_only_review_count": reviews.count(),
        "cross_label_conflict_count": tables["conflicts"].count() + tables["semantic_conflicts"].count(),
    }


def _plain(value):
    if hasattr(value, "asDict"):
        return {k: _plain(v) for k, v in value.asDict().items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def artifact_stream(kind: str, body: dict) -> Iterator[bytes]:
    """The bytes of a canonical artifact; tables come from Spark row by row in their order."""
    whole = body | {"artifact_type": kind, "schema_version": VERSION}
    yield b"{"
    for n, name in enumerate(sorted(whole)):
        yield (b"," if n else b"") + canonical_json(name) + b":"
        if isinstance(whole[name], DataFrame):
            yield b"["
            for k, row in enumerate(whole[name].toLocalIterator()):
                yield (b"," if k else b"") + canonical_json(_plain(row))
            yield b"]"
        else:
            yield canonical_json(whole[name])
    yield b"}\n"


def write_audit(path: str, tables: dict[str, DataFrame], configuration, *, seeds=()) -> str:
    """Writes the audit artifact as a stream; returns its SHA-256."""
    from twinsieve.operators.evidence import semantic_reviews

    dataset = snapshot_hash(tables["records"], tables["issues"].withColumnRenamed("id", "record_id"))
    reviews = semantic_reviews(tables["records"], tables["edges"])
    body = audit_tables(tables) | {"metadata": run_metadata(configuration, dataset, seeds), "summary": audit_summary(tables, reviews)}
    return publish(path, artifact_stream("audit", body))


def write_repair(path: str, audit: dict, moved: DataFrame, plan, ratios: dict[str, float], *, size_weight=1.0, class_weight=1.0, seed=42) -> str:
    """Writes the repair artifact of an audit artifact; it carries the audit's dataset hash."""
    body = {
        "metadata": run_metadata({"seed": seed}, audit["metadata"]["dataset_manifest_sha256"], [seed]),
        "requested_ratios": [{"split": s, "ratio": ratios[s]} for s in TARGETS], "integer_targets": [[s, plan.targets[s]] for s in TARGETS],
        "split_size_weight": size_weight, "class_balance_weight": class_weight,
        "assignments": moved.select("record_id", "family_id", "original_split", "repaired_split").orderBy("record_id"),
        "excluded_invalid_ids": sorted({r["record_id"] for r in audit["invalid_records"] if r["record_id"]}),
        "infeasibility_warnings": sorted(set(plan.warnings)),
        "summary": {"split_size_error": plan.size_error, "class_divergence": plan.class_divergence, "objective": plan.objective},
    }
    return publish(path, artifact_stream("repair", body))


def write_rows(path: str, kind: str, rows: DataFrame, metadata: dict, **more) -> str:
    """Writes an artifact of one table (``detection_benchmark``, ``scaling_benchmark``, ``training``)."""
    return publish(path, artifact_stream(kind, {"metadata": metadata, "rows": rows, **more}))


# ------------------------------------------------------------------ reading

# Fields of each kind of artifact and of its rows.
FIELDS = {
    "audit": {"metadata", "records", "invalid_records", "edges", "families", "leakage_groups", "label_conflicts", "summary"},
    "repair": {
        "metadata", "requested_ratios", "integer_targets", "split_size_weight", "class_balance_weight", "assignments",
        "excluded_invalid_ids", "infeasibility_warnings", "summary",
    },
    "detection_benchmark": {"metadata", "embedding_provenance", "rows"},
    "scaling_benchmark": {"metadata", "rows"},
    "training": {"metadata", "rows", "ground_truth_sha256"},
}
ROWS = {
    "records": {"id", "path", "split", "label", "byte_sha256", "byte_size", "width", "height", "format", "phash"},
    "invalid_records": {"record_id", "path", "split", "label", "code"},
    "edges": {"left_id", "right_id", "evidence", "classification", "decision", "confidence"},
    "families": {"family_id", "member_ids", "edge_count"},
    "leakage_groups": {"family_id", "member_ids", "splits", "boundaries", "evidence_types", "strongest_evidence", "labels", "label_conflict"},
    "label_conflicts": {"family_id", "member_ids", "labels", "kind"},
    "assignments": {"record_id", "family_id", "original_split", "repaired_split"},
}


def _ordered(values: list, name: str) -> None:
    need(values == sorted(set(values)), f"{name} must be unique and in order")


def _no_twice(pairs):
    out = dict(pairs)
    need(len(out) == len(pairs), "a key stands twice")
    return out


def load_artifact(path: str, kind: str) -> dict:
    """The artifact as plain values, after every contract of its kind; ``ArtifactError`` names what
    is broken, never a path."""
    try:
        with open(path, "rb") as file:
            body = json.loads(file.read().decode(), parse_constant=lambda c: need(False, "no finite number"), object_pairs_hook=_no_twice)
    except (OSError, UnicodeDecodeError, json.JSONDecodeError) as problem:
        raise ArtifactError(f"the {kind} artifact cannot be read: {type(problem).__name__}") from None
    check_artifact(body, kind)
    return body


def check_artifact(body, kind: str) -> None:
    need(isinstance(body, dict) and body.get("artifact_type") == kind, f"no {kind} artifact")
    need(body.get("schema_version") == VERSION, "unknown schema version")
    need(set(body) - {"artifact_type", "schema_version"} == FIELDS[kind], f"fields of a {kind} artifact")
    try:
        check_metadata(body["metadata"])
        for name, fields in ROWS.items():
            for row in body.get(name, ()):
                need(isinstance(row, dict) and set(row) == fields, f"fields of {name}")
        CHECKS[kind](body)
    except (KeyError, TypeError, AttributeError, IndexError) as problem:
        raise ArtifactError(f"the {kind} artifact has values of a wrong type: {type(problem).__name__}") from None


def _check_audit(a: dict) -> None:
    _ordered([r["id"] for r in a["records"]], "records")
    _ordered([(e["left_id"], e["right_id"]) for e in a["edges"]], "edges")
    _ordered([f["family_id"] for f in a["families"]], "families")
    _ordered([g["family_id"] for g in a["leakage_groups"]], "leakage groups")
    known = {r["id"]: r for r in a["records"]}
    for r in a["records"]:
        need(r["split"] in SPLITS and _SHA.fullmatch(r["byte_sha256"]) is not None and r["byte_size"] >= 0, "a record's values")
        need(r["phash"] is None or 0 <= r["phash"] < 1 << 64, "a record's hash")
    need(all(i["code"] in ISSUE_CODES for i in a["invalid_records"]), "unknown issue code")
    for e in a["edges"]:
        v = e["evidence"]
        need(e["left_id"] < e["right_id"] and e["left_id"] in known and e["right_id"] in known, "an edge's ends")
        kind = CLASSES[0] if v["exact_match"] else CLASSES[1] if v["phash_distance"] is not None else CLASSES[2]
        need(v["exact_match"] or v["phash_distance"] is not None or v["cosine_similarity"] is not None, "an edge without a signal")
        need(e["classification"] == kind and e["decision"] in ("definite", "review") and 0 <= e["confidence"] <= 1, "an edge's class")
    owner: dict[str, str] = {}
    for f in a["families"]:
        _ordered(f["member_ids"], "members")
        need(len(f["member_ids"]) > 1 and f["edge_count"] > 0 and set(f["member_ids"]) <= set(known), "a family's members")
        for m in f["member_ids"]:
            need(owner.setdefault(m, f["family_id"]) == f["family_id"], "a record in two families")
    names = [f"{x}-{y}" for x, y in BOUNDARIES]
    for g in a["leakage_groups"]:
        splits = {known[m]["split"] for m in g["member_ids"]}
        crossed = [b for b in names if set(b.split("-")) <= splits]
        need([f"{b['left']}-{b['right']}" for b in g["boundaries"]] == crossed and crossed, "a leakage group's boundaries")
        need(g["splits"] == [s for s in SPLITS if s in splits], "a leakage group's splits")
        need(g["evidence_types"] and g["strongest_evidence"] == g["evidence_types"][0] and g["strongest_evidence"] != CLASSES[2], "strongest evidence")
        labels = sorted({known[m]["label"] for m in g["member_ids"]} - {None})
        need(g["labels"] == labels and g["label_conflict"] == (len(labels) > 1), "a leakage group's labels")
    for c in a["label_conflicts"]:
        _ordered(c["labels"], "labels")
        need(len(c["labels"]) > 1 and c["kind"] in KINDS, "a conflict")
    need([KINDS.index(c["kind"]) for c in a["label_conflicts"]] == sorted(KINDS.index(c["kind"]) for c in a["label_conflicts"]), "order of conflicts")
    s = a["summary"]
    dirty = {m for g in a["leakage_groups"] for m in g["member_ids"]}
    held = {r["id"] for r in a["records"] if r["split"] in ("val", "test")}
    share = len(dirty & held) / len(held) if held else 0.0
    counts = {
        "valid_image_count": len(a["records"]), "invalid_image_count": len(a["invalid_records"]), "leakage_group_count": len(a["leakage_groups"]),
        "contaminated_image_count": len(dirty), "evaluation_image_count": len(held),
        "exact_leakage_group_count": sum(g["strongest_evidence"] == CLASSES[0] for g in a["leakage_groups"]),
        "perceptual_leakage_group_count": sum(g["strongest_evidence"] == CLASSES[1] for g in a["leakage_groups"]),
        "cross_label_conflict_count": len(a["label_conflicts"]),
    }
    need(all(s[k] == n for k, n in counts.items()), "summary counts do not follow from the tables")
    need(math.isclose(s["contaminated_evaluation_fraction"], share, rel_tol=0, abs_tol=1e-12), "the contaminated fraction")


def _check_repair(r: dict) -> None:
    need([x["split"] for x in r["requested_ratios"]] == list(TARGETS), "ratios must be of train, val and test in order")
    need(math.isclose(sum(x["ratio"] for x in r["requested_ratios"]), 1, rel_tol=0, abs_tol=1e-9), "ratios must sum to one")
    need([s for s, _ in r["integer_targets"]] == list(TARGETS), "targets must be of train, val and test in order")
    need(sum(n for _, n in r["integer_targets"]) == len(r["assignments"]), "targets must sum to the assignments")
    need(r["split_size_weight"] >= 0 and r["class_balance_weight"] >= 0 and r["split_size_weight"] + r["class_balance_weight"] > 0, "weights")
    _ordered([x["record_id"] for x in r["assignments"]], "assignments")
    homes: dict[str, str] = {}
    for x in r["assignments"]:
        need(x["original_split"] in SPLITS and x["repaired_split"] in TARGETS, "an assignment's splits")
        need(homes.setdefault(x["family_id"], x["repaired_split"]) == x["repaired_split"], "a family is divided")
    _ordered(r["excluded_invalid_ids"], "excluded ids")
    _ordered(r["infeasibility_warnings"], "warnings")


def detector_name(p: dict) -> str:
    """The detector's label, which says what made the vectors (fixed values)."""
    import hashlib

    if p["backend"] == "fake":
        return "synthetic_fake_embedding_cosine_not_dinov2"
    if p["backend"] == "dinov2":
        return f"dinov2_embedding_cosine@{p['model_revision'][:12]}"
    return f"custom_embedding_cosine@{hashlib.sha256(p['model_identity'].encode()).hexdigest()[:12]}"


def check_provenance(p: dict) -> None:
    need(set(p) == {"backend", "model_identity", "model_revision", "preprocessing_version", "device", "is_synthetic"}, "provenance fields")
    need(p["backend"] in ("fake", "dinov2", "custom") and p["device"] in ("cpu", "cuda"), "provenance values")
    need(bool(p["model_identity"]) and bool(p["preprocessing_version"]), "provenance is incomplete")
    if p["backend"] == "fake":
        need(p["is_synthetic"] and p["model_identity"].startswith("fake:") and p["model_revision"] is None and p["device"] == "cpu", "fake provenance")
    if p["backend"] == "dinov2":
        need(not p["is_synthetic"] and re.fullmatch("[0-9a-f]{40}", p["model_revision"] or "") is not None, "a model needs an immutable revision")
        need(f"@{p['model_revision']}" in p["model_identity"], "the model's identity must contain its revision")


def _check_detection(d: dict) -> None:
    check_provenance(d["embedding_provenance"])
    name = detector_name(d["embedding_provenance"])
    for r in d["rows"]:
        tp, fp, fn = r["tp"], r["fp"], r["fn"]
        p, c = tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn) if tp + fn else 0.0
        f1 = 2 * p * c / (p + c) if p + c else 0.0
        need(min(tp, fp, fn) >= 0, "counts must not be negative")
        need(all(math.isclose(r[k], v, rel_tol=0, abs_tol=1e-12) for k, v in (("precision", p), ("recall", c), ("f1", f1))), "rates do not follow from the counts")
        need("embedding" not in r["detector"] or name in r["detector"], "a detector's name must follow from the provenance")


def _check_scaling(s: dict) -> None:
    for r in s["rows"]:
        need(r["dataset_size"] > 0 and r["duration_seconds"] >= 0, "a scaling row's values")
        need((r["peak_memory_bytes"] is None) == (r["memory_measurement_scope"] is None), "memory and its scope go together")
        need(r["recall_at_k"] is None or 0 <= r["recall_at_k"] <= 1, "recall lies in 0..1")


def _check_training(t: dict) -> None:
    seen: dict[tuple, set] = {}
    sums: dict[tuple, list[int]] = {}
    for r in t["rows"]:
        need(0 <= r["correct"] <= r["total"], "correct cannot exceed total")
        need(math.isclose(r["accuracy"], r["correct"] / r["total"] if r["total"] else 0.0, rel_tol=0, abs_tol=1e-12), "accuracy does not match its counts")
        seen.setdefault(r["seed"], set()).add(r["condition"])
        for k, v in (("total", r["total"]), ("correct", r["correct"])):
            sums.setdefault((r["seed"], r["condition"], r["label"], k), [0, 0])[r["cohort"] != "all"] += v
    need(all(c == {"contaminated", "repaired"} for c in seen.values()), "every seed needs a run of each condition")
    need(all(a == b for a, b in sums.values()), "cohorts must sum to all rows")
    need(_SHA.fullmatch(t["ground_truth_sha256"]) is not None, "the truth's hash")


CHECKS = {
    "audit": _check_audit, "repair": _check_repair, "detection_benchmark": _check_detection, "scaling_benchmark": _check_scaling,
    "training": _check_training,
}


def check_pair(audit: dict, repair: dict) -> None:
    """A repair must be one of this audit: same dataset, same records, same original splits."""
    need(audit["metadata"]["dataset_manifest_sha256"] == repair["metadata"]["dataset_manifest_sha256"], "the repair is of another dataset")
    splits = {r["id"]: r["split"] for r in audit["records"]}
    need({x["record_id"]: x["original_split"] for x in repair["assignments"]} == splits, "the repair must cover the audit's records")


def records_of(spark: SparkSession, audit: dict) -> tuple[DataFrame, DataFrame]:
    """``records`` and ``members`` of an audit artifact as tables."""
    schema = "id string, path string, split string, label string, byte_sha256 string, byte_size long"
    names = [c.split()[0] for c in schema.split(", ")]
    rows = [tuple(r[n] for n in names) for r in audit["records"]]
    members = [(m, f["member_ids"][0]) for f in audit["families"] for m in f["member_ids"]]
    return spark.createDataFrame(rows, schema), spark.createDataFrame(members, "id string, root string")


