"""A small dataset with known defects, and its audit, repair and report from end to end."""

from __future__ import annotations

import os
import shutil

import numpy as np
from pyspark.sql import SparkSession

from twinsieve.functions.images import encode_png, resize
from twinsieve.functions.jpeg import encode_jpeg
from twinsieve.operators.synthetic import source_image
from twinsieve.plans import artifacts as A
from twinsieve.plans.audit import audit, repair
from twinsieve.plans.report import write_artifact_report
from twinsieve.sources.sinks import materialise_dataset, write_repaired_manifest

RATIOS = {"train": 0.6, "val": 0.2, "test": 0.2}


class DemoError(RuntimeError):
    pass


def write_fixture(root: str, *, seed: int = 20260903) -> list[str]:
    """Six files: a source, its exact copy in another split, a JPEG and a smaller version of it,
    a copy under another label, and one that is no image."""
    picture = source_image(seed, 0, 96)
    png = encode_png(picture)
    files = {
        "train/cat/source.png": png, "test/cat/exact-copy.png": png, "test/cat/recompressed.jpg": encode_jpeg(picture, 85),
        "val/cat/smaller.png": encode_png(np.ascontiguousarray(resize(picture, 72, 72))), "val/dog/other-label.png": png,
        "train/cat/broken.png": b"this is no image",
    }
    for path, data in files.items():
        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
        with open(f"{root}/{path}", "wb") as file:
            file.write(data)
    return sorted(files)


def run_demo(spark: SparkSession, folder: str, *, seed: int = 20260903) -> dict:
    """Writes the fixture, artifacts, repaired manifest, copied dataset and report below ``folder``
    (which must not exist) and checks what is known about them."""
    if os.path.lexists(folder):
        raise DemoError("the output must not exist yet")
    try:
        root = f"{folder}/dataset"
        write_fixture(root, seed=seed)
        tables = audit(spark, root, radius=8, threshold=0.95)
        A.write_audit(f"{folder}/audit.json", tables, {"radius": 8, "threshold": 0.95}, seeds=[seed])
        found = A.load_artifact(f"{folder}/audit.json", "audit")
        moved, plan = repair(tables, RATIOS, seed=seed)
        A.write_repair(f"{folder}/repair.json", found, moved, plan, RATIOS, seed=seed)
        fixed = A.load_artifact(f"{folder}/repair.json", "repair")
        A.check_pair(found, fixed)
        sha = write_repaired_manifest(f"{folder}/repaired.csv", tables["records"], moved)
        copied = materialise_dataset(root, tables["records"], moved, f"{folder}/repaired")
        write_artifact_report(spark, f"{folder}/report", {"audit": found, "repair": fixed}, root=root)
        s = found["summary"]
        known = {
            "valid_image_count": 5, "invalid_image_count": 1, "leakage_group_count": 1, "cross_label_conflict_count": 1,
            "contaminated_image_count": 5,
        }
        wrong = sorted(k for k, v in known.items() if s[k] != v)
        splits = {x["repaired_split"] for x in fixed["assignments"]}
        if wrong or len(splits) != 1 or copied["record_count"] != 5:
            raise DemoError(f"the demo did not find what it planted: {', '.join(wrong) or 'repair'}")
        return {"summary": s, "objective": plan.objective, "manifest_sha256": sha, "files": copied["record_count"]}
    except BaseException:
        shutil.rmtree(folder, ignore_errors=True)
        raise
