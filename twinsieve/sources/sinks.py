"""Artifacts: canonical JSON and repaired manifests, published atomically; copied datasets."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.functions.identity import TARGETS
from twinsieve.runtime import materialise, ship_package
from twinsieve.sources.images import ROW, ManifestError, _normal_rows, manifest_line

# Fixed value: the header of a manifest.
HEADER = b"path,split,label\n"
EXTENSION = re.compile(r"[A-Za-z0-9]{1,16}")


def canonical_json(value) -> bytes:
    """Sorted keys, no blanks, no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


def _staged(path: str, parts) -> tuple[str, str]:
    """A temporary file beside ``path`` with the bytes of ``parts``, and their SHA-256."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder)
    whole = hashlib.sha256()
    try:
        with os.fdopen(handle, "wb") as file:
            for part in parts:
                whole.update(part)
                file.write(part)
            file.flush()
            os.fsync(file.fileno())
    except BaseException:
        os.unlink(temporary)
        raise
    return temporary, whole.hexdigest()


def publish(path: str, data) -> str:
    """Write bytes, or an iterator of bytes, by a temporary file and a rename; returns the SHA-256."""
    temporary, sha = _staged(path, [data] if isinstance(data, bytes) else data)
    try:
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise
    return sha


def publish_set(folder: str, files: dict[str, bytes]) -> dict[str, str]:
    """Replace the named files of ``folder`` together: all are staged first, what was there is
    kept aside, and if any step fails everything is as before. Other files are not touched."""
    os.makedirs(folder, exist_ok=True)
    aside = tempfile.mkdtemp(dir=folder, prefix=".aside-")
    staged, shas, saved, placed = {}, {}, [], []
    try:
        for name, data in files.items():
            staged[name], shas[name] = _staged(os.path.join(folder, name), [data])
        for name in files:
            target = os.path.join(folder, name)
            if os.path.isdir(target):
                raise IsADirectoryError(f"a folder stands where {name} belongs")
            if os.path.lexists(target):
                os.makedirs(os.path.dirname(os.path.join(aside, name)), exist_ok=True)
                os.replace(target, os.path.join(aside, name))
                saved.append(name)
            os.replace(staged[name], target)
            placed.append(name)
    except BaseException:
        for name in placed:
            os.unlink(os.path.join(folder, name))
        for name in saved:
            os.replace(os.path.join(aside, name), os.path.join(folder, name))
        for name, temporary in staged.items():
            if name not in placed:
                os.unlink(temporary)
        raise
    finally:
        shutil.rmtree(aside, ignore_errors=True)
    return shas


def write_artifact(path: str, kind: str, body: dict) -> str:
    return publish(path, canonical_json({"artifact_type": kind, "schema_version": "1.0", **body}) + b"\n")


def checked_assignments(records: DataFrame, assignments: DataFrame) -> DataFrame:
    """``records`` (path, split, label, ...) with their ``repaired_split``. The assignments must
    cover the records one to one, keep their original splits and name target splits."""
    for df, key in ((records, "id"), (assignments, "record_id")):
        if not df.groupBy(key).count().where("count > 1").isEmpty():
            raise ManifestError("a record stands twice")
    met = records.join(assignments, F.col("id") == F.col("record_id"), "full_outer")
    bad = F.col("id").isNull() | F.col("record_id").isNull() | (F.col("split") != F.col("original_split"))
    bad = bad | ~F.coalesce(F.col("repaired_split").isin(*TARGETS), F.lit(False))
    if not met.where(bad).isEmpty():
        raise ManifestError("assignments must cover the records exactly and keep their original splits")
    return met


def manifest_lines(rows: DataFrame) -> Iterator[bytes]:
    """The lines of a manifest (``path, split, label``) in canonical order. Rows are range-sorted
    by Spark and come to the driver one partition at a time."""
    ship_package(rows.sparkSession)
    normal = materialise(rows.select("path", "split", "label").mapInArrow(_normal_rows, ROW), "manifest-rows")
    twin = normal.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).where("n > 1").first()
    if twin is not None:
        raise ManifestError(f"duplicate logical path: {twin.path!r}")
    yield HEADER
    for r in normal.orderBy("fold", "path", "split", F.coalesce("label", F.lit(""))).toLocalIterator():
        yield manifest_line(r.path, r.split, r.label)


def write_repaired_manifest(path: str, records: DataFrame, assignments: DataFrame) -> str:
    """CSV of the new splits; records and assignments must match one to one."""
    met = checked_assignments(records.select("id", "path", "split", "label"), assignments)
    return publish(path, manifest_lines(met.select("path", F.col("repaired_split").alias("split"), "label")))


def _copy(batches: Iterator[pa.RecordBatch], root: str, staged: str, link: bool) -> Iterator[pa.RecordBatch]:
    """Copy or link the files of a batch and check their content; ``path`` is the new place."""
    for batch in batches:
        places = []
        for record, path, sha in zip(*(batch.column(c).to_pylist() for c in ("id", "path", "byte_sha256"))):
            ending = os.path.splitext(path)[1].lstrip(".")
            if not EXTENSION.fullmatch(ending):
                raise ManifestError("a file name has no plain extension")
            name = f"images/{record}.{ending.casefold()}"
            source, target = os.path.join(root, path), os.path.join(staged, name)
            if link:
                if not os.path.islink(target):
                    os.symlink(source, target)
            else:
                shutil.copyfile(source, target + ".part")
                os.replace(target + ".part", target)  # a task that runs again writes the same
            with open(target, "rb") as file:
                if hashlib.file_digest(file, "sha256").hexdigest() != sha:
                    raise ManifestError("content changed after the scan")
            places.append(name)
        yield pa.RecordBatch.from_arrays(
            [pa.array(places, pa.string()), batch.column("split"), batch.column("label")], names=["path", "split", "label"]
        )


def materialise_dataset(root: str, records: DataFrame, assignments: DataFrame, target: str, *, link: bool = False) -> dict:
    """A new folder ``target`` with ``images/<id>.<ext>`` and ``manifest.csv``; returns ``mode``,
    ``record_count``, ``verified_file_count`` and ``manifest_sha256``.

    Tasks copy (or link) the files of their rows into a stage beside ``target`` and check each
    content; the stage takes its name at the end or is removed. All executors must see both
    folders, which may not lie within each other."""
    base, place = os.path.realpath(root), os.path.realpath(target)
    if os.path.lexists(target):
        raise ManifestError("the output must not exist yet")
    if (place + os.sep).startswith(base + os.sep) or (base + os.sep).startswith(place + os.sep):
        raise ManifestError("the output and the dataset must not overlap")
    met = checked_assignments(records.select("id", "path", "split", "label", "byte_sha256"), assignments)
    rows = met.select("id", "path", F.col("repaired_split").alias("split"), "label", "byte_sha256")
    ship_package(records.sparkSession)
    staged = tempfile.mkdtemp(dir=os.path.dirname(place))
    try:
        os.chmod(staged, 0o755)
        os.mkdir(f"{staged}/images")
        copied = materialise(rows.mapInArrow(lambda it: _copy(it, base, staged, link), "path string, split string, label string"), "copied")
        n, sha = copied.count(), publish(f"{staged}/manifest.csv", manifest_lines(copied))
        os.rename(staged, place)
    except BaseException:
        shutil.rmtree(staged, ignore_errors=True)
        raise
    return {"mode": "symlink" if link else "copy", "record_count": n, "verified_file_count": n, "manifest_sha256": sha}
