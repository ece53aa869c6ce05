"""Timing of the stages of an audit over generated collections of several sizes."""

from __future__ import annotations

import os
import shutil
import tempfile
import time
import tracemalloc
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.operators import duplicates as D
from twinsieve.operators import synthetic as S
from twinsieve.runtime import materialise
from twinsieve.sources.images import image_folder, scan

# What memory figures cover, and the mode of the check by all pairs.
SCOPE = "python_allocations_via_tracemalloc"  # of the driver
BRUTE = "brute_force_reference_small_n_only"
ROW = (
    "dataset_size long, stage string, mode string, duration_seconds double, peak_memory_bytes long, memory_measurement_scope string, recall_at_k double"
)
# The stages that make up an audit.
AUDIT_STAGES = (
    "manifest_discovery", "image_validation_sha256", "phash_computation", "phash_index_build", "phash_query", "image_embedding",
    "embedding_index_build", "embedding_query",
)


def measured(work: Callable):
    """Result, seconds and peak of the driver's Python allocations of ``work()``."""
    mine = not tracemalloc.is_tracing()
    if mine:
        tracemalloc.start()
    tracemalloc.reset_peak()
    before, start = tracemalloc.get_traced_memory()[0], time.perf_counter()
    try:
        out = work()
        return out, time.perf_counter() - start, max(0, tracemalloc.get_traced_memory()[1] - before)
    finally:
        if mine:
            tracemalloc.stop()


class _Clock:
    def __init__(self, n: int):
        self.n, self.rows = n, []

    def time(self, stage: str, mode: str, work: Callable, recall: Callable | None = None):
        out, seconds, peak = measured(work)
        self.rows.append((self.n, stage, mode, seconds, peak, SCOPE, recall(out) if recall else None))
        return out


def compare_fingerprint_plans(clock: _Clock, records: DataFrame, radius: int, brute_force_max: int) -> None:
    """The block index, and all pairs for small tables; both must give the same pairs."""
    rows = materialise(records.where("fp IS NOT NULL").select("id", "fp"), "prints")
    clock.time("phash_index_build", "blocks_of_16_bits", lambda: materialise(D._classes(rows, "fp"), "classes").count())
    found = clock.time("phash_query", "blocks_of_16_bits", lambda: materialise(D.hamming_pairs(rows, radius, plan="blocks"), "pairs"))
    if clock.n <= brute_force_max:
        every = clock.time("phash_query", BRUTE, lambda: materialise(D.hamming_pairs(rows, radius, plan="loop"), "pairs"))
        if not found.exceptAll(every).isEmpty() or not every.exceptAll(found).isEmpty():
            raise RuntimeError("the index and all pairs differ")


def compare_neighbor_plans(clock: _Clock, vectors: DataFrame, k: int, threshold: float = -1.0) -> None:
    """Exact search, and codes with their recall against it; queries are one row in fifty."""
    queries = vectors.where(F.pmod(F.xxhash64("id"), F.lit(50)) == 0)
    clock.time("embedding_index_build", "exact", lambda: vectors.count())
    exact = clock.time("embedding_query", "exact", lambda: materialise(D.nearest_neighbors(vectors, queries, k, threshold=threshold), "exact"))
    clock.time(
        "embedding_query", "codes",
        lambda: materialise(D.approximate_neighbors(vectors, queries, k, threshold=threshold), "found"),
        lambda found: D.recall_at_k(exact, found).first().recall,
    )


def scale_run(spark: SparkSession, n: int, *, seed: int, radius: int = 8, dimension: int = 64, k: int = 10, brute_force_max: int = 1000, folder: str | None = None) -> list[tuple]:
    """Rows of one size: a collection of ``n`` images is written to ``folder`` (which all executors
    see; a temporary one on a local master) and each stage of an audit over it is timed."""
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("a cluster needs a folder that all executors see")
    base = folder or tempfile.mkdtemp(prefix="twinsieve-scale-")
    root = os.path.join(base, f"images-{n}")
    clock = _Clock(n)
    try:
        S.write_collection(spark, root, n, seed=seed)
        manifest = clock.time("manifest_discovery", "image_folder", lambda: materialise(image_folder(spark, root), "manifest"))
        seen = clock.time("image_validation_sha256", "scan_with_hash_and_vector", lambda: materialise(scan(manifest, root, dimension=dimension), "scan"))
        if not seen.where("issue IS NOT NULL").isEmpty() or seen.count() != n:
            raise RuntimeError("the generated collection does not scan clean")
        compare_fingerprint_plans(clock, seen, radius, brute_force_max)
        compare_neighbor_plans(clock, materialise(seen.select("id", "vec"), "vectors"), k)
        total = sum(r[3] for r in clock.rows if r[1] in AUDIT_STAGES and r[2] != BRUTE)
        clock.rows.append((n, "total_local_audit", "sum_of_audit_stages", total, None, None, None))
    finally:
        shutil.rmtree(root if folder else base, ignore_errors=True)
    return sorted(clock.rows, key=lambda r: (r[1], r[2]))


def scaling_benchmark(spark: SparkSession, config, *, folder: str | None = None, seed: int = 20260903) -> DataFrame:
    """Rows of all sizes of a ``Scaling`` configuration, by size, stage and mode."""
    rows = []
    for n in config.dataset_sizes:
        rows += scale_run(
            spark, n, seed=seed, radius=config.phash_radius, dimension=config.embedding_dimension, k=config.k,
            brute_force_max=config.brute_force_max_size, folder=folder,
        )
    return spark.createDataFrame(rows, ROW).orderBy("dataset_size", "stage", "mode")
