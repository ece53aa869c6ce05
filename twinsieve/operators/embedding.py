"""Embedding of distinct contents with a content-addressed Parquet cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from twinsieve.functions.images import decode, test_embedding
from twinsieve.runtime import materialise, ship_package

CACHE = "cache_key string, vec array<float>"


def cache_key(content_sha256: F.Column, model: str, preprocessing: str) -> F.Column:
    """SHA-256 of the canonical JSON of content, model and preprocessing."""
    body = F.concat(
        F.lit('{"content_sha256":"'), content_sha256,
        F.lit(f'","model_identity":"{model}","preprocessing_version":"{preprocessing}"}}'),
    )
    return F.sha2(body, 256)


def _embed(batches: Iterator[pa.RecordBatch], embed: Callable, dimension: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.asarray(embed([c.as_py() for c in batch.column("content")]), np.float64).reshape(-1, dimension)
        norms = np.linalg.norm(rows, axis=1, keepdims=True)
        if len(rows) != batch.num_rows or not np.isfinite(rows).all() or (norms == 0).any():
            raise ValueError("an embedder must give one finite vector other than zero for each content")
        vectors = (rows / norms).astype(np.float32).tolist()
        yield pa.RecordBatch.from_arrays(
            [batch.column("cache_key"), pa.array(vectors, pa.list_(pa.float32()))], names=["cache_key", "vec"]
        )


def embed_records(
    contents: DataFrame, cache_path: str, embed: Callable, *, model: str, preprocessing: str, dimension: int
) -> DataFrame:
    """``id, byte_sha256, vec`` for a table ``id, byte_sha256, content``.

    Each distinct content is embedded once (``embed``: list of bytes to rows); what the cache
    below ``cache_path`` has is not embedded again, what it lacks is appended. Cached
    vectors that are not of ``dimension`` finite numbers and unit length count as missing.
    """
    return embed_counted(contents, cache_path, embed, model=model, preprocessing=preprocessing, dimension=dimension)[0]


def _sound(cache: DataFrame, dimension: int) -> DataFrame:
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    fine = (F.size("vec") == dimension) & F.forall("vec", lambda x: ~F.isnan(x)) & (F.abs(F.sqrt(square) - 1) <= 1e-5)
    return cache.where(fine).dropDuplicates(["cache_key"])


def embed_counted(
    contents: DataFrame, cache_path: str, embed: Callable, *, model: str, preprocessing: str, dimension: int
) -> tuple[DataFrame, dict[str, int]]:
    """As ``embed_records``, with ``records``, ``distinct_contents``, ``cache_hits`` and ``cache_misses``."""
    spark = contents.sparkSession
    ship_package(spark)
    keyed = contents.withColumn("cache_key", cache_key(F.col("byte_sha256"), model, preprocessing))
    try:
        sound = _sound(spark.read.schema(CACHE).parquet(cache_path), dimension)
    except AnalysisException:
        sound = spark.createDataFrame([], CACHE)
    ids = materialise(keyed.select("id", "byte_sha256", "cache_key"), "embedding-ids")
    distinct = ids.select("cache_key").distinct()
    missing = materialise(distinct.join(sound.select("cache_key"), "cache_key", "left_anti"), "embedding-missing")
    new = keyed.select("cache_key", "content").join(missing, "cache_key", "left_semi").dropDuplicates(["cache_key"])
    counts = {"records": ids.count(), "distinct_contents": distinct.count(), "cache_misses": missing.count()}
    counts["cache_hits"] = counts["distinct_contents"] - counts["cache_misses"]
    new.mapInArrow(lambda it: _embed(it, embed, dimension), CACHE).write.mode("append").parquet(cache_path)
    known = _sound(spark.read.schema(CACHE).parquet(cache_path), dimension)
    return ids.join(known, "cache_key").drop("cache_key"), counts


class PixelEmbedder:
    """Vectors derived from a hash of the pixels: equal pictures have equal ones. For tests and
    timing; it stands for no model."""

    model_identity, preprocessing_version = "fake:sha256-expand-v1", "rgb-v1"

    def __init__(self, dimension: int = 16, seed: int = 0):
        self.dimension, self.seed = dimension, seed

    def __call__(self, contents: list[bytes]) -> np.ndarray:
        return np.array([test_embedding(decode(c), self.dimension, self.seed) for c in contents]).reshape(-1, self.dimension)


def embedder_of(backend: str, *, dimension: int = 16, seed: int = 0, custom: Callable | None = None) -> Callable:
    """The embedder of a configuration: ``fake``, or one that the caller gives. Models that are
    not installed here are refused."""
    if backend == "fake":
        return PixelEmbedder(dimension, seed)
    if custom is None:
        raise ValueError(f"no embedder for the backend {backend!r} is installed; give one")
    return custom
