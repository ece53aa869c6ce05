"""Controlled corruptions with known truth, and the detector benchmark over them."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from twinsieve.functions.identity import TARGETS, stable_id
from twinsieve.functions.images import decode, encode_png, gray, on_white, perceptual_hash, resize, sniff
from twinsieve.functions.jpeg import decode_jpeg, encode_jpeg
from twinsieve.operators.metrics import pair_metrics, sweep
from twinsieve.runtime import materialise, ship_package
from twinsieve.sources.images import read_within

# Kinds of corruption; the first three leave the bytes as they are, the last is no image.
SAME_BYTES = ("exact_copy", "cross_split_copy", "cross_label_duplicate")
TRANSFORMED = ("jpeg_recompression", "resize", "small_crop", "brightness_shift", "gaussian_blur")
KINDS = (*SAME_BYTES, *TRANSFORMED)
MALFORMED = "malformed_file"
ALL_KINDS = (*KINDS, MALFORMED)
RELATIONSHIPS = {k: "exact_duplicate" for k in SAME_BYTES} | {k: "transformed_duplicate" for k in TRANSFORMED} | {MALFORMED: "invalid_image"}
# Strength of each corruption, from the first byte p of its parameters.
JPEG_QUALITY = lambda p: 68 + p % 11
RESIZE_SCALE = lambda p: 0.68 + p % 13 / 100
CROP_PART = 16
BRIGHTNESS = (0.78, 1.22)
BLUR_RADIUS = lambda p: 0.8 + p % 8 / 10
TRIES = 16
RADII = [0, 2, 4, 6, 8, 12]
COSINES = [0.8, 0.9, 0.95, 0.97, 0.99]


def source_image(seed: int, number: int, size: int = 48) -> np.ndarray:
    """A smooth image of its own for each number."""
    coarse = np.random.default_rng([seed, number]).integers(0, 256, (6, 6, 3)).astype(np.uint8)
    return resize(coarse, size, size)


def _blur(pixels: np.ndarray, radius: float) -> np.ndarray:
    reach = int(3 * radius + 1)
    taps = np.exp(-0.5 * (np.arange(-reach, reach + 1) / radius) ** 2)
    taps /= taps.sum()
    out = pixels.astype(np.float64)
    for axis in (0, 1):
        pad = [(reach, reach) if a == axis else (0, 0) for a in range(3)]
        wide = np.pad(out, pad, mode="edge")
        out = sum(t * np.take(wide, range(k, k + pixels.shape[axis]), axis=axis) for k, t in enumerate(taps))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def parameters(seed: int, name: str, kind: str) -> bytes:
    return hashlib.sha256(f"{seed}\0{name}\0{kind}".encode()).digest()


def _transform(pixels: np.ndarray, kind: str, p: int) -> np.ndarray:
    height, width, _ = pixels.shape
    if kind == "jpeg_recompression":
        return decode_jpeg(encode_jpeg(pixels, JPEG_QUALITY(p)))
    if kind == "resize":
        shrunk = lambda n: max(1, min(n - 1, round(n * RESIZE_SCALE(p))))
        return resize(pixels, shrunk(width), shrunk(height))
    if kind == "small_crop":
        dx, dy = (min(max(1, n // CROP_PART), max(0, (n - 1) // 2)) for n in (width, height))
        return np.ascontiguousarray(pixels[dy : height - dy, dx : width - dx])
    if kind == "brightness_shift":
        return np.clip(np.rint(pixels * BRIGHTNESS[p % 2]), 0, 255).astype(np.uint8)
    if kind == "gaussian_blur":
        return _blur(pixels, BLUR_RADIUS(p))
    raise ValueError(f"unknown corruption {kind!r}")


def corrupt(pixels: np.ndarray, kind: str, seed: int, name: str) -> np.ndarray:
    """The corrupted image; its strength follows from seed, name and kind."""
    return pixels if kind in SAME_BYTES else _transform(pixels, kind, parameters(seed, name, kind)[0])


def corrupted_file(data: bytes, pixels: np.ndarray, kind: str, seed: int, name: str) -> tuple[bytes, str]:
    """Content and extension of a corrupted file. A transformed one must differ from its
    source in its bytes; other strengths are tried up to ``TRIES`` times."""
    if kind in SAME_BYTES:
        return data, {"jpeg": "jpg"}.get(sniff(data), sniff(data))
    own = parameters(seed, name, kind)
    if kind == MALFORMED:
        return b"not an image\0" + own + name.encode(), "corrupt"
    for n in range(TRIES):
        p = own if not n else hashlib.sha256(own + n.to_bytes(2, "big")).digest()
        if kind == "jpeg_recompression":
            out = encode_jpeg(on_white(pixels), JPEG_QUALITY(p[0])), "jpg"
        else:
            out = encode_png(_transform(pixels, kind, p[0])), "png"
        if out[0] != data:
            return out
    raise ValueError(f"{kind} of {name} gives its source again")


def next_split(split: str) -> str:
    """The target split after this one, in a circle; ``train`` after ``custom``."""
    return TARGETS[(TARGETS.index(split) + 1) % 3] if split in TARGETS else TARGETS[0]


def other_label(label: str | None) -> str:
    return "conflicting_label" if label != "conflicting_label" else "conflicting_label_2"


def contaminant(pixels: np.ndarray, kind: str) -> np.ndarray:
    """A near copy of a small image: shrunk and enlarged again, or through a JPEG."""
    height, width = pixels.shape[:2]
    if kind == "resize":  # 32 pixels to 27 and back
        small = resize(pixels, max(1, width * 27 // 32), max(1, height * 27 // 32), "bilinear")
        return resize(small, width, height, "bicubic")
    if kind == "jpeg":
        return decode_jpeg(encode_jpeg(pixels, 62))
    raise ValueError(f"unknown contamination {kind!r}")


# ------------------------------------------------------------------ a tree of corruptions

TRUTH = (
    "source_id string, source_path string, source_sha256 string, source_split string, source_label string, corruption string, "
    "derived_id string, derived_path string, derived_sha256 string, target_split string, target_label string, "
    "relationship string, is_duplicate boolean, exact_bytes boolean, valid_image boolean"
)


def _corrupt_files(batches: Iterator[pa.RecordBatch], root: str, out: str, seed: int, kinds: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in TRUTH.split(", ")]
    for batch in batches:
        rows = []
        for source in batch.to_pylist():
            data = read_within(root, source["path"])
            if hashlib.sha256(data).hexdigest() != source["byte_sha256"]:
                raise ValueError("content changed after the scan")
            pixels = decode(data)
            for kind in kinds:
                body, ending = corrupted_file(data, pixels, kind, seed, source["id"])
                split = next_split(source["split"]) if kind == "cross_split_copy" else source["split"]
                label = other_label(source["label"]) if kind == "cross_label_duplicate" else source["label"]
                path = f"{split}/{label or 'unlabeled'}/{source['id']}-{kind}.{ending}"
                place = os.path.join(out, path)
                os.makedirs(os.path.dirname(place), exist_ok=True)
                with open(place + ".part", "wb") as file:
                    file.write(body)
                os.replace(place + ".part", place)
                rows.append((
                    source["id"], source["path"], source["byte_sha256"], source["split"], source["label"], kind, None, path,
                    hashlib.sha256(body).hexdigest(), split, label, RELATIONSHIPS[kind], kind in KINDS, kind in SAME_BYTES, kind in KINDS,
                ))
        columns = list(zip(*rows)) or [()] * len(names)
        types = [pa.bool_() if " boolean" in c else pa.string() for c in TRUTH.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def write_corruptions(records: DataFrame, root: str, out: str, *, seed: int, kinds: tuple[str, ...] = ALL_KINDS) -> DataFrame:
    """Each record's image in each of ``kinds`` as files below ``out`` (a folder that all executors
    see), and the truth about each: a row with source, derived file and their relationship.
    Sources are checked against their recorded content."""
    if not kinds or set(kinds) - set(ALL_KINDS):
        raise ValueError("unknown corruptions")
    ship_package(records.sparkSession)
    rows = records.select("id", "path", "byte_sha256", "split", "label")
    made = rows.mapInArrow(lambda it: _corrupt_files(it, os.path.abspath(root), os.path.abspath(out), seed, tuple(kinds)), TRUTH)
    return materialise(made.withColumn("derived_id", stable_id("img", F.col("derived_path"))), "truth")


def negative_controls(truth: DataFrame) -> DataFrame:
    """``truth`` of valid images with ``left_id`` and ``right_id``: each source with its own
    derived file, and (``is_duplicate`` false) with that of the next source, in a circle by id."""
    valid = truth.where("valid_image")
    sources = valid.select("source_id").distinct().orderBy("source_id")
    ranked = materialise(sources.withColumn("at", F.monotonically_increasing_id()), "sources")
    after = Window.orderBy("at")  # the sources of a benchmark are few
    following = F.coalesce(F.lead("source_id").over(after), F.first("source_id").over(after))
    if ranked.count() < 2:
        raise ValueError("controls need two sources")
    pairs = ranked.select(F.col("source_id").alias("left_id"), following.alias("source_id"))
    own = valid.select(F.col("source_id").alias("left_id"), F.col("derived_id").alias("right_id"), "corruption", "is_duplicate", "exact_bytes")
    other = pairs.join(valid, "source_id").select("left_id", F.col("derived_id").alias("right_id"), "corruption")
    controls = other.withColumns({"is_duplicate": F.lit(False), "exact_bytes": F.lit(False)})
    return own.unionByName(controls)


def observe_tree(truth: DataFrame, sources: DataFrame, derived: DataFrame, vectors: DataFrame) -> DataFrame:
    """Observations of true pairs and controls: ``left_id, right_id, corruption, is_duplicate,
    exact_match, distance, cosine``. ``sources`` and ``derived`` are scanned records, ``vectors``
    ``id, vec`` of both; the payloads of both ends are joined by id."""
    one = lambda df, end, k: df.select(F.col("id").alias(end), F.col("byte_sha256").alias(f"s{k}"), F.col("fp").alias(f"f{k}"))
    vector = lambda end, k: vectors.select(F.col("id").alias(end), F.col("vec").alias(f"v{k}"))
    met = negative_controls(truth).join(one(sources, "left_id", 1), "left_id").join(one(derived, "right_id", 2), "right_id")
    met = met.join(vector("left_id", 1), "left_id", "left").join(vector("right_id", 2), "right_id", "left")
    dot = F.aggregate(F.zip_with("v1", "v2", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    return met.select(
        "left_id", "right_id", "corruption", "is_duplicate", (F.col("s1") == F.col("s2")).alias("exact_match"),
        F.bit_count(F.col("f1").bitwiseXOR(F.col("f2"))).cast("int").alias("distance"),
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)).alias("cosine"),
    )


def truth_mismatches(truth: DataFrame, observed: DataFrame) -> DataFrame:
    """Pairs of the truth that were not observed, or the other way round (no rows if all is well)."""
    key = ["left_id", "right_id", "corruption", "is_duplicate"]
    want, got = negative_controls(truth).select(*key), observed.select(*key)
    missing = want.exceptAll(got).withColumn("what", F.lit("not observed"))
    return missing.unionByName(got.exceptAll(want).withColumn("what", F.lit("not in the truth")))


def thumbnail_vector(pixels: np.ndarray) -> np.ndarray:
    """A plain embedding: the centred 8 x 8 gray thumbnail, of unit length."""
    small = resize(gray(pixels), 8, 8).astype(np.float64).reshape(-1)
    small -= small.mean()
    return small / (np.linalg.norm(small) or 1.0)


def _observe(batches: Iterator[pa.RecordBatch], n: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i in batch.column("id").to_pylist():
            left = source_image(seed, i)
            sha, mark, vector = hashlib.sha256(encode_png(left)).digest(), perceptual_hash(left), thumbnail_vector(left)
            for kind in KINDS:
                for j in (i, (i + 1) % n):  # the true pair, and its control from the next source
                    right = corrupt(source_image(seed, j), kind, seed, str(j))
                    rows.append((
                        i, j, kind, i == j, hashlib.sha256(encode_png(right)).digest() == sha,
                        (perceptual_hash(right) ^ mark).bit_count(), float(np.clip(thumbnail_vector(right) @ vector, -1, 1)),
                    ))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.int32(), pa.float64()]
        names = ["source", "other", "corruption", "is_duplicate", "exact_match", "distance", "cosine"]
        columns = list(zip(*rows)) if rows else [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def observations(spark: SparkSession, n: int, *, seed: int = 20260903) -> DataFrame:
    """A true pair and a negative control for each of ``n`` sources and each kind. The truth
    comes from how a pair was made, never from a detector."""
    if n < 2:
        raise ValueError("controls need two sources")
    ship_package(spark)
    return spark.range(n).mapInArrow(
        lambda it: _observe(it, n, seed),
        "source long, other long, corruption string, is_duplicate boolean, exact_match boolean, distance int, cosine double",
    )


#: What makes the vectors of the benchmark: a plain function of the pixels, no model.
PROVENANCE = {
    "backend": "custom", "model_identity": "custom:gray-thumbnail-8x8", "model_revision": None, "preprocessing_version": "gray-8x8-v1",
    "device": "cpu", "is_synthetic": True,
}
COSINE_DETECTOR = "custom_embedding_cosine@" + hashlib.sha256(PROVENANCE["model_identity"].encode()).hexdigest()[:12]


def detection_benchmark(
    spark: SparkSession, n: int = 16, *, seed: int = 20260903, radius: int = 8, cosine: float = 0.95, radii: list[int] = RADII,
    cosines: list[float] = COSINES,
) -> DataFrame:
    """``detector, corruption, threshold, tp, fp, fn, tn, precision, recall, f1``."""
    pairs = materialise(observations(spark, n, seed=seed), "observations")
    named = lambda df, name: df.withColumn("detector", F.lit(name)).withColumn("threshold", F.col("threshold").cast("double"))
    single = lambda hit: pair_metrics(pairs, hit, "corruption").withColumn("threshold", F.lit(None))
    both = F.col("exact_match") | (F.col("distance") <= radius) | (F.col("cosine") >= cosine)
    out = named(single(F.col("exact_match")), "sha256_exact")
    for part in (
        named(sweep(pairs, radii, lambda t: F.col("distance") <= t, "corruption"), "phash_hamming"),
        named(sweep(pairs, cosines, lambda t: F.col("cosine") >= t, "corruption"), COSINE_DETECTOR),
        named(single(both), f"combined_exact_phash_plus_{COSINE_DETECTOR}"),
    ):
        out = out.unionByName(part)
    return out.select("detector", "corruption", "threshold", "tp", "fp", "fn", "tn", "precision", "recall", "f1")


def chained_fingerprints(spark: SparkSession, n: int, *, seed: int = 20260903) -> DataFrame:
    """``number, id, fp``: hashed fingerprints, where each number of the form 23 k + 1 is the
    one before it with bit number % 64 flipped (known neighbours for timing the join)."""
    if isinstance(n, bool) or not isinstance(n, int) or n < 1:
        raise ValueError("the number of fingerprints must be a positive integer")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    own = F.conv(F.left(digest, F.lit(16)), 16, -10).cast("long")
    former = F.sha2(F.concat(F.lit(f"{seed}:"), (F.col("id") - 1).cast("string")), 256)
    powers = F.array(*[F.lit((1 << k) - (1 << 64 if k == 63 else 0)).cast("long") for k in range(64)])
    flipped = F.conv(F.left(former, F.lit(16)), 16, -10).cast("long").bitwiseXOR(F.get(powers, (F.col("id") % 64).cast("int")))
    fp = F.when(F.col("id") % 23 == 1, flipped).otherwise(own)
    return spark.range(n).select(F.col("id").alias("number"), F.format_string("syn_%012d", F.col("id")).alias("id"), fp.alias("fp"))


def unit_vectors(spark: SparkSession, n: int, dimension: int, *, seed: int) -> DataFrame:
    """``id, vec``: random unit vectors, each from a generator of its own number, made in tasks."""
    if n < 1 or dimension < 1:
        raise ValueError("numbers must be positive")
    ship_package(spark)

    def make(batches):
        for batch in batches:
            ids = batch.column("id").to_pylist()
            rows = np.array([np.random.default_rng([seed, i]).normal(size=dimension) for i in ids]).reshape(len(ids), dimension)
            rows /= np.linalg.norm(rows, axis=1, keepdims=True)
            names = pa.array([f"vec_{i:012d}" for i in ids], pa.string())
            yield pa.RecordBatch.from_arrays([names, pa.array(rows.astype(np.float32).tolist(), pa.list_(pa.float32()))], names=["id", "vec"])

    return spark.range(n).mapInArrow(make, "id string, vec array<float>")


def write_collection(spark: SparkSession, root: str, n: int, *, seed: int) -> DataFrame:
    """``n`` images of 24 x 24 pixels, no two alike, as ``root/split/class/file``: 8 of 10 in
    train, one each in val and test, four classes. Returns ``path, split, label``."""
    ship_package(spark)
    base = os.path.abspath(root)

    def make(batches):
        for batch in batches:
            paths, splits, labels = [], [], []
            for i in batch.column("id").to_pylist():
                split, label = ("train" if i % 10 < 8 else "val" if i % 10 == 8 else "test"), f"class_{i % 4}"
                pixels = source_image(seed, i, 24)
                pixels[0, :3] = np.frombuffer(i.to_bytes(9, "big"), np.uint8).reshape(3, 3)  # the number itself
                path = f"{split}/{label}/image_{i:08d}.png"
                os.makedirs(os.path.dirname(f"{base}/{path}"), exist_ok=True)
                with open(f"{base}/{path}.part", "wb") as file:
                    file.write(encode_png(pixels))
                os.replace(f"{base}/{path}.part", f"{base}/{path}")
                paths.append(path)
                splits.append(split)
                labels.append(label)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (paths, splits, labels)], names=["path", "split", "label"])

    return materialise(spark.range(n).mapInArrow(make, "path string, split string, label string"), "collection")
