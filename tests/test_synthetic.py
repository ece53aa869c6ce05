import numpy as np
import pytest
from pyspark.sql import functions as F

from twinsieve.operators import synthetic
from twinsieve.operators.embedding import embed_records


def test_corruptions_are_repeatable_and_differ():
    image = synthetic.source_image(1, 5)
    for kind in synthetic.KINDS:
        once = synthetic.corrupt(image, kind, 1, "a")
        assert (once == synthetic.corrupt(image, kind, 1, "a")).all()
        assert (once.shape == image.shape and (once == image).all()) == (kind in synthetic.SAME_BYTES)
    with pytest.raises(ValueError):
        synthetic.corrupt(image, "other", 1, "a")


def test_detection_benchmark(spark):
    rows = {(r.detector, r.corruption, r.threshold): r for r in synthetic.detection_benchmark(spark, 8).collect()}
    assert len(rows) == 8 * (1 + 6 + 5 + 1)
    for kind in synthetic.KINDS:
        exact = rows["sha256_exact", kind, None]
        assert (exact.precision, exact.recall) == ((1, 1) if kind in synthetic.SAME_BYTES else (0, 0))
        recalls = [rows["phash_hamming", kind, float(t)].recall for t in synthetic.RADII]
        assert recalls == sorted(recalls)
    for kind in ("resize", "gaussian_blur", "brightness_shift", "jpeg_recompression"):
        assert rows["phash_hamming", kind, 8.0].recall == 1 and rows["phash_hamming", kind, 8.0].precision == 1


def test_embedding_cache(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def embed(contents):
        calls.add(len(contents))
        return np.array([[len(c), 1.0, 2.0] for c in contents])

    df = spark.createDataFrame([("a", b"x"), ("b", b"x"), ("c", b"yy")], "id string, content binary").withColumn("byte_sha256", F.sha2("content", 256))
    options = {"model": "m", "preprocessing": "p", "dimension": 3}
    for _ in range(2):
        got = {r.id: r.vec for r in embed_records(df, str(tmp_path / "cache"), embed, **options).collect()}
        assert got["a"] == got["b"] != got["c"] and abs(np.linalg.norm(got["c"]) - 1) < 1e-6
    assert calls.value == 2
    embed_records(df, str(tmp_path / "cache"), embed, **options | {"model": "n"}).collect()
    assert calls.value == 4
