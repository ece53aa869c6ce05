"""Content de-duplication of a stream (an extension; the batch operators stand alone)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_contents(stream: DataFrame, *, text_col: str, time_col: str, delay: str = "1 hour") -> DataFrame:
    """Rows whose content hash was not seen within the watermark; state is bounded by ``delay``."""
    hashed = stream.withWatermark(time_col, delay).withColumn("content_sha256", F.sha2(F.col(text_col), 256))
    return hashed.dropDuplicatesWithinWatermark(["content_sha256"])
