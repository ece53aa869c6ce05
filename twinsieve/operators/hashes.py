"""Hashes of whole datasets and of what was measured on them."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.sources.sinks import canonical_json

# The fields of a snapshot's rows; detector results have no part in it.
RECORD_FIELDS = ("id", "path", "split", "label", "byte_sha256", "byte_size", "width", "height", "format")
ISSUE_FIELDS = ("record_id", "path", "split", "label", "code")
SCHEMA = "dataset-snapshot-v1"


def _quoted(text: Column) -> Column:
    """A JSON string, escaped as a canonical writer without ASCII escapes does."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for char, escape in (("\n", "n"), ("\r", "r"), ("\t", "t"), ("\b", "b"), ("\f", "f")):
        out = F.replace(out, F.lit(char), F.lit("\\" + escape))
    for code in [c for c in range(32) if chr(c) not in "\n\r\t\b\f"]:
        out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), out, F.lit('"'))


def json_row(df: DataFrame, fields: tuple[str, ...]) -> Column:
    """Canonical JSON of a row: sorted keys, no blanks, nulls and missing columns as ``null``."""
    kinds = dict(df.dtypes)
    parts = []
    for name in sorted(fields):
        column = F.col(name) if name in kinds else F.lit(None).cast("string")
        text = _quoted(column) if kinds.get(name, "string") == "string" else column.cast("string")
        parts.append(F.concat(F.lit(f'"{name}":'), F.coalesce(text, F.lit("null"))))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def snapshot_rows(records: DataFrame) -> DataFrame:
    """``id, row``: each record as canonical JSON."""
    return records.select("id", json_row(records, RECORD_FIELDS).alias("row"))


def snapshot_hash(records: DataFrame, issues: DataFrame | None) -> str:
    """SHA-256 of the canonical JSON of all records in the order of id, path and content, and all
    issues. The rows are range-sorted by Spark and stream through the driver one partition at
    a time, as one SHA-256 over all of them cannot be taken in parts."""
    whole = hashlib.sha256()

    def feed(df: DataFrame | None, fields: tuple[str, ...], keys: tuple[str, ...]) -> None:
        if df is None:
            return
        order = [F.coalesce(F.col(k), F.lit("")) for k in keys if k in df.columns]
        for n, row in enumerate(df.select(json_row(df, fields).alias("row"), *[o.alias(f"k{i}") for i, o in enumerate(order)])
                                .orderBy(*[f"k{i}" for i in range(len(order))]).toLocalIterator()):
            whole.update((("," if n else "") + row.row).encode())

    whole.update(b'{"issues":[')
    feed(issues, ISSUE_FIELDS, ISSUE_FIELDS)
    whole.update(b'],"records":[')
    feed(records, RECORD_FIELDS, ("id", "path", "byte_sha256"))
    whole.update(b'],"schema":' + canonical_json(SCHEMA) + b"}")
    return whole.hexdigest()


def content_hash(value) -> str:
    """SHA-256 of the canonical JSON of plain values: configurations, ground truth, fixtures."""
    return hashlib.sha256(canonical_json(value)).hexdigest()
