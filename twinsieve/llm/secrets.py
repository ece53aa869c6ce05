"""Secret scans: rules, entropy, and how widely each candidate is copied."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.runtime import materialise, ship_package


def _either(word: str) -> str:
    """``word`` with ASCII letters in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key")))
ASSIGN = re.compile(rf"""(?:{_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}")
KINDS = ("assign", "access", "hex", "opaque")


def entropy(text: str) -> float:
    """Bits a character."""
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values())


def scan_text(text: str) -> list[tuple[int, int, int, str]]:
    """``(kind, begin, end, value)`` of all candidates, by start, then kind.

    The first three kinds are the base rules; ``opaque`` is a run of 24 or more key
    characters outside of them, with letters and digits and 3.5 bits a character.
    """
    found = [(0, *m.span(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        # A longer run of A-Z and 0-9 before the key does not matter: the key starts at AKIA.
        found += [(1, *m.span(), m[0]) for m in ACCESS.finditer(text)]
    found += [(2, *m.span(), m[0]) for m in HEX.finditer(text)]
    base = [(b, e) for _, b, e, _ in found]
    for m in OPAQUE.finditer(text):
        value = m[0]
        if any(b < m.end() and m.start() < e for b, e in base):
            continue
        if re.search("[0-9]", value) and re.search("[A-Za-z]", value) and entropy(value) >= 3.5:
            found.append((3, *m.span(), value))
    return sorted(found, key=lambda f: (f[1], f[0], f[2]))


_ITEM = pa.struct(
    [("kind", pa.int32()), ("begin", pa.int64()), ("end", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())]
)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column("text"):
            row = []
            for kind, begin, end, value in scan_text(text.as_py() or ""):
                h = xxhash.xxh3_128_intdigest(value.encode())
                row.append({"kind": kind, "begin": begin, "end": end, "h1": _signed(h >> 64), "h2": _signed(h & (2**64 - 1))})
            out.append(row)
        columns = [batch.column(c) for c in ("id", "owner", "repo", "mark")]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(out, pa.list_(_ITEM))], names=["id", "owner", "repo", "mark", "items"]
        )


def find_secrets(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_cols: tuple[str, ...] = ("source", "lang"),
    owners: int = 3,
    repos: int = 6,
) -> DataFrame:
    """One row per input row: ``id_col`` and ``items``, an array of
    ``struct<kind,begin,end,n_owners,n_repos,live>`` in code points, by start, then kind.

    Each candidate's value is known by a 128-bit hash. Over all documents its distinct
    owners and repositories (``repo_cols`` together) are counted; a value of ``owners``
    owners or ``repos`` repositories or more is a copied example (``live`` false), others
    are owner-specific. Base candidates (assign, access, hex) all stay in ``items``;
    opaque ones only if live.

    Ids are integers. Null text counts as empty, a null owner or repository as one of its own;
    texts of any length are read whole; null ids and repeated rows have results like any
    others; an empty table gives an empty result; columns not named are not read. A hot value is first reduced to its
    distinct owners and repositories map-side; the join back is split by AQE.
    """
    ship_package(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    repo = F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in repo_cols]))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("\0")).alias("owner"),
        repo.alias("repo"), F.xxhash64(text).alias("mark"), text.alias("text"),
    )
    item = "struct<kind:int,begin:long,end:long,h1:long,h2:long>"
    rows = materialise(
        rows.mapInArrow(_scan_batches, f"id long, owner string, repo string, mark long, items array<{item}>"),
        "secret-rows",
    )
    every = rows.select("id", "mark", "owner", "repo", F.explode("items").alias("c")).select(
        "id", "mark", "owner", "repo", "c.kind", "c.begin", "c.end", "c.h1", "c.h2"
    )
    spread = (
        every.select("h1", "h2", "owner", "repo")
        .distinct()
        .groupBy("h1", "h2")
        .agg(F.countDistinct("owner").alias("n_owners"), F.countDistinct("repo").alias("n_repos"))
    )
    live = (F.col("n_owners") < owners) & (F.col("n_repos") < repos)
    known = every.join(spread, ["h1", "h2"]).withColumn("live", live).where((F.col("kind") < 3) | F.col("live"))
    per_row = known.groupBy(F.col("id").alias("i2"), F.col("mark").alias("m2")).agg(
        F.collect_set(F.struct("begin", "kind", "end", "n_owners", "n_repos", "live")).alias("items")
    )
    met = rows.select("id", "mark").join(
        per_row, F.col("id").eqNullSafe(F.col("i2")) & (F.col("mark") == F.col("m2")), "left"
    )
    empty = "array<struct<begin:bigint,kind:int,end:bigint,n_owners:bigint,n_repos:bigint,live:boolean>>"
    items = F.array_sort(F.coalesce(F.col("items"), F.array().cast(empty)))
    return met.select(F.col("id").alias(id_col), items.alias("items"))


def joined(items) -> F.Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            items, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["begin"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )
