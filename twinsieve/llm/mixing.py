"""Mixing sources to target weights: a time-varying curriculum.

Every source has a target in words. Its documents stand in a seeded order; the running
sum of their sizes is the source's token demand. A weight schedule (piecewise linear over
training time 0..1) is integrated per source, and the inverse of that integral turns each
document's place in the demand into a training position. Documents are then range-sorted
by position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinsieve.runtime import materialise

WORD = r"[^\x20\x09-\x0D]+"

#: Schedule knots (time, weight) by place in the weight cycle: heavy sources fade out,
#: light ones fade in, the middle stays level.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)))


def segments(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    """(time, integral so far, weight, slope) of each linear piece; the integral ends at 1."""
    pieces, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        pieces.append((t0, total, w0, (w1 - w0) / (t1 - t0)))
        total += (w0 + w1) / 2 * (t1 - t0)
    return [(t, y / total, w / total, s / total) for t, y, w, s in pieces]


def _segments_of(cycle: F.Column, schedules) -> F.Column:
    arrays = [
        F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(p, ("t", "y", "w", "s"))]) for p in segments(k)])
        for k in schedules
    ]
    chosen = arrays[-1]
    for i in range(len(arrays) - 2, -1, -1):
        chosen = F.when(cycle == i, arrays[i]).otherwise(chosen)
    return chosen


def _position(share: F.Column, pieces: F.Column) -> F.Column:
    """Time at which the integrated schedule reaches ``share`` (0..1)."""
    piece = F.element_at(F.filter(pieces, lambda p: p["y"] <= share), -1)
    rest = share - piece["y"]
    root = F.sqrt(F.greatest(piece["w"] * piece["w"] + 2 * piece["s"] * rest, F.lit(0.0)))
    return F.least(F.lit(1.0), piece["t"] + F.when(rest <= 0, 0.0).otherwise(2 * rest / (piece["w"] + root)))


def source_targets(sizes: DataFrame, *, budget: float, weights: Sequence[int], most: float) -> DataFrame:
    """``source, n_rows, source_size, cycle, target`` for a table ``source, size``.

    Targets share ``budget`` times all sizes by weight; a target stops at ``most`` times
    its source's size and the excess is shared again by weight among the others. Sources
    are ranked by code point, null last; their number is taken to fit one task.
    """
    by_rank = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("cycle") + 1)
    sources = materialise(
        sizes.groupBy("source")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("source_size"))
        .withColumn("cycle", ((F.row_number().over(by_rank) - 1) % len(weights)).cast("int"))
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(most))),
        "mix-sources",
    )
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, n_capped = None, -1
    while True:  # each round caps at least one more source, so it ends
        capped = F.lit(False) if level is None else F.col("weight") * F.lit(level) > F.col("cap")
        cap_sum, w_sum, n = sources.agg(
            F.sum(F.when(capped, F.col("cap")).otherwise(0.0)),
            F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))),
            F.sum(capped.cast("long")),
        ).first()
        if not total or not w_sum or n == n_capped:
            break
        level, n_capped = (budget * total - cap_sum) / w_sum, n
    target = F.least(F.col("cap"), F.col("weight") * F.lit(level or 0.0))
    return sources.select("source", "n_rows", "source_size", "cycle", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    budget: float = 1.5,
    weights: Sequence[int] = (5, 2, 1),
    most: float = 2.0,
    schedules=SCHEDULES,
    seed: str = "mix",
) -> DataFrame:
    """One row per input row: ``id_col, source_col, size, source_size, target, taken,
    position, again``, sorted by ``position``.

    ``taken`` is the number of words that the mix takes of the row (at most ``most`` = 2
    times its size); ``position`` is its training time in [0, 1] and ``again`` that of its
    second pass; both are null where the pass is not taken. A source with a target below
    its size takes a seeded random part of its rows, one of them in part.

    Null text has size 0, texts of any length are counted whole; a null source is a source of
    its own, ranked last; null or repeated ids are rows like any others; an empty table gives
    an empty result. Other columns are not read. A hot source is dealt over about
    sqrt(rows) buckets by a hash of id and text, so its running sum needs no task with all of
    its rows, whatever the ids; only rows equal in id and text (which are interchangeable)
    share a bucket.
    """
    if most > 2:
        raise ValueError("a document has at most two passes")
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(text))
    rows = materialise(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long").alias("key"),
        ),
        "mix-rows",
    )
    sources = source_targets(rows, budget=budget, weights=weights, most=most)
    sources = sources.withColumn("pieces", _segments_of(F.col("cycle"), schedules))
    dealt = rows.alias("r").join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
    n_buckets = F.ceil(F.sqrt(F.col("n_rows")))
    dealt = dealt.select(
        "r.id", "r.source", "size", "key", "source_size", "target", "pieces",
        F.floor(F.col("key") * F.lit(2.0**-52) * n_buckets).cast("long").alias("bucket"),
    )
    sums = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("source").alias("s2"), F.col("bucket").alias("b2"),
        F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("bucket_start"),
    )
    within = (
        Window.partitionBy("source", "bucket")
        .orderBy("key", F.col("id").asc_nulls_first(), "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    start = F.col("bucket_start") + F.coalesce(F.sum("size").over(within), F.lit(0))
    limit = F.floor(F.col("target"))
    part = lambda begin: F.least(F.greatest(limit - begin, F.lit(0)), F.col("size"))
    place = lambda begin: F.when(part(begin) > 0, _position(begin / F.col("target"), F.col("pieces")))
    first, second = F.col("start"), F.col("start") + F.col("source_size")
    return (
        dealt.join(sums, F.col("source").eqNullSafe(F.col("s2")) & (F.col("bucket") == F.col("b2")))
        .withColumn("start", start)
        .select(
            F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
            (part(first) + part(second)).cast("long").alias("taken"),
            place(first).alias("position"), place(second).alias("again"),
        )
        .orderBy(F.col("position").asc_nulls_last(), id_col)
    )
