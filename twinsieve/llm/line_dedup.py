"""Line de-duplication by overlapping three-line windows (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A line counts if it has a character that is not white space.
INK = r"[^\x20\x09-\x0D]"


def once(value, body):
    """``body(value)`` with ``value`` worked out a single time, also inside nested lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_mark(text) -> F.Column:
    """60 bits of the text's MD5: tells rows of one id apart."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def line_windows(docs: DataFrame, *, id_col: str, text_col: str, width: int = 3) -> DataFrame:
    """``id, mark, begin, end, h1, h2``: each run of ``width`` consecutive non-blank lines.

    ``mark`` is the text's ``text_mark``; ``begin`` and ``end`` are line numbers (from 0, end included). A run is known by two 64-bit hashes of its
    lines, so that chance equality does not matter at 10^12 windows.
    """
    lines = F.filter(
        F.transform(
            F.split(F.col(text_col), "\n", -1),
            lambda line, i: F.struct(
                i.alias("i"), line.rlike(INK).alias("ink"),
                F.xxhash64(line).alias("a"), F.xxhash64(F.lit("second"), line).alias("b"),
            ),
        ),
        lambda x: x["ink"],
    )

    def runs(rows):
        return F.when(
            F.size(rows) >= width,
            F.transform(
                F.sequence(F.lit(0), F.size(rows) - width),
                lambda k: F.struct(
                    F.get(rows, k)["i"].alias("begin"),
                    F.get(rows, k + (width - 1))["i"].alias("end"),
                    F.xxhash64(*[F.get(rows, k + j)["a"] for j in range(width)]).alias("h1"),
                    F.xxhash64(*[F.get(rows, k + j)["b"] for j in range(width)]).alias("h2"),
                ),
            ),
        )

    found = docs.select(F.col(id_col).alias("id"), text_mark(F.col(text_col)).alias("mark"), once(lines, runs).alias("w"))
    return found.select("id", "mark", F.explode("w").alias("w")).select("id", "mark", "w.begin", "w.end", "w.h1", "w.h2")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """All rows and columns of ``docs`` with repeated line runs cut from ``text_col``, plus
    ``n_lines`` and ``n_removed``.

    A window of ``width`` consecutive non-blank lines that stands earlier (by id, then text
    hash, then line number) anywhere in the table is a repeat; every line from a repeat's
    first to its last goes. The first occurrence of a window stays, unless another repeat
    covers its lines.

    Null text stays null with 0 lines; empty text is one line. Null ids come last. Rows of
    one id with different texts are documents of their own; rows equal in id and text
    are one document that stands several times and are cut alike. Columns named
    ``n_lines`` or ``n_removed`` are replaced. An empty table gives an empty result.

    Shuffles: 36 bytes a window twice (partially aggregated, then joined to the repeated
    windows only, where AQE splits hot windows), and each text once to meet its cuts.
    """
    windows = line_windows(docs, id_col=id_col, text_col=text_col, width=width)
    place = F.struct(F.col("id").isNull().alias("last"), "id", "mark", "begin")
    repeated = (
        windows.groupBy("h1", "h2")
        .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("h1", "h2", "first")
    )
    later = windows.join(repeated, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    cuts = later.groupBy(F.col("id").alias("__cut_id"), F.col("mark").alias("__cut_mark")).agg(
        F.flatten(F.collect_set(F.sequence("begin", "end"))).alias("__cut")
    )
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__cut"))
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    text = F.when(F.col("__cut").isNull(), F.col(text_col)).otherwise(
        once(lines, lambda rows: F.array_join(F.transform(kept, lambda i: F.get(rows, i)), "\n"))
    )
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines))
    n_removed = F.when(F.col("__cut").isNull() | F.col(text_col).isNull(), 0).otherwise(F.size(lines) - F.size(kept))
    mine = F.col(id_col).eqNullSafe(F.col("__cut_id")) & (text_mark(F.col(text_col)) == F.col("__cut_mark"))
    return docs.join(cuts, mine, "left").select(
        *[(text if c == text_col else F.col(c)).alias(c) for c in columns],
        n_lines.cast("long").alias("n_lines"),
        n_removed.cast("long").alias("n_removed"),
    )
