"""Preference formatting of chats (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the chat template: before the role, after the role, after the text.
OPEN, ROLE_END, CLOSE = "<|", "|>\n", "<|end|>\n"
LAST = (1 << 63) - 1


def format_preferences(
    chosen: DataFrame,
    rejected: DataFrame,
    *,
    pair_col: str = "pair_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    trained_role: str = "assistant",
) -> DataFrame:
    """``pair_col, part, turn_col, role_col, rendered, trained, train_from``: a row per turn.

    Both tables hold turns: pair, turn number, role, text. The prompt of a pair is the
    longest run of turns from its start on that both conversations share (same number,
    role and text); it is given once (``part`` = ``prompt``), the other turns as ``chosen``
    and ``rejected``. ``rendered`` is the turn in the chat template; concatenating a part's
    rows by turn gives its string. A turn of ``trained_role`` in a completion is trained
    on, from character ``train_from`` (after its header) on; all else is masked
    (``trained`` false, ``train_from`` null).

    A pair stays in rows, as one conversation may be of any length: no task holds one as a
    whole. Rows with a null pair are left out; a null turn number stands last, a null role
    is ``unknown``, a null text empty. Several rows of one turn number count as one turn
    and are rendered each. If both conversations are equal, all is prompt. A pair in one
    table only has an empty prompt. Texts of any length are rendered whole. Empty tables
    give no rows. Other columns are not read.
    """

    def turns(df: DataFrame, part: str) -> DataFrame:
        return df.where(F.col(pair_col).isNotNull()).select(
            F.col(pair_col).alias("pair"),
            F.coalesce(F.col(turn_col).cast("long"), F.lit(LAST)).alias("turn"),
            F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
            F.lit(part).alias("part"),
        )

    every = turns(chosen, "chosen").unionByName(turns(rejected, "rejected"))
    # The turns of one number are known by a sum of digests: 120 bits, and their number.
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    half = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")
    sums = []
    for part in ("chosen", "rejected"):
        mine = F.col("part") == part
        marks = [F.sum(F.when(mine, half(at))).alias(f"m{at}") for at in (1, 16)]
        sums.append(F.struct(F.count(F.when(mine, True)).alias("n"), *marks).alias(part))
    met = every.groupBy("pair", "turn").agg(*sums)
    apart = ~F.col("chosen").eqNullSafe(F.col("rejected"))
    fork = met.where(apart).groupBy("pair").agg(F.min("turn").alias("fork"))
    placed = every.join(fork, "pair", "left")
    shared = F.col("fork").isNull() | (F.col("turn") < F.col("fork"))
    header = F.concat(F.lit(OPEN), F.col("role"), F.lit(ROLE_END))
    trained = ~shared & (F.col("role") == trained_role)
    return placed.where(~shared | (F.col("part") == "chosen")).select(
        F.col("pair").alias(pair_col),
        F.when(shared, "prompt").otherwise(F.col("part")).alias("part"),
        F.when(F.col("turn") < LAST, F.col("turn")).alias(turn_col),
        F.col("role").alias(role_col),
        F.concat(header, F.col("text"), F.lit(CLOSE)).alias("rendered"),
        trained.alias("trained"),
        F.when(trained, F.length(header)).alias("train_from"),
    )


def forked_pairs(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected tables from plain conversations (``conv_id, turn, role, text``),
    which have no preference labels.

    Chosen is each conversation. Rejected is the same up to a fork, and from the fork on the
    turns of its neighbour (the conversation whose id differs in the last bit; none if there
    is no such conversation). The fork is the id modulo the last turn number + 2, so it
    stands anywhere from the first turn to behind the last. A null turn number stands last.
    Rows with a null ``conv_id`` are left out; every other turn is in both tables or forked.
    """
    at = F.coalesce(F.col("turn").cast("long"), F.lit(LAST))
    turns = turns.where("conv_id IS NOT NULL").select("conv_id", at.alias("turn"), "role", "text")
    last = F.coalesce(F.max(F.when(F.col("turn") < LAST, F.col("turn"))), F.lit(-1))
    forks = turns.groupBy("conv_id").agg(last.alias("last"))
    forks = forks.select("conv_id", F.pmod(F.col("conv_id"), F.greatest(F.col("last"), F.lit(-1)) + 2).alias("fork"))
    cols = F.col("conv_id").alias("pair_id"), F.when(F.col("turn") < LAST, F.col("turn")).alias("turn"), "role", "text"
    own = turns.join(forks, "conv_id").where("turn < fork")
    other = turns.withColumn("conv_id", F.col("conv_id").bitwiseXOR(F.lit(1))).join(forks, "conv_id").where("turn >= fork")
    return turns.select(*cols), own.select(*cols).unionByName(other.select(*cols))


def assemble_pairs(formatted: DataFrame, *, pair_col: str = "pair_id", turn_col: str = "turn") -> DataFrame:
    """``pair_col, prompt, chosen, rejected, chosen_spans, rejected_spans`` from the rows of
    ``format_preferences``: a row per pair with the prompt once and both completions.

    Spans (``array<struct<begin,end>>``, characters, end exclusive) say which parts of a
    completion are trained on; all else is masked. A missing part is an empty string. A pair
    becomes one row here, so its conversations must fit a row, as documents do; the rows
    of ``format_preferences`` are the form for conversations that do not.
    """
    parts = ("prompt", "chosen", "rejected")
    item = F.struct(F.coalesce(F.col(turn_col), F.lit(LAST)).alias("t"), "rendered", F.coalesce("train_from", F.lit(-1)).alias("f"))
    rows = formatted.groupBy(pair_col).agg(
        *[F.array_sort(F.collect_list(F.when(F.col("part") == p, item))).alias(p) for p in parts]
    )

    def spans(turns):
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("out"))

        def step(acc, turn):
            end = acc["at"] + F.length(turn["rendered"])
            mine = F.struct((acc["at"] + turn["f"]).alias("begin"), end.alias("end"))
            return F.struct(end.alias("at"), F.when(turn["f"] >= 0, F.array_append(acc["out"], mine)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(turns, begin, step)["out"]

    text = lambda p: F.array_join(F.transform(F.col(p), lambda t: t["rendered"]), "").alias(p)
    return rows.select(pair_col, *[text(p) for p in parts], *[spans(F.col(p)).alias(f"{p}_spans") for p in parts[1:]])
