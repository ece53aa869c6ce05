"""Personal data: fixed rules plus bootstrapped contextual extraction (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.runtime import drop_materialised, materialise

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
BLANK = r"\x20\x09-\x0D"

#: kind -> pattern. Possessive forms of the rules: they match the same spans, without
#: deep recursion and without rescanning a long run from each of its characters.
RULES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*RULES, "id")
#: What a text must have for a rule to match in it.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}

#: A token with a digit or an @, from the first of its characters.
TOKEN = rf"(?<![^{BLANK}])[^{BLANK}0-9@]*+[0-9@][^{BLANK}]*+"
#: Two words at the end of the text before a token.
CONTEXT = rf"(?:^|[{BLANK}])([^{BLANK}]+)[{BLANK}]+([^{BLANK}]+)[{BLANK}]+$"
REACH = 80
#: Background is counted in one of so many parts of the rows first, then in all others.
FIRST = 64
#: Before each word but a first one at the text's start.
WORD_START = rf"(?<=[{BLANK}])(?![{BLANK}])"


def _digits(match):
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits):
    worth = F.transform(
        F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0)),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5)),
    )
    return F.aggregate(worth, F.lit(0).cast("long"), lambda a, x: a + x) % 10 == 0


def _passes(kind: str, match):
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        n = F.length(_digits(match))
        return (F.length(match) >= 16) & (n >= 16) & (n <= 19) & _luhn(_digits(match))
    if kind == "phone":
        n = F.length(_digits(match))
        return (n >= 8) & (n <= 15)
    return F.lit(True)


def _walk(text, pattern: str, keep, empty: str):
    """Array of ``keep(match, start, piece before)`` (arrays of 0 or 1 values), in text order.

    The pieces between matches give the offsets: their lengths (in code points) add up.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), F.array().cast(empty).alias("out"))

    def step(pieces, acc, hit):
        piece = F.get(pieces, acc["i"])
        begin = acc["at"] + F.length(piece)
        return F.struct(
            (acc["i"] + 1).alias("i"),
            (begin + F.length(hit)).alias("at"),
            F.concat(acc["out"], keep(hit, begin, piece)).cast(empty).alias("out"),
        )

    def scan(found):
        pieces = F.array(F.split(text, pattern, -1))
        walked = F.get(
            F.transform(pieces, lambda p: F.aggregate(found, start, lambda a, h: step(p, a, h))["out"]), F.lit(0)
        )
        return F.when(F.size(found) > 0, walked).otherwise(F.array().cast(empty))

    return F.get(F.transform(F.array(hits), scan), F.lit(0))


_SPAN = "array<struct<kind:int,begin:int,end:int>>"


def base_spans(text) -> F.Column:
    """``array<struct<kind,begin,end>>`` by kind (index in ``KINDS``), then start."""
    parts = []
    for k, (kind, pattern) in enumerate(RULES.items()):

        def keep(hit, begin, piece, k=k, kind=kind):
            span = F.struct(F.lit(k).alias("kind"), begin.alias("begin"), (begin + F.length(hit)).alias("end"))
            return F.when(_passes(kind, hit), F.array(span)).otherwise(F.array().cast(_SPAN))

        parts.append(F.when(text.rlike(HINTS[kind]), _walk(text, pattern, keep, _SPAN)).otherwise(F.array().cast(_SPAN)))
    return F.concat(*parts)


_CANDIDATE = "array<struct<pattern:string,instance:string,begin:int,end:int>>"


def _pair(before) -> F.Column:
    """The pattern that a text ends with: its last two words in the last ``REACH`` characters."""
    near = F.right(before, F.lit(REACH))
    words = lambda g: F.regexp_extract(near, CONTEXT, g)
    return F.when(words(1) != "", F.lower(F.concat(words(1), F.lit(" "), words(2))))


def candidates(text) -> F.Column:
    """Tokens with a digit or ``@`` that follow two words, with those words as their pattern."""

    def keep(hit, begin, piece):
        bare = F.regexp_replace(F.regexp_replace(hit, r"^[\"'(<\[]+", ""), r"[.,;:!?)\"'>\]]+$", "")
        head = F.length(F.regexp_extract(hit, r"^[\"'(<\[]+", 0))
        found = lambda pattern: F.struct(
            pattern.alias("pattern"),
            bare.alias("instance"),
            (begin + head).alias("begin"),
            (begin + head + F.length(bare)).alias("end"),
        )
        known = lambda p: F.when(p.isNull(), F.array().cast(_CANDIDATE)).otherwise(F.array(found(p)).cast(_CANDIDATE))
        return F.get(F.transform(F.array(_pair(piece)), known), F.lit(0))

    return F.when(text.rlike("[0-9@]"), _walk(text, TOKEN, keep, _CANDIDATE)).otherwise(F.array().cast(_CANDIDATE))


def count_background(texts: DataFrame, patterns: DataFrame, *, text_col: str = "t") -> DataFrame:
    """``pattern, n``: at how many places of ``texts`` each of ``patterns`` stands and no token follows.

    A text ends as if with a blank. ``texts``: none null. The words of a text with the blanks
    behind them become rows. (The outer explode and the pattern that is never null keep Spark
    from computing both twice for a filter.)
    """
    words = texts.select(F.split(F.concat(text_col, F.lit(" ")), WORD_START).alias("words"))
    words = words.select("words", F.posexplode_outer("words").alias("i", "a"))
    runs = words.select("a", F.get("words", F.col("i") + 1).alias("b"), F.get("words", F.col("i") + 2).alias("c"))
    bare = lambda w: F.rtrim(w, F.lit(" \t\n\x0b\x0c\r"))
    whole = F.lower(F.concat(bare("a"), F.lit(" "), bare("b")))
    pattern = F.when(F.length("a") + F.length("b") <= REACH, whole).when(~F.col("a").rlike("[0-9@]"), _pair(F.concat("a", "b")))
    alone = ~F.coalesce("c", F.lit("")).rlike("[0-9@]")
    places = runs.select(F.coalesce(pattern, F.lit("")).alias("pattern"), alone.alias("alone"))
    met = places.join(patterns.select("pattern"), "pattern", "left_semi")
    return met.groupBy("pattern").agg(F.count_if("alone").alias("n"))


def joined(spans) -> F.Column:
    """``kind:begin:end`` by kind, then start, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["begin"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def score_patterns(
    edges: DataFrame, background: DataFrame | None, *, rounds: int, support: float, confidence: float
) -> DataFrame:
    """``pattern, confidence`` of the patterns that end with a high confidence.

    ``edges``: ``pattern, instance, seed`` (distinct); ``background``: ``pattern, n`` (none: 0). Each
    round, a pattern is worth the sum of its instances' scores over its instances, its
    background occurrences and 1; patterns that reach ``support`` and ``confidence`` score
    the instances in turn (noisy or; seeds keep 1).
    """
    scores = edges.where("seed").select("instance", F.lit(1.0).alias("score")).distinct()
    good = None
    for _ in range(rounds):
        met = edges.join(scores, "instance", "left").groupBy("pattern").agg(
            F.sum(F.coalesce("score", F.lit(0.0))).alias("worth"), F.count(F.lit(1)).alias("n_instances")
        )
        ranked = met.where(F.col("worth") >= support)
        ranked = ranked.withColumn("n", F.lit(0)) if background is None else ranked.join(background, "pattern", "left")
        value = F.col("worth") / (F.col("n_instances") + F.coalesce("n", F.lit(0)) + 1)
        former = good
        good = materialise(
            ranked.select("pattern", value.alias("confidence")).where(F.col("confidence") >= confidence), "pii-patterns"
        )
        if former is not None:
            drop_materialised(former)
        grown = edges.join(good, "pattern").groupBy("instance").agg(
            F.max("seed").alias("seed"),
            (1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999)))))).alias("score"),
        )
        seeds = edges.where("seed").select("instance", F.lit(1.0).alias("score")).distinct()
        scores = seeds.unionByName(grown.where(~F.col("seed")).select("instance", "score"))
        scores = scores.groupBy("instance").agg(F.max("score").alias("score"))
    return good


def find_personal_data(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    rounds: int = 3,
    support: float = 4.0,
    confidence: float = 0.8,
) -> DataFrame:
    """One row per input row: ``id_col``, ``base`` and ``found``, both
    ``array<struct<kind,begin,end>>`` in code points (end exclusive).

    ``base``: what the rules find (email, ip, card, phone). ``found``: tokens of kind
    ``id`` outside the base spans, with a digit or @ and at least 5 characters, 3 of them
    digits or one an @, that follow a pattern (two lower-cased words at most 80 characters
    before) which the bootstrap trusts. Seeds are the tokens in base spans. Limits: both
    words must stand after the token's last predecessor with a digit or @, or the token has
    no pattern and is not found; a first word that begins before the 80 characters is cut.

    Null text counts as empty and has no spans; texts of any length are read whole; null ids
    and repeated rows have results like any others (rows are told apart by id and text); an
    empty table gives an empty result; other columns are not read. Counts cover all documents:
    a pattern's background is each place of any text, with or without tokens, where it stands
    and no token follows. It is counted in one part of the rows (one of ``FIRST``) and then in
    all others, each time for the patterns that are trusted by the places counted so far. That
    loses none: more background only lowers a confidence, and with it all that follow from
    it, so a pattern that the places of one part rule out is out by all places too. The patterns
    trusted at the end have all their places counted. Shuffled are only tokens with their
    patterns and, where the patterns to count are too many to broadcast, pairs of words, never
    texts; a hot pattern or token is combined map-side, and its joins are split by AQE.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), text.alias("t"))
    rows = materialise(
        row.select("id", "mark", base_spans(F.col("t")).alias("base"), candidates(F.col("t")).alias("tokens")),
        "pii-rows",
    )
    over = F.exists("base", lambda b: (b["begin"] < F.col("c.end")) & (F.col("c.begin") < b["end"]))
    tokens = rows.select("id", "mark", "base", F.explode("tokens").alias("c")).select(
        "id", "mark", over.alias("seed"), "c.pattern", "c.instance", "c.begin", "c.end"
    )
    edges = materialise(
        tokens.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "pii-edges"
    )
    dealt = F.pmod(F.xxhash64("id", "mark"), F.lit(FIRST)) == 0
    slack = 1e-6  # while places are missing: sums in another order may differ in the last digit
    good = score_patterns(edges, None, rounds=rounds, support=support - slack, confidence=confidence - slack)
    background = None
    for part, slack in ((row.where(dealt), slack), (row.where(~dealt), 0.0)):
        more = count_background(part, good)
        if background is not None:
            more = more.unionByName(background).groupBy("pattern").agg(F.sum("n").alias("n"))
        former = [good] if background is None else [good, background]
        background = materialise(more, "pii-background")
        good = score_patterns(edges, background, rounds=rounds, support=support - slack, confidence=confidence - slack)
        for old in former:
            drop_materialised(old)
    drop_materialised(edges)
    drop_materialised(background)
    like_id = (F.length("instance") >= 5) & (
        F.contains("instance", F.lit("@")) | (F.length(F.regexp_replace("instance", "[^0-9]", "")) >= 3)
    )
    span = F.struct(F.lit(KINDS.index("id")).alias("kind"), "begin", "end")
    found = (
        tokens.where(~F.col("seed") & like_id)
        .join(good.select("pattern"), "pattern", "left_semi")
        .groupBy(F.col("id").alias("i2"), F.col("mark").alias("m2"))
        .agg(F.collect_set(span).alias("found"))
    )
    met = rows.join(found, F.col("id").eqNullSafe(F.col("i2")) & (F.col("mark") == F.col("m2")), "left")
    return met.select(
        F.col("id").alias(id_col),
        "base",
        F.array_sort(F.coalesce(F.col("found"), F.array().cast(_SPAN))).alias("found"),
    )
