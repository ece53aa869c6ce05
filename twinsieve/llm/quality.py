"""Quality rules: an isolation forest on rule statistics, calibrated from labelled rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.words import WordHashes, shingles
from twinsieve.runtime import materialise, ship_package

# Classes of bytes: 1 white space, 2 symbol, 3 A-Z, 4 a-z, 5 ! or ?, 6 inside a code point, 0 other.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[list(b"#*$%&|<>")] = 2
_CLASS[65:91] = 3
_CLASS[97:123] = 4
_CLASS[list(b"!?")] = 5
_CLASS[128:192] = 6

FEATURES = ("symbols", "shouting", "exclaiming", "stuttering", "word_length", "variety")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
BINS = 10_000


def repeated_words(words: np.ndarray, width: int = 8) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    run = shingles(words, width)
    if len(run) < 2:
        return 0
    order = np.argsort(run, kind="stable")
    same = run[order[1:]] == run[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(len(run), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    edge[: len(run)] += again
    edge[width : width + len(run)] -= again
    return int(np.count_nonzero(np.cumsum(edge[:-1]) > 0))


def rule_statistics(text: bytes, hashes: WordHashes) -> tuple[list[int], list[float]]:
    """The counts of ``COUNTS`` and the features of ``FEATURES``, none clipped or shifted.

    Features: symbols a word, the part of letters in upper case, ``!`` and ``?`` a word, the
    part of words that repeat the word before, characters a word, distinct words a word.
    (Repeated lines and windows stay with the base rule: with them as features the forest
    loses 3 % of the good labelled rows here, as good documents repeat passages too.)
    """
    words = text.split()
    n = len(words)
    kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=7)
    ids = hashes.of(words)
    again = repeated_words(ids)
    seen: set[bytes] = set()
    n_dup = 0
    for line in text.split(b"\n"):
        if line in seen:
            n_dup += bool(line.strip(b" \t\n\r\x0b\x0c"))
        else:
            seen.add(line)
    counts = [n, int(len(text) - kinds[6] - kinds[1]), int(kinds[2]), n_dup, again]
    stutter = np.count_nonzero(ids[1:] == ids[:-1]) if n else 0
    some = max(n, 1)
    letters = max(int(kinds[3] + kinds[4]), 1)
    features = [kinds[2] / some, kinds[3] / letters, kinds[5] / some, stutter / some, counts[1] / some, len(set(words)) / some]
    return counts, [float(f) for f in features]


def _statistic_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    with np.errstate(over="ignore"):
        for batch in batches:
            rows = [rule_statistics(t.as_py() or b"", hashes) for t in batch.column("text").cast(pa.binary())]
            columns = [batch.column("id")]
            columns += [pa.array([r[0][i] for r in rows], pa.int64()) for i in range(len(COUNTS))]
            columns += [pa.array([r[1][i] for r in rows], pa.float64()) for i in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", *COUNTS, *FEATURES])


class IsolationForest:
    """Random splits on random features; rows that few splits cut off are anomalous.

    A node draws its feature in proportion to the squared kurtosis of its rows, so that
    features with outliers are split more often than those that only vary.
    """

    def __init__(self, rows: np.ndarray, *, trees: int, rows_per_tree: int, seed: int):
        rng = np.random.default_rng(seed)
        self.size = min(rows_per_tree, len(rows))
        self.depth = max(1, int(np.ceil(np.log2(max(self.size, 2)))))
        self.trees = [self._grow(rows[rng.choice(len(rows), self.size, replace=False)], rng) for _ in range(trees)]

    @staticmethod
    def usual_path(n: int) -> float:
        """Mean path length of an unsuccessful search among ``n`` rows."""
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n

    def _grow(self, rows: np.ndarray, rng) -> dict[str, np.ndarray]:
        nodes: list[list[float]] = []
        todo = [(rows, 0, None)]
        while todo:
            part, depth, parent = todo.pop()
            me = len(nodes)
            if parent is not None:
                nodes[parent[0]][parent[1]] = me
            low, high = part.min(axis=0), part.max(axis=0)
            open_ = np.flatnonzero(high > low)
            if depth >= self.depth or not len(open_):
                nodes.append([-1, 0.0, me, me, depth + self.usual_path(len(part))])
                continue
            gap = part[:, open_] - part[:, open_].mean(axis=0)
            heavy = ((gap**4).mean(axis=0) / np.maximum((gap**2).mean(axis=0) ** 2, 1e-300)) ** 2
            f = int(rng.choice(open_, p=heavy / heavy.sum()))
            cut = rng.uniform(low[f], high[f])
            left = part[:, f] <= cut
            nodes.append([f, cut, me, me, 0.0])
            todo += [(part[~left], depth + 1, (me, 3)), (part[left], depth + 1, (me, 2))]
        grown = np.array(nodes)
        kinds = {"feature": np.int64, "cut": float, "left": np.int64, "right": np.int64, "path": float}
        return {k: grown[:, i].astype(t) for i, (k, t) in enumerate(kinds.items())}

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly in 0..1: 2 to the power of minus the mean path over the usual path."""
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for t in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = t["feature"][at]
                at = np.where(rows[every, np.maximum(f, 0)] <= t["cut"][at], t["left"][at], t["right"][at])
            total += t["path"][at]
        return 2.0 ** (-total / len(self.trees) / max(self.usual_path(self.size), 1e-9))


def _score_batches(batches: Iterator[pa.RecordBatch], forest: IsolationForest) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in FEATURES])
        columns = [batch.column(c) for c in ("id", *COUNTS)]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(forest.scores(rows), pa.float64())], names=["id", *COUNTS, "score"]
        )


def calibrated(good: dict[int, int], bad: dict[int, int], *, weight: float) -> float | None:
    """Score from which on rows are rejected, from labelled counts by bin (``BINS`` a unit).

    Of the cuts with the least ``weight`` * part of the good that is lost + part of the bad
    that is missed, the middle of the first run. The lost part is what is to be expected of
    rows not seen, (lost + 1) / (good + 2); so a cut that few good rows speak for is not made,
    and neither is one without bad rows: then the score is beyond 1 and rejects nothing.
    """
    if not good:
        return None
    n_good, n_bad = sum(good.values()), sum(bad.values())
    above, missed, costs = n_good, 0, []
    for cut in range(BINS + 1):  # rows in bins of at least ``cut`` are rejected
        costs.append(weight * (above + 1) / (n_good + 2) + (missed / n_bad if n_bad else 0))
        above -= good.get(cut, 0)
        missed += bad.get(cut, 0)
    first = min(range(len(costs)), key=costs.__getitem__)
    if not n_bad or costs[first] >= 1:  # the cost of rejecting nothing
        return (BINS + 1) / BINS
    last = first
    while last + 1 < len(costs) and costs[last + 1] == costs[first]:
        last += 1
    return (first + last) // 2 / BINS


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    quality_col: str = "quality",
    fit_rows: int = 4096,
    trees: int = 200,
    rows_per_tree: int = 32,
    weight: float = 20.0,
    seed: int = 20,
) -> DataFrame:
    """One row per input row: ``id_col``, the counts of ``COUNTS``, ``base_failed``,
    ``score``, ``threshold``, ``kept``.

    ``base_failed``: under 20 words, or over 30 % of the words in repeated 8-word windows.
    The forest is fitted on a bounded sample of labelled rows: the ``fit_rows`` that pass the
    base rules with the least id hash. Statistics, scores and the threshold cover all
    rows: the threshold is ``calibrated`` on all labelled documents that pass the base
    rules, where losing a part of the good ones (as expected from their number) counts
    ``weight`` times as much as missing the same part of the bad ones; too few good rows, or no
    bad ones, reject nothing. ``kept`` is true below it; rows of equal
    statistics have equal verdicts.

    Ids are integers. Null or empty text: all counts 0, fails the base rules. Texts of any
    length are read whole. Without labelled rows that pass the base rules there is no forest
    (scores are 0); without good ones among them the threshold is null; in both cases the
    base rules alone decide. Null ids have no label; repeated rows give repeated results;
    labels repeated for an id count once, with the best quality. An empty table gives an
    empty result. Other columns are not read.
    """
    ship_package(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    counts = ", ".join(f"{c} long" for c in COUNTS)
    stats = materialise(
        texts.mapInArrow(_statistic_batches, f"id long, {counts}, " + ", ".join(f"{f} double" for f in FEATURES)),
        "quality-statistics",
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    marks = (
        labels.where(F.col(id_col).isNotNull() & F.col(quality_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("id"))
        .agg(F.max(quality_col).alias("quality"))
    )
    labelled = stats.join(marks, "id")

    def sample(rows: DataFrame) -> np.ndarray:
        key = F.xxhash64(F.lit(seed), "id")
        some = rows.where(~failed).select(key.alias("key"), *FEATURES).orderBy("key", *FEATURES).limit(fit_rows)
        return np.array([r[1:] for r in some.collect()], float).reshape(-1, len(FEATURES))

    fit = sample(labelled)
    out = "id long, " + counts + ", score double"
    if len(fit):
        forest = IsolationForest(fit, trees=trees, rows_per_tree=rows_per_tree, seed=seed)
        shared = docs.sparkSession.sparkContext.broadcast(forest)
        score = lambda rows: rows.mapInArrow(lambda it: _score_batches(it, shared.value), out)
    else:
        score = lambda rows: rows.select("id", *COUNTS, F.lit(0.0).alias("score"))
    bin_ = F.floor(F.col("score") * BINS)
    kinds = {}
    for kind, rows in (("good", labelled.where("quality > 0")), ("bad", labelled.where("quality <= 0"))):
        scored = score(rows.where(~failed).select("id", *COUNTS, *FEATURES))
        kinds[kind] = {r[0]: r[1] for r in scored.groupBy(bin_.alias("b")).count().collect()}
    threshold = calibrated(kinds["good"], kinds["bad"], weight=weight)
    limit = F.lit(threshold).cast("double")
    scored = score(stats.select("id", *COUNTS, *FEATURES))
    return scored.select(
        F.col("id").alias(id_col),
        *COUNTS,
        failed.alias("base_failed"),
        "score",
        limit.alias("threshold"),
        (~failed & F.coalesce(bin_ < F.lit(threshold).cast("double") * BINS - 0.5, F.lit(True))).alias("kept"),
    )
