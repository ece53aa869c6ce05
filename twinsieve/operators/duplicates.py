"""The three duplicate signals as joins: equal content, Hamming radius, cosine."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinsieve.functions.identity import SPLITS, boundaries, hamming, sorted_by_rank
from twinsieve.runtime import materialise, ship_package


def exact_clusters(records: DataFrame) -> DataFrame:
    """Groups of two or more records of equal content hash, with counts, splits, labels and
    crossed boundaries. Aggregates only: a cluster's members are not gathered."""
    return (
        records.where("byte_sha256 IS NOT NULL")
        .groupBy("byte_sha256")
        .agg(
            F.min("id").alias("first_id"), F.count(F.lit(1)).alias("member_count"),
            F.sum("byte_size").alias("total_duplicate_bytes"),
            F.collect_set("split").alias("s"), F.collect_set("label").alias("l"),
        )
        .where("member_count >= 2")
        .select(
            F.concat(F.lit("exact_"), F.col("byte_sha256")).alias("cluster_id"), "byte_sha256", "first_id", "member_count",
            "total_duplicate_bytes",
            F.array_join(sorted_by_rank(F.col("s"), SPLITS), ",").alias("splits"),
            F.array_join(F.array_sort("l"), ",").alias("labels"),
            F.array_join(boundaries(F.col("s")), ",").alias("boundaries"),
            (F.size(boundaries(F.col("s"))) > 0).alias("crosses_evaluation_boundary"),
        )
    )


def exact_edges(records: DataFrame) -> DataFrame:
    """``left_id, right_id``: the least id of each cluster to each other member (n - 1 edges)."""
    clusters = exact_clusters(records).select("byte_sha256", "first_id")
    met = records.select("id", "byte_sha256").join(clusters, "byte_sha256").where("id <> first_id")
    return met.select(F.col("first_id").alias("left_id"), F.col("id").alias("right_id"))


def _classes(records: DataFrame, key: str) -> DataFrame:
    """One row per distinct ``key``: its least id and its number of records."""
    return records.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("size"))


def _star(records: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    many = classes.where("size > 1").select(key, F.col("id").alias("left_id"))
    return records.select("id", key).join(many, key).where("id <> left_id").select("left_id", F.col("id").alias("right_id"))


# ------------------------------------------------------------------ guards


def checked_radius(radius: int) -> int:
    """A Hamming radius of 64-bit fingerprints."""
    if isinstance(radius, bool) or not isinstance(radius, int) or not 0 <= radius <= 64:
        raise ValueError(f"the radius must be an integer from 0 to 64; got {radius!r}")
    return radius


def checked_k(k: int) -> int:
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError(f"k must be a positive integer; got {k!r}")
    return k


def checked_threshold(threshold: float) -> float:
    if isinstance(threshold, bool) or not -1 <= threshold <= 1:
        raise ValueError(f"a cosine threshold lies in [-1, 1]; got {threshold!r}")
    return float(threshold)


def refuse_repeated_ids(records: DataFrame, id_col: str = "id") -> None:
    """Raises if an id is null, empty or stands twice."""
    bad = records.groupBy(id_col).count().where(F.col(id_col).isNull() | (F.col(id_col).cast("string") == "") | (F.col("count") > 1))
    if not bad.isEmpty():
        raise ValueError(f"record ids must be present and unique; {bad.first()[0]!r} is not")


def normalised(records: DataFrame, vec_col: str = "vec", dimension: int | None = None) -> DataFrame:
    """``records`` with unit float vectors: normalised in double, rounded to float, and
    normalised again, as an index of floats holds them. A vector that is null, not finite, of length zero or
    of another dimension fails the job."""

    def unit(vector):
        square = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x)
        return F.get(F.transform(F.array(F.sqrt(square)), lambda n: F.transform(vector, lambda x: x / n)), F.lit(0))

    raw = F.col(vec_col).cast("array<double>")
    wrong = F.lit(False) if dimension is None else F.size(raw) != dimension
    odd = F.exists(raw, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    zero = F.forall(raw, lambda x: x == 0)
    problem = (
        F.when(raw.isNull(), "a vector is missing").when(wrong, "a vector has another dimension")
        .when(odd, "a vector is not finite").when(zero, "a vector has length zero")
    )
    checked = F.when(problem.isNotNull(), F.raise_error(problem).cast("array<double>")).otherwise(raw)
    once = unit(checked).cast("array<float>").cast("array<double>")
    return records.withColumn(vec_col, once).withColumn(vec_col, unit(F.col(vec_col)).cast("array<float>"))


# ------------------------------------------------------------------ blocks of rows


def _cells(queries: DataFrame, rows: DataFrame, columns: list[str], work, schema: str, *, block: int, symmetric: bool) -> DataFrame:
    """``work`` (a function of two Arrow tables) for each block of queries with each block of
    rows. A task holds one block of each; rows are dealt by a hash of their id, so a block
    has about ``block`` of them. If ``symmetric``, both sides are the same table and each
    pair of blocks meets once."""
    ship_package(rows.sparkSession)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = queries.count(), rows.count()
    n_q, n_r = (-(-n // block) or 1 for n in size)
    # Small tables are cut further, so that all cores have a block.
    n_r = max(n_r, min(-(-size[1] // 256), math.isqrt(2 * cores) + 1 if symmetric else -(-cores // n_q)))
    n_q = n_r if symmetric else n_q
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    later = F.sequence(F.col("i"), F.lit(n_r - 1)) if symmetric else F.sequence(F.lit(0), F.lit(n_r - 1))
    former = F.sequence(F.lit(0), F.col("j")) if symmetric else F.sequence(F.lit(0), F.lit(n_q - 1))
    q = queries.select("id", *columns, F.lit(True).alias("is_query"), deal(n_q).alias("i")).withColumn("j", F.explode(later))
    r = rows.select("id", *columns, F.lit(False).alias("is_query"), deal(n_r).alias("j")).withColumn("i", F.explode(former))

    def cell(key, table):
        mine = table.column("is_query").to_numpy(zero_copy_only=False)
        order = pc.sort_indices(table, sort_keys=[("id", "ascending")])
        table, mine = table.take(order), mine[order.to_numpy()]
        return work(table.filter(pa.array(mine)), table.filter(pa.array(~mine)), key[0].as_py() == key[1].as_py())

    return q.unionByName(r).groupBy("i", "j").applyInArrow(cell, schema)


def _pair_table(left, right, value, name: str, kind) -> pa.Table:
    return pa.table({"left_id": pa.array(left, pa.string()), "right_id": pa.array(right, pa.string()), name: pa.array(value, kind)})


def _fingerprint_cell(radius: int, symmetric: bool):
    def work(q: pa.Table, r: pa.Table, diagonal: bool) -> pa.Table:
        fq, fr = (t.column("fp").to_numpy().view(np.uint64) for t in (q, r))
        qi, ri = (np.array(t.column("id").to_pylist(), object) for t in (q, r))
        left, right, found = [], [], []
        for at in range(0, len(fq), 512):
            gaps = np.bitwise_count(fq[at : at + 512, None] ^ fr[None, :])
            x, y = np.nonzero(gaps <= radius)
            keep = qi[at + x] != ri[y] if not diagonal or not symmetric else qi[at + x] < ri[y]
            x, y = x[keep], y[keep]
            a, b = qi[at + x], ri[y]
            swap = (a > b) if symmetric else np.zeros(len(a), bool)
            left += np.where(swap, b, a).tolist()
            right += np.where(swap, a, b).tolist()
            found += gaps[x, y].tolist()
        return _pair_table(left, right, found, "distance", pa.int32())

    return work


#: A shuffled row of the block index takes about the time of so many comparisons.
_ROW_COST = 300


def block_masks(radius: int, agreeing: int) -> list[int]:
    """Masks of 64 bits, one of which two fingerprints within ``radius`` agree on: of
    ``radius`` + ``agreeing`` blocks of bits, ``radius`` flips leave ``agreeing`` blocks alone, so each
    choice of so many blocks is a mask."""
    n = radius + agreeing
    if n > 64:
        return [0]  # blocks of no bits agree always
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [(1 << high) - (1 << low) for low, high in zip(edges, edges[1:])]
    return [sum(some) for some in combinations(blocks, agreeing)]


def _index_cost(n: int, masks: list[int]) -> float:
    """Comparisons that an index of ``n`` fingerprints by ``masks`` takes, its rows included."""
    return n * len(masks) * _ROW_COST + n * n / 2 * sum(2.0 ** -m.bit_count() for m in masks)


def index_masks(n: int, radius: int) -> list[int]:
    """The masks of least cost for ``n`` fingerprints: more agreeing blocks propose fewer pairs
    and take more rows (at most 200 a fingerprint)."""
    choices = [masks for k in (1, 2, 3) if len(masks := block_masks(radius, k)) <= 200]
    return min(choices, key=lambda masks: _index_cost(n, masks))


def index_pays(n: int, radius: int) -> bool:
    """Whether the block index takes far fewer comparisons than all pairs do: blocks of real
    fingerprints agree more often than those of random ones."""
    return 4 * _index_cost(n, index_masks(n, radius)) < n * n / 2


def _indexed_pairs(classes: DataFrame, n: int, radius: int, block: int) -> DataFrame:
    """Pairs of the ``n`` classes within ``radius``: the classes that agree on a mask's bits are
    compared in NumPy. Groups of more than ``block`` classes are cut into parts and each pair of parts
    meets once, so no task depends on the size of a group. A pair that agrees on several masks is given
    by the first of them, so only hits leave a task and none twice."""
    spark = classes.sparkSession
    ship_package(spark)
    masks = index_masks(n, radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bits")) for k, m in enumerate(signed)])
    rows = classes.select("id", "fp", F.inline(keys))
    parts = F.lit(1)
    if n > block:
        large = rows.groupBy("mask", "bits").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts")).where("parts > 1")
        # At most (masks * n / block) groups are that large.
        rows = rows.join(F.broadcast(materialise(large, "large")), ["mask", "bits"], "left")
        parts = F.coalesce("parts", F.lit(1))
    rows = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("id", "fp", "mask", "bits", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part")
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-n * len(masks) // 100_000))
    dealt = rows.repartition(tasks, "mask", "bits", "i", "j")
    return dealt.mapInArrow(lambda it: _agreeing(it, masks, radius), "left_id string, right_id string, distance int")


def _agreeing(batches: Iterator[pa.RecordBatch], masks: list[int], radius: int) -> Iterator[pa.RecordBatch]:
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    mask, bits, i, j, part, fp = (table.column(c).to_numpy() for c in ("mask", "bits", "i", "j", "part", "fp"))
    order = np.lexsort((part, j, i, bits, mask))
    mask, bits, i, j, part, fp = (x[order] for x in (mask, bits, i, j, part, fp.view(np.uint64)))
    ids, bounds = table.column("id"), np.array(masks, np.uint64)
    new = np.concatenate([[True], (np.diff(mask) != 0) | (np.diff(bits) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0), [True]])
    edges = np.flatnonzero(new)
    several = np.diff(edges) > 1
    found: list[tuple] = []
    n = 0
    for low, high in zip(edges[:-1][several].tolist(), edges[1:][several].tolist()):
        whole = i[low] == j[low]
        middle = high if whole else low + int(np.count_nonzero(part[low:high] == i[low]))
        start = low if whole else middle
        strip = max(1, (1 << 17) // max(1, high - start))
        for at in range(low, middle, strip):
            # Within a part, a row meets the later ones.
            first = at + 1 if whole else start
            gaps = np.bitwise_count(fp[at : min(at + strip, middle), None] ^ fp[None, first:high])
            x, y = np.nonzero(gaps <= radius)
            distance, x, y = gaps[x, y], x + at, y + first
            keep = x < y
            for earlier in bounds[: mask[low]]:
                keep &= (fp[x] ^ fp[y]) & earlier != 0
            if keep.any():
                found.append((order[x[keep]], order[y[keep]], distance[keep]))
                n += len(found[-1][0])
            if n > 100_000:
                yield _ordered_pairs(ids, found)
                found, n = [], 0
    if found:
        yield _ordered_pairs(ids, found)


def _ordered_pairs(ids: pa.ChunkedArray, found: list[tuple]) -> pa.RecordBatch:
    x, y, distance = (np.concatenate(c) for c in zip(*found))
    a, b = (ids.take(pa.array(c)).combine_chunks() for c in (x, y))
    less = pc.less(a, b)
    ends = pc.if_else(less, a, b), pc.if_else(less, b, a), pa.array(distance, pa.int32())
    return pa.RecordBatch.from_arrays(list(ends), names=["left_id", "right_id", "distance"])


def hamming_pairs(records: DataFrame, radius: int, *, plan: str = "auto", block: int = 8192) -> DataFrame:
    """``left_id, right_id, distance`` of fingerprints (``fp``) within ``radius``.

    Records of one fingerprint are a class: its least id stands for it in the pairs with
    other classes and has a pair of distance 0 with each other member. All plans are exact:
    ``loop`` compares all classes, in blocks of rows; ``blocks`` compares those that agree on some
    blocks of their bits (``block_masks``); ``auto`` takes the one of fewer comparisons
    (``index_pays``).
    """
    checked_radius(radius)
    records = materialise(records.select("id", "fp"), "prints")  # packed once for the classes and their members
    classes = materialise(_classes(records, "fp"), "fingerprints")
    if plan == "auto":
        plan = "blocks" if index_pays(classes.count(), radius) else "loop"
    if plan == "loop":
        pairs = _cells(
            classes, classes, ["fp"], _fingerprint_cell(radius, True), "left_id string, right_id string, distance int",
            block=block, symmetric=True,
        )
    elif plan == "blocks":
        pairs = _indexed_pairs(classes, classes.count(), radius, block)
    else:
        raise ValueError(f"unknown plan {plan!r}")
    return pairs.unionByName(_star(records, classes, "fp").withColumn("distance", F.lit(0)))


def hamming_search(records: DataFrame, queries: DataFrame, radius: int, *, block: int = 8192) -> DataFrame:
    """``query_id, id, distance`` of all other records within ``radius`` of each query's ``fp``.
    Queries and records meet in blocks; nothing but the hits leaves a block."""
    checked_radius(radius)
    found = _cells(
        queries.where("fp IS NOT NULL"), records.where("fp IS NOT NULL"), ["fp"], _fingerprint_cell(radius, False),
        "left_id string, right_id string, distance int", block=block, symmetric=False,
    )
    return found.toDF("query_id", "id", "distance")


def _matrix(table: pa.Table, column: str = "vec") -> np.ndarray:
    values = table.column(column).combine_chunks()
    values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
    m = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    if not np.isfinite(m).all() or (norm == 0).any():
        raise ValueError("vectors must be finite and not of length zero")
    return m / norm


def _top(sims: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and columns of its ``k`` greatest values, ties to the first columns."""
    for i, row in enumerate(sims):
        if len(row) > k:
            least = np.partition(row, len(row) - k)[len(row) - k]
            above = np.flatnonzero(row > least)
            yield i, np.concatenate([above, np.flatnonzero(row == least)[: k - len(above)]])
        else:
            yield i, np.arange(len(row))


def _cosine_cell(threshold: float, k: int | None, symmetric: bool):
    def work(q: pa.Table, r: pa.Table, diagonal: bool) -> pa.Table:
        if not len(q) or not len(r):
            return _pair_table([], [], [], "cosine", pa.float64())
        left, right = _matrix(q), _matrix(r)
        qi, ri = (np.array(t.column("id").to_pylist(), object) for t in (q, r))
        place = {x: n for n, x in enumerate(ri)}
        out_l, out_r, out_c = [], [], []
        for at in range(0, len(left), 512):
            sims = np.clip(left[at : at + 512] @ right.T, -1.0, 1.0)
            if k is None:
                x, y = np.nonzero(sims >= threshold)
                keep = qi[at + x] < ri[y] if diagonal else qi[at + x] != ri[y]
                x, y = x[keep], y[keep]
            else:
                for n, name in enumerate(qi[at : at + 512]):
                    if name in place:
                        sims[n, place[name]] = -2.0  # a row is no neighbour of itself
                chosen = list(_top(sims, k))
                x = np.concatenate([np.full(len(c), i) for i, c in chosen])
                y = np.concatenate([c for _, c in chosen])
                keep = sims[x, y] >= threshold
                x, y = x[keep], y[keep]
            a, b = qi[at + x], ri[y]
            swap = (a > b) if symmetric else np.zeros(len(a), bool)
            out_l += np.where(swap, b, a).tolist()
            out_r += np.where(swap, a, b).tolist()
            out_c += sims[x, y].tolist()
        return _pair_table(out_l, out_r, out_c, "cosine", pa.float64())

    return work


def cosine_pairs(records: DataFrame, threshold: float, *, block: int = 4096) -> DataFrame:
    """``left_id, right_id, cosine`` of vectors (``vec``) with a cosine of at least ``threshold``.

    Equal vectors are a class, as in ``hamming_pairs``. Exact: the classes are compared in
    blocks of about ``block`` rows, each pair of blocks once, so the work is quadratic but
    no task holds more than two blocks and a strip of their products;
    ``approximate_neighbors`` is the choice for large tables.
    """
    checked_threshold(threshold)
    classes = materialise(_classes(records, "vec"), "vectors")
    found = _cells(
        classes, classes, ["vec"], _cosine_cell(threshold, None, True), "left_id string, right_id string, cosine double",
        block=block, symmetric=True,
    )
    return found.unionByName(_star(records, classes, "vec").withColumn("cosine", F.lit(1.0)))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("left_id").orderBy(F.desc("cosine"), "right_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_neighbors(records: DataFrame, queries: DataFrame, k: int, *, threshold: float = -1.0, block: int = 4096) -> DataFrame:
    """``left_id, right_id, cosine, rank``: at most ``k`` others per query by (-cosine, id).
    A block of rows gives at most ``k`` of them per query, ties to the least ids."""
    checked_k(k)
    checked_threshold(threshold)
    found = _cells(
        queries.where("vec IS NOT NULL"), records.where("vec IS NOT NULL"), ["vec"], _cosine_cell(threshold, k, False),
        "left_id string, right_id string, cosine double", block=block, symmetric=False,
    )
    return _ranked(found, k)


def _sign_codes(batches: Iterator[pa.RecordBatch], dim: int, bits: int, seed: int) -> Iterator[pa.RecordBatch]:
    planes = np.random.default_rng(seed).normal(size=(dim, bits))
    for batch in batches:
        if batch.num_rows:
            m = _matrix(pa.Table.from_batches([batch]))
            codes = np.packbits(m @ planes > 0, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "code"])


def _code_cell(most: int):
    def work(q: pa.Table, r: pa.Table, diagonal: bool) -> pa.Table:
        if not len(q) or not len(r):
            return _pair_table([], [], [], "gap", pa.int32())
        codes = [np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint64).reshape(len(t), -1) for t in (q, r)]
        qi, ri = (np.array(t.column("id").to_pylist(), object) for t in (q, r))
        place = {x: n for n, x in enumerate(ri)}
        out_l, out_r, out_g = [], [], []
        for n, (name, code) in enumerate(zip(qi, codes[0])):
            gaps = np.bitwise_count(codes[1] ^ code).sum(axis=1, dtype=np.int32)
            if name in place:
                gaps[place[name]] = 1 << 30
            [(_, some)] = _top(-gaps[None, :], most)
            some = some[gaps[some] < 1 << 30]
            out_l += [name] * len(some)
            out_r += ri[some].tolist()
            out_g += gaps[some].tolist()
        return _pair_table(out_l, out_r, out_g, "gap", pa.int32())

    return work


def approximate_neighbors(
    records: DataFrame, queries: DataFrame, k: int, *, threshold: float, bits: int = 256, refine: int = 30, seed: int = 1, block: int = 65536
) -> DataFrame:
    """Like ``nearest_neighbors``, by random-hyperplane codes of ``bits`` bits (a multiple of 64).

    Every row is indexed by its code. The codes, 32 bytes a row, are compared in blocks; the
    ``refine`` * ``k`` rows of each query with the nearest codes are the candidates, and only
    their vectors are fetched and compared exactly. Recall is to be measured with
    ``recall_at_k``.
    """
    checked_k(k)
    spark = records.sparkSession
    ship_package(spark)
    first = records.where("vec IS NOT NULL").first()
    if first is None:
        return spark.createDataFrame([], "left_id string, right_id string, cosine double, rank int")
    dim = len(first["vec"])

    def coded(df: DataFrame, label: str) -> DataFrame:
        rows = df.where("vec IS NOT NULL").select("id", "vec")
        return materialise(rows.mapInArrow(lambda it: _sign_codes(it, dim, bits, seed), "id string, code binary"), label)

    most = refine * k
    found = _cells(
        coded(queries, "codes"), coded(records, "codes"), ["code"], _code_cell(most), "left_id string, right_id string, gap int",
        block=block, symmetric=False,
    )
    nearest = Window.partitionBy("left_id").orderBy("gap", "right_id")
    near = found.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= most).select("left_id", "right_id")
    vectors = lambda df, end, name: df.where("vec IS NOT NULL").select(F.col("id").alias(end), F.col("vec").alias(name))
    met = near.join(vectors(queries, "left_id", "v1"), "left_id").join(vectors(records, "right_id", "v2"), "right_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    cos = dot("v1", "v2") / F.sqrt(dot("v1", "v1") * dot("v2", "v2"))
    return _ranked(met.select("left_id", "right_id", cos.alias("cosine")).where(F.col("cosine") >= threshold), k)


def nearest_fingerprints(records: DataFrame, queries: DataFrame, k: int, *, block: int = 8192) -> DataFrame:
    """``left_id, right_id, distance, rank``: at most ``k`` others per query by (distance, id)."""
    checked_k(k)

    def work(q: pa.Table, r: pa.Table, diagonal: bool) -> pa.Table:
        fq, fr = (t.column("fp").to_numpy().view(np.uint64) for t in (q, r))
        qi, ri = (np.array(t.column("id").to_pylist(), object) for t in (q, r))
        left, right, found = [], [], []
        for name, fp in zip(qi, fq):
            gaps = np.bitwise_count(fr ^ fp).astype(np.int32)
            gaps[ri == name] = 99
            [(_, some)] = _top(-gaps[None, :], k) if len(gaps) else [(0, np.empty(0, int))]
            some = some[gaps[some] < 99]
            left += [name] * len(some)
            right += ri[some].tolist()
            found += gaps[some].tolist()
        return _pair_table(left, right, found, "distance", pa.int32())

    found = _cells(
        queries.where("fp IS NOT NULL"), records.where("fp IS NOT NULL"), ["fp"], work, "left_id string, right_id string, distance int",
        block=block, symmetric=False,
    )
    order = Window.partitionBy("left_id").orderBy("distance", "right_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def pair_histogram(queries: DataFrame, records: DataFrame, cosines: list[float], *, block: int = 4096) -> DataFrame:
    """``corruption, is_duplicate, fold, exact, distance, level, n``: counts of the pairs of each
    query with each other record. ``corruption`` is the query's label, ``is_duplicate`` says that
    the labels are equal, ``fold`` is the other's ``number`` modulo 2, ``exact`` that the
    vectors are equal, ``distance`` that of the fingerprints and ``level`` the number of
    ``cosines`` (ascending) that the cosine reaches.

    Detectors and thresholds are then judged on the histogram. A block of each side is counted
    within a task, so no pair leaves it."""
    levels = np.array(cosines, float)

    def work(q: pa.Table, r: pa.Table, diagonal: bool) -> pa.Table:
        names = ["corruption", "is_duplicate", "fold", "exact", "distance", "level", "n"]
        kinds = [pa.string(), pa.bool_(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int64()]
        counts: dict[tuple, int] = {}
        if len(q) and len(r):
            m, other = _matrix(q), _matrix(r)
            fr, fold = r.column("fp").to_numpy().view(np.uint64), r.column("number").to_numpy() % 2
            label, ri = np.array(r.column("label").to_pylist(), object), np.array(r.column("id").to_pylist(), object)
            content = lambda t: np.array([v.tobytes() for v in np.array(t.column("vec").to_pylist(), np.float64)], object)
            raw, others = content(q), content(r)
            for name, fp, mine, row, bytes_ in zip(q.column("id").to_pylist(), q.column("fp").to_numpy().view(np.uint64), q.column("label").to_pylist(), m, raw):
                gaps = np.bitwise_count(fr ^ fp).astype(np.int64)
                level = np.searchsorted(levels, np.clip(other @ row, -1, 1), side="right")
                same, exact = (label == mine).astype(np.int64), (others == bytes_).astype(np.int64)
                key = (((same * 2 + fold) * 2 + exact) * 65 + gaps) * (len(levels) + 1) + level
                for code, n in zip(*(x.tolist() for x in np.unique(key[ri != name], return_counts=True))):
                    code, lv = divmod(code, len(levels) + 1)
                    code, gap = divmod(code, 65)
                    found = mine, bool(code >> 2), code >> 1 & 1, bool(code & 1), gap, lv
                    counts[found] = counts.get(found, 0) + n
        columns = list(zip(*[(*k, n) for k, n in counts.items()])) or [()] * 7
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    by = ["corruption", "is_duplicate", "fold", "exact", "distance", "level"]
    schema = "corruption string, is_duplicate boolean, fold int, exact boolean, distance int, level int, n long"
    cells = _cells(queries, records, ["number", "label", "fp", "vec"], work, schema, block=block, symmetric=False)
    return cells.groupBy(*by).agg(F.sum("n").alias("n"))


def recall_at_k(exact: DataFrame, found: DataFrame) -> DataFrame:
    """``n_exact, n_found, recall``: part of the exact directed pairs that were found (1 if none).
    A directed pair that stands twice on a side fails the job."""
    counted = lambda df, name: df.groupBy("left_id", "right_id").agg(F.count(F.lit(1)).alias(name))
    met = counted(exact, "e").join(counted(found, "f"), ["left_id", "right_id"], "full_outer")
    twice = F.when((F.col("e") > 1) | (F.col("f") > 1), F.raise_error(F.lit("a directed pair stands twice")).cast("long"))
    met = met.withColumn("e", F.coalesce(twice, F.col("e"))).where("e IS NOT NULL")
    counts = met.agg(F.count("e").alias("n_exact"), F.count("f").alias("n_found"))
    return counts.withColumn("recall", F.when(F.col("n_exact") == 0, 1.0).otherwise(F.col("n_found") / F.col("n_exact")))
