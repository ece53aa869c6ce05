"""Near-duplicate groups by SuperMinHash, banding, exact verification and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinsieve.llm.words import U64, WordHashes, mix64, shingle_set
from twinsieve.operators.components import connected_components, merged_components
from twinsieve.runtime import drop_materialised, materialise, ship_package

_STEP = 0x9E3779B97F4A7C15


def superminhash(elements: np.ndarray, owner: np.ndarray, n_owners: int, slots: int) -> np.ndarray:
    """SuperMinHash signatures, ``n_owners`` x ``slots``; ``owner`` gives each element's row.

    Element x visits the slots in a random order of its own; visit j offers slot value
    j + r, r in [0, 1), and a slot keeps the least offer. All elements of a row make visit
    j at once; a row stops when all its slots are filled, as later visits only offer more.
    The order is a Fisher-Yates shuffle that is replayed from the swaps so far.
    """
    sig = np.full(n_owners * slots, np.inf)
    swaps: list[np.ndarray] = []
    for j in range(slots):
        draw = mix64(elements + U64((_STEP * (2 * j + 1)) & 0xFFFFFFFFFFFFFFFF))
        pick = mix64(elements ^ U64((_STEP * (2 * j + 2)) & 0xFFFFFFFFFFFFFFFF))
        at = (j + (pick >> U64(32)).astype(np.int64) * (slots - j) // (1 << 32)).astype(np.int32)
        swaps.append(at)
        slot = at.copy()
        for i in range(j - 1, -1, -1):
            slot[slot == swaps[i]] = i
        np.minimum.at(sig, owner * slots + slot, j + (draw >> U64(11)).astype(np.float64) * 2.0**-53)
        filled = np.isfinite(sig.reshape(n_owners, slots)).all(axis=1)
        alive = ~filled[owner]
        if not alive.any():
            break
        if not alive.all():
            elements, owner = elements[alive], owner[alive]
            swaps = [s[alive] for s in swaps]
    return sig.reshape(n_owners, slots)


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit bucket key per row and band."""
    bits = signatures.view(U64).reshape(len(signatures), bands, -1)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=U64), bits.shape[:2]).copy()
    for c in range(bits.shape[2]):
        keys = mix64(keys * U64(_STEP) + bits[:, :, c])
    return keys


def sign_batches(
    batches: Iterator[pa.RecordBatch], *, width: int, bands: int, rows: int, per_block: int = 60_000
) -> Iterator[pa.RecordBatch]:
    """``doc_id, text`` -> ``doc_id, n_shingles, d1, d2, bands`` (digest of the set, bucket keys)."""
    hashes = WordHashes()
    with np.errstate(over="ignore"):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            sets = []
            for text in texts:
                words = (text.as_py() or b"").lower().split()  # bytes: only A-Z change, and the six blanks split
                sets.append(shingle_set(hashes.of(words), width))
            keys = np.zeros((len(sets), bands), U64)
            begin = 0
            while begin < len(sets):
                end, total = begin, 0
                while end < len(sets) and (end == begin or total + len(sets[end]) <= per_block):
                    total += len(sets[end])
                    end += 1
                some = [i for i in range(begin, end) if len(sets[i])]
                if some:
                    owner = np.repeat(np.arange(len(some)), [len(sets[i]) for i in some])
                    sig = superminhash(np.concatenate([sets[i] for i in some]), owner, len(some), bands * rows)
                    keys[some] = band_keys(sig, bands)
                begin = end
            digests = [xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else 0 for s in sets]
            empty = np.array([len(s) == 0 for s in sets], bool)
            flat = pa.array(keys.view(np.int64).reshape(-1))
            offsets = pa.array(np.arange(0, len(sets) * bands + 1, bands, dtype=np.int32))
            half = lambda shift: np.array([(d >> shift) & (2**64 - 1) for d in digests], U64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(half(64), mask=empty),
                    pa.array(half(0), mask=empty),
                    pa.ListArray.from_arrays(offsets, flat),
                ],
                names=["doc_id", "n_shingles", "d1", "d2", "bands"],
            )


def verify_batches(
    batches: Iterator[pa.RecordBatch], *, width: int, percent: int
) -> Iterator[pa.RecordBatch]:
    """``a, b, text_a, text_b`` -> the pairs whose full sets reach the similarity."""
    hashes = WordHashes()
    last: tuple = (None, None)
    with np.errstate(over="ignore"):
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            left, right = batch.column("text_a").cast(pa.binary()), batch.column("text_b").cast(pa.binary())
            keep = []
            for i in range(len(a)):
                text = left[i].as_py() or b""
                if last[0] != text:  # a hub's pairs stand together
                    last = text, shingle_set(hashes.of(text.lower().split()), width)
                mine = last[1]
                other = shingle_set(hashes.of((right[i].as_py() or b"").lower().split()), width)
                both = len(np.intersect1d(mine, other, assume_unique=True))
                if both and 100 * both >= percent * (len(mine) + len(other) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())],
                names=["a", "b"],
            )


def gram_batches(batches: Iterator[pa.RecordBatch], *, width: int) -> Iterator[pa.RecordBatch]:
    """``fam, rep, text`` -> ``fam, rep, g``: a row for each shingle of the set."""
    hashes = WordHashes()
    with np.errstate(over="ignore"):
        for batch in batches:
            fams, reps = batch.column("fam").to_numpy(), batch.column("rep").to_numpy()
            texts = batch.column("text").cast(pa.binary())
            for begin in range(0, len(reps), 200):
                part = range(begin, min(begin + 200, len(reps)))
                sets = [shingle_set(hashes.of((texts[i].as_py() or b"").lower().split()), width) for i in part]
                sizes = [len(x) for x in sets]
                rows = (np.repeat(fams[begin : part.stop], sizes), np.repeat(reps[begin : part.stop], sizes), np.concatenate(sets).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["fam", "rep", "g"])


#: A family's rows are dealt over this many keys where they meet a row of their family.
SALTS = 32


def _meet(rows: DataFrame, few: DataFrame) -> DataFrame:
    """``rows`` joined on ``fam`` with ``few``, the smaller side, which is given to each deal:
    no family of any size lies in one task."""
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int"))
    every = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(every, ["fam", "salt"]).drop("salt")


def _label_sets(texts: DataFrame, signed: DataFrame, *, width: int, percent: int) -> DataFrame:
    """``d1, d2, top`` for each distinct set of ``signed`` that has a link or none: the least id
    of its group. Ids are unique in ``texts`` (null ids have no part)."""
    made = []

    def keep(df: DataFrame, label: str) -> DataFrame:
        made.append(materialise(df, label))
        return made[-1]

    reps = materialise(
        signed.where("doc_id IS NOT NULL AND n_shingles > 0")
        .groupBy("d1", "d2")
        .agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"), F.min("n_shingles").alias("n")),
        "near-reps",
    )
    spread = reps.select("rep", "n", F.explode("bands").alias("bucket"))
    hubs = spread.groupBy("bucket").agg(F.min("rep").alias("a"), F.min_by("n", "rep").alias("na"), F.max("rep").alias("hi"))
    stars = keep(
        spread.join(hubs.where("a < hi"), "bucket").where("rep <> a")
        .select("a", "na", F.col("rep").alias("b"), F.col("n").alias("nb"))
        .distinct(),
        "near-stars",
    )
    members = keep(stars.select("a", "na").union(stars.select("b", "nb")).toDF("rep", "n").distinct(), "near-members")
    known = keep(texts.join(members.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), "near-texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The linked ones of ``a, b``. A pair carries the text of ``b`` to that of ``a``, of
        which each deal of its pairs has a copy, so that a hub's pairs lie in many tasks."""
        dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
        halves = dealt.join(known.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        tops = known.join(dealt.select(F.col("a").alias("doc_id"), "salt").distinct(), "doc_id")
        full = halves.join(tops.select(F.col("doc_id").alias("a"), "salt", F.col("text").alias("text_a")), ["a", "salt"])
        return full.select("a", "b", "text_a", "text_b").mapInArrow(
            lambda it: verify_batches(it, width=width, percent=percent), "a long, b long"
        )

    # A pair's sizes alone can rule it out: the intersection is at most the smaller set.
    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    # Enough in common: i / (x + y - i) >= percent / 100.
    enough = lambda i, x, y: (100 + percent) * i >= percent * (x + y)

    families = keep(connected_components(stars, "a", "b").select(F.col("node").alias("rep"), F.col("comp").alias("fam")), "near-families")
    links = keep(confirmed(stars.where(fits(F.col("na"), F.col("nb"))).select("a", "b")), "near-links")
    labels = keep(connected_components(links, "a", "b"), "near-labels")

    def open_members(labels: DataFrame) -> DataFrame:
        """``rep, n, fam, comp`` of the families that lie in several components so far."""
        placed = (
            families.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
            .withColumn("comp", F.coalesce("comp", "rep"))
            .join(members, "rep")
        )
        split = placed.groupBy("fam").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
        return keep(_meet(placed, split.select("fam")).select("rep", "n", "fam", "comp"), "near-open")

    def settled(labels: DataFrame, unsettled: DataFrame) -> DataFrame:
        """``labels`` after the open families are resolved through their cores."""
        grams = keep(
            unsettled.select("rep", "fam")
            .join(known.withColumnRenamed("doc_id", "rep"), "rep")
            .select("fam", "rep", "text")
            .mapInArrow(lambda it: gram_batches(it, width=width), "fam long, rep long, g long"),
            "near-grams",
        )
        sizes = unsettled.groupBy("fam").agg(F.count(F.lit(1)).alias("k"))
        counted = grams.groupBy("fam", "g").agg(F.count(F.lit(1)).alias("df")).where("df > 1").withColumnRenamed("g", "rep")
        often = keep(
            _meet(counted, sizes).select("fam", F.col("rep").alias("g"), "df", (2 * F.col("df") >= F.col("k")).alias("core")), "near-often"
        )
        shared_grams = keep(grams.join(often.hint("merge"), ["fam", "g"]).select("fam", "rep", "g", "df", "core"), "near-shared")
        parts = shared_grams.groupBy("rep").agg(F.count(F.lit(1)).alias("m"), F.count_if("core").alias("c"))
        cores = sizes.select("fam").join(often.where("core").groupBy("fam").agg(F.count(F.lit(1)).alias("core_size")), "fam", "left")
        measured = keep(
            _meet(unsettled.select("rep", "n", "fam").join(parts, "rep"), cores.fillna(0)).select("rep", "n", "fam", "m", "c", "core_size"),
            "near-measured",
        )
        nearest = measured.groupBy("fam").agg(
            F.max(F.struct((F.col("c") / (F.col("n") + F.col("core_size") - F.col("c"))).alias("j"), (-F.col("rep")).alias("r"), F.col("n"))).alias("hub")
        )
        nearest = nearest.select("fam", (-F.col("hub.r")).alias("hub"), F.col("hub.n").alias("hub_n"))
        pairs = (
            _meet(unsettled, nearest)
            .where((F.col("rep") != F.col("hub")) & fits(F.col("n"), F.col("hub_n")))
            .select(F.col("hub").alias("a"), F.col("rep").alias("b"))
        )
        more = keep(confirmed(pairs), "near-links")
        labels = keep(merged_components(labels, more, "a", "b"), "near-labels")

        # m counts what a member can have in common with any other at all, c its part of the core.
        left = open_members(labels).join(measured.select("rep", "m", "c"), "rep")
        left = keep(left.where(100 * F.col("m") >= percent * F.col("n")), "near-left")
        if left.isEmpty():
            return labels
        able = 100 * F.col("c") >= percent * F.col("n")
        apart = F.col("comp1") != F.col("comp2")
        renamed = lambda df, *keys: df.select(*keys, *[F.col(x).alias(x + "1") for x in ("rep", "n", "comp", "m", "c")])
        second = lambda df, *keys: df.select(*keys, "rep", *[F.col(x).alias(x + "2") for x in ("n", "comp", "m", "c")])
        major = left.where(able).groupBy("fam", "comp").count().groupBy("fam").agg(F.max(F.struct("count", "comp"))["comp"].alias("main"))
        minor = _meet(left.where(able), major).where(F.col("comp") != F.col("main"))
        in_core = _meet(second(left.where(able), "fam"), renamed(minor, "fam")).where(
            apart & enough(F.least("c1", "c2"), F.col("n1"), F.col("n2"))
        )
        # Of two sets that reach the similarity, one of the shared grams is among the rarest of
        # both (prefix filter): n - percent % of n + 1 of all, of which n - m are not shared at all.
        floor = F.floor((F.lit(percent) * F.col("n") + 99) / 100)
        rarest = F.row_number().over(Window.partitionBy("rep").orderBy("df", "g"))
        early = shared_grams.withColumn("place", rarest).where(~F.col("core")).select("rep", "g", "place").join(left, "rep")
        early = early.where(F.col("place") <= F.col("m") - floor + 1)
        outside = renamed(early, "fam", "g").join(second(early, "fam", "g"), ["fam", "g"]).where(
            (F.col("rep1") < F.col("rep")) & apart & enough(F.least("m1", "m2"), F.col("n1"), F.col("n2"))
        )
        ends = lambda df: df.select(F.least("rep1", "rep").alias("a"), F.greatest("rep1", "rep").alias("b"))
        pairs = keep(ends(in_core).unionByName(ends(outside)).distinct(), "near-pairs")
        if not pairs.isEmpty():
            labels = keep(merged_components(labels, keep(confirmed(pairs), "near-links"), "a", "b"), "near-labels")
        return labels

    unsettled = open_members(labels)
    if not unsettled.isEmpty():
        labels = settled(labels, unsettled)
    tops = materialise(
        reps.select("d1", "d2", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        .select("d1", "d2", F.coalesce("comp", "rep").alias("top")),
        "near-tops",
    )
    for done in (reps, *made):
        drop_materialised(done)
    return tops


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 3,
    percent: int = 85,
    bands: int = 32,
    rows: int = 6,
) -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` for each row of ``docs``.

    Two documents are linked if the intersection of their sets of ``width``-word shingles
    (A-Z lower-cased) is at least ``percent`` % of the union; groups are the components of
    the links, named by their least id, and ``kept`` marks the row of that id.

    1. Each text gives a SuperMinHash signature of ``bands * rows`` slots and a digest of
       its set. Equal sets are collapsed to their least id (map-side combined).
    2. Buckets of equal bands: each member is checked against the bucket's least id, so the
       pairs grow with the bucket's size and not its square. With the defaults a pair at
       0.85 shares no bucket with odds of 3e-7, one at 0.9 with 1e-11.
       What a family of buckets leaves in several components is then resolved exactly:
       its core is the set of shingles that half of its members have. Each member is
       checked against the member nearest to the core. Of the pairs that then still lie in
       different components, two that share no shingle outside of the core (and are both
       in it) can have at most the smaller core part in common; so only pairs that share
       one of their rarest, or whose core parts are large enough, are checked.
    3. Every pair is confirmed on the full sets, from the whole texts.
    4. Components by distributed star contraction.

    Ids are integers (they are cast to long). Null or empty texts have an empty set and are
    linked with nothing. Rows with a null id are linked with nothing (``component_id`` null,
    ``kept`` true). Rows that share an id and have words are linked with each other: the
    group of one is the group of all. If any id is repeated, the rows are first numbered in the
    order of their ids (a sort of the texts) and the numbers stand for them. An empty table
    gives an empty result. Other columns are not read.
    """
    ship_package(docs.sparkSession)

    def signatures(rows_: DataFrame) -> DataFrame:
        return materialise(
            rows_.mapInArrow(
                lambda it: sign_batches(it, width=width, bands=bands, rows=rows),
                "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>",
            ),
            "near-signed",
        )

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    repeated = texts.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    numbered = None
    if not repeated.isEmpty():
        order = texts.withColumn("seq", F.monotonically_increasing_id()).orderBy(F.asc_nulls_last("doc_id"), "seq")
        numbered = materialise(order.select(F.monotonically_increasing_id().alias("number"), "doc_id", "text"), "near-rows")
        texts = numbered.select(F.when(F.col("doc_id").isNotNull(), F.col("number")).alias("doc_id"), "text")
    signed = signatures(texts)
    tops = _label_sets(texts, signed, width=width, percent=percent)
    same = (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")) & F.col("doc_id").isNotNull()
    # A row for each distinct set: never to be broadcast, however well its files compress.
    found = signed.join(tops.withColumnsRenamed({"d1": "e1", "d2": "e2"}).hint("merge"), same, "left")
    found = found.select("doc_id", "n_shingles", F.coalesce("top", "doc_id").alias("component_id"))
    if numbered is not None:
        found = materialise(found, "near-found")
        own = numbered.select(F.col("number").alias("doc_id"), F.col("doc_id").alias("own"))
        placed = found.join(own, "doc_id")
        firsts = placed.where("n_shingles > 0").groupBy("own").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("k"))
        links = placed.where("n_shingles > 0").join(firsts.where("k > 1").select("own", "a"), "own").where("doc_id <> a")
        labels = found.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("node"), F.col("component_id").alias("comp"))
        labels = merged_components(labels, links.select("a", F.col("doc_id").alias("b")), "a", "b")
        tops = own.toDF("comp", "component_id")
        whole = labels.join(tops, "comp").join(own.toDF("node", "own"), "node").join(found.select(F.col("doc_id").alias("node"), "n_shingles"), "node")
        without = found.where("doc_id IS NULL").select(F.lit(None).cast("long"), "n_shingles", F.lit(None).cast("long"))
        found = whole.select("own", "n_shingles", "component_id").union(without).toDF("doc_id", "n_shingles", "component_id")
    return found.select(
        F.col("doc_id").alias(id_col), "n_shingles", "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
