"""Merging signals to typed edges, families, leakage, conflicts and reviews."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.functions.identity import CLASSES, KINDS, SPLITS, boundaries, family_id, rank_of, sorted_by_rank
from twinsieve.operators.components import connected_components


@dataclass(frozen=True)
class Policy:
    """Which evidence makes an edge definite; other edges are for review."""

    exact_is_duplicate: bool = True
    transformed_is_duplicate: bool = True
    embedding_only_requires_review: bool = True


def classification(exact: Column, distance: Column) -> Column:
    return F.when(exact, CLASSES[0]).when(distance.isNotNull(), CLASSES[1]).otherwise(CLASSES[2])


def decision(kind: Column, policy: Policy) -> Column:
    sure = (
        (F.lit(policy.exact_is_duplicate) & (kind == CLASSES[0]))
        | (F.lit(policy.transformed_is_duplicate) & (kind == CLASSES[1]))
        | (F.lit(not policy.embedding_only_requires_review) & (kind == CLASSES[2]))
    )
    return F.when(sure, "definite").otherwise("review")


def confidence(kind: Column, distance: Column, cosine: Column) -> Column:
    """A ranking score, not a probability."""
    return F.when(kind == CLASSES[0], F.lit(1.0)).when(kind == CLASSES[1], 1.0 - distance / 64).otherwise((cosine + 1) / 2)


def merge_evidence(
    records: DataFrame,
    exact: DataFrame | None,
    hamming: DataFrame | None,
    cosine: DataFrame | None,
    *,
    radius: int,
    threshold: float,
    policy: Policy = Policy(),
) -> DataFrame:
    """``left_id, right_id, exact_match, phash_distance, cosine_similarity, classification,
    decision, confidence``: one row per unordered pair with a signal within its threshold.

    A pair of equal content counts as exact whatever signal proposed it, if the exact
    signal is given. The least distance and the greatest cosine of a pair count.
    """
    typed = []
    for df, columns in (
        (exact, (F.lit(True), F.lit(None), F.lit(None))),
        (hamming, (F.lit(False), F.col("distance") if hamming is not None else None, F.lit(None))),
        (cosine, (F.lit(False), F.lit(None), F.col("cosine") if cosine is not None else None)),
    ):
        if df is not None:
            typed.append(df.select(
                F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"),
                columns[0].alias("e"), columns[1].cast("int").alias("d"), columns[2].cast("double").alias("c"),
            ))
    every = typed[0]
    for more in typed[1:]:
        every = every.unionByName(more)
    merged = every.where("left_id <> right_id").groupBy("left_id", "right_id").agg(
        F.bool_or("e").alias("e"), F.min(F.when(F.col("d") <= radius, F.col("d"))).alias("phash_distance"),
        F.max(F.when(F.col("c") >= threshold, F.col("c"))).alias("cosine_similarity"),
    )
    if exact is not None:
        content = records.select("id", "byte_sha256")
        merged = (
            merged.join(content.toDF("left_id", "s1"), "left_id", "left")
            .join(content.toDF("right_id", "s2"), "right_id", "left")
            .withColumn("e", F.col("e") | F.coalesce(F.col("s1") == F.col("s2"), F.lit(False)))
        )
    kind = classification(F.col("exact_match"), F.col("phash_distance"))
    return (
        merged.withColumnRenamed("e", "exact_match")
        .where(F.col("exact_match") | F.col("phash_distance").isNotNull() | F.col("cosine_similarity").isNotNull())
        .select("left_id", "right_id", "exact_match", "phash_distance", "cosine_similarity", kind.alias("classification"))
        .withColumn("decision", decision(F.col("classification"), policy))
        .withColumn("confidence", confidence(F.col("classification"), F.col("phash_distance"), F.col("cosine_similarity")))
    )


def membership(edges: DataFrame) -> DataFrame:
    """``id, root`` of the components of the definite edges."""
    found = connected_components(edges.where("decision = 'definite'"), "left_id", "right_id", one_task=200_000)
    return found.select(F.col("node").alias("id"), F.col("comp").alias("root"))


def families(members: DataFrame, edges: DataFrame) -> DataFrame:
    """``root, family_id, members, member_count, edge_count``. The id is a hash over all
    sorted member ids, so a family's ids (not its records) meet in one row."""
    ids = members.groupBy("root").agg(F.array_sort(F.collect_set("id")).alias("m"))
    inside = edges_in_families(members, edges).groupBy("root").agg(F.count(F.lit(1)).alias("edge_count"))
    return ids.join(inside, "root").select(
        "root", family_id(F.col("m")).alias("family_id"), F.array_join("m", ",").alias("members"),
        F.size("m").cast("long").alias("member_count"), "edge_count",
    )


def edges_in_families(members: DataFrame, edges: DataFrame, only: str = "definite") -> DataFrame:
    """Definite edges with the family (``root``) that both ends lie in."""
    left, right = members.toDF("left_id", "root"), members.toDF("right_id", "root2")
    chosen = edges.where(F.col("decision") == only) if only else edges
    return chosen.join(left, "left_id").join(right, "right_id").where("root = root2").drop("root2")


def leakage_groups(records: DataFrame, members: DataFrame, edges: DataFrame) -> DataFrame:
    """Families that cross a protected boundary and have definite exact or transformed
    evidence: ``root, member_count, splits, boundaries, evidence, strongest, labels,
    label_conflict``."""
    inside = edges_in_families(members, edges).where(F.col("classification") != CLASSES[2])
    proof = inside.groupBy("root").agg(F.collect_set("classification").alias("ev"))
    met = members.join(records.select("id", "split", "label"), "id").groupBy("root").agg(
        F.count(F.lit(1)).alias("member_count"), F.collect_set("split").alias("s"), F.collect_set("label").alias("l")
    )
    evidence = sorted_by_rank(F.col("ev"), CLASSES)
    return met.join(proof, "root").where(F.size(boundaries(F.col("s"))) > 0).select(
        "root", "member_count",
        F.array_join(sorted_by_rank(F.col("s"), SPLITS), ",").alias("splits"),
        boundaries(F.col("s")).alias("crossed"),
        F.array_join(evidence, ",").alias("evidence"), F.get(evidence, F.lit(0)).alias("strongest"),
        F.array_join(F.array_sort("l"), ",").alias("labels"), (F.size("l") > 1).alias("label_conflict"),
    )


def boundary_counts(groups: DataFrame) -> DataFrame:
    """``boundary, n_groups`` for each protected boundary, zeros included."""
    from twinsieve.functions.identity import BOUNDARIES

    names = groups.sparkSession.createDataFrame([("-".join(b),) for b in BOUNDARIES], "boundary string")
    met = groups.select(F.explode("crossed").alias("boundary")).groupBy("boundary").agg(F.count(F.lit(1)).alias("n"))
    return names.join(met, "boundary", "left").select("boundary", F.coalesce("n", F.lit(0)).alias("n_groups"))


def leakage_summary(records: DataFrame, members: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: contaminated and evaluation records, the fraction, groups by evidence."""
    held = F.col("split").isin("val", "test")
    dirty = members.join(groups.select("root"), "root", "left_semi").select("id", F.lit(True).alias("dirty"))
    met = records.select("id", "split").join(dirty, "id", "left")
    n = met.agg(
        F.count("dirty").alias("contaminated_records"), F.count_if(held).alias("evaluation_records"),
        F.count_if(held & F.col("dirty").isNotNull()).alias("contaminated_evaluation_records"),
    )
    kinds = groups.agg(
        F.count_if(F.col("strongest") == CLASSES[0]).alias("exact_groups"),
        F.count_if(F.col("strongest") == CLASSES[1]).alias("transformed_groups"),
    )
    share = F.col("contaminated_evaluation_records") / F.col("evaluation_records")
    return n.withColumn("contaminated_fraction", F.when(F.col("evaluation_records") == 0, 0.0).otherwise(share)).join(kinds)


def semantic_only(edges: DataFrame) -> DataFrame:
    """Review edges with no evidence but the cosine, without pairs that are definite elsewhere."""
    only = edges.where(
        (F.col("decision") == "review") & (F.col("classification") == CLASSES[2]) & ~F.col("exact_match")
        & F.col("phash_distance").isNull() & F.col("cosine_similarity").isNotNull()
    )
    return only.join(edges.where("decision = 'definite'").select("left_id", "right_id"), ["left_id", "right_id"], "left_anti")


def with_ends(edges: DataFrame, records: DataFrame) -> DataFrame:
    ends = records.select("id", "split", "label")
    left, right = ends.toDF("left_id", "left_split", "left_label"), ends.toDF("right_id", "right_split", "right_label")
    return edges.join(left, "left_id").join(right, "right_id")


def semantic_reviews(records: DataFrame, edges: DataFrame) -> DataFrame:
    """Semantic-only pairs over a protected boundary, the best edge of each pair."""
    met = with_ends(semantic_only(edges), records)
    crossing = met.where(F.size(boundaries(F.array("left_split", "right_split"))) > 0)
    best = F.max(F.struct("cosine_similarity", "confidence"))
    return crossing.groupBy("left_id", "right_id", "left_split", "right_split").agg(best.alias("b")).select(
        "left_id", "right_id", "left_split", "right_split", F.col("b.cosine_similarity").alias("cosine_similarity")
    )


def definite_conflicts(records: DataFrame, members: DataFrame, edges: DataFrame) -> DataFrame:
    """``root, labels, kind`` of families with a definite edge between different known labels."""
    inside = with_ends(edges_in_families(members, edges), records).where(
        (F.col("classification") != CLASSES[2]) & (F.col("left_label") != F.col("right_label"))
    )
    kinds = inside.groupBy("root").agg(F.bool_or(F.col("classification") == CLASSES[0]).alias("exact"))
    labels = members.join(records.select("id", "label"), "id").groupBy("root").agg(F.collect_set("label").alias("l"))
    return kinds.join(labels, "root").where(F.size("l") > 1).select(
        "root", F.array_join(F.array_sort("l"), ",").alias("labels"), F.when(F.col("exact"), KINDS[0]).otherwise(KINDS[1]).alias("kind")
    )


def semantic_conflicts(records: DataFrame, members: DataFrame, edges: DataFrame) -> DataFrame:
    """``family_id, members, labels, kind`` of semantic-only pairs of different known labels
    whose ends are not in one family with a definite conflict."""
    pairs = with_ends(semantic_only(edges), records).where("left_label <> right_label")
    hit = members.join(definite_conflicts(records, members, edges).select("root"), "root", "left_semi").select("id", "root")
    free = pairs.join(hit.toDF("left_id", "r1"), "left_id", "left").join(hit.toDF("right_id", "r2"), "right_id", "left")
    both = F.array("left_id", "right_id")
    return free.where(~F.coalesce(F.col("r1") == F.col("r2"), F.lit(False))).select(
        family_id(both).alias("family_id"), F.concat_ws(",", "left_id", "right_id").alias("members"),
        F.array_join(F.array_sort(F.array("left_label", "right_label")), ",").alias("labels"), F.lit(KINDS[2]).alias("kind"),
    )


def class_rank(kind: Column) -> Column:
    return rank_of(kind, CLASSES)
