"""The audit of an image dataset, from manifest to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.operators import balance, duplicates, evidence
from twinsieve.runtime import materialise
from twinsieve.sources.images import load_manifest, scan


def audit(
    spark: SparkSession, source: str, *, radius: int = 8, threshold: float = 0.95, policy=evidence.Policy(), embeddings: bool = True,
    phash: bool = True, k: int | None = None, approximate: bool = False, max_pixels: int = 50_000_000, dataset_root: str | None = None,
) -> dict[str, DataFrame]:
    """Tables ``records, issues, edges, members, families, leaks, conflicts, semantic_conflicts,
    summary``. The cosine signal has every pair that reaches ``threshold``; with ``k`` only
    the ``k`` nearest of each record, found exactly or by codes (``approximate``)."""
    manifest, root = load_manifest(spark, source, dataset_root=dataset_root)
    seen = materialise(scan(manifest, root, max_pixels=max_pixels), "scan")
    records = seen.where("issue IS NULL")
    exact = duplicates.exact_edges(records)
    hamming = duplicates.hamming_pairs(records, radius) if phash else None
    cosine = None
    if embeddings and k is None:
        cosine = duplicates.cosine_pairs(records, threshold)
    elif embeddings:
        search = duplicates.approximate_neighbors if approximate else duplicates.nearest_neighbors
        cosine = search(records, records, k, threshold=threshold).select("left_id", "right_id", "cosine")
    edges = materialise(
        evidence.merge_evidence(records, exact, hamming, cosine, radius=radius, threshold=threshold, policy=policy), "edges"
    )
    members = materialise(evidence.membership(edges), "members")
    leaks = materialise(evidence.leakage_groups(records, members, edges), "leaks")
    return {
        "records": records,
        "issues": seen.where("issue IS NOT NULL").select("id", "path", "split", "label", F.col("issue").alias("code")),
        "edges": edges,
        "members": members,
        "families": materialise(evidence.families(members, edges), "families"),
        "leaks": leaks,
        "conflicts": evidence.definite_conflicts(records, members, edges),
        "semantic_conflicts": evidence.semantic_conflicts(records, members, edges),
        "summary": evidence.leakage_summary(records, members, leaks),
    }


def configured(spark: SparkSession, source: str, config, **options) -> dict[str, DataFrame]:
    """The audit that an ``AuditConfig`` asks for."""
    policy = evidence.Policy(
        config.policy.exact_is_duplicate, config.policy.phash_is_duplicate, config.policy.embedding_only_requires_review
    )
    return audit(
        spark, source, radius=config.phash.hamming_threshold, threshold=config.neighbors.cosine_threshold, policy=policy,
        embeddings=config.embeddings.enabled, phash=config.phash.enabled, k=config.neighbors.k,
        approximate=config.neighbors.index == "hnsw", max_pixels=config.io.max_image_pixels, **options,
    )


def repair(tables: dict[str, DataFrame], ratios, **options) -> tuple[DataFrame, balance.Plan]:
    return balance.repair_splits(tables["records"], tables["members"], ratios, **options)
