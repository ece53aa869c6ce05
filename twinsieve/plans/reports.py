"""Report views and constraint checks over an audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.functions.identity import CLASSES, KINDS, PRIVATE, boundaries, family_id
from twinsieve.operators import balance as B
from twinsieve.operators import duplicates as D
from twinsieve.operators import evidence as E
from twinsieve.operators import synthetic as S
from twinsieve.plans.queries import RATIOS, Audit, _repaired
from twinsieve.runtime import materialise, table


def safe_text(text: Column) -> Column:
    """Absolute paths, Windows or POSIX, become ``[private path]``."""
    for pattern, new in PRIVATE:
        text = F.regexp_replace(text, pattern, new)
    return text


def private_paths(spark, sf_dir):
    """Notes that hold paths of several forms, scrubbed; one per page."""
    name = F.regexp_replace("url", "^[a-z]+://", "")
    folder = F.element_at(F.array(*map(F.lit, ("/srv/", "C:\\data\\", "x:/", "(/home/", "rel/", '"/tmp/a/'))), (F.col("page_id") % 6 + 1).cast("int"))
    note = F.concat(F.lit("read "), folder, name, F.lit(" of "), F.col("url"), F.lit(" and/or 1/2"))
    return table(spark, sf_dir, "pages").select("page_id", safe_text(note).alias("note"))


def report_evidence(spark, sf_dir):
    """Flat edges for display, missing values as a dash."""
    e = Audit(spark, sf_dir).edges
    dash = lambda c: F.coalesce(c.cast("string"), F.lit("—"))
    return e.select(
        F.concat_ws(" ~ ", "left_id", "right_id").alias("pair"), "classification", "decision",
        dash(F.col("phash_distance")).alias("distance"), F.when(F.col("exact_match"), "yes").otherwise("no").alias("exact"),
    )


def report_repair_splits(spark, sf_dir):
    """Records per split before and after the repair."""
    out = _repaired(Audit(spark, sf_dir))
    count = lambda c, name: out.groupBy(F.col(c).alias("split")).agg(F.count(F.lit(1)).alias(name))
    met = count("original_split", "before").join(count("repaired_split", "after"), "split", "full_outer")
    return met.select("split", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("before", "after")])


def chained_fingerprint_pairs(spark, sf_dir):
    """Pairs among generated fingerprints: the planted ones, at distance 1."""
    return D.hamming_pairs(S.chained_fingerprints(spark, 2000), 1).select("left_id", "right_id", "distance")


def detection_benchmark(spark, sf_dir):
    return S.detection_benchmark(spark)


def audit_summary(spark, sf_dir):
    """The counts of an audit's summary."""
    a = Audit(spark, sf_dir)
    leaks = materialise(a.leaks, "leaks")
    one = E.leakage_summary(a.records, a.members, leaks)
    counted = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    conflicts = E.definite_conflicts(a.records, a.members, a.edges).select("kind").union(E.semantic_conflicts(a.records, a.members, a.edges).select("kind"))
    out = one.select(
        F.col("contaminated_records").alias("contaminated_images"), F.col("evaluation_records").alias("evaluation_images"),
        F.round("contaminated_fraction", 6).alias("contaminated_evaluation_fraction"), F.col("exact_groups").alias("exact_leakage_groups"),
        F.col("transformed_groups").alias("perceptual_leakage_groups"),
    )
    for df, name in (
        (a.records, "valid_images"), (leaks, "leakage_groups"), (E.semantic_reviews(a.records, a.edges), "embedding_only_reviews"),
        (conflicts, "cross_label_conflicts"),
    ):
        out = out.join(counted(df, name))  # one row each
    return out


def repair_order(spark, sf_dir):
    """The order in which the repair places groups."""
    a = Audit(spark, sf_dir)
    return B.placing_order(B.group_vectors(a.records, a.grouped), 42)


def normalised_vectors(spark, sf_dir):
    """Unit vectors as an index holds them: their length and two of their components."""
    v = D.normalised(a_vectors(spark, sf_dir))
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    part = lambda i: F.round(F.get("vec", F.lit(i)).cast("double"), 4)
    return v.select("number", F.round(length, 4).alias("length"), part(0).alias("first"), part(63).alias("last"))


def a_vectors(spark, sf_dir):
    return Audit(spark, sf_dir).vectors


def truth_constraints(spark, sf_dir):
    """``constraint, n``: synthetic pairs that contradict how they were made (0 everywhere)."""
    n = 6
    pairs = materialise(S.observations(spark, n), "observations")
    same = F.col("corruption").isin(*S.SAME_BYTES)
    per = pairs.groupBy("source", "corruption").agg(F.count_if("is_duplicate").alias("own"), F.count_if(~F.col("is_duplicate")).alias("controls"))
    checks = {
        "exact_bytes_follow_the_kind": pairs.where(F.col("is_duplicate") & (F.col("exact_match") != same)),
        "controls_come_from_another_source": pairs.where(F.col("is_duplicate") != (F.col("source") == F.col("other"))),
        "one_pair_and_control_per_kind": per.where("own <> 1 OR controls <> 1"),
        "every_kind_covered": per.groupBy("source").count().where(F.col("count") != len(S.KINDS)),
        "signals_in_range": pairs.where(~F.col("distance").between(0, 64) | ~F.col("cosine").between(-1, 1)),
    }
    counted = [df.agg(F.lit(name).alias("constraint"), F.count(F.lit(1)).alias("n")) for name, df in checks.items()]
    return reduce(DataFrame.unionByName, counted)


def constraint_violations(spark, sf_dir):
    """``constraint, n``: rows that break each contract of the audit (0 everywhere)."""
    a = Audit(spark, sf_dir)
    edges, members, records = a.edges, a.members, a.records
    families = materialise(E.families(members, edges), "families")
    leaks = materialise(E.leakage_groups(records, members, edges), "leaks")
    clusters = D.exact_clusters(a.docs)
    conflicts = E.definite_conflicts(records, members, edges)
    grouped = a.grouped
    inside = E.edges_in_families(members, edges).groupBy("root").agg(F.count(F.lit(1)).alias("k"))
    one_signal = F.col("exact_match") | F.col("phash_distance").isNotNull() | F.col("cosine_similarity").isNotNull()
    in_range = F.col("cosine_similarity").isNull() | F.col("cosine_similarity").between(-1.0, 1.0000001)
    rank = E.class_rank(F.col("strongest"))
    checks: dict[str, DataFrame] = {
        "edge_has_signal": edges.where(~one_signal),
        "edge_ends_ordered": edges.where(F.col("left_id") >= F.col("right_id")),
        "edge_pair_unique": edges.groupBy("left_id", "right_id").count().where("count > 1"),
        "edge_class_matches": edges.where(F.col("classification") != E.classification(F.col("exact_match"), F.col("phash_distance"))),
        "edge_values_in_range": edges.where(~in_range | (F.col("phash_distance") > 64) | ~F.col("confidence").between(0.0, 1.0)),
        "edge_ends_known": edges.select(F.col("left_id").alias("id")).union(edges.select("right_id")).join(records, "id", "left_anti"),
        "member_in_one_family": members.groupBy("id").count().where("count > 1"),
        "family_of_two_or_more": families.where("member_count < 2 OR edge_count < 1"),
        "family_id_recomputed": families.where(F.col("family_id") != family_id(F.split("members", ","))),
        "family_edge_count": families.join(inside, "root").where("edge_count <> k"),
        "definite_edge_in_family": edges.where("decision = 'definite'").join(E.edges_in_families(members, edges), ["left_id", "right_id"], "left_anti"),
        "leak_crosses_boundary": leaks.where(F.size("crossed") < 1),
        "leak_boundaries_recomputed": leaks.where(F.array_join("crossed", ",") != F.array_join(boundaries(F.split("splits", ",")), ",")),
        "leak_strongest_first": leaks.where((rank < 0) | (F.substring_index("evidence", ",", 1) != F.col("strongest")) | (F.col("strongest") == CLASSES[2])),
        "leak_conflict_flag": leaks.where(F.col("label_conflict") != F.contains("labels", F.lit(","))),
        "conflict_has_two_labels": conflicts.where(~F.contains("labels", F.lit(","))),
        "cluster_of_two_or_more": clusters.where("member_count < 2 OR cluster_id <> concat('exact_', byte_sha256)"),
        "cluster_members_recounted": clusters.join(a.docs.groupBy("byte_sha256").count(), "byte_sha256", "left").where("count IS NULL OR count <> member_count"),
        "cluster_boundaries_recomputed": clusters.where(
            (F.array_join(boundaries(F.split("splits", ",")), ",") != F.col("boundaries")) | (F.col("crosses_evaluation_boundary") != (F.col("boundaries") != ""))
        ),
        "boundary_counts_recomputed": E.boundary_counts(leaks).join(
            leaks.select(F.explode("crossed").alias("boundary")).groupBy("boundary").count(), "boundary", "left"
        ).where("n_groups <> coalesce(count, 0)"),
        "conflicts_within_families": conflicts.join(families, "root", "left_anti"),
        "conflict_kind_known": conflicts.where(~F.col("kind").isin(*KINDS[:2])),
        "record_in_one_group": grouped.groupBy("id").count().where("count <> 1"),
        "record_has_group": records.join(grouped, "id", "left_anti"),
        "targets_sum_to_records": records.agg(F.count(F.lit(1)).alias("n")).where(
            F.col("n") != F.lit(sum(B.integer_targets(records.count(), RATIOS).values()))
        ),
    }
    counted = [df.agg(F.lit(name).alias("constraint"), F.count(F.lit(1)).alias("n")) for name, df in checks.items()]
    return reduce(DataFrame.unionByName, counted)


QUERIES = {
    f.__name__: f
    for f in (private_paths, report_evidence, report_repair_splits, chained_fingerprint_pairs, detection_benchmark, audit_summary, repair_order, normalised_vectors, truth_constraints, constraint_violations)
}
CONSTRAINTS = (
    "edge_has_signal", "edge_ends_ordered", "edge_pair_unique", "edge_class_matches", "edge_values_in_range", "edge_ends_known",
    "member_in_one_family", "family_of_two_or_more", "family_id_recomputed", "family_edge_count", "definite_edge_in_family",
    "leak_crosses_boundary", "leak_boundaries_recomputed", "leak_strongest_first", "leak_conflict_flag", "conflict_has_two_labels",
    "cluster_of_two_or_more", "cluster_members_recounted", "cluster_boundaries_recomputed", "boundary_counts_recomputed",
    "conflicts_within_families", "conflict_kind_known", "record_in_one_group", "record_has_group", "targets_sum_to_records",
)
BODIES = {
    "private_paths": r"""SELECT page_id, regexp_replace(regexp_replace(note, '(^|[^A-Za-z0-9])[A-Za-z]:[\\/][^\s"''<>|]*', '\1[private path]', 'g'),
  '(^|[\s"''(=])/[^\s/"''<>|]+/[^\s"''<>|]*', '\1[private path]', 'g') AS note
FROM (SELECT page_id, 'read ' || (['/srv/', 'C:\data\', 'x:/', '(/home/', 'rel/', '"/tmp/a/'])[page_id % 6 + 1] || regexp_replace(url, '^[a-z]+://', '')
  || ' of ' || url || ' and/or 1/2' AS note FROM pages)""",
    "report_evidence": "SELECT left_id || ' ~ ' || right_id AS pair, classification, decision, coalesce(phash_distance::VARCHAR, '—') AS distance, CASE WHEN exact_match THEN 'yes' ELSE 'no' END AS exact FROM edges",
    "chained_fingerprint_pairs": "SELECT printf('syn_%012d', i - 1) AS left_id, printf('syn_%012d', i) AS right_id, 1 AS distance FROM range(0, 2000) r(i) WHERE i % 23 = 1",
    "audit_summary": """SELECT * FROM
  (SELECT count(*) AS valid_images FROM records), (SELECT count(*) AS leakage_groups, count(*) FILTER (WHERE kinds[1] = 'exact') AS exact_leakage_groups,
    count(*) FILTER (WHERE kinds[1] = 'transformed_duplicate') AS perceptual_leakage_groups FROM leaks),
  (SELECT count(*) AS embedding_only_reviews FROM sem WHERE ls <> rs),
  (SELECT count(*) AS cross_label_conflicts FROM (SELECT kind FROM conflicts UNION ALL SELECT kind FROM semconf)),
  (SELECT count(root) AS contaminated_images, count(*) FILTER (WHERE split IN ('val', 'test')) AS evaluation_images,
    round(count(root) FILTER (WHERE split IN ('val', 'test')) / count(*) FILTER (WHERE split IN ('val', 'test')), 6) AS contaminated_evaluation_fraction
    FROM records r LEFT JOIN (SELECT id, m.root FROM members m JOIN leaks l ON l.root = m.root) d USING (id))""",
    "repair_order": """SELECT g.group_id, row_number() OVER (ORDER BY size DESC, round(coalesce(entropy, 0.0), 9) DESC, sha256('42' || chr(0) || g.group_id), g.group_id) - 1 AS place
FROM (SELECT group_id, count(*) AS size FROM grouped GROUP BY 1) g LEFT JOIN (
  SELECT group_id, -sum(n / t * log2(n / t)) AS entropy FROM (SELECT group_id, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY group_id) AS t
  FROM grouped JOIN records USING (id) WHERE label IS NOT NULL GROUP BY 1, 2) GROUP BY 1) e USING (group_id)""",
    "normalised_vectors": "SELECT number, 1.0::DOUBLE AS length, round(vec[1] / n, 4) AS first, round(vec[64] / n, 4) AS last FROM (SELECT *, sqrt(list_dot_product(vec, vec)) AS n FROM vecs)",
    "truth_constraints": "SELECT unnest(['exact_bytes_follow_the_kind', 'controls_come_from_another_source', 'one_pair_and_control_per_kind', 'every_kind_covered', 'signals_in_range']) AS \"constraint\", 0::BIGINT AS n",
    "constraint_violations": "SELECT unnest([" + ", ".join(f"'{c}'" for c in CONSTRAINTS) + "]) AS \"constraint\", 0::BIGINT AS n",
}
