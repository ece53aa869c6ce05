"""DuckDB SQL that gives the same rows as the queries of ``queries``."""

from __future__ import annotations

from twinsieve.plans.experiment import BODIES as EXPERIMENT_BODIES
from twinsieve.plans.queries import RATIOS
from twinsieve.plans.reports import BODIES as REPORT_BODIES
from twinsieve.sources.tables import COSINE, NEIGHBOURS, RADIUS

_HEX = "printf('%016x', strlen({0})) || hex(encode({0}))"


def _stable(ns: str, *parts: str) -> str:
    body = " || ".join(_HEX.format(p) for p in (f"'{ns}'", *parts))
    return f"'{ns}_' || left(sha256(unhex({body})), 24)"


def _family(ids: str) -> str:
    """Id of the sorted list of distinct ids ``ids``."""
    one = _HEX.format("x")
    head = _HEX.format("'family'")
    return f"'family_' || left(sha256(unhex({head} || array_to_string(list_transform({ids}, lambda x: {one}), ''))), 24)"


def _split(n: str) -> str:
    return f"CASE WHEN {n} % 10 < 8 THEN 'train' WHEN {n} % 10 = 8 THEN 'val' ELSE 'test' END"


def _crossed(s: str) -> str:
    """Boundaries that the split list ``s`` crosses."""
    return f"""list_filter(['train-val', 'train-test', 'val-test'], lambda b: list_contains({s}, split_part(b, '-', 1)) AND list_contains({s}, split_part(b, '-', 2)))"""


_RANKED = "list_filter(['train', 'val', 'test', 'custom'], lambda n: list_contains({0}, n))"
_KINDS = "list_filter(['exact', 'transformed_duplicate', 'semantic_candidate'], lambda n: list_contains({0}, n))"

BASE = f"""
docs AS (
  SELECT {_stable("doc", "doc_id::VARCHAR")} AS id, doc_id AS number, {_split("doc_id")} AS split, source AS label,
    sha256(text) AS byte_sha256, strlen(text)::BIGINT AS byte_size FROM documents),
packed AS (
  SELECT *, list_sort(embedding[2:64])[32] AS middle FROM embeddings),
vecs AS (
  SELECT {_stable("vec", "vec_id::VARCHAR")} AS id, vec_id AS number, {_split("vec_id")} AS split, 'class_' || label AS label,
    list_sum(list_transform(range(1, 64), lambda i: CASE WHEN embedding[i + 1] > middle THEN (1::BIGINT << (63 - i)::INTEGER) ELSE 0 END))::BIGINT AS fp,
    embedding::DOUBLE[] AS vec FROM packed),
records AS (
  SELECT id, number, split, label, byte_sha256, byte_size FROM docs
  UNION ALL SELECT id, number, split, label, NULL, 0 FROM vecs),
clusters AS (
  SELECT 'exact_' || byte_sha256 AS cluster_id, byte_sha256, min(id) AS first_id, count(*) AS member_count,
    sum(byte_size)::BIGINT AS total_duplicate_bytes, list(DISTINCT split) AS s, list_sort(list(DISTINCT label)) AS l
  FROM docs GROUP BY byte_sha256 HAVING count(*) >= 2),
exact AS (
  SELECT first_id AS left_id, id AS right_id FROM docs JOIN clusters USING (byte_sha256) WHERE id <> first_id),
fps AS (SELECT fp, min(id) AS id, count(*) AS size FROM vecs GROUP BY fp),
ham AS (
  SELECT a.id AS left_id, b.id AS right_id, bit_count(xor(a.fp, b.fp))::INTEGER AS distance
  FROM fps a JOIN fps b ON a.id < b.id AND bit_count(xor(a.fp, b.fp)) <= {RADIUS}
  UNION ALL SELECT fps.id, vecs.id, 0 FROM vecs JOIN fps ON vecs.fp = fps.fp WHERE vecs.id <> fps.id),
units AS (SELECT vec, min(id) AS id FROM vecs GROUP BY vec),
cos AS (
  SELECT a.id AS left_id, b.id AS right_id, list_cosine_similarity(a.vec, b.vec) AS cosine
  FROM units a JOIN units b ON a.id < b.id AND list_cosine_similarity(a.vec, b.vec) >= {COSINE}
  UNION ALL SELECT units.id, vecs.id, 1.0 FROM vecs JOIN units ON vecs.vec = units.vec WHERE vecs.id <> units.id),
signals AS (
  SELECT left_id, right_id, true AS e, NULL::INTEGER AS d, NULL::DOUBLE AS c FROM exact
  UNION ALL SELECT left_id, right_id, false, distance, NULL FROM ham
  UNION ALL SELECT left_id, right_id, false, NULL, cosine FROM cos),
merged AS (
  SELECT left_id, right_id, bool_or(e) AS exact_match, min(d) AS phash_distance, max(c) AS cosine_similarity
  FROM (SELECT least(left_id, right_id) AS left_id, greatest(left_id, right_id) AS right_id, e, d, c FROM signals)
  GROUP BY 1, 2),
classed AS (
  SELECT *, CASE WHEN exact_match THEN 'exact' WHEN phash_distance IS NOT NULL THEN 'transformed_duplicate' ELSE 'semantic_candidate' END AS classification
  FROM merged),
edges AS (
  SELECT *, CASE WHEN classification = 'semantic_candidate' THEN 'review' ELSE 'definite' END AS decision,
    CASE classification WHEN 'exact' THEN 1.0 WHEN 'transformed_duplicate' THEN 1.0 - phash_distance / 64.0 ELSE (cosine_similarity + 1) / 2 END AS confidence
  FROM classed),
ways AS (
  SELECT left_id AS a, right_id AS b FROM edges WHERE decision = 'definite'
  UNION ALL SELECT right_id, left_id FROM edges WHERE decision = 'definite'),
reach(node, root) AS (
  SELECT a, a FROM ways UNION SELECT ways.b, reach.root FROM reach JOIN ways ON ways.a = reach.node),
members AS (SELECT node AS id, min(root) AS root FROM reach GROUP BY node),
fam AS (SELECT root, list_sort(list(id)) AS m, count(*) AS member_count, {_family("list_sort(list(id))")} AS family_id FROM members GROUP BY root),
inside AS (
  SELECT e.*, a.root FROM edges e JOIN members a ON a.id = e.left_id JOIN members b ON b.id = e.right_id AND b.root = a.root),
spans AS (
  SELECT root, list(DISTINCT split) AS s, list_sort(list(DISTINCT label)) AS l FROM members JOIN records USING (id) GROUP BY root),
proof AS (
  SELECT root, list(DISTINCT classification) AS ev FROM inside
  WHERE decision = 'definite' AND classification <> 'semantic_candidate' GROUP BY root),
leaks AS (
  SELECT f.family_id, f.root, f.member_count, {_RANKED.format("s")} AS sp, {_crossed("s")} AS crossed, {_KINDS.format("ev")} AS kinds, l
  FROM fam f JOIN spans USING (root) JOIN proof USING (root) WHERE len({_crossed("s")}) > 0),
sem AS (
  SELECT e.left_id, e.right_id, e.cosine_similarity, a.split AS ls, b.split AS rs, a.label AS ll, b.label AS rl
  FROM edges e JOIN records a ON a.id = e.left_id JOIN records b ON b.id = e.right_id
  WHERE decision = 'review' AND classification = 'semantic_candidate'),
sure AS (
  SELECT i.root, bool_or(classification = 'exact') AS ex FROM inside i JOIN records a ON a.id = i.left_id JOIN records b ON b.id = i.right_id
  WHERE decision = 'definite' AND classification <> 'semantic_candidate' AND a.label <> b.label GROUP BY i.root),
conflicts AS (
  SELECT f.family_id, array_to_string(l, ',') AS labels, CASE WHEN ex THEN 'exact' ELSE 'near' END AS kind
  FROM sure JOIN fam f USING (root) JOIN spans USING (root)),
hit AS (SELECT id, root FROM members JOIN sure USING (root)),
semconf AS (
  SELECT {_family("[left_id, right_id]")} AS family_id, left_id || ',' || right_id AS members,
    array_to_string(list_sort([ll, rl]), ',') AS labels, 'semantic' AS kind
  FROM sem LEFT JOIN hit h1 ON h1.id = left_id LEFT JOIN hit h2 ON h2.id = right_id
  WHERE ll <> rl AND NOT coalesce(h1.root = h2.root, false)),
grouped AS (
  SELECT r.id, coalesce(f.family_id, {_family("[r.id]")}) AS group_id FROM records r LEFT JOIN members m ON m.id = r.id LEFT JOIN fam f USING (root)),
qs AS (SELECT * FROM vecs WHERE number % 50 = 0),
near AS (
  SELECT q.id AS left_id, r.id AS right_id, q.label AS l1, r.label AS l2, list_cosine_similarity(q.vec, r.vec) AS cosine
  FROM qs q JOIN vecs r ON q.id <> r.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY cosine DESC, right_id) AS rank FROM near),
truth AS (
  SELECT q.label AS corruption, q.label = r.label AS is_duplicate, q.vec = r.vec AS exact, r.number % 2 AS fold,
    bit_count(xor(q.fp, r.fp))::INTEGER AS distance, list_cosine_similarity(q.vec, r.vec) AS cosine
  FROM qs q JOIN vecs r ON q.number <> r.number),
targets(split, ratio) AS (VALUES {", ".join(f"('{s}', {r}::DOUBLE)" for s, r in RATIOS.items())}),
pq AS (
  SELECT t.split, t.ratio, g.label, coalesce(k.n, 0) / nullif(sum(k.n) OVER (PARTITION BY t.split), 0) AS p, g.q
  FROM targets t CROSS JOIN (SELECT label, count(*) / sum(count(*)) OVER () AS q FROM records GROUP BY label) g
  LEFT JOIN (SELECT split, label, count(*) AS n FROM records GROUP BY ALL) k ON k.split = t.split AND k.label = g.label),
jsds AS (
  SELECT split, ratio, CASE WHEN max(p) IS NULL THEN 1.0 ELSE greatest(0.0, least(1.0, sum(
    CASE WHEN p > 0 THEN 0.5 * p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * log2(q / ((p + q) / 2)) ELSE 0 END))) END AS jsd
  FROM pq GROUP BY split, ratio),
sizeerr AS (
  SELECT 0.5 * sum(abs(coalesce(n, 0) / total - ratio)) AS e
  FROM (SELECT split, ratio FROM targets UNION ALL SELECT 'custom', 0) t LEFT JOIN (SELECT split, count(*) AS n FROM records GROUP BY split) USING (split),
    (SELECT count(*)::DOUBLE AS total FROM records))
"""

_RATES = """round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision,
 round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall,
 round(CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1"""


def _counts(hit: str, truth: str = "is_duplicate") -> str:
    return ", ".join(
        f"count(*) FILTER (WHERE {a}({hit}) AND {b}({truth})) AS {n}"
        for n, a, b in (("tp", "", ""), ("fp", "", "NOT "), ("fn", "NOT ", ""), ("tn", "NOT ", "NOT "))
    )


def _rates(inner: str) -> str:
    return f"SELECT *, {_RATES} FROM ({inner})"


_SWEEP = _rates(f"SELECT t::INTEGER AS threshold, {_counts('exact OR distance <= t')} FROM truth, range(-1, 65) r(t) GROUP BY t")
_FOLDS = f"SELECT t::INTEGER AS threshold, CASE fold WHEN 0 THEN 'selection' ELSE 'held_out' END AS fold, {_counts('exact OR distance <= t')} FROM truth, range(-1, 65) r(t) GROUP BY ALL"
# The fields of a snapshot row.
_ROW = """'{"byte_sha256":"' || byte_sha256 || '","byte_size":' || byte_size || ',"format":null,"height":null,"id":"' || id || '","label":' || coalesce(to_json(label)::VARCHAR, 'null') || ',"path":null,"split":"' || split || '","width":null}'"""

BODIES = {
    "ids_stable": f"SELECT doc_id, {_stable('doc', 'doc_id::VARCHAR')} AS id, {_stable('img', 'p', 'doc_id::VARCHAR')} AS path_id FROM (SELECT doc_id, lang || '/' || source AS p FROM documents)",
    "ids_family": f"SELECT byte_sha256, {_family('list_sort(list(DISTINCT id))')} AS family_id FROM docs GROUP BY byte_sha256",
    "records_docs": "SELECT * FROM docs",
    "records_vectors": "SELECT id, number, split, label, fp FROM vecs",
    "manifest_ordinal": "SELECT id, path, row_number() OVER (ORDER BY lower(path), path, split, coalesce(label, '')) - 1 AS ordinal FROM (SELECT *, split || '/' || label || '/' || number AS path FROM docs)",
    "dup_id_issues": "SELECT 'invalid_manifest' AS code, id AS key, count(*) AS n FROM docs GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'duplicate_content', byte_sha256, count(*) FROM docs GROUP BY byte_sha256 HAVING count(*) > 1",
    "exact_clusters": f"SELECT cluster_id, byte_sha256, first_id, member_count, total_duplicate_bytes, array_to_string({_RANKED.format('s')}, ',') AS splits, array_to_string(l, ',') AS labels, array_to_string({_crossed('s')}, ',') AS boundaries, len({_crossed('s')}) > 0 AS crosses_evaluation_boundary FROM clusters",
    "exact_anchor_edges": "SELECT * FROM exact",
    "exact_cross_split": f"SELECT cluster_id, member_count, array_to_string({_crossed('s')}, ',') AS boundaries FROM clusters WHERE len({_crossed('s')}) > 0",
    "exact_boundary_counts": f"SELECT boundary, count(cluster_id) AS n_groups FROM (VALUES ('train-val'), ('train-test'), ('val-test')) b(boundary) LEFT JOIN clusters ON list_contains({_crossed('s')}, boundary) GROUP BY boundary",
    "fingerprint_pack": "SELECT number, fp, bit_count(fp)::INTEGER AS n_bits FROM vecs",
    "hamming_pairs_bnlj": "SELECT * FROM ham",
    "hamming_pairs_banded": "SELECT * FROM ham WHERE distance <= 8",
    "hamming_pairs_auto": f"SELECT a.id AS left_id, b.id AS right_id, bit_count(xor(a.fp, b.fp))::INTEGER AS distance FROM fps a JOIN fps b ON a.id < b.id AND bit_count(xor(a.fp, b.fp)) <= {RADIUS + 2} UNION ALL SELECT fps.id, vecs.id, 0 FROM vecs JOIN fps ON vecs.fp = fps.fp WHERE vecs.id <> fps.id",
    "hamming_point_query": f"SELECT q.id AS query_id, r.id, bit_count(xor(q.fp, r.fp))::INTEGER AS distance FROM qs q JOIN vecs r ON q.id <> r.id AND bit_count(xor(q.fp, r.fp)) <= {RADIUS + 2}",
    "knn_exact_topk": f"SELECT left_id, right_id, round(cosine, 4) AS cosine, rank::INTEGER AS rank FROM ranked WHERE rank <= {NEIGHBOURS}",
    "cosine_threshold_pairs": "SELECT left_id, right_id, round(cosine, 4) AS cosine FROM cos",
    "recall_at_k": f"SELECT count(*) AS n_exact, count(h.a) AS n_found, count(h.a) / count(*) AS recall FROM (SELECT left_id, right_id FROM ranked WHERE rank <= {NEIGHBOURS}) e LEFT JOIN (SELECT q.id AS a, r.id AS b, row_number() OVER (PARTITION BY q.id ORDER BY bit_count(xor(q.fp, r.fp)), r.id) AS k FROM qs q JOIN vecs r ON q.id <> r.id) h ON h.a = left_id AND h.b = right_id AND h.k <= {NEIGHBOURS}",
    "evidence_merge": "SELECT left_id, right_id, exact_match, phash_distance, round(cosine_similarity, 4) AS cosine_similarity FROM edges",
    "edge_classify": "SELECT classification, decision, count(*) AS n_edges FROM edges GROUP BY ALL",
    "edge_confidence": "SELECT left_id, right_id, round(confidence::DOUBLE, 4) AS confidence FROM edges",
    "policy_variants": "SELECT x || t || s AS policy, count(*) FILTER (WHERE ok) AS definite, count(*) FILTER (WHERE NOT ok) AS review FROM (SELECT x, t, s, CASE classification WHEN 'exact' THEN x = '1' WHEN 'transformed_duplicate' THEN t = '1' ELSE s = '0' END AS ok FROM edges, (VALUES ('0'), ('1')) a(x), (VALUES ('0'), ('1')) b(t), (VALUES ('0'), ('1')) c(s)) GROUP BY ALL",
    "families": "SELECT family_id, array_to_string(m, ',') AS members, member_count FROM fam",
    "family_edge_counts": "SELECT family_id, edge_count FROM fam JOIN (SELECT root, count(*) AS edge_count FROM inside WHERE decision = 'definite' GROUP BY root) USING (root)",
    "leakage_groups": "SELECT family_id, member_count, array_to_string(sp, ',') AS splits, array_to_string(crossed, ',') AS boundaries, array_to_string(kinds, ',') AS evidence, kinds[1] AS strongest, array_to_string(l, ',') AS labels, len(l) > 1 AS label_conflict FROM leaks",
    "leakage_boundary_counts": "SELECT boundary, count(root) AS n_groups FROM (VALUES ('train-val'), ('train-test'), ('val-test')) b(boundary) LEFT JOIN leaks ON list_contains(crossed, boundary) GROUP BY boundary",
    "leakage_summary": "SELECT n.*, round(CASE WHEN evaluation_records = 0 THEN 0 ELSE contaminated_evaluation_records / evaluation_records END, 6) AS contaminated_fraction, k.* FROM (SELECT count(root) AS contaminated_records, count(*) FILTER (WHERE split IN ('val', 'test')) AS evaluation_records, count(root) FILTER (WHERE split IN ('val', 'test')) AS contaminated_evaluation_records FROM records r LEFT JOIN (SELECT id, m.root FROM members m JOIN leaks l ON l.root = m.root) d USING (id)) n, (SELECT count(*) FILTER (WHERE kinds[1] = 'exact') AS exact_groups, count(*) FILTER (WHERE kinds[1] = 'transformed_duplicate') AS transformed_groups FROM leaks) k",
    "semantic_reviews_cross_split": "SELECT left_id, right_id, ls AS left_split, rs AS right_split, round(cosine_similarity, 4) AS cosine_similarity FROM sem WHERE ls <> rs",
    "label_conflicts": "SELECT * FROM conflicts",
    "conflict_counts": "SELECT count(*) AS cross_label_conflicts, count(*) FILTER (WHERE kind <> 'semantic') AS definite_conflicts, count(*) FILTER (WHERE kind = 'exact') AS exact_conflicts, count(*) FILTER (WHERE kind = 'near') AS near_conflicts, count(*) FILTER (WHERE kind = 'semantic') AS semantic_review_conflicts FROM (SELECT kind FROM conflicts UNION ALL SELECT kind FROM semconf)",
    "semantic_conflicts": "SELECT * FROM semconf",
    "split_statistics": "SELECT split, coalesce(sum(n), 0)::BIGINT AS image_count, coalesce(string_agg(label || ':' || n, ',' ORDER BY label), '') AS class_counts FROM (SELECT split FROM targets) LEFT JOIN (SELECT split, label, count(*) AS n FROM records GROUP BY ALL) USING (split) GROUP BY split",
    "class_histogram": "SELECT split, label, count(*) AS n FROM records GROUP BY ALL",
    "largest_remainder_targets": "SELECT split, (base + CASE WHEN row_number() OVER (ORDER BY rest DESC, place) <= total - sum(base) OVER () THEN 1 ELSE 0 END)::BIGINT AS target FROM (SELECT split, floor(total * ratio) AS base, total * ratio - floor(total * ratio) AS rest, list_position(['train', 'val', 'test'], split) AS place, total FROM targets, (SELECT count(*) AS total FROM records))",
    "split_size_error": "SELECT round(e, 6) AS size_error FROM sizeerr",
    "jsd_by_split": "SELECT split, round(jsd, 6) AS jsd FROM jsds",
    "objective_before": "SELECT round(e, 6) AS size_error, round(d, 6) AS class_divergence, round(e + d, 6) AS objective FROM sizeerr, (SELECT sum(ratio * jsd) AS d FROM jsds)",
    "group_vectors_entropy": "SELECT g.group_id, size, round(coalesce(entropy, 0.0), 6) + 0.0 AS entropy, coalesce(labels, '') AS labels, coalesce(splits, '') AS splits FROM (SELECT group_id, count(*) AS size FROM grouped GROUP BY 1) g LEFT JOIN (SELECT group_id, -sum(n / t * log2(n / t)) AS entropy, string_agg(label || ':' || n, ',' ORDER BY label) AS labels FROM (SELECT group_id, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY group_id) AS t FROM grouped JOIN records USING (id) WHERE label IS NOT NULL GROUP BY 1, 2) GROUP BY 1) l USING (group_id) LEFT JOIN (SELECT group_id, string_agg(split || ':' || n, ',' ORDER BY split) AS splits FROM (SELECT group_id, split, count(*) AS n FROM grouped JOIN records USING (id) GROUP BY 1, 2) GROUP BY 1) s USING (group_id)",
    "singleton_groups": f"SELECT id, {_family('[id]')} AS group_id FROM records WHERE id NOT IN (SELECT id FROM members)",
    "repair_invariant": "SELECT 0::BIGINT AS divided_families, 0::BIGINT AS missing_records, 0::BIGINT AS unknown_assignments, 0::BIGINT AS other_splits, 0::BIGINT AS targets_off",
    "conflict_order": "SELECT family_id, kind, row_number() OVER (ORDER BY list_position(['exact', 'near', 'semantic'], kind), family_id, members) - 1 AS place FROM (SELECT family_id, kind, array_to_string(m, ',') AS members FROM conflicts JOIN fam USING (family_id) UNION ALL SELECT family_id, kind, members FROM semconf)",
    "edge_order": "SELECT left_id, right_id, row_number() OVER (ORDER BY left_id, right_id) - 1 AS place FROM edges",
    "metric_order": "SELECT corruption, t AS threshold, row_number() OVER (ORDER BY corruption, t) - 1 AS place FROM (SELECT DISTINCT corruption FROM truth), (VALUES (0), (8), (16)) v(t)",
    "repair_leakage": "SELECT count(*) FILTER (WHERE n > 1) AS leakage_before, 0::BIGINT AS leakage_after, count(*) AS n_families FROM (SELECT root, count(DISTINCT split) FILTER (WHERE split <> 'custom') AS n FROM members JOIN records USING (id) GROUP BY root)",
    "repair_splits_before": "SELECT split, count(*) AS before FROM records GROUP BY split",
    "pair_metrics_exact": _rates(f"SELECT corruption, {_counts('exact')} FROM truth GROUP BY corruption"),
    "phash_threshold_sweep": _rates(f"SELECT t AS threshold, corruption, {_counts('distance <= t')} FROM truth, (VALUES (0), (4), (8), (16), (24), (28), (32)) v(t) GROUP BY t, corruption"),
    "cosine_threshold_sweep": _rates(f"SELECT t::DOUBLE AS threshold, {_counts('cosine >= t', 'l1 = l2')} FROM near, (VALUES (0.05005), (0.10005), (0.20005), (0.30005)) v(t) GROUP BY t"),
    "combined_policy_metrics": _rates(f"SELECT corruption, {_counts('exact OR distance <= 24 OR cosine >= 0.30005')} FROM truth GROUP BY corruption"),
    "labeled_pair_sweep": _SWEEP,
    "select_radius": _rates(f"WITH s AS ({_FOLDS}) SELECT s.* FROM s JOIN (SELECT threshold FROM ({_rates('SELECT * FROM s')}) WHERE fold = 'selection' AND precision >= 0.10 ORDER BY recall DESC, precision DESC, threshold LIMIT 1) USING (threshold)"),
    "fold_independence": " UNION ALL ".join(f"SELECT '{c}' AS what, count(*) AS n_shared FROM (SELECT {c} FROM docs WHERE number % 2 = 0 INTERSECT SELECT {c} FROM docs WHERE number % 2 = 1)" for c in ("byte_sha256", "label", "id")),
    "accuracy_by_class": "SELECT l1 AS label, count(*) AS n, count(*) FILTER (WHERE l1 = l2) AS correct, round(count(*) FILTER (WHERE l1 = l2) / count(*), 6) AS accuracy FROM ranked WHERE rank = 1 GROUP BY l1",
    "negative_controls": "SELECT cluster_id, first_id AS source_id, coalesce(lead(first_id) OVER (ORDER BY cluster_id), first_value(first_id) OVER (ORDER BY cluster_id)) AS control_id FROM clusters",
    "stratified_sample": "SELECT id, label, rank::INTEGER AS rank, CASE WHEN rank <= 6 THEN 'train' WHEN rank <= 8 THEN 'val' ELSE 'test' END AS bucket FROM (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY sha256('42:' || id), id) AS rank FROM docs) WHERE rank <= 10",
    "snapshot_rows": f"SELECT id, {_ROW} AS row FROM docs",
    "snapshot_hash": f"""SELECT sha256('{{"issues":[],"records":[' || string_agg({_ROW}, ',' ORDER BY id) || '],"schema":"dataset-snapshot-v1"}}') AS snapshot_sha256 FROM docs""",
    "unknown_id_guard": "SELECT left_id AS id FROM edges WHERE left_id NOT IN (SELECT id FROM records) UNION SELECT right_id FROM edges WHERE right_id NOT IN (SELECT id FROM records)",
    "disjoint_family_guard": "SELECT id, count(*) AS n FROM members GROUP BY id HAVING count(*) > 1",
    "edge_order_guard": "SELECT left_id, right_id FROM edges WHERE left_id >= right_id",
    "representative_ids": "SELECT family_id, root AS representative_id, member_count FROM fam",
    "report_families": "SELECT DISTINCT classification, f.family_id, array_to_string(list_sort(s), ',') AS splits, array_to_string(l, ',') AS labels FROM inside JOIN fam f USING (root) JOIN spans USING (root)",
}

ORACLES = {name: f"WITH RECURSIVE {BASE}\n{body}" for name, body in (BODIES | REPORT_BODIES | EXPERIMENT_BODIES).items()}
