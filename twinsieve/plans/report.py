"""Markdown and HTML reports of an audit, for the driver; tables are read in full order."""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame

from twinsieve.functions.identity import PRIVATE
from twinsieve.plans.audit import audit, repair
from twinsieve.sources.sinks import publish_set

SECTIONS = (
    ("Summary", "summary"), ("Leakage", "leaks"), ("Label conflicts", "conflicts"), ("Semantic conflicts", "semantic_conflicts"),
    ("Families", "families"), ("Evidence", "edges"), ("Issues", "issues"),
)


def scrubbed(text: str) -> str:
    """Absolute paths become ``[private path]``, by the patterns that ``safe_text`` uses in Spark."""
    for pattern, new in PRIVATE:
        text = re.sub(pattern, new.replace("$1", r"\1"), text)
    return text


def _cell(value) -> str:
    if value is None:
        return "—"
    if isinstance(value, float):
        return f"{value:.6f}"
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, (list, tuple)):
        return ", ".join(map(_cell, value))
    return scrubbed(str(value))


def _rows(df: DataFrame, most: int | None) -> tuple[list[str], list[list[str]], int]:
    shown = df.drop("root")
    columns = shown.columns
    total = shown.count()
    ordered = shown.orderBy(*columns)
    rows = ordered.toLocalIterator() if most is None else ordered.limit(most).collect()
    return columns, [[_cell(v) for v in r] for r in rows], total


def markdown(title: str, tables: list[tuple[str, list[str], list[list[str]], int]]) -> str:
    escape = lambda s: re.sub(r"([\\`*_|<>\[\]])", r"\\\1", s).replace("\n", " ")
    out = [f"# {escape(title)}"]
    for name, columns, rows, total in tables:
        out.append(f"\n## {name} ({total})\n")
        if not rows:
            out.append("None recorded.")
            continue
        out += ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
        out += ["| " + " | ".join(escape(c) for c in r) + " |" for r in rows]
    return "\n".join(out) + "\n"


def html_page(title: str, tables: list[tuple[str, list[str], list[list[str]], int]], pictures: dict[str, str] | None = None) -> str:
    row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in cells) + "</tr>"
    parts = [f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, columns, rows, total in tables:
        body = "<table>" + row(columns, "th") + "".join(row(r, "td") for r in rows) + "</table>" if rows else "<p>None recorded.</p>"
        parts.append(f"<h2>{html.escape(name)} ({total})</h2>{body}")
    if pictures:
        one = lambda name, uri: f"<figure><img src='{uri}' alt=''><figcaption>{html.escape(name)}</figcaption></figure>"
        parts += ["<h2>Pictures</h2>", *[one(name, uri) for name, uri in pictures.items()]]
    return "\n".join(parts) + "\n"


def write_report(spark, source: str, folder: str, *, ratios=None, most_rows: int | None = 1000, **options) -> dict[str, str]:
    """``report.md`` and ``report.html`` of the audit of ``source``, with the repair if
    ``ratios`` are given; at most ``most_rows`` rows of a table are shown (None: all), with its
    full count."""
    found = audit(spark, source, **options)
    tables = [(title, *_rows(found[name], most_rows)) for title, name in SECTIONS]
    if ratios is not None:
        moved, plan = repair(found, ratios)
        tables.append(("Repair", *_rows(moved, most_rows)))
        facts = [["objective", _cell(plan.objective)], ["size error", _cell(plan.size_error)], ["class divergence", _cell(plan.class_divergence)]]
        facts += [["warning", w] for w in plan.warnings]
        tables.append(("Repair plan", ["fact", "value"], facts, len(facts)))
    return _publish(folder, tables)


def _publish(folder: str, tables, pictures: dict[str, str] | None = None) -> dict[str, str]:
    title = "Dataset integrity report"
    page = html_page(title, tables, pictures)
    return publish_set(folder, {"report.md": markdown(title, tables).encode(), "report.html": page.encode()})


def _listed(name: str, columns: list[str], rows: list[list]) -> tuple:
    return name, columns, [[_cell(v) for v in r] for r in rows], len(rows)


def _frame(name: str, df: DataFrame) -> tuple:
    """A table of an artifact, which the driver has read whole, in the order it comes in."""
    return _listed(name, df.columns, [list(r) for r in df.collect()])


def write_artifact_report(spark, folder: str, artifacts: dict[str, dict], *, root: str | None = None, most_pictures: int = 48) -> dict[str, str]:
    """The report of artifacts that were read and checked: ``audit``, and any of ``repair``,
    ``detection_benchmark``, ``scaling_benchmark`` and ``training``. With a dataset ``root``
    it has thumbnails of the records that matter most."""
    from twinsieve.plans import artifacts as A
    from twinsieve.plans import charts as G

    audit_ = artifacts["audit"]
    A.check_artifact(audit_, "audit")
    split = {r["id"]: r["split"] for r in audit_["records"]}
    label = {r["id"]: r["label"] for r in audit_["records"]}
    home = {m: f["family_id"] for f in audit_["families"] for m in f["member_ids"]}
    inner: dict[tuple[str, str], int] = {}
    for e in audit_["edges"]:
        if home.get(e["left_id"]) and home.get(e["left_id"]) == home.get(e["right_id"]):
            key = e["classification"], home[e["left_id"]]
            inner[key] = inner.get(key, 0) + 1
    members = {f["family_id"]: f["member_ids"] for f in audit_["families"]}
    tables = [
        _listed("Summary", ["name", "value"], sorted(audit_["summary"].items())),
        _listed("Leakage", ["family", "splits", "boundaries", "strongest", "labels", "conflict"], [
            [g["family_id"], g["splits"], [f"{b['left']}-{b['right']}" for b in g["boundaries"]], g["strongest_evidence"], g["labels"], g["label_conflict"]]
            for g in audit_["leakage_groups"]]),
        _listed("Label conflicts", ["family", "kind", "labels", "members"], [[c["family_id"], c["kind"], c["labels"], c["member_ids"]] for c in audit_["label_conflicts"]]),
        _listed("Families by evidence", ["evidence", "family", "edges", "splits", "labels"], [
            [kind, f, n, sorted({split[m] for m in members[f]}), sorted({label[m] or "(unlabeled)" for m in members[f]})] for (kind, f), n in sorted(inner.items())]),
        _listed("Evidence", ["left", "right", "class", "decision", "exact", "distance", "cosine"], [
            [e["left_id"], e["right_id"], e["classification"], e["decision"], *[e["evidence"][k] for k in ("exact_match", "phash_distance", "cosine_similarity")]]
            for e in audit_["edges"]]),
        _listed("Issues", ["record", "path", "code"], [[i["record_id"], i["path"], i["code"]] for i in audit_["invalid_records"]]),
    ]
    if "repair" in artifacts:
        A.check_artifact(artifacts["repair"], "repair")
        A.check_pair(audit_, artifacts["repair"])
        schema = "record_id string, family_id string, original_split string, repaired_split string"
        names = [c.split()[0] for c in schema.split(", ")]
        moved = spark.createDataFrame([tuple(r[n] for n in names) for r in artifacts["repair"]["assignments"]], schema)
        tables.append(_frame("Splits before and after the repair", G.split_frame(moved)))
        tables.append(_listed("Repair warnings", ["warning"], [[w] for w in artifacts["repair"]["infeasibility_warnings"]]))
    schemas = {
        "detection_benchmark": "detector string, corruption string, threshold double, tp long, fp long, fn long, precision double, recall double, f1 double",
        "scaling_benchmark": "dataset_size long, stage string, mode string, duration_seconds double, peak_memory_bytes long, memory_measurement_scope string, recall_at_k double",
        "training": "condition string, seed long, cohort string, label string, total long, correct long, accuracy double",
    }
    views = {"detection_benchmark": ("Detection", G.detection_rows), "scaling_benchmark": ("Scaling", G.scaling_rows), "training": ("Training", G.training_rows)}
    for kind, schema in schemas.items():
        if kind in artifacts:
            A.check_artifact(artifacts[kind], kind)
            names = [c.split()[0] for c in schema.split(", ")]
            rows = spark.createDataFrame([tuple(r[n] for n in names) for r in artifacts[kind]["rows"]], schema)
            tables.append(_frame(views[kind][0], views[kind][1](rows)))
    if "detection_benchmark" in artifacts:
        tables.append(_frame("Embedding provenance", G.provenance_rows(spark, artifacts["detection_benchmark"]["embedding_provenance"])))
    tables.append(_frame("Artifacts", G.artifact_rows(spark, artifacts)))
    pictures = None
    if root is not None:
        schema = "id string, path string, byte_sha256 string"
        records = spark.createDataFrame([(r["id"], r["path"], r["byte_sha256"]) for r in audit_["records"]], schema)
        groups = []
        for name in ("leakage_groups", "label_conflicts", "families"):
            rows = [(f"{n:09d}", m) for n, g in enumerate(audit_[name]) for m in g["member_ids"]]
            groups.append((spark.createDataFrame(rows, "o string, m string"), "o", "m"))
        pictures, skipped = G.thumbnails(records, G.representative_ids(records, groups, most_pictures), root)
        tables.append(_listed("Thumbnails", ["shown", "skipped"], [[len(pictures), skipped]]))
    return _publish(folder, tables, pictures)
