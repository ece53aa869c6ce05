"""The ``opN_<name>`` queries: each applies one operator to its whole table."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from twinsieve.llm import (
    chat,
    decontamination,
    licenses,
    line_dedup,
    mixing,
    near_dedup,
    pii,
    quality,
    secrets,
    token_counts,
)
from twinsieve.runtime import table


def op1_line_dedup(spark, sf_dir):
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text"), 256).alias("text_sha256"))


def op2_chat_format(spark, sf_dir):
    """Every turn of every conversation, against the same conversation forked to its neighbour."""
    out = chat.format_preferences(*chat.forked_pairs(table(spark, sf_dir, "conversations")))
    digest = F.sha2(F.col("rendered"), 256).alias("sha256")
    return out.select("pair_id", "part", "turn", "role", "trained", "train_from", F.length("rendered").alias("n_chars"), digest)


def op3_token_counts(spark, sf_dir, tokenizers=os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")):
    """Three edits a document: a replacement, a deletion and an insertion."""
    ranks = f"{tokenizers}/byte_bpe_50k.tiktoken"
    indexed = token_counts.index_tokens(table(spark, sf_dir, "documents"), ranks)
    n = F.length("text")
    edit = lambda b, e, new: F.struct(b.cast("long").alias("begin"), e.cast("long").alias("end"), F.lit(new).alias("new"))
    quarter, half, rest = F.floor(n / 4), F.floor(n / 2), F.floor(3 * n / 4)
    edits = F.array(edit(quarter, quarter + 3, "edited words "), edit(half, half + 10, ""), edit(rest, rest, "\n\nA new line.\n"))
    out = token_counts.recount(indexed.withColumn("edits", edits), ranks)
    return out.select("doc_id", "tokens_before", "tokens_after", "n_edits", "chars_encoded", F.length("text").alias("n_chars"))


def op4_quality_rules(spark, sf_dir):
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_license_scan(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op6_mixing(spark, sf_dir):
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position", "again")


def op7_personal_data(spark, sf_dir):
    out = pii.find_personal_data(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(pii.RULES)],
        F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"),
        pii.joined(F.concat("base", "found")).alias("spans"),
        F.size("found").cast("long").alias("n_found"),
        (F.size("base") + F.size("found")).cast("long").alias("n_spans"),
    )


def op8_secret_scan(spark, sf_dir):
    out = secrets.find_secrets(table(spark, sf_dir, "documents"))
    of_kind = lambda k: F.size(F.filter("items", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id",
        *[of_kind(k).alias(f"n_{secrets.KINDS[k]}") for k in range(3)],
        F.sha2(secrets.joined(F.filter("items", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        secrets.joined(F.col("items")).alias("spans"),
        F.size(F.filter("items", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size("items").cast("long").alias("n_spans"),
    )


def op9_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_decontamination(spark, sf_dir):
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_chat_format": op2_chat_format,
    "op3_token_counts": op3_token_counts,
    "op4_quality_rules": op4_quality_rules,
    "op5_license_scan": op5_license_scan,
    "op6_mixing": op6_mixing,
    "op7_personal_data": op7_personal_data,
    "op8_secret_scan": op8_secret_scan,
    "op9_near_dedup": op9_near_dedup,
    "op10_decontamination": op10_decontamination,
}
