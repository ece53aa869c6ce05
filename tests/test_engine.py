import itertools
import json
import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinsieve.functions import images
from twinsieve.functions.identity import boundaries, family_id, pack_bits, stable_id
from twinsieve.operators import balance, duplicates, evidence, metrics
from twinsieve.operators.components import connected_components, merged_components
from twinsieve.operators.synthetic import source_image
from twinsieve.plans.audit import audit, repair
from twinsieve.sources import images as sources
from twinsieve.sources import sinks

# Paths of the golden example and what they give.
PATHS = [
    ("test/cat/exact-duplicate.png", "test", "cat"), ("test/cat/jpeg-recompressed.jpg", "test", "cat"),
    ("train/cat/source.png", "train", "cat"), ("val/cat/resized.png", "val", "cat"), ("val/dog/conflicting-label.png", "val", "dog"),
]
GOLDEN_FAMILY = "family_f4f24c2c9b763fb84b88f822"
GOLDEN_CSV = "66481f802039b34569802da3a1d751f1a522f2dba6615300f68338c5aeec2910"


def example_image(seed=3):
    return source_image(seed, 1, 96)[:72]


# ---------------------------------------------------------------- ids


def test_golden_ids(spark):
    df = spark.createDataFrame(PATHS, "path string, split string, label string")
    ids = {r.path: r.id for r in df.select("path", stable_id("img", F.col("path")).alias("id")).collect()}
    assert ids["val/cat/resized.png"] == "img_47d267bbd334ff82d9262ebe"
    assert ids["train/cat/source.png"] == "img_fcd841e84d92a918cb4faef9"
    one = spark.createDataFrame([(list(ids.values())[::-1],)], "m array<string>")
    assert one.select(family_id(F.col("m"))).first()[0] == GOLDEN_FAMILY


def test_boundaries(spark):
    cases = [(["val", "custom"], []), (["test", "train"], ["train-test"]), (["train", "val", "test"], ["train-val", "train-test", "val-test"])]
    df = spark.createDataFrame(cases, "s array<string>, want array<string>")
    assert all(r[0] == r[1] for r in df.select(boundaries(F.col("s")), "want").collect())


def test_pack_bits(spark):
    rng = np.random.default_rng(1)
    rows = [rng.normal(size=64).astype(np.float32).tolist() for _ in range(20)] + [[0.0] * 64]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in rows], "v array<float>").select(pack_bits(F.col("v"))).collect()]
    for v, fp in zip(rows, got):
        a = np.array(v, np.float32)
        bits = a > np.median(a[1:])
        bits[0] = False
        assert fp == int("".join("01"[int(b)] for b in bits), 2)


# ---------------------------------------------------------------- image kernels


def slow_hash(pixels):
    """The hash from the definition of the cosine transform, term by term."""
    small = images.resize(images.gray(pixels), 32, 32).astype(float)
    terms = []
    for v in range(8):
        for u in range(8):
            total = sum(
                small[y, x] * np.cos(np.pi * (2 * x + 1) * u / 64) * np.cos(np.pi * (2 * y + 1) * v / 64) for y in range(32) for x in range(32)
            )
            terms.append(total * (1 / np.sqrt(2) if u == 0 else 1) * (1 / np.sqrt(2) if v == 0 else 1) / 16)
    middle = sorted(terms[1:])[31]
    return int("0" + "".join("1" if t > middle else "0" for t in terms[1:]), 2)


def test_hash_by_brute_force():
    for seed in (1, 2):
        assert images.perceptual_hash(example_image(seed)) == slow_hash(example_image(seed))
    assert images.perceptual_hash(np.zeros((9, 7, 3), np.uint8)) == 0


def test_png_round_trip_and_filters():
    rng = np.random.default_rng(2)
    for channels in (3, 4):
        pixels = rng.integers(0, 256, (17, 23, channels)).astype(np.uint8)
        assert (images.decode(images.encode_png(pixels)) == pixels).all()
    import zlib

    pixels = rng.integers(0, 256, (6, 5, 3)).astype(np.int32)
    raw = b""
    for y in range(6):
        kind = y % 5
        line = pixels[y].reshape(-1)
        up = pixels[y - 1].reshape(-1) if y else np.zeros(15, np.int32)
        left = np.concatenate([np.zeros(3, np.int32), line[:-3]])
        corner = np.concatenate([np.zeros(3, np.int32), up[:-3]])
        p = left + up - corner
        gaps = np.abs(np.stack([p - left, p - up, p - corner]))
        paeth = np.where((gaps[0] <= gaps[1]) & (gaps[0] <= gaps[2]), left, np.where(gaps[1] <= gaps[2], up, corner))
        guess = [0 * line, left, up, (left + up) // 2, paeth][kind]
        raw += bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes()
    whole = images.encode_png(pixels.astype(np.uint8))
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    data = whole[:33] + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert (images.decode(data) == pixels).all()


def test_problems():
    png = images.encode_png(example_image())
    code = lambda data, **k: pytest.raises(images.ImageProblem, images.decode, data, **k).value.code
    assert code(b"nothing") == "malformed_image"
    assert code(b"GIF89a" + bytes(20)) == "unsupported_format"
    assert code(png[:200]) == "malformed_image"
    assert code(png, max_pixels=100) == "image_too_large"


# ---------------------------------------------------------------- joins


def records(spark, rows):
    """(id, split, label, sha, fp, vec)"""
    return spark.createDataFrame(
        [(*r[:4], 12, *r[4:]) for r in rows], "id string, split string, label string, byte_sha256 string, byte_size long, fp long, vec array<float>"
    )


@pytest.mark.parametrize("radius", [0, 1, 3, 8, 20])
def test_hamming_plans_agree_with_brute_force(spark, radius):
    rng = random.Random(radius)
    prints = [rng.getrandbits(63) for _ in range(24)]
    prints += [prints[0], prints[0] ^ 1, prints[1] ^ 3, prints[2] ^ 0xF0F, None]
    rows = [(f"r{i:02}", "train", "a", None, p, None) for i, p in enumerate(prints)]
    rng.shuffle(rows)
    df = records(spark, rows)
    first = {}
    for i, p in enumerate(prints):
        first.setdefault(p, f"r{i:02}")
    want = {(a, b, (p ^ q).bit_count()) for (p, a), (q, b) in itertools.combinations([x for x in first.items() if x[0] is not None], 2) if (p ^ q).bit_count() <= radius}
    want = {(min(a, b), max(a, b), d) for a, b, d in want} | {(first[p], f"r{i:02}", 0) for i, p in enumerate(prints) if p is not None and first[p] != f"r{i:02}"}
    for plan in ("loop", "blocks", "auto"):
        assert {tuple(r) for r in duplicates.hamming_pairs(df, radius, plan=plan).collect()} == want
    hits = duplicates.hamming_search(df, df.where("id = 'r00'"), radius).collect()
    assert {(r.id, r.distance) for r in hits} == {
        (f"r{i:02}", (p ^ prints[0]).bit_count()) for i, p in enumerate(prints) if i and p is not None and (p ^ prints[0]).bit_count() <= radius
    }


def test_block_index_shuffles_few_rows_a_fingerprint(spark, monkeypatch):
    rng = random.Random(7)
    base = [rng.getrandbits(63) for _ in range(300)]
    prints = base + [base[0] ^ sum(1 << b for b in rng.sample(range(64), 5)) for _ in range(200)]  # a large group
    prints = list(dict.fromkeys(p - (1 << 64) if p >> 63 else p for p in prints))
    df = records(spark, [(f"r{i:03}", "train", "a", None, p, None) for i, p in enumerate(prints)])
    gaps = ((a, b, ((prints[a] ^ prints[b]) & (1 << 64) - 1).bit_count()) for a, b in itertools.combinations(range(len(prints)), 2))
    want = sorted((f"r{a:03}", f"r{b:03}", d) for a, b, d in gaps if d <= 8)
    assert len(want) > 1000

    def shuffled():
        sc = spark.sparkContext
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = shuffled()
        got = sorted(map(tuple, duplicates.hamming_pairs(df, 8, plan="blocks").collect()))
        assert got == want and shuffled() - before < 20 * len(prints)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for agreeing in (1, 2, 3):
        monkeypatch.setattr(duplicates, "index_masks", lambda n, radius, k=agreeing: duplicates.block_masks(radius, k))
        for block in (30, 8192):
            assert sorted(map(tuple, duplicates.hamming_pairs(df, 8, plan="blocks", block=block).collect())) == want


@pytest.mark.parametrize("radius", [0, 1, 8, 61, 63, 64])
def test_block_masks_miss_no_pair(radius):
    rng = random.Random(radius)
    for agreeing in (1, 2, 3) if radius < 10 else (1,):
        masks = duplicates.block_masks(radius, agreeing)
        for _ in range(200):
            flips = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(flips & m == 0 for m in masks)


def test_cosine_blocks_agree_with_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(60, 8)).astype(np.float32)
    vectors[7] = vectors[3]
    rows = [(f"v{i:02}", "train", "a", None, None, v.tolist()) for i, v in enumerate(vectors)]
    df = records(spark, rows)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    sims = unit @ unit.T
    skip = {7}
    want = {(f"v{i:02}", f"v{j:02}") for i in range(60) for j in range(i + 1, 60) if sims[i, j] >= 0.5 and not {i, j} & skip} | {("v03", "v07")}
    got = duplicates.cosine_pairs(df, 0.5, block=17).collect()
    assert {(r.left_id, r.right_id) for r in got} == want
    near = duplicates.nearest_neighbors(df, df.where("id < 'v05'"), 3, block=17).collect()
    for i in range(5):
        ids = [r.right_id for r in sorted((r for r in near if r.left_id == f"v{i:02}"), key=lambda r: r.rank)]
        best = sorted((j for j in range(60) if j != i), key=lambda j: (-round(float(sims[i, j]), 6), j))[:3]
        assert ids == [f"v{j:02}" for j in best]


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102), (200, 200), (None, 3)] + [(300, x) for x in range(301, 330)]
    rng.shuffle(edges)
    got = {r.node: r.comp for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, **{x: 300 for x in range(300, 330)}}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_components_with_hubs_and_later_links(spark):
    rng = random.Random(8)

    def brute(edges):
        top = {}

        def root(x):
            top.setdefault(x, x)
            while top[x] != x:
                x = top[x]
            return x

        for a, b in edges:
            low, high = sorted((root(a), root(b)))
            top[high] = low
        return {x: root(x) for x in top}

    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)] + [(1000, 1000 + i) for i in range(1, 600)]
    edges = [e for e in edges if e[0] != e[1]]
    labels = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b")
    for found in (labels, connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b", one_task=10_000)):
        assert {r.node: r.comp for r in found.collect()} == brute(edges)
    more = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(40)] + [(5, 1300)]
    got = {r.node: r.comp for r in merged_components(labels, spark.createDataFrame(more, "a long, b long"), "a", "b").collect()}
    want = brute(edges + more)
    assert all(want[x] == c for x, c in got.items()) and set(got) >= {x for e in edges for x in e}


# ---------------------------------------------------------------- evidence


def graph(spark, hamming=(), cosine=(), policy=evidence.Policy()):
    df = records(spark, [("a", "train", "cat", "s1", None, None), ("b", "val", "cat", "s1", None, None), ("c", "test", "dog", "s1", None, None),
                         ("d", "train", "dog", "s2", None, None), ("e", "custom", None, "s3", None, None), ("f", "test", "cat", "s4", None, None)])
    h = spark.createDataFrame(list(hamming), "left_id string, right_id string, distance int")
    c = spark.createDataFrame(list(cosine), "left_id string, right_id string, cosine double")
    edges = evidence.merge_evidence(df, duplicates.exact_edges(df), h, c, radius=8, threshold=0.9, policy=policy)
    return df, edges


def test_evidence_and_thresholds(spark):
    _, edges = graph(spark, [("c", "b", 3), ("a", "d", 8), ("a", "e", 9)], [("d", "f", 0.9), ("f", "d", 0.95), ("e", "f", 0.89), ("b", "c", 0.1)])
    got = {(r.left_id, r.right_id): (r.classification, r.decision, round(r.confidence, 4)) for r in edges.collect()}
    assert got == {
        ("a", "b"): ("exact", "definite", 1.0), ("a", "c"): ("exact", "definite", 1.0), ("b", "c"): ("exact", "definite", 1.0),
        ("a", "d"): ("transformed_duplicate", "definite", 0.875), ("d", "f"): ("semantic_candidate", "review", 0.975),
    }


def test_leakage_and_conflicts(spark):
    df, edges = graph(spark, [("a", "d", 8)], [("d", "f", 0.95), ("e", "f", 0.99)])
    members = evidence.membership(edges)
    leak = evidence.leakage_groups(df, members, edges).collect()
    assert [(r.member_count, r.splits, r.crossed, r.evidence, r.labels) for r in leak] == [
        (4, "train,val,test", ["train-val", "train-test", "val-test"], "exact,transformed_duplicate", "cat,dog")
    ]
    row = evidence.leakage_summary(df, members, evidence.leakage_groups(df, members, edges)).first()
    assert (row.contaminated_records, row.evaluation_records, row.contaminated_evaluation_records) == (4, 3, 2)
    assert [r.kind for r in evidence.definite_conflicts(df, members, edges).collect()] == ["exact"]
    assert [(r.left_id, r.right_id) for r in evidence.semantic_reviews(df, edges).collect()] == [("d", "f")]
    assert [r.members for r in evidence.semantic_conflicts(df, members, edges).collect()] == ["d,f"]


def test_policy_toggles(spark):
    df, edges = graph(spark, [], [("d", "f", 0.95)], evidence.Policy(exact_is_duplicate=False))
    members = evidence.membership(edges)
    assert members.count() == 0 and evidence.leakage_groups(df, members, edges).count() == 0
    assert [(r.left_id, r.right_id) for r in evidence.semantic_reviews(df, edges).collect()] == [("d", "f")]
    df, edges = graph(spark, [], [("d", "f", 0.95)], evidence.Policy(embedding_only_requires_review=False))
    members = evidence.membership(edges)
    assert {r.id for r in members.collect()} == {"a", "b", "c", "d", "f"}
    assert evidence.leakage_groups(df, members, edges).count() == 1  # the semantic-only family is none


# ---------------------------------------------------------------- balance and repair


def test_divergence_values():
    assert balance.divergence({}, {}) == 0 and balance.divergence({}, {"cat": 1}) == 1
    assert balance.divergence({"cat": 2}, {"cat": 10}) == 0 and balance.divergence({"cat": 1}, {"dog": 1}) == 1
    assert balance.divergence({"cat": 1, "dog": 1}, {"cat": 1}) == pytest.approx(0.3112781244591328)


def test_golden_repair(spark, tmp_path):
    rows = [(p, s, x) for p, s, x in PATHS]
    manifest = sources.entries_of(spark, rows)
    df = manifest.select("id", "path", "split", "label")
    root = df.agg(F.min("id")).first()[0]
    members = df.select("id", F.lit(root).alias("root"))
    moved, plan = balance.repair_splits(df, members, (0.6, 0.2, 0.2), seed=20260903, iterations=50)
    assert plan.targets == {"train": 3, "val": 1, "test": 1} and plan.objective == pytest.approx(0.8)
    assert plan.size_error == pytest.approx(0.4) and plan.class_divergence == pytest.approx(0.4) and len(plan.warnings) == 2
    assert moved.where("original_split <> repaired_split").count() == 4
    before = balance.objective(df, {"train": 0.6, "val": 0.2, "test": 0.2}).first()
    assert before.size_error == pytest.approx(0.4) and before.class_divergence == pytest.approx(0.10104603850284208)
    assert sinks.write_repaired_manifest(str(tmp_path / "out.csv"), df, moved) == GOLDEN_CSV


def test_repair_improves_and_keeps_families():
    rng = random.Random(7)
    rows = [(f"g{i:02}", rng.randint(1, 6), {}, {}) for i in range(25)]
    rows = [(g, n, {"x": k, "y": n - k}, {"train": n}) for g, n, *_ in rows for k in [rng.randint(0, n)]]
    options = {"size_weight": 1.0, "class_weight": 1.0, "seed": 1}
    plans = [balance.plan_repair(rows, balance.normalise_ratios((0.6, 0.2, 0.2)), iterations=i, **options) for i in (0, 5, 100)]
    assert plans[0].objective >= plans[1].objective >= plans[2].objective < 0.02
    again = balance.plan_repair(rows[::-1], balance.normalise_ratios((0.6, 0.2, 0.2)), iterations=100, **options)
    assert again.splits == plans[2].splits
    empty = balance.plan_repair([], balance.normalise_ratios((0.6, 0.2, 0.2)), iterations=3, **options)
    assert empty.splits == {} and "no records" in empty.warnings[0]


def test_targets_and_ratios():
    assert balance.integer_targets(5, balance.normalise_ratios((0.6, 0.2, 0.2))) == {"train": 3, "val": 1, "test": 1}
    assert balance.integer_targets(1, balance.normalise_ratios((1 / 3, 1 / 3, 1 / 3))) == {"train": 1, "val": 0, "test": 0}
    for bad in ((0.5, 0.5, 0.5), {"train": 1.0}, (2.0, -0.5, -0.5)):
        with pytest.raises(ValueError):
            balance.normalise_ratios(bad)


def test_metrics(spark):
    rows = [(True, 0), (False, 20), (True, 3), (False, 1)]
    pairs = spark.createDataFrame(rows, "is_duplicate boolean, distance int")
    scores = metrics.sweep(pairs, list(range(-1, 65)), lambda t: F.col("distance") <= t)
    best = metrics.select_radius(scores, 0.6).first()
    assert (best.threshold, best.tp, best.fp, best.fn, best.tn) == (3, 2, 1, 0, 1)
    none = scores.where("threshold = -1").first()
    assert (none.precision, none.recall, none.f1) == (0, 0, 0)


# ---------------------------------------------------------------- sources and the whole audit


def test_csv_manifest(spark, tmp_path):
    path = tmp_path / "m.CSV"
    path.write_text("﻿path, split ,label,extra\n.\\images\\cat.png,train,cat,1\n\n , , , \nimages/nested/../dog.png,custom,,2\n", encoding="utf-8")
    got, root = sources.load_manifest(spark, str(path))
    assert [tuple(r)[1:] for r in got.orderBy("ordinal").collect()] == [("images/cat.png", "train", "cat", 0), ("images/dog.png", "custom", None, 1)]
    assert root == str(tmp_path)
    for text in ("path,split\n", "path,split,label,path\n", "path,split,label\na,train\n", "path,split,label\n../a,train,x\n",
                 "path,split,label\n/a,train,x\n", "path,split,label\nA.png,train,x\na.PNG,val,x\n", "path,split,label\na,bad,x\n"):
        path.write_text(text)
        with pytest.raises(sources.ManifestError):
            sources.csv_manifest(spark, str(path)).count()


def test_audit_of_a_folder(spark, tmp_path):
    root = tmp_path / "data"
    image = example_image()
    files = {
        "train/cat/source.png": images.encode_png(image), "test/cat/copy.png": images.encode_png(image),
        "val/cat/resized.png": images.encode_png(images.resize(image, 72, 54)), "val/dog/other.png": images.encode_png(image),
        "train/dog/broken.png": b"no image at all", "train/dog/some.gif": b"GIF89a" + bytes(30),
        "train/dog/noise.png": images.encode_png(np.random.default_rng(4).integers(0, 256, (40, 40, 3)).astype(np.uint8)),
    }
    for name, data in files.items():
        os.makedirs((root / name).parent, exist_ok=True)
        (root / name).write_bytes(data)
    tables = audit(spark, str(root), radius=8, threshold=0.99)
    assert {(r.path, r.code) for r in tables["issues"].collect()} == {("train/dog/broken.png", "malformed_image"), ("train/dog/some.gif", "unsupported_format")}
    kinds = sorted(r.classification for r in tables["edges"].collect())
    assert kinds == ["exact", "exact", "transformed_duplicate"]  # stars: copies are not expanded into all pairs
    family = tables["families"].first()
    assert family.member_count == 4 and tables["families"].count() == 1
    assert [r.kind for r in tables["conflicts"].collect()] == ["exact"]
    moved, plan = repair(tables, (0.6, 0.2, 0.2))
    assert moved.groupBy("family_id").agg(F.countDistinct("repaired_split").alias("n")).where("n > 1").count() == 0
    done = sinks.materialise_dataset(str(root), tables["records"], moved, str(tmp_path / "out"))
    assert done["record_count"] == 5 and done["mode"] == "copy" and (tmp_path / "out/manifest.csv").exists()
    assert len(os.listdir(tmp_path / "out/images")) == 5
    linked = sinks.materialise_dataset(str(root), tables["records"], moved, str(tmp_path / "links"), link=True)
    assert linked["mode"] == "symlink" and all(os.path.islink(tmp_path / "links/images" / n) for n in os.listdir(tmp_path / "links/images"))
    assert linked["manifest_sha256"] == done["manifest_sha256"]
    for place in (root / "inside", tmp_path):
        with pytest.raises(sources.ManifestError):
            sinks.materialise_dataset(str(root), tables["records"], moved, str(place))
    with pytest.raises(sources.ManifestError):
        sinks.materialise_dataset(str(root), tables["records"], moved, str(tmp_path / "out"))
    os.symlink(root / "train/cat/source.png", root / "train/cat/link.png")
    with pytest.raises(sources.ManifestError):
        sources.image_folder(spark, str(root))


def test_command_line(spark, tmp_path, capsys):
    from twinsieve.cli import main

    os.makedirs(tmp_path / "d/train/a")
    (tmp_path / "d/train/a/x.png").write_bytes(images.encode_png(example_image()))
    (tmp_path / "d/train/a/y.png").write_bytes(b"junk")
    assert main(["scan", str(tmp_path / "d")]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"records": 1, "issues": {"malformed_image": 1}}
    assert main(["audit", str(tmp_path / "d"), "--output", str(tmp_path / "audit.json")]) == 0
    assert json.loads((tmp_path / "audit.json").read_bytes())["artifact_type"] == "audit"
    capsys.readouterr()
    assert main(["repair", str(tmp_path / "audit.json"), "--ratios", "0.5,0.25,0.25", "--output", str(tmp_path / "repair.json")]) == 0
    assert main(["report", str(tmp_path / "audit.json"), "--repair", str(tmp_path / "repair.json"), "--output", str(tmp_path / "report")]) == 0
    assert "Splits before and after" in (tmp_path / "report/report.md").read_text()
    assert main(["repair", str(tmp_path / "repair.json"), "--ratios", "0.5,0.25,0.25"]) == 2
    assert main(["audit", str(tmp_path / "nothing")]) == 2
    assert str(tmp_path) not in capsys.readouterr().err
    assert main(["version"]) == 0


def test_report(spark, tmp_path):
    from twinsieve.plans.report import html_page, markdown, scrubbed, write_report

    for name in ("train/a/x.png", "test/a/y.png"):
        os.makedirs((tmp_path / "d" / name).parent)
        (tmp_path / "d" / name).write_bytes(images.encode_png(example_image()))
    write_report(spark, str(tmp_path / "d"), str(tmp_path / "out"), ratios=(0.5, 0.25, 0.25))
    text = (tmp_path / "out/report.md").read_text()
    assert "## Leakage (1)" in text and "## Issues (0)\n\nNone recorded." in text and "train-test" in text
    assert scrubbed("at /srv/x/y.png and C:\\data\\z, not http://a/b") == "at [private path] and [private path] not http://a/b"
    assert "<td>&lt;b&gt;</td>" in html_page("t", [("n", ["c"], [["<b>"]], 1)]) and "\\|" in markdown("t", [("n", ["c"], [["a|b"]], 1)])


def test_labeled_pairs(spark, tmp_path):
    from twinsieve.sources import pairs

    rng = np.random.default_rng(6)
    for fold in "ce":
        for i in range(3):
            pixels = images.resize(rng.integers(0, 256, (6, 6, 3)).astype(np.uint8), 48, 48)
            (tmp_path / f"{fold}{i}.png").write_bytes(images.encode_png(pixels))
            (tmp_path / f"{fold}{i}-copy.png").write_bytes(images.encode_png(np.clip(pixels * 0.9, 0, 255).astype(np.uint8)))
        rows = [f"{fold}{i}.png,{fold}{i}-copy.png,1,{fold}{i},{fold}{i}" for i in range(3)]
        rows += [f"{fold}0.png,{fold}{i}.png,0,{fold}0,{fold}{i}" for i in (1, 2)]
        (tmp_path / f"{fold}.csv").write_text("\n".join([",".join(pairs.HEADER), *rows]) + "\n")
    folds = [pairs.load_fold(spark, str(tmp_path / f"{f}.csv"), str(tmp_path)) for f in "ce"]
    out = pairs.evaluate_pairs(*folds)
    assert out["calibration"]["recall"] == 1 and out["evaluation"]["tp"] + out["evaluation"]["fn"] == 3
    with pytest.raises(sources.ManifestError):
        pairs.evaluate_pairs(folds[0], folds[0])
    for row in ("a.png,a.png,1,x,x", "a.png,b.png,1,x,y", "a.png,b.png,2,x,x", "a.png,b.png,1,x,", "a.png,b.png,1,x,x\nb.png,a.png,1,x,x"):
        (tmp_path / "bad.csv").write_text(",".join(pairs.HEADER) + "\n" + row + "\nc.png,d.png,0,q,r\n")
        with pytest.raises(sources.ManifestError):
            pairs.read_pairs(str(tmp_path / "bad.csv"))


def test_stream_dedup(spark, tmp_path):
    from twinsieve.streaming.dedup import first_contents

    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "n int, text string").withColumn("ts", F.timestamp_seconds("n"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = first_contents(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), text_col="text", time_col="ts")
    query = stream.writeStream.format("memory").queryName("contents").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("SELECT count(*) FROM contents").first()[0] == 2
