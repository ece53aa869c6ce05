"""Image formats, manifests, the read ladder, sinks."""

import hashlib
import io
import os
import struct
import zlib

import numpy as np
import pytest

from twinsieve.functions import images, jpeg, tiff
from twinsieve.operators.synthetic import source_image
from twinsieve.sources import images as sources
from twinsieve.sources import sinks


def picture(seed=1, height=41, width=53):
    return np.ascontiguousarray(source_image(seed, 2, 64)[:height, :width])


# ---------------------------------------------------------------- formats


@pytest.mark.parametrize("subsample", [True, False])
@pytest.mark.parametrize("quality", [40, 75, 95])
def test_jpeg_round_trip(quality, subsample):
    p = picture()
    out = images.decode(jpeg.encode_jpeg(p, quality, subsample=subsample))
    assert out.shape == p.shape and np.abs(out.astype(int) - p).mean() < {40: 7, 75: 5, 95: 3}[quality] - (0 if subsample else 1.5)
    assert images.header(jpeg.encode_jpeg(p, quality)) == ("jpeg", 53, 41)


def progressive(p):
    """A gray progressive JPEG: first bits of all terms, then the last bit of each, by hand-made codes."""
    high, wide = -(-p.shape[0] // 8) * 8, -(-p.shape[1] // 8) * 8
    plane = np.pad(p, ((0, high - p.shape[0]), (0, wide - p.shape[1])), mode="edge") - 128.0
    blocks = plane.reshape(high // 8, 8, wide // 8, 8).swapaxes(1, 2)
    rows = np.rint(jpeg._BASIS @ blocks @ jpeg._BASIS.T / 4).astype(int).reshape(-1, 64)[:, jpeg.ZIGZAG]
    segment = lambda kind, data: struct.pack(">BBH", 0xFF, kind, len(data) + 2) + data
    table = lambda slot, symbols: segment(0xC4, bytes([slot, *[0] * 7, len(symbols), *[0] * 8, *symbols]))
    ac = [(r << 4) | s for r in range(16) for s in range(11) if s or r in (0, 15)]

    def scan(bits, low, top, shifts):
        bits += "1" * (-len(bits) % 8)
        body = int(bits or "0", 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
        return segment(0xDA, bytes([1, 1, 0, low, top, shifts])) + body

    code = lambda symbols, s: format(symbols.index(s), "08b")
    sized = lambda v: (abs(v).bit_length(), format(v if v > 0 else v + (1 << abs(v).bit_length()) - 1, f"0{abs(v).bit_length()}b") if v else "")
    dc, last = list(range(12)), 0
    one = two = three = four = ""
    for row in rows:
        value = int(row[0]) >> 1
        n, text = sized(value - last)
        one, last = one + code(dc, n) + text, value
        two += str(int(row[0]) & 1)
        half = [int(np.sign(v)) * (abs(int(v)) >> 1) for v in row]
        run = 0
        for k in range(1, 64):
            if not half[k]:
                run += 1
                continue
            while run > 15:
                three, run = three + code(ac, 0xF0), run - 16
            n, text = sized(half[k])
            three, run = three + code(ac, run << 4 | n) + text, 0
        if run:
            three += code(ac, 0)
        run, pending = 0, ""
        ends = max((k for k in range(1, 64) if not half[k] and row[k]), default=0)
        for k in range(1, 64):
            if k > ends:
                pending += str(abs(int(row[k])) & 1) if half[k] else ""
            elif half[k]:
                pending += str(abs(int(row[k])) & 1)
            elif not row[k]:
                run += 1
                if run == 16:
                    four, run, pending = four + code(ac, 0xF0) + pending, 0, ""
            else:
                four += code(ac, run << 4 | 1) + ("1" if row[k] > 0 else "0") + pending
                run, pending = 0, ""
        four += (code(ac, 0) + pending) if ends < 63 else ""
    head = b"\xff\xd8" + segment(0xDB, bytes([0, *[4] * 64])) + segment(0xC2, struct.pack(">BHHB", 8, *p.shape, 1) + bytes([1, 0x11, 0]))
    return (
        head + table(0, dc) + table(0x10, ac) + scan(one, 0, 0, 0x01) + scan(three, 1, 63, 0x01) + scan(two, 0, 0, 0x10)
        + scan(four, 1, 63, 0x10) + b"\xff\xd9"
    )


def test_progressive_jpeg():
    p = images.gray(picture(3, 40, 48))
    out = images.decode(progressive(p))
    assert out.shape == (40, 48, 3) and (out[:, :, 0] == out[:, :, 2]).all()
    assert np.abs(out[:, :, 0].astype(int) - p).max() <= 16 and np.abs(out[:, :, 0].astype(int) - p).mean() < 1.5


def exif(orientation, end="<"):
    return {"<": b"II", ">": b"MM"}[end] + struct.pack(end + "HI", 42, 8) + struct.pack(end + "HHHIHHI", 1, 0x112, 3, 1, orientation, 0, 0)


@pytest.mark.parametrize("end", ["<", ">"])
def test_exif_rotation(end):
    p = picture(4)
    plain = jpeg.encode_jpeg(p, 95)
    upright = images.decode(plain)
    turned = {
        1: upright, 2: upright[:, ::-1], 3: upright[::-1, ::-1], 4: upright[::-1], 5: upright.swapaxes(0, 1),
        6: np.rot90(upright, -1), 7: upright[::-1, ::-1].swapaxes(0, 1), 8: np.rot90(upright, 1),
    }
    for orientation, want in turned.items():
        body = b"Exif\0\0" + exif(orientation, end)
        data = plain[:2] + struct.pack(">BBH", 0xFF, 0xE1, len(body) + 2) + body + plain[2:]
        assert (images.decode(data) == want).all()
        assert images.header(data) == ("jpeg", want.shape[1], want.shape[0])


def write_tiff(p, packing, *, end="<", rows_each=7, predictor=1, colors=2):
    height, width = p.shape[:2]
    samples = 1 if p.ndim == 2 else p.shape[2]
    strips = []
    for y in range(0, height, rows_each):
        part = p[y : y + rows_each].reshape(-1, width, samples)
        if predictor == 2:
            part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
        raw = part.astype(np.uint8).tobytes()
        if packing == 8:
            raw = zlib.compress(raw)
        if packing == 32773:
            raw = b"".join(bytes([min(128, len(raw) - i) - 1]) + raw[i : i + 128] for i in range(0, len(raw), 128))
        if packing == 5:
            raw = pack_lzw(raw)
        strips.append(raw)
    out = io.BytesIO()
    out.write({"<": b"II", ">": b"MM"}[end] + struct.pack(end + "HI", 42, 0))
    places = []
    for s in strips:
        places.append(out.tell())
        out.write(s)
    arrays = {}
    for tag, values in ((273, places), (279, [len(s) for s in strips]), (258, [8] * samples)):
        arrays[tag] = (out.tell(), values)
        out.write(struct.pack(end + f"{len(values)}I", *values))
    at = out.tell()
    fields = {256: width, 257: height, 259: packing, 262: colors, 277: samples, 278: rows_each, 317: predictor}
    rows = [(t, 4, 1, v) for t, v in fields.items()]
    rows += [(t, 4, len(v), place if len(v) > 1 else v[0]) for t, (place, v) in arrays.items()]
    out.write(struct.pack(end + "H", len(rows)))
    for row in sorted(rows):
        out.write(struct.pack(end + "HHII", *row))
    data = bytearray(out.getvalue())
    data[4:8] = struct.pack(end + "I", at)
    return bytes(data)


def pack_lzw(raw):
    table, bits, word, width = {bytes([i]): i for i in range(256)}, format(256, "09b"), b"", 9
    for byte in raw:
        longer = word + bytes([byte])
        if longer in table:
            word = longer
            continue
        bits += format(table[word], f"0{width}b")
        table[longer] = len(table) + 2
        width = 9 + sum(len(table) + 2 >= limit for limit in (512, 1024, 2048))
        if len(table) + 2 >= 4094:
            bits += format(256, f"0{width}b")
            table, width = {bytes([i]): i for i in range(256)}, 9
        word = bytes([byte])
    bits += (format(table[word], f"0{width}b") if word else "")
    bits += format(257, f"0{9 + sum(len(table) + 3 >= limit for limit in (512, 1024, 2048))}b")
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


@pytest.mark.parametrize("packing", [1, 5, 8, 32773])
@pytest.mark.parametrize("end", ["<", ">"])
def test_tiff(packing, end):
    p = picture(5)
    for predictor in (1, 2):
        data = write_tiff(p, packing, end=end, predictor=predictor)
        assert (images.decode(data) == p).all() and images.header(data) == ("tiff", 53, 41)
    gray = images.gray(p)
    assert (images.decode(write_tiff(gray, packing, colors=1))[:, :, 1] == gray).all()
    with pytest.raises(tiff.TiffProblem):
        tiff.decode_tiff(data[:60])


def test_every_broken_image_has_a_code():
    p = picture()
    whole = {"jpeg": jpeg.encode_jpeg(p, 80), "tiff": write_tiff(p, 8), "png": images.encode_png(p)}
    rng = np.random.default_rng(5)
    for data in whole.values():
        for _ in range(60):
            bad = bytearray(data[: rng.integers(4, len(data))])
            for _ in range(3):
                bad[rng.integers(0, len(bad))] = rng.integers(0, 256)
            try:
                images.decode(bytes(bad), 100_000)
            except images.ImageProblem as problem:
                assert problem.code in sources.ISSUE_CODES
    webp = b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0/" + struct.pack("<I", 9 | 9 << 14) + bytes(20)
    with pytest.raises(images.ImageProblem, match="unsupported_format"):
        images.decode(webp)


def write_png(p, depth, color, interlace):
    """A PNG without filters, of samples of ``depth`` bits (height, width, channels)."""
    height, width, channels = p.shape
    raw = b""
    for x, y, dx, dy in images.PASSES if interlace else ((0, 0, 1, 1),):
        part = p[y::dy, x::dx]
        if not part.size:
            continue
        for row in part.reshape(len(part), -1):
            bits = "".join(format(int(v), f"0{depth}b") for v in row)
            bits += "0" * (-len(bits) % 8)
            raw += b"\0" + int(bits, 2).to_bytes(len(bits) // 8, "big")
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    head = struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, interlace)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("interlace", [0, 1])
def test_png_depths_and_interlacing(interlace):
    rng = np.random.default_rng(7)
    for height, width in ((1, 1), (3, 5), (8, 8), (13, 21)):
        for depth in (1, 2, 4, 8, 16):
            gray = rng.integers(0, 1 << depth, (height, width, 1))
            want = gray >> 8 if depth == 16 else gray * 255 // ((1 << depth) - 1)
            out = images.decode(write_png(gray, depth, 0, interlace))
            assert out.shape == (height, width, 3) and (out == want).all()
        for depth in (8, 16):
            rgba = rng.integers(0, 1 << depth, (height, width, 4))
            assert (images.decode(write_png(rgba, depth, 6, interlace)) == rgba >> (depth - 8)).all()


def test_pixel_digest_is_of_the_picture():
    p = picture()
    assert images.pixel_digest(images.decode(images.encode_png(p))) == images.pixel_digest(images.decode(write_tiff(p, 5)))
    assert images.pixel_digest(p) != images.pixel_digest(p[:, ::-1])


# ---------------------------------------------------------------- manifests and scan


def test_paths_and_formats():
    assert sources.normal_path(" a\\b/./c/../d.png ") == "a/b/d.png"
    assert sources.strict_path("a/b.png") == "a/b.png"
    for bad in ("/a", "../a", "a/../../b", "C:/a", "", "a\0b"):
        for check in (sources.normal_path, sources.strict_path):
            with pytest.raises(sources.ManifestError):
                check(bad)
    for bad in ("a\\b", "./a", "a//b", "a/../b", "e\u0301.png"):
        with pytest.raises(sources.ManifestError):
            sources.strict_path(bad)
    assert sources.canonical_format(" .JPEG") == "jpeg"
    with pytest.raises(sources.ManifestError):
        sources.canonical_format("a b")


def test_read_ladder(spark, tmp_path):
    root = tmp_path / "d+x (1)"  # signs that patterns take for their own
    os.makedirs(root / "train/a")
    files = {"ok.png": images.encode_png(picture()), "photo.jpg": jpeg.encode_jpeg(picture(), 90), "_hidden.png": images.encode_png(picture(6)),
             "bad.png": b"nothing", "some.gif": b"GIF89a" + bytes(20), "big.png": images.encode_png(picture(7, 60, 60))}
    for name, data in files.items():
        (root / "train/a" / name).write_bytes(data)
    os.makedirs(root / "train/a/folder.png")
    (tmp_path / "outside.png").write_bytes(files["ok.png"])
    os.symlink(tmp_path / "outside.png", root / "train/a/escape.png")
    names = [*files, "folder.png", "escape.png", "absent.png"]
    manifest = sources.entries_of(spark, [(f"train/a/{n}", "train", "a") for n in names])
    got = {os.path.basename(r.path): r for r in sources.scan(manifest, str(root), max_pixels=3000).collect()}
    codes = {n: r.issue for n, r in got.items()}
    assert codes == {
        "ok.png": None, "photo.jpg": None, "_hidden.png": None, "bad.png": "malformed_image", "some.gif": "unsupported_format",
        "big.png": "image_too_large", "folder.png": "not_a_file", "escape.png": "path_escape", "absent.png": "missing_path",
    }
    assert got["photo.jpg"].fp is not None and got["photo.jpg"].format == "jpeg" and (got["photo.jpg"].width, got["photo.jpg"].height) == (53, 41)
    assert got["ok.png"].byte_sha256 == hashlib.sha256(files["ok.png"]).hexdigest()
    rows = [("x", "train/a/ok.png"), ("x", "train/a/bad.png"), ("y", "train/a/photo.jpg"), ("z", "train/a/photo.jpg"), ("w", "train/a/ok.png")]
    twice = spark.createDataFrame([(i, p, "train", "a") for i, p in rows], "id string, path string, split string, label string")
    issues = sorted((r.id, r.issue) for r in sources.scan(twice, str(root)).collect())
    assert issues == [("w", "duplicate_path"), ("x", "invalid_manifest"), ("x", "invalid_manifest"), ("y", "duplicate_path"), ("z", "duplicate_path")]


def test_manifest_root_and_order(spark, tmp_path):
    (tmp_path / "m.csv").write_text('path,split,label\n"b,1.png",val,x\nA.png,train,\nstraße.png,test,y\nSTRASSD.png,test,y\n', encoding="utf-8")
    manifest, root = sources.load_manifest(spark, str(tmp_path / "m.csv"), dataset_root="/elsewhere")
    assert root == "/elsewhere"
    assert [r.path for r in manifest.orderBy("ordinal").collect()] == ["A.png", "b,1.png", "STRASSD.png", "straße.png"]
    assert [r.ordinal for r in manifest.orderBy("ordinal").collect()] == [0, 1, 2, 3]
    with pytest.raises(sources.ManifestError):
        sources.load_manifest(spark, str(tmp_path), dataset_root="/elsewhere")
    with pytest.raises(sources.ManifestError, match="duplicate logical path"):
        sources.entries_of(spark, [("straße.png", "train", None), ("STRASSE.png", "val", None)])


# ---------------------------------------------------------------- sinks


def test_publish_set_rolls_back(tmp_path, monkeypatch):
    (tmp_path / "a.txt").write_bytes(b"old a")
    (tmp_path / "other.txt").write_bytes(b"other")
    real = os.replace

    def failing(source, target):
        if str(target).endswith("b.txt") and ".aside" not in str(target):
            raise OSError("no room")
        return real(source, target)

    monkeypatch.setattr(os, "replace", failing)
    with pytest.raises(OSError):
        sinks.publish_set(str(tmp_path), {"a.txt": b"new a", "b.txt": b"new b"})
    monkeypatch.undo()
    assert sorted(os.listdir(tmp_path)) == ["a.txt", "other.txt"] and (tmp_path / "a.txt").read_bytes() == b"old a"
    shas = sinks.publish_set(str(tmp_path), {"a.txt": b"new a", "b.txt": b"new b"})
    assert shas["a.txt"] == hashlib.sha256(b"new a").hexdigest() and (tmp_path / "a.txt").read_bytes() == b"new a"
    assert sorted(os.listdir(tmp_path)) == ["a.txt", "b.txt", "other.txt"]


def test_assignments_must_cover_the_records(spark):
    records = spark.createDataFrame([("a", "x", "train", None), ("b", "y", "val", "k")], "id string, path string, split string, label string")
    kind = "record_id string, original_split string, repaired_split string"
    good = [("a", "train", "test"), ("b", "val", "train")]
    lines = sinks.checked_assignments(records, spark.createDataFrame(good, kind)).count()
    assert lines == 2
    for bad in (good[:1], [*good, ("c", "val", "val")], [good[0], ("b", "test", "val")], [good[0], ("b", "val", "custom")], [*good, good[0]]):
        with pytest.raises(sources.ManifestError):
            sinks.checked_assignments(records, spark.createDataFrame(bad, kind))
