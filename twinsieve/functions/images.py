"""Image kernels in NumPy: decoding, perceptual hash, test embedding, PNG writing."""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from functools import lru_cache

import numpy as np

from twinsieve.functions.jpeg import JpegProblem, decode_jpeg, exif_orientation, upright
from twinsieve.functions.tiff import TiffProblem, decode_tiff, tags

FORMATS = ("bmp", "jpeg", "png", "tiff", "webp")


class ImageProblem(Exception):
    """``code`` is one of unsupported_format, image_too_large, malformed_image."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def sniff(data: bytes) -> str | None:
    """Format by the first bytes."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return "png"
    if data[:2] == b"BM":
        return "bmp"
    if data[:3] == b"\xff\xd8\xff":
        return "jpeg"
    if data[:4] in (b"II*\0", b"MM\0*"):
        return "tiff"
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp"
    return "gif" if data[:4] == b"GIF8" else None


def _jpeg_size(data: bytes) -> tuple[int, int]:
    at = 2
    while at + 9 < len(data):
        if data[at] != 0xFF:
            break
        kind = data[at + 1]
        if kind == 0xFF or kind in (0x01, *range(0xD0, 0xD9)):
            at += 1 if kind == 0xFF else 2
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        else:
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    raise ImageProblem("malformed_image")


def header(data: bytes) -> tuple[str, int, int]:
    """Format, width, height as seen (after the EXIF rotation), without decoding pixels."""
    kind = sniff(data)
    if kind is None:
        raise ImageProblem("malformed_image")
    if kind not in FORMATS:
        raise ImageProblem("unsupported_format")
    try:
        if kind == "png":
            width, height = struct.unpack(">II", data[16:24])
        elif kind == "bmp":
            width, height = struct.unpack("<ii", data[18:26])
            height = abs(height)
        elif kind == "jpeg":
            width, height = _jpeg_size(data)
        elif kind == "webp":
            width, height = _webp_size(data)
        else:
            width, height = _tiff_size(data)
    except struct.error:
        raise ImageProblem("malformed_image") from None
    if width <= 0 or height <= 0:
        raise ImageProblem("malformed_image")
    return (kind, height, width) if orientation(data, kind) >= 5 else (kind, width, height)


def _webp_size(data: bytes) -> tuple[int, int]:
    chunk = data[12:16]
    if chunk == b"VP8X":
        return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
    if chunk == b"VP8L":
        bits = int.from_bytes(data[21:25], "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    width, height = struct.unpack("<HH", data[26:30])
    return width & 0x3FFF, height & 0x3FFF


def _tiff_size(data: bytes) -> tuple[int, int]:
    try:
        found = tags(data)
        return found[256][0], found[257][0]
    except (KeyError, struct.error):
        raise ImageProblem("malformed_image") from None


def orientation(data: bytes, kind: str) -> int:
    """The EXIF orientation of a JPEG or TIFF, 1 for others and if there is none."""
    try:
        if kind == "jpeg":
            return exif_orientation(data)
        if kind == "tiff":
            found = tags(data).get(274, [1])[0]
            return found if 1 <= found <= 8 else 1
    except (JpegProblem, KeyError, struct.error):
        pass
    return 1


def _unfilter(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    rows = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.int32)
    for y in range(height):
        kind = raw[y * (stride + 1)]
        line = np.frombuffer(raw, np.uint8, stride, y * (stride + 1) + 1).astype(np.int32)
        if kind == 1:
            line = np.concatenate([np.cumsum(line[c::step])[:, None] for c in range(step)], axis=1).reshape(-1) if stride % step == 0 else line
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):
            out = line.tolist()
            up = above.tolist()
            for x in range(stride):
                left = out[x - step] if x >= step else 0
                if kind == 3:
                    guess = (left + up[x]) // 2
                else:
                    corner = up[x - step] if x >= step else 0
                    p = left + up[x] - corner
                    gaps = abs(p - left), abs(p - up[x]), abs(p - corner)
                    guess = left if gaps[0] <= gaps[1] and gaps[0] <= gaps[2] else up[x] if gaps[1] <= gaps[2] else corner
                out[x] = (out[x] + guess) & 255
            line = np.array(out, np.int32)
        elif kind:
            raise ImageProblem("malformed_image")
        above = line & 255
        rows[y] = above
    return rows


# First column, first row and steps of the passes of an interlaced PNG.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _decode_png(data: bytes) -> np.ndarray:
    at, body, palette, clear = 8, [], None, None
    width, height, depth, color, _, _, interlace = struct.unpack(">IIBBBBB", data[16:29])
    while at + 8 <= len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        if len(chunk) < size or zlib.crc32(name + chunk) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ImageProblem("malformed_image")
        if name == b"IDAT":
            body.append(chunk)
        elif name == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif name == b"tRNS":
            clear = chunk
        elif name == b"IEND":
            break
        at += 12 + size
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(color)
    if channels is None or interlace > 1 or depth not in (1, 2, 4, 8, 16):
        raise ImageProblem("malformed_image")
    raw, used = zlib.decompress(b"".join(body)), 0
    pixels = np.zeros((height, width, channels), np.uint8)
    for x, y, dx, dy in PASSES if interlace else ((0, 0, 1, 1),):
        wide, high = -(-(width - x) // dx), -(-(height - y) // dy)
        if wide <= 0 or high <= 0:
            continue
        stride = (wide * channels * depth + 7) // 8
        if len(raw) < used + high * (stride + 1):
            raise ImageProblem("malformed_image")
        rows = _unfilter(raw[used : used + high * (stride + 1)], high, stride, max(1, channels * depth // 8))
        used += high * (stride + 1)
        if depth == 16:
            rows = rows[:, ::2]
        elif depth < 8:
            bits = np.unpackbits(rows, axis=1).reshape(high, -1, depth)
            rows = (bits * (1 << np.arange(depth)[::-1])).sum(axis=2).astype(np.uint8)[:, : wide * channels]
            if color == 0:
                rows = (rows.astype(np.int32) * 255 // ((1 << depth) - 1)).astype(np.uint8)
        pixels[y::dy, x::dx] = rows.reshape(high, wide, channels)
    if color == 3:
        alpha = np.full(256, 255, np.uint8)
        if clear:
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
        index = pixels[:, :, 0]
        return np.dstack([palette[index], alpha[index]]) if clear else palette[index]
    if channels <= 2:
        gray = np.repeat(pixels[:, :, :1], 3, axis=2)
        return np.dstack([gray, pixels[:, :, 1]]) if channels == 2 else gray
    return pixels


def _decode_bmp(data: bytes) -> np.ndarray:
    begin, _, width, height, _, bits, packing = struct.unpack("<IIiiHHI", data[10:34])
    if bits not in (24, 32) or packing not in (0, 3):
        raise ImageProblem("malformed_image")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, abs(height) * stride, begin).reshape(abs(height), stride)
    pixels = rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    return pixels[::-1] if height > 0 else pixels


def decode(data: bytes, max_pixels: int = 50_000_000) -> np.ndarray:
    """RGB or RGBA pixels (height, width, channels), upright, of a PNG, BMP, JPEG or TIFF. WEBP is
    recognised and measured by ``header``, but there is no decoder for it here."""
    kind, width, height = header(data)
    if width * height > max_pixels:
        raise ImageProblem("image_too_large")
    try:
        if kind == "png":
            return _decode_png(data)
        if kind == "bmp":
            return _decode_bmp(data)
        if kind == "jpeg":
            return decode_jpeg(data)
        if kind == "tiff":
            return upright(decode_tiff(data), orientation(data, kind))
    except (zlib.error, struct.error, ValueError, IndexError, TypeError, JpegProblem, TiffProblem):
        raise ImageProblem("malformed_image") from None
    raise ImageProblem("unsupported_format")


def encode_png(pixels: np.ndarray) -> bytes:
    """PNG of uint8 RGB or RGBA pixels."""
    height, width, channels = pixels.shape
    raw = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], axis=1).tobytes()
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    head = struct.pack(">IIBBBBB", width, height, 8, {3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def _cubic(x: float) -> float:
    """The convolution kernel with slope -1/2 at 1."""
    x = abs(x)
    return 1.5 * x**3 - 2.5 * x**2 + 1 if x < 1 else -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0.0


def _lanczos(x: float) -> float:
    sinc = lambda v: 1.0 if v == 0 else math.sin(math.pi * v) / (math.pi * v)
    return sinc(x) * sinc(x / 3) if -3 <= x < 3 else 0.0


KERNELS = {"lanczos": (3, _lanczos), "bilinear": (1, lambda x: max(0.0, 1 - abs(x))), "bicubic": (2, _cubic)}


@lru_cache(maxsize=256)
def _taps(size: int, out: int, kernel: str) -> np.ndarray:
    """Fixed-point weights (out x size), in units of 2**-22."""
    reach, weigh = KERNELS[kernel]
    scale = size / out
    stretch = max(scale, 1.0)
    weights = np.zeros((out, size), np.int64)
    for i in range(out):
        center = (i + 0.5) * scale
        lo = max(0, int(center - reach * stretch + 0.5))
        hi = min(size, int(center + reach * stretch + 0.5))
        row = [weigh((x - center + 0.5) / stretch) for x in range(lo, hi)]
        total = sum(row)
        weights[i, lo:hi] = [int(w / total * (1 << 22) + (0.5 if w / total >= 0 else -0.5)) for w in row]
    return weights


def resize(pixels: np.ndarray, width: int, height: int, kernel: str = "lanczos") -> np.ndarray:
    """Resize of uint8 pixels (2-d or with channels): along x, then along y."""
    whole = pixels if pixels.ndim == 3 else pixels[:, :, None]
    half = 1 << 21
    across = np.einsum("ox,yxc->yoc", _taps(whole.shape[1], width, kernel), whole.astype(np.int64)) + half >> 22
    across = np.clip(across, 0, 255)
    down = np.einsum("oy,yxc->oxc", _taps(whole.shape[0], height, kernel), across) + half >> 22
    out = np.clip(down, 0, 255).astype(np.uint8)
    return out if pixels.ndim == 3 else out[:, :, 0]


def on_white(pixels: np.ndarray) -> np.ndarray:
    if pixels.shape[2] == 3:
        return pixels
    alpha = pixels[:, :, 3:].astype(np.int64)
    mixed = pixels[:, :, :3] * alpha + 255 * (255 - alpha) + 128
    return (mixed + (mixed >> 8) >> 8).astype(np.uint8)


def gray(rgb: np.ndarray) -> np.ndarray:
    r, g, b = (rgb[:, :, i].astype(np.int64) for i in range(3))
    return (r * 19595 + g * 38470 + b * 7471 + 0x8000 >> 16).astype(np.uint8)


@lru_cache(maxsize=1)
def _cosines() -> np.ndarray:
    k, x = np.arange(8)[:, None], np.arange(32)[None, :]
    basis = np.cos(np.pi * k * (2 * x + 1) / 64) * math.sqrt(2 / 32)
    basis[0] /= math.sqrt(2)
    return basis


def perceptual_hash(pixels: np.ndarray) -> int:
    """64-bit hash: gray on white, 32 x 32, the 8 x 8 lowest DCT terms against the median of
    all but the first (whose bit, the highest, is 0)."""
    small = resize(gray(on_white(pixels)), 32, 32).astype(np.float64)
    low = (_cosines() @ small @ _cosines().T).reshape(-1)
    bits = low > np.median(low[1:])
    bits[0] = False
    return int("".join("01"[int(b)] for b in bits), 2)


def pixel_digest(pixels: np.ndarray) -> str:
    """SHA-256 of width and height (8 bytes each) and the RGB bytes, on white: equal for equal
    pictures, however their files are written."""
    rgb = np.ascontiguousarray(on_white(pixels))
    return hashlib.sha256(rgb.shape[1].to_bytes(8, "big") + rgb.shape[0].to_bytes(8, "big") + rgb.tobytes()).hexdigest()


def test_embedding(pixels: np.ndarray, dimension: int = 16, seed: int = 0) -> np.ndarray:
    """Unit vector derived from a hash of the pixels; equal images give equal vectors."""
    rgb = on_white(pixels) if pixels.shape[2] == 4 else pixels
    size = rgb.shape[1].to_bytes(8, "big") + rgb.shape[0].to_bytes(8, "big")
    digest = hashlib.sha256(size + np.ascontiguousarray(rgb).tobytes()).digest()
    need = range(-(-dimension // 32))
    raw = b"".join(hashlib.sha256(str(seed).encode() + i.to_bytes(8, "big") + digest).digest() for i in need)
    row = np.frombuffer(raw[:dimension], np.uint8).astype(np.float64) - 127.5
    return (row / np.linalg.norm(row)).astype(np.float32)


test_embedding.__test__ = False
