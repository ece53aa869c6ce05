"""TIFF decoding in NumPy: strips of 8-bit gray, RGB, RGBA or palette pixels, uncompressed,
PackBits, LZW or Deflate."""

from __future__ import annotations

import struct
import zlib

import numpy as np


class TiffProblem(Exception):
    pass


# Bytes by field type.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8}


def tags(data: bytes) -> dict[int, list[int]]:
    """Integer fields of the first directory."""
    end = {b"II": "<", b"MM": ">"}[data[:2]]
    at = struct.unpack(end + "I", data[4:8])[0]
    found = {}
    for i in range(struct.unpack(end + "H", data[at : at + 2])[0]):
        tag, kind, n = struct.unpack(end + "HHI", data[at + 2 + 12 * i : at + 10 + 12 * i])
        size = _SIZES.get(kind, 0) * n
        if kind not in (1, 3, 4) or not n:
            continue
        place = at + 10 + 12 * i
        if size > 4:
            place = struct.unpack(end + "I", data[place : place + 4])[0]
        found[tag] = list(struct.unpack(end + str(n) + {1: "B", 3: "H", 4: "I"}[kind], data[place : place + size]))
    return found


def _unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def _unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits; 256 clears the table, 257 ends."""
    out, at, width = bytearray(), 0, 9
    table: list[bytes] = [bytes([i]) for i in range(256)] + [b"", b""]
    former = b""
    while at + width <= 8 * len(data):
        code = int.from_bytes(data[at >> 3 : (at >> 3) + 4].ljust(4, b"\0"), "big") >> (32 - (at & 7) - width) & ((1 << width) - 1)
        at += width
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, former = 9, b""
            continue
        if code > len(table) or (code == len(table) and not former):
            raise TiffProblem("unknown code")
        word = table[code] if code < len(table) else former + former[:1]
        out += word
        if former:
            table.append(former + word[:1])
        former = word
        width = 9 + sum(len(table) + 1 >= limit for limit in (512, 1024, 2048))
    return bytes(out)


def decode_tiff(data: bytes) -> np.ndarray:
    """Pixels (height, width, 3 or 4) and no rotation."""
    try:
        t = tags(data)
        width, height = t[256][0], t[257][0]
        packing, colors, samples = t.get(259, [1])[0], t.get(262, [1])[0], t.get(277, [1])[0]
        if set(t.get(258, [1])) != {8} or t.get(284, [1])[0] != 1 or 273 not in t:
            raise TiffProblem("unsupported layout")
        rows_each = t.get(278, [height])[0]
        pixels = np.empty((height, width, samples), np.uint8)
        for k, (begin, n) in enumerate(zip(t[273], t[279])):
            part = data[begin : begin + n]
            if packing in (8, 32946):
                part = zlib.decompress(part)
            elif packing == 5:
                part = _unpack_lzw(part)
            elif packing == 32773:
                part = _unpack_bits(part)
            elif packing != 1:
                raise TiffProblem("unsupported compression")
            y = k * rows_each
            n_rows = min(rows_each, height - y)
            strip = np.frombuffer(part, np.uint8, n_rows * width * samples).reshape(n_rows, width, samples)
            if t.get(317, [1])[0] == 2:
                strip = np.cumsum(strip, axis=1, dtype=np.uint8)
            pixels[y : y + n_rows] = strip
    except (KeyError, IndexError, ValueError, struct.error, zlib.error) as problem:
        raise TiffProblem("malformed data") from problem
    if colors == 3:
        palette = (np.array(t[320]).reshape(3, -1).T >> 8).astype(np.uint8)
        return palette[pixels[:, :, 0]]
    if colors == 2 and samples in (3, 4):
        return pixels
    if colors in (0, 1) and samples == 1:
        return np.repeat(255 - pixels if colors == 0 else pixels, 3, axis=2)
    raise TiffProblem("unsupported colours")
