"""A JPEG decoder (baseline and progressive, 8 bits) and a baseline encoder, in NumPy."""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass, field

import numpy as np


class JpegProblem(Exception):
    pass


# The quantisation tables of the standard at quality 50, in rows.
LUMA = np.array([
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
])
CHROMA = np.full((8, 8), 99)
CHROMA[:4, :4] = [[17, 18, 24, 47], [18, 21, 26, 66], [24, 26, 56, 99], [47, 66, 99, 99]]

#: Places of the 64 coefficients along the diagonals, as indices into rows.
ZIGZAG = np.array([y * 8 + x for _, _, y, x in sorted((x + y, x if (x + y) % 2 == 0 else y, y, x) for y in range(8) for x in range(8))])
_BASIS = np.cos((2 * np.arange(8)[None, :] + 1) * np.arange(8)[:, None] * math.pi / 16) * 0.5
_BASIS[0] /= math.sqrt(2)


@dataclass
class _Part:
    """A colour component."""

    across: int
    down: int
    quant: int
    wide: int = 0  # blocks with the padding of whole units
    high: int = 0
    own_wide: int = 0  # blocks that scans of this component alone have
    own_high: int = 0
    coefficients: np.ndarray = field(default_factory=lambda: np.empty(0))


class _Bits:
    """Bits of one stretch of entropy-coded data."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data.replace(b"\xff\x00", b"\xff") + b"\0" * 8, 0, 0
        self.end = (len(self.data) - 8) * 8

    def peek(self) -> int:
        byte = self.at >> 3
        return int.from_bytes(self.data[byte : byte + 3], "big") >> (8 - (self.at & 7)) & 0xFFFF

    def take(self, n: int) -> int:
        if not n:
            return 0
        byte = self.at >> 3
        value = int.from_bytes(self.data[byte : byte + 4], "big") >> (32 - (self.at & 7) - n) & ((1 << n) - 1)
        self.at += n
        if self.at > self.end + 64:
            raise JpegProblem("entropy data ends early")
        return value

    def symbol(self, table: list[tuple[int, int]]) -> int:
        value, n = table[self.peek()]
        if not n:
            raise JpegProblem("unknown code")
        self.at += n
        if self.at > self.end + 64:
            raise JpegProblem("entropy data ends early")
        return value

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value if not n or value >> (n - 1) else value - (1 << n) + 1


def _lookup(counts: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """(symbol, length) for each 16 bits that may come next."""
    table = [(0, 0)] * 65536
    code = at = 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            span = 1 << (16 - length)
            if (code + 1) * span > 65536:
                raise JpegProblem("codes overflow")
            table[code * span : (code + 1) * span] = [(symbols[at], length)] * span
            code += 1
            at += 1
        code <<= 1
    return table


def _orientation(exif: bytes) -> int:
    """The orientation (1 to 8) that EXIF data gives, 1 if none."""
    try:
        end = {b"II": "<", b"MM": ">"}[exif[:2]]
        at = struct.unpack(end + "I", exif[4:8])[0]
        for i in range(struct.unpack(end + "H", exif[at : at + 2])[0]):
            tag, _, _, value = struct.unpack(end + "HHIH", exif[at + 2 + 12 * i : at + 12 + 12 * i])
            if tag == 0x112:
                return value if 1 <= value <= 8 else 1
    except (KeyError, struct.error):
        pass
    return 1


def upright(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """Pixels as they are meant to be seen."""
    if orientation in (2, 3, 6, 7):
        pixels = pixels[:, ::-1] if orientation in (2, 3) else pixels
    if orientation in (3, 4):
        pixels = pixels[::-1]
    if orientation >= 5:
        pixels = pixels.swapaxes(0, 1)
        if orientation in (6, 7):
            pixels = pixels[:, ::-1]
        if orientation in (7, 8):
            pixels = pixels[::-1]
    return np.ascontiguousarray(pixels)


def segments(data: bytes):
    """(marker, payload, end) of each segment up to the first scan, then of the scans' headers;
    entropy-coded data is stepped over."""
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise JpegProblem("marker expected")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0xD9:
            return
        if 0xD0 <= kind <= 0xD8 or kind == 1:
            at += 2
            continue
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        if at + 2 + size > len(data):
            raise JpegProblem("segment ends early")
        end = at + 2 + size
        yield kind, data[at + 4 : end], end
        at = end
        if kind == 0xDA:
            while True:
                at = data.find(b"\xff", at)
                if at < 0 or at + 1 >= len(data):
                    raise JpegProblem("no end of image")
                if data[at + 1] != 0 and not 0xD0 <= data[at + 1] <= 0xD7:
                    break
                at += 2


def exif_orientation(data: bytes) -> int:
    for kind, body, _ in segments(data):
        if kind == 0xE1 and body[:6] == b"Exif\0\0":
            return _orientation(body[6:])
        if kind == 0xDA:
            break
    return 1


class _Decoder:
    def __init__(self, data: bytes):
        self.data = data
        self.quants: dict[int, np.ndarray] = {}
        self.tables: dict[int, list] = {}
        self.parts: dict[int, _Part] = {}
        self.interval, self.adobe, self.orientation = 0, None, 1
        self.width = self.height = 0
        self.progressive = False

    def run(self) -> np.ndarray:
        scans = 0
        for kind, body, end in segments(self.data):
            if kind == 0xDB:
                self._quant(body)
            elif kind == 0xC4:
                self._huffman(body)
            elif kind in (0xC0, 0xC1, 0xC2):
                self._frame(body, kind == 0xC2)
            elif 0xC3 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                raise JpegProblem("lossless and arithmetic coding are not supported")
            elif kind == 0xDD:
                self.interval = struct.unpack(">H", body[:2])[0]
            elif kind == 0xEE and body[:5] == b"Adobe":
                self.adobe = body[11]
            elif kind == 0xE1 and body[:6] == b"Exif\0\0":
                self.orientation = _orientation(body[6:])
            elif kind == 0xDA:
                self._scan(body, end)
                scans += 1
        if not scans:
            raise JpegProblem("no scan")
        return self._pixels()

    def _quant(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, slot = body[at] >> 4, body[at] & 15
            size = 128 if wide else 64
            self.quants[slot] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, at + 1).astype(np.float64)
            at += 1 + size

    def _huffman(self, body: bytes) -> None:
        at = 0
        while at + 17 <= len(body):
            counts = body[at + 1 : at + 17]
            n = sum(counts)
            self.tables[body[at]] = _lookup(counts, body[at + 17 : at + 17 + n])
            at += 17 + n

    def _frame(self, body: bytes, progressive: bool) -> None:
        bits, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        if bits != 8 or not self.height or not self.width or self.parts:
            raise JpegProblem("unsupported frame")
        self.progressive = progressive
        for i in range(n):
            name, sampling, quant = body[6 + 3 * i : 9 + 3 * i]
            self.parts[name] = _Part(sampling >> 4, sampling & 15, quant)
        self.most = max(p.across for p in self.parts.values()), max(p.down for p in self.parts.values())
        self.units = -(-self.width // (8 * self.most[0])), -(-self.height // (8 * self.most[1]))
        for p in self.parts.values():
            p.wide, p.high = self.units[0] * p.across, self.units[1] * p.down
            p.own_wide = -(-(-(-self.width * p.across // self.most[0])) // 8)
            p.own_high = -(-(-(-self.height * p.down // self.most[1])) // 8)
            p.coefficients = np.zeros((p.high * p.wide, 64), np.int32)

    def _scan(self, body: bytes, begin: int) -> None:
        n = body[0]
        chosen = [(self.parts[body[1 + 2 * i]], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
        low, high, shifts = body[1 + 2 * n : 4 + 2 * n]
        at, stretches, start = begin, [], begin
        while True:
            at = self.data.find(b"\xff", at)
            following = self.data[at + 1]
            if following == 0:
                at += 2
            elif 0xD0 <= following <= 0xD7:
                stretches.append(self.data[start:at])
                at = start = at + 2
            else:
                stretches.append(self.data[start:at])
                break
        if n == 1:
            part = chosen[0][0]
            places = [[(0, y * part.wide + x)] for y in range(part.own_high) for x in range(part.own_wide)]
        else:
            places = [
                [(c, (uy * p.down + y) * p.wide + ux * p.across + x) for c, (p, _, _) in enumerate(chosen) for y in range(p.down) for x in range(p.across)]
                for uy in range(self.units[1]) for ux in range(self.units[0])
            ]
        step = self.interval or len(places)
        for k, stretch in enumerate(stretches):
            bits, former, self.run_left = _Bits(stretch), [0] * n, 0
            for unit in places[k * step : (k + 1) * step]:
                for c, place in unit:
                    part, dc, ac = chosen[c]
                    row = part.coefficients[place]
                    if not self.progressive:
                        self._baseline(bits, row, former, c, self.tables[dc], self.tables[16 + ac])
                    elif low == 0:
                        if shifts >> 4:
                            row[0] |= bits.take(1) << (shifts & 15)
                        else:
                            former[c] += bits.signed(bits.symbol(self.tables[dc]))
                            row[0] = former[c] << (shifts & 15)
                    elif shifts >> 4:
                        self._refine(bits, row, self.tables[16 + ac], low, high, 1 << (shifts & 15))
                    else:
                        self._first(bits, row, self.tables[16 + ac], low, high, shifts & 15)

    @staticmethod
    def _baseline(bits, row, former, c, dc, ac) -> None:
        former[c] += bits.signed(bits.symbol(dc))
        row[0] = former[c]
        k = 1
        while k < 64:
            code = bits.symbol(ac)
            run, size = code >> 4, code & 15
            if not size:
                if run < 15:
                    return
                k += 16
                continue
            k += run
            if k > 63:
                raise JpegProblem("too many coefficients")
            row[k] = bits.signed(size)
            k += 1

    def _first(self, bits, row, ac, low, high, shift) -> None:
        if self.run_left:
            self.run_left -= 1
            return
        k = low
        while k <= high:
            code = bits.symbol(ac)
            run, size = code >> 4, code & 15
            if not size:
                if run < 15:
                    self.run_left = (1 << run) - 1 + bits.take(run)
                    return
                k += 16
                continue
            k += run
            if k > 63:
                raise JpegProblem("too many coefficients")
            row[k] = bits.signed(size) * (1 << shift)
            k += 1

    def _refine(self, bits, row, ac, low, high, one) -> None:
        """A further bit of the coefficients known so far, and new ones between them."""

        def sharpen(k: int) -> None:
            if bits.take(1) and not abs(int(row[k])) & one:
                row[k] += one if row[k] > 0 else -one

        k = low
        if not self.run_left:
            while k <= high:
                code = bits.symbol(ac)
                zeros, size = code >> 4, code & 15
                fresh = 0
                if size:
                    fresh = one if bits.take(1) else -one
                elif zeros < 15:
                    self.run_left = (1 << zeros) + bits.take(zeros)
                    break
                while k <= high:
                    if row[k]:
                        sharpen(k)
                    elif not zeros:
                        break
                    else:
                        zeros -= 1
                    k += 1
                if fresh and k <= high:
                    row[k] = fresh
                k += 1
        if self.run_left:
            for rest in range(k, high + 1):
                if row[rest]:
                    sharpen(rest)
            self.run_left -= 1

    def _plane(self, part: _Part) -> np.ndarray:
        rows = np.zeros((len(part.coefficients), 64))
        rows[:, ZIGZAG] = part.coefficients * self.quants[part.quant]
        blocks = _BASIS.T @ rows.reshape(-1, 8, 8) @ _BASIS + 128
        plane = np.clip(np.rint(blocks), 0, 255).reshape(part.high, part.wide, 8, 8).swapaxes(1, 2).reshape(part.high * 8, part.wide * 8)
        plane = plane[: -(-self.height * part.down // self.most[1]), : -(-self.width * part.across // self.most[0])]
        for axis, times in ((0, self.most[1] // part.down), (1, self.most[0] // part.across)):
            plane = _stretch(plane, axis, times)
        return plane[: self.height, : self.width]

    def _pixels(self) -> np.ndarray:
        planes = [self._plane(p) for p in self.parts.values()]
        if len(planes) == 1:
            out = np.dstack(planes * 3)
        elif len(planes) == 3 and self.adobe != 0:
            out = _rgb(*planes)
        elif len(planes) == 3:
            out = np.dstack(planes)
        elif len(planes) == 4:  # inks, stored as their complements
            inks = np.clip(_rgb(*planes[:3]), 0, 255) if self.adobe == 2 else np.dstack(planes[:3])
            out = inks * planes[3][:, :, None] / 255
        else:
            raise JpegProblem("unsupported colours")
        return upright(np.clip(np.rint(out), 0, 255).astype(np.uint8), self.orientation)


def _stretch(plane: np.ndarray, axis: int, times: int) -> np.ndarray:
    """Samples ``times`` as dense: between neighbours in the ratio 3 : 1 where doubled."""
    if times == 1:
        return plane
    if times != 2:
        return np.repeat(plane, times, axis)
    n = plane.shape[axis]
    before = np.take(plane, [0, *range(n - 1)], axis)
    after = np.take(plane, [*range(1, n), n - 1], axis)
    both = np.stack([(3 * plane + before) / 4, (3 * plane + after) / 4], axis + 1)
    return both.reshape([2 * s if a == axis else s for a, s in enumerate(plane.shape)])


def _rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    cb, cr = cb - 128, cr - 128
    return np.dstack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb])


def decode_jpeg(data: bytes) -> np.ndarray:
    """RGB pixels, turned upright by the EXIF orientation."""
    try:
        return _Decoder(data).run()
    except (struct.error, IndexError, KeyError, ValueError) as problem:
        raise JpegProblem("malformed data") from problem


# ------------------------------------------------------------------ encoder


def _quality_table(base: np.ndarray, quality: int) -> np.ndarray:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((base.reshape(64) * scale + 50) // 100, 1, 255)


def _block_codes(rows: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Per block: (symbol, bits, number of bits) of the differences and the runs."""
    out, former = [], 0
    for row in rows.tolist():
        codes = []

        def add(run: int, value: int) -> None:
            size = abs(value).bit_length()
            codes.append((run << 4 | size, value if value > 0 else value + (1 << size) - 1, size))

        add(0, row[0] - former)
        former, run = row[0], 0
        last = max((k for k in range(1, 64) if row[k]), default=0)
        for value in row[1 : last + 1]:
            if not value:
                run += 1
                continue
            while run > 15:
                codes.append((0xF0, 0, 0))
                run -= 16
            add(run, value)
            run = 0
        if last < 63:
            codes.append((0, 0, 0))
        out.append(codes)
    return out


def encode_jpeg(pixels: np.ndarray, quality: int, *, subsample: bool = True) -> bytes:
    """A baseline JPEG of RGB pixels, by default with colours at half the density each way.

    Codes are of one length per table, which any decoder reads; files are larger than
    with codes fitted to the data."""
    rgb = pixels.astype(np.float64)
    y = rgb @ (0.299, 0.587, 0.114)
    planes = [y, (rgb[:, :, 2] - y) / 1.772 + 128, (rgb[:, :, 0] - y) / 1.402 + 128]
    height, width = y.shape
    unit = 16 if subsample else 8
    high, wide = -(-height // unit) * unit, -(-width // unit) * unit
    planes = [np.pad(p, ((0, high - height), (0, wide - width)), mode="edge") for p in planes]
    if subsample:
        planes[1:] = [p.reshape(high // 2, 2, wide // 2, 2).mean(axis=(1, 3)) for p in planes[1:]]
    quants = [_quality_table(t, quality) for t in (LUMA, CHROMA, CHROMA)]
    units = []
    for p, q, s in zip(planes, quants, (2 if subsample else 1, 1, 1)):
        blocks = (p - 128).reshape(p.shape[0] // 8, 8, -1, 8).swapaxes(1, 2)
        rows = np.rint((_BASIS @ blocks @ _BASIS.T).reshape(*blocks.shape[:2], 64) / q).astype(int)[:, :, ZIGZAG]
        units.append(rows.reshape(high // unit, s, wide // unit, s, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64))
    codes = [_block_codes(u) for u in units]
    tables = {}
    for slot, mine in ((0, codes[:1]), (1, codes[1:])):
        tables[slot] = sorted({b[0][0] for c in mine for b in c})
        tables[16 + slot] = sorted({s for c in mine for b in c for s, _, _ in b[1:]}) or [0]
    length = {slot: max(1, len(symbols).bit_length()) for slot, symbols in tables.items()}
    place = {slot: {s: i for i, s in enumerate(symbols)} for slot, symbols in tables.items()}
    bits: list[str] = []
    per = (4 if subsample else 1, 1, 1)
    for u in range(len(codes[1])):
        for c in range(3):
            for b in codes[c][u * per[c] : (u + 1) * per[c]]:
                for k, (symbol, value, size) in enumerate(b):
                    slot = min(c, 1) + 16 * bool(k)
                    bits.append(format(place[slot][symbol], f"0{length[slot]}b"))
                    if size:
                        bits.append(format(value, f"0{size}b"))
    stream = "".join(bits)
    stream += "1" * (-len(stream) % 8)
    body = int(stream, 2).to_bytes(len(stream) // 8, "big").replace(b"\xff", b"\xff\x00")
    segment = lambda kind, data: struct.pack(">BBH", 0xFF, kind, len(data) + 2) + data
    out = b"\xff\xd8" + segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")
    for slot in (0, 1):
        out += segment(0xDB, bytes([slot]) + bytes(quants[slot][ZIGZAG].tolist()))
    luma = 0x22 if subsample else 0x11
    out += segment(0xC0, struct.pack(">BHHB", 8, height, width, 3) + bytes([1, luma, 0, 2, 0x11, 1, 3, 0x11, 1]))
    for slot, symbols in tables.items():
        counts = [len(symbols) if n == length[slot] else 0 for n in range(1, 17)]
        out += segment(0xC4, bytes([slot, *counts, *symbols]))
    return out + segment(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])) + body + b"\xff\xd9"
