"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks,
exact weighted-shingle verification."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.words import U64, WordHashes, mix64, shingles
from twinsieve.runtime import ship_package

PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
SCREEN_BITS = 22
#: A fingerprint has 128 bits, in blocks of 16.
BITS, BLOCK = 128, 16
N_BLOCKS = BITS // BLOCK


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words with ASCII punctuation taken out."""
    return (text or b"").lower().translate(None, PUNCTUATION).split()


def votes(run: np.ndarray) -> np.ndarray:
    """The 128 bits (0 or 1) that each shingle votes for."""
    both = np.stack([run, mix64(run + U64(0x5851F42D4C957F2D))], axis=1)
    return np.unpackbits(np.ascontiguousarray(both).view(np.uint8), axis=1)


def fingerprints(sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Fingerprints (rows of 16-bit blocks) from summed votes of ``n`` shingles each."""
    return np.packbits(2 * sums > n[:, None], axis=1).view(np.uint16)


def simhash(run: np.ndarray) -> np.ndarray:
    """The blocks of one SimHash; a shingle counts as often as it stands in ``run``."""
    return fingerprints(votes(run).sum(axis=0, dtype=np.int64)[None, :], np.array([len(run)]))[0]


def block_radii(radius: int) -> list[int]:
    """Flips to allow per block: two prints within ``radius`` agree so far in at least one.

    If every block i had more than r_i flips, the distance would be at least the sum of all
    r_i + 1; so the r_i need only sum to ``radius`` - blocks + 1. -1 leaves a block out.
    """
    total = min(radius, BITS) - N_BLOCKS + 1
    return [max(-1, total // N_BLOCKS + (i < total % N_BLOCKS)) for i in range(N_BLOCKS)]


def flips(most: int) -> np.ndarray:
    """All 16-bit masks of at most ``most`` bits."""
    masks = [sum(1 << b for b in some) for k in range(most + 1) for some in combinations(range(BLOCK), k)]
    return np.array(masks, np.uint16)


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the lesser over sum of the greater weights of two shingle runs; a shingle
    weighs its count."""
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(nx[i], ny[j]).sum())
    total = len(a) + len(b) - both
    return both / total if total else 0.0


class ItemsOfLength:
    """Prints of the items of one length in words, indexed by block."""

    def __init__(self, members: list[int], prints: np.ndarray, radii: list[int]):
        self.members, self.prints, self.radii = np.array(members), prints, radii
        self.order = [np.argsort(prints[:, b], kind="stable") for b in range(N_BLOCKS)]
        self.values = [prints[o, b] for b, o in enumerate(self.order)]

    def proposed(self, print_: np.ndarray, masks: dict[int, np.ndarray]) -> np.ndarray:
        """Positions whose print is within the block's radius in at least one block, found by
        the flips of each block's value."""
        found = []
        for b, r in enumerate(self.radii):
            if r >= 0:
                keys = masks[r] ^ print_[b]
                lo, hi = (np.searchsorted(self.values[b], keys, side=side) for side in ("left", "right"))
                some = np.flatnonzero(lo < hi)
                found += [self.order[b][x:y] for x, y in zip(lo[some].tolist(), hi[some].tolist())]
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)

    def near(self, prints: np.ndarray, radius: int, masks: dict[int, np.ndarray]) -> Iterator[tuple[int, int, int]]:
        """(row of ``prints``, item, distance) of each item within the radius. Where the items
        are fewer than the flips of a block, the blocks are compared value by value."""
        if len(self.members) > min(len(m) for m in masks.values()):
            for row, print_ in enumerate(prints):
                some = self.proposed(print_, masks)
                distance = np.bitwise_count(self.prints[some] ^ print_).sum(axis=1, dtype=np.int64)
                yield from ((row, int(self.members[s]), int(d)) for s, d in zip(some, distance) if d <= radius)
            return
        for at in range(0, len(prints), 512):
            gaps = np.bitwise_count(prints[at : at + 512, None, :] ^ self.prints[None, :, :])
            whole = gaps.sum(axis=2, dtype=np.int64)
            rows, some = np.nonzero((gaps <= np.array(self.radii)).any(axis=2) & (whole <= radius))
            yield from zip((rows + at).tolist(), self.members[some].tolist(), whole[rows, some].tolist())


class ItemIndex:
    """A block of items: their shingles, a screen of all shingles, and prints by length."""

    def __init__(self, items: list[tuple[int, bytes]], *, width: int, radius: int):
        hashes = WordHashes()
        self.width, self.radius = width, radius
        self.ids: list[int] = []
        self.length: list[int] = []
        self.runs: list[np.ndarray] = []
        self.screen = np.zeros(1 << SCREEN_BITS, bool)
        by_length: dict[int, list[int]] = {}
        for item_id, text in items:
            words = hashes.of(words_of(text))
            if len(words):
                run = shingles(words, min(width, len(words)))
                by_length.setdefault(len(words), []).append(len(self.ids))
                self.ids.append(item_id)
                self.length.append(len(words))
                self.runs.append(run)
                self.screen[run & U64((1 << SCREEN_BITS) - 1)] = True
        radii = block_radii(radius)
        self.masks = {r: flips(r) for r in set(radii) if r >= 0}
        self.groups = {
            n: ItemsOfLength(members, np.stack([simhash(self.runs[i]) for i in members]), radii)
            for n, members in sorted(by_length.items())
        }


def item_windows(words: np.ndarray, starts: np.ndarray, index: ItemIndex, percent: int) -> Iterator[tuple]:
    """``length, begins, ends, prints`` of the item-sized windows of a batch of texts, for
    each item length. ``words`` are the word hashes of all texts, ``starts`` their bounds.

    A text shorter than an item is one window. Windows with too few shingles that stand in
    any item to reach the similarity with one are passed over: to share s of n and m
    shingles at ``percent`` %, s must be at least percent * (n + m) / (100 + percent).
    """
    sizes = np.diff(starts)
    room = np.repeat(starts[1:], sizes) - np.arange(len(words))  # words from here to the text's end
    runs: dict[int, tuple] = {}
    for length in index.groups:
        k = min(index.width, length)
        if k not in runs:
            run = shingles(words, k)
            run = np.concatenate([run, np.zeros(len(words) - len(run), U64)])
            known = index.screen[run & U64((1 << SCREEN_BITS) - 1)] & (room >= k)
            runs[k] = run, np.concatenate([[0], np.cumsum(known, dtype=np.int32)]).astype(np.int32)
        run, known = runs[k]
        m = length - k + 1
        need = -(-2 * percent * m // (100 + percent))
        full = np.flatnonzero(known[m:] - known[:-m] >= need) if len(words) >= m else np.empty(0, np.int64)
        full = full[room[full] >= length]
        short = np.flatnonzero((sizes < length) & (sizes >= k))
        n = sizes[short] - k + 1
        hits = known[starts[short] + n] - known[starts[short]]
        short = short[(100 + percent) * hits >= percent * (n + m)]
        begins, ends = np.concatenate([full, starts[short]]), np.concatenate([full + length, starts[short + 1]])
        n = ends - begins - k + 1
        for at in range(0, len(begins), 4096):
            b, m = begins[at : at + 4096], n[at : at + 4096]
            # Votes of all shingles under these windows, once each; a window's sum is a difference.
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, b, 1)
            np.add.at(edge, b + m, -1)
            under = np.cumsum(edge[:-1]) > 0
            rank = np.concatenate([[0], np.cumsum(under)])
            sums = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(votes(run[under]), axis=0, dtype=np.int32)])
            yield length, b, ends[at : at + 4096], fingerprints(sums[rank[b + m]] - sums[rank[b]], m)


def match_texts(words: np.ndarray, starts: np.ndarray, index: ItemIndex, percent: int) -> dict:
    """(text, item) -> (similarity, first word, distance, number of windows) of the best window."""
    best: dict[tuple[int, int], tuple[float, int, int, int]] = {}
    for length, begins, ends, prints in item_windows(words, starts, index, percent):
        group = index.groups[length]
        texts = np.searchsorted(starts, begins, side="right") - 1
        for row, item, distance in group.near(prints, index.radius, index.masks):
            window = words[begins[row] : ends[row]]
            run = shingles(window, min(index.width, length, len(window)))
            similarity = weighted_similarity(run, index.runs[item])
            if 100 * similarity >= percent:
                key, place = (int(texts[row]), item), int(begins[row] - starts[texts[row]])
                old = best.get(key)
                if old is None or similarity > old[0]:
                    best[key] = similarity, place, distance, (old[3] if old else 0) + 1
                else:
                    best[key] = *old[:3], old[3] + 1
    return best


def _match_batches(
    batches: Iterator[pa.RecordBatch], index: ItemIndex, percent: int, per_block: int = 200_000
) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    names = ["doc_id", "item_id", "start_word", "n_words", "distance", "similarity", "n_windows"]
    kinds = [pa.int64()] * 5 + [pa.float64(), pa.int64()]
    with np.errstate(over="ignore"):
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary())
            at = 0
            while at < len(ids):
                some: list[np.ndarray] = []
                first, total = at, 0
                while at < len(ids) and (at == first or total < per_block):
                    some.append(hashes.of(words_of(texts[at].as_py())))
                    total += len(some[-1])
                    at += 1
                starts = np.concatenate([[0], np.cumsum([len(w) for w in some])]).astype(np.int64)
                found = match_texts(np.concatenate(some), starts, index, percent) if total else {}
                out = [
                    (ids[first + text], index.ids[item], place, index.length[item], distance, similarity, n)
                    for (text, item), (similarity, place, distance, n) in sorted(found.items())
                ]
                columns = list(zip(*out)) if out else [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    radius: int = 31,
    block_words: int = 2_000_000,
) -> DataFrame:
    """``id_col, item_id, start_word, n_words, distance, similarity, n_windows``: one row per
    document row and item of which the document holds a window of the item's length with
    a weighted ``width``-word shingle similarity of at least ``percent`` %.

    Candidates: the SimHash (128 bits over the weighted shingles) of every window of an
    item's length, looked up among the items of that length by a multi-index of eight
    16-bit blocks. With ``radius`` 31 a pair within the radius differs in at most 3 bits of
    one block, so the index finds every print within it, and proposes 8 % of unrelated
    ones. Exact similarity decides. Windows that cannot reach the similarity, as too few of
    their shingles stand in any item, get no print. A pair at 80 % lies 19 bits off on average
    (sd 4; about 1 in 700 beyond 31, fewer above); ``radius`` 128 compares all and is exact.

    Ids are integers. Words are lower-cased (A-Z), ASCII punctuation is dropped. An item with
    fewer than ``width`` words counts as one shingle; an empty or null item, or text, matches
    nothing. A document shorter than an item is one window. Rows with a null id are
    matched like others; a repeated row gives its result again. Empty tables give none;
    other columns are not read.

    The items are read in blocks of about ``block_words`` words (8 bytes a word and 4 MB for
    each process that holds a block; the benchmark tables here are one block). Documents
    are never shuffled; each block of items is one pass over them.
    """
    ship_package(docs.sparkSession)
    source = items.select(F.col(item_id_col).cast("long").alias("i"), F.col(item_text_col).alias("t"))
    source = source.where("t IS NOT NULL").distinct()
    total = source.agg(F.sum(F.size(F.split("t", r"\s+")))).first()[0] or 0
    n_blocks = -(-total // block_words) or 1
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = (
        "doc_id long, item_id long, start_word long, n_words long, distance long, similarity double, n_windows long"
    )
    out = None
    for block in range(n_blocks):
        part = source.where(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == block).orderBy("i", "t").collect()
        with np.errstate(over="ignore"):
            index = ItemIndex([(r["i"], r["t"].encode()) for r in part], width=width, radius=radius)
        shared = docs.sparkSession.sparkContext.broadcast(index)
        found = texts.mapInArrow(lambda it, s=shared: _match_batches(it, s.value, percent), schema)
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("doc_id", id_col)
