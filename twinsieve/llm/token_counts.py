"""Edit-aware token counts: a segment tree over runs of pre-tokens per document."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.runtime import ship_package

#: Fixed value: the pattern that cuts text into pre-tokens before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF_CHARS = 256

#: Places where pre-tokens always part, whatever stands further off: before white space that
#: stands alone, between letters and digits, around other signs. An apostrophe may begin a
#: pre-token with the letters after it, so no cut is made behind one.
CUT = regex.compile(
    r"(?<=\S)(?=\s\S)|(?<=\p{L})(?=[\p{N}\p{P}\p{S}])|(?<=\p{N})(?=[\p{L}\p{P}\p{S}])|(?<=[\p{P}\p{S}--'])(?=[\p{L}\p{N}])",
    regex.V1,
)

_encodings: dict[str, tiktoken.Encoding] = {}


def encoding_of(ranks: bytes) -> tiktoken.Encoding:
    """The tokenizer of a rank file's content; one per process and content."""
    key = hashlib.sha256(ranks).hexdigest()
    if key not in _encodings:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _encodings[key] = tiktoken.Encoding(key, pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _encodings[key]


def cut_leaves(text: str, size: int = LEAF_CHARS) -> list[str]:
    """Cut ``text`` about every ``size`` characters, at the first ``CUT`` from there on.

    No pre-token spans such a place and none looks past it, so the tokens of the leaves are the
    tokens of the text. What stands between two cuts is never divided: a megabyte of one
    letter is one leaf.
    """
    leaves, begin = [], 0
    while True:
        cut = CUT.search(text, begin + size)
        if cut is None or cut.start() >= len(text):
            leaves.append(text[begin:])
            return leaves
        leaves.append(text[begin : cut.start()])
        begin = cut.start()


def build_tree(counts: list[int]) -> list[int]:
    """Heap of sums: node i has children 2i and 2i + 1; leaves start at the middle."""
    half = 1 << max(0, (len(counts) - 1).bit_length())
    tree = [0] * (2 * half)
    tree[half : half + len(counts)] = counts
    for i in range(half - 1, 0, -1):
        tree[i] = tree[2 * i] + tree[2 * i + 1]
    return tree


def set_leaf(tree: list[int], leaf: int, count: int) -> None:
    i = len(tree) // 2 + leaf
    change = count - tree[i]
    while i and change:
        tree[i] += change
        i //= 2


def apply_edits(
    text: str, sizes: list[int], tree: list[int], edits: list[tuple[int, int, str]], count
) -> tuple[str, int, int]:
    """Apply edits (begin, end, new text; places of the old text); ``sizes`` and ``tree``
    change in place. Returns the new text, the edits applied and the characters encoded.

    An edit touches the leaves it lies in and those beside a cut that is next to it, as a
    cut depends on the character before and two behind. Touched leaves are encoded again. If
    their new text needs no more leaves than before, sums change along their paths only; if
    it needs more, leaves are put in and the sums (not the tokens) are built anew, so no
    leaf grows with the number of edits.
    """
    n = len(text)
    starts, at = [], 0
    for s in sizes:
        starts.append(at)
        at += s
    applied: list[tuple[int, int, str]] = []
    for begin, end, new in sorted(edits):
        begin, end = min(max(begin, 0), n), min(max(end, begin, 0), n)
        if applied and begin < applied[-1][1]:
            continue
        applied.append((begin, end, new))
    groups: list[list] = []  # first leaf, last leaf, edits
    first = last = 0
    for edit in applied:
        begin, end, _ = edit
        while first + 1 < len(starts) and starts[first + 1] <= begin - 2:
            first += 1
        last = max(last, first)
        while last + 1 < len(starts) and starts[last + 1] <= end:
            last += 1
        if groups and first <= groups[-1][1]:
            groups[-1][1] = max(groups[-1][1], last)
            groups[-1][2].append(edit)
        else:
            groups.append([first, last, [edit]])
    out, done, encoded = [], 0, 0
    longer: list[tuple[int, int, list[str]]] = []
    for low, high, some in groups:
        lo = starts[low]
        hi = starts[high + 1] if high + 1 < len(starts) else n
        parts, place = [], lo
        for begin, end, new in some:
            parts += [text[place:begin], new]
            place = end
        parts.append(text[place:hi])
        region = "".join(parts)
        slots = high - low + 1
        leaves = cut_leaves(region)
        if len(leaves) > slots:
            longer.append((low, high, leaves))
        else:
            for k, leaf in enumerate(leaves + [""] * (slots - len(leaves))):
                sizes[low + k] = len(leaf)
                set_leaf(tree, low + k, count(leaf) if leaf else 0)
        encoded += len(region)
        out += [text[done:lo], region]
        done = hi
    out.append(text[done:])
    if longer:
        half = len(tree) // 2
        counts = tree[half : half + len(sizes)]
        for low, high, leaves in reversed(longer):
            sizes[low : high + 1] = map(len, leaves)
            counts[low : high + 1] = map(count, leaves)
        tree[:] = build_tree(counts)
    return "".join(out), len(applied), encoded


def _index_batches(batches: Iterator[pa.RecordBatch], ranks: bytes) -> Iterator[pa.RecordBatch]:
    encode = encoding_of(ranks).encode_ordinary
    for batch in batches:
        sizes, trees = [], []
        for text in batch.column("text"):
            leaves = cut_leaves(text.as_py() or "")
            sizes.append([len(leaf) for leaf in leaves])
            trees.append(build_tree([len(encode(leaf)) for leaf in leaves]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("text"), pa.array(sizes, pa.list_(pa.int32())), pa.array(trees, pa.list_(pa.int64()))],
            names=["id", "text", "leaf_chars", "tree"],
        )


def _edit_batches(batches: Iterator[pa.RecordBatch], ranks: bytes) -> Iterator[pa.RecordBatch]:
    encode = encoding_of(ranks).encode_ordinary
    for batch in batches:
        rows = []
        for text, sizes, tree, edits in zip(*(batch.column(c) for c in ("text", "leaf_chars", "tree", "edits"))):
            sizes, tree = sizes.as_py(), tree.as_py()
            before = tree[1]
            todo = [(e["begin"], e["end"], e["new"] or "") for e in edits.as_py() or () if e and None not in (e["begin"], e["end"])]
            new, applied, encoded = apply_edits(text.as_py() or "", sizes, tree, todo, lambda s: len(encode(s)))
            rows.append((new, sizes, tree, before, applied, encoded))
        kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64()]
        names = ["text", "leaf_chars", "tree", "tokens_before", "n_edits", "chars_encoded"]
        columns = list(zip(*rows)) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["id", *names]
        )


def index_tokens(docs: DataFrame, rank_file: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, text_col, leaf_chars, tree``: the token count of a text is ``tree[1]``.

    ``rank_file`` is a path on the driver; its content is sent to the tasks. Ids are integers.
    Null text counts as empty (0 tokens); texts of any length are counted whole, one at a
    time. Rows are independent of each other, so repeated rows and null ids have results
    like any others; an empty table gives an empty one. Other columns are not read.
    """
    ship_package(docs.sparkSession)
    with open(rank_file, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = rows.mapInArrow(
        lambda it: _index_batches(it, ranks.value), "id long, text string, leaf_chars array<int>, tree array<long>"
    )
    return out.withColumnsRenamed({"id": id_col, "text": text_col})


def recount(
    indexed: DataFrame, rank_file: str, *, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits"
) -> DataFrame:
    """Apply ``edits_col`` (``array<struct<begin,end,new>>``, code points of the old text) to
    a table from ``index_tokens``: the same columns for the new text, and
    ``tokens_before, tokens_after, n_edits, chars_encoded``.

    Edits apply in order of place; one that begins before the end of the one before is
    left out, as are edits with a null place; places are clipped to the text; null new text
    deletes; null or empty edits leave the row as it is. Work grows with the text of the touched
    leaves (a run without any place to cut, such as one long word, is a leaf). Null ids,
    repeated rows and empty tables as in ``index_tokens``; other columns are dropped.
    """
    ship_package(indexed.sparkSession)
    with open(rank_file, "rb") as file:
        ranks = indexed.sparkSession.sparkContext.broadcast(file.read())
    edits = F.col(edits_col).cast("array<struct<begin:long,end:long,new:string>>")
    rows = indexed.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), "leaf_chars", "tree", edits.alias("edits"))
    out = rows.mapInArrow(
        lambda it: _edit_batches(it, ranks.value),
        "id long, text string, leaf_chars array<int>, tree array<long>, tokens_before long, n_edits long, chars_encoded long",
    )
    return out.withColumn("tokens_after", F.get("tree", F.lit(1))).withColumnsRenamed({"id": id_col, "text": text_col})
