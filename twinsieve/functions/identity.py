"""Deterministic ids and the vocabulary of splits and evidence, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names in rank order.
SPLITS = ("train", "val", "test", "custom")
TARGETS = SPLITS[:3]
CLASSES = ("exact", "transformed_duplicate", "semantic_candidate")
KINDS = ("exact", "near", "semantic")
#: Absolute paths, Windows then POSIX, and what stands in their place.
PRIVATE = (
    (r"(?<![A-Za-z0-9])[A-Za-z]:[\\/][^\s\"'<>|]*", "[private path]"),
    (r"(^|[\s\"'(=])/[^\s/\"'<>|]+/[^\s\"'<>|]*", "$1[private path]"),
)
BOUNDARIES = (("train", "val"), ("train", "test"), ("val", "test"))


def _framed(text: Column) -> Column:
    """Hex of the byte length (8 bytes, big endian) and the UTF-8 bytes of ``text``."""
    return F.concat(F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0"), F.hex(F.encode(text, "UTF-8")))


def _digest(namespace: str, body: Column) -> Column:
    whole = F.sha2(F.unhex(F.concat(_framed(F.lit(namespace)), body)), 256)
    return F.concat(F.lit(f"{namespace}_"), F.left(whole, F.lit(24)))


def stable_id(namespace: str, *parts: Column) -> Column:
    """``namespace_`` and 24 hex digits of SHA-256 over the length-framed parts."""
    return _digest(namespace, F.concat(*[_framed(p) for p in parts]))


def family_id(members: Column) -> Column:
    """Id of a set of record ids (array), independent of their order."""
    ordered = F.array_sort(F.array_distinct(members))
    return _digest("family", F.array_join(F.transform(ordered, _framed), ""))


def rank_of(value: Column, names: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n in names]), value) - 1


def sorted_by_rank(values: Column, names: tuple[str, ...]) -> Column:
    """The members of ``names`` that the array ``values`` holds, in rank order."""
    return F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.array_contains(values, n))


def boundaries(splits: Column) -> Column:
    """``train-val``-like names of the protected boundaries that a set of splits crosses."""
    every = F.array(*[F.struct(F.lit(a).alias("l"), F.lit(b).alias("r")) for a, b in BOUNDARIES])
    crossed = F.filter(every, lambda b: F.array_contains(splits, b["l"]) & F.array_contains(splits, b["r"]))
    return F.transform(crossed, lambda b: F.concat_ws("-", b["l"], b["r"]))


def split_by_number(number: Column) -> Column:
    """8 of 10 to train, one each to val and test."""
    tenth = F.pmod(number, F.lit(10))
    return F.when(tenth < 8, "train").when(tenth == 8, "val").otherwise("test")


def pack_bits(values: Column) -> Column:
    """64 coefficients to a fingerprint, most significant bit first: a bit is set where a
    coefficient other than the first exceeds the median of all but the first."""
    powers = F.array(*[F.lit(1 << (63 - k) if k else 0).cast("long") for k in range(64)])

    def packed(bound):  # the median and the powers are bound once, outside the loop over bits
        chosen = F.zip_with(values, bound["powers"], lambda v, p: F.when(v > bound["middle"], p).otherwise(F.lit(0).cast("long")))
        return F.aggregate(chosen, F.lit(0).cast("long"), lambda a, x: a + x)

    middle = F.element_at(F.array_sort(F.slice(values, 2, 63)), 32)
    return F.get(F.transform(F.array(F.struct(middle.alias("middle"), powers.alias("powers"))), packed), F.lit(0))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
