"""Document fingerprints: one-permutation MinHash with optimal densification, low-order bits packed.

All in Spark's built-in functions. Every five-word shingle is hashed once; the top byte of the hash is its
bin, and a bin keeps its smallest hash. To find the minima of all bins in one sort, one upper
bound per bin is added to the hashes: after sorting, the first value of each bin is its minimum,
or the bound if the bin is empty. An empty bin takes the value of the first occupied bin in its
own random order of all bins: ``PROBES`` drawn bins, then the rest by the hash of (empty bin, bin). The order
is the same for all texts, so two texts choose alike. Of each minimum the low-order bits are kept, packed into 64-bit words;
comparing two fingerprints is an exclusive or and a bit count per word, and the share of equal
lanes is corrected for lanes that are equal by chance.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS, BIN_BITS = 256, 8
WORDS = 5
#: Low-order bits kept of each minimum: 1, 2, 4 or 8.
LANE_BITS = 8
PROBES = 64
_LOW = 64 - BIN_BITS


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _sql_array(values: list[int], suffix: str) -> str:
    return "array(" + ",".join(f"{v}{suffix}" if v != -(1 << 63) else "-9223372036854775807L - 1L" for v in values) + ")"


#: The largest hash of each bin, in the order a signed sort puts the bins.
_BOUNDS = sorted(_signed((b << _LOW) | ((1 << _LOW) - 1)) for b in range(BINS))


def _probe(t: int, position: int) -> int:
    return hashlib.blake2b(f"{t}:{position}".encode(), digest_size=2).digest()[0]




def fingerprint(docs: DataFrame, text: str, out: str, lane_bits: int = LANE_BITS) -> DataFrame:
    """All columns of ``docs`` plus ``out``: array of BINS * lane_bits / 64 words (bigint).

    Words are split at blanks and line ends after lowering; a text of fewer than five words is one
    shingle; a text without words, or null, has an empty array. Equal texts have equal
    fingerprints. Whole texts are read, every row by itself. An input column called ``out`` is replaced.
    """
    tmp = [f"__{out}_{x}" for x in ("words", "hashes", "sorted", "dense", "full", "codes")]
    words, hashes, ordered, dense, full, codes = tmp
    empty = f"(v & {(1 << _LOW) - 1}L) = {(1 << _LOW) - 1}L"
    low = (1 << lane_bits) - 1
    per_word = 64 // lane_bits

    def probed(t: str, p: str) -> str:
        at = f"{dense}[{t}[{p}]]"
        return f"(case when ({at} & {(1 << _LOW) - 1}L) != {(1 << _LOW) - 1}L then {at} end)"

    first = [_sql_array([_probe(t, p) for p in range(BINS)], "") for t in range(4)]
    later = "array(" + ",".join(_sql_array([_probe(t, p) for p in range(BINS)], "") for t in range(4, PROBES)) + ")"
    choice = ", ".join(probed(x, "p") for x in first)
    docs = docs.drop(out)
    docs = docs.withColumn(words, F.expr(
        rf"transform(filter(split(lower(coalesce({text}, '')), '[\\x20\\x09-\\x0D]+'), w -> w != ''), w -> xxhash64(w))"))
    docs = docs.withColumn(hashes, F.expr(
        f"case when size({words}) = 0 then cast(array() as array<bigint>)"
        f" when size({words}) < {WORDS} then array(xxhash64({words}))"
        f" else transform(sequence(0, size({words}) - {WORDS}), i -> xxhash64("
        + ", ".join(f"{words}[i + {j}]" if j else f"{words}[i]" for j in range(WORDS)) + ")) end"))
    docs = docs.withColumn(ordered, F.expr(f"sort_array(concat({hashes}, {_sql_array(_BOUNDS, 'L')}))"))
    docs = docs.withColumn(dense, F.expr(
        f"filter({ordered}, (v, i) -> i = 0 or shiftrightunsigned(v, {_LOW}) != shiftrightunsigned({ordered}[i - 1], {_LOW}))"))
    docs = docs.withColumn(full, F.expr(f"filter({dense}, v -> not ({empty}))"))
    # four probes directly, the rest in a loop, at last the occupied bin with the smallest hash for this bin
    last = f"array_min(transform({full}, f -> struct(xxhash64(p, shiftrightunsigned(f, {_LOW})) as h, f as v))).v"
    docs = docs.withColumn(codes, F.expr(
        f"case when size({full}) = 0 then cast(array() as array<bigint>) else transform({dense}, (v, p) -> cast((case when not ({empty}) then v else coalesce({choice},"
        f" aggregate({later}, cast(null as bigint), (got, t) -> coalesce(got, {probed('t', 'p')})),"
        f" {last}) end) & {low}L as bigint)) end"))
    lanes = " | ".join(f"shiftleft({codes}[{per_word} * i + {j}], {lane_bits * j})" for j in range(per_word))
    docs = docs.withColumn(out, F.expr(
        f"case when size({full}) = 0 then cast(array() as array<bigint>)"
        f" else transform(sequence(0, {BINS // per_word - 1}), i -> {lanes}) end"))
    return docs.drop(*tmp)


def as_text(words: str) -> Column:
    """A fingerprint as lower-case hexadecimal digits; '' for the empty one."""
    return F.expr(f"array_join(transform({words}, x -> lower(lpad(hex(x), 16, '0'))), '')")


def likeness(left: str, right: str, lane_bits: int = LANE_BITS) -> Column:
    """Estimated Jaccard similarity of the shingle sets, 0 to 1: bias-corrected share of equal lanes.

    Two empty fingerprints are alike (1), an empty one and another are not (0).
    """
    mask = _signed(sum(1 << i for i in range(0, 64, lane_bits)))
    step = lane_bits // 2
    differ = "(l ^ r)"
    while step:
        differ = f"({differ} | shiftrightunsigned({differ}, {step}))"
        step //= 2
    chance = 2.0 ** -lane_bits
    equal = f"({BINS} - aggregate(zip_with({left}, {right}, (l, r) -> bit_count({differ} & {mask}L)), 0, (a, x) -> a + x))"
    return F.expr(
        f"case when size({left}) = 0 and size({right}) = 0 then 1.0D when size({left}) = 0 or size({right}) = 0 then 0.0D"
        f" else greatest(0.0D, ({equal} / {float(BINS)}D - {chance}D) / {1 - chance}D) end")
