"""Partition and table hashes as columns; all run inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def next_pow2(n: int) -> int:
    """The least power of two that is n or more (1 for n below 1)."""
    return 1 << max(n - 1, 0).bit_length()


def log2_of(n: int) -> int:
    return next_pow2(n).bit_length() - 1


def next_pow2_col(c: Column) -> Column:
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(c, F.lit(1))))).cast("long")


def _key(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def modulo(c: Column | str, buckets: int, low: int = 0, skip: int = 0) -> Column:
    """((v - low) & mask) >> skip, for a power of two of buckets."""
    mask = (next_pow2(buckets) - 1) << skip
    return F.shiftright((_key(c) - F.lit(low)).bitwiseAND(F.lit(mask).cast("long")), skip)


def modulo_passes(c: Column | str, buckets: int, passes: int, low: int = 0) -> list[Column]:
    """One hash for each pass, the bits shared out from the highest; the first passes take what is left over."""
    bits = log2_of(buckets)
    share = [bits // passes + (i < bits % passes) for i in range(passes)]
    out, left = [], bits
    for own in share:
        left -= own
        out.append(modulo(c, 1 << own, low, left))
    return out


def in_range(c: Column | str, buckets: int, low: int, high: int) -> Column:
    """Equal ranges of [low, high]: ((v - low) * buckets) / (high - low + 1)."""
    return F.floor(F.shiftleft(_key(c) - F.lit(low), log2_of(buckets)) / F.lit(high - low + 1)).cast("long")


def magic(c: Column | str, buckets: int) -> Column:
    """Closes the gaps of keys of which only the first eight of every 32 are in use."""
    v = _key(c)
    return F.shiftright(v, 2).bitwiseAND(F.lit(~7).cast("long")).bitwiseOR(v.bitwiseAND(F.lit(7).cast("long"))).bitwiseAND(F.lit(next_pow2(buckets) - 1).cast("long"))


def radix(c: Column | str, bits: int, shift: int = 0) -> Column:
    """Bits shift to shift + bits - 1 of the key."""
    return F.shiftright(_key(c).bitwiseAND(F.lit(((1 << bits) - 1) << shift).cast("long")), shift)


def radix_from_one(c: Column | str, bits: int, shift: int = 0) -> Column:
    """radix of key - 1, for keys that begin at 1; key 0 falls into the last partition."""
    return radix(_key(c) - F.lit(1), bits, shift)
