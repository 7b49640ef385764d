"""Fixed-point arithmetic as column expressions.

Values are computed in BIGINT and narrowed at the end, because ANSI mode
raises on overflow where the codec wraps around. ``>>`` floors and ``div``
truncates; both occur on the same values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def long(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("long")


def wrap16(x: Column) -> Column:
    """Two's complement wrap to 16 bits."""
    return ((long(x) + 32768).bitwiseAND(65535)) - 32768


def wrap8u(x: Column) -> Column:
    return long(x).bitwiseAND(255)


def wrap32(x: Column) -> Column:
    return (long(x) + 2**31).bitwiseAND(2**32 - 1) - 2**31


def clamp8(x: Column) -> Column:
    """Clamp to a sample, 0 to 255."""
    return F.greatest(F.least(long(x), F.lit(255).cast("long")), F.lit(0).cast("long"))


def trunc_div(x: Column, by: int) -> Column:
    """Division that truncates towards zero."""
    q = F.floor(F.abs(long(x)) / by).cast("long")
    return F.when(long(x) < 0, -q).otherwise(q)


def shr(x: Column, n: int) -> Column:
    return F.shiftright(long(x), n)


def mul16(a, b) -> Column:
    """High part of a 32-bit product, which wraps: (a * b) >> 16."""
    return shr(wrap32(long(a) * long(b)), 16)


def rescale_prob(prob: Column, weight: Column, bias: Column, most: int = 255) -> Column:
    """A probability scaled by weight / 256 with a bias, kept in 1..most."""
    scaled = shr(long(prob) * long(weight) + 128, 8) + long(bias)
    return F.greatest(F.least(scaled, F.lit(most).cast("long")), F.lit(1).cast("long"))


def prob_weight(a: Column, b: Column) -> Column:
    """Weight of a branch of two probabilities; never 0."""
    return F.greatest(shr(long(a) * long(b), 8), F.lit(1).cast("long"))


def mode_share(part: Column, total: Column) -> Column:
    """Share of a mode in 255ths, as an 8-bit value."""
    return wrap8u(F.floor(long(part) * 255 / (long(total) + 1)).cast("long"))


def median3(a: Column, b: Column, c: Column) -> Column:
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))


def deblock_pair(a: Column, b: Column, c: Column, d: Column, limit: Column) -> tuple[Column, Column]:
    """The two samples next to an edge after the dead-zone filter: (b', c')."""
    a, b, c, d, limit = (long(x) for x in (a, b, c, d, limit))
    raw = shr((a - d) + (c - b) * 3 + 4, 3)
    size = F.abs(raw)
    folded = F.when(raw < 0, -raw - limit * 2).otherwise(limit * 2 - raw)
    step = F.when(size >= limit * 2, F.lit(0).cast("long")).when(size >= limit, folded).otherwise(raw)
    return clamp8(b + step), clamp8(c - step)


def bilinear(a: Column, b: Column, part: Column) -> Column:
    """Sample ``part`` eighths of the way from a to b."""
    return shr(long(a) * (8 - long(part)) + long(b) * long(part) + 4, 3)


def four_tap(samples: list, taps: list) -> Column:
    """Four-tap filter with taps that sum to 128."""
    total = sum((long(s) * long(t) for s, t in zip(samples, taps)), F.lit(64).cast("long"))
    return clamp8(shr(total, 7))


def variance16(total: Column, squares: Column) -> Column:
    """Spread of 16 samples from their sum and sum of squares, as an unsigned 16-bit value."""
    return shr(long(squares) * 16 - long(total) * long(total), 8).bitwiseAND(65535)
