"""Reading bits of BINARY columns at fixed places, and reversing them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import long

#: Order in which a reader takes the bytes of a 32-bit word, by mode.
ORDERS = {"be": (0, 1, 2, 3), "le16msb": (1, 0, 3, 2), "le32msb": (3, 2, 1, 0)}


def byte_at(data: Column, index: int) -> Column:
    """Byte ``index`` of a binary column as LONG, 0 past its end."""
    return F.coalesce(F.conv(F.hex(F.substring(data, index + 1, 1)), 16, 10).cast("long"), F.lit(0).cast("long"))


def left(data: Column, at: int) -> Column:
    """Bits after place ``at``; negative past the end."""
    return F.octet_length(data).cast("long") * 8 - at


def _word(data: Column, at: int, n: int, mode: str) -> tuple[Column, int]:
    """A number holding the bytes that bits at..at+n touch, and how many bits follow the wanted ones."""
    first, last = at // 8, (at + n - 1) // 8
    value = F.lit(0).cast("long")
    for k in range(first, last + 1):
        source = k if mode == "be" else k // 4 * 4 + ORDERS[mode][k % 4]
        value = value * 256 + byte_at(data, source)
    return value, (last + 1) * 8 - at - n


def read_bits(data: Column, at: int, n: int, mode: str = "be") -> Column:
    """``n`` bits (0 to 32) at bit ``at``; null if they reach past the end.

    Mode "le" numbers bits from the lowest bit of each byte upwards; the
    other modes take the highest first, after putting the bytes of each
    16- or 32-bit group in order.
    """
    if n == 0:
        return F.lit(0).cast("long")
    if n > 32:
        return F.lit(None).cast("long")
    if mode == "le":
        first, last = at // 8, (at + n - 1) // 8
        value = F.lit(0).cast("long")
        for k in range(last, first - 1, -1):
            value = value * 256 + byte_at(data, k)
        value = F.shiftright(value, at - first * 8)
    else:
        value, rest = _word(data, at, n, mode)
        value = F.shiftright(value, rest)
    return F.when(left(data, at + n) >= 0, value.bitwiseAND((1 << n) - 1))


def read_signed(data: Column, at: int, n: int, mode: str = "be") -> Column:
    """As ``read_bits`` with the first bit as the sign; reading 0 bits is an error (null)."""
    if n == 0:
        return F.lit(None).cast("long")
    half = 1 << (n - 1)
    return read_bits(data, at, n, mode).bitwiseXOR(half) - half


def peek_at(data: Column, at: Column, n: int, low_first: bool = False) -> Column:
    """The next ``n`` (1 to 32) bits at a place that is a column, with zeros past the end; other ``n`` give 0."""
    if not 0 < n <= 32:
        return F.lit(0).cast("long")
    first, inside = F.shiftright(long(at), 3), long(at).bitwiseAND(7).cast("int")
    # At most five bytes hold the bits.
    text = F.rpad(F.hex(F.substr(data, (first + 1).cast("int"), F.lit(5))), 10, "0")
    if low_first:
        text = F.concat(*[F.substring(text, 2 * k + 1, 2) for k in range(4, -1, -1)])
    value = F.conv(text, 16, 10).cast("long")
    move = inside if low_first else F.lit(40 - n) - inside
    return F.call_function("shiftright", value, move).bitwiseAND((1 << n) - 1)


def skipped(data: Column, at: Column, n: Column) -> Column:
    """The place after skipping ``n`` bits; past the end only a border of 32 bits is reached, else null."""
    to = long(at) + long(n)
    return F.when((to <= F.octet_length(data).cast("long") * 8) | (to % 32 == 0), to)


def sought(data: Column, at: Column) -> Column:
    """The place itself, null if its byte lies past the end."""
    return F.when(F.floor((long(at) + 7) / 8) <= F.octet_length(data), long(at))


def aligned(at: Column) -> Column:
    """The next place at a byte border."""
    return F.floor((long(at) + 7) / 8).cast("long") * 8


def align(at: int) -> int:
    """The next place at a byte border."""
    return -(-at // 8) * 8


def reverse_bits(value: Column, n: int) -> Column:
    """The low ``n`` bits in reverse order; 0 for none."""
    if n == 0:
        return F.lit(0).cast("long")
    low = long(value).bitwiseAND((1 << n) - 1)
    return F.conv(F.reverse(F.lpad(F.bin(low), n, "0")), 2, 10).cast("long")
