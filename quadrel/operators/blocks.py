"""Inverse transform and reconstruction of 8x8 blocks.

Two forms with equal results: array expressions inside the JVM, and a batch
kernel on numpy that takes many blocks at a time through Arrow.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import clamp8, long, mul16, shr, wrap16
from ..functions.tables import IDCT
from ..session import map_arrow

C1, C2, C3, C4, C5, C6, C7 = IDCT


def _products(s, mul, wrap, bias):
    """Products of the first stage of a one-dimensional pass over eight values."""
    return {
        "even_a": mul(C4, wrap(s[0] + s[4])) + bias,
        "even_b": mul(C4, wrap(s[0] - s[4])) + bias,
        "even_c": mul(C2, s[2]) + mul(C6, s[6]),
        "even_d": mul(C6, s[2]) - mul(C2, s[6]),
        "odd_a": mul(C1, s[1]) + mul(C7, s[7]),
        "odd_b": mul(C7, s[1]) - mul(C1, s[7]),
        "odd_c": mul(C3, s[3]) + mul(C5, s[5]),
        "odd_d": mul(C3, s[5]) - mul(C5, s[3]),
    }


def _turned(p, mul):
    """The second stage: odd parts turned and put beside the even ones."""
    turn_a, turn_b = mul(C4, p["odd_a"] - p["odd_c"]), mul(C4, p["odd_b"] - p["odd_d"])
    return {
        "top": p["even_a"] + p["even_c"],
        "base": p["even_a"] - p["even_c"],
        "outer": p["odd_a"] + p["odd_c"],
        "inner": p["odd_b"] + p["odd_d"],
        "left": p["even_b"] + turn_a,
        "right": p["even_b"] - turn_a,
        "up": turn_b + p["even_d"],
        "down": turn_b - p["even_d"],
    }


def _outputs(t):
    return [
        t["top"] + t["outer"],
        t["left"] + t["up"],
        t["left"] - t["up"],
        t["base"] + t["inner"],
        t["base"] - t["inner"],
        t["right"] + t["down"],
        t["right"] - t["down"],
        t["top"] - t["outer"],
    ]


def _struct(parts: dict) -> Column:
    return F.struct(*[c.alias(n) for n, c in parts.items()])


def _pass(value, wrap, bias: int) -> Column:
    """One pass over eight lines at once: an array of eight arrays; ``value(line, k)`` gives the inputs.

    Each stage is a transform of its own, so nothing is computed twice.
    """
    lines = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda i: _struct(_products([value(i, k) for k in range(8)], mul16, wrap, F.lit(bias).cast("long"))),
    )
    return F.transform(F.transform(lines, lambda p: _struct(_turned(p, mul16))), lambda t: F.array(*_outputs(t)))


def is_whole(coeffs: Column) -> Column:
    """Whether a block has 64 coefficients and none is null."""
    return F.coalesce((F.size(coeffs) == 64) & F.forall(coeffs, lambda x: x.isNotNull()), F.lit(False))


def idct(coeffs: Column) -> Column:
    """Inverse transform of 64 coefficients in an array, rows first; null for a block that is not whole."""
    rows = _pass(lambda r, k: long(F.get(coeffs, r * 8 + k)), wrap16, 0)
    # One-element transforms bind an array once for all that reads it.
    columns = F.transform(F.array(F.flatten(rows)), lambda t: _pass(lambda c, k: F.get(t, c + 8 * k), lambda x: x, 8))
    flat = F.transform(columns, lambda c: F.flatten(c))
    out = F.transform(
        flat, lambda v: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: wrap16(shr(F.get(v, i % 8 * 8 + F.floor(i / 8).cast("int")), 4)))
    )
    return F.when(is_whole(coeffs), F.get(out, F.lit(0)))


def idct_dc(dc: Column) -> Column:
    """The value that fills a block whose only coefficient is ``dc``."""
    return wrap16(shr(mul16(C4, mul16(C4, dc)) + 8, 4))


def unquantised(coeffs: Column, factors: Column) -> Column:
    """All but the first coefficient times its factor, wrapping to 16 bits."""
    return F.transform(coeffs, lambda x, i: F.when(i == 0, long(x)).otherwise(wrap16(long(x) * F.get(factors, i))))


def put_block(residual: Column) -> Column:
    """Samples of an intra block."""
    return F.transform(residual, lambda x: clamp8(wrap16(x + 128)))


def add_block(residual: Column, predicted: Column) -> Column:
    """Samples of an inter block: residual on top of the prediction."""
    return F.zip_with(residual, predicted, lambda r, p: clamp8(wrap16(r + p)))


def line_of(block_y: Column, row: Column, interlaced: bool) -> Column:
    """The plane's line of a block's row; interlaced pairs of blocks take every other line."""
    if not interlaced:
        return long(block_y) * 8 + row
    return shr(block_y, 1) * 16 + long(block_y).bitwiseAND(1) + row * 2


def idct_planes(coeffs: np.ndarray) -> np.ndarray:
    """Inverse transform of (64, n) coefficients, one row for each place, as 16-bit values.

    Sums stay far below 32 bits, and products wrap to them.
    """
    mul = lambda a, b: b * np.int32(a) >> 16
    wrap = lambda x: x.astype(np.int16).astype(np.int32)
    s = coeffs.astype(np.int16).astype(np.int32).reshape(8, 8, -1)
    rows = np.stack(_outputs(_turned(_products([s[:, k] for k in range(8)], mul, wrap, 0), mul)), axis=1)
    out = np.stack(_outputs(_turned(_products([rows[k] for k in range(8)], mul, lambda x: x, 8), mul)))
    return (out >> 4).astype(np.int16).reshape(64, -1)


def idct_numpy(coeffs: np.ndarray) -> np.ndarray:
    """Inverse transform of (n, 64) coefficients, as 16-bit values."""
    mul = lambda a, b: (a * b).astype(np.int32).astype(np.int64) >> 16
    wrap = lambda x: x.astype(np.int16).astype(np.int64)
    s = coeffs.astype(np.int64).reshape(-1, 8, 8)
    rows = np.stack(_outputs(_turned(_products([s[:, :, k] for k in range(8)], mul, wrap, 0), mul)), axis=2)
    out = np.stack(_outputs(_turned(_products([rows[:, k, :] for k in range(8)], mul, lambda x: x, 8), mul)), axis=1) >> 4
    return out.astype(np.int16).reshape(-1, 64)


def idct_batch(blocks: DataFrame) -> DataFrame:
    """(block_id, out): inverse transform of ``coeffs``, whole Arrow batches at a time; null for a block that is not whole."""

    def run(batches):
        for batch in batches:
            whole = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            out = idct_numpy(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, 64)).astype(np.int64).reshape(-1)
            ends = np.concatenate(([0], 64 * whole.cumsum())).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(out), mask=pa.array(~whole))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["block_id", "out"])

    return map_arrow(blocks.select("block_id", F.when(is_whole(F.col("coeffs")), F.col("coeffs"))), run, "block_id long, out array<long>")
