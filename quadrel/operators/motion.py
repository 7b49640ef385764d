"""Motion vectors, prediction from neighbours, interpolation and edges."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import bilinear, four_tap, long, shr, trunc_div, wrap16
from ..functions.tables import NEIGHBOURS
from ..session import map_arrow, ship
from .blocks import is_whole


def vector_parts(mv: Column, luma: bool) -> dict[str, Column]:
    """Whole samples, eighths, and the truncated value that the edge filter looks at."""
    bits = 2 if luma else 3
    part = long(mv).bitwiseAND((1 << bits) - 1)
    return {"whole": shr(mv, bits), "eighths": part * 2 if luma else part, "edge": trunc_div(mv, 1 << bits)}


def four_vector_chroma(xs: list) -> Column:
    """Chroma component of a macroblock with four vectors: their sum, divided by 4 towards zero."""
    return trunc_div(wrap16(sum((long(x) for x in xs[1:]), long(xs[0]))), 4)


def clamped(place: Column, size: Column) -> Column:
    """A place inside 0..size, as if the border samples went on for ever."""
    return F.greatest(F.least(long(place), long(size) - 1), F.lit(0).cast("long"))


def sample(pixels: Column, x: Column, y: Column, width: int = 8, height: int = 8) -> Column:
    """A sample of a plane in an array, with replicated borders."""
    return F.get(pixels, (clamped(y, F.lit(height)) * width + clamped(x, F.lit(width))).cast("int"))


def edge_block(pixels: Column, x: int, y: int, size: int = 12, width: int = 8, height: int = 8) -> Column:
    """A block of ``size`` by ``size`` samples at (x, y), which may lie outside the plane."""
    places = F.sequence(F.lit(0), F.lit(size * size - 1))
    return F.transform(places, lambda i: sample(pixels, i % size + x, F.floor(i / size) + y, width, height))


def interpolate(pixels: Column, mx: int, my: int, taps: tuple | None = None) -> Column:
    """An 8x8 block at (mx, my) eighths, bilinear, or by four taps given for (x, y).

    The four-tap form filters one axis alone if the other one's taps are a
    plain copy (128 in the second place).
    """
    places = F.sequence(F.lit(0), F.lit(63))
    at = lambda i, dx, dy: sample(pixels, i % 8 + dx, F.floor(i / 8) + dy)
    if taps is None:
        def horizontal(i, dy):
            return bilinear(at(i, 0, dy), at(i, 1, dy), F.lit(mx)) if mx else long(at(i, 0, dy))

        if my == 0:
            return F.transform(places, lambda i: bilinear(at(i, 0, 0), at(i, 1, 0), F.lit(mx)))
        return F.transform(places, lambda i: bilinear(horizontal(i, 0), horizontal(i, 1), F.lit(my)))
    tx, ty = taps
    along = lambda i, dy: four_tap([at(i, d, dy) for d in (-1, 0, 1, 2)], tx)
    if ty[1] == 128:
        return F.transform(places, lambda i: along(i, 0))
    if tx[1] == 128:
        return F.transform(places, lambda i: four_tap([at(i, 0, d) for d in (-1, 0, 1, 2)], ty))
    return F.transform(places, lambda i: four_tap([along(i, d) for d in (-1, 0, 1, 2)], ty))


def interpolate_batch(blocks: DataFrame, mx: int, my: int, taps: tuple | None = None) -> DataFrame:
    """(block_id, out): as ``interpolate`` on the ``pixels`` of whole Arrow batches; null for a block that is not whole."""

    def along(rows, weights):
        return np.clip(sum(r * w for r, w in zip(rows, weights)) + 64 >> 7, 0, 255)

    def computed(area):
        # Areas have a border of one sample before and two behind the block.
        if taps is None:
            wide = (area[:, :, 1:9] * (8 - mx) + area[:, :, 2:10] * mx + 4) >> 3 if mx else area[:, :, 1:9]
            return (wide[:, 1:9] * (8 - my) + wide[:, 2:10] * my + 4) >> 3 if my else wide[:, 1:9]
        tx, ty = taps
        wide = area[:, :, 1:9] if tx[1] == 128 and ty[1] != 128 else along([area[:, :, k : k + 8] for k in range(4)], tx)
        return wide[:, 1:9] if ty[1] == 128 else along([wide[:, k : k + 8] for k in range(4)], ty)

    def run(batches):
        for batch in batches:
            whole = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, 8, 8)
            out = computed(np.pad(flat, ((0, 0), (1, 2), (1, 2)), "edge")).astype(np.int64).reshape(-1)
            ends = np.concatenate(([0], 64 * whole.cumsum())).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(out), mask=pa.array(~whole))], names=["block_id", "out"])

    pixels = F.col("pixels").cast("array<bigint>")
    return map_arrow(blocks.select("block_id", F.when(is_whole(pixels), pixels)), run, "block_id long, out array<long>")


VECTORS = "pkt_no long, mb_x long, mb_y long, n_found long, nearest_x long, nearest_y long, near_x long, near_y long, pred_x long, pred_y long"


def _picture_vectors(rows: pd.DataFrame) -> pd.DataFrame:
    """``neighbour_vectors`` of one picture: twelve look-ups in its sorted places."""
    whole = rows.notna().all(axis=1).to_numpy()
    x, y, ref, mx, my = (rows[c].to_numpy(np.float64, na_value=0).astype(np.int64) for c in ("mb_x", "mb_y", "ref_id", "mv_x", "mv_y"))
    moved = np.flatnonzero(whole & ((mx != 0) | (my != 0)))
    # No picture is so wide that a place beside it is one of the next line.
    place = (y << 32) + x
    moved = moved[np.argsort(place[moved], kind="stable")]
    n, zero = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    out = {c: zero.copy() for c in ("nearest_x", "nearest_y", "near_x", "near_y", "pred_x", "pred_y")}
    for k, (dy, dx) in enumerate(NEIGHBOURS):
        if not len(moved):
            break
        wanted = place + (dy << 32) + dx
        at = moved[np.minimum(np.searchsorted(place[moved], wanted), len(moved) - 1)]
        hit = whole & (place[at] == wanted) & (ref[at] == ref)
        first = hit & (n == 0)
        second = hit & (n == 1) & ((mx[at] != out["nearest_x"]) | (my[at] != out["nearest_y"]))
        for names, rows_of in ((("nearest",) + (("pred",) if k < 2 else ()), first), (("near",), second)):
            for name in names:
                out[f"{name}_x"][rows_of], out[f"{name}_y"][rows_of] = mx[at][rows_of], my[at][rows_of]
        n += first.astype(np.int64) + second
    return pd.DataFrame({"pkt_no": rows["pkt_no"], "mb_x": rows["mb_x"], "mb_y": rows["mb_y"], "n_found": n, **out})


def neighbour_vectors(grid: DataFrame) -> DataFrame:
    """Nearest and near vector of every macroblock, from its neighbours with the same reference.

    Neighbours are looked at in a fixed order; the first vector that is not
    zero is the nearest one, the first later one that differs is the near
    one, and the nearest one also predicts if it is among the first two
    places. Each picture is gathered once, which holds at most 255 by 255
    macroblocks, one at each place. A row with a null has no neighbours and
    is none.
    """
    ship(grid.sparkSession)
    rows = grid.select("pkt_no", *[F.col(c).cast("long") for c in ("mb_x", "mb_y", "ref_id", "mv_x", "mv_y")])
    return rows.groupBy(F.col("pkt_no").cast("long").alias("pkt_no")).applyInPandas(_picture_vectors, VECTORS)
