"""Motion queries: vectors, neighbours, borders and interpolation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fixed import long, median3
from ..functions.tables import NEIGHBOURS
from ..operators import motion as M
from ..sources import carriers

#: Taps of one sharpness level, for the queries (fixed values).
TAPS_X, TAPS_Y, COPY = (-6, 92, 47, -5), (-4, 68, 68, -4), (0, 128, 0, 0)


def mv_median(spark, sf_dir):
    """Median of a vector, its turned copy and a shifted one, component by component; and sums and differences."""
    x, y = long(F.col("x")), long(F.col("y"))
    return carriers.vectors(spark, sf_dir).select(
        "l_orderkey",
        "l_linenumber",
        "x",
        "y",
        median3(x, y, x - y).alias("median_x"),
        median3(y, -x, y + 3).alias("median_y"),
        (x + y).alias("added"),
        (x - y).alias("taken"),
        (-x).alias("turned"),
    )


def mv_split(spark, sf_dir):
    cols = [v.alias(f"{c}_{n}_{k}") for c in "xy" for k, luma in (("luma", True), ("chroma", False)) for n, v in M.vector_parts(F.col(c), luma).items()]
    chroma = M.four_vector_chroma([F.col("x"), F.col("y"), F.col("x") * 3, F.lit(-5)])
    return carriers.vectors(spark, sf_dir).select("l_orderkey", "l_linenumber", "x", "y", *cols, chroma.alias("four"))


def mv_candidates(spark, sf_dir):
    return M.neighbour_vectors(carriers.mb_grid(spark, sf_dir))


def edge_emulation(spark, sf_dir):
    found = carriers.samples(spark, sf_dir).select("block_id", M.edge_block(F.col("pixels"), -3, 5).alias("out"))
    return found.select("block_id", F.posexplode("out").alias("place", "value")).select("block_id", long(F.col("place")).alias("place"), long(F.col("value")).alias("value"))


def _interpolated(mx, my, taps=None):
    def query(spark, sf_dir):
        found = M.interpolate_batch(carriers.samples(spark, sf_dir), mx, my, taps)
        return found.select("block_id", F.posexplode("out").alias("place", "value")).select("block_id", long(F.col("place")).alias("place"), "value")

    return query


QUERIES = {
    "mv_median": mv_median,
    "mv_split": mv_split,
    "mv_candidates": mv_candidates,
    "edge_emulation": edge_emulation,
    "mc_bilinear_h": _interpolated(3, 0),
    "mc_bilinear_v": _interpolated(0, 5),
    "mc_bilinear_hv": _interpolated(3, 5),
    "mc_bicubic_h": _interpolated(3, 0, (TAPS_X, COPY)),
    "mc_bicubic_v": _interpolated(0, 4, (COPY, TAPS_Y)),
    "mc_bicubic_hv": _interpolated(3, 4, (TAPS_X, TAPS_Y)),
}

_MV = "with v as (select l_orderkey, l_linenumber, l_partkey % 129 - 64 as x, l_suppkey % 129 - 64 as y from lineitem) "
_PX = """with px as (select vec_id as block_id, place, place % 8 as x, place // 8 as y, least(greatest(floor(embedding[place + 1]::double * 128)::bigint + 128, 0), 255) as p
  from (select *, unnest(range(64)) as place from embeddings)) """


def _parts(c: str) -> str:
    return ", ".join(
        [f"{c} >> {b} as {c}_whole_{k}, ({c} & {2**b - 1}) * {m} as {c}_eighths_{k}, {c} // {2**b} as {c}_edge_{k}" for k, b, m in (("luma", 2, 2), ("chroma", 3, 1))]
    )


def _sampled(steps: dict) -> str:
    """Samples at the given steps (dx, dy) beside each place, with replicated borders, looked up in one list per block."""
    at = lambda c, d: f"greatest(least({c} + ({d}), 7), 0)"
    found = (f"ps[{at('y', dy)} * 8 + {at('x', dx)} + 1] as {n}" for n, (dx, dy) in steps.items())
    return f"""from (select block_id, place, {', '.join(found)} from
  (select block_id, ps, place, place % 8 as x, place // 8 as y from (select block_id, list(p order by place) as ps from px group by block_id), range(64) as r(place)))"""


def _bilinear(a: str, b: str, part: int) -> str:
    return f"(({a}) * {8 - part} + ({b}) * {part} + 4) >> 3"


def _taps(xs: list, taps: tuple) -> str:
    return f"least(greatest((({' + '.join(f'({x}) * ({t})' for x, t in zip(xs, taps))}) + 64) >> 7, 0), 255)"


_ROW = {f"s{i}": (d, 0) for i, d in enumerate((-1, 0, 1, 2))}
_COLUMN = {f"s{i}": (0, d) for i, d in enumerate((-1, 0, 1, 2))}
_SQUARE = {f"s{i}{j}": (dx, dy) for j, dy in enumerate((-1, 0, 1, 2)) for i, dx in enumerate((-1, 0, 1, 2))}
_PLACES = ", ".join(f"({i}, {y}, {x})" for i, (y, x) in enumerate(NEIGHBOURS))

ORACLES = {
    "mv_median": _MV
    + """select l_orderkey, l_linenumber, x, y, list_sort([x, y, x - y])[2] as median_x, list_sort([y, -x, y + 3])[2] as median_y,
  x + y as added, x - y as taken, -x as turned from v""",
    "mv_split": _MV + f"select l_orderkey, l_linenumber, x, y, {_parts('x')}, {_parts('y')}, (x + y + x * 3 - 5) // 4 as four from v",
    "mv_candidates": f"""
with g as (select event_id // 100 as pkt_no, event_id % 100 // 10 as mb_y, event_id % 10 as mb_x, user_id % 3 as ref_id, user_id % 5 - 2 as mv_x, user_id % 7 - 3 as mv_y from events),
o(place, dy, dx) as (values {_PLACES}),
f as (select g.pkt_no, g.mb_x, g.mb_y, o.place, n.mv_x, n.mv_y from g cross join o join g as n on n.pkt_no = g.pkt_no and n.mb_x = g.mb_x + o.dx and n.mb_y = g.mb_y + o.dy
  and n.ref_id = g.ref_id and (n.mv_x <> 0 or n.mv_y <> 0)),
a as (select pkt_no, mb_x, mb_y, min(place) as place, arg_min(mv_x, place) as x, arg_min(mv_y, place) as y from f group by all),
b as (select f.pkt_no, f.mb_x, f.mb_y, arg_min(f.mv_x, f.place) as x, arg_min(f.mv_y, f.place) as y from f join a using (pkt_no, mb_x, mb_y)
  where f.mv_x <> a.x or f.mv_y <> a.y group by f.pkt_no, f.mb_x, f.mb_y)
select g.pkt_no, g.mb_x, g.mb_y, (case when a.x is null then 0 when b.x is null then 1 else 2 end)::bigint as n_found,
  coalesce(a.x, 0) as nearest_x, coalesce(a.y, 0) as nearest_y, coalesce(b.x, 0) as near_x, coalesce(b.y, 0) as near_y,
  case when a.place < 2 then a.x else 0 end as pred_x, case when a.place < 2 then a.y else 0 end as pred_y
from g left join a using (pkt_no, mb_x, mb_y) left join b using (pkt_no, mb_x, mb_y)""",
    "edge_emulation": _PX
    + """, c as (select block_id, unnest(range(144)) as place from (select distinct block_id from px))
select c.block_id, c.place, px.p as value from c join px on px.block_id = c.block_id and px.x = greatest(least(c.place % 12 - 3, 7), 0) and px.y = greatest(least(c.place // 12 + 5, 7), 0)""",
    "mc_bilinear_h": _PX + f"select block_id, place, {_bilinear('b', 'r', 3)} as value {_sampled({'b': (0, 0), 'r': (1, 0)})}",
    "mc_bilinear_v": _PX + f"select block_id, place, {_bilinear('b', 'd', 5)} as value {_sampled({'b': (0, 0), 'd': (0, 1)})}",
    "mc_bilinear_hv": _PX
    + f"select block_id, place, {_bilinear(_bilinear('b', 'r', 3), _bilinear('d', 'q', 3), 5)} as value {_sampled({'b': (0, 0), 'r': (1, 0), 'd': (0, 1), 'q': (1, 1)})}",
    "mc_bicubic_h": _PX + f"select block_id, place, {_taps(list(_ROW), TAPS_X)} as value {_sampled(_ROW)}",
    "mc_bicubic_v": _PX + f"select block_id, place, {_taps(list(_COLUMN), TAPS_Y)} as value {_sampled(_COLUMN)}",
    "mc_bicubic_hv": _PX
    + f"select block_id, place, {_taps([_taps([f's{i}{j}' for i in range(4)], TAPS_X) for j in range(4)], TAPS_Y)} as value {_sampled(_SQUARE)}",
}
