"""Transform and reconstruction queries over the block carriers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fixed import deblock_pair, long, variance16
from ..functions.tables import FILTER_LIMITS, IDCT
from ..operators import blocks as B
from ..sources import carriers


def _both(spark, sf_dir):
    """Coefficient blocks beside sample blocks of the same vector."""
    return carriers.blocks(spark, sf_dir).join(carriers.samples(spark, sf_dir), "block_id")


def idct_dc(spark, sf_dir):
    return carriers.blocks(spark, sf_dir).select("block_id", B.idct_dc(F.get("coeffs", F.lit(0))).alias("dc"))


def _per_place(df, column="out"):
    return df.select("block_id", F.posexplode(column).alias("place", "value")).select("block_id", long(F.col("place")).alias("place"), "value")


def idct_full(spark, sf_dir):
    return _per_place(carriers.blocks(spark, sf_dir).select("block_id", B.idct(F.col("coeffs")).alias("out")))


def idct_full_batch(spark, sf_dir):
    return _per_place(B.idct_batch(carriers.blocks(spark, sf_dir)))


def unquant_wrap(spark, sf_dir):
    factors = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i * 97 + 13)
    return _per_place(carriers.blocks(spark, sf_dir).select("block_id", B.unquantised(F.col("coeffs"), factors).alias("out")))


def put_block(spark, sf_dir):
    return _per_place(carriers.blocks(spark, sf_dir).select("block_id", B.put_block(B.idct(F.col("coeffs"))).alias("out")))


def put_block_dc(spark, sf_dir):
    filled = F.array_repeat(B.idct_dc(F.get("coeffs", F.lit(0))), 64)
    return _per_place(carriers.blocks(spark, sf_dir).select("block_id", B.put_block(filled).alias("out")))


def add_block(spark, sf_dir):
    return _per_place(_both(spark, sf_dir).select("block_id", B.add_block(B.idct(F.col("coeffs")), F.col("pixels")).alias("out")))


def add_block_dc(spark, sf_dir):
    filled = F.array_repeat(B.idct_dc(F.get("coeffs", F.lit(0))), 64)
    return _per_place(_both(spark, sf_dir).select("block_id", B.add_block(filled, F.col("pixels")).alias("out")))


def put_block_ilace_rows(spark, sf_dir):
    """Lines of the plane that rows of interlaced blocks land on."""
    rows = carriers.blocks(spark, sf_dir).select("block_id", (F.col("block_id") % 4).alias("by"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("row"))
    line = lambda x: B.line_of(F.col("by"), F.col("row"), x)
    return rows.select("block_id", long(F.col("row")).alias("row"), line(True).alias("line_interlaced"), line(False).alias("line"))


def loop_filter_edge(spark, sf_dir):
    """Every row of a sample block, filtered across its middle with the limit of a quantiser."""
    limits = F.array(*[F.lit(x) for x in FILTER_LIMITS])
    rows = carriers.samples(spark, sf_dir).select(
        "block_id", "pixels", F.get(limits, (F.col("block_id") % 64).cast("int")).alias("lim"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("row")
    )
    at = lambda k: F.get("pixels", F.col("row") * 8 + k)
    b, c = deblock_pair(at(2), at(3), at(4), at(5), F.col("lim"))
    return rows.select("block_id", long(F.col("row")).alias("row"), b.alias("b"), c.alias("c"))


def block_variance(spark, sf_dir):
    """Spread of every second sample of every second row."""
    places = [y * 8 + x for y in range(0, 8, 2) for x in range(0, 8, 2)]
    values = [long(F.get("pixels", F.lit(p))) for p in places]
    total, squares = sum(values[1:], values[0]), sum((v * v for v in values[1:]), values[0] * values[0])
    return carriers.samples(spark, sf_dir).select("block_id", variance16(total, squares).alias("variance"))


def _ilace(spark, sf_dir, samples):
    """Samples of interlaced blocks by line and column of their macroblock."""
    rows = samples.select("block_id", F.posexplode("out").alias("place", "value"))
    line = B.line_of(F.col("block_id") % 4, F.floor(F.col("place") / 8), True)
    return rows.select("block_id", line.alias("line"), (F.col("place") % 8).cast("long").alias("x"), "value")


def put_block_ilace(spark, sf_dir):
    return _ilace(spark, sf_dir, carriers.blocks(spark, sf_dir).select("block_id", B.put_block(B.idct(F.col("coeffs"))).alias("out")))


def add_block_ilace(spark, sf_dir):
    return _ilace(spark, sf_dir, _both(spark, sf_dir).select("block_id", B.add_block(B.idct(F.col("coeffs")), F.col("pixels")).alias("out")))


QUERIES = {
    f.__name__: f
    for f in (
        idct_dc,
        idct_full,
        idct_full_batch,
        unquant_wrap,
        put_block,
        put_block_dc,
        add_block,
        add_block_dc,
        put_block_ilace_rows,
        put_block_ilace,
        add_block_ilace,
        loop_filter_edge,
        block_variance,
    )
}

_WRAP = "((({0}) + 32768) & 65535) - 32768"
C1, C2, C3, C4, C5, C6, C7 = IDCT
# One row per coefficient, with its line y and place x.
_COEFFS = """
with c as (select vec_id as block_id, place, place // 8 as y, place % 8 as x, floor(embedding[place + 1]::double * 2000)::bigint as v
  from (select *, unnest(range(64)) as place from embeddings)),
dc as (select block_id, """ + _WRAP.format(f"((({C4} * (({C4} * v) >> 16)) >> 16) + 8) >> 4") + """ as dc from c where place = 0),
px as (select vec_id as block_id, place, least(greatest(floor(embedding[place + 1]::double * 128)::bigint + 128, 0), 255) as p
  from (select *, unnest(range(64)) as place from embeddings))
"""


def _pass(source: str, group: str, along: str, name: str, first: bool) -> str:
    """SQL of one pass: gather eight values, then the products, then the sums."""
    m = lambda k, v: f"(({k} * ({v})) >> 16)"
    sum04, dif04 = (_WRAP.format("s0 + s4"), _WRAP.format("s0 - s4")) if first else ("s0 + s4", "s0 - s4")
    bias, shift = (0, 0) if first else (8, 4)
    picks = ", ".join(f"max(case when {along} = {k} then v end) as s{k}" for k in range(8))
    sums = {0: "g1 + c2", 7: "g1 - c2", 1: "a3 + h2", 2: "a3 - h2", 3: "e2 + d2", 4: "e2 - d2", 5: "f2 + b2", 6: "f2 - b2"}
    cases = " ".join(f"when {k} then ({e}) >> {shift}" for k, e in sorted(sums.items()))
    return f"""
{name}_s as (select block_id, {group}, {picks} from {source} group by block_id, {group}),
{name}_m as (select block_id, {group},
  {m(C1, 's1')} + {m(C7, 's7')} as a, {m(C7, 's1')} - {m(C1, 's7')} as b, {m(C3, 's3')} + {m(C5, 's5')} as c, {m(C3, 's5')} - {m(C5, 's3')} as d,
  {m(C4, sum04)} + {bias} as e, {m(C4, dif04)} + {bias} as f, {m(C2, 's2')} + {m(C6, 's6')} as g, {m(C6, 's2')} - {m(C2, 's6')} as h from {name}_s),
{name}_t as (select *, {m(C4, 'a - c')} as a1, {m(C4, 'b - d')} as b1, a + c as c2, b + d as d2, e - g as e2, e + g as g1 from {name}_m),
{name}_u as (select *, f + a1 as a3, f - a1 as f2, b1 - h as b2, b1 + h as h2 from {name}_t),
{name} as (select block_id, {group}, k as {along}, case k {cases} end as v from (select *, unnest(range(8)) as k from {name}_u))"""


_IDCT = _COEFFS + "," + _pass("c", "y", "x", "r", True) + "," + _pass("r", "x", "y", "q", False) + f""",
o as (select block_id, y * 8 + x as place, {_WRAP.format('v')} as value from q)
"""
_LINE = "block_id % 4 // 2 * 16 + block_id % 4 % 2 + place // 8 * 2"
_CLAMP = "least(greatest({0}, 0), 255)"

ORACLES = {
    "idct_dc": _COEFFS + "select block_id, dc from dc",
    "idct_full": _IDCT + "select block_id, place, value from o",
    "idct_full_batch": _IDCT + "select block_id, place, value from o",
    "unquant_wrap": _COEFFS + f"select block_id, place, case when place = 0 then v else {_WRAP.format('v * (place * 97 + 13)')} end as value from c",
    "put_block": _IDCT + f"select block_id, place, {_CLAMP.format(_WRAP.format('value + 128'))} as value from o",
    "put_block_dc": _COEFFS + f"select block_id, unnest(range(64)) as place, {_CLAMP.format(_WRAP.format('dc + 128'))} as value from dc",
    "add_block": _IDCT + f"select block_id, place, {_CLAMP.format(_WRAP.format('value + p'))} as value from o join px using (block_id, place)",
    "add_block_dc": _COEFFS + f"select block_id, place, {_CLAMP.format(_WRAP.format('dc + p'))} as value from dc join px using (block_id)",
    "put_block_ilace": _IDCT + f"select block_id, {_LINE} as line, place % 8 as x, {_CLAMP.format(_WRAP.format('value + 128'))} as value from o",
    "add_block_ilace": _IDCT + f"select block_id, {_LINE} as line, place % 8 as x, {_CLAMP.format(_WRAP.format('value + p'))} as value from o join px using (block_id, place)",
    "put_block_ilace_rows": """select vec_id as block_id, r as row, ((vec_id % 4) // 2 * 16 + vec_id % 4 % 2 + r * 2)::bigint as line_interlaced,
  (vec_id % 4 * 8 + r)::bigint as line from (select *, unnest(range(8)) as r from embeddings)""",
    "loop_filter_edge": _COEFFS
    + f""", e as (select block_id, place // 8 as row, max(case when place % 8 = 2 then p end) as a, max(case when place % 8 = 3 then p end) as b,
  max(case when place % 8 = 4 then p end) as c, max(case when place % 8 = 5 then p end) as d, {list(FILTER_LIMITS)}[block_id % 64 + 1]::bigint as lim from px group by block_id, place // 8),
d as (select *, ((a - d) + 3 * (c - b) + 4) >> 3 as raw from e),
f as (select *, case when abs(raw) >= 2 * lim then 0 when abs(raw) < lim then raw when raw < 0 then -raw - 2 * lim else 2 * lim - raw end as step from d)
select block_id, row, {_CLAMP.format('b + step')} as b, {_CLAMP.format('c - step')} as c from f""",
    "block_variance": _COEFFS
    + """select block_id, ((sum(p * p) * 16 - sum(p) * sum(p))::bigint >> 8) & 65535 as variance from px where place % 2 = 0 and place // 8 % 2 = 0 group by block_id""",
}
