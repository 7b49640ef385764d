"""Pixel format and scan-order queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fixed import long
from ..functions.tables import INTERLACED_SCAN_BANDS, SCAN_BANDS, ZIGZAG
from ..operators import formats as P
from ..operators.scan import scan_from_bands
from ..sources import carriers


def _components(spark, sf_dir):
    """One made-up component and picture size per part."""
    s = F.coalesce("p_size", F.lit(1))
    comp = F.struct(
        (s % 3).alias("h_ss"), F.floor(s / 3 % 3).cast("int").alias("v_ss"), (s % 2 == 0).alias("packed"), (s % 16 + 1).alias("depth"),
        (s % 5).alias("shift"), F.lit(0).alias("comp_offs"), F.lit(1).alias("next_elem"),
    )
    n = F.col("p_partkey")
    return carriers.table(spark, sf_dir, "part").select("p_partkey", (n % 1920 + 1).alias("width"), (n % 1080 + 1).alias("height"), comp.alias("c"))


def component_sizes(spark, sf_dir):
    w, h, c = F.col("width"), F.col("height"), F.col("c")
    return _components(spark, sf_dir).select(
        "p_partkey",
        P.scaled_size(w, c["h_ss"]).alias("cw"),
        P.scaled_size(h, c["v_ss"]).alias("ch"),
        P.line_size(w, c).alias("line"),
        P.data_size(w, h, c).alias("size"),
        P.describe_component(c).alias("text"),
    )


def format_depths(spark, sf_dir):
    c = F.col("comp_info")
    return P.pixel_formats(spark).select(
        "name",
        F.size(P.present(c)).cast("long").alias("n_components"),
        long(P.max_depth(c)).alias("max_depth"),
        long(P.total_depth(c)).alias("total_depth"),
        long(P.max_subsampling(c)).alias("max_subsampling"),
        P.is_unpacked(c, F.col("palette")).alias("unpacked"),
    )


def format_short_name(spark, sf_dir):
    return P.pixel_formats(spark).select("name", P.short_name(F.col).alias("short_name"), P.describe(F.col).alias("text"))


def plane_layout(spark, sf_dir):
    """Layout of every predefined format at the size of every part."""
    n = F.col("p_partkey")
    sizes = carriers.table(spark, sf_dir, "part").select("p_partkey", (n % 1920 + 1).alias("width"), (n % 1080 + 1).alias("height"))
    every = sizes.withColumn("wanted", F.explode(F.array(*[F.lit(f[0]) for f in P.FORMATS])))
    laid = P.plane_layout(every.join(F.broadcast(P.pixel_formats(spark)), F.col("wanted") == F.col("name")))  # seven formats
    texts = [F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))).alias(c) for c in ("offsets", "strides")]
    return laid.select("p_partkey", "name", "kind", *texts, "size")


BROKEN = ("broken", "YUV", "YUVJ", 3, [P.FORMATS[0][4][0], None, P.FORMATS[0][4][2], None, None], 0, False, False, False)
LAYOUT_FORMATS = ("yuv420", "pal8", "rgb565", "rgb24", "broken")


def layout_errors(spark, sf_dir):
    """Layouts of pictures of up to 2**39 by 2**39 samples, and of a format without its second component."""
    n = F.col("p_partkey")
    power = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), (x % 40).cast("int"))
    sizes = carriers.table(spark, sf_dir, "part").select("p_partkey", power(n).alias("width"), power(n * 7).alias("height"))
    every = sizes.withColumn("wanted", F.explode(F.array(*[F.lit(f) for f in LAYOUT_FORMATS])))
    known = P.pixel_formats(spark).union(spark.createDataFrame([BROKEN], P.FORMAT_SCHEMA))
    return P.plane_layout(every.join(F.broadcast(known), F.col("wanted") == F.col("name"))).select("p_partkey", "name", "status", F.col("size").cast("string").alias("size"))  # eight formats


def colour_models(spark, sf_dir):
    """What is known of the colour model of each part, as if its key chose one."""
    n = F.col("p_partkey")
    model = F.element_at(F.array(*[F.lit(m) for m in MODELS]), (n % len(MODELS)).cast("int") + 1)
    submodel = F.when(model == "RGB", F.when(n % 2 == 0, "RGB").otherwise("sRGB")).otherwise(F.element_at(F.array(*[F.lit(m) for m in ("YCbCr", "YIQ", "YUVJ")]), (n % 3).cast("int") + 1))
    return carriers.table(spark, sf_dir, "part").select(
        "p_partkey",
        long(P.default_components(model)).alias("n_components"),
        P.is_model(model, "RGB").alias("is_rgb"),
        P.is_model(model, "YUV").alias("is_yuv"),
        P.model_short_name(model).alias("short_name"),
        P.describe_model(model, submodel).alias("text"),
    )


def scan_order_update(spark, sf_dir):
    """Scan orders from 63 four-bit bands per block, and from the two default tables."""
    bands = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.slice("coeffs", 2, 63), lambda x: F.pmod(x, F.lit(16))))
    own = carriers.blocks(spark, sf_dir).select("block_id", bands.alias("bands"))
    fixed = spark.createDataFrame([(-1, list(SCAN_BANDS)), (-2, list(INTERLACED_SCAN_BANDS))], "block_id long, bands array<bigint>")
    orders = own.union(fixed).select("block_id", scan_from_bands(F.col("bands")).alias("scan"))
    zigzag = F.array(*[F.lit(z).cast("long") for z in ZIGZAG])
    return orders.select("block_id", F.posexplode("scan").alias("place", "coefficient")).select(
        "block_id", long(F.col("place")).alias("place"), "coefficient", F.get(zigzag, F.col("coefficient").cast("int")).alias("zigzag")
    )


MODELS = ("RGB", "YUV", "CMYK", "HSV", "LAB", "XYZ")
QUERIES = {
    f.__name__: f for f in (component_sizes, format_depths, format_short_name, plane_layout, layout_errors, colour_models, scan_order_update)
}

_PARTS = """with p as (select p_partkey, coalesce(p_size, 1) as s, p_partkey % 1920 + 1 as w, p_partkey % 1080 + 1 as h from part),
c as (select *, s % 3 as hs, s // 3 % 3 as vs, s % 2 = 0 as packed, s % 16 + 1 as d, s % 5 as sh from p),
z as (select *, (w + (1 << hs) - 1) >> hs as cw, (h + (1 << vs) - 1) >> vs as ch from c),
l as (select *, case when packed then (cw * d + d - 1) >> 3 else cw end as line from z) """

_NAMED = (
    "values ('yuv420', 3, 8, 24, 1, true, 'yuv422p'), ('yuv410', 3, 8, 24, 2, true, 'yuv410p'), ('yuva410', 4, 8, 32, 2, true, 'yuva410p'),"
    " ('yuva420', 4, 8, 32, 1, true, 'yuva422p'), ('pal8', 3, 8, 24, 0, false, 'pal8'), ('rgb565', 3, 6, 16, 0, false, 'bgr565le'), ('rgb24', 3, 8, 24, 0, false, 'rgb24')"
)

ORACLES = {
    "component_sizes": _PARTS
    + """select p_partkey, cw, ch, line, line * ch as size, '(' || hs || 'x' || vs || ', ' ||
  case when packed then 'packed(+0,' || printf('%X', ((1 << d) - 1) << sh) || ', step 1)' else 'planar(0,1)' end || ')' as text from l""",
    "format_depths": f"with f(name, n_components, max_depth, total_depth, max_subsampling, unpacked, s) as ({_NAMED}) select name, n_components::bigint as n_components, max_depth::bigint as max_depth, total_depth::bigint as total_depth, max_subsampling::bigint as max_subsampling, unpacked from f",
    "plane_layout": """
with p as (select p_partkey, (p_partkey % 1920 + 16) // 16 * 16 as w, (p_partkey % 1080 + 16) // 16 * 16 as h from part),
f(name, planes, ss) as (values ('yuv420', 3, 2), ('yuv410', 3, 4), ('yuva410', 4, 4), ('yuva420', 4, 2)),
y as (select *, w * h as luma, (w // ss) * (h // ss) as chroma, w // ss as cw from p cross join f)
select p_partkey, name, 'video' as kind,
  case planes when 3 then '0,' || luma || ',' || (luma + chroma) else '0,' || luma || ',' || (luma + chroma) || ',' || (luma + 2 * chroma) end as offsets,
  case planes when 3 then w || ',' || cw || ',' || cw else w || ',' || cw || ',' || cw || ',' || w end as strides,
  luma * (planes - 2) + 2 * chroma as size from y
union all by name select p_partkey, 'pal8' as name, 'video' as kind, '0,' || (((w * 8 + 7) >> 3) * h) as offsets, '' || ((w * 8 + 7) >> 3) as strides, ((w * 8 + 7) >> 3) * h + 768 as size from p
union all by name select p_partkey, 'rgb565' as name, 'video16' as kind, '' as offsets, '' || w as strides, w * h as size from p
union all by name select p_partkey, 'rgb24' as name, 'packed' as kind, '' as offsets, '' || (w * 3) as strides, w * 3 * h as size from p""",
    "layout_errors": f"""
with p as (select p_partkey, 1::hugeint << (p_partkey % 40)::int as w0, 1::hugeint << (p_partkey * 7 % 40)::int as h0 from part),
a as (select p_partkey, (w0 + 15) // 16 * 16 as w, (h0 + 15) // 16 * 16 as h from p),
s as (select p_partkey, name, case name when 'yuv420' then w * h + 2 * ((w // 2) * (h // 2)) when 'pal8' then w * h + 768 when 'rgb565' then w * h when 'rgb24' then 3 * w * h end as size
  from a, (values {', '.join(f"('{n}')" for n in LAYOUT_FORMATS)}) as f(name))
select p_partkey, name, case when size is null then 'FormatError' when size > 9223372036854775807 then 'TooLargeDimensions' else 'OK' end as status,
  case when size <= 9223372036854775807 then size end::varchar as size from s""",
    "colour_models": """
with m as (select p_partkey, ['RGB', 'YUV', 'CMYK', 'HSV', 'LAB', 'XYZ'][p_partkey % 6 + 1] as m, p_partkey % 2 = 0 as even, ['YCbCr', 'YIQ', 'YUVJ'][p_partkey % 3 + 1] as sub from part)
select p_partkey, case when m = 'CMYK' then 4 else 3 end::bigint as n_components, m = 'RGB' as is_rgb, m = 'YUV' as is_yuv, lower(m) as short_name,
  case m when 'RGB' then case when even then 'RGB(RGB)' else 'RGB(sRGB)' end when 'YUV' then 'YUV(' || sub || ')' else m end as text from m""",
    "scan_order_update": f"""
with b as (select vec_id as block_id, place, case when place = 0 then 0 else ((floor(embedding[place + 1]::double * 2000)::bigint % 16) + 16) % 16 end as band
    from (select *, unnest(range(64)) as place from embeddings)
  union all select -1, k, {list(SCAN_BANDS)}[k + 1] from (select unnest(range(64)) as k)
  union all select -2, k, {list(INTERLACED_SCAN_BANDS)}[k + 1] from (select unnest(range(64)) as k)),
o as (select block_id, 0 as place, 0 as coefficient from b where place = 0
  union all select block_id, row_number() over (partition by block_id order by band, place) as place, place as coefficient from b where place > 0)
select block_id, place::bigint as place, coefficient::bigint as coefficient, {list(ZIGZAG)}[coefficient + 1]::bigint as zigzag from o""",
}


def _planar(*comps: tuple) -> str:
    return " ".join(f"({s}x{s}, planar({o},1))" for s, o in comps)


def _packed(*comps: tuple) -> str:
    return " ".join(f"(0x0, packed(+{o},{mask}, step {step}))" for o, mask, step in comps)


_TEXTS = {
    "yuv420": ("yuv422p", "YUV(YUVJ) (elem LE size 0)", _planar((0, 0), (1, 1), (1, 2))),
    "yuv410": ("yuv410p", "YUV(YUVJ) (elem LE size 0)", _planar((0, 0), (2, 1), (2, 2))),
    "yuva410": ("yuva410p", "YUV(YUVJ) (alpha elem LE size 0)", _planar((0, 0), (2, 1), (2, 2), (0, 3))),
    "yuva420": ("yuva422p", "YUV(YUVJ) (alpha elem LE size 0)", _planar((0, 0), (1, 1), (1, 2), (0, 3))),
    "pal8": ("pal8", "RGB(RGB) (palette elem LE size 3)", _packed((0, "FF", 3), (1, "FF", 3), (2, "FF", 3))),
    "rgb565": ("bgr565le", "RGB(RGB) (elem LE size 2)", _packed((0, "F800", 2), (0, "7E0", 2), (0, "1F", 2))),
    "rgb24": ("rgb24", "RGB(RGB) (elem LE size 3)", _packed((0, "FF", 3), (1, "FF", 3), (2, "FF", 3))),
}
ORACLES["format_short_name"] = "select * from (values " + ", ".join(
    f"('{name}', '{short}', '[Formaton for {head}:  {comps}]')" for name, (short, head, comps) in _TEXTS.items()
) + ") as t(name, short_name, text)"
