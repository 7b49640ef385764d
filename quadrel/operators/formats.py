"""Pixel formats: metadata of components, short names and buffer layouts.

A format is a struct of its colour model, component count, component structs
and flags. All formulas are column expressions over arrays of components.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import long, shr

COMPONENT = "struct<h_ss:int,v_ss:int,packed:boolean,depth:int,shift:int,comp_offs:int,next_elem:int>"
FORMAT_SCHEMA = (
    f"name string, model string, submodel string, components int, comp_info array<{COMPONENT}>, elem_size int, be boolean, alpha boolean, palette boolean"
)


def _plane(ss: int, offset: int) -> tuple:
    return (ss, ss, False, 8, 0, offset, 1)


def _packed(depth: int, shift: int, offset: int, step: int) -> tuple:
    return (0, 0, True, depth, shift, offset, step)


# The predefined formats.
FORMATS = [
    ("yuv420", "YUV", "YUVJ", 3, [_plane(0, 0), _plane(1, 1), _plane(1, 2), None, None], 0, False, False, False),
    ("yuv410", "YUV", "YUVJ", 3, [_plane(0, 0), _plane(2, 1), _plane(2, 2), None, None], 0, False, False, False),
    ("yuva410", "YUV", "YUVJ", 4, [_plane(0, 0), _plane(2, 1), _plane(2, 2), _plane(0, 3), None], 0, False, True, False),
    ("yuva420", "YUV", "YUVJ", 4, [_plane(0, 0), _plane(1, 1), _plane(1, 2), _plane(0, 3), None], 0, False, True, False),
    ("pal8", "RGB", "RGB", 3, [_packed(8, 0, 0, 3), _packed(8, 0, 1, 3), _packed(8, 0, 2, 3), None, None], 3, False, False, True),
    ("rgb565", "RGB", "RGB", 3, [_packed(5, 11, 0, 2), _packed(6, 5, 0, 2), _packed(5, 0, 0, 2), None, None], 2, False, False, False),
    ("rgb24", "RGB", "RGB", 3, [_packed(8, 0, 0, 3), _packed(8, 0, 1, 3), _packed(8, 0, 2, 3), None, None], 3, False, False, False),
]
DEFAULT_COMPONENTS = {"CMYK": 4}


def pixel_formats(spark: SparkSession) -> DataFrame:
    """The predefined formats as a small dimension table."""
    return spark.createDataFrame(FORMATS, FORMAT_SCHEMA)


def default_components(model: Column) -> Column:
    """Components of a colour model; a picture may have an alpha component besides."""
    return F.coalesce(*[F.when(model == m, n) for m, n in DEFAULT_COMPONENTS.items()], F.lit(3))


def is_model(model: Column, name: str) -> Column:
    """Whether a colour model is RGB, YUV or any other."""
    return model == name


def model_short_name(model: Column) -> Column:
    return F.lower(model)


def describe_model(model: Column, submodel: Column) -> Column:
    """Text of a colour model; only RGB and YUV have variants."""
    return F.when(model.isin("RGB", "YUV"), F.concat(model, F.lit("("), submodel, F.lit(")"))).otherwise(model)


def present(comps: Column) -> Column:
    return F.filter(comps, lambda c: c.isNotNull())


def scaled_size(size: Column, subsampling: Column) -> Column:
    """Width or height of a component: divided by a power of two, rounded up."""
    unit = F.element_at(F.array(*[F.lit(1 << k).cast("long") for k in range(9)]), subsampling.cast("int") + 1)
    return F.call_function("shiftright", F.try_add(long(size), unit - 1), subsampling.cast("int"))


def line_size(width: Column, comp: Column) -> Column:
    """Bytes of a packed component's line, elements of a planar one; null if that is no BIGINT."""
    w = scaled_size(width, comp["h_ss"])
    depth = long(comp["depth"])
    return F.when(comp["packed"], shr(F.try_add(F.try_multiply(w, depth), depth - 1), 3)).otherwise(w)


def data_size(width: Column, height: Column, comp: Column) -> Column:
    return F.try_multiply(line_size(width, comp), scaled_size(height, comp["v_ss"]))


def max_depth(comps: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(present(comps), lambda c: c["depth"])), F.lit(0))


def total_depth(comps: Column) -> Column:
    return F.aggregate(present(comps), F.lit(0), lambda a, c: a + c["depth"])


def max_subsampling(comps: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(present(comps), lambda c: F.greatest(c["h_ss"], c["v_ss"]))), F.lit(0))


def is_unpacked(comps: Column, palette: Column) -> Column:
    return ~palette & F.forall(present(comps), lambda c: ~c["packed"])


def _order_of(fmt) -> Column:
    """Letters of an RGB format in the order of its components.

    If every component is at the same element, their shifts tell the order
    (lowest first); otherwise their offsets do. A component that stands
    alone at its offset writes its letter there last.
    """
    comps = present(fmt("comp_info"))
    letters = F.array(*[F.lit(x) for x in "rgba"])
    tagged = F.transform(comps, lambda c, i: F.struct(c["shift"].alias("shift"), c["comp_offs"].alias("offs"), F.get(letters, i).alias("letter")))
    same = F.forall(comps, lambda c: c["comp_offs"] == 0)
    by_shift = F.transform(F.array_sort(tagged), lambda t: t["letter"])
    by_place = F.transform(F.array_sort(F.transform(tagged, lambda t: F.struct(t["offs"], t["letter"]))), lambda t: t["letter"])
    # With one shared element the last component's letter is written over the first place.
    last = F.element_at(F.transform(comps, lambda c, i: F.get(letters, i)), -1)
    shared = F.concat(F.array(last), F.slice(by_shift, 2, 5))
    return F.array_join(F.when(same, shared).otherwise(by_place), "")


def short_name(fmt) -> Column:
    """Short name of a format whose columns ``fmt(name)`` gives; null where there is none.

    4:2:0 is called yuv422p: names repeat the horizontal digit unless the
    vertical subsampling is 4. That is how the format's names are defined.
    """
    comps, n = fmt("comp_info"), fmt("components")
    deepest, total, unpacked = max_depth(comps), total_depth(comps), is_unpacked(comps, fmt("palette"))
    end = F.when(fmt("be"), "be").otherwise("le")
    depths = F.array_join(F.transform(present(comps), lambda c: c["depth"].cast("string")), "")
    rgb = (
        F.when(fmt("palette"), F.when(fmt("name") == "pal8", "pal8"))
        .when(total.isin(15, 16), F.concat(_order_of(fmt), depths, end))
        .otherwise(
            F.concat(
                _order_of(fmt),
                F.when((total == 24) | (total != n * 8), total.cast("string")).otherwise(""),
                F.when(unpacked, "p").otherwise(""),
                F.when(deepest > 8, end).otherwise(""),
            )
        )
    )
    cu, cv = F.get(comps, F.lit(1)), F.get(comps, F.lit(2))
    digit = F.element_at(F.array(F.lit("4"), F.lit("2"), F.lit("1")), cu["h_ss"] + 1)
    yuv = (
        F.when(total != deepest * n, None)
        .when(n < 3, F.when((n == 1) & (deepest == 8), "y8").when((n == 2) & fmt("alpha") & (deepest == 8), "y8a"))
        .when((cu["h_ss"] != cv["h_ss"]) | (cu["v_ss"] != cv["v_ss"]) | (cu["h_ss"] > 2) | (cu["v_ss"] > 2), None)
        .otherwise(
            F.concat(
                F.when(fmt("alpha"), "yuva4").otherwise("yuv4"),
                digit,
                F.when(cu["v_ss"] > 1, "0").otherwise(digit),
                F.when(unpacked, "p").otherwise(""),
                F.when(deepest != 8, deepest.cast("string")).otherwise(""),
            )
        )
    )
    return F.when(fmt("model") == "RGB", rgb).when(fmt("model") == "YUV", yuv)


def describe_component(comp: Column) -> Column:
    """Text of a component, such as (1x1, planar(2,1))."""
    bits = F.element_at(F.array(*[F.lit((1 << k) - 1).cast("long") for k in range(33)]), comp["depth"] + 1)
    move = F.element_at(F.array(*[F.lit(1 << k).cast("long") for k in range(33)]), comp["shift"] + 1)
    mask = F.hex(bits * move)
    packed = F.format_string("packed(+%d,%s, step %d)", comp["comp_offs"], mask, comp["next_elem"])
    planar = F.format_string("planar(%d,%d)", comp["comp_offs"], comp["next_elem"])
    return F.format_string("(%dx%d, %s)", comp["h_ss"], comp["v_ss"], F.when(comp["packed"], packed).otherwise(planar))


def describe(fmt) -> Column:
    """Text of a whole format."""
    model = describe_model(fmt("model"), fmt("submodel"))
    flags = F.concat(F.when(fmt("palette"), "palette ").otherwise(""), F.when(fmt("alpha"), "alpha ").otherwise(""))
    head = F.format_string("Formaton for %s (%selem %s size %d): ", model, flags, F.when(fmt("be"), "BE").otherwise("LE"), fmt("elem_size"))
    parts = F.transform(present(fmt("comp_info")), lambda c: F.concat(F.lit(" "), describe_component(c)))
    return F.concat(F.lit("["), head, F.array_join(parts, ""), F.lit("]"))


def aligned(size: Column, align: int) -> Column:
    """Size rounded up to a multiple of a power of two."""
    return shr(F.try_add(long(size), F.lit((1 << align) - 1).cast("long")), align) * (1 << align)


def plane_layout(rows: DataFrame, align: int = 4) -> DataFrame:
    """Buffer kind, offsets, strides, size and status of a picture in its format.

    ``rows`` has width and height beside the format columns. Sizes are in
    elements of the kind: video (8 bits), video16, video32 or packed. A
    format that lacks one of its components has the status FormatError; a
    picture whose size is no BIGINT has TooLargeDimensions; both have nulls
    in the other columns. Otherwise the status is OK.
    """
    fmt = F.col
    comps = present(fmt("comp_info"))
    whole_format = F.size(F.filter(F.slice(fmt("comp_info"), F.lit(1), fmt("components")), lambda c: c.isNotNull())) == fmt("components")
    width, height = aligned(fmt("width"), align), aligned(fmt("height"), align)
    used = F.slice(comps, 1, 5)
    add = lambda a, b: F.try_add(a, b)
    strides = F.transform(used, lambda c: line_size(width, c))
    sizes = F.transform(used, lambda c: data_size(width, height, c))
    offsets = F.transform(sizes, lambda x, i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0).cast("long"), add))
    total = F.aggregate(sizes, F.lit(0).cast("long"), add)
    all_packed = F.forall(used, lambda c: c["packed"])
    bytewise = F.forall(used, lambda c: ~c["packed"] | ((c["shift"] + c["depth"]) % 8 == 0))
    line = line_size(width, F.get(comps, F.lit(0)))
    elem = long(fmt("elem_size"))
    deepest = max_depth(comps)
    as_bytes = bytewise | ~fmt("elem_size").isin(2, 4)
    palette, planar = fmt("palette"), ~all_packed
    picture, packed_line = F.try_multiply(line, height), F.try_multiply(width, elem)
    found = {
        "kind": F.when(palette, "video")
        .when(planar, F.when(deepest <= 8, "video").when(deepest <= 16, "video16").otherwise("video32"))
        .when(as_bytes, "packed")
        .when(fmt("elem_size") == 2, "video16")
        .otherwise("video32"),
        "offsets": F.when(palette, F.array(F.lit(0).cast("long"), picture)).when(planar, offsets).otherwise(F.array().cast("array<bigint>")),
        "strides": F.when(palette, F.array(line)).when(planar, strides).when(as_bytes, F.array(packed_line)).otherwise(F.array(width)),
        "size": F.when(palette, F.try_add(picture, elem * 256))
        .when(planar, total)
        .when(as_bytes, F.try_multiply(packed_line, height))
        .otherwise(F.try_multiply(width, height)),
    }
    status = F.when(~whole_format, "FormatError").when(found["size"].isNull(), "TooLargeDimensions").otherwise("OK")
    laid = rows.select("*", *[c.alias(n) for n, c in found.items()], status.alias("status"))
    return laid.select(*rows.columns, *[F.when(F.col("status") == "OK", F.col(n)).alias(n) for n in found], "status")
