"""Records about streams, pictures and buffers, and their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .formats import describe, scaled_size, total_depth

#: Texts of frame types; only I and P come out of the decoder.
FRAME_TYPES = {"I": "I", "P": "P", "B": "B", "Skip": "skip", "Other": "x"}
#: Statuses of packets by the error that a reader or an allocation meets.
STATUS_OF_ERROR = {
    "BitstreamEnd": "ShortData",
    "TooManyBitsRequested": "InvalidData",
    "InvalidCode": "InvalidData",
    "TooLargeDimensions": "AllocError",
    "FormatError": "AllocError",
}


def video_info(width: Column, height: Column, flipped: Column, fmt) -> Column:
    """Picture size, orientation, format name and total depth as a struct."""
    return F.struct(
        width.cast("int").alias("width"),
        height.cast("int").alias("height"),
        flipped.alias("flipped"),
        fmt("name").alias("format"),
        total_depth(fmt("comp_info")).cast("smallint").alias("bits"),
    )


def describe_video(info: Column, fmt) -> Column:
    return F.concat(info["width"].cast("string"), F.lit("x"), info["height"].cast("string"), F.lit(" "), describe(fmt))


def codec_record(name: Column, info: Column, extradata: Column) -> Column:
    """A stream's codec: name, video properties (null for none) and extra data."""
    return F.struct(name.alias("codec"), info.alias("video"), extradata.alias("extradata"))


def is_video(record: Column) -> Column:
    return record["video"].isNotNull()


def describe_codec(record: Column) -> Column:
    """Name and size of a codec record."""
    video = F.concat_ws("x", record["video"]["width"].cast("string"), record["video"]["height"].cast("string"))
    return F.when(is_video(record), F.concat(record["codec"], F.lit(": "), video)).otherwise(F.concat(record["codec"], F.lit(": none")))


def frame_type_text(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, v) for k, v in FRAME_TYPES.items()], F.lit("x"))


def status_of(error: Column) -> Column:
    """Packet status of an error name; OK for none."""
    return F.coalesce(F.when(error.isNull(), "OK"), *[F.when(error == k, v) for k, v in STATUS_OF_ERROR.items()], F.lit("InvalidData"))


def plane_size(width: Column, height: Column, comp: Column) -> Column:
    """Size of a component as a struct; 0 by 0 for one that is absent."""
    zero = F.lit(0).cast("long")
    return F.struct(
        F.when(comp.isNull(), zero).otherwise(scaled_size(width, comp["h_ss"])).alias("width"),
        F.when(comp.isNull(), zero).otherwise(scaled_size(height, comp["v_ss"])).alias("height"),
    )


def buffer_offset(offsets: Column, index: Column) -> Column:
    """Offset or stride of a component; 0 past the end."""
    return F.coalesce(F.get(offsets, index), F.lit(0).cast("long"))


#: What a buffer of each kind gives: bits of its samples, a view of 8, 16 or 32 bits, and its text.
BUFFER_KINDS = {
    "video": (8, "8-bit"),
    "packed": (8, "packed"),
    "video16": (16, "16-bit"),
    "video32": (32, "32-bit"),
}


def buffer_view(kind: Column) -> Column:
    """What a buffer of a kind holds, as a struct: has_video, view_bits (null for none) and its text; data and none hold no video."""
    pick = lambda k: F.coalesce(*[F.when(kind == n, F.lit(v[k])) for n, v in BUFFER_KINDS.items()])
    text = F.coalesce(pick(1), F.when(kind == "data", "Data buffer").otherwise("No buffer"))
    return F.struct(pick(0).isNotNull().alias("has_video"), pick(0).alias("view_bits"), text.alias("text"))


def vector_text(x: Column, y: Column) -> Column:
    return F.concat_ws(",", x.cast("string"), y.cast("string"))


def reference_frames(headers: DataFrame) -> DataFrame:
    """Packet numbers of the last and the golden reference of each packet.

    ``headers`` has (stream_id, pkt_no, is_intra, is_golden). An intra packet
    clears both references; golden is the latest packet marked so since.
    """
    stream = Window.partitionBy("stream_id").orderBy("pkt_no")
    gop = headers.withColumn("gop", F.sum(F.col("is_intra").cast("long")).over(stream.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("stream_id", "gop").orderBy("pkt_no")
    marked = F.when(F.col("is_golden") | F.col("is_intra"), F.col("pkt_no"))
    golden = F.last(marked, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    # Packets before the first intra one have no references.
    usable = F.col("gop") > 0
    return gop.select(
        "stream_id",
        "pkt_no",
        F.when(usable, F.lag("pkt_no").over(inside)).alias("last_ref"),
        F.when(usable, golden).alias("golden_ref"),
        F.when(usable, "OK").otherwise("MissingReference").alias("status"),
    )
