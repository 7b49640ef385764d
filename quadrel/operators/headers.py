"""Fixed header bits, groups of pictures, and fields that inter packets inherit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import read_bits


def fixed_bits(packets: DataFrame) -> DataFrame:
    """Header fields at fixed places: is_intra, quant, multistream; version, profile and interlaced of intra packets."""
    data = F.col("data")
    intra = read_bits(data, 0, 1) == 0
    only_intra = lambda x: F.when(intra, x)
    return packets.select(
        "stream_id",
        "pkt_no",
        intra.alias("is_intra"),
        read_bits(data, 1, 6).alias("quant"),
        (read_bits(data, 7, 1) == 1).alias("multistream"),
        only_intra(read_bits(data, 8, 5)).alias("version"),
        only_intra(read_bits(data, 13, 2)).alias("profile"),
        only_intra(read_bits(data, 15, 1) == 1).alias("interlaced"),
    )


def _in_stream() -> Window:
    return Window.partitionBy("stream_id").orderBy("pkt_no").rowsBetween(Window.unboundedPreceding, 0)


def with_groups(headers: DataFrame) -> DataFrame:
    """``gop``: number of intra packets so far; 0 holds the packets before the first, which have no reference."""
    return headers.withColumn("gop", F.sum(F.col("is_intra").cast("long")).over(_in_stream()))


def with_inherited(headers: DataFrame) -> DataFrame:
    """Version, profile and interlaced of inter packets from the last intra packet before."""
    last = lambda c: F.last(c, ignorenulls=True).over(_in_stream()).alias(c)
    return headers.select("stream_id", "pkt_no", "is_intra", "quant", "multistream", *[last(c) for c in ("version", "profile", "interlaced")])


def header_status(is_intra: Column, version: Column, profile: Column) -> Column:
    """OK, InvalidData or MissingReference, as far as the fixed bits tell."""
    bad = is_intra & (~version.between(6, 8) | ~profile.isin(0, 3))
    return F.when(bad, "InvalidData").when(version.isNull(), "MissingReference").otherwise("OK")


def gop_summary(headers: DataFrame) -> DataFrame:
    """Per stream and group: packets, intra packets and the mean quantiser."""
    return with_groups(headers).groupBy("stream_id", "gop").agg(
        F.count("*").alias("n_packets"),
        F.sum(F.col("is_intra").cast("long")).alias("n_intra"),
        F.avg("quant").alias("mean_quant"),
    )
