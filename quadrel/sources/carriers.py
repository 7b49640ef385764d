"""Inputs for the operators: packets, blocks, samples and vectors.

Real inputs are tables of packets (stream_id, pkt_no, data), read from
Parquet or from folders of files. The sample tables hold no video, so the
carriers derive numbers and bytes from their columns by fixed formulas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKETS = "stream_id string, pkt_no bigint, data binary"


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """Packets from a Parquet table of (stream_id, pkt_no, data)."""
    return spark.read.schema(PACKETS).parquet(path)


def read_packet_files(spark: SparkSession, path: str) -> DataFrame:
    """Packets from one file each, named <number>.<anything>, in one folder per stream."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(
        F.regexp_extract("path", "([^/]*)/[^/]*$", 1).alias("stream_id"),
        F.regexp_extract("path", "/([0-9]+)[^/]*$", 1).cast("long").alias("pkt_no"),
        F.col("content").alias("data"),
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 bytes per event: the MD5 of its id."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("user_id").alias("stream_id"),
        F.col("event_id").alias("pkt_no"),
        F.unhex(F.md5(F.col("event_id").cast("string").cast("binary"))).alias("data"),
    )


def blocks(spark: SparkSession, sf_dir: str, scale: int = 2000, bias: int = 0) -> DataFrame:
    """One 8x8 block per embedding: floor(value * scale) + bias."""
    values = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long") + bias)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("block_id"), values.alias("coeffs"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 samples of 0 to 255 per embedding."""
    found = blocks(spark, sf_dir, 128, 128)
    return found.select("block_id", F.transform("coeffs", lambda x: F.greatest(F.least(x, F.lit(255)), F.lit(0))).alias("pixels"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A motion vector of -64 to 64 per line item."""
    part, supp = F.col("l_partkey") % 129 - 64, F.col("l_suppkey") % 129 - 64
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", part.alias("x"), supp.alias("y"))


def mb_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macroblocks of 10 by 10 grids, one per event."""
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.floor(n / 100).alias("pkt_no"),
        F.floor(n % 100 / 10).alias("mb_y"),
        (n % 10).alias("mb_x"),
        (F.col("user_id") % 3).alias("ref_id"),
        (F.col("user_id") % 5 - 2).alias("mv_x"),
        (F.col("user_id") % 7 - 3).alias("mv_y"),
    )
