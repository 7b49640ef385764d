"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: A word is a longest run of characters other than these six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def materialise(df: DataFrame, tag: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage with data that outlives any executor, and makes
    sure that what follows sees one fixed version of the rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quadrel-{tag}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    writer = df.write
    if codec:
        writer = writer.option("compression", codec)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_written: dict = {}


def clean_up(spark: SparkSession) -> int:
    """Delete all tables that ``materialise`` has written in this application; what was made from them cannot be read afterwards."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def word_count(text: Column) -> Column:
    """Number of words as LONG; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` has not taken, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def with_size_checked(df: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most_rows`` (narrow) rows, else left to a shuffle join."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


#: A key is hot if it has more than 1/HOT of all rows, so there are fewer than HOT hot keys; their rows are dealt to SALTS tasks.
HOT, SALTS = 1000, 64


def hot_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_id: str, weight: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on a key, with the rows of hot keys dealt to many tasks.

    ``right`` has each key once, with the number of its rows on the left in
    ``weight``. Rows of a hot key are dealt by a hash of ``left_id``, and the
    one row on the right is repeated for each share. Which keys are hot is
    known from the weights: fewer than ``HOT`` keys, which are broadcast.
    Rows without a key match nothing and are dealt in turn. The columns of
    both sides are returned.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) > total / HOT
    mark, salt, other = free_name(left, "hot"), free_name(left, "salt"), free_name(right, "share")
    marks = F.broadcast(right.where(hot).select(F.col(right_key).alias(mark)))
    dealt = left.join(marks, F.col(left_key) == F.col(mark), "left")
    turn = F.when(F.col(left_key).isNull(), F.monotonically_increasing_id() % SALTS)
    dealt = dealt.withColumn(salt, turn.when(F.col(mark).isNotNull(), F.pmod(F.xxhash64(left_id), F.lit(SALTS))).otherwise(0).cast("int"))
    shares = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread = right.withColumn(other, F.explode(shares))
    return dealt.join(spread, (F.col(left_key) == F.col(right_key)) & (F.col(salt) == F.col(other)), how).drop(mark, salt, other)


def small_batches(batches, column: int, most_bytes: int = 4 << 20):
    """Slices of Arrow batches with about ``most_bytes`` of text each, so that what Python makes of them stays small.

    A single longer text is a slice of its own.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
