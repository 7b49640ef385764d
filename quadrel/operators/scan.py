"""Coefficient scan orders from bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scan_from_bands(bands: Column) -> Column:
    """Scan order of 64 coefficients: place 0 first, then 1..63 by band, equal bands in order."""
    keyed = F.transform(F.slice(bands, 2, 63), lambda b, i: F.struct(b.alias("band"), (i + 1).cast("long").alias("place")))
    return F.concat(F.array(F.lit(0).cast("long")), F.transform(F.array_sort(keyed), lambda k: k["place"]))
