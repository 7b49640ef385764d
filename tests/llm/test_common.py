"""Joins on hot keys, and deleting intermediate tables."""

import builtins
import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quadrel.llm import common
from quadrel.llm.graph import components
from quadrel.session import map_arrow


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_join_is_a_join(spark, how):
    rng = random.Random(1)
    rows = [(i, None if i % 97 == 0 else 7 if i % 3 == 0 else rng.randrange(400)) for i in range(6000)]
    left = spark.createDataFrame([(*r, "a", 1) for r in rows], "id long, key long, __hot string, __salt int")
    n = Counter(k for _, k in rows if k is not None)
    right = spark.createDataFrame([(k, f"v{k}", c) for k, c in n.items() if k % 5], "other long, value string, n long")
    got = common.hot_join(left, right, "key", "other", "id", "n", how)
    assert got.columns == [*left.columns, *right.columns]
    plain = left.join(right, F.col("key") == F.col("other"), how)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, plain.collect()))
    assert common.hot_join(left.limit(0), right.limit(0), "key", "other", "id", "n", how).count() == 0


def test_rows_of_a_hot_key_are_dealt_to_many_tasks(spark):
    rows = [(i, 7 if i % 2 else i) for i in range(20_000)]
    left = spark.createDataFrame(rows, "id long, key long")
    right = left.groupBy("key").agg(F.count("*").alias("n")).withColumnRenamed("key", "other")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = common.hot_join(left, right, "key", "other", "id", "n").where("key = 7")
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 10_000 and len(sizes) == 4 and max(sizes) < 5000


def test_clean_up_deletes_what_was_written(spark):
    kept = common.materialise(spark.range(5).toDF("x"), "test")
    path = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(path) and common.clean_up(spark) >= 1 and not os.path.exists(path)
    assert common.clean_up(spark) == 0


def test_components_of_a_star_and_its_rays(spark):
    links = [(0, i) for i in range(1, 3000)] + [(i, 10_000 + i) for i in range(1, 3000, 3)] + [(20_001, 20_002)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(c == (20_001 if n > 20_000 else 0) for n, c in found.items()) and len(found) == 3000 + 1000 + 2


def test_workers_keep_no_memory_that_their_tasks_have_freed(spark):
    def own_mb():
        with open("/proc/self/smaps_rollup") as file:
            return int(re.search(r"\nPss_Anon:\s+(\d+)", file.read())[1]) / 1024

    def large(batches):
        # Blocks of the C heap, and one above them that stays.
        blocks = [np.ones(12_000) for _ in range(1500)]
        vars(builtins).setdefault("kept_by_test", []).append(np.ones(12_000))
        yield from batches
        assert len(blocks) == 1500

    def look(batches):
        list(batches)
        yield pa.RecordBatch.from_arrays([pa.array([own_mb()])], names=["mb"])

    rows = spark.range(0, 4, 1, 4)
    sizes = lambda: [r["mb"] for r in rows.mapInArrow(look, "mb double").collect()]
    before = max(sizes())
    assert map_arrow(rows, large, "id long").count() == 4
    assert max(sizes()) < before + 70
