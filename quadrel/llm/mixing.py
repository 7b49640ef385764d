"""Mixing sources to target weights with hash-threshold histograms.

Every row has a fixed 60-bit hash. For each source a threshold on that hash
decides which rows are taken once more, so a mix is a filter and needs no
sorting of rows. The thresholds are found by summing words in 4096 hash
buckets per source, walking the running sum to the bucket where the budget
ends, and refining that one bucket with the next 12 bits, until it holds one
hash value. Budgets nest: a smaller budget takes a subset of a larger one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialise, word_count

HASH_BITS = 60
LEVEL_BITS = 12
CYCLE = (3, 1, 2)
TOTAL_SHARE = 1.5
MAX_REPEAT = 2


def row_hash(key: Column, text: Column | None = None) -> Column:
    """60 bits of the MD5 of the key's text, as LONG; a null key hashes as the row's ``text``, or as ''."""
    rest = [] if text is None else [F.concat(F.lit("text "), text)]
    text = F.coalesce(key.cast("string"), *rest, F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, cycle=CYCLE) -> DataFrame:
    """(source, source_size, target): each source's share of 1.5 times all words.

    ``sizes`` has one row per source, so the windows below see as many rows
    as there are sources. Sources take the weights of ``cycle`` in code-point
    order, null last. A target stops at twice its source's size, and what is
    left over goes to the others by weight. The capped sources are a prefix
    when ordered by size over weight, so one running sum finds them all.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = (F.row_number().over(ordered) - 1) % len(cycle)
    weight = F.coalesce(*[F.when(F.col("rank") == i, F.lit(w)) for i, w in enumerate(cycle)]).cast("long")
    by_cap = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(0, Window.unboundedFollowing)
    ranked = sizes.withColumn("rank", rank).withColumn("weight", weight)
    summed = ranked.select(
        "source",
        "source_size",
        "weight",
        F.sum("source_size").over(whole).alias("total"),
        F.coalesce(F.sum(F.col("source_size") * MAX_REPEAT).over(before), F.lit(0)).alias("capped"),
        F.sum("weight").over(onward).alias("weights"),
    )
    # 3 * total / 2 stays exact in integers as twice the budget.
    left2 = F.col("total") * 3 - F.col("capped") * 2
    is_capped = left2 * F.col("weight") >= F.col("source_size") * (2 * MAX_REPEAT) * F.col("weights")
    rated = summed.withColumn("is_capped", is_capped).withColumn("rate", left2.cast("double") / 2 / F.col("weights"))
    rate = F.max(F.when(~F.col("is_capped"), F.col("rate"))).over(whole)
    return rated.withColumn("best", rate).select(
        "source",
        "source_size",
        F.when(F.col("is_capped"), (F.col("source_size") * MAX_REPEAT).cast("double"))
        .otherwise(F.col("best") * F.col("weight"))
        .alias("target"),
    )


def thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, base, threshold): rows with a hash below the threshold count base + 1 times.

    ``rows`` has (source, size, h). One level is one aggregation over the
    rows of the boundary buckets; levels go on only while some boundary
    bucket still holds several hash values. The row at the very boundary is
    taken if that brings the sum nearer to the target.
    """
    base = F.when(F.col("target") > F.col("source_size"), F.lit(1)).otherwise(F.lit(0))
    state = targets.select(
        "source",
        "source_size",
        "target",
        base.alias("base"),
        (F.col("target") - base * F.col("source_size")).alias("need"),
        F.lit(0).cast("long").alias("prefix"),
        F.lit(False).alias("done"),
        F.lit(None).cast("long").alias("threshold"),
    )
    for level in range(HASH_BITS // LEVEL_BITS):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        state = materialise(_refine(rows, state, shift), f"mix{level}")
        if state.where(~F.col("done")).isEmpty():
            break
    return state.select("source", "source_size", "target", "base", "threshold")


def _refine(rows: DataFrame, state: DataFrame, shift: int) -> DataFrame:
    open_ = state.where(~F.col("done")).select(F.col("source").alias("src"), "need", "prefix")
    inside = rows.join(open_, F.col("source").eqNullSafe(F.col("src")) & (F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix")))
    cells = inside.groupBy("src", "need", F.shiftright("h", shift).alias("cell")).agg(
        F.sum("size").alias("words"), F.min("h").alias("low"), F.max("h").alias("high")
    )
    in_source = Window.partitionBy("src").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    summed = cells.withColumn("upto", F.sum("words").over(in_source))
    edge = summed.where((F.col("upto") > F.col("need")) & (F.col("upto") - F.col("words") <= F.col("need"))).select(
        F.col("src").alias("edge_source"), (F.col("need") - F.col("upto") + F.col("words")).alias("rest"), "words", "cell", "low", "high"
    )
    single = F.col("low") == F.col("high")
    nearer = F.when(F.col("words") < F.col("rest") * 2, F.col("low") + 1).otherwise(F.col("low"))
    joined = state.join(edge, F.col("source").eqNullSafe(F.col("edge_source")) & ~F.col("done"), "left")
    found = F.col("cell").isNotNull()
    return joined.select(
        "source",
        "source_size",
        "target",
        "base",
        F.when(found, F.col("rest")).otherwise(F.col("need")).alias("need"),
        F.when(found, F.col("cell")).otherwise(F.col("prefix")).alias("prefix"),
        (F.col("done") | ~found | single).alias("done"),
        F.when(F.col("done"), F.col("threshold"))
        .when(~found, F.lit(1 << HASH_BITS))
        .when(single, nearer)
        .otherwise(F.col("threshold"))
        .alias("threshold"),
    )


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    columns = (F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    return materialise(docs.select(*columns, row_hash(F.col(id_col), F.col(text_col)).alias("h")), "mix")


def _cuts(rows: DataFrame, cycle) -> DataFrame:
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    return thresholds(rows, source_targets(sizes, cycle))


def _times(h: Column) -> Column:
    """How often a row is taken, by its hash and its source's cut."""
    return F.col("base") + F.when(h < F.col("threshold"), 1).otherwise(0)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cycle=CYCLE) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken.

    Sizes count whole texts. Null text has size 0 and is taken 0 times; a
    null source is a source of its own; a row with a null id is told by its
    text. Rows that repeat an id (or a text without an id) share a hash and
    are taken alike, so the same input always gives the same mix. An empty table gives no rows. Only the
    three named columns are read; others may have any names.
    """
    rows = _sized(docs, id_col, text_col, source_col)
    cuts = _cuts(rows, cycle).withColumnRenamed("source", "cut_source")
    joined = rows.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * _times(F.col("h"))).alias("taken"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cycle=CYCLE) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the mix takes it, columns unchanged.

    Only the cuts, one row per source, are joined to the rows. A null text
    has no words and goes like any other row by its hash; rows without an id
    are told by their texts, rows that repeat an id come equally often, and a
    null source is one of its own. An empty table gives no rows.
    """
    cuts = _cuts(_sized(docs, id_col, text_col, source_col), cycle)
    at, base, cut = (free_name(docs, n) for n in ("mix_source", "mix_base", "mix_cut"))
    renamed = cuts.select(F.col("source").alias(at), F.col("base").alias(base), F.col("threshold").alias(cut))
    joined = docs.join(renamed, docs[source_col].eqNullSafe(renamed[at]))
    times = F.col(base) + F.when(row_hash(docs[id_col], docs[text_col]) < F.col(cut), 1).otherwise(0)
    copies = F.explode(F.array_repeat(F.lit(0), times.cast("int")))
    return joined.select(*[docs[c] for c in docs.columns], copies.alias(at)).drop(at)
