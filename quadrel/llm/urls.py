"""URL filters: fixed host and path rules, then association rules mined by FP-growth.

Each URL is a set of tokens: host labels, path segments (numbers as '#'),
query keys. Tokens that occur in just the same labelled URLs are one item, so
a long URL that comes again and again is no explosion of token sets.
FP-growth over the labelled URLs finds combinations of items that imply a
block; rules are pruned by support, confidence and lift. A rule is indexed
under its rarest item, so a URL meets only the rules that could match it, and
then has to hold all the other items too. Everything is DataFrame functions
and Spark's own FP-growth.

Verdicts of the fixed rules are labels as well: what they have in common is
mined and decides URLs that no fixed rule fits.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, with_size_checked

# Fixed values of the contract: (host/path, verdict).
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.9
#: A rule needs so many labelled URLs, however few there are in all.
MIN_COUNT = 20
BLOCK, ALLOW = "=block", "=allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and query of a URL; all empty without '://'."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substr(url, start + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return (
        F.translate(host, _UPPER, _LOWER),
        F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1),
        F.regexp_extract(rest, "^[^?#]*\\?([^#]*)", 1),
    )


def fixed_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule whose host and path fit, else null."""
    fits = F.lit(None).cast("string")
    for text, _ in sorted(rules, key=lambda r: len(r[0])):
        name, _, tail = text.partition("/")
        here = ((host == name) | host.endswith("." + name)) & path.startswith("/" + tail)
        fits = F.when(here, F.lit(text)).otherwise(fits)
    return fits


def tokens(host: Column, path: Column, query: Column) -> Column:
    """Distinct tokens of a URL, sorted."""

    def tagged(tag: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(tag), x))

    segments = F.transform(F.split(path, "/"), lambda x: F.regexp_replace(x, "[0-9]+", "#"))
    keys = F.transform(F.split(query, "[&;]"), lambda x: F.regexp_extract(x, "^[^=]*", 0))
    found = F.concat(tagged("h:", F.split(host, "\\.")), tagged("p:", segments), tagged("q:", keys))
    return F.array_sort(F.array_distinct(found))


def items_of(labelled: DataFrame, least: int) -> DataFrame:
    """(token, item): tokens of at least ``least`` labelled URLs; tokens of just the same URLs share an item, the first of them.

    Which URLs hold a token is told by their number and two sums of hashes of
    their row numbers. The result has at most (all tokens) / ``least`` rows.
    """
    seen = labelled.select("row", F.explode("tokens").alias("token")).groupBy("token")
    where = [F.sum(F.xxhash64("row", F.lit(k)).cast("decimal(38,0)")).alias(f"at_{k}") for k in (1, 2)]
    marked = seen.agg(F.count("*").alias("n"), *where).where(F.col("n") >= least)
    same = marked.groupBy("n", "at_1", "at_2").agg(F.min("token").alias("item"), F.collect_list("token").alias("tokens"))
    return same.select(F.explode("tokens").alias("token"), "item")


def _itemised(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(row, items): the items of each row's tokens; rows without any are absent."""
    spread = rows.select("row", F.explode("tokens").alias("token"))
    return spread.join(with_size_checked(items), "token").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """Rules that imply a block, (antecedent, confidence), and (token, item), from (row, tokens, blocked) rows.

    A rule needs ``MIN_COUNT`` URLs and the share ``min_support`` of them.
    """
    n = max(labelled.count(), 1)
    least = max(MIN_COUNT, math.ceil(min_support * n - 1e-9))
    items = materialise(items_of(labelled, least), "items")
    item = F.when(F.col("blocked"), F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    named = labelled.select("row", item.alias("label")).join(_itemised(labelled, items), "row", "left")
    baskets = named.select(F.concat(F.coalesce("items", F.array().cast("array<string>")), F.array("label")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / n), minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules
    return rules.where((F.element_at("consequent", 1) == BLOCK) & (F.col("lift") > 1)).select("antecedent", "confidence"), items


def matched(rows: DataFrame, rules: DataFrame, items: DataFrame) -> DataFrame:
    """(row, confidence): the rows (row, tokens) that hold all items of a rule, with the best confidence.

    Rules are looked up by their rarest item; rules and items are broadcast if
    they are few. Rows meet again by their own numbers, so no key is hot.
    """
    held = materialise(_itemised(rows, items), "held")
    counts = held.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    spread = rules.select("antecedent", "confidence", F.explode("antecedent").alias("item"))
    rarest = spread.join(counts, "item").groupBy("antecedent", "confidence").agg(F.min_by("item", F.struct("n", "item")).alias("item"))
    index = with_size_checked(materialise(rarest, "index"))
    hits = held.select("row", "items", F.explode("items").alias("item")).join(index, "item").where(F.size(F.array_except("antecedent", "items")) == 0)
    return hits.groupBy("row").agg(F.max("confidence").alias("confidence"))


def url_filter(
    pages: DataFrame,
    labels: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, confidence.

    A fixed rule decides if one fits; else a matching mined rule blocks, with
    its confidence, and what no rule matches is allowed. Rules are mined from
    the verdicts of the fixed rules and, for other pages, from ``labels``,
    which has (id, blocked) for some of them, joined by page id. A null URL
    or one without '://' has an empty host and path and no tokens, and is
    allowed. Null and repeated ids pass through. Without labelled pages
    nothing is mined. An empty table gives no rows. Only the two named
    columns are read.
    """
    host, path, query = _parts(F.col(url_col))
    judged = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), tokens(host, path, query).alias("tokens"))
    judged = judged.withColumn("rule", fixed_rule(F.col("host"), F.col("path"))).withColumn("row", F.monotonically_increasing_id())
    judged = materialise(judged, "urls")
    verdict = reduce(lambda a, r: F.when(F.col("rule") == r[0], F.lit(r[1])).otherwise(a), RULES, F.lit(None).cast("string"))
    labelled = judged.where("rule is not null").select("row", "tokens", (verdict == "block").alias("blocked"))
    if labels is not None:
        known = labels.where("id is not null and blocked is not null").groupBy("id").agg(F.max("blocked").alias("blocked"))
        told = judged.where("rule is null").join(known, F.col("page_id") == F.col("id")).select("row", "tokens", "blocked")
        labelled = labelled.union(told)
    labelled = materialise(labelled.where(F.size("tokens") > 0), "labelled")
    best = judged.withColumn("confidence", F.lit(None).cast("double"))
    if not labelled.isEmpty():
        rules, items = mine(labelled, min_support, min_confidence)
        rules = materialise(rules, "mined")
        if not rules.isEmpty():
            hits = materialise(matched(judged.where("rule is null"), rules, items), "hits").withColumnRenamed("row", "hit")
            best = judged.join(hits, F.col("row") == F.col("hit"), "left")
    mined = F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return best.select("page_id", "host", "path", "rule", F.coalesce(verdict, mined).alias("verdict"), "confidence")
