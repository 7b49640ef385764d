"""Quality rules as weak supervision, in DataFrame functions only.

Every rule looks at one ratio of a text and has ranges of its own: in one it
votes good (1), in another bad (-1), and between them it abstains (0). So
rules contradict each other on the same text. The votes of a document form a
pattern; the patterns of all documents that pass the base rules are counted,
and expectation-maximisation over the counts estimates the share of good
documents and, for each rule, how often its vote is right on good documents
and on bad ones. A document's verdict is its posterior probability of being
good, given all its votes: a lone vote of a rule that the others contradict
is outweighed, where a filter that all rules must pass would reject.

An abstention is no evidence. The first accuracies only say which of the two
classes is the good one.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialise

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Rule: (ratio, votes bad below, votes good from, votes good to, votes bad above); None for no such bound.
RULES = {
    "symbols": ("r_symbols", None, None, 0.05, 0.25),
    "bare_symbols": ("r_bare", None, None, 0.01, 0.10),
    "short_words": ("r_short", 0.10, 0.15, None, None),
    "repeats": ("r_repeats", None, None, 0.05, 0.20),
    "dup_lines": ("r_dup_lines", None, None, 0.05, 0.30),
    "capitals": ("r_capitals", None, 0.004, 0.10, 0.30),
    "bangs": ("r_bangs", None, None, 0.01, 0.10),
    "digits": ("r_digits", None, None, 0.01, 0.10),
    "word_length": ("r_chars", 3.0, 4.0, 6.0, 7.0),
    "same_words": ("r_same", None, None, 0.30, 0.45),
    "length": ("n_words", 80, 150, None, None),
}
#: Accuracies before any vote (a rule seldom faults a good document and finds few of all kinds of bad ones) and the share of good
#: documents; as many votes are added for them.
FIRST_GOOD, FIRST_BAD, FIRST_SHARE, PRIOR_VOTES = 0.95, 0.3, 0.5, 10.0
LEAST, MOST = 0.02, 0.98
ITERATIONS = 20

_BEFORE, _AFTER = r"(?<![^\x20\x09-\x0D])", r"(?![^\x20\x09-\x0D])"
SHORT_WORD, BARE_SYMBOLS = rf"{_BEFORE}\p{{L}}{{1,3}}[.,;:!?]?{_AFTER}", rf"{_BEFORE}[{SYMBOLS}]+{_AFTER}"


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def _count_of(text: Column, chars: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def _covered(n_words: Column, windows: Column) -> Column:
    """Words inside three-word windows that occur twice or more.

    Windows are sorted with their positions; equal neighbours are the
    repeated ones. Their positions, sorted again, cover three words each
    less what they overlap.
    """
    keyed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # The sorted array is bound once by a one-element transform.
    positions = F.flatten(
        F.transform(
            F.array(keyed),
            lambda s: F.filter(
                F.transform(
                    s,
                    lambda x, j: F.when(
                        (F.get(s, j - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, j + 1)["h"].eqNullSafe(x["h"])), x["i"]
                    ),
                ),
                lambda p: p.isNotNull(),
            ),
        )
    )
    total = F.transform(
        F.array(F.sort_array(positions)),
        lambda p: F.aggregate(
            F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))),
            F.lit(0).cast("long"),
            lambda a, b: a + b,
        ),
    )
    return F.get(total, F.lit(0))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every whole text, and the ratios that the rules read."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(
        F.col(id_col).alias("doc_id"),
        text.alias("text"),
        F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0)).alias("words"),
        F.filter(F.split(text, "\n", -1), lambda x: F.char_length(F.translate(x, SPACES, "")) > 0).alias("lines"),
    )
    n = F.size("words")
    window = F.transform(
        F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)),
    )
    hashed = split.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.char_length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        _count_of(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        _count_of(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
        _count_of(F.col("text"), "0123456789").alias("n_digits"),
        (F.char_length("text") - F.char_length(F.replace(F.col("text"), F.lit("!!"), F.lit("!")))).alias("n_bangs"),
        F.regexp_count("text", F.lit(SHORT_WORD)).alias("n_short"),
        F.when(_count_of(F.col("text"), SYMBOLS) > 0, F.regexp_count("text", F.lit(BARE_SYMBOLS))).otherwise(0).alias("n_bare"),
        window.alias("windows"),
    )
    repeated = F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"), _covered(F.col("n_words"), F.col("windows"))
    ).otherwise(F.lit(0).cast("long"))
    counted = hashed.withColumn("n_repeat_words", repeated).drop("windows")
    words, chars = F.col("n_words"), F.col("word_chars")
    return counted.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        ((words < MIN_WORDS) | (F.col("n_repeat_words") * 100 > words * MAX_REPEAT_PERCENT)).alias("base_failed"),
        _ratio(F.col("n_symbols"), words).alias("r_symbols"),
        _ratio(F.col("n_repeat_words"), words).alias("r_repeats"),
        _ratio(F.col("n_dup_lines"), F.col("n_lines")).alias("r_dup_lines"),
        _ratio(F.col("n_capitals"), chars).alias("r_capitals"),
        _ratio(F.col("n_bangs"), words).alias("r_bangs"),
        _ratio(F.col("n_short"), words).alias("r_short"),
        _ratio(F.col("n_bare"), words).alias("r_bare"),
        _ratio(F.col("n_digits"), chars).alias("r_digits"),
        _ratio(chars, words).alias("r_chars"),
        F.when(words > 0, 1 - F.col("n_distinct") / words).otherwise(F.lit(0.0)).alias("r_same"),
    )


def vote(rule: str) -> Column:
    """1, -1 or 0: the rule's vote on a row of ``features``."""
    name, bad_below, good_from, good_to, bad_above = RULES[rule]
    ratio = F.col(name)
    bad = reduce(lambda a, b: a | b, [ratio < bad_below] * (bad_below is not None) + [ratio > bad_above] * (bad_above is not None))
    good = reduce(lambda a, b: a & b, [ratio >= good_from] * (good_from is not None) + [ratio <= good_to] * (good_to is not None))
    return F.when(bad, -1).when(good, 1).otherwise(0)


def _posterior(model: dict) -> Column:
    """Probability of a good document, given its votes.

    Log-odds stand in one array, three for each rule, so that all steps of a
    fit run the same compiled code.
    """
    odds = [x for good, bad in (model[r] for r in RULES) for x in (math.log((1 - good) / bad), 0.0, math.log(good / (1 - bad)))]
    table = F.lit([*odds, math.log(model["share"] / (1 - model["share"]))])
    places = [F.col(f"v_{r}") + (3 * k + 1) for k, r in enumerate(RULES)]
    total = reduce(lambda a, b: a + b, [F.get(table, p) for p in places], F.get(table, F.lit(len(odds))))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(patterns: DataFrame, iterations: int = ITERATIONS) -> dict:
    """{rule: (accuracy on good, accuracy on bad documents), "share": of good ones}, by expectation-maximisation.

    ``patterns`` has the counted (``n``) patterns of votes, of which there
    are at most 3**11 however many documents there are. Each step is one
    aggregation that brings four sums per rule to the driver. No patterns
    leave the first values as they are.
    """
    model = dict.fromkeys(RULES, (FIRST_GOOD, FIRST_BAD)) | {"share": FIRST_SHARE}
    for _ in range(iterations):
        good = F.col("p") * F.col("n")
        bad = F.col("n") - good
        sums = [F.sum(good).alias("good"), F.sum("n").alias("all")]
        for r in RULES:
            v = F.col(f"v_{r}")
            for name, part, right in (("good", good, 1), ("bad", bad, -1)):
                sums += [F.sum(F.when(v == right, part)).alias(f"{name}_right_{r}"), F.sum(F.when(v != 0, part)).alias(f"{name}_cast_{r}")]
        row = patterns.withColumn("p", _posterior(model)).agg(*sums).first()
        part = lambda first, right, cast: min(MOST, max(LEAST, ((row[right] or 0.0) + first * PRIOR_VOTES) / ((row[cast] or 0) + PRIOR_VOTES)))
        model = {
            r: (part(FIRST_GOOD, f"good_right_{r}", f"good_cast_{r}"), part(FIRST_BAD, f"bad_right_{r}", f"bad_cast_{r}")) for r in RULES
        } | {"share": part(FIRST_SHARE, "good", "all")}
    return model


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its counts, base_failed, posterior and kept.

    ``kept`` is false if the base rules fail, else whether the posterior is
    at least 0.5. The accuracies come from all documents that pass the base
    rules. Null text counts as empty, and an empty text has no words
    and fails the base. Null and repeated ids are passed through, one row
    each. An empty table gives no rows. Only the two named columns are read.
    """
    votes = [vote(r).alias(f"v_{r}") for r in RULES]
    scored = materialise(features(docs, id_col, text_col).select("*", *votes), "rules")
    counted = scored.where("not base_failed").groupBy(*[f"v_{r}" for r in RULES]).agg(F.count("*").alias("n"))
    posterior = _posterior(fit(materialise(counted, "patterns")))
    return scored.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (posterior >= 0.5)).alias("kept"),
        posterior.alias("posterior"),
    )
