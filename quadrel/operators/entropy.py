"""Arithmetic-coded decisions, mode probabilities and Huffman weights as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.bits import byte_at
from ..functions.fixed import long, mode_share, prob_weight, shr
from ..functions.tables import mode_branches
from .readers import RUN_WEIGHTS, TOKEN_WEIGHTS, leaf_weights


def bool_decisions(data: Column, probs: list) -> Column:
    """The first decisions of a binary range decoder as a string of 0 and 1; null for under 4 bytes.

    The state (value, range, spare bits, next byte) folds over the list of
    probabilities. Past the end of the data zeros are shifted in.
    """
    first = ((byte_at(data, 0) * 256 + byte_at(data, 1)) * 256 + byte_at(data, 2)) * 256 + byte_at(data, 3)
    start = F.struct(
        first.alias("value"), long(255).alias("range"), long(8).alias("spare"), long(4).alias("next"), F.lit("").alias("out")
    )

    def step(s, prob):
        # Leading zeros of the range below 8 bits; a one-element transform binds each stage once.
        shift = sum((F.when(s["range"] < (1 << k), 1).otherwise(0) for k in range(1, 8)), F.lit(0))
        moved = F.struct(
            shift.alias("shift"),
            F.shiftleft(s["range"], 0).alias("range0"),
            s["value"].alias("value0"),
            s["spare"].alias("spare0"),
            s["next"].alias("next0"),
            s["out"].alias("out0"),
        )

        def refill(m):
            factor = F.element_at(F.array(*[F.lit(1 << k).cast("long") for k in range(8)]), m["shift"] + 1)
            spare = m["spare0"] - m["shift"]
            value = (m["value0"] * factor).bitwiseAND(0xFFFFFFFF)
            more = (spare <= 0) & (m["next0"] < F.octet_length(data))
            up = F.element_at(F.array(*[F.lit(1 << k).cast("long") for k in range(8)]), F.least(-spare, F.lit(7)).cast("int") + 1)
            byte = F.coalesce(F.conv(F.hex(F.substr(data, (m["next0"] + 1).cast("int"), F.lit(1))), 16, 10).cast("long"), long(0))
            return F.struct(
                F.when(more, value.bitwiseOR(byte * up)).otherwise(value).alias("value"),
                (m["range0"] * factor).alias("range"),
                F.when(more, spare + 8).otherwise(spare).alias("spare"),
                F.when(more, m["next0"] + 1).otherwise(m["next0"]).alias("next"),
                (shr((m["range0"] * factor - 1) * prob, 8) + 1).alias("split"),
                m["out0"].alias("out"),
            )

        def decide(m):
            edge = F.shiftleft(m["split"], 24)
            one = m["value"] >= edge
            return F.struct(
                F.when(one, m["value"] - edge).otherwise(m["value"]).alias("value"),
                F.when(one, m["range"] - m["split"]).otherwise(m["split"]).alias("range"),
                m["spare"].alias("spare"),
                m["next"].alias("next"),
                F.concat(m["out"], F.when(one, "1").otherwise("0")).alias("out"),
            )

        stages = F.transform(F.transform(F.array(moved), refill), decide)
        return F.get(stages, F.lit(0))

    out = F.aggregate(F.array(*[long(p) for p in probs]), start, step, lambda s: s["out"])
    return F.when(F.octet_length(data) >= 4, out)


def mode_probs(sent: Column, mode: Column) -> list:
    """The ten branch probabilities of a macroblock mode, from the twenty sent ones (pairs of change and keep)."""
    counts = [F.when(mode == i, 0).otherwise(long(F.get(sent, F.lit(2 * i))) * 100) for i in range(10)]
    keep, change = long(F.get(sent, mode * 2 + 1)), long(F.get(sent, mode * 2))
    return [mode_share(zero, both) + 1 for zero, both in mode_branches(counts)] + [255 - mode_share(keep, keep + change)]


def _leaves(tree, probs: Column, n_probs: int, n: int) -> list:
    return leaf_weights(tree, [long(F.get(probs, F.lit(i))) for i in range(n_probs)], n, prob_weight)


def huffman_weights(probs: Column) -> list:
    """Weights of the twelve token leaves from eleven probabilities; the last leaf ends the block."""
    return _leaves(TOKEN_WEIGHTS, probs, 11, 12)


def run_weights(probs: Column) -> list:
    """Weights of the nine leaves of zero runs from eight probabilities."""
    return _leaves(RUN_WEIGHTS, probs, 8, 9)


def decided_number(bits: Column, at: int, n: int) -> Column:
    """``n`` (1 to 32) decisions of a string of 0 and 1, as a number; null past its end."""
    part = F.substring(bits, at + 1, n)
    return F.when(F.length(part) == n, F.conv(part, 2, 10).cast("long"))


def decided_signed(bits: Column, at: int, n: int) -> Column:
    """The same with the first decision as the sign of a two's complement."""
    return decided_number(bits, at, n) - F.when(F.substring(bits, at + 1, 1) == "1", 1 << n).otherwise(0)


def decided_probability(bits: Column, at: int) -> Column:
    """Seven decisions, doubled; 0 means 1."""
    return F.greatest(decided_number(bits, at, 7) * 2, F.lit(1).cast("long"))
