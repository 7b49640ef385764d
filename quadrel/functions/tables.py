"""Fixed values of the bitstream format.

The constants below are data of the format. Tables of more entries (mode vectors, coefficient update
probabilities, all sharpness levels of the interpolation taps) are not part
of this package: ``CodecTables`` takes them as parameters.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cached_property

# fmt: off
# Fixed values, in the order of the format.
IDCT = (64277, 60547, 54491, 46341, 36410, 25080, 12785)
ZIGZAG = (
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
)
COEF_BASE = (5, 7, 11, 19, 35, 67)
COEF_ADD_PROBS = ((159,), (165, 145), (173, 148, 140), (176, 155, 140, 135), (180, 157, 141, 134, 130), (254, 254, 243, 230, 196, 177, 153, 140, 133, 130, 129))
COEF_ADD_BITS = (1, 2, 3, 4, 5, 11)
DC_QUANTS = (
    47, 47, 47, 47, 45, 43, 43, 43, 43, 43, 42, 41, 41, 40, 40, 40, 40, 35, 35, 35, 35, 33, 33, 33, 33, 32, 32, 32, 27, 27, 26, 26,
    25, 25, 24, 24, 23, 23, 19, 19, 19, 19, 18, 18, 17, 16, 16, 16, 16, 16, 15, 11, 11, 11, 10, 10, 9, 8, 7, 5, 3, 3, 2, 2,
)
AC_QUANTS = (
    94, 92, 90, 88, 86, 82, 78, 74, 70, 66, 62, 58, 54, 53, 52, 51, 50, 49, 48, 47, 46, 45, 44, 43, 42, 40, 39, 37, 36, 35, 34, 33,
    32, 31, 30, 29, 28, 27, 26, 25, 24, 23, 22, 21, 20, 19, 18, 17, 16, 15, 14, 13, 12, 11, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1,
)
FILTER_LIMITS = (
    14, 14, 13, 13, 12, 12, 10, 10, 10, 10, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8,
    8, 8, 8, 8, 7, 7, 7, 7, 7, 7, 6, 6, 6, 6, 6, 6, 5, 5, 5, 5, 4, 4, 4, 4, 4, 4, 4, 3, 3, 3, 3, 2,
)
DEFAULT_MODE_PROBS = (
    (42, 69, 2, 1, 7, 1, 42, 44, 22, 6, 3, 1, 2, 0, 5, 1, 1, 0, 0, 0),
    (8, 229, 1, 1, 8, 0, 0, 0, 0, 0, 2, 1, 1, 0, 0, 0, 1, 1, 0, 0),
    (35, 122, 1, 1, 6, 1, 34, 46, 0, 0, 2, 1, 1, 0, 1, 0, 1, 1, 0, 0),
)
NEIGHBOURS = ((-1, 0), (0, -1), (-1, -1), (-1, 1), (-2, 0), (0, -2), (-1, -2), (-2, -1), (-2, 1), (-1, 2), (-2, -2), (-2, 2))
LONG_VECTOR_ORDER = (0, 1, 2, 7, 6, 5, 4)
NZ_PROBS = (162, 164)
RAW_PROBS = ((247, 210, 135, 68, 138, 220, 239, 246), (244, 184, 201, 44, 173, 221, 239, 253))
TREE_PROBS = ((225, 146, 172, 147, 214, 39, 156), (204, 170, 119, 235, 140, 230, 228))
ZERO_RUN_PROBS = ((198, 197, 196, 146, 198, 204, 169, 142, 130, 136, 149, 149, 191, 249), (135, 201, 181, 154, 98, 117, 132, 126, 146, 169, 184, 240, 246, 254))
HAS_NZ_PROB = (237, 231)
HAS_SIGN_PROB = (246, 243)
HAS_TREE_PROB = ((253, 253, 254, 254, 254, 254, 254), (245, 253, 254, 254, 254, 254, 254))
HAS_RAW_PROB = ((254, 254, 254, 254, 254, 250, 250, 252), (254, 254, 254, 254, 254, 251, 251, 254))
HAS_COEF_PROBS = ((146, 255, 181, 207, 232, 243, 238, 251, 244, 250, 249), (179, 255, 214, 240, 250, 255, 244, 255, 255, 255, 255))
HAS_SCAN_PROBS = (
    0, 132, 132, 159, 153, 151, 161, 170, 164, 162, 136, 110, 103, 114, 129, 118, 124, 125, 132, 136, 114, 110, 142, 135, 134, 123, 143, 126, 153, 183, 166, 161,
    171, 180, 179, 164, 203, 218, 225, 217, 215, 206, 203, 217, 229, 241, 248, 243, 253, 255, 253, 255, 255, 255, 255, 255, 255, 255, 255, 255, 255, 255, 255, 255,
)
HAS_ZERO_RUN_PROBS = ((219, 246, 238, 249, 232, 239, 249, 255, 248, 253, 239, 244, 241, 248), (198, 232, 251, 253, 219, 241, 253, 255, 248, 249, 244, 238, 251, 255))
DC_WEIGHTS = (
    ((122, 133), (133, 51), (142, -16)), ((0, 1), (0, 1), (0, 1)), ((78, 171), (169, 71), (221, -30)), ((139, 117), (214, 44), (246, -3)), ((168, 79), (210, 38), (203, 17)),
)
AC_BANDS = (
    0, 0, 1, 1, 1, 2, 2, 2, 2, 2, 2, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4,
    4, 4, 4, 4, 4, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5,
)
SCAN_BANDS = (
    0, 0, 1, 1, 1, 2, 2, 2, 2, 2, 2, 3, 3, 4, 4, 4, 5, 5, 5, 5, 6, 6, 7, 7, 7, 7, 7, 8, 8, 9, 9, 9,
    9, 9, 9, 10, 10, 11, 11, 11, 11, 11, 11, 12, 12, 12, 12, 12, 12, 13, 13, 13, 13, 13, 14, 14, 14, 14, 15, 15, 15, 15, 15, 15,
)
INTERLACED_SCAN_BANDS = (
    0, 1, 0, 1, 1, 2, 5, 3, 2, 2, 2, 2, 4, 7, 8, 10, 9, 7, 5, 4, 2, 3, 5, 6, 8, 9, 11, 12, 13, 12, 11, 10,
    9, 7, 5, 4, 6, 7, 9, 11, 12, 12, 13, 13, 14, 12, 11, 9, 7, 9, 11, 12, 14, 14, 14, 15, 13, 11, 13, 15, 15, 15, 15, 15,
)
# fmt: on

MB_TYPES = (
    "intra",
    "inter_no_mv",
    "inter_mv",
    "inter_nearest",
    "inter_near",
    "inter_four_mv",
    "golden_no_mv",
    "golden_mv",
    "golden_nearest",
    "golden_near",
)
#: Place of each macroblock type in the mode probability tables.
MODE_PLACES = (1, 0, 2, 3, 4, 7, 5, 6, 8, 9)
#: Tree of macroblock types: (index of probability, branch for 0, branch for 1).
MODE_TREE = (0, (1, (3, 1, 2), (4, 3, 4)), (2, (5, 0, 5), (6, (7, 6, 7), (8, 8, 9))))


def mode_branches(counts: list) -> list:
    """For each branch of the mode tree: (count of its branch for 0, count of both), from counts by place in the probability tables.

    Counts are numbers or columns.
    """
    out = [None] * 9

    def total(node):
        if not isinstance(node, tuple):
            return counts[MODE_PLACES[node]]
        zero, one = total(node[1]), total(node[2])
        out[node[0]] = (zero, zero + one)
        return zero + one

    total(MODE_TREE)
    return out


def ref_id(mb_type: int) -> int:
    """0 for intra, 1 for the last frame, 2 for the golden one."""
    return 0 if mb_type == 0 else 1 if mb_type < 6 else 2


@dataclass(frozen=True)
class CodecTables:
    """The large tables of the format, which the caller supplies.

    ``ac_update``: probabilities [3][2][6][11] that a coefficient probability
    is sent; ``mode_vectors``: [3][16][20] ready-made mode probabilities;
    ``taps``: [17][8][4] interpolation taps by sharpness level and eighth.
    """

    ac_update: list
    mode_vectors: list
    taps: list

    def __post_init__(self):
        shapes = {"ac_update": (3, 2, 6, 11), "mode_vectors": (3, 16, 20), "taps": (17, 8, 4)}
        for name, shape in shapes.items():
            value = getattr(self, name)
            for n in shape:
                if len(value) != n:
                    raise ValueError(f"{name} must have the shape {shape}")
                value = value[0]
        if any(sum(t) != 128 for level in self.taps for t in level):
            raise ValueError("interpolation taps must sum to 128")

    @cached_property
    def ac_chances(self) -> tuple:
        """``ac_update`` in one row."""
        return tuple(p for kind in self.ac_update for plane in kind for band in plane for p in band)

    @classmethod
    def load(cls, path: str) -> "CodecTables":
        """Tables from a JSON file with the three names."""
        with open(path) as file:
            return cls(**json.load(file))
