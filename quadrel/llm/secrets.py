"""Secret scans: fixed patterns, and character Markov models for the rest.

Two second-order Markov models over characters, one of random strings and
one of ordinary identifiers, are trained from labelled samples. What the
patterns leave of a long token is a secret as a whole if its mean
log-likelihood ratio is above a cut that held-out identifiers stay below.
Otherwise its best run of characters is one, wherever that begins and ends,
if the run's sum of ratios is above a cut for tokens of that length.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_arrow
from .common import materialise, small_batches

# Fixed values of the scan's contract: kinds in order, with their patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A longest run of 16 or more: shorter runs could only be matched and dropped.
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "markov")

TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Least characters of a secret without a pattern, and of one judged by its mean; lengths that part the cuts on sums.
LEAST, LEAST_MEAN, LENGTHS = 16, 20, (24, 40, 80, 160)
#: Taken off each ratio before sums, so that long odd but ordinary text does not add up to what a short key has.
DRIFT = 2.0
SIGNS = "+/_=-"
CHARS = string.ascii_letters + string.digits + "+/_=-"
EDGE = len(CHARS)
#: Bound of the training sample: so many distinct words of all documents, about.
SAMPLE_WORDS = 20_000
ORDINARY = r"\b(?:[A-Za-z][a-z]{2,39}|[A-Z]{3,40})\b"

_INDEX = np.full(128, EDGE, dtype=np.int64)
for _i, _c in enumerate(CHARS):
    _INDEX[ord(_c)] = _i


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, in code points."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    found.sort(key=lambda s: (s[0], s[2]))
    return found


def _codes(token: str) -> np.ndarray:
    codes = _INDEX[np.frombuffer(token.encode("ascii"), dtype=np.uint8)]
    return np.concatenate(([EDGE, EDGE], codes))


def _log_model(tokens: list[str]) -> np.ndarray:
    """Log-probability of a character after the two before it, backed off to one and none."""
    n = EDGE + 1
    tri = np.zeros((n, n, n))
    for t in tokens:
        c = _codes(t)
        np.add.at(tri, (c[:-2], c[1:-1], c[2:]), 1.0)
    bi, uni = tri.sum(0), tri.sum((0, 1))
    p0 = (uni + 1) / (uni.sum() + n)
    p1 = (bi + 5 * p0) / (bi.sum(1, keepdims=True) + 5)
    p2 = (tri + 5 * p1) / (tri.sum(2, keepdims=True) + 5)
    return np.log(p2)


def _long(names: list[str], seed: int = 17) -> list[str]:
    """Names joined to tokens of all lengths, as in paths and constants."""
    rng = random.Random(seed)
    out = []
    for i in range(2 * len(names)):
        out.append(rng.choice(("_", "-", "/", "=")).join(rng.choices(names, k=rng.randint(2, 12)))[:400])
    return out


class SecretModel:
    """Log-likelihood ratios of random over ordinary, the cut on their mean, and the cuts on the sums of runs."""

    def __init__(self, ratio: np.ndarray, cut: float, sums: tuple[float, ...] = (16.0,) * (len(LENGTHS) + 1)):
        self.ratio, self.cut, self.sums = ratio, cut, sums

    @classmethod
    def train(cls, randoms: list[str], ordinary: list[str]) -> "SecretModel":
        held, kept = ordinary[::5], [t for i, t in enumerate(ordinary) if i % 5]
        ratio = (_log_model(randoms) - _log_model(kept)).astype(np.float32)
        model = cls(ratio, 0.0)
        scores = [model.score(t) for t in held if len(t) >= 12]
        model.cut = max(0.3, float(np.quantile(scores, 0.9999)) + 0.1 if scores else 0.0)
        sums = [[] for _ in model.sums]
        for t in (held + _long(held) if held else ()):
            if len(t) >= LEAST:
                sums[bisect_right(LENGTHS, len(t))].append(model.best_run(model.ratios(t))[0])
        # A longer token has more runs to choose from, so no cut is below that of a shorter one.
        found = [float(np.quantile(x, 0.9999)) + 1.0 if x else 0.0 for x in sums]
        model.sums = tuple(float(x) for x in np.maximum.accumulate([max(8.0, x) for x in found]))
        return model

    def ratios(self, token: str) -> np.ndarray:
        c = _codes(token)
        return self.ratio[c[:-2], c[1:-1], c[2:]]

    def score(self, token: str) -> float:
        return float(self.ratios(token).mean())

    def best_run(self, ratios: np.ndarray) -> tuple[float, int, int]:
        """(sum, start, end) of the run of at least ``LEAST`` characters with the highest sum of ratios less ``DRIFT``."""
        total = np.concatenate(([0.0], np.cumsum(ratios - DRIFT, dtype=np.float64)))
        gain = total[LEAST:] - np.minimum.accumulate(total[: len(total) - LEAST])
        end = int(gain.argmax()) + LEAST
        return float(gain[end - LEAST]), int(total[: end - LEAST + 1].argmin()), end

    def runs(self, token: str) -> list[tuple[int, int]]:
        """(start, end) of the secrets in a token that no pattern claims."""
        ratios = self.ratios(token)
        if len(token) >= LEAST_MEAN and ratios.mean() > self.cut:
            return [(0, len(token))]
        cut, out, left = self.sums[bisect_right(LENGTHS, len(token))], [], [(0, len(token))]
        while left:
            low, high = left.pop()
            if high - low < LEAST:
                continue
            best, a, b = self.best_run(ratios[low:high])
            if best <= cut:
                continue
            a, b = low + a, low + b
            # No rest of a word of the secret stays outside.
            while a > low and token[a - 1] not in SIGNS and token[a] not in SIGNS:
                a -= 1
            while b < high and token[b] not in SIGNS and token[b - 1] not in SIGNS:
                b += 1
            out.append((a, b))
            left += [(low, a), (b, high)]
        return sorted(out)

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """All spans of a whole text: the base ones, and what the models call random of the rest of each token."""
        found = base_spans(text)
        # Base spans may overlap each other; the furthest end so far decides.
        starts, ends, reach = [], [], 0
        for s in found:
            starts.append(s[0])
            reach = max(reach, s[1])
            ends.append(reach)
        added = []
        for m in TOKEN.finditer(text):
            at, end = m.span()
            k = bisect_right(ends, at)
            while at < end:
                stop = min(end, starts[k]) if k < len(starts) else end
                if stop - at >= LEAST:
                    added += [(at + a, at + b, 3) for a, b in self.runs(text[at:stop])]
                at = max(at, ends[k]) if k < len(ends) else end
                k += 1
        return sorted(found + added, key=lambda s: (s[0], s[2])) if added else found


def random_samples(n: int = 20000, seed: int = 7) -> list[str]:
    """Labelled random strings: the alphabets that keys are written in, 16 to 64 characters."""
    rng = random.Random(seed)
    alphabets = (string.ascii_letters + string.digits, CHARS, string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits)
    return ["".join(rng.choices(alphabets[i % 4], k=rng.randint(16, 64))) for i in range(n)]


# Common parts of names in programs and addresses.
NAME_PARTS = (
    "abstract account action address admin application array async base buffer builder bytes cache channel check client code column command config"
    " connection content context count create data date default delete detail document encoded error event factory field file filter find first form"
    " format function get group handler header html http identifier image index info input instance item json key label last length level line link list"
    " load local location log manager map max message method min mode model module name network node number object offset option order output package page"
    " parameter parse password path pattern payment position process profile project property proxy query queue read record request resource response result"
    " root row rule save schema search section select send server service session set setting singleton size source stack start state status stream string"
    " style system table tag target task template test text thread time timeout title token total transaction tree type update url user util value version"
    " view volume web width window word work write www xml"
).split()


def generated_samples(n: int = 8000, seed: int = 13) -> list[str]:
    """Labelled ordinary identifiers made by rule: compound names, numbers in groups, rulers of one sign."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        parts = rng.choices(NAME_PARTS, k=rng.randint(2, 5))
        style = i % 5
        if style == 0:
            name = parts[0] + "".join(p.capitalize() for p in parts[1:])
        elif style == 1:
            name = "".join(p.capitalize() for p in parts)
        else:
            name = ("_", "-", "/")[i % 3].join(parts)
            name = name.upper() if style == 2 else name
        out.append(name + (str(rng.randrange(3000)) if i % 7 == 0 else ""))
    for i in range(n // 4):
        groups = ["".join(rng.choices(string.digits, k=rng.choice((2, 3, 4, 4, 8, 16)))) for _ in range(rng.randint(1, 6))]
        out.append(rng.choice(("-", "/", "", "_")).join(groups))
        out.append(rng.choice(CHARS) * rng.randint(12, 60))
    rng.shuffle(out)
    return out


def ordinary_samples(docs: DataFrame, text_col: str) -> list[str]:
    """Labelled ordinary identifiers: words of whole documents, single and joined.

    Of the distinct words of all documents, those with the lowest hashes are
    taken, some ``SAMPLE_WORDS`` of them, so reruns agree and the driver gets
    no more, however many words there are. Ordinary are words of letters
    alone that are in one case but for their first letter, which leaves out
    unknown secrets of mixed signs.
    """
    words = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(ORDINARY), F.lit(0)))
    known = materialise(docs.select(F.explode(words).alias("w")).distinct(), "words")
    share = min(1.0, SAMPLE_WORDS / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("w"), F.lit(1 << 40)) < int(share * (1 << 40)))
    found = sorted(r["w"] for r in chosen.collect() if not base_spans(r["w"]))
    rng = random.Random(11)
    rng.shuffle(found)
    joined = [s.join(p) for s, p in zip(rng.choices(("_", "-", "", "/"), k=len(found)), zip(found[::2], found[1::2]))]
    camel = [a.capitalize() + b.capitalize() + c.capitalize() for a, b, c in zip(found[::3], found[1::3], found[2::3])]
    return found + joined + camel


def fit(docs: DataFrame, text_col: str = "text") -> SecretModel:
    return SecretModel.train(random_samples(), generated_samples() + ordinary_samples(docs, text_col))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every run of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame, model: SecretModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of base spans, their digest, and all spans.

    Null text counts as empty and has no spans (the digest is that of ''),
    ids pass through, null and repeated ones too. Texts are scanned whole.
    An empty table gives no rows. Only the two named columns are read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model or fit(docs, text_col))

    def run(batches):
        for batch in small_batches(batches, 1):
            found = [held.value.spans(t or "") for t in batch.column(1).to_pylist()]
            bases = [[s for s in f if s[2] < 3] for f in found]
            count = [[sum(s[2] == k for s in b) for b in bases] for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *[pa.array(c, pa.int64()) for c in count],
                    pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in bases], pa.string()),
                    pa.array([joined(f) for f in found], pa.string()),
                ],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, SCHEMA)


def redacted(docs: DataFrame, model: SecretModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same rows and columns, with every secret in the text replaced by a mark.

    Null and empty texts stay as they are, null and repeated ids too; equal
    texts change alike. An empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model or fit(docs, text_col))
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in small_batches(batches, at):
            texts = [t and redact(t, held.value.spans(t)) for t in batch.column(at).to_pylist()]
            arrays = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return map_arrow(docs, run, docs.schema)
