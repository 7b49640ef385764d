"""Quality classifier: random-indexing word vectors, pooled, and a small network.

Tokens are runs of letters and digits or runs of other signs. Every token
falls in one of ``BUCKETS`` hash buckets, and every bucket has a fixed sparse
ternary index vector. A bucket's word vector is the sum of the index vectors
of its neighbours in the training texts. A document is the mean of the word
vectors of all its tokens, with two pooled numbers about adjacent tokens. A
two-layer network on numpy gives a logit, which a temperature fitted on
held-back training rows turns into a calibrated probability.

The model's size is fixed by ``BUCKETS`` and ``DIMS`` (4 MB), whatever the
size of the corpus, so it can be broadcast.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_arrow
from .common import small_batches
from .mixing import row_hash

TOKEN = re.compile(r"\w+|[^\w\s]+")
BUCKETS, DIMS, NONZERO, WINDOW = 1 << 15, 32, 4, 2
HIDDEN, EPOCHS = 24, 300
#: Bound of the training sample: labelled rows, with their whole texts.
SAMPLE_ROWS = 3000
THRESHOLD = 0.3
FOLDS = 5
_MOST_CACHED = 100_000


class Buckets(dict):
    """Bucket of each token seen, cleared when it grows too large."""

    def __missing__(self, token: str) -> int:
        at = xxhash.xxh3_64_intdigest(token) % BUCKETS
        if len(token) <= 64:
            if len(self) > _MOST_CACHED:
                self.clear()
            self[token] = at
        return at


def index_vectors() -> np.ndarray:
    """A sparse ternary vector for each bucket, from a fixed seed."""
    rng = np.random.default_rng(20240101)
    index = np.zeros((BUCKETS, DIMS), dtype=np.float32)
    rows = np.arange(BUCKETS)[:, None]
    places = np.argsort(rng.random((BUCKETS, DIMS)), axis=1)[:, :NONZERO]
    index[rows, places] = rng.choice(np.array([-1, 1], dtype=np.float32), (BUCKETS, NONZERO))
    return index


def token_ids(text: str, cache: Buckets) -> np.ndarray:
    return np.array([cache[t] for t in TOKEN.findall(text)], dtype=np.int32)


def _pair_counts(texts: list[np.ndarray], step: int, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of buckets ``step`` apart in the texts, and how often each occurs; ``most`` pairs are sorted at a time."""
    pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    some, size = [], 0
    for x in texts:
        for at in range(0, max(0, len(x) - step), most):
            part = x[at : at + most + step].astype(np.int64)
            some.append(part[:-step] * BUCKETS + part[step:])
            size += len(some[-1])
            if size >= most:
                pairs, counts, some, size = *_merged(pairs, counts, some), [], 0
    return _merged(pairs, counts, some)


def _merged(pairs: np.ndarray, counts: np.ndarray, more: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, n = np.unique(np.concatenate([np.zeros(0, np.int64), *more]), return_counts=True)
    both, place = np.unique(np.concatenate([pairs, found]), return_inverse=True)
    return both, np.bincount(place, np.concatenate([counts, n]), len(both)).astype(np.int64)


def word_vectors(texts: list[np.ndarray]) -> np.ndarray:
    """Unit vectors: each bucket's own index vector and those of its neighbours in the texts, summed."""
    index = index_vectors()
    words = index.copy()
    for step in range(1, WINDOW + 1):
        pair, count = _pair_counts(texts, step)
        for at in range(0, len(pair), 50_000):
            some = pair[at : at + 50_000]
            left, right, weight = some // BUCKETS, some % BUCKETS, np.log1p(count[at : at + 50_000]).astype(np.float32)[:, None]
            np.add.at(words, left, index[right] * weight)
            np.add.at(words, right, index[left] * weight)
    return words / np.maximum(np.linalg.norm(words, axis=1, keepdims=True), 1e-6)


def pooled(ids: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Mean vector of all tokens, and how often a token repeats the one or the two before."""
    out = np.zeros(DIMS + 2, dtype=np.float32)
    if len(ids):
        used, count = np.unique(ids, return_counts=True)
        out[:DIMS] = (count[:, None] * words[used]).sum(0) / len(ids)
        out[DIMS] = (ids[1:] == ids[:-1]).sum() / len(ids)
        out[DIMS + 1] = (ids[2:] == ids[:-2]).sum() / len(ids)
    return out


class QualityModel:
    def __init__(self, words, mean, scale, w1, b1, w2, b2, temperature):
        self.words, self.mean, self.scale = words, mean, scale
        self.w1, self.b1, self.w2, self.b2, self.temperature = w1, b1, w2, b2, temperature
        self._cache = Buckets()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_cache"}

    def __setstate__(self, state):
        self.__dict__.update(state, _cache=Buckets())

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, texts: list) -> np.ndarray:
        """Probability of label 1 for each whole text; null counts as empty."""
        if not texts:
            return np.zeros(0)
        x = np.stack([pooled(token_ids(t or "", self._cache), self.words) for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500).astype(np.float64)))


def train(texts: list[str], labels: list[int], seed: int = 1) -> QualityModel:
    """As ``train_ids``, on texts; null counts as empty."""
    cache = Buckets()
    return train_ids([token_ids(t or "", cache) for t in texts], labels, seed)


def train_ids(ids: list[np.ndarray], labels: list[int], seed: int = 1) -> QualityModel:
    """Fit vectors, network and temperature. Without both labels the score is the labels' smoothed mean."""
    words = word_vectors(ids)
    y = np.array(labels, dtype=np.float64)
    width = DIMS + 2
    x = np.stack([pooled(i, words) for i in ids]) if ids else np.zeros((0, width), dtype=np.float32)
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(width), np.ones(width))
    prior = (y.sum() + 1) / (len(y) + 2)
    rng = np.random.default_rng(seed)
    w1, b1 = rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN)
    w2, b2 = rng.normal(0, HIDDEN**-0.5, HIDDEN), float(np.log(prior / (1 - prior)))
    if len(set(labels)) < 2:
        return QualityModel(words, mean, scale, w1, b1, np.zeros(HIDDEN), b2, 1.0)
    held = np.arange(len(y)) % 5 == 0
    z = (x - mean) / scale
    zt, yt = z[~held], y[~held]
    params, first, second = [w1, b1, w2, np.array(b2)], [0.0] * 4, [0.0] * 4
    for t in range(1, EPOCHS + 1):
        h = np.tanh(zt @ params[0] + params[1])
        p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -60, 60)))
        d = (p - yt) / len(yt)
        dh = np.outer(d, params[2]) * (1 - h * h)
        grads = [zt.T @ dh + 1e-4 * params[0], dh.sum(0), h.T @ d + 1e-4 * params[2], d.sum()]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            params[i] = params[i] - 0.02 * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    model = QualityModel(words, mean, scale, *params[:3], float(params[3]), 1.0)
    logits, yh = model.logits(x[held]), y[held]
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    loss = [np.mean(np.logaddexp(0, logits / t) - yh * logits / t) for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    return model


def fold(doc_id, folds: int = FOLDS):
    """crc32 of the id's text, modulo ``folds``; a null id has the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Train on a bounded sample of labelled rows outside fold 0.

    The sample is the ``SAMPLE_ROWS`` labelled ids with the lowest id hash.
    Their whole texts are cut into tokens on the executors; the driver gets
    two bytes per token. An id that is labelled twice trains with its lowest
    label, one with several texts with its lowest text. Labels that are null
    or other than 0 and 1 and null ids are left out, and so are labels
    without a document; without any the score is 0.5.
    """
    spark = docs.sparkSession
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    chosen = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(row_hash(F.col("doc_id")), "doc_id")
    picked = {r["doc_id"]: r["quality"] for r in chosen.limit(SAMPLE_ROWS).collect()}
    if not picked:
        return train_ids([], [])
    # Rows from a list would start Python workers of another kind, which stay beside those of the operators.
    asked = spark.createDataFrame(pa.table({"picked": pa.array(list(picked), pa.int64())}))
    texts = (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        .join(F.broadcast(asked), F.col("doc_id") == F.col("picked"))  # at most SAMPLE_ROWS ids
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"))
    )

    def run(batches):
        cache = Buckets()
        for batch in small_batches(batches, 1):
            ids = [token_ids(t or "", cache).astype(np.uint16).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    rows = sorted(map_arrow(texts.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, ids binary").collect())
    return train_ids([np.frombuffer(r["ids"], np.uint16).astype(np.int32) for r in rows], [picked[r["doc_id"]] for r in rows])


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Every whole text is scored, null as empty, whatever its id; ids pass
    through, null and repeated ones too, and equal texts score alike. An
    empty table gives no rows. Only the two named columns are read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in small_batches(batches, 2):
            p = held.value.score(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32), pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(F.col(id_col)) == 0).alias("held_out"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores at least the threshold, unchanged.

    Null counts as an empty text, which is judged like any other; ids are not
    read, and rows with equal texts stay or go together. An empty table gives
    no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in small_batches(batches, at):
            yield batch.filter(pa.array(held.value.score(batch.column(at).to_pylist()) >= THRESHOLD))

    return map_arrow(docs, run, docs.schema)
