"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

Documents are read once into chunks of some 2 MB of text: the distinct words
of a chunk as sorted 64-bit hashes, and the text as numbers into that list.
Counts over the corpus are then gathered by an exchange of blocks. A chunk
sends the sorted keys it needs, with its own counts, to owners that each hold
a range of the hash space; an owner adds up the counts of equal keys and
answers every chunk with the sums in the order of its keys. Keys are sent
once per chunk, so owners stay even whatever a word's frequency, and an
exchange moves a few bytes per distinct key instead of a row per token.

One exchange counts words, a second one bigrams. A tenth of the training
documents is held out in turn: their bigrams, seen through the counts of the
rest, train mixture weights for each bucket of context frequency by
expectation-maximisation on a bounded histogram. Scores use all counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_arrow, ship
from .classifier import fold
from .common import materialise, small_batches
from .neardup import WordHashes, mix64

TEST_FOLDS, TEST_FOLD, DEV_FOLDS = 7, 2, 10
CHUNK_BYTES = 2 << 20
KEYS_PER_OWNER = 1_000_000
#: The end of a text, also the context of its first word. No word holds a space.
END = xxhash.xxh3_64_intdigest(b" end")
BUCKETS = 48
#: Width of a bin of logarithms, the bin of 0, and the last one: from -16 to 32, which no corpus leaves.
BIN, ZERO_BIN, LAST_BIN = 0.25, 64, 192
EM_ROUNDS = 50

_A = np.uint64(0xFF51AFD7ED558CCD)


def _pack(values: np.ndarray) -> bytes:
    """Compress numbers byte plane by byte plane."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.compress(planes.tobytes(), 1)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    kind = np.dtype(kind)
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, "u8"), dtype=np.uint64)


CODED = "chunk long, dev boolean, n_train long, n_tokens long, ids array<long>, held array<boolean>, trains array<boolean>, sizes binary, words binary, tokens binary"


def coded(docs: DataFrame) -> DataFrame:
    """Chunks of (doc_id, held_out, dev, text as binary) rows; documents of the held-out tenth get chunks of their own."""

    def emit(number, dev, rows):
        ids, held, sets = [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]
        words, places = np.unique(np.concatenate(sets), return_inverse=True)
        # Frequent words get small numbers, which compress better.
        order = np.argsort(-np.bincount(places), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        sizes = np.array([len(s) for s in sets], np.uint32)
        trains = [not h for h in held]
        fields = (
            [number], [dev], [int(sizes[np.array(trains)].sum())], [int(sizes.sum())], [ids], [held], [trains],
            [_pack(sizes)], [_pack_keys(words)], [_pack_tokens(rank[places], order)],
        )
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary())
        names = [c.split()[0] for c in CODED.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(f, k) for f, k in zip(fields, kinds)], names=names)

    def run(batches):
        cache, end = WordHashes(), np.array([END], np.uint64)
        part, count = TaskContext.get().partitionId() << 24, 0
        open_: dict = {False: [[], 0], True: [[], 0]}
        for batch in small_batches(batches, 3):
            for doc_id, held, dev, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = np.array([cache[w] for w in text.lower().split()], np.uint64) if text else end[:0]
                rows = open_[dev]
                rows[0].append((doc_id, held, np.concatenate((words, end))))
                rows[1] += len(text or b"") + 8
                if rows[1] > CHUNK_BYTES:
                    yield emit(part + count, dev, rows[0])
                    count, open_[dev] = count + 1, [[], 0]
        for dev, (rows, _) in open_.items():
            if rows:
                yield emit(part + count, dev, rows)
                count += 1

    return map_arrow(docs, run, CODED)


def _pack_tokens(ranks: np.ndarray, order: np.ndarray) -> bytes:
    """Ranks of the tokens and the place of each rank in the sorted words, as two packed arrays."""
    first, second = _pack(order.astype(np.uint32)), _pack(ranks.astype(np.uint32))
    return len(first).to_bytes(4, "little") + first + second


def _unpack_tokens(data: bytes) -> np.ndarray:
    cut = 4 + int.from_bytes(data[:4], "little")
    return _unpack(data[4:cut], "u4")[_unpack(data[cut:], "u4")].astype(np.int64)


def _owner(keys: np.ndarray, owners: int) -> np.ndarray:
    """Owners hold ranges, so sorted keys are in the order of their owners."""
    return ((keys >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)


def _requests(chunk: int, keys: np.ndarray, train: np.ndarray, dev: np.ndarray, owners: int) -> pa.RecordBatch:
    """A block for each owner that holds any of the keys: never more rows than keys, however many owners there are."""
    owner = _owner(keys, owners)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1, [len(keys)]))
    blocks = [slice(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]
    part = lambda x, f: pa.array([f(x[b]) for b in blocks], pa.binary())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([chunk] * len(blocks), pa.int64()),
            pa.array([int(owner[b.start]) for b in blocks], pa.int32()),
            part(keys, _pack_keys),
            part(train.astype(np.uint32), _pack),
            part(dev.astype(np.uint32), _pack),
        ],
        names=["chunk", "owner", "keys", "train", "dev"],
    )


REQUEST = "chunk long, owner int, keys binary, train binary, dev binary"


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """What one owner tells each chunk: the corpus counts of the chunk's keys."""
    blocks = [_unpack_keys(k) for k in rows["keys"]]
    keys, place = np.unique(np.concatenate(blocks), return_inverse=True)
    sums = []
    for name in ("train", "dev"):
        own = np.concatenate([_unpack(x, "u4") for x in rows[name]])
        sums.append(np.bincount(place, weights=own, minlength=len(keys)).astype(np.uint64))
    ends = np.cumsum([len(b) for b in blocks])
    out = {"chunk": rows["chunk"], "owner": rows["owner"]}
    for name, total in zip(("train", "dev"), sums):
        each = np.split(total[place], ends[:-1])
        out[name] = [_pack(x) for x in each]
    out["n_distinct"] = [int((sums[0] > 0).sum())] + [0] * (len(rows) - 1)
    return pd.DataFrame(out)


def exchange(requests: DataFrame, tag: str) -> DataFrame:
    """(chunk, owner, train, dev, n_distinct): an owner's answers; n_distinct once per owner."""
    ship(requests.sparkSession)
    answers = requests.groupBy("owner").applyInPandas(_answer, "chunk long, owner int, train binary, dev binary, n_distinct long")
    return materialise(answers, tag)


def _gathered(answers: DataFrame, name: str) -> DataFrame:
    return answers.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("owner", "train", "dev"))).alias(name))


def _counts(answers: list) -> tuple[np.ndarray, np.ndarray]:
    """Counts in the order of the chunk's sorted keys."""
    return tuple(np.concatenate([_unpack(a[name], "u8") for a in answers]).astype(np.float64) for name in ("train", "dev"))


def _rows(batches):
    """The rows of Arrow batches as dictionaries, one at a time, as each holds a whole chunk."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


class Chunk:
    """One chunk's tokens, flags and keys."""

    def __init__(self, row: dict):
        self.number, self.ids, self.held, self.dev = row["chunk"], row["ids"], row["held"], row["dev"]
        self.sizes = _unpack(row["sizes"], "u4").astype(np.int64)
        self.words = _unpack_keys(row["words"])
        self.tokens = _unpack_tokens(row["tokens"])
        self.train = np.repeat(~np.array(self.held), self.sizes)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))

    def own_counts(self, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        train = np.bincount(place, weights=self.train, minlength=n)
        return train, train if self.dev else np.zeros(n)

    def bigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct keys of the chunk's bigrams, and the place of each token's bigram among them."""
        end = int(np.searchsorted(self.words, np.uint64(END)))
        self.context = np.concatenate(([end], self.tokens[:-1]))
        pairs, place = np.unique(self.context * len(self.words) + self.tokens, return_inverse=True)
        left, right = np.divmod(pairs, len(self.words))
        keys = mix64(mix64(self.words[left] + _A) * _A + self.words[right])
        keys, again = np.unique(keys, return_inverse=True)
        return keys, again[place]


def _word_requests(chunks: DataFrame, owners: int) -> DataFrame:
    def run(batches):
        for row in _rows(batches):
            c = Chunk(row)
            yield _requests(c.number, c.words, *c.own_counts(c.tokens, len(c.words)), owners)

    return map_arrow(chunks, run, REQUEST)


def _bigram_requests(chunks: DataFrame, owners: int) -> DataFrame:
    def run(batches):
        for row in _rows(batches):
            c = Chunk(row)
            keys, place = c.bigrams()
            yield _requests(c.number, keys, *c.own_counts(place, len(keys)), owners)

    return map_arrow(chunks, run, REQUEST)


def _bucket(count: np.ndarray) -> np.ndarray:
    """0 for no occurrence, else one more than the binary logarithm's whole part."""
    return np.where(count > 0, np.minimum(BUCKETS - 1, np.floor(np.log2(np.maximum(count, 1))) + 1), 0).astype(np.int64)


def _bins(p: np.ndarray, p0: float) -> np.ndarray:
    """Bins of log(p / p0), -1 where p is 0."""
    logs = np.log(np.maximum(p, 1e-300) / p0)
    return np.where(p > 0, np.clip(np.round(logs / BIN) + ZERO_BIN, 0, LAST_BIN), -1).astype(np.int64)


def _histogram(joined: DataFrame, n_train: int, n_dev: int, n_words: int) -> DataFrame:
    """(bucket, bin1, bin2, n) over the tokens of held-out chunks, by the counts of the rest."""

    def run(batches):
        for row in _rows(batches):
            c = Chunk(row)
            train, dev = _counts(row["word_counts"])
            rest = train - dev
            _, place = c.bigrams()
            pair_train, pair_dev = _counts(row["pair_counts"])
            pair = (pair_train - pair_dev)[place]
            context = rest[c.context]
            p1 = rest[c.tokens] / max(1, n_train - n_dev)
            p2 = np.where(context > 0, pair / np.maximum(context, 1), 0)
            p0 = 1 / (n_words + 1)
            cell = (_bucket(context) * 1000 + _bins(p1, p0) + 1) * 1000 + _bins(p2, p0) + 1
            cells, n = np.unique(cell, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n.astype(np.int64))], names=["cell", "n"])

    return map_arrow(joined, run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def mixture(cells: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Weights (BUCKETS, 3) of uniform, unigram and bigram, by expectation-maximisation in each bucket.

    Each bucket starts from weights of the buckets together, and one count of
    these is added, so a bucket without held-out tokens keeps them.
    """
    bucket, bin1, bin2 = cells // 1_000_000, cells // 1000 % 1000 - 1, cells % 1000 - 1
    ratio = lambda b: np.where(b >= 0, np.exp((b - ZERO_BIN) * BIN), 0.0)
    p = np.stack([np.ones(len(cells)), ratio(bin1), ratio(bin2)], axis=1)

    def fit(rows, start, prior):
        weights = start
        for _ in range(EM_ROUNDS):
            part = p[rows] * weights
            part *= (counts[rows] / part.sum(1))[:, None]
            weights = part.sum(0) + prior
            weights = weights / weights.sum()
        return weights

    every = np.array([0.05, 0.45, 0.5])
    shared = fit(np.arange(len(cells)), every, every) if len(cells) else every
    out = np.tile(shared, (BUCKETS, 1))
    for b in range(BUCKETS):
        rows = np.flatnonzero(bucket == b)
        if len(rows):
            out[b] = fit(rows, shared, shared)
    # Without occurrences of the context there is no bigram estimate.
    out[0, 2] = 0.0
    out[0] /= out[0].sum()
    return out


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(joined: DataFrame, weights: np.ndarray, n_train: int, n_words: int) -> DataFrame:
    def run(batches):
        for row in _rows(batches):
            c = Chunk(row)
            count, _ = _counts(row["word_counts"])
            _, place = c.bigrams()
            pair = _counts(row["pair_counts"])[0][place]
            own, context = count[c.tokens], count[c.context]
            w = weights[_bucket(context)]
            p = w[:, 0] / (n_words + 1) + w[:, 1] * own / max(1, n_train) + w[:, 2] * pair / np.maximum(context, 1)
            base = np.log10(own + 1) - np.log10(n_train + n_words + 1)
            add = lambda x: np.add.reduceat(x, c.starts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(c.ids, pa.int64()),
                    pa.array(c.held, pa.bool_()),
                    pa.array(c.sizes),
                    pa.array(add((own > 0).astype(np.int64))),
                    pa.array(np.full(len(c.sizes), n_train)),
                    pa.array(add(base)),
                    pa.array(add(np.log10(p))),
                ],
                names=[x.split()[0] for x in SCORED.split(", ")],
            )

    return map_arrow(joined, run, SCORED)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from documents outside the test fold and scores all of
    them, by whole texts. Null text counts as empty, and an empty text is one
    end token; a null id falls in the fold of ''. Ids pass through, repeated
    ones too, and repeated rows all count. An empty table gives no rows.
    Only the two named columns are read.
    """
    id_ = F.col(id_col)
    held = fold(id_, TEST_FOLDS) == TEST_FOLD
    dev = ~held & (F.crc32(F.concat(F.lit("dev:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary")) % DEV_FOLDS == 0)
    rows = docs.select(id_.cast("long").alias("doc_id"), held.alias("held_out"), dev.alias("dev"), F.col(text_col).cast("binary").alias("text"))
    chunks = materialise(coded(rows), "coded")
    total = chunks.agg(F.sum("n_tokens").alias("n"), F.sum("n_train").alias("train"), F.sum(F.when(F.col("dev"), F.col("n_train"))).alias("dev")).first()
    n_train, n_dev = total["train"] or 0, total["dev"] or 0
    owners = max(8, -(-(total["n"] or 0) // KEYS_PER_OWNER))
    words = exchange(_word_requests(chunks, owners), "words")
    n_words = words.agg(F.sum("n_distinct")).first()[0] or 0
    pairs = exchange(_bigram_requests(chunks, owners), "pairs")
    joined = chunks.join(_gathered(words, "word_counts"), "chunk").join(_gathered(pairs, "pair_counts"), "chunk")
    # At most BUCKETS * 194**2 rows of two numbers, 29 MB, however large the corpus is.
    bins = _histogram(joined.where("dev"), n_train, n_dev, n_words).toArrow()
    cells, counts = (bins.column(c).to_numpy().astype(np.int64) for c in ("cell", "n"))
    order = np.argsort(cells)
    weights = mixture(cells[order], counts[order].astype(np.float64))
    return _scores(joined, weights, n_train, n_words)
