"""Chroma audio fingerprints for columns of WAV recordings.

A recording is cut into overlapping frames, and each frame's spectrum is
folded into twelve pitch classes. Sixteen filters, each comparing two sums
of a window of this image (read from its integral image), give two bits each:
32 bits for every position. Queries are indexed by three bytes of each item,
in four ways; equal keys vote for the offset between two recordings, and every
offset in such a histogram is judged by its bit errors over the whole overlap.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_arrow
from .common import hot_join, materialise, small_batches

# Fixed values of the WAV format: kinds of samples.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
RATE, FRAME, HOP = 4000, 1024, 256
CLASSES = 12
LOW_HZ, HIGH_HZ = 55.0, 1760.0
WIDTH = 8
#: An alignment: at least so many positions overlap, with at most this share of different bits.
LEAST_OVERLAP, MOST_ERRORS = 16, 0.10
QUERY_MODULUS = 50
#: What a row of packed recordings holds, at most (a longer recording is a row of its own).
BLOCK_ROWS, BLOCK_BYTES = 4096, 1 << 20
#: The item of a silent window: it gives no vote.
SILENCE = 0
#: Keys of an item leave out one byte each.
MASKS = tuple(np.uint32(0xFFFFFFFF ^ 0xFF << 8 * i) for i in range(4))
#: Votes and items looked at together, at most.
CHUNK = 1 << 20


def decode_wav(data: bytes | None) -> tuple[int, np.ndarray]:
    """(rate, mono samples in -1..1) of WAV data: PCM of 8, 16, 24 or 32 bits or floats of 32 or 64, plain or extensible.

    Anything else is silence of no length. Floats that are no numbers are 0.
    """
    none = (RATE, np.zeros(0, np.float32))
    if not data or len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return none
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            form = struct.unpack_from("<HHIIHH", body)
            if form[0] == EXTENSIBLE and len(body) >= 26:
                form = (*struct.unpack_from("<H", body, 24), *form[1:])
        elif name == b"data" and form:
            tag, channels, rate, _, _, bits = form
            step = bits // 8 * channels
            if bits not in {PCM: (8, 16, 24, 32), FLOAT: (32, 64)}.get(tag, ()) or not step or not rate:
                return none
            body = body[: len(body) // step * step]
            if tag == FLOAT:
                wave = np.clip(np.nan_to_num(np.frombuffer(body, f"<f{bits // 8}"), posinf=0, neginf=0), -1, 1).astype(np.float32)
            elif bits == 8:
                wave = (np.frombuffer(body, np.uint8).astype(np.float32) - 128) / 128
            elif bits == 24:
                raw = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
                wave = ((raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16) << 8).astype(np.float32) / 2**31
            else:
                wave = np.frombuffer(body, f"<i{bits // 8}").astype(np.float32) / 2 ** (bits - 1)
            return rate, wave.reshape(-1, channels).mean(1)
        at += 8 + size + size % 2
    return none


def encode_wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    """8-bit mono PCM."""
    body = np.clip(np.round(samples * 127 + 128), 0, 255).astype(np.uint8).tobytes()
    form = struct.pack("<HHIIHH", 1, 1, rate, rate, 1, 8)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", len(body)) + body


def _fold() -> np.ndarray:
    """(bins, 12) weights that send each FFT bin to its pitch class."""
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    inside = (hz >= LOW_HZ) & (hz <= HIGH_HZ)
    pitch = np.round(12 * np.log2(np.maximum(hz, 1.0) / 440.0)).astype(int) % CLASSES
    fold = np.zeros((len(hz), CLASSES), np.float32)
    fold[np.flatnonzero(inside), pitch[inside]] = 1
    return fold


_FOLD, _WINDOW = _fold(), np.hanning(FRAME).astype(np.float32)


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """(frames, 12): energy per pitch class, each frame scaled to length one."""
    if rate != RATE and len(samples):
        times = np.arange(int(len(samples) * RATE / rate)) * (rate / RATE)
        samples = np.interp(times, np.arange(len(samples)), samples).astype(np.float32)
    if len(samples) < FRAME:
        return np.zeros((0, CLASSES), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    out = []
    for at in range(0, len(frames), 4096):
        power = np.abs(np.fft.rfft(frames[at : at + 4096] * _WINDOW, axis=1)).astype(np.float32) ** 2
        energy = power @ _FOLD
        out.append(energy / np.maximum(np.linalg.norm(energy, axis=1, keepdims=True), 1e-6))
    return np.concatenate(out)


def _filters() -> list[tuple]:
    """Sixteen filters from a rule: six shapes in turn, at pitch classes and heights spread over the octave."""
    return [(i % 6, i * 5 % CLASSES, 2 + i * 7 % 9, WIDTH if i % 3 else WIDTH // 2) for i in range(16)]


FILTERS = _filters()
#: Logarithms of the ratio of the two sums that part the four levels of a filter.
CUTS = (-0.2, 0.0, 0.2)
GRAY = np.array([0, 1, 3, 2], np.uint32)


def fingerprint(image: np.ndarray) -> np.ndarray:
    """One 32-bit integer for each position of a chroma image; a silent window gives ``SILENCE``."""
    n = len(image) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    # Pitch classes are circular: two octaves side by side let a window wrap around.
    total = np.zeros((len(image) + 1, 2 * CLASSES + 1))
    total[1:, 1:] = np.concatenate([image, image], axis=1).cumsum(0).cumsum(1)

    def area(x, y, w, h):
        rows = np.arange(n) + x
        return total[rows + w, y + h] - total[rows, y + h] - total[rows + w, y] + total[rows, y]

    out = np.zeros(n, np.uint32)
    for shape, y, h, w in FILTERS:
        half_h, half_w, third_h, third_w = h // 2, w // 2, max(1, h // 3), max(1, w // 3)
        whole = area(0, y, w, h)
        if shape == 0:
            a, b = whole, area(0, (y + 6) % CLASSES, w, h)
        elif shape == 1:
            a = area(0, y, w, half_h)
            b = whole - a
        elif shape == 2:
            a = area(0, y, half_w, h)
            b = whole - a
        elif shape == 3:
            a = area(0, y, half_w, half_h) + area(half_w, y + half_h, w - half_w, h - half_h)
            b = whole - a
        elif shape == 4:
            a = area(0, y + third_h, w, max(1, h - 2 * third_h))
            b = whole - a
        else:
            a = area(third_w, y, max(1, w - 2 * third_w), h)
            b = whole - a
        level = np.digitize(np.log((1 + np.maximum(a, 0)) / (1 + np.maximum(b, 0))), CUTS)
        out = out << np.uint32(2) | GRAY[level]
    out[area(0, 0, WIDTH, CLASSES) < 1e-6] = SILENCE
    return out


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, float]:
    """(overlap, share of different bits) with position i of ``a`` against i + offset of ``b``."""
    low, high = max(0, -offset), min(len(a), len(b) - offset)
    if high <= low:
        return 0, 1.0
    differ = np.bitwise_count(a[low:high] ^ b[low + offset : high + offset]).sum()
    return high - low, float(differ) / (32 * (high - low))


def fingerprints(recordings: DataFrame, id_col: str, audio_col: str) -> DataFrame:
    """(rec_id, n_items, digest, items) of each recording; items are little-endian 32-bit integers.

    Null audio, audio that ``decode_wav`` does not know and audio that is too short have no items.
    """

    def run(batches):
        for batch in small_batches(batches, 1):
            items = []
            for data in batch.column(1).to_pylist():
                rate, samples = decode_wav(data)
                items.append(fingerprint(chroma(samples, rate)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) // 4 for x in items], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(x) for x in items], pa.binary()),
                    pa.array(items, pa.binary()),
                ],
                names=["rec_id", "n_items", "digest", "items"],
            )

    rows = recordings.select(F.col(id_col).cast("long").alias("rec_id"), F.col(audio_col).alias("audio"))
    return map_arrow(rows, run, "rec_id long, n_items long, digest binary, items binary")


def _blocks(classes: DataFrame, prefix: str) -> DataFrame:
    """Recordings packed in rows of at most ``BLOCK_ROWS`` and about ``BLOCK_BYTES``: (ids, sizes, items)."""

    def run(batches):
        for batch in small_batches(batches, 1, BLOCK_BYTES):
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                items = part.column(1).to_pylist()
                sizes = np.array([len(x) // 4 for x in items], np.int32)
                ids = np.array(part.column(0).to_pylist(), np.int64)
                packed = [pa.array([x], pa.binary()) for x in (ids.tobytes(), sizes.tobytes(), b"".join(items))]
                yield pa.RecordBatch.from_arrays(packed, names=[f"{prefix}ids", f"{prefix}sizes", f"{prefix}items"])

    return map_arrow(classes.select("rec_id", "items"), run, ", ".join(f"{prefix}{c} binary" for c in ("ids", "sizes", "items")))


def _unpacked(ids: bytes, sizes: bytes, items: bytes) -> list[tuple[int, np.ndarray]]:
    cuts = np.frombuffer(sizes, np.int32).astype(np.int64).cumsum()[:-1]
    return list(zip(np.frombuffer(ids, np.int64).tolist(), np.split(np.frombuffer(items, "<u4"), cuts)))


class Index:
    """Recordings, their items end to end; if ``keyed``, with the sorted keys of all items and the place of each."""

    def __init__(self, recordings: list[tuple[int, np.ndarray]], keyed: bool = True):
        self.ids = np.array([i for i, _ in recordings], np.int64)
        self.sizes = np.array([len(x) for _, x in recordings], np.int64)
        self.starts = self.sizes.cumsum() - self.sizes
        self.items = np.concatenate([x for _, x in recordings]) if recordings else np.zeros(0, np.uint32)
        self.owner = np.repeat(np.arange(len(recordings)), self.sizes)
        self.heard = np.flatnonzero(self.items != SILENCE)
        if keyed:
            keys = np.concatenate([_keys(self.items[self.heard], k) for k in range(len(MASKS))])
            order = np.argsort(keys)
            self.keys, self.places = keys[order], np.tile(self.heard, len(MASKS))[order]


def _keys(items: np.ndarray, mask: int) -> np.ndarray:
    return (items & MASKS[mask]).astype(np.uint64) | np.uint64(mask << 32)


def _ragged(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count, end to end."""
    return np.arange(counts.sum()) - np.repeat(counts.cumsum() - counts, counts)


def _runs(sizes: np.ndarray):
    """(first, last + 1) of runs of places with about ``CHUNK`` in all."""
    ends, start = sizes.cumsum(), 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHUNK, side="right")))
        yield start, stop
        start = stop


def histograms(index: Index, other: Index):
    """(query, recording, offset) arrays: the offsets that equal keys vote for, without repeats in an array."""
    heard = other.heard
    span, back = int(index.sizes.max(initial=0) + other.sizes.max(initial=0)) + 1, int(index.sizes.max(initial=0))
    for mask in range(len(MASKS)):
        keys = _keys(other.items[heard], mask)
        low, high = np.searchsorted(index.keys, keys), np.searchsorted(index.keys, keys, side="right")
        hit = np.flatnonzero(high > low)
        for a, b in _runs((high - low)[hit]):
            at = hit[a:b]
            counts = high[at] - low[at]
            mine = index.places[np.repeat(low[at], counts) + _ragged(counts)]
            theirs = np.repeat(heard[at], counts)
            query, rec = index.owner[mine], other.owner[theirs]
            offset = theirs - other.starts[rec] - mine + index.starts[query]
            bins = np.sort((query * len(other.ids) + rec) * span + offset + back)
            bins = bins[np.append(True, bins[1:] != bins[:-1])[: len(bins)]]
            pair = bins // span
            yield pair // len(other.ids), pair % len(other.ids), bins % span - back


def _verified(index: Index, other: Index, query, rec, offset) -> tuple:
    """(query, recording, offset, overlap, bit error) arrays of the alignments that count.

    Positions are compared in turn; every few of them, alignments with more
    different bits than the whole overlap allows are put aside, so all that
    count are compared to their end.
    """
    low = np.maximum(0, -offset)
    overlap = np.minimum(index.sizes[query], other.sizes[rec] - offset) - low
    # Longest first, so that those which go on are in front.
    left = np.flatnonzero(overlap >= LEAST_OVERLAP)
    left = left[np.argsort(-overlap[left], kind="stable")]
    shorter = -overlap[left]
    a, b = (index.starts[query] + low)[left], (other.starts[rec] + low + offset)[left]
    errors = np.zeros(len(left), np.int64)
    k = 0
    while len(left) and k < -shorter[0]:
        live = int(np.searchsorted(shorter, -k))
        errors[:live] += np.bitwise_count(index.items[a[:live] + k] ^ other.items[b[:live] + k])
        k += 1
        if k % 12 == 0:
            fits = errors <= MOST_ERRORS * 32 * -shorter + 1e-6
            left, shorter, a, b, errors = left[fits], shorter[fits], a[fits], b[fits], errors[fits]
    fits = errors <= MOST_ERRORS * 32 * -shorter + 1e-6
    left, errors = left[fits], errors[fits]
    return query[left], rec[left], offset[left], overlap[left], errors / (32 * overlap[left])


def best_alignments(index: Index, other: Index) -> tuple:
    """(query, recording, offset, overlap, bit error) arrays: the least of all voted alignments of each pair that count."""
    found = [(np.zeros(0, np.int64),) * 4 + (np.zeros(0),)]
    found += [_verified(index, other, *voted) for voted in histograms(index, other)]
    query, rec, offset, overlap, errors = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((offset, -overlap, errors, rec, query))
    query, rec, offset, overlap, errors = (x[order] for x in (query, rec, offset, overlap, errors))
    first = np.ones(len(query), bool)
    first[1:] = (query[1:] != query[:-1]) | (rec[1:] != rec[:-1])
    return index.ids[query[first]], other.ids[rec[first]], offset[first], overlap[first], errors[first]


def align(classes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, rec_id, offset, overlap, bit_error): the best alignment of each query class with each other class.

    The best has the lowest bit error, then the longest overlap, then the
    lowest offset. Blocks of queries, as indexes, meet blocks of classes, and
    all votes of all keys count, however common a key is. An alignment is
    found if one of its items has all its errors in one byte; of the
    alignments with 10 % errors anywhere, a share of 0.78**overlap has none
    (2 % at the least overlap). Silent windows give no votes, so what shares
    nothing but silence has no alignment.
    """
    spark = classes.sparkSession
    # Few and full blocks of queries: every class is looked up once for each of them.
    parts = max(4 * spark.sparkContext.defaultParallelism, -(-classes.count() // BLOCK_ROWS))
    few = max(1, -(-queries.count() // BLOCK_ROWS))
    pairs = _blocks(queries.repartition(few), "a_").crossJoin(_blocks(classes.repartition(parts), "b_"))

    def run(batches):
        key, index = None, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != key:
                    key, index = row[:3], Index(_unpacked(*row[:3]))
                query, rec, offset, overlap, error = best_alignments(index, Index(_unpacked(*row[3:]), keyed=False))
                other = query != rec
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query[other]), pa.array(rec[other]), pa.array(offset[other].astype(np.int32)), pa.array(overlap[other]), pa.array(error[other])],
                    names=["query", "rec_id", "offset", "overlap", "bit_error"],
                )

    return map_arrow(pairs, run, "query long, rec_id long, offset int, overlap long, bit_error double")


def match_recordings(recordings: DataFrame, id_col: str = "rec_id", audio_col: str = "audio") -> DataFrame:
    """One row per recording: rec_id, n_items, class_id, is_query, n_links, best_id, best_offset, best_error.

    Recordings with equal fingerprints are one class, named by its lowest
    id. The recordings whose id is divisible by 50 are the queries; each
    query's class is aligned with every other class. ``n_links`` counts the
    classes that a query aligns with, and the best of them (lowest error,
    then id) is given with its offset; other rows have nulls there.
    Recordings without items and null ids are classes of their own and match
    nothing. Repeated ids share a class if their audio is the same.
    """
    prints = materialise(fingerprints(recordings, id_col, audio_col), "prints")
    usable = prints.where("rec_id is not null and n_items > 0")
    is_query = F.col("rec_id") % QUERY_MODULUS == 0
    classes = materialise(
        usable.groupBy("digest").agg(
            F.min("rec_id").alias("rec_id"), F.max(is_query).alias("asked"), F.first("items").alias("items"), F.count("*").alias("copies")
        ),
        "audio",
    )
    found = align(classes, classes.where("asked"))
    best = F.min(F.struct("bit_error", "rec_id", "offset"))
    linked = found.groupBy("query").agg(F.count("*").alias("n"), best.alias("best"))
    labels = classes.join(linked, F.col("rec_id") == F.col("query"), "left").select(
        F.col("digest").alias("class"), F.col("rec_id").alias("class_id"), "n", "best", "copies"
    )
    # A null id or a recording without items is of no shared class.
    digest = F.when(F.col("rec_id").isNotNull() & (F.col("n_items") > 0), F.col("digest"))
    rows = hot_join(prints.select("rec_id", "n_items", digest.alias("digest")), materialise(labels, "matches"), "digest", "class", "rec_id", "copies", "left")
    asked = F.coalesce(is_query, F.lit(False))
    return rows.select(
        "rec_id",
        "n_items",
        F.coalesce("class_id", "rec_id").alias("class_id"),
        asked.alias("is_query"),
        F.when(asked, F.coalesce("n", F.lit(0).cast("long"))).alias("n_links"),
        F.when(asked, F.col("best.rec_id")).alias("best_id"),
        F.when(asked, F.col("best.offset")).alias("best_offset"),
        F.when(asked, F.col("best.bit_error")).alias("best_error"),
    )


def rendered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(rec_id, audio): each vector played as a tune, one note of 64 ms per number.

    The tables hold no audio, so this makes recordings of known likeness from
    vectors. A number picks one of 24 semitones and its loudness; null
    numbers are rests and a null vector is null audio.
    """

    def run(batches):
        times = np.arange(HOP) / RATE
        for batch in batches:
            out = []
            for vector in batch.column(1).to_pylist():
                if vector is None:
                    out.append(None)
                    continue
                v = np.array([np.nan if x is None else x for x in vector], np.float64)
                notes = np.clip(np.floor(np.nan_to_num(v) * 20) + 12, 0, 23)
                loud = np.where(np.isfinite(v), 0.4 + 0.4 * np.minimum(1, np.abs(np.nan_to_num(v))), 0.0)
                hz = 220.0 * 2 ** (notes / 12)
                out.append(encode_wav((loud[:, None] * np.sin(2 * np.pi * hz[:, None] * times)).reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["rec_id", "audio"])

    rows = vectors.select(F.col(id_col).cast("long").alias("rec_id"), F.col(vector_col).alias("vector"))
    return map_arrow(rows, run, "rec_id long, audio binary")
