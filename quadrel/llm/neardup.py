"""Near-duplicate groups: SuperMinHash signatures, banding, verification, union-find.

1. Each text becomes the set of 64-bit hashes of its word shingles, with a
   SuperMinHash signature cut into bands, and a digest of the whole set.
2. Texts with equal sets are one class; only its lowest id goes on.
3. Classes that share a band are candidates. In each bucket every class is
   paired with the lowest one, so a bucket gives one pair fewer than it has
   classes.
4. Pairs whose signatures agree too little for the threshold (by five
   standard deviations) are put aside, the others are confirmed on full
   sets, and confirmed links make components.
5. All classes that were paired with one and the same lowest class form a
   group; every two classes that share a band are in some group together.
   Groups that still hold several components are finished: members outside
   the group's main component meet all its members, in pairs of blocks of
   bounded size. Signatures first tell which members may have a link at all;
   those are compared on full sets, and only links that join components
   leave a block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_arrow, ship
from .common import hot_join, materialise, small_batches, with_size_checked
from .graph import components

BANDS, ROWS = 32, 5
SLOTS = BANDS * ROWS
BLOCK = 512
_CHUNK_BYTES = 1 << 20
_MOST_CACHED = 50_000

_A, _B, _S = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> _S)) * _A
    x = (x ^ (x >> _S)) * _B
    return x ^ (x >> _S)


class WordHashes(dict):
    """64-bit hash of each word seen, cleared when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) > _MOST_CACHED:
                self.clear()
            self[word] = h
        return h


def shingles(text: bytes | None, cache: WordHashes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the ``words``-word shingles of a UTF-8 text, A-Z lower-cased.

    ``bytes.lower`` and ``bytes.split`` know ASCII only, as the contract asks.
    A text of fewer words is one shingle; one without words has none.
    """
    parts = text.lower().split() if text else []
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    h = np.array([cache[w] for w in parts], dtype=np.uint64)
    size = min(words, len(h))
    n = len(h) - size + 1
    out = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        out = mix64(out * _A + h[i : i + n])
    return np.unique(out)


def super_minhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures (len(sets), slots) of hash sets; at most 255 slots.

    Every element walks through its own random permutation of the slots. At
    step j it offers the value j + r, r in [0, 1), to the slot at place j of
    the permutation (here j fills the top 8 bits, r the lower 56). All
    elements take a step together; a set stops as soon as all its slots hold
    values below the next j, so large sets stop after the first step.
    """
    sig = np.full((len(sets), slots), np.iinfo(np.uint64).max, dtype=np.uint64)
    sizes = np.array([len(s) for s in sets])
    if not sizes.sum():
        return sig
    flat = sig.reshape(-1)
    elem, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    perm = None
    for j in range(slots):
        step = mix64(elem + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        value = (step >> np.uint64(8)) | np.uint64(j << 56)
        pick = j + ((mix64(step) >> np.uint64(32)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            place = pick
        else:
            lines = np.arange(len(elem))
            place = perm[lines, pick]
            perm[lines, pick] = perm[:, j]
            perm[:, j] = place
        np.minimum.at(flat, owner * slots + place, value)
        live = (sig >= np.uint64((j + 1) << 56)).any(1) & (sizes > 0)
        stay = live[owner]
        if not stay.any():
            break
        if j == 0:
            elem, owner, pick = elem[stay], owner[stay], pick[stay]
            perm = np.tile(np.arange(slots, dtype=np.uint8), (len(elem), 1))
            perm[np.arange(len(elem)), pick] = 0
            perm[:, 0] = pick
        elif stay.sum() < 0.7 * len(stay):
            elem, owner, perm = elem[stay], owner[stay], perm[stay]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, different bands apart."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _B, (len(sig), BANDS))
    for r in range(ROWS):
        key = mix64(key * _A + parts[:, :, r])
    return key.view(np.int64)


def _chunks(texts: list):
    """Runs of rows of a bounded number of bytes."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size > _CHUNK_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, digest, keys, sig) of every whole text; sig has the low byte of each slot."""

    def run(batches):
        cache = WordHashes()
        for batch in small_batches(batches, 1, _CHUNK_BYTES):
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in _chunks(texts):
                sets = [shingles(t, cache, words) for t in texts[a:b]]
                sig = super_minhash(sets)
                keys = band_keys(sig)
                offsets = np.arange(0, (b - a + 1) * BANDS, BANDS, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1))),
                        pa.array([x.astype(np.uint8).tobytes() for x in sig], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "digest", "keys", "sig"],
                )

    return map_arrow(docs, run, "doc_id long, n_shingles long, digest binary, keys array<long>, sig binary")


#: Bits of the bitmap that preselects documents, at most: 8 MB.
MOST_BITS = 1 << 26


def full_sets(texts: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(id, shingles) of the documents with the ids in ``wanted``: sorted hashes as little-endian bytes.

    A bitmap of hashed ids, of bounded size, lets most other documents fall
    away where they are read, so no texts are shuffled; what it lets through
    by chance goes at the join of ids that follows. Where ids are too many
    for the bitmap to tell them apart, texts are joined with them first.
    """
    n = wanted.count()
    asked = wanted.select(F.col("id").alias("wanted"))
    if 8 * n > MOST_BITS:
        found = texts.join(asked, F.col("doc_id") == F.col("wanted"), "left_semi").select(F.col("doc_id").alias("id"), "text")
        return _shingled(found, words)
    bits = min(MOST_BITS, 1 << max(10, (16 * n).bit_length()))
    slot = F.pmod(F.xxhash64("id"), F.lit(bits))
    marked = wanted.select(slot.alias("slot")).groupBy(F.shiftright("slot", 5).alias("at"))
    rows = marked.agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(slot, 32) as int))")).alias("mask")).collect()
    bitmap = np.zeros(bits // 32, np.uint64)
    for r in rows:
        bitmap[r["at"]] = r["mask"]
    held = texts.sparkSession.sparkContext.broadcast(bitmap)

    rows = texts.where("doc_id is not null").select(F.col("doc_id").alias("id"), "text").withColumn("slot", slot)
    found = _shingled(rows.select("id", "text", "slot"), words, held)
    return found.join(asked, F.col("id") == F.col("wanted"), "left_semi")


def _shingled(rows: DataFrame, words: int, held=None) -> DataFrame:
    """(id, shingles) of rows of (id, text), or of those of (id, text, slot) whose slot is marked in the bitmap ``held``."""

    def run(batches):
        cache = WordHashes()
        for batch in small_batches(batches, 1, 4 * _CHUNK_BYTES):
            if held is not None:
                at = batch.column(2).to_numpy(zero_copy_only=False)
                batch = batch.take(pa.array(np.flatnonzero(held.value[at >> 5] >> (at & 31).astype(np.uint64) & np.uint64(1))))
            ids, data = batch.column(0), batch.column(1).to_pylist()
            for a, b in _chunks(data):
                packed = [shingles(t, cache, words).tobytes() for t in data[a:b]]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(packed, pa.binary())], names=["id", "shingles"])

    return map_arrow(rows, run, "id long, shingles binary")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted sets."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b"))

    def run(batches):
        for batch in small_batches(batches, 2, 4 * _CHUNK_BYTES):
            rows = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            hit = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in rows]
            yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")
    return map_arrow(joined, run, "a long, b long")


def least_agreement(percent: int) -> float:
    """Share of equal slots that pairs at the threshold exceed, but for a chance of about 3e-7."""
    t = percent / 100
    return t - 5 * (t * (1 - t) / SLOTS) ** 0.5


def _slots(sigs) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint8).reshape(len(sigs), SLOTS)


def _plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and signatures allow a link."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    near = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(near).select("a", "b", "sig_a", "sig_b")
    least = least_agreement(percent)

    def run(batches):
        for batch in batches:
            x, y = (_slots(batch.column(i).to_pylist()) for i in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(1) >= least))

    return map_arrow(joined, run, "a long, b long")


def _blocks(placed: DataFrame) -> DataFrame:
    """Rows of ``placed`` (center, id, component, ...) dealt to pairs of blocks of their group, one pair to a task.

    A group's outer members (``outer``, those outside its most frequent
    component) are cut into blocks, and so are all its members. An outer row
    goes to every block of members, and any row to every block of outer
    ones. Groups of one component fall away; a group that is nearly all one
    component is hardly multiplied.
    """
    count = placed.groupBy("center", "component").agg(F.count("*").alias("n"))
    group = count.groupBy("center").agg(
        F.sum("n").alias("all"), F.max("n").alias("most"), F.max_by("component", F.struct("n", "component")).alias("main")
    )
    open_ = group.where("most < all").select(
        F.col("center").alias("open_center"),
        "main",
        F.col("all").alias("rows"),
        F.ceil(F.col("all") / BLOCK).cast("int").alias("member_parts"),
        F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("outer_parts"),
    )
    rows = hot_join(placed, materialise(open_, "open"), "center", "open_center", "id", "rows")
    member_part = F.pmod(F.xxhash64("id"), F.col("member_parts")).cast("int")
    outer_part = F.pmod(F.xxhash64("id"), F.col("outer_parts")).cast("int")
    spread = lambda x, n: F.explode(F.sequence(F.lit(0), n - 1)).alias(x)
    kept = [*placed.columns, (F.col("component") != F.col("main")).alias("stray")]
    outer = rows.where("component != main").select(*kept, F.lit(True).alias("outer"), outer_part.alias("o"), spread("m", F.col("member_parts")))
    member = rows.select(*kept, F.lit(False).alias("outer"), spread("o", F.col("outer_parts")), member_part.alias("m"))
    return outer.unionByName(member).repartition("center", "o", "m")


def _candidates(rows: pd.DataFrame, percent: int):
    """For each outer row of a pair of blocks: its place, and those of members it may link with, likeliest first."""
    ids, comps, sizes, slots = rows["id"].to_numpy(), rows["component"].to_numpy(), rows["n_shingles"].to_numpy(), _slots(rows["sig"])
    outer, stray = rows["outer"].to_numpy(), rows["stray"].to_numpy()
    members, least = np.flatnonzero(~outer), least_agreement(percent)
    for i in np.flatnonzero(outer):
        near = np.minimum(sizes[members], sizes[i]) * 100 >= np.maximum(sizes[members], sizes[i]) * percent
        # Two outer rows meet twice; once is enough.
        met = members[near & (comps[members] != comps[i]) & (~stray[members] | (ids[members] > ids[i]))]
        same = (slots[met] == slots[i]).mean(1)
        likely = np.flatnonzero(same >= least)
        if len(likely):
            yield i, met[likely[np.argsort(-same[likely], kind="stable")]]


def _involved(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    places = [np.append(others, i) for i, others in _candidates(rows, percent)]
    ids = np.unique(rows["id"].to_numpy()[np.concatenate(places)]) if places else np.zeros(0, np.int64)
    return pd.DataFrame({"center": np.full(len(ids), rows["center"].iloc[0]), "id": ids})


def _block_links(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links that join components, among the rows of one pair of blocks."""
    root = {c: c for c in rows["component"]}

    def find(c):
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    ids, comps = rows["id"].tolist(), rows["component"].tolist()
    sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
    found = []
    for i, others in _candidates(rows, percent):
        for j in others:
            a, b = find(comps[i]), find(comps[j])
            if a != b and linked(sets[i], sets[j], percent):
                root[max(a, b)] = min(a, b)
                found.append((ids[i], ids[j]))
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def _placed(members: DataFrame, found: DataFrame, *columns: str) -> DataFrame:
    known = found.select(F.col("node").alias("known"), "component")
    joined = members.join(known, F.col("id") == F.col("known"), "left")
    return joined.select("center", "id", F.coalesce("component", "id").alias("component"), *columns)


def _rest(stars: DataFrame, found: DataFrame, classes: DataFrame, sets: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between components that share a group."""
    ship(stars.sparkSession)
    members = stars.select(F.col("a").alias("center"), F.col("b").alias("id")).union(stars.select("a", "a").distinct())
    signs = classes.select("id", "n_shingles", "sig")
    signed = materialise(_placed(members.join(signs, "id"), found, "n_shingles", "sig"), "placed")
    blocks = _blocks(signed).groupBy("center", "o", "m")
    involved = materialise(blocks.applyInPandas(lambda rows: _involved(rows, percent), "center long, id long").distinct(), "involved")
    missing = involved.select("id").distinct().join(sets.select("id"), "id", "left_anti")
    if not missing.isEmpty():
        sets = sets.union(_sets_of(missing, texts, words, "sets2"))
    full = _placed(involved.join(signs, "id").join(sets, "id"), found, "n_shingles", "sig", "shingles")
    again = _blocks(full).groupBy("center", "o", "m")
    return materialise(again.applyInPandas(lambda rows: _block_links(rows, percent), "a long, b long"), "more")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()


def _sets_of(wanted: DataFrame, texts: DataFrame, words: int, tag: str) -> DataFrame:
    """Full sets of the documents with the ids in ``wanted``."""
    wanted = materialise(wanted.select("id"), f"{tag}-ids")
    return materialise(full_sets(texts, wanted, words).groupBy("id").agg(F.first("shingles").alias("shingles")), tag)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents link if 100 * |A & B| >= percent * |A | B| for their sets of
    ``words``-word shingles, and a component is all that links reach. Null
    and empty texts have no shingles and link with nothing. A null id takes
    part in no group and is kept with a null component. Ids should be unique;
    rows that repeat both id and text act as copies of each other and are
    kept or not together. An empty table gives no rows. Only the two named
    columns are read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    signed = materialise(signatures(texts, words), "signed")
    usable = signed.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    first = [F.first(c).alias(c) for c in ("n_shingles", "keys", "sig")]
    classes = materialise(usable.groupBy("digest").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), *first), "classes")
    banded = classes.select("id", F.explode("keys").alias("key"))
    shared = materialise(
        banded.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).where("low != high"), "shared"
    )
    large = shared.where("n > 2").select(F.col("key").alias("large_key"), "low", "n")
    members = materialise(hot_join(banded, large, "key", "large_key", "id", "n").select("key", "id", "low"), "members")
    stars = materialise(
        shared.where("n = 2")
        .select(F.col("low").alias("a"), F.col("high").alias("b"))
        .union(members.where("id != low").select("low", "id"))
        .distinct(),
        "stars",
    )
    pairs = materialise(_plausible(stars, classes, percent), "pairs")
    sets = _sets_of(_ends(pairs), texts, words, "sets")
    links = materialise(_confirmed(pairs, sets, percent), "confirmed")
    found = components(links)
    more = _rest(stars, found, classes, sets, texts, words, percent)
    if not more.isEmpty():
        found = components(links.union(more))
    labels = classes.join(found, F.col("id") == F.col("node"), "left").select(
        F.col("digest").alias("class"), "copies", "id", F.coalesce("component", "id").alias("component")
    )
    grouped = materialise(labels.where("copies > 1 or component != id").select("class", "component", "copies"), "grouped")
    # A null id or an empty text is of no class.
    digest = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("digest"))
    rows = hot_join(signed.select("doc_id", "n_shingles", digest.alias("digest")), grouped, "digest", "class", "doc_id", "copies", "left")
    component = F.coalesce("component", "doc_id")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document is kept, columns unchanged; rows with a null id stay."""
    dropped = near_duplicates(docs, words, percent, id_col, text_col).where("not kept").select(F.col("doc_id").alias("dropped"))
    dropped = with_size_checked(materialise(dropped.distinct(), "dropped"))
    return docs.join(dropped, docs[id_col] == dropped["dropped"], "left_anti")
