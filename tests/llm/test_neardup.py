import os
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrel.llm import neardup as N
from quadrel.llm.graph import components

DOCS = "doc_id long, text string, keys string, digest string, center long"


def frame(spark, rows):
    """Documents with columns that clash with internal names."""
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], DOCS)


def sets_of(text, words):
    parts = (text or "").encode().lower().split()
    if not parts:
        return set()
    n = min(words, len(parts))
    return {tuple(parts[i : i + n]) for i in range(len(parts) - n + 1)}


def brute(rows, words, percent):
    sets = {i: sets_of(t, words) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sets, 2):
        both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if both and 100 * both >= percent * either:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def result(spark, rows, words=3, percent=85):
    out = N.near_duplicates(frame(spark, rows), words, percent).collect()
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out}


def drift(rng, n, length, step, start):
    """A chain of texts, each changed a little from the one before."""
    words = [f"w{rng.randrange(10**6)}" for _ in range(length)]
    rows = []
    for i in range(n):
        rows.append((start + i, " ".join(words)))
        for _ in range(step):
            words[rng.randrange(length)] = f"w{rng.randrange(10**6)}"
    return rows


def test_chains_and_stars_match_brute_force(spark):
    rng = random.Random(3)
    rows = drift(rng, 40, 90, 1, 1000) + drift(rng, 40, 300, 4, 2000)
    base = [f"v{rng.randrange(10**6)}" for _ in range(200)]
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(1, 9)):
            words[rng.randrange(200)] = f"v{rng.randrange(10**6)}"
        rows.append((3000 + i, " ".join(words)))
    rng.shuffle(rows)
    assert result(spark, rows) == brute(rows, 3, 85)


def test_small_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(5)
    rows = drift(rng, 60, 120, 2, 10)
    monkeypatch.setattr(N, "BLOCK", 8)
    assert result(spark, rows) == brute(rows, 3, 85)


def test_threshold_is_inclusive(spark):
    # 17 of 20 shingles shared: 100 * 17 == 85 * 20.
    words = [f"a{i}" for i in range(21)]
    other = words[:19]
    rows = [(5, " ".join(words)), (9, " ".join(other))]
    assert brute(rows, 3, 85) == {5: (19, 5), 9: (17, 5)}
    assert result(spark, rows) == brute(rows, 3, 85)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "One  two"), (8, "ÉTÉ x"), (9, "été x"), (None, "one")]
    out = {(r["doc_id"], r["component_id"], r["kept"]) for r in N.near_duplicates(frame(spark, rows), 3, 85).collect()}
    # Only A-Z are lower-cased, so 8 and 9 differ.
    assert out == {(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 4, False), (6, 6, True), (7, 6, False), (8, 8, True), (9, 9, True), (None, None, True)}
    assert N.near_duplicates(frame(spark, []), 3, 85).count() == 0


def test_repeated_rows_and_long_texts(spark):
    long = " ".join(f"x{i % 997}y{i % 89}" for i in range(60_000))
    rows = [(3, long), (3, long), (1, long + " tail"), (2, "a b c d")]
    out = [(r["doc_id"], r["component_id"]) for r in N.near_duplicates(frame(spark, rows), 3, 85).collect()]
    assert sorted(out) == [(1, 1), (2, 2), (3, 1), (3, 1)]


def test_without_duplicates_keeps_columns(spark):
    docs = frame(spark, [(2, "a b c d e f"), (1, "a b c d e f"), (3, None), (None, "a b c d e f")])
    kept = N.without_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {1, 3, None}


def test_super_minhash_estimates_and_covers_all_slots():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 40, 400, 5000):
        pool = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
        a, b = np.unique(pool[:n]), np.unique(pool[n // 3 : n // 3 + n])
        sig = N.super_minhash([a, b, a, np.zeros(0, np.uint64)])
        assert (sig[0] == sig[2]).all() and (sig[:3] < np.iinfo(np.uint64).max).all()
        exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((sig[0] == sig[1]).mean() - exact) < 0.2


def test_super_minhash_is_the_sequential_algorithm():
    """Against a plain loop over elements that keeps one permutation for each."""
    elements = np.unique(np.random.default_rng(2).integers(0, 2**63, 23).astype(np.uint64))
    slots = 16
    best = [(1 << 64) - 1] * slots
    for e in elements:
        perm = list(range(slots))
        for j in range(slots):
            step = N.mix64(np.array([e], np.uint64) + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
            pick = j + int((N.mix64(step)[0] >> np.uint64(32)) * np.uint64(slots - j) >> np.uint64(32))
            perm[j], perm[pick] = perm[pick], perm[j]
            best[perm[j]] = min(best[perm[j]], int(step[0] >> np.uint64(8)) | j << 56)
    assert N.super_minhash([elements], slots)[0].tolist() == best


@pytest.mark.parametrize("shape", ["path", "star", "cycles"])
def test_components(spark, shape):
    if shape == "path":
        links = [(i, i + 1) for i in range(70)]
    elif shape == "star":
        links = [(100, i) for i in range(60)] + [(200, 201), (201, 201)]
    else:
        links = [(i, (i + 7) % 42) for i in range(42)] + [(None, 3)]
    out = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for e in links if None not in e and e[0] != e[1] for x in e}
    root = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            if a is not None and a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert out == root
    assert components(spark.createDataFrame([], "a long, b long").where(F.lit(True))).count() == 0


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/documents.parquet"), reason="sample tables are absent")
def test_sample_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(docs, 3, 85).collect()}
    expected = brute(rows, 3, 85)
    assert out == expected
    assert sum(c != i for i, (_, c) in expected.items()) > 50
