"""Quality classifier, rules, secret scans, LM scores and pieces against brute force or held-out accuracy."""

import hashlib
import math
import os
import random
import string
import sys
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrel.llm import classifier, lm, pieces, rules, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "river", "stone", "walked", "under", "light", "morning", "house"]) + rng.choice(["", "", ","]) for _ in range(n))


def junk(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)).upper() + "!!" for _ in range(n))


def docs_of(spark, rows):
    """Columns that clash with the operators' own names ride along."""
    return spark.createDataFrame([(i, t, 1, "z", True) for i, t in rows], "doc_id long, text string, score int, spans string, held_out boolean")


# --- quality classifier


def test_classifier_on_held_out_rows(spark):
    rng = random.Random(1)
    rows = [(i, junk(rng, 60) if i % 4 == 0 else prose(rng, 60)) for i in range(400)]
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1) for i in range(400)] + [(None, 1), (7, 1)], "doc_id long, quality int")
    docs = docs_of(spark, rows)
    out = classifier.score(docs, classifier.fit(docs, labels)).collect()
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.3) == int(r["doc_id"] % 4 != 0)


def test_classifier_learns_nothing_from_the_held_out_fold(spark):
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    docs = docs_of(spark, [(i, f"word{i} other") for i in range(300)])
    wrong = spark.createDataFrame([(i, 0) for i in held], "doc_id long, quality int")
    scores = {r["score"] for r in classifier.score(docs, classifier.fit(docs, wrong)).collect()}
    assert len(scores) == 1 and abs(scores.pop() - 0.5) < 1e-9


def test_classifier_edges(spark):
    model = classifier.train([prose(random.Random(k), 30) for k in range(40)] + [junk(random.Random(k), 30) for k in range(40)], [1] * 40 + [0] * 40)
    docs = docs_of(spark, [(1, None), (None, ""), (2, "x " * 200_000), (2, "x " * 200_000)])
    out = classifier.score(docs, model).collect()
    assert len(out) == 4 and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if r["doc_id"] in (1, None)}) == 1
    assert classifier.score(docs_of(spark, []), model).count() == 0
    assert classifier.accepted(docs, model).columns == docs.columns


def test_classifier_trains_on_long_texts_and_all_their_tokens(spark):
    rng = random.Random(5)
    rows = [(i, (junk if i % 2 else prose)(rng, 12_000 if i < 40 else 40)) for i in range(80)]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)], "doc_id long, quality int")
    model = classifier.fit(docs, labels)
    out = {r["doc_id"]: r["predicted"] for r in classifier.score(docs, model).collect()}
    assert all(out[i] == 1 - i % 2 for i in out)
    kept = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    same = classifier.train([rows[i][1] for i in kept], [1 - i % 2 for i in kept])
    assert np.array_equal(same.words, model.words) and same.temperature == model.temperature


def test_classifier_starts_no_python_workers_for_its_ids(spark, monkeypatch):
    made = []
    make = type(spark).createDataFrame
    docs = docs_of(spark, [(i, f"some words {i}") for i in range(10)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int")
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, *a, **k: made.append(make(self, *a, **k)) or made[-1])
    classifier.fit(docs, labels)
    # Rows from Python's lists come as an RDD that Python workers unpack.
    assert made and not any("LogicalRDD" in x._jdf.queryExecution().analyzed().toString() for x in made)


def test_pair_counts_in_parts_equal_counts_at_once():
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 9, n) for n in (0, 1, 2, 3, 50, 700)]
    for step in (1, 2):
        expected = Counter(int(a) * classifier.BUCKETS + int(b) for x in texts for a, b in zip(x, x[step:]))
        for most in (1, 7, 1 << 22):
            pairs, counts = classifier._pair_counts(texts, step, most)
            assert dict(zip(pairs.tolist(), counts.tolist())) == expected


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/documents.parquet"), reason="sample tables are absent")
def test_classifier_on_the_sample_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = classifier.score(docs, classifier.fit(docs, labels)).where("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    assert len(out) > 40 and sum(r["predicted"] == r["quality"] for r in out) >= 0.95 * len(out)


# --- quality rules


def brute_counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    covered = {k for i, w in enumerate(windows) if seen[w] > 1 for k in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_rules_count_like_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", "  \n\t ", "a", "a b", "a b c a b c", "x x x x x", "é\u00a0b \x0b c 😀# <|>", "l1\nl1\n\n \nl2\nl1", "\u2003 wide"]
    texts += ["".join(rng.choice("ab \n\t#") for _ in range(rng.randrange(200))) for _ in range(60)]
    texts.append("q w e r " * 30_000)
    rows = list(enumerate(texts))
    for r in rules.quality_rules(docs_of(spark, rows)).collect():
        n = brute_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r["base_failed"] and r["kept"])


def brute_verdicts(texts):
    """(votes, posterior, accuracies) of texts that pass the base, by expectation-maximisation over documents, not patterns."""
    def divided(a, b):
        return a / b if b else 0.0

    rows = []
    for text in texts:
        words, chars = WORD.findall(text), sum(map(len, WORD.findall(text)))
        n, _, symbols, dup, repeat = brute_counts(text)
        short = sum(bool(re.fullmatch(r"[^\W\d_]{1,3}[.,;:!?]?", w)) for w in words)
        bare = sum(set(w) <= set("#*$%&|<>") for w in words)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        rows.append(
            {
                "symbols": divided(symbols, n), "bare_symbols": divided(bare, n), "short_words": divided(short, n), "repeats": divided(repeat, n),
                "dup_lines": divided(dup, len(lines)), "capitals": divided(sum("A" <= c <= "Z" for c in text), chars),
                "bangs": divided(len(text) - len(text.replace("!!", "!")), n), "digits": divided(sum("0" <= c <= "9" for c in text), chars),
                "word_length": divided(chars, n), "same_words": 1 - len(set(words)) / n if n else 0.0, "length": n,
            }
        )
    votes = np.zeros((len(rows), len(rules.RULES)), int)
    for i, row in enumerate(rows):
        for k, (rule, (_, below, low, high, above)) in enumerate(rules.RULES.items()):
            x = row[rule]
            bad = below is not None and x < below or above is not None and x > above
            votes[i, k] = -1 if bad else (low is None or x >= low) and (high is None or x <= high)
    good, bad, share = np.full(votes.shape[1], 0.95), np.full(votes.shape[1], 0.3), 0.5

    def posterior():
        odds = math.log(share / (1 - share)) + ((votes == 1) * np.log(good / (1 - bad)) + (votes == -1) * np.log((1 - good) / bad)).sum(1)
        return 1 / (1 + np.exp(-odds))

    for _ in range(20):
        p = posterior()[:, None]
        good = np.clip(((p * (votes == 1)).sum(0) + 9.5) / ((p * (votes != 0)).sum(0) + 10), 0.02, 0.98)
        bad = np.clip((((1 - p) * (votes == -1)).sum(0) + 3) / (((1 - p) * (votes != 0)).sum(0) + 10), 0.02, 0.98)
        share = min(0.98, max(0.02, (p.sum() + 5) / (len(p) + 10)))
    return votes, posterior(), dict(zip(rules.RULES, zip(good, bad))) | {"share": share}


def mixed_texts(rng, n):
    """Prose, junk of two kinds, and prose with one flaw each."""
    out = []
    for _ in range(n):
        text = prose(rng, rng.randrange(55, 300)).capitalize()
        kind = rng.randrange(12)
        if kind == 0:
            text = " ".join(w + rng.choice(("***", "&&&", "%%%")) for w in text.split())
        elif kind == 1:
            text = " | ".join(w for w in text.split() if len(w) > 3)
        elif kind == 2:
            text = " ".join(f"{w} {rng.randrange(10**6)}" for w in text.split())
        elif kind == 3:
            text = "A line.\nA line.\nB line.\nB line.\n" + text
        out.append(text)
    return out


def test_verdicts_and_accuracies_equal_brute_force(spark):
    texts = [t for t in mixed_texts(random.Random(31), 300) if not rules_fail(t)]
    votes, posterior, model = brute_verdicts(texts)
    docs = docs_of(spark, [*enumerate(texts), (-1, "too short to count"), (-2, None)])
    out = {r["doc_id"]: r for r in rules.quality_rules(docs).collect()}
    assert len(out) == len(texts) + 2
    for i, p in enumerate(posterior):
        assert out[i]["posterior"] == pytest.approx(p, abs=1e-9) and out[i]["kept"] == (p >= 0.5)
    cols = [f"v_{r}" for r in rules.RULES]
    voted = rules.features(docs).where("not base_failed").select(*[rules.vote(r).alias(f"v_{r}") for r in rules.RULES])
    patterns = rules.materialise(voted.groupBy(*cols).agg(F.count("*").alias("n")), "patterns")
    found = rules.fit(patterns)
    assert all(found[r] == pytest.approx(model[r]) for r in (*rules.RULES, "share"))
    # The method overrules: some texts with a bad vote are kept.
    overruled = [i for i, p in enumerate(posterior) if (votes[i] < 0).any() and p >= 0.5]
    assert overruled and any(p < 0.5 for p in posterior)


def rules_fail(text):
    n = brute_counts(text)
    return n[0] < 50 or 100 * n[4] > 50 * n[0]


def test_rules_reject_junk_and_keep_prose(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 30) + "\n" + " ".join("".join(rng.choices("aeioulmnrst", k=6)) for _ in range(60))) for i in range(80)]
    rows += [(100 + i, junk(rng, 80)) for i in range(10)] + [(200 + i, " ".join(f"w{rng.randrange(999)}***" for _ in range(70))) for i in range(10)]
    out = {r["doc_id"]: r["kept"] for r in rules.quality_rules(docs_of(spark, rows)).collect()}
    assert all(out[i] == (i < 100) for i in out)
    assert rules.quality_rules(docs_of(spark, [])).count() == 0
    assert rules.quality_rules(docs_of(spark, [(None, "a"), (None, "a")])).count() == 2


# --- secret scans


def test_base_spans():
    text = "Password: 'abcdefghijkl' token=short AKIAABCDEFGHIJKLMN x api_key = 0123456789abcdef0"
    found = {(secrets.KINDS[k], text[a:b]) for a, b, k in secrets.base_spans(text)}
    assert found == {
        ("assign", "Password: 'abcdefghijkl"),
        ("access", "AKIAABCDEFGHIJKLMN"),
        ("assign", "api_key = 0123456789abcdef0"),
        ("hex", "0123456789abcdef0"),
    }
    # A match that is dropped still takes its text: "token" is the short value of "secret".
    assert secrets.base_spans("secret: token = abcdefghijkl") == []
    # Only ASCII letters are taken in either case.
    assert secrets.base_spans("pa\u017f\u017fword: abcdefghijkl") == []
    assert secrets.base_spans("é" * 3 + "AKIA" + "A" * 14) == [(3, 21, 1)]


def brute_base(text):
    """Base spans by walking over characters, one kind at a time."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    value = set(string.ascii_letters + string.digits + "+/_.=-")
    found = []

    def run(at, allowed):
        end = at
        while end < len(text) and text[end] in allowed:
            end += 1
        return end

    def assigned(at):
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(name, at):
                k = at + len(name)
                # Optional signs may have to be given up for the rest to fit; here none of them can start what follows.
                k += text[k : k + 1] in ("'", '"') and k < len(text)
                k = run(k, " ")
                if text[k : k + 1] not in (":", "=") or k >= len(text):
                    return None
                k = run(k + 1, " ")
                k += text[k : k + 1] in ("'", '"') and k < len(text)
                return (k, run(k, value)) if run(k, value) > k else None
        return None

    for kind in range(3):
        at = 0
        while at < len(text):
            if kind == 0:
                hit = assigned(at)
                start, end, keep = at, hit and hit[1], hit and hit[1] - hit[0] >= 12
            elif kind == 1:
                end = run(at + 4, set(string.ascii_uppercase + string.digits)) if text.startswith("AKIA", at) else 0
                hit, start, keep = end > at + 4, at, end - at >= 18
            else:
                end = run(at, set("0123456789abcdef"))
                hit, start, keep = end > at, at, end - at >= 16
            if hit:
                if keep:
                    found.append((start, end, kind))
                at = end
            else:
                at += 1
    return sorted(found, key=lambda s: (s[0], s[2]))


def test_counts_and_digest_equal_a_brute_scan(spark):
    rng = random.Random(41)
    parts = ["token", "api_key", "APIKEY", "Secret", "passwd", "password", "AKIA", "AKIAQWERTYUIOPASDF", "0123456789abcdef", "deadbeef", "é", "\u017f", "😀", " ", " ", "=", ":", "'", '"', "\n", "x", "Zk9", "+/", "abcdefghijkl", "-"]
    texts = [None, ""] + ["".join(rng.choices(parts, k=rng.randrange(1, 40))) for _ in range(1500)]
    texts += ["token=" + "a1" * 50_000, "x " * 30_000 + "AKIA" + "Z" * 20]
    out = {r["doc_id"]: r for r in secrets.scan(docs_of(spark, list(enumerate(texts)))).collect()}
    total = Counter()
    for i, text in enumerate(texts):
        spans = brute_base(text or "")
        r, n = out[i], Counter(k for *_, k in spans)
        total += n
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (n[0], n[1], n[2]), text
        line = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, b, k in spans)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith("markov")] == [s for s in line.split(",") if s]
    assert min(total.values()) > 50


def test_ordinary_words_come_from_all_of_all_documents(spark):
    late = "zebra"
    rows = [(i, "common words here " * 400 + (late if i == 59 else "")) for i in range(60)] + [(None, "nobody"), (None, "nowhere"), (5, None)]
    found = secrets.ordinary_samples(docs_of(spark, rows), "text")
    assert {"common", "words", "here", late, "nobody", "nowhere"} <= set(found)
    assert found == secrets.ordinary_samples(docs_of(spark, rows[::-1]), "text")


def test_markov_models_find_random_strings(spark):
    rng = random.Random(4)
    words = ["request", "config", "handler", "value", "stream", "window", "update", "record", "session", "template"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(200)) + " " + "_".join(rng.choices(words, k=4))) for i in range(60)]
    key = "Zx8Qp3LmT0vKd7RwYb2NcH5s"
    rows += [(100, f"see {key} there"), (101, None), (102, ""), (103, "=" * 40 + " getUserAccountByNumber2024 1234-5678-1234-5678-1234 THE_MAX_TIMEOUT_VALUE zzzzzzzzzzzzzzzzzzzzzzzz")]
    out = {r["doc_id"]: r for r in secrets.scan(docs_of(spark, rows)).collect()}
    assert out[100]["spans"] == f"markov:4:{4 + len(key)}" and out[100]["n_hex"] == 0
    assert all(out[i]["spans"] == "" for i in out if i != 100)
    assert out[101]["base_sha256"] == out[102]["base_sha256"]


def test_redaction_keeps_columns_and_merges_spans(spark):
    docs = docs_of(spark, [(1, "token=0123456789abcdef01 end"), (2, None)])
    out = {r["doc_id"]: r["text"] for r in secrets.redacted(docs).collect()}
    assert out == {1: "[SECRET] end", 2: None}
    assert secrets.redacted(docs).columns == docs.columns
    assert secrets.scan(docs_of(spark, [])).count() == 0


def test_random_runs_within_tokens():
    model = secrets.SecretModel.train(secrets.random_samples(), secrets.generated_samples())
    rng = random.Random(12)
    key = lambda n: "".join(rng.choices(string.ascii_letters + string.digits, k=n))
    marked = lambda text: [text[a:b] for a, b, k in model.spans(text) if k == 3]
    frames = ("{}", "STRIPE_PRODUCTION_PUBLISHABLE_CREDENTIAL={}", "static/content/images/thumbnail/profile/account/user/{}", "user_{}_item/list")
    for n, least in ((16, 0.9), (19, 0.95), (24, 0.99)):
        for frame in frames:
            keys = [key(n) for _ in range(200)]
            assert sum(any(k in s for s in marked(frame.format(k))) for k in keys) >= least * len(keys), (n, frame)
    hexes = "0123456789abcdef" * 2
    k = key(24)
    assert any(k in s for s in marked(f"{hexes}/{k}")) and any(k in s for s in marked(f"{k}/{hexes}"))
    a, b = key(24), key(24)
    found = marked(f"content_value_{a}/static/content/images/thumbnail/profile/{b}")
    assert any(a in s for s in found) and any(b in s for s in found)
    for name in ("static/content/images/thumbnail/profile/account/user", "STRIPE_PRODUCTION_PUBLISHABLE_CREDENTIAL", "getAccountTransactionHandler", "2024-01-01/2024-12-31", "=" * 40):
        assert marked(name) == [], name


# --- language model


def brute_scores(rows):
    tokens = {i: (t or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split() + [None] for i, t in rows}
    crc = lambda s: zlib.crc32(s.encode())
    train = {i for i in tokens if crc(str(i)) % 7 != 2}
    dev = {i for i in train if crc(f"dev:{i}") % 10 == 0}

    def count(ids):
        uni, bi = Counter(), Counter()
        for i in ids:
            uni.update(tokens[i])
            bi.update(zip([None, *tokens[i]], tokens[i]))
        return uni, bi

    uni, bi = count(train)
    rest_uni, rest_bi = count(train - dev)
    n, v = sum(uni.values()), len(uni)
    n_rest = max(1, sum(rest_uni.values()))
    bucket = lambda c: 0 if c <= 0 else min(lm.BUCKETS - 1, int(math.log2(c)) + 1)
    bins = Counter()
    for i in dev:
        for c, w in zip([None, *tokens[i]], tokens[i]):
            p1 = rest_uni[w] / n_rest
            p2 = rest_bi[c, w] / rest_uni[c] if rest_uni[c] else 0
            b1, b2 = (int(lm._bins(np.array([p]), 1 / (v + 1))[0]) for p in (p1, p2))
            bins[(bucket(rest_uni[c]) * 1000 + b1 + 1) * 1000 + b2 + 1] += 1
    weights = lm.mixture(np.array(list(bins), np.int64), np.array(list(bins.values()), np.float64))
    out = {}
    for i, seq in tokens.items():
        score = 0.0
        for c, w in zip([None, *seq], seq):
            a = weights[bucket(uni[c])]
            score += math.log10(a[0] / (v + 1) + a[1] * uni[w] / n + (a[2] * bi[c, w] / uni[c] if uni[c] else 0))
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in seq)
        out[i] = (i not in train, len(seq), sum(uni[w] > 0 for w in seq), n, base, score)
    return out


def test_lm_scores_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 3000)
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("The cat dog sat on a Mat and RAN far".split()) for _ in range(rng.randrange(60)))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, "never seen words"), (1003, "tab\tand\x0bÉtoile")]
    expected = brute_scores(rows)
    got = {r["doc_id"]: r for r in lm.lm_scores(docs_of(spark, rows)).collect()}
    assert got.keys() == expected.keys()
    for i, (held, n, known, total, base, score) in expected.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9)
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())


def test_lm_edges(spark):
    assert lm.lm_scores(docs_of(spark, [])).count() == 0
    out = lm.lm_scores(docs_of(spark, [(None, "a b"), (None, "a b"), (3, "c " * 300_000)])).collect()
    assert len(out) == 3 and all(math.isfinite(r["score"]) for r in out)


def test_packing_round_trip():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    assert (lm._unpack_keys(lm._pack_keys(keys)) == keys).all()
    assert len(lm._unpack(lm._pack(np.zeros(0, np.uint32)), "u4")) == 0


# --- pieces


@pytest.fixture(scope="module")
def processor():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)


CASES = [
    "", " ", "   ", "a", " a  b ", "\n\n", "a\n b\r\n\tc", "Hello World", "日本語 テスト", "emoji 😀 x😀", "▁x", "x▁▁y ", "a" * 50, "      def f():\n\treturn  1",
    "é é", "\x00\x01", "<s> </s> <unk> <0x0A>", "naïve—“quote”…", "end ", "\u2581\u2581", "mixed\u00a0space",
]


def test_pieces_match_the_library(processor):
    t = pieces.load()
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyzABCÉüñß0189 .,;-_\n▁é漢😀"
    texts = CASES + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 120))) for _ in range(400)]
    for text in texts:
        coded = t.encode(text)
        ids = np.frombuffer(coded, "<u4").tolist()
        assert ids == processor.encode(text), text
        assert t.decode(coded) == processor.decode(ids), text


def test_remembered_words_stay_small(processor):
    t = pieces.load()
    for start in range(0, 300_000, 1000):
        text = " ".join(f"w{i}" for i in range(start, start + 1000))
        coded = t.encode(text)
        if start % 50_000 == 0:
            assert np.frombuffer(coded, "<u4").tolist() == processor.encode(text)
    held = sum(sys.getsizeof(x) for d in (t._words, t._older) for x in (d, *d, *d.values()))
    assert held < 20 << 20
    assert np.frombuffer(t.encode("w1 w299999"), "<u4").tolist() == processor.encode("w1 w299999")


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_character_maps_match_the_library(rule, squeeze):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
    spec = next(dict(pieces._fields(v)) for k, v in pieces._fields(library.serialized_model_proto()) if k == 3)
    own = pieces.Normaliser(pieces.character_map(spec.get(2, b"")), True, squeeze, True)
    assert bool(own.rules) == (rule != "identity")
    rng = random.Random(19)
    letters = "aeE\u0301\u0308\u0327ＡＢ１\u3000 \t\n\u00a0ﬁ①㍿가\u1100\u1161\u11a8ｶ\uff9e\u200b\u00ad\u1e9b\u0323ǅß▁İ\x07"
    for text in CASES + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]:
        assert own(text) == library.Normalize(text), text


def test_pieces_as_columns(spark, processor):
    rows = [(i, x) for i, x in enumerate(CASES)] + [(None, "a b"), (99, None), (98, "word " * 40_000)]
    docs = docs_of(spark, rows)
    coded = pieces.encode(docs)
    got = {r["doc_id"]: r["ids"] for r in coded.collect()}
    assert got[99] is None and got[0] == [] and got[7] == processor.encode(CASES[7])
    back = {r["doc_id"]: r["text"] for r in pieces.decode(coded).collect()}
    assert back[7] == CASES[7] and back[98] == "word " * 40_000 and back[99] is None
    out = {r["doc_id"]: r for r in pieces.encoded_digests(docs).collect()}
    assert out[7]["n_tokens"] == len(got[7]) and out[7]["round_trip"] and out[99]["n_tokens"] == 0
    assert pieces.encoded_digests(docs_of(spark, [])).count() == 0
