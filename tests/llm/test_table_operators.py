"""Mixing, URL filters, page text, audio and the pipeline."""

import itertools
import random
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quadrel.llm import audio, html_text, mixing, urls

# --- mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    budget, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = budget - sum(2 * sizes[s] for s in capped)
        rate = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if rate * weight[s] > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in capped else rate * weight[s] for s in order}
        capped |= over


def mix_docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 5, 6) for i, t, s in rows], "doc_id long, text string, source string, size int, h int")


def test_mix_meets_its_targets(spark):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        source = rng.choice(["b", "a", "é", "Z", None, "tiny"] + ["hot"] * 8) if i % 50 else "tiny"
        rows.append((i, "w " * (rng.randrange(1, 60) if source != "hot" else 40), source))
    rows.append((9000, None, "a"))
    out = mixing.mix(mix_docs(spark, rows)).collect()
    assert len(out) == len(rows)
    source_of = {i: s for i, _, s in rows}
    sizes, taken, target = {}, {}, {}
    for r in out:
        s = source_of[r["doc_id"]]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s] = r["target"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    expected = brute_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(expected[s])
        assert abs(taken[s] - target[s]) <= 60
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(mix_docs(spark, rows[::-1])).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in out}


def test_mix_edges(spark):
    assert mixing.mix(mix_docs(spark, [])).count() == 0
    out = mixing.mix(mix_docs(spark, [(1, "", "a"), (2, None, None)])).collect()
    assert {(r["doc_id"], r["taken"]) for r in out} == {(1, 0), (2, 0)}
    same = mixing.mix(mix_docs(spark, [(7, "a b", "s"), (7, "a b", "s"), (None, "c", "t")])).collect()
    assert len({r["taken"] for r in same if r["doc_id"] == 7}) == 1


def test_mix_of_rows_without_ids_meets_its_targets(spark):
    rng = random.Random(6)
    rows = [(None if i % 3 else i, f"w{i} " + "w " * rng.randrange(30), rng.choice("ab")) for i in range(1500)]
    out = mixing.mix(mix_docs(spark, rows)).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert len(out) == 2 and all(abs(r["taken"] - r["target"]) <= 31 for r in out)


def test_repeated_rows_are_the_mix(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(1, 9), rng.choice("abc")) for i in range(300)]
    docs = mix_docs(spark, rows)
    taken = {r["doc_id"]: r["taken"] // max(1, r["size"]) for r in mixing.mix(docs).collect()}
    mixed = mixing.repeated(docs)
    assert mixed.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {i: n for i, n in taken.items() if n}


# --- URL filters


def brute_url(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for rule, verdict in urls.RULES:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail):
            fits.append((len(rule), rule, verdict))
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


URLS = [
    None, "", "no scheme", "http://", "http://EXAMPLE.org", "http://example.org/", "https://a.example.org/es/x?y#z", "http://example.org/en/12", "http://badexample.org/en/1",
    "http://x.com/fr/", "http://x.com/de/q", "http://com/de/", "http://x.community/de/", "http://x.com?/de/", "http://x.com#/fr/", "ftp://org", "http://org/a://b.com/de/", "http://É.ORG/é",
]


def pages_of(spark, found):
    return spark.createDataFrame([(i, u, "t", "v", 1.0) for i, u in found], "page_id long, url string, tokens string, verdict string, confidence double")


def test_fixed_url_rules(spark):
    none = spark.createDataFrame([], "id long, blocked boolean")
    for r in urls.url_filter(pages_of(spark, enumerate(URLS)), none).collect():
        host, path, rule, verdict = brute_url(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or "allow")
    assert urls.url_filter(pages_of(spark, []), none).count() == 0


def test_mined_url_rules(spark):
    rng = random.Random(3)
    found, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        found.append((i, f"http://{'spam' if bad else rng.choice(['news', 'blog'])}.site{rng.randrange(4)}.net/{rng.choice(['win', 'top'])}/{i}?ref=x"))
        if i % 2:
            labels.append((i, bad or rng.random() < 0.05))
    labels += [(None, True), (1, None), (5, True), (5, True)]
    found += [(None, "http://spam.other.net/zzz/1"), (7000, None)]
    out = urls.url_filter(pages_of(spark, found), spark.createDataFrame(labels, "id long, blocked boolean"))
    for r in out.collect():
        assert r["verdict"] == ("block" if r["host"].startswith("spam.") else "allow"), r


def brute_tokens(url):
    host, path, *_ = brute_url(url)
    query = re.match(r"(?s).*?://[^?#]*\?([^#]*)", url or "")
    found = {"h:" + x for x in host.split(".") if x} | {"p:" + re.sub("[0-9]+", "#", x) for x in path.split("/") if x}
    return found | {"q:" + x.split("=")[0] for x in re.split("[&;]", query[1] if query else "") if x.split("=")[0]}


def brute_confidence(labelled, least, confidence):
    """[(tokens, confidence)] of every token set that implies a block, by trying all sets."""
    share = sum(b for _, b in labelled) / len(labelled)
    every = {c for t, _ in labelled for k in range(1, len(t) + 1) for c in itertools.combinations(sorted(t), k)}
    out = []
    for found in every:
        blocked = [b for t, b in labelled if t.issuperset(found)]
        # A rule's support counts its URLs with the block.
        if sum(blocked) >= least and sum(blocked) / len(blocked) >= confidence and sum(blocked) / len(blocked) > share:
            out.append((set(found), sum(blocked) / len(blocked)))
    return out


def test_mined_rules_equal_brute_force(spark):
    rng = random.Random(21)
    hosts, words = ["a.example.org", "b.example.org", "x.com", "y.x.com", "q.net", "r.q.net"], ["de", "es", "fr", "en", "k", "k/m", "1", "12/v"]
    found = [(i, f"http://{rng.choice(hosts)}/{rng.choice(words)}/{rng.choice(words)}{rng.choice(['', '?u=1', '?u=1&w=2', '#z'])}") for i in range(900)]
    labels = [(i, rng.random() < (0.97 if "/k/m" in u else 0.3)) for i, u in found if i % 3 and "q.net" in u]
    out = urls.url_filter(pages_of(spark, found), spark.createDataFrame(labels, "id long, blocked boolean")).collect()
    known, labelled = dict(labels), []
    for i, u in found:
        verdict = brute_url(u)[3]
        if verdict or i in known:
            labelled.append((brute_tokens(u), verdict == "block" if verdict else known[i]))
    rules = brute_confidence(labelled, urls.MIN_COUNT, urls.MIN_CONFIDENCE)
    assert rules
    mined = 0
    for r in out:
        host, path, rule, verdict = brute_url(found[r["page_id"]][1])
        best = max((c for t, c in rules if t <= brute_tokens(found[r["page_id"]][1])), default=None)
        assert r["verdict"] == (verdict or ("block" if best else "allow"))
        assert r["confidence"] == (None if rule else best and pytest.approx(best))
        mined += not rule and best is not None
    assert mined > 20


def test_long_urls_that_come_again_end(spark):
    long_url = "http://h.org/es/" + "/".join(f"s{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60))
    found = [(i, long_url.replace("h.org", "example.org")) for i in range(100)] + [(100 + i, f"http://h.org/{i}") for i in range(100)]
    found += [(300, long_url.replace("h.org", "h.net")), (301, "http://h.net/sab"), (302, "http://h.net/zz")]
    out = {r["page_id"]: r["verdict"] for r in urls.url_filter(pages_of(spark, found)).collect()}
    assert out[300] == out[301] == "block" and out[302] == "allow"
    assert urls.url_filter(pages_of(spark, [])).count() == 0


# --- page text

FRAME = '<!DOCTYPE html><html><head><title>T {0}</title><style>p{{}}</style><script>var x="</p>";</script></head><body><nav><a href="/a">Home</a></nav><!-- no --><div class="ad">Buy {0}</div>{1}<footer>&copy; host</footer>'


def text_of(page, shared=None):
    found = html_text.lines(page)
    return html_text.main_text(found, shared or bytes(len(found)))


def test_markup():
    article = "<article><h1>Head &amp; more</h1><p><b>One <i>t</i>wo<br>three<p>a\n\t b&nbsp;c</p></article>"
    assert text_of(FRAME.format("x", article)) == "Head & more One two three a b c"
    assert text_of("<article><p>kept</p><aside>side</aside><form>f</form><div class='share-bar'>s</div></article>") == "kept"
    assert text_of("<main><header><h1>Title</h1></header><p>body</p><section id='comments'><p>no</p></section></main>") == "Title body"
    assert text_of("<header>site</header><p>plain &lt;text&gt; a < b</p><div class='cookie-notice'>ok?</div>") == "plain <text> a < b"
    assert text_of("<article><p class='lead'>a<p class='notice'>no</p>b<ul class='comment-list'><li class='c'><p>x</ul><ul><li class='ad'><p>y<li>z</ul></article>") == "a b z"
    assert text_of("<div class='entry-header'>Top</div><div class='site-header'>Site</div><table><tr><td class='ad'>q<td>w</table>") == "Top w"
    assert text_of("<article><p>unclosed <b>tags") == "unclosed tags"
    assert text_of("") == "" and text_of("<nav>only</nav>") == ""
    assert text_of("<p>x<!-- open") == "x" and text_of("<p>y<script>never closed <p>z") == "y"


def test_class_words_of_wrappers_leave_the_article():
    assert text_of("<div class='content-sidebar-wrap'><main><p>Story</p></main><div class='sidebar'>side</div></div>") == "Story"
    assert text_of("<div class='search-page'><div role='main'><p>Story</p><p class='notice'>no</p></div></div>") == "Story"
    assert text_of("<div id='social-news'><article><p>Story</p><div class='share'>no</div></article></div>") == "Story"
    assert text_of("<div class='widget'><div itemprop='articleBody'>Story</div></div>") == "Story"
    assert text_of("<main class='has-sidebar'><p>Story</p><div class='related'>no</div></main>") == "Story"
    assert text_of("<div class='has-sidebar'><nav>Menu</nav><p>Story</p></div>") == "Story"
    assert text_of("<p>Site</p><div class='has-sidebar'><p>Story</p></div>", bytes([1, 0])) == "Story"
    assert text_of("<nav class='menu'><article>no</article></nav><div class='comments'><article class='comment'>no</article></div><p>Story</p>") == "Story"


def test_pages_without_marks_are_differenced(spark):
    page = lambda k: f"<div>Site name</div><div>Menu</div><p>Story {k} begins.</p><p>And {k} ends.</p><div>All rights</div>"
    rows = [(i, f"http://h.net/a/{i}", page(i)) for i in range(30)]
    rows += [(100, "http://lone.net/x", page(100)), (101, None, None), (102, "http://h.net/a/5", page(5)), (102, "http://h.net/a/5", page(5)), (None, "http://h.net/b", "")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, key string, part int")
    out = [(r["page_id"], r["text"], r["n_chars"]) for r in html_text.page_text(df).collect()]
    assert len(out) == len(rows)
    for i, text, n in out:
        assert n == len(text)
        if i is not None and (i < 30 or i == 102):
            k = i if i < 30 else 5
            assert text == f"Story {k} begins. And {k} ends."
    texts = dict((i, t) for i, t, _ in out)
    assert texts[100].startswith("Site name Menu Story 100") and texts[101] == "" and texts[None] == ""
    assert html_text.page_text(df.limit(0)).count() == 0


def brute_texts(pages):
    """{id: text} of pages given as (id, host, path, lines): lines that the nearer neighbour by path shares go."""
    def lcs(a, b):
        best = [[[] for _ in range(len(b) + 1)] for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + [x] if x == y else max(best[i][j + 1], best[i + 1][j], key=len)
        return best[-1][-1]

    def near(p, q):
        return next((k for k, (x, y) in enumerate(zip(p.split("/"), q.split("/"))) if x != y), min(p.count("/"), q.count("/")) + 1)

    out = {}
    for i, host, path, own in pages:
        on_host = sorted((p for p in pages if p[1] == host), key=lambda p: (p[2], p[0]))
        at = [p[0] for p in on_host].index(i)
        sides = [next((p for p in side if p[3] != own), None) for side in (on_host[:at][::-1], on_host[at + 1 :])]
        sides = [p for p in sides if p]
        # The earlier page wins a tie.
        best = max(sides, key=lambda p: near(path, p[2])) if sides else None
        out[i] = " ".join(t for t in own if best is None or t not in lcs(own, best[3]))
    return out


def test_unmarked_pages_equal_brute_force(spark):
    rng = random.Random(17)
    frame = [f"Frame line {k}" for k in range(8)]
    pages = []
    for i in range(150):
        host, path = f"h{rng.randrange(6)}.net", "/" + "/".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) + f"/{i:03}"
        top = [t for t in frame[:4] if rng.random() < 0.8]
        end = [t for t in frame[4:] if rng.random() < 0.8]
        pages.append((i, host, path, [*top, *(f"Story {i} part {k}." for k in range(rng.randrange(4))), *end]))
    for k in range(20):
        i, host, path, own = rng.choice(pages[:150])
        pages.append((200 + k, host, f"{path}x{k:02}", own))
    rows = [(i, f"http://{host}{path}", "".join(f"<div>{t}</div>" for t in own)) for i, host, path, own in pages]
    out = {r["page_id"]: r["text"] for r in html_text.page_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    expected = brute_texts(pages)
    assert len(out) == len(rows) and sum(out[i] == expected[i] for i in out) == len(rows)
    # Without differencing nearly every text would be another one.
    assert sum(expected[i] != " ".join(own) for i, _, _, own in pages) > 0.8 * len(pages)


def test_shared_paragraphs_of_marked_articles_stay(spark):
    page = lambda k: FRAME.format(k, f"<article><p>Same words.</p><p>Part {k}</p></article>")
    df = spark.createDataFrame([(i, f"http://h.net/{i}", page(i)) for i in range(8)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_text.page_text(df).collect()} == {i: f"Same words. Part {i}" for i in range(8)}


def test_copies_beyond_a_partition_are_differenced(spark):
    page = lambda k: f"<div>Site name</div><div>Menu</div><p>Story {k}.</p>"
    rows = [(0, "http://c.net/a", page("a"))] + [(i, f"http://c.net/b/{i:03}", page("b")) for i in range(1, 60)] + [(60, "http://c.net/c", page("c"))]
    rows += [(100 + i, f"http://d.net/{i:03}", page("d")) for i in range(60)] + [(160, "http://d.net/e", page("e"))]
    rows += [(200 + i, f"http://e.net/{i:03}", page("f")) for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r["page_id"]: r["text"] for r in html_text.page_text(df).collect()}
    assert all(out[i] == f"Story {k}." for i, k in [(0, "a"), (60, "c"), (160, "e")])
    assert {out[i] for i in range(1, 60)} == {"Story b."} and {out[100 + i] for i in range(60)} == {"Story d."}
    assert {out[200 + i] for i in range(20)} == {"Site name Menu Story f."}


def test_common_lines_is_a_longest_common_subsequence():
    rng = random.Random(4)

    def length(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in "ab")
        found = html_text.common_lines(np.array(a, np.uint64), np.array(b, np.uint64))
        assert len(found) == length(a, b) and found == sorted(set(found))


def test_common_lines_of_many_equal_lines():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(40))] for _ in "ab")
        a, b = np.array(a, np.uint64), np.array(b, np.uint64)
        found = html_text.common_lines(a, b, most=rng.choice((0, 5, 60)))
        assert found == sorted(set(found)) and len(found) == len(html_text.common_lines(a, b))
        rest = iter(b.tolist())
        assert all(x in rest for x in a[found].tolist())
    a, b = np.array([0] * 20 + [1, 2] + [0] * 1500, np.uint64), np.array([1, 2] + [0] * 1500, np.uint64)
    assert html_text.common_lines(a, b) == [*range(20, 1522)]


# --- audio


def tune(rng, notes):
    times = np.arange(audio.HOP * 2) / audio.RATE
    return np.concatenate([0.5 * np.sin(2 * np.pi * 220 * 2 ** (rng.integers(0, 24) / 12) * times) for _ in range(notes)]).astype(np.float32)


def test_wav_round_trip_and_damage():
    wave = tune(np.random.default_rng(1), 3)
    rate, back = audio.decode_wav(audio.encode_wav(wave))
    assert rate == audio.RATE and np.abs(back - wave).max() < 0.02
    for bad in (None, b"", b"RIFF", audio.encode_wav(wave)[:20], b"x" * 100):
        assert len(audio.decode_wav(bad)[1]) == 0


@pytest.mark.parametrize("extensible", [False, True])
@pytest.mark.parametrize("tag,kind", [(1, "u1"), (1, "<i2"), (1, "<i4"), (3, "<f4"), (3, "<f8")])
def test_kinds_of_wav(tag, kind, extensible):
    wave = tune(np.random.default_rng(2), 2)
    stereo, bits = np.stack([wave, wave], axis=1), 8 * np.dtype(kind).itemsize
    body = (stereo if tag == 3 else np.round(stereo * (127 if bits == 8 else 2 ** (bits - 1) - 1)) + (128 if bits == 8 else 0)).astype(kind).tobytes()
    form = struct.pack("<HHIIHH", 0xFFFE if extensible else tag, 2, 8000, 8000 * bits // 4, bits // 4, bits)
    if extensible:
        form += struct.pack("<HHIH", 22, bits, 3, tag) + bytes(14)
    data = b"RIFF" + struct.pack("<I", 20 + len(form) + len(body)) + b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(body)) + body
    rate, back = audio.decode_wav(data)
    assert rate == 8000 and len(back) == len(wave) and np.abs(back - wave).max() < 0.02
    if tag == 3:
        odd = np.array([np.nan, np.inf, -np.inf, 5, -5], kind).tobytes()
        start = data.index(b"data") + 8
        assert set(audio.decode_wav(data[:start] + odd + data[start + len(odd) :])[1][:2].tolist()) <= {0.0, 0.5}


def test_alignment_recall_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows, waves = [], {}
    for k in range(40):
        base = tune(rng, 30)
        waves[k * 50] = base
        shift = audio.HOP * int(rng.integers(0, 12))
        noisy = base[shift:] + rng.normal(0, 0.004, len(base) - shift)
        waves[k * 50 + 1] = noisy.astype(np.float32)
    waves[3] = waves[0]
    rows = [(i, audio.encode_wav(w), "c", 1) for i, w in waves.items()] + [(2, None, "c", 1), (4, b"junk", "c", 1), (None, audio.encode_wav(waves[0]), "c", 1)]
    df = spark.createDataFrame(rows, "rec_id long, audio binary, digest string, n int")
    out = {r["rec_id"]: r for r in audio.match_recordings(df).collect()}
    prints = {i: audio.fingerprint(audio.chroma(audio.decode_wav(audio.encode_wav(w))[1], audio.RATE)) for i, w in waves.items()}
    true = {}
    for q in (i for i in waves if i % 50 == 0):
        for r in (i for i in waves if i not in (q, 3)):
            best = min((audio.bit_errors(prints[q], prints[r], o)[::-1] for o in range(-40, 41)), key=lambda x: (x[1] < audio.LEAST_OVERLAP, x[0]))
            if best[1] >= audio.LEAST_OVERLAP and best[0] <= audio.MOST_ERRORS:
                true.setdefault(q, set()).add(r)
    hits = sum(out[q]["best_id"] in rs for q, rs in true.items())
    assert len(true) >= 30 and hits / len(true) >= 0.9
    assert sum(out[q]["n_links"] for q in true) >= 0.9 * sum(map(len, true.values()))
    assert out[3]["class_id"] == out[0]["class_id"] == 0
    assert out[2]["n_items"] == 0 and out[2]["class_id"] == 2 and out[4]["n_items"] == 0
    assert audio.match_recordings(df.limit(0)).count() == 0


def brute_links(prints, queries):
    found = {}
    for q in queries:
        for r in prints.keys() - {q}:
            a, b = prints[q], prints[r]
            tried = [(*audio.bit_errors(a, b, o)[::-1], o) for o in range(-len(a), len(b) + 1)]
            fits = [(e, -n, o) for e, n, o in tried if n >= audio.LEAST_OVERLAP and e <= audio.MOST_ERRORS]
            if fits:
                found[q, r] = min(fits)
    return found


def links_of(spark, prints, queries):
    df = spark.createDataFrame([(i, x.astype("<u4").tobytes()) for i, x in prints.items()], "rec_id long, items binary")
    out = audio.align(df, df.where(F.col("rec_id").isin(list(queries)))).collect()
    assert len(out) == len({(r["query"], r["rec_id"]) for r in out})
    return {(r["query"], r["rec_id"]): (r["bit_error"], -r["overlap"], r["offset"]) for r in out}


def test_alignments_up_to_the_most_bit_errors(spark):
    rng = np.random.default_rng(6)
    prints = {}
    for k in range(12):
        base = rng.integers(0, 2**32, int(rng.integers(10, 70)), dtype=np.uint32)
        prints[100 * k] = base
        for j in range(1, 9):
            flips = np.packbits(rng.random((len(base), 32)) < rng.uniform(0.05, 0.11), axis=1).view(">u4").reshape(-1).astype(np.uint32)
            lead = rng.integers(0, 2**32, int(rng.integers(0, 9)), dtype=np.uint32)
            prints[100 * k + j] = np.concatenate([lead, (base ^ flips)[int(rng.integers(0, 9)) :]])
    queries = {100 * k for k in range(12)}
    true = brute_links(prints, queries)
    assert len(true) > 20 and max(e for e, *_ in true.values()) > 0.095
    assert links_of(spark, prints, queries) == true


def test_alignments_of_noisy_tunes_shifted_by_part_hops(spark):
    rng = np.random.default_rng(7)
    prints = {}
    for k in range(15):
        base = tune(rng, 30)
        for j in range(8):
            shift = int(rng.integers(0, 6 * audio.HOP)) if j else 0
            wave = base[shift:] + rng.normal(0, 0.02 * j, len(base) - shift)
            prints[10 * k + j] = audio.fingerprint(audio.chroma(audio.decode_wav(audio.encode_wav(wave))[1], audio.RATE))
    queries = {10 * k for k in range(15)}
    true = brute_links(prints, queries)
    assert len(true) > 15 and max(e for e, *_ in true.values()) > 0.08
    assert links_of(spark, prints, queries) == true


def test_alignments_of_repeated_passages(spark):
    rng = np.random.default_rng(8)
    a, b, c, d = (rng.integers(0, 2**32, n, dtype=np.uint32) for n in (40, 30, 20, 25))
    whole = lambda *parts: np.concatenate(parts)
    prints = {0: whole(a, c), 1: whole(a, b, a, c), 2: whole(c, c, c, d), 3: whole(d, c, d, c), 4: np.full(50, 7, np.uint32), 5: np.full(61, 7, np.uint32)}
    found = links_of(spark, prints, set(prints))
    assert found == brute_links(prints, set(prints))
    assert found[0, 1] == (0.0, -60, 70) and found[4, 5] == (0.0, -50, 0)


def test_silence_gives_no_votes(spark):
    quiet, tone = np.zeros(audio.HOP * 40, np.float32), tune(np.random.default_rng(3), 12)
    item = lambda wave: audio.fingerprint(audio.chroma(wave, audio.RATE))
    assert set(item(quiet).tolist()) == {audio.SILENCE}
    prints = {0: item(quiet), 1: item(np.concatenate([quiet, quiet])), 2: item(np.concatenate([quiet, tone, quiet])), 3: item(np.concatenate([tone, quiet]))}
    found = links_of(spark, prints, set(prints))
    # Only the tune links, and silence then counts in the overlap like anything else.
    assert {(2, 3), (3, 2)} == found.keys() and found[3, 2][0] <= audio.MOST_ERRORS


def test_rendered_vectors(spark):
    df = spark.createDataFrame([(1, [0.1] * 64), (2, None), (3, [None, 0.2])], "vec_id long, embedding array<float>")
    found = {r["rec_id"]: r["audio"] for r in audio.rendered(df).collect()}
    assert found[2] is None and len(audio.decode_wav(bytes(found[1]))[1]) == 64 * audio.HOP


# --- pipeline


def test_pipeline_against_its_parts(spark, tmp_path):
    """Every stage on its own input: rows it must drop, keep, change or repeat."""
    rng = random.Random(9)
    words = ["the", "of", "river", "stone", "walked", "under", "light", "morning", "house", "and"]
    prose = lambda k: " ".join(f"{rng.choice(words)}{rng.choice(['', '', 'ly', 'ed'])}" for _ in range(80)) + f" number{k}"
    rows = [(i, prose(i), "en", f"s{i % 3}") for i in range(120)]
    rows += [(200 + i, " ".join("".join(rng.choice("QWERTZ") for _ in range(6)) + "!!" for _ in range(60)), "en", "s0") for i in range(30)]
    rows += [(300, rows[5][1], "en", "s1"), (301, rows[6][1] + " tail", "en", "s2"), (302, prose(302) + " token=0123456789abcdef01", "en", "s0")]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i < 200 or i >= 300)) for i, *_ in rows]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    frames, docs = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path)).cache()
        frames[name] = docs
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda name: {r["doc_id"] for r in frames[name].select("doc_id").collect()}
    clean = {i for i, *_ in rows if i < 200 or i >= 300}
    assert ids("quality_classifier") == clean
    assert ids("near_dedup") == clean - {300, 301}
    scanned = {r["doc_id"]: r for r in frames["secret_scans"].collect()}
    assert scanned.keys() == clean - {300, 301}
    assert scanned[302]["text"].endswith(" [SECRET]") and scanned[302]["n_chars"] == len(scanned[302]["text"])
    assert scanned[4]["text"] == rows[4][1]
    counts = {r["doc_id"]: r["count"] for r in frames["mixing"].groupBy("doc_id").count().collect()}
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(frames["secret_scans"]).collect()}
    assert counts == {i: n for i, n in taken.items() if n}
    final = {r["doc_id"]: r["n"] for r in corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").agg(F.count("ids").alias("n")).collect()}
    assert final == counts


def test_pipeline_edges(spark, tmp_path):
    """Null ids, texts and sources, empty texts, repeated rows, and columns that clash with the operators' own."""
    rng = random.Random(10)
    prose = lambda k: " ".join(rng.choice(["the", "of", "river", "stone", "walked", "under", "light"]) for _ in range(60)) + f" n{k}"
    text = prose(0)
    rows = [(i, prose(i), "a") for i in range(40)] + [(50, text, "a"), (50, text, "a"), (51, text, None), (None, text, "b"), (None, None, None), (60, None, "b"), (61, "", "b")]
    schema = "doc_id long, text string, lang string, source string, n_chars int, component_id string, dropped int, slot string, times int, ids string, id string"
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), "c", 1, "s", 2, "x", "y") for i, t, s in rows], schema)
    home = str(tmp_path)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    labels.write.parquet(f"{home}/labels.parquet")
    by_name = dict(corpus_pipeline.STAGES)
    for frame in (docs, docs.limit(0)):
        n = frame.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, home)
            assert out.columns == docs.columns and (n or out.count() == 0), name
        assert by_name["sentencepiece"](spark, frame, home).count() == n
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in by_name["near_dedup"](spark, docs, home).collect())
    # Of the copies of one text the lowest id stays, with both its rows; null ids, null and empty texts stay.
    assert kept.count((False, 50, text)) == 2 and (False, 51, text) not in kept
    assert sum(k[0] for k in kept) == 2 and (False, 60, "") in kept and (False, 61, "") in kept
    assert len(kept) == len(rows) - 1
    clean = by_name["secret_scans"](spark, docs, home).collect()
    assert len(clean) == len(rows) and sum(r["text"] is None for r in clean) == 2 and all(r["n_chars"] == len(r["text"]) for r in clean if r["text"])
    times = by_name["mixing"](spark, docs, home).groupBy("doc_id", "text").count().collect()
    assert all(r["count"] <= 4 for r in times)
    coded = {(r["doc_id"], r["ids"] is None) for r in by_name["sentencepiece"](spark, docs, home).collect()}
    assert (60, True) in coded and (61, False) in coded
    empty = tmp_path / "empty"
    docs.limit(0).write.parquet(str(empty / "documents.parquet"))
    labels.limit(0).write.parquet(str(empty / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
