"""Main text of web pages by nearest-URL page differencing.

Every page is cut into lines, one per block of text. Pages are ordered by
host and URL path, and each is paired with the nearer of its two neighbours
there (the one that shares more path segments). The longest common
subsequence of their lines is what the site repeats, and such lines are
deleted, unless they stand in a paragraph of a marked article. Markup is
evidence too: lines in menus, footers, adverts and the like are dropped, and
where a page marks its article, only that counts.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_arrow, ship
from .common import materialise, small_batches
from .urls import _parts

# Element names and the words of class, id and role that mark their kind.
RAW = frozenset("script style noscript template iframe object svg math canvas audio video textarea select button".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td"
    " tfoot th thead title tr ul".split()
)
CONTAINER = frozenset(
    "article aside blockquote body dd details dialog div dl dt fieldset figure footer form head header hgroup html li main menu nav ol"
    " section span table tbody td tfoot th thead title tr ul".split()
)
# Elements that end where one of these begins.
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dd dt td th figcaption caption br".split())
BOILER_TAGS = frozenset("head title nav footer aside form dialog menu".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising alert aside banner breadcrumb breadcrumbs bottombar comment comments consent"
    " cookie cookies copyright disclaimer discussion disqus footer form gdpr header hidden login masthead menu modal nav navbar navigation"
    " newsletter notice notices notification overlay pager pagination popup promo promotion recommended related replies reply respond"
    " search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tagcloud toolbar topbar tracking"
    " widget".split()
)
BOILER_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
PART_WORDS = frozenset("header heading title meta image thumbnail".split())
MAIN_WORDS = frozenset("article articlebody content entry main post story".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z))|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?(?=[\s/>])""", re.I)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

#: WORDED lines are boilerplate by a class word alone.
NEUTRAL, MAIN_PROSE, MAIN_OTHER, BOILER, WORDED = 0, 1, 2, 3, 4


def _kind(name: str, attributes: str, inside: int) -> int:
    """Kind of an element's lines, given that of what it stands in: MAIN_OTHER stands for the whole article."""
    if inside == BOILER:
        return BOILER
    if name in BOILER_TAGS or name == "header" and inside in (NEUTRAL, WORDED):
        return BOILER
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if "=" in attributes or "hidden" in attributes else {}
    words = set(re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{found.get('class', '')} {found.get('id', '')}").lower()))
    if name not in ("html", "body"):
        bad = words & BOILER_WORDS
        if inside == MAIN_OTHER or name in ("article", "main"):
            bad -= {"header", "form"}
        if words & MAIN_WORDS:
            bad -= {"header"}
        if found.get("role", "").lower() in BOILER_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true":
            return BOILER
        if re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
            return BOILER
        # The page's one main element is no boilerplate by what its class says.
        if name == "main" or found.get("role", "").lower() == "main" or found.get("itemprop", "").lower() == "articlebody":
            return MAIN_OTHER
        if bad:
            return WORDED
    if name == "article" or inside == NEUTRAL and name in ("div", "section") and words & MAIN_WORDS and not words & PART_WORDS:
        return MAIN_OTHER
    return inside


def lines(page: str) -> list[tuple[str, int]]:
    """(text, kind) of the blocks of a page that hold text, in order."""
    out, parts, stack = [], [], [("", NEUTRAL)]
    at, prose, own = 0, False, None

    def close():
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                kind = stack[-1][1] if own is None else own
                out.append((text, MAIN_PROSE if kind == MAIN_OTHER and prose else kind))
            parts.clear()

    for m in TAG.finditer(page):
        start, end = m.span()
        name = m[2].lower() if m[2] else ""
        if start < at:
            continue
        if start > at:
            parts.append(html.unescape(page[at:start]))
        at = end
        if not name:
            continue
        if name in RAW:
            if not m[1] and not m[3].endswith("/>"):
                close_at = re.compile(f"</{name}\\b[^>]*>", re.I).search(page, end)
                at = close_at.end() if close_at else len(page)
            continue
        if name in BLOCK:
            close()
            prose = name in PROSE and (not m[1] or name == "br")
            # A paragraph may be marked as well; its kind holds up to the next block.
            own = None if m[1] or name in CONTAINER or "=" not in m[3] else _kind(name, m[3], stack[-1][1])
            while not m[1] and len(stack) > 1 and stack[-1][0] in ENDED_BY.get(name, ()):
                stack.pop()
        if name in CONTAINER:
            if m[1]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        if name == "span" and any(x[0] != "span" for x in stack[k:]):
                            break
                        if stack[k][1] != stack[-1][1] or stack[k - 1][1] != stack[-1][1]:
                            close()
                        del stack[k:]
                        break
            elif name not in VOID and not m[3].endswith("/>"):
                kind = _kind(name, m[3], stack[-1][1])
                if name != "span" or kind != stack[-1][1]:
                    if kind != stack[-1][1]:
                        close()
                    stack.append((name, kind))
    if at < len(page):
        parts.append(html.unescape(page[at:]))
    close()
    return out


def _prefix_lengths(a: list, b: list) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with each prefix of ``b``, one bit per line (Hyyro)."""
    at: dict = {}
    for j, h in enumerate(b):
        at.setdefault(h, []).append(j)
    masks = {}
    for h in set(a) & at.keys():
        flags = np.zeros(len(b), np.uint8)
        flags[at[h]] = 1
        masks[h] = int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")
    whole = (1 << len(b)) - 1
    rest = whole
    for h in a:
        if h in masks:
            both = rest & masks[h]
            rest = (rest + both | rest - both) & whole
    bits = np.frombuffer(rest.to_bytes(len(b) // 8 + 1, "little"), np.uint8)
    return np.concatenate(([0], np.cumsum(1 - np.unpackbits(bits, bitorder="little")[: len(b)].astype(np.int64))))


def common_lines(a: np.ndarray, b: np.ndarray, most: int = 2_000_000) -> list[int]:
    """Places in ``a`` of a longest common subsequence of two lists of line hashes.

    Hunt and Szymanski's method where equal lines give at most ``most``
    pairs. Other lists are halved first, where Hirschberg's method says that
    the halves' subsequences add up to a longest one of the whole, so memory
    stays bounded at every size.
    """
    return _common(a.tolist(), b.tolist(), most)


def _common(wanted: list, other: list, most: int) -> list[int]:
    count = Counter(other)
    if len(wanted) == 1:
        return [0] if wanted[0] in count else []
    if sum(count[h] for h in wanted) <= most:
        return _by_pairs(wanted, other)
    if len(other) == 1:
        return [wanted.index(other[0])]
    low, high = 0, min(len(wanted), len(other))
    while low < high and wanted[low] == other[low]:
        low += 1
    tail = 0
    while tail < high - low and wanted[-1 - tail] == other[-1 - tail]:
        tail += 1
    if low or tail:
        inner = _common(wanted[low : len(wanted) - tail], other[low : len(other) - tail], most)
        return [*range(low), *(low + i for i in inner), *range(len(wanted) - tail, len(wanted))]
    half = len(wanted) // 2
    total = _prefix_lengths(wanted[:half], other) + _prefix_lengths(wanted[half:][::-1], other[::-1])[::-1]
    cut = int(total.argmax())
    return _common(wanted[:half], other[:cut], most) + [half + i for i in _common(wanted[half:], other[cut:], most)]


def _by_pairs(wanted: list, other: list) -> list[int]:
    places: dict = {}
    for j, h in enumerate(other):
        places.setdefault(h, []).append(j)
    ends, chains = [], []
    for i, h in enumerate(wanted):
        for j in reversed(places.get(h, ())):
            k = bisect_left(ends, j)
            chain = (i, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(chain)
            else:
                ends[k], chains[k] = j, chain
    out, chain = [], chains[-1] if chains else None
    while chain:
        out.append(chain[0])
        chain = chain[1]
    return out[::-1]


def main_text(page_lines: list[tuple[str, int]], shared: bytes) -> str:
    """The article, given which lines (1) the nearest page shares."""
    marked = any(k in (MAIN_PROSE, MAIN_OTHER) for _, k in page_lines)
    if not marked:
        plain = [(t, k) for (t, k), s in zip(page_lines, shared) if k in (NEUTRAL, WORDED) and not s]
        # Where class words would leave nothing, they name a wrapper of the page; then only differencing counts.
        return " ".join(t for t, k in plain if k == NEUTRAL) or " ".join(t for t, _ in plain)
    main = [(t, k, s) for (t, k), s in zip(page_lines, shared) if k in (MAIN_PROSE, MAIN_OTHER)]
    # A neighbour that shares most of the article is a copy of it, not a site's frame.
    copy = 2 * sum(len(t) for t, _, s in main if s) > sum(len(t) for t, _, _ in main)
    return " ".join(t for t, k, s in main if k == MAIN_PROSE or copy or not s)


def _line_hashes(pages: DataFrame) -> DataFrame:
    def run(batches):
        for batch in small_batches(batches, 3):
            packed = [
                np.array([xxhash.xxh3_64_intdigest(t) for t, _ in lines(p or "")], np.uint64).tobytes() for p in batch.column(3).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed, pa.binary())], names=["key", "host", "path", "lines"])

    return map_arrow(pages, run, "key long, host string, path string, lines binary")


def _near(path: str, other: str) -> int:
    """Number of leading path segments in common."""
    n = 0
    for a, b in zip(path.split("/"), other.split("/")):
        if a != b:
            break
        n += 1
    return n


def _shared(rows: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """(key, shared) of one run of the ordered pages; ``edges`` has the pages before (sides -2, -1) and after it (1, 2)."""
    rows = rows.sort_values(["host", "path", "key"], kind="stable")
    got = list(zip(rows["host"], rows["path"], rows["lines"]))
    edges = edges.sort_values("side")
    before, after = (list(edges[["host", "path", "lines"]][at].itertuples(index=False, name=None)) for at in (edges["side"] < 0, edges["side"] > 0))
    got = [*before, *got, *after]
    n, first = len(got), len(before)

    def nearest(order):
        """For each page the last one before it, in ``order``, with other lines and the same host."""
        out, last, run = [None] * n, None, None
        for i in order:
            if run is not None and got[run][2] != got[i][2]:
                last = run
            if last is not None and got[last][0] != got[i][0]:
                last = None
            if run is not None and got[run][0] != got[i][0]:
                last = None
            out[i], run = last, i
        return out

    left, right = nearest(range(n)), nearest(range(n - 1, -1, -1))
    flags = []
    for i in range(first, first + len(rows)):
        host, path, data = got[i]
        own = np.frombuffer(data, np.uint64)
        mask = np.zeros(len(own), np.uint8)
        partners = [p for p in (left[i], right[i]) if p is not None]
        if partners and len(own):
            best = max(partners, key=lambda p: (_near(path, got[p][1]), -p))
            mask[common_lines(own, np.frombuffer(got[best][2], np.uint64))] = 1
        flags.append(mask.tobytes())
    return pd.DataFrame({"key": rows["key"].to_numpy(), "shared": flags})


def _outer(parts: list, other: int) -> dict:
    """{part: keys of the two pages that its pages see beyond its edge}, nearest first, for parts in the order of the walk.

    ``parts`` has (part, near edge, far edge, others) with pages as rows of
    key, host and digest. The first page is the far edge of the part passed
    last; the second is the last one passed on the same host with other
    lines, however many parts of copies lie in between.
    """
    out, first, second = {}, None, None
    for part, near, far, others in parts:
        out[part] = [p["key"] for p in (first, second) if p is not None]
        if others[other] is not None:
            second = others[other]
        elif first is None or near["host"] != far["host"] or first["host"] != far["host"]:
            second = None
        elif first["digest"] != far["digest"]:
            second = first
        first = far
    return out


def _differences(hashes: DataFrame, per_part: int = 20_000) -> DataFrame:
    """(key, shared) for every page, from its nearest neighbour by URL path within its host.

    Pages are range-partitioned by host, path and key, so a host of any size
    spreads over many tasks. Each task also gets, on either side of its
    range, the next page and the next one on that page's host with other
    lines, which are four rows per partition; the driver finds them from the
    hosts and digests of four pages of each partition.
    """
    unique = hashes.dropDuplicates(["key"])
    spark = hashes.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-hashes.count() // per_part))
    ranged = materialise(
        unique.repartitionByRange(parts, "host", "path", "key").withColumn("part", F.spark_partition_id()), "ranged"
    )
    digest = F.sha2("lines", 256)
    page, order = F.struct("key", "host", digest.alias("digest")), F.struct("host", "path", "key")
    ends = ranged.groupBy("part").agg(F.min_by(page, order).alias("low"), F.max_by(page, order).alias("high"))
    found = {r["part"]: (r["low"], r["high"]) for r in ends.collect()}
    marks = [(k, low["host"], low["digest"], high["host"], high["digest"]) for k, (low, high) in found.items()]
    ended = F.broadcast(spark.createDataFrame(marks, "part int, low_host string, low_digest string, high_host string, high_digest string"))
    unlike = lambda end: F.when((F.col("host") == F.col(f"{end}_host")) & (digest != F.col(f"{end}_digest")), order)
    others = ranged.join(ended, "part").groupBy("part").agg(F.min_by(page, unlike("low")).alias("low"), F.max_by(page, unlike("high")).alias("high"))
    other = {r["part"]: (r["low"], r["high"]) for r in others.collect()}
    rising = sorted(found)
    before = _outer([(k, *found[k], other[k]) for k in rising], 1)
    after = _outer([(k, *found[k][::-1], other[k]) for k in rising[::-1]], 0)
    wanted = [(k, step * (i + 1), key) for step, side in ((-1, before), (1, after)) for k, keys in side.items() for i, key in enumerate(keys)]
    asked = F.broadcast(spark.createDataFrame(wanted, "for_part int, side int, key long"))
    edges = ranged.join(asked, "key").select(F.col("for_part").alias("part"), "side", *[F.col(c).alias(c) for c in ("host", "path", "lines")])
    ship(spark)
    return ranged.groupBy("part").cogroup(edges.groupBy("part")).applyInPandas(_shared, "key long, shared binary")


def page_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null html counts as empty, and an empty page has an empty text. A null
    URL or one without '://' has an empty host and path, and such pages are
    neighbours of each other. Rows that repeat id, url and html get the same
    text. Ids and URLs pass through. A page that is alone on its host, or
    whose neighbours all have the same lines, is judged by its markup. An
    empty table gives no rows. Only the three named columns are read.
    """
    host, path, _ = _parts(F.col(url_col))
    keyed = pages.select(
        F.xxhash64(id_col, url_col, html_col).alias("key"),
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        F.col(html_col).alias("html"),
        host.alias("host"),
        path.alias("path"),
    )
    hashes = materialise(_line_hashes(keyed.select("key", "host", "path", "html")), "lines")
    shared = materialise(_differences(hashes), "shared").withColumnRenamed("key", "shared_key")
    # One row per page on either side, so this is a merge join at every size.
    joined = keyed.join(shared.hint("merge"), F.col("key") == F.col("shared_key")).select("page_id", "url", "html", "shared")

    def run(batches):
        for batch in small_batches(batches, 2):
            texts = [main_text(lines(p or ""), s) for p, s in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])

    return map_arrow(joined, run, "page_id long, url string, text string, n_chars long")
