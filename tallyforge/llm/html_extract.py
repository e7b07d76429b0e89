"""HTML extraction: page structure gives zones, a suffix array per host finds their boilerplate.

A page is cut into blocks (headings, paragraphs, list items, cells and the like; white space inside a block
is one space). Blocks under menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
comments are dropped, by element and by words of class, id and role, whole or as parts of compounds. Where a page has `article` or `main`, only
what stands in it is its text; of several articles, the longest and those at least half as long, teasers only where there is nothing else. What remains is main text, except on pages that mark no main
part: there, the token streams of all pages of a host are concatenated, a suffix array (prefix
doubling) with its longest common prefixes finds runs of `MIN_RUN` tokens or more, within and across blocks, that
distinct pages share; blocks that runs cover go, in other blocks the covered runs of that length, and unique runs
stay. Pages of equal text count as one page, so mirrors keep theirs, and a short block goes only as
part of a longer run. What a page marks as its main part goes through suffix arrays of its host, too, as notices and adverts stand in articles as well; but
articles quote each other, so there a run goes only if it stands on more than `COMMON_SHARE` of the host's pages, `COMMON_PAGES` at least.

A host's pages are dealt over shards of about `SHARD_TOKENS` tokens by page hash and each shard has its own
suffix array; windows of MIN_RUN tokens that its array doesn't find repeated are counted by hash over the
whole host after a combine within each shard, so a run that two shards share is found too, and no task
gets a whole host.

Defined cases: null or empty html gives an empty text; broken or unclosed markup is read as far as it goes (an
unclosed comment, script or style hides the rest); character references are decoded once; rows that
repeat a page are each extracted; a null url counts as host "" and a null page_id is kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, with_text
from .textstats import chunks

MIN_RUN = 8
_HALF = (1 << 32) - 1
#: A run within marked main parts is boilerplate on more than this share of its host's different pages, and on so many of them at least.
COMMON_SHARE, COMMON_PAGES = 0.5, 4
SHARD_TOKENS = 400_000

BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
#: Elements that end a block without leaving the paragraph they stand in: a line break separates words only.
SOFT = frozenset({"br"})
HIDDEN = frozenset("script style noscript template svg math canvas iframe object audio video head title textarea select button".split())
RAW = frozenset("script style textarea title noscript iframe".split())
DROPPED = frozenset("nav header footer aside form menu dialog search".split())
MAIN = frozenset({"article", "main"})
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Whole words of class, id and role that mark what isn't main text.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsored sponsor promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "sidebar side-bar aside complementary footer header contentinfo cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe signup "
    "share sharing social comment comments reply replies disqus related recommended widget toolbar pagination pager skip search dialog alert".split()
)
#: Parts of a hyphenated word that say the mark after them isn't here or is elsewhere on the page, and a word that only looks marked.
NEGATED, UNMARKED = frozenset({"no", "non", "not", "without", "with", "has", "hide"}), frozenset({"ad-hoc"})
#: Of these, the words that count anywhere within a compound (hyphens or capitals part it).
STRONG = MARKS - frozenset("header notice notices search skip social share sharing overlay modal alert widget related recommended menu complementary".split())
#: Words that count as the first or the last part of a compound, as the first only, and as the last after one of some others.
AT_ENDS = frozenset("menu search alert notice notices overlay modal widget social sharing".split())
FIRST = frozenset("skip share related recommended recommendations".split())
LAST_AFTER = {"header": frozenset("site global top main app web brand".split()), "share": frozenset({"social"}), "posts": frozenset("related more".split())}
#: Ids of what holds readers' comments, and words of an article that leads to another one.
COMMENT_IDS = frozenset({"respond", "usercomments"})
TEASERS = frozenset("teaser teasers tease card preview excerpt snippet".split())
#: Beside the longest article of a page, those stay that are at least this share as long.
MAIN_SHARE = 0.5
_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z))", re.S)
_ATTR = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDE = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_SPLIT = re.compile(r"[\s_]+")
_CAPITAL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def _names(attrs: str) -> Iterator[list[str]]:
    """Parts of each word of class, id and role."""
    for m in _ATTR.finditer(attrs):
        for word in _SPLIT.split(m[2] or m[3] or m[4] or ""):
            yield _CAPITAL.sub("-", word).lower().split("-")


def _compound(parts: list[str]) -> bool:
    """Whether a compound marks what isn't main text."""
    plain = next((i for i, x in enumerate(parts) if x in NEGATED), len(parts))
    parts = parts[:plain]
    if any(x in STRONG for x in parts):
        return True
    if not parts:
        return False
    return bool({parts[0], parts[-1]} & AT_ENDS) or parts[0] in FIRST or (len(parts) > 1 and parts[-2] in LAST_AFTER.get(parts[-1], ()))


def _marked(attrs: str) -> bool:
    if _HIDE.search(attrs):
        return True
    for parts in _names(attrs):
        word = "-".join(parts)
        if word in MARKS or word in COMMENT_IDS or (word not in UNMARKED and len(parts) > 1 and _compound(parts)):
            return True
    return False


def _main_articles(found: list[tuple[str, bool, int]], teasers: set[int]) -> set[int]:
    """Of a page's articles, those that are its text: no teasers where there are others, and none much shorter than the longest."""
    size: dict[int, int] = {}
    for text, inside, nth in found:
        if inside and nth:
            size[nth] = size.get(nth, 0) + len(text)
    if set(size) - teasers:
        size = {k: v for k, v in size.items() if k not in teasers}
    return {k for k, v in size.items() if v >= MAIN_SHARE * max(size.values())}


#: Elements whose end is implied by a sibling's start.
_CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
_NO_P = BLOCK_TAGS - SOFT - {"option", "optgroup"}


def blocks(page: str | None) -> tuple[list[str], bool]:
    """(blocks of text in page order, whether the page marks its main part)."""
    page = page or ""
    found: list[tuple[str, bool, int]] = []
    stack: list[tuple[str, int, bool, int]] = []  # element, dropped (2: by its element, 1: by a mark), in main, number of the article
    run: list[str] = []
    teasers: set[int] = set()
    dropped, main, nth, articles, any_main = 0, False, 0, 0, False

    def flush() -> None:
        nonlocal run
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            run = []
            if text:
                found.append((text, main, nth))

    def settle() -> None:
        nonlocal dropped, main, nth
        _, dropped, main, nth = stack[-1] if stack else ("", 0, False, 0)

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            if not dropped:
                run.append(page[at:])
            break
        if m.start() > at and not dropped:
            run.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in SOFT:
            run.append(" ")
            continue
        if name in BLOCK_TAGS:
            flush()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    settle()
                    break
            continue
        if name in _NO_P and name != "p" and stack and stack[-1][0] == "p":
            stack.pop()
            settle()
        elif name in _CLOSES and stack and stack[-1][0] in _CLOSES[name]:
            while stack and stack[-1][0] in _CLOSES[name]:
                stack.pop()
            settle()
        if name in VOID or m[3].endswith("/"):
            continue
        if name in HIDDEN or (name in DROPPED and not (name == "header" and main)):
            out = 2
        else:
            out = int(name not in ("html", "body", "main") and _marked(m[3]))
        if name in MAIN and not out and dropped == 1 and not any_main:
            dropped = 0  # a marked wrapper around the main part, such as "has-sidebar"
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        dropped = max(dropped, out)
        main = main or (name in MAIN and not dropped)
        any_main = any_main or main
        if name == "article" and not dropped and not nth:
            articles += 1
            nth = articles
            if any(x in TEASERS for parts in _names(m[3]) for x in parts):
                teasers.add(nth)
        stack.append((name, dropped, main, nth))
    flush()
    if not any_main:
        return [t for t, _, _ in found], False
    kept = _main_articles(found, teasers) if articles > 1 else {1}
    return [t for t, inside, k in found if inside and (not k or k in kept)], True


def suffix_array(tokens: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Order of the suffixes of an integer sequence, by prefix doubling; up to their first depth tokens if that is given."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        second = np.full(n, -1, np.int64)
        second[: max(0, n - step)] = rank[step:]
        order = np.lexsort((second, rank))
        new = np.concatenate(([0], ((rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1])).cumsum()))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if n == 0 or new[-1] == n - 1 or step >= n or (depth and 2 * step >= depth):
            return order
        step *= 2


def _window_groups(tokens: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, group of each of its places): suffixes of one group begin with the same `width` tokens."""
    n = len(tokens)
    sa = suffix_array(tokens, width)
    same = np.ones(n - 1, bool)  # common prefix of neighbours of at least width
    for d in range(width):
        a, b = sa[:-1] + d, sa[1:] + d
        inside = (a < n) & (b < n)
        same &= inside
        same[inside] &= tokens[a[inside]] == tokens[b[inside]]
    return sa, np.concatenate(([0], (~same).cumsum()))


def repeated_windows(tokens: np.ndarray, page: np.ndarray, width: int = MIN_RUN) -> np.ndarray:
    """Where a window of `width` tokens starts that occurs on another page too. Separators are tokens of their own."""
    n = len(tokens)
    out = np.zeros(n, bool)
    if n < width:
        return out
    sa, group = _window_groups(tokens, width)
    first = np.full(group[-1] + 1, n, np.int64)
    last = np.full(group[-1] + 1, -1, np.int64)
    np.minimum.at(first, group, page[sa])
    np.maximum.at(last, group, page[sa])
    out[sa] = (first < last)[group]
    return out


def window_pages(tokens: np.ndarray, page: np.ndarray, width: int = MIN_RUN) -> np.ndarray:
    """On how many pages the window of `width` tokens that starts at each place stands; 0 where the sequence ends before."""
    n = len(tokens)
    out = np.zeros(n, np.int64)
    if n < width:
        return out
    sa, group = _window_groups(tokens, width)
    pairs = np.unique(np.stack((group, page[sa]), axis=1), axis=0)
    out[sa] = np.bincount(pairs[:, 0])[group]
    out[n - width + 1 :] = 0
    return out


def _words(block: str) -> list[int]:
    h = xxhash.xxh64_intdigest
    return [h(w.encode()) >> 1 for w in block.split()]


def _stream(pages: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, page) over pages; every page is followed by a separator that occurs once."""
    tokens, page = [], []
    for i, words in enumerate(pages):
        tokens += [*words, -i - 1]
        page += [i] * (len(words) + 1)
    return np.array(tokens, np.int64), np.array(page, np.int64)


def _window_hashes(words: list[int]) -> list[int]:
    """Signed 64-bit hashes of a page's windows of MIN_RUN tokens."""
    a = np.array(words, np.uint64)
    return [xxhash.xxh64_intdigest(a[i : i + MIN_RUN].tobytes()) - (1 << 63) for i in range(len(a) - MIN_RUN + 1)]


def without_runs(text: str, starts: list[int]) -> str:
    """text without the blocks that windows at these words cover, and without covered runs of MIN_RUN words in others."""
    blocks_ = [part.split() for part in text.split("\n")]
    mask = np.zeros(sum(map(len, blocks_)), bool)
    for s in starts:
        mask[s : s + MIN_RUN] = True
    kept, at = [], 0
    for words in blocks_:
        gone = mask[at : at + len(words)]
        at += len(words)
        if gone.all():
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
        for i, j in edges.reshape(-1, 2).tolist():
            if j - i < MIN_RUN:
                gone[i:j] = False
        kept.append(" ".join(w for w, m in zip(words, gone.tolist(), strict=True) if not m))
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages."""
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, 256):
            got = [blocks(h) for h in b.column("html").to_pylist()]
            text = ["\n".join(t) for t, _ in got]
            words = pa.array([sum(len(x.split()) for x in t) for t, _ in got], pa.int64())
            cols = [b.column("page_id"), b.column("url"), pa.array(text, pa.string()), words, pa.array([not m and bool(t) for t, m in got])]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "words", "open"])

    cutted = materialize(with_text(src).mapInArrow(cut, "page_id long, url string, text string, words long, open boolean"), "html-blocks")
    sure = _without_common_runs(cutted.where(~F.col("open")))
    unsure = cutted.where("open")
    if not unsure.isEmpty():
        sure = sure.unionByName(_without_boilerplate(unsure))
    return sure.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def _host() -> Column:
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def _without_common_runs(marked: DataFrame) -> DataFrame:
    """Pages with a marked main part, without the runs that stand on most different pages of their host.

    A run on more than a share of a host's pages is on more than that share of some shard's, so each shard's suffix array
    gives few candidates; only these are counted over the whole host.
    """
    named = marked.withColumn("host", _host()).withColumn("row", F.xxhash64("host", "text"))
    # hosts of several shards only: no more rows than all tokens have shards
    big = named.groupBy("host").agg(F.ceil(F.sum("words") / SHARD_TOKENS).cast("int").alias("shards")).where("shards > 1")
    dealt = named.where(F.col("words") >= MIN_RUN).join(F.broadcast(big), "host", "left").withColumn("shard", F.pmod("row", F.coalesce("shards", F.lit(1))).cast("int"))
    # copies of a page become one where they arrive, before a shard is held
    # and words move as halves of their hashes
    cut = dealt.select("host", "shard", "row", "text").mapInArrow(_halves, "host string, shard int, row long, w binary")
    pages = cut.repartition("host", "shard").groupBy("host", "shard", "row").agg(F.min("w").alias("w"))

    def candidates(key, t):
        texts = [np.frombuffer(x, np.uint32).tolist() for x in t.column("w").to_pylist()]
        tok, page = _stream(texts)
        often = window_pages(tok, page) > COMMON_SHARE * len(texts)
        found, at = set(), 0
        for w in texts:
            a = np.array(w, np.uint64)
            found |= {xxhash.xxh64_intdigest(a[i : i + MIN_RUN].tobytes()) - (1 << 63) for i in np.flatnonzero(often[at : at + len(w) - MIN_RUN + 1]).tolist()}
            at += len(w) + 1
        return pa.table({"host": pa.array([key[0].as_py()] * len(found), pa.string()), "k": pa.array(list(found), pa.int64())})

    near = materialize(pages.groupBy("host", "shard").applyInArrow(candidates, "host string, k long").distinct(), "html-candidates")
    plain = marked.select("page_id", "url", "text")
    if near.isEmpty():
        return plain
    asked = named.join(near.select("host").distinct(), "host", "left_semi")
    placed = asked.select("host", "row", "text").mapInArrow(_windows, "host string, row long, start int, h long, k long").join(near, ["host", "k"])
    total = asked.groupBy("host").agg(F.count_distinct("row").alias("pages")).where(F.col("pages") >= COMMON_PAGES)
    counted = placed.groupBy("host", "h").agg(F.count_distinct("row").alias("n")).join(total, "host")
    common = counted.where((F.col("n") > COMMON_SHARE * F.col("pages")) & (F.col("n") >= COMMON_PAGES)).select("host", "h")
    covered = materialize(placed.join(common, ["host", "h"]).groupBy("row").agg(F.collect_set("start").alias("cover")), "html-covered")
    if covered.isEmpty():
        return plain
    return named.join(covered, "row", "left").select("page_id", "url", "text", "cover").mapInArrow(_prune, "page_id long, url string, text string")


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, shard, row, w) of (host, shard, row, text): the lower halves of the words' hashes."""
    for b in chunks(batches, 256):
        w = [(np.array(_words(x), np.uint64) & np.uint64(_HALF)).astype(np.uint32).tobytes() for x in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("host"), b.column("shard"), b.column("row"), pa.array(w, pa.binary())], names=["host", "shard", "row", "w"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, row, start, h, k) of every window of (host, row, text); k is of halves of the words' hashes."""
    for b in chunks(batches, 256):
        host, row, start, h, k = [], [], [], [], []
        for ho, r, text in zip(b.column("host").to_pylist(), b.column("row").to_pylist(), b.column("text").to_pylist(), strict=True):
            words = _words(text)
            for s, (x, y) in enumerate(zip(_window_hashes(words), _window_hashes([w & _HALF for w in words]), strict=True)):
                host.append(ho), row.append(r), start.append(s), h.append(x), k.append(y)
        cols = [pa.array(host, pa.string()), pa.array(row, pa.int64()), pa.array(start, pa.int32()), pa.array(h, pa.int64()), pa.array(k, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["host", "row", "start", "h", "k"])


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, text) without what the windows that start at cover hold."""
    for b in chunks(batches, 256):
        out = [without_runs(text, cover) if cover else text for text, cover in zip(b.column("text").to_pylist(), b.column("cover").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def _without_boilerplate(cutted: DataFrame) -> DataFrame:
    """Pages without a marked main part: blocks that runs shared by pages of the host cover are removed."""
    named = cutted.withColumn("host", _host()).withColumn("row", F.xxhash64("host", "text"))
    tokens = F.size(F.split("text", r"\s+"))
    shards = named.groupBy("host").agg(F.ceil(F.sum(tokens) / SHARD_TOKENS).cast("int").alias("shards"))
    dealt = materialize(named.join(shards, "host").withColumn("shard", F.pmod("row", F.greatest("shards", F.lit(1))).cast("int")), "html-dealt")

    def runs(key, t):
        """(host, hash, pages in this shard, two at most) of every window."""
        order = np.argsort(t.column("row").to_numpy(), kind="stable")
        t = t.take(pa.array(order))
        rows = t.column("row").to_numpy()
        _, who = np.unique(rows, return_inverse=True)
        pages = [_words(x) for x in t.column("text").to_pylist()]
        tok, page = _stream(pages)
        hit = repeated_windows(tok, who[page]) if len(tok) else np.zeros(0, bool)
        seen: dict[int, int] = {}
        at = 0
        for i, w in enumerate(pages):
            for d, h in enumerate(_window_hashes(w)):
                seen[h] = 2 if hit[at + d] else seen.get(h, 1)
            at += len(w) + 1
        host = key[0].as_py()
        return pa.table({"host": pa.array([host] * len(seen), pa.string()), "h": pa.array(list(seen), pa.int64()), "n": pa.array(list(seen.values()), pa.int64())})

    counted = dealt.select("host", "shard", "row", "text").groupBy("host", "shard").applyInArrow(runs, "host string, h long, n long")
    common = materialize(counted.groupBy("host", "h").agg(F.sum("n").alias("n")).where("n >= 2").select("host", "h"), "html-common")

    placed = dealt.select("host", "row", "text").mapInArrow(_windows, "host string, row long, start int, h long, k long").drop("k")
    covered = placed.join(common, ["host", "h"]).groupBy("row").agg(F.collect_set("start").alias("cover"))

    return dealt.join(covered, "row", "left").select("page_id", "url", "text", "cover").mapInArrow(_prune, "page_id long, url string, text string")
