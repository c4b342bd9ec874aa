"""HTML extraction with nearest-URL page differencing.

A page is cut into text blocks by a tolerant scanner: block tags separate, inline tags
don't, character references are decoded, white space within a block is one space.
Blocks inside elements that never hold the article (menus, headers, footers, asides,
forms, scripts, ...) or whose class, id or role names an advert, a notice, a sidebar or
reader comments, are furniture.

Each page is then compared with its neighbours: pages of a host are ordered by URL path,
and the lines (blocks) of a page are aligned with those of the page before and the page
after by longest common subsequence; lines that both have are shared furniture and are
deleted wherever markup leaves them open: all lines outside furniture on pages without an
``article`` or ``main`` element, and in such an element the parts whose class or id has a
word that could mean furniture (``section-header``, ``notice``). Other lines of an article
are not deleted for being shared: neighbouring pages may hold copies of the same article or
the same sentence, and the contract is to keep the article whole. A neighbour that shares
``NEARLY`` of the characters outside furniture is a copy; it says nothing about the page,
and deletes nothing.

Only line hashes and lengths travel to the ordering; the extracted texts then meet the lists of
shared lines in one join.

Edge cases: null or empty html gives an empty text; pages without a host, or without a
url, are a host of their own; repeated pages are neighbours of each other, and pages of
equal path stand in the order of url, id and content; unclosed elements end with the element
around them. Very long pages are cut whole, and lines of any number are aligned in steps
in proportion to their equal pairs. An empty table gives an empty result; other columns are
not read, so names that clash with the result's do no harm.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage, tidy

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>\x00]*)((?:=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))|[^>])*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*))?")
_SPACE = re.compile(r"\s+")

# Elements by their role in the HTML standard.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "ruby", "rb", "rp", "rt", "rtc", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "picture", "source", "br"}
FURNITURE = {"head", "script", "style", "noscript", "template", "nav", "footer", "aside", "form", "button", "select", "option", "textarea", "input", "iframe", "svg", "canvas", "object", "embed", "audio", "video", "map", "menu", "dialog", "title", "datalist", "fieldset", "noembed", "noframes"}
MAIN = {"article", "main"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "alertdialog", "menu", "menubar"}
# Words of class and id names that mark furniture.
NAMES = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "sidebar side aside menu nav navbar navigation breadcrumb breadcrumbs header masthead footer foot share sharing social related recommended newsletter subscribe subscription signup login search toolbar "
    "comment comments commentlist disqus respond reply replies discussion pagination pager copyright legal widget".split()
)
# Whole class and id names that mark furniture inside an article, too.
OUTRIGHT = set(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsored sponsored-content sidebar navbar breadcrumb breadcrumbs pagination newsletter newsletter-signup "
    "cookie-banner cookie-consent cookie-notice share-buttons social-share social-links sharing related-posts related-articles comments comment-list comments-list commentlist comment-form comment-section reader-comments disqus-thread".split()
)


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): entities.unescape(v.strip("\"'")) for k, v in _ATTR.findall(raw)}


def _is_furniture(tag: str, raw: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element is furniture, and whether its name only raises a suspicion. Inside
    the article a name has to be one of OUTRIGHT as a whole; a part of it that could mean
    furniture (section-header, side-by-side, notice) leaves the verdict to differencing."""
    if tag in FURNITURE:
        return True, False
    if tag in ("html", "body") or not raw.strip():
        return False, False
    at = _attributes(raw)
    if at.get("role", "").lower() in ROLES or "hidden" in at or at.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", at.get("style", ""), re.I):
        return True, False
    if tag in MAIN:
        return False, False
    called = f"{at.get('class', '')} {at.get('id', '')}"
    named = not NAMES.isdisjoint(re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", called).lower()))
    if not inside:
        return named, False
    return not OUTRIGHT.isdisjoint(called.lower().replace("_", "-").split()), named


def blocks_of(page: str) -> list[tuple[str, bool, int]]:
    """(text, in furniture, place) of each block with text; place: 1 in an article or main
    element, 2 in a part of one whose name raises a suspicion, 0 elsewhere."""
    out: list[tuple[str, bool, int]] = []
    buffer: list[str] = []
    stack: list[tuple[str, bool, int]] = []  # tag, furniture here or above, place

    def flush() -> None:
        if buffer:
            text = _SPACE.sub(" ", "".join(buffer)).strip()
            buffer.clear()
            if text:
                out.append((text, stack[-1][1] if stack else False, stack[-1][2] if stack else 0))

    def pop_to(k: int) -> None:
        while len(stack) > k:
            if stack[-1][0] not in INLINE:
                flush()
            stack.pop()

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            buffer.append(entities.unescape(page[at:]))
            break
        if m.start() > at:
            buffer.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        if m[0].startswith("<![CDATA["):
            continue
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "br":
                buffer.append(" ")
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if k is not None and (tag not in INLINE or all(s[0] in INLINE or s[0] == tag for s in stack[k:])):
                pop_to(k)
            elif tag not in INLINE:
                flush()
            continue
        raw = m[3]
        if tag == "br":
            buffer.append(" ")
            continue
        inline = tag in INLINE
        if tag in CLOSES_P:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p" or stack[i][0] in ("div", "td", "article", "section", "main", "body", "li")), None)
            if k is not None and stack[k][0] == "p":
                pop_to(k)
        if tag in SIBLINGS:
            k = len(stack) - 1
            while k >= 0 and (stack[k][0] in INLINE or stack[k][0] == "p"):
                k -= 1
            if k >= 0 and stack[k][0] in SIBLINGS[tag]:
                pop_to(k)
                if tag == "tr" and stack and stack[-1][0] == "tr":
                    pop_to(len(stack) - 1)
        if not inline:
            flush()
        above = stack[-1] if stack else ("", False, 0)
        # A header inside an article is the article's own (its title); elsewhere it is the page's.
        header = tag == "header" and not above[2]
        outright, suspect = _is_furniture(tag, raw, bool(above[2]))
        furniture = above[1] or header or outright
        if inline and furniture and not above[1]:
            # An inline element hidden or marked as an advert: a block of its own.
            flush()
        if tag in RAW and not raw.rstrip().endswith("/"):
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag in VOID or raw.rstrip().endswith("/") and tag not in ("p", "div", "a", "b", "li", "span"):
            continue
        if inline and furniture and not above[1]:
            stack.append((f"{tag}", True, above[2]))
            continue
        stack.append((tag, furniture, max(above[2], int(tag in MAIN), 2 * (suspect and above[2] > 0))))
    pop_to(0)
    flush()
    return out


def line_hashes(blocks: list[tuple[str, bool, int]]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(t.encode()) for t, _, _ in blocks], np.uint64)


#: Share of a page's characters outside furniture that only a copy of it has too.
NEARLY = 0.9


def packed_lines(blocks: list[tuple[str, bool, int]]) -> bytes:
    """Line hashes, then each line's characters, 0 in furniture."""
    return line_hashes(blocks).tobytes() + np.array([0 if furniture else len(t) for t, furniture, _ in blocks], np.uint32).tobytes()


def unpacked_lines(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 12
    return np.frombuffer(data, np.uint64, n), np.frombuffer(data, np.uint32, n, 8 * n)


def common_lines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places in a of a longest common subsequence with b. Equal ends are taken first;
    the rest is matched by the points (i, j) of equal lines, taken in order of i with j
    falling, whose longest rising chain is the subsequence (Hunt and Szymanski)."""
    import bisect

    n, m = len(a), len(b)
    k = min(n, m)
    head = int(np.argmax(np.append(a[:k] != b[:k], True)))
    tail = int(np.argmax(np.append(a[n - (k - head) :][::-1] != b[m - (k - head) :][::-1], True))) if k > head else 0
    where: dict[int, list[int]] = {}
    for j in range(m - tail - 1, head - 1, -1):
        where.setdefault(int(b[j]), []).append(j)
    ends: list[int] = []
    last: list[tuple] = []
    for i in range(head, n - tail):
        for j in where.get(int(a[i]), ()):
            p = bisect.bisect_left(ends, j)
            link = (i, last[p - 1] if p else None)
            if p == len(ends):
                ends.append(j)
                last.append(link)
            else:
                ends[p], last[p] = j, link
    middle, link = [], last[-1] if last else None
    while link:
        middle.append(link[0])
        link = link[1]
    return np.array([*range(head), *reversed(middle), *range(n - tail, n)], np.int64)


_PARTS = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("page_sha", T.LongType()), T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("lines", T.BinaryType())])
_URL = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)")


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Line hashes of each page, with its host and path."""
    for batch in batches:
        rows = []
        for page_id, url, sha, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            m = _URL.match(url or "")
            rows.append((page_id, url, sha, m[1].lower() if m else "", m[2] if m else url or "", packed_lines(blocks_of(page or ""))))
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()), strict=True)], _PARTS.names)


_SHARED = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("page_sha", T.LongType()), T.StructField("shared", T.BinaryType()), T.StructField("gone", T.BinaryType())])


def deleted(chars: np.ndarray, shared: list[np.ndarray]) -> np.ndarray:
    """Of a page's lines, by their characters, and the places that each neighbour shares:
    the places to delete. Neighbours that leave next to nothing are copies; where only both
    together do, what both share goes."""
    least = NEARLY * int(chars.sum())
    shared = [x for x in shared if int(chars[x].sum()) < least]
    if not shared:
        return np.empty(0, np.int64)
    every = np.unique(np.concatenate(shared))
    return every if int(chars[every].sum()) < least else np.intersect1d(*shared)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the lines of the page before and after: the places of shared lines,
    and of those to delete."""
    for batch in batches:
        rows = []
        for page_id, url, sha, mine, before, after in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "page_sha", "lines", "before", "after")), strict=True):
            a, chars = unpacked_lines(mine)
            shared = [common_lines(a, unpacked_lines(x)[0]) for x in (before, after) if x]
            both = np.unique(np.concatenate(shared)) if shared else np.empty(0, np.int64)
            if len(both):
                rows.append((page_id, url, sha, both.astype("<i4").tobytes(), deleted(chars, shared).astype("<i4").tobytes()))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], _SHARED.names)


def neighbours(parts: DataFrame) -> DataFrame:
    """parts with the lines of the page before and after in the host's order of paths.
    A host of any size is spread over tasks: pages are dealt in ranges of (host, path),
    and the pages at the edges of ranges meet those of the next range in a small join."""
    order = ["host", "path", "url", "page_id", "page_sha"]
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    # written first: sampling the ranges would cut every page a second time
    ranged = stage(stage(parts, "lines").repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "ranges")
    from pyspark.sql import Window

    within = Window.partitionBy("range").orderBy("place")
    beside = ranged.select("*", F.lag(F.struct("host", "lines")).over(within).alias("b"), F.lead(F.struct("host", "lines")).over(within).alias("a"))
    # Two rows per range: its first and its last page. The one before a range's first is the last of the range before.
    edges = ranged.groupBy("range").agg(F.min_by(F.struct("host", "lines"), "place").alias("first"), F.max_by(F.struct("host", "lines"), "place").alias("last"))
    chain = Window.orderBy("range")
    edges = edges.select("range", F.lag("last").over(chain).alias("eb"), F.lead("first").over(chain).alias("ea"))
    joined = beside.join(edges, "range")
    b, a = F.coalesce("b", "eb"), F.coalesce("a", "ea")
    return joined.select(
        "page_id", "url", "page_sha", "lines",
        F.when(b["host"] == F.col("host"), b["lines"]).alias("before"), F.when(a["host"] == F.col("host"), a["lines"]).alias("after"),
    )


_BLOCKS = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("page_sha", T.LongType()), T.StructField("text", T.StringType()), T.StructField("places", T.BinaryType())])
TEXTS = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_lines", T.LongType()), T.StructField("n_shared_lines", T.LongType())])


def candidates(page: str) -> tuple[list[tuple[int, str, bool]], int]:
    """The blocks that may be of the article with their places, and whether differencing
    decides on them; and the number of blocks. With an article or main element that has
    text: its blocks, of which markup leaves the suspect ones open; else all blocks, all
    open. Furniture never counts."""
    blocks = blocks_of(page)
    inside = [(k, t, place == 2) for k, (t, furniture, place) in enumerate(blocks) if place and not furniture]
    return inside or [(k, t, True) for k, (t, furniture, _) in enumerate(blocks) if not furniture], len(blocks)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for page in batch.column(3).to_pylist():
            kept, n = candidates(page or "")
            # places of blocks on which markup has decided are written as -1
            rows.append(("\n\n".join(t for _, t, _ in kept), np.array([n, *(k if undecided else -1 for k, _, undecided in kept)], "<i4").tobytes()))
        cols = list(zip(*rows, strict=True)) or [[]] * 2
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary())], _BLOCKS.names)


def _delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Deletes shared lines on which markup has not decided."""
    for batch in batches:
        texts, lines, common = [], [], []
        for text, places, shared, gone in zip(*(batch.column(c).to_pylist() for c in ("text", "places", "shared", "gone")), strict=True):
            places = np.frombuffer(places, "<i4")
            drop = set(np.frombuffer(gone, "<i4").tolist()) if gone else set()
            if drop and text:
                text = "\n\n".join(t for t, k in zip(text.split("\n\n"), places[1:].tolist(), strict=True) if k not in drop)
            texts.append(text)
            lines.append(int(places[0]))
            common.append(len(shared or b"") // 4)
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(lines, pa.int64()), pa.array(common, pa.int64())], TEXTS.names)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, lines of the page and lines that a neighbour shares,
    of each row of pages (page_id, url, html)."""
    pages = pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "xxhash64(html) page_sha", "cast(html as string) html")
    shared = neighbours(pages.mapInArrow(tidy(_describe), _PARTS)).mapInArrow(tidy(_compare), _SHARED)
    # Repeated rows are neighbours of each other; one of their lists stands for all.
    shared = shared.groupBy("page_id", "url", "page_sha").agg(F.max("shared").alias("shared"), F.max("gone").alias("gone")).withColumnsRenamed({"page_id": "p", "url": "u", "page_sha": "h"})
    joined = pages.mapInArrow(tidy(_cut), _BLOCKS).join(shared, F.expr("page_id <=> p and url <=> u and page_sha = h"), "left")
    return joined.select("page_id", "url", "text", "places", "shared", "gone").mapInArrow(tidy(_delete), TEXTS)
