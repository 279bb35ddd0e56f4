"""Main text of web pages: differences between neighbouring pages, guarded by structure.

A page's lines are its blocks, cut at block tags. Pages of a host are ordered by
path, each is paired with the neighbour whose path it shares most of, their
lines are aligned by longest common subsequence, and lines in it are deleted:
they are the template. Lines inside an article element are its author's and
stay. What a page doesn't share, as it is alone in its host or an advert is its
own, the structure tells: what is left in menus, headers, footers, sidebars,
notices, adverts, forms or comments goes, and so does what is outside the
article, where there is one.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, stored
from .url_filter import host, path

# Elements by what they do to the text.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
LEFT_OUT = {"nav", "header", "footer", "aside", "form", "button", "select", "svg", "template", "noscript", "menu", "dialog", "head", "object", "canvas"} | RAW
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "blockquote", "body", "center", "dd", "details", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6",
    "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption",
} | LEFT_OUT
MAIN = {"article", "main"}
#: Elements without text of the page.
UNSEEN = {"head", "template", "noscript", "object", "canvas", "svg"} | RAW
#: No class or id hides these.
SHOWN = {"html", "body"} | MAIN
MARKS = {
    "ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "cookies", "consent", "disclaimer",
    "footer", "header", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "related", "share", "sharing", "sidebar", "social",
    "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "dialog", "alert"}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>?", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


def _marks(value: str) -> bool:
    """Whether one of the names in a class or id is a mark, or made of marks alone, as cookie-banner."""
    return any(MARKS.issuperset(parts) for x in value.split() if (parts := [y for y in _SPLIT.split(x) if y]))


def _hidden(element: str, attrs: str) -> bool:
    """Whether an element's class, id or role says that it isn't main text."""
    for name, value in _ATTR.findall(attrs) if attrs else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "role" and value in ROLES) or (name in ("class", "id") and element not in SHOWN and _marks(value)):
            return True
    return False


def blocks(html: str | None) -> list[tuple[str, bool, bool]]:
    """(text, in an article, in an element that the structure leaves out) of each block, in page order.

    Unclosed elements end where an enclosing one ends, or with the page; end
    tags without a start are ignored. The head, scripts, styles and comments of
    the markup have no text.
    """
    source = html or ""
    out: list[tuple[str, bool, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, left out, main
    off = inside = unseen = 0
    at, n = 0, len(source)

    def close_block() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((text, inside > 0, off > 0))
            parts.clear()

    def pop() -> str:
        nonlocal off, inside, unseen
        closed, hides, main = stack.pop()
        off -= hides
        inside -= main
        unseen -= closed in UNSEEN
        return closed

    while at < n:
        m = _TAG.search(source, at)
        end = m.start() if m else n
        if end > at and not unseen:
            parts.append(source[at:end])
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name == "br":
            if not unseen:
                parts.append(" ")
            continue
        hides = name in LEFT_OUT or (not m[1] and _hidden(name, m[3]))
        if name in BLOCK or hides:
            close_block()
        if m[1]:
            if any(s[0] == name for s in stack):
                if name in BLOCK or any(s[0] == name and s[1] for s in stack):
                    close_block()
                while pop() != name:
                    pass
        elif name not in VOID and not m[3].endswith("/"):
            if name in RAW:
                stop = re.compile(rf"</{name}\b[^>]*>?", re.I).search(source, at)
                at = stop.end() if stop else n
                continue
            if name == "p":  # a paragraph ends the one before
                while stack and stack[-1][0] in ("p", "b", "i", "em", "strong", "a", "span", "u", "font") and any(s[0] == "p" for s in stack):
                    pop()
            main = name in MAIN
            stack.append((name, hides, main))
            off += hides
            inside += main
            unseen += name in UNSEEN
    close_block()
    return out


def kept(found: list[tuple[str, bool, bool]]) -> list[int]:
    """Places of the blocks that the structure keeps."""
    article = any(inside and not off for _, inside, off in found)
    return [k for k, (_, inside, off) in enumerate(found) if not off and (inside or not article)]


def _ends(x: list[int], y: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of x with each beginning of y, a bit of a long number for each place of y."""
    masks: dict[int, int] = {}
    for j, v in enumerate(y):
        masks[v] = masks.get(v, 0) | 1 << j
    full = (1 << len(y)) - 1
    row = full
    for v in x:
        if m := masks.get(v):
            hit = row & m
            row = (row + hit | row - hit) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(y) // 8 + 1, "little"), np.uint8), count=len(y), bitorder="little")
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_lines(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places in a and in b of a longest common subsequence, at any length.

    Equal ends are matched first. Of the rest, one is halved and the other cut
    where the two halves have most in common, so memory grows with the lines and
    not with their pairs.
    """
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            found.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            found.append((i1, j1))
        x, y = a[i0:i1], b[j0:j1]
        if not x or not y or not set(x) & set(y):
            continue
        if len(x) == 1:
            found.append((i0, j0 + y.index(x[0])))
            continue
        mid = len(x) // 2
        cut_at = int(np.argmax(_ends(x[:mid], y) + _ends(x[mid:][::-1], y[::-1])[::-1]))
        todo += [(i0, i0 + mid, j0, j0 + cut_at), (i0 + mid, i1, j0 + cut_at, j1)]
    return sorted(found)


def _shared(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def neighbours(lines: DataFrame) -> DataFrame:
    """lines (page, host, path, lines) with those of the page before and after in the host, by path.

    The rows are sorted in ranges over all hosts and numbered, so that a host
    with very many pages is spread over many tasks.
    """
    number = F.monotonically_increasing_id()
    ranked = stored(lines.orderBy("host", "path", "page").withColumn("at", number))
    part = F.shiftright("at", 33).cast("int")
    sizes = {r[0]: r[1] for r in ranked.groupBy(part.alias("p")).agg(F.count("*")).collect()}
    base, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        base.append(total)
        total += sizes.get(p, 0)
    if not base:
        return ranked.select("page", "path", "lines", *[F.lit(None).cast(t).alias(c) for c, t in (("path_0", "string"), ("lines_0", "array<bigint>"), ("path_1", "string"), ("lines_1", "array<bigint>"))])
    offset = F.element_at(F.lit(base), part + 1).cast("long")
    rows = ranked.select("page", F.xxhash64("host").alias("host"), "path", "lines", (offset + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("n"))
    out = rows
    for k, step in enumerate((1, -1)):
        other = rows.select((F.col("n") + step).alias(f"n_{k}"), F.col("host").alias(f"host_{k}"), F.col("path").alias(f"path_{k}"), F.col("lines").alias(f"lines_{k}"))
        out = out.join(other, (F.col("n") == F.col(f"n_{k}")) & (F.col("host") == F.col(f"host_{k}")), "left")
    return out.select("page", "path", "lines", "path_0", "lines_0", "path_1", "lines_1")


def _deletions(pairs: DataFrame) -> DataFrame:
    """(page, shared): places of the lines that a page shares with its nearest neighbour."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, gone = [], []
            for row, (own, lines, path_0, lines_0, path_1, lines_1) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
                near = [(-_shared(own, p), k, x) for k, (p, x) in enumerate(((path_0, lines_0), (path_1, lines_1))) if p is not None]
                if near and (found := [i for i, _ in common_lines(lines, min(near)[2])]):
                    at.append(row)
                    gone.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(gone, pa.list_(pa.int64()))], names=["page", "shared"])

    kind = pairs.schema["page"].dataType.simpleString()
    return pairs.select("page", "path", "lines", "path_0", "lines_0", "path_1", "lines_1").mapInArrow(run, f"page {kind}, shared array<bigint>")


def _identity(*columns: Column) -> Column:
    """Two hashes of 64 bits, as 10^10 rows would have equal ones under one."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit("and"), *columns).alias("b"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_shared) for every row of pages; blocks are joined by an empty line.

    Lines that the nearest page of the host shares go, but for those inside an
    article element; n_shared counts those that go. Pages of a host with the
    same lines are copies: they are one page, at the first of their paths, and
    are compared with the nearest that isn't one of them. Pages alone in their
    host have no differences; there the structure decides. Null html is empty
    and gives an empty text; null urls and urls without :// share a nameless
    host; pages of any length are aligned exactly; equal rows get equal texts;
    ties go to the page before; extra columns are not read; no rows give no
    rows.
    """
    key = _identity(F.col(id_col), F.col(url_col), F.col(html_col))
    rows = pages.select(key.alias("key"), F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    digest = xxhash.xxh3_64_intdigest

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [blocks(x) for x in batch.column(3).to_pylist()]
            hashes = [[digest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for t, *_ in x] for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(hashes, pa.list_(pa.int64()))], names=["key", "host", "path", "lines"])

    narrow = rows.select("key", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "html")
    own = narrow.mapInArrow(lines, "key struct<a:bigint,b:bigint>, host string, path string, lines array<bigint>").where(F.size("lines") > 0)
    own = stored(own.withColumn("page", _identity(F.col("host"), F.col("lines"))))
    one = own.groupBy("page").agg(F.min("host").alias("host"), F.min("path").alias("path"), F.first("lines").alias("lines"))
    shared = _deletions(neighbours(one)).withColumnRenamed("page", "of")
    gone = own.join(shared, F.col("page") == F.col("of")).select(F.col("key").alias("gone_key"), "shared").dropDuplicates(["gone_key"])
    kind = rows.schema["page_id"].dataType.simpleString()

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [blocks(x) for x in batch.column(3).to_pylist()]
            at = [kept(x) for x in found]
            own = [[x[k][0] for k in places] for x, places in zip(found, at, strict=True)]
            inside = [[k for k, b in enumerate(x) if b[1]] for x in found]
            ints = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(own, pa.list_(pa.string())), pa.array(at, ints), pa.array(inside, ints)], names=["key", "page_id", "url", "texts", "at", "inside"])

    parsed = rows.mapInArrow(texts, f"key struct<a:bigint,b:bigint>, page_id {kind}, url string, texts array<string>, at array<bigint>, inside array<bigint>")
    both = parsed.join(gone, F.col("key") == F.col("gone_key"), "left")
    lost = F.coalesce(F.array_except("shared", "inside"), F.array().cast("array<bigint>"))
    left = F.filter("texts", lambda t, k: ~F.array_contains(F.col("lost"), F.get("at", k)))
    return both.withColumn("lost", lost).select("page_id", "url", F.array_join(left, "\n\n").alias("text"), F.size("lost").cast("long").alias("n_shared"))
