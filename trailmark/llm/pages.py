"""Main text of web pages by nearest-URL differencing and structure.

A page becomes lines: one for each block, with the region it stands in and the path of its elements (tags, words of class and id).
The different pages of a host are put in the order of their URL paths; each is paired with the neighbour that shares the longer
path prefix, and the lines of a pair are aligned by longest common subsequence. Shared lines outside the article are template and
are deleted. They also tell where the host's template is: an element path outside articles on which lines are shared is template on
the whole host, and so is a path of pages without a marked article where at least TEMPLATE_PERCENT of the lines are shared; all
lines on such a path are deleted, also those that change from page to page. What a page marks as its article is never deleted as
shared: two articles share a paragraph by chance. What then remains outside a marked article, and what tags or names call a menu,
notice, advert, form or comment, goes by structure: menus and adverts that change from page to page are shared with no neighbour.

Each page is parsed once, into a table in the shared folder. Pairing moves line hashes only. Hosts are cut into ranges by a range
partitioning of host and path, so that a host with a third of all pages is many ranges; a page at a range's edge takes its
neighbour from the table of edges.

Cases: a null or empty page has no text; a page with a null or empty URL has no host and is judged by structure, as is a page alone on its
host; a URL without host is its own host; pages of one host with equal lines are one page to pairing, at the least of their URLs, so
that a page published twice isn't its own template; repeated rows are each answered; very long and very deep pages are taken whole, in time
that grows with their length, also where tags or quotes stay open; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import column, cut, staged, text_column

#: Elements that begin and end a block (fixed values).
BLOCKS = set("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()) - {"br"}
#: Elements without an end tag (fixed values).
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text (fixed values).
SILENT = set("script style noscript template svg math iframe object head title textarea select button canvas audio video".split())
#: Elements outside an article (fixed values).
OUTSIDE = set("nav header footer aside form menu dialog".split())
#: Words in class, id or role that say the same of any element (fixed values).
OUTSIDE_WORDS = set("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer discussion footer form header login masthead menu modal nav navbar navigation newsletter notice notification pagination popup promo related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
ROLES = {"banner", "navigation", "complementary", "contentinfo", "search", "form", "dialog", "alert", "menu", "menubar"}
INSIDE = {"article", "main"}
#: Tags that end an open paragraph (fixed values).
END_PARAGRAPH = BLOCKS - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: Elements that implied end tags close, and the elements that keep them open (fixed values).
IMPLIED = {"p": {"article", "main", "body", "div", "section", "td", "th", "li", "blockquote", "button"}, "li": {"ul", "ol", "menu"}}
SCOPES = {*IMPLIED, *set().union(*IMPLIED.values())}
DROPPED, OPEN, ARTICLE = 0, 1, 2
#: The share of a path's lines that must be shared where no article is marked.
TEMPLATE_PERCENT = 80
#: Bytes of deletions, or of template paths, that are broadcast at most.
MOST_BROADCAST = 8 << 20
#: Bits of the table of an alignment that is kept at once; longer pages are halved.
MOST_BITS = 1 << 26


#: Text, or markup: comments, declarations, processing instructions, tags with their attributes.
TOKEN = re.compile(r"([^<]+)|<!--(?:[\s\S]*?-->|[\s\S]*)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>|<[!?/][^>]*>?|<")
#: A tag that ends at the next >, for the rest of a page in which a quote stays open.
PLAIN_TAG = re.compile(r"(\A(?!))?<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""([^\s=\"'/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: Elements whose content is not markup (fixed values).
RAW = set("script style textarea title".split())


class Element(NamedTuple):
    tag: str
    region: int
    silent: bool
    path: int  #: a hash of the block elements from the root down to here
    open: dict[str, int]  #: for p and li: the place of the one that an implied end tag would close here


class Blocks:
    """Collects (region, path, text) of each block, in page order."""

    def __init__(self):
        self.lines: list[tuple[int, int, str]] = []
        self.parts: list[str] = []
        self.stack: list[Element] = [Element("", OPEN, False, 0, {})]
        self.counts: Counter[str] = Counter()

    def feed(self, html: str) -> None:
        at, end, last, quoted = 0, len(html), html.rfind(">"), True
        while at < end:
            if at > last and html[at] == "<":  # no tag ends any more; declarations and end tags run to the end
                m = re.compile(r"<[!?/]").search(html, at)
                if not self.stack[-1].silent:
                    self.parts.append(unescape(html[at : m.start() if m else end]))
                break
            m = TOKEN.match(html, at) if quoted or html[at] != "<" else PLAIN_TAG.match(html, at) or TOKEN.match(html, at)
            if m[0] == "<" and html[at + 1 : at + 2].isalpha() and html[at + 1].isascii():
                quoted, m = False, PLAIN_TAG.match(html, at)
            at = m.end()
            if (data := m[1]) is not None:
                if not self.stack[-1].silent:
                    self.parts.append(unescape(data) if "&" in data else data)
            elif (name := m[3]) is not None:
                tag = name.lower()
                if m[2]:
                    self.end_tag(tag)
                    continue
                self.start_tag(tag, m[4])
                if tag in RAW and not m[4].endswith("/"):
                    close = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                    if tag not in SILENT and close:
                        self.parts.append(html[at : close.start()])
                    at = close.end() if close else end
                    self.end_tag(tag)
            elif m[0] == "<" and not self.stack[-1].silent:
                self.parts.append("<")
        self.end_block()

    def end_block(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text:
                self.lines.append((self.stack[-1].region, self.stack[-1].path, text))

    def start_tag(self, tag: str, rest: str) -> None:
        if tag in END_PARAGRAPH:
            self.end_open("p")
        if tag == "li":
            self.end_open("li")
        block = tag in BLOCKS or tag in OUTSIDE
        if block:
            self.end_block()
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        above = self.stack[-1]
        region, named, role, hidden = above.region, set(), "", False
        if rest.strip():
            for key, *values in ATTRIBUTE.findall(rest):
                key, value = key.lower(), "".join(values).lower()
                if key in ("class", "id"):
                    named.update(re.split(r"[^a-z]+", value))
                elif key == "role":
                    role = value
                hidden = hidden or key == "hidden" or (key == "aria-hidden" and value == "true")
        if tag in INSIDE and region == OPEN and not named & {"comment", "comments", "reply"}:
            region = ARTICLE
        elif (tag in OUTSIDE or named & OUTSIDE_WORDS or role in ROLES or hidden) and tag not in ("html", "body"):
            region = DROPPED
        open_ = {t: len(self.stack) if t == tag else above.open.get(t, 0) for t, until in IMPLIED.items() if t == tag or tag not in until} if tag in SCOPES else above.open
        self.stack.append(Element(tag, region, above.silent or tag in SILENT, path_hash(above.path, tag, frozenset(named)) if block else above.path, open_))
        self.counts[tag] += 1

    def pop(self, at: int) -> None:
        """Ends all elements from a place of the stack on."""
        for e in self.stack[at:]:
            self.counts[e.tag] -= 1
        del self.stack[at:]

    def end_open(self, tag: str) -> None:
        """Ends the innermost open `tag`, unless it is outside of an element that keeps it open."""
        if at := self.stack[-1].open.get(tag, 0):
            self.end_block()
            self.pop(at)

    def end_tag(self, tag: str) -> None:
        if tag in BLOCKS or tag in OUTSIDE:
            self.end_block()
        if not self.counts[tag]:
            return
        at = next(i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i].tag == tag)
        if any(e.tag in BLOCKS for e in self.stack[at + 1 :]):
            self.end_block()
        self.pop(at)


@lru_cache(1 << 16)
def path_hash(above: int, tag: str, named: frozenset[str]) -> int:
    return xxhash.xxh64_intdigest(f"{above} {tag} {' '.join(sorted(named - {''}))}".encode("utf-8", "surrogatepass")) - (1 << 63)


def blocks(html: str) -> list[tuple[int, int, str]]:
    """(region, path, text) of each block. Where the page marks an article, blocks that stand outside it are dropped."""
    parser = Blocks()
    parser.feed(html)
    marked = any(r == ARTICLE for r, *_ in parser.lines)
    return [(DROPPED if marked and r == OPEN else r, p, t) for r, p, t in parser.lines]


def _rows_of(own: list[int], places: dict[int, int], width: int) -> Iterator[int]:
    """For each line of `own` the bit vector of the places where the common subsequence with the lines so far doesn't grow (bit-parallel)."""
    full = (1 << width) - 1
    v = full
    for h in own:
        u = v & places.get(h, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _places(other: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for j, h in enumerate(other):
        out[h] = out.get(h, 0) | 1 << j
    return out


def _lengths(own: list[int], other: list[int]) -> np.ndarray:
    """The longest common subsequence of all of `own` with each prefix of `other`."""
    v = (1 << len(other)) - 1
    for v in _rows_of(own, _places(other), len(other)):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(other) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(other)]
    return np.append(0, np.cumsum(bits == 0))


def shared_lines(own: list[int], other: list[int]) -> list[int]:
    """Which lines of `own` are in a longest common subsequence with `other`. Common heads and tails are cut off, lines that the other side
    lacks are left out, and long rests are halved, so that memory stays bounded."""
    out, todo = [], [(own, other, list(range(len(own))))]
    while todo:
        x, y, at = todo.pop()
        head = 0
        while head < min(len(x), len(y)) and x[head] == y[head]:
            head += 1
        tail = 0
        while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
            tail += 1
        out += at[:head] + at[len(x) - tail :]
        both = set(x[head : len(x) - tail]) & set(y[head : len(y) - tail])
        inner = [(h, i) for h, i in zip(x[head : len(x) - tail], at[head : len(x) - tail], strict=True) if h in both]
        x, at, y = [h for h, _ in inner], [i for _, i in inner], [h for h in y[head : len(y) - tail] if h in both]
        if len(x) > 1 and len(x) * len(y) > MOST_BITS:
            half = len(x) // 2
            cut_ = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
            todo += [(x[:half], y[:cut_], at[:half]), (x[half:], y[cut_:], at[half:])]
            continue
        kept = [*_rows_of(x, _places(y), len(y))]
        i, j = len(x) - 1, len(y) - 1
        while i >= 0 and j >= 0:
            if kept[i] >> j & 1:  # nothing ends at this place of y
                j -= 1
            elif i and not kept[i - 1] >> j & 1:  # it is reached without this line
                i -= 1
            else:
                out.append(at[i])
                i, j = i - 1, j - 1
    return sorted(out)


def parsed(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """key, url, host, path (of the URL), content (a hash of the page's lines), texts, lines (hashes), regions and paths of each page."""
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))

    def run(batches):
        for batch in batches:
            found = [blocks(x) for x in text_column(batch, "html").to_pylist()]
            lines = [[xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for *_, t in page] for page in found]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "key"), column(batch, "url"), pa.array([[t for *_, t in page] for page in found], pa.list_(pa.string())), pa.array(lines, pa.list_(pa.int64())), pa.array([[r for r, *_ in page] for page in found], pa.list_(pa.int32())), pa.array([[p for _, p, _ in page] for page in found], pa.list_(pa.int64()))],
                ["key", "url", "texts", "lines", "regions", "paths"],
            )

    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(run, f"key {kind}, url string, texts array<string>, lines array<bigint>, regions array<int>, paths array<bigint>")
    host = F.lower(F.regexp_extract("url", r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_replace("url", r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//[^/?#]*", "")
    return out.select("key", "url", F.when(host != "", host).when(F.col("url") != "", F.col("url")).alias("host"), path.alias("path"), F.xxhash64("lines", "regions", "paths").alias("content"), "texts", "lines", "regions", "paths")


def paired(rows: DataFrame) -> DataFrame:
    """The different contents of each host, with before and after: URL path and lines of the neighbours there."""
    first = lambda c: F.first(c).alias(c)
    distinct = rows.filter("host IS NOT NULL").groupBy("host", "content").agg(F.min("path").alias("path"), first("lines"), first("regions"), first("paths"))
    ranged = cut(distinct.repartitionByRange("host", "path", "content").sortWithinPartitions("host", "path", "content").withColumn("part", F.spark_partition_id()))
    near = F.struct("host", "path", "lines")
    order = Window.partitionBy("part").orderBy("host", "path", "content")
    edges = ranged.groupBy("part").agg(F.min_by(near, F.struct("host", "path", "content")).alias("first"), F.max_by(near, F.struct("host", "path", "content")).alias("last"))
    across = Window.orderBy("part")  # one row for each range
    edges = edges.select("part", F.lag("last").over(across).alias("before_part"), F.lead("first").over(across).alias("after_part"))
    both = ranged.withColumn("before", F.lag(near).over(order)).withColumn("after", F.lead(near).over(order)).join(F.broadcast(edges), "part")
    sides = [F.coalesce("before", "before_part"), F.coalesce("after", "after_part")]
    return both.select("host", "content", "path", "lines", "regions", "paths", *(F.when(s["host"] == F.col("host"), F.struct(s["path"].alias("path"), s["lines"].alias("lines"))).alias(n) for s, n in zip(sides, ("before", "after"), strict=True)))


def differenced(pairs: DataFrame) -> DataFrame:
    """host, content, regions, paths and shared: the numbers of the lines outside articles that the page shares with its neighbour."""

    def prefix(a: str, b: str) -> int:
        return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

    def run(batches):
        for batch in batches:
            out = []
            for path, lines, regions, *sides in zip(*(column(batch, c).to_pylist() for c in ("path", "lines", "regions", "before", "after")), strict=True):
                best = max((s for s in sides if s), key=lambda s: prefix(path, s["path"]), default=None)
                out.append([i for i in shared_lines(lines, best["lines"]) if regions[i] != ARTICLE] if best else [])
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in kept), pa.array(out, pa.list_(pa.int32()))], [*kept, "shared"])

    kept = ("host", "content", "regions", "paths")
    return pairs.mapInArrow(run, "host string, content bigint, regions array<int>, paths array<bigint>, shared array<int>")


def template(found: DataFrame) -> DataFrame:
    """host and template: the element paths of the host that its shared lines tell to be template."""
    lines = found.select("host", "shared", F.posexplode(F.arrays_zip("regions", "paths")).alias("i", "at")).filter(F.col("at.regions") != ARTICLE)
    counts = lines.groupBy("host", F.col("at.paths").alias("path")).agg(F.count("*").alias("n"), F.count_if(F.array_contains("shared", F.col("i"))).alias("n_shared"), F.max("at.regions").alias("region"))
    marked = counts.filter((F.col("n_shared") > 0) & ((F.col("region") == DROPPED) | (100 * F.col("n_shared") >= TEMPLATE_PERCENT * F.col("n"))))
    return marked.groupBy("host").agg(F.collect_list("path").alias("template"))  # as many as the host's pages have kinds of elements


def deletions(rows: DataFrame) -> DataFrame:
    """rows of parsed() with shared (numbers of lines) and template (element paths), null where differencing found none."""
    found = cut(differenced(paired(rows)))
    marks = cut(template(found))
    once = found.filter(F.size("shared") > 0).select("host", "content", "shared")
    # tables that are known to be small spare the pages a shuffle; larger ones are joined by key
    small = lambda df, c: F.broadcast(df) if (df.agg(F.sum(64 + F.octet_length("host") + 8 * F.size(c))).first()[0] or 0) <= MOST_BROADCAST else df
    return rows.join(small(once, "shared"), ["host", "content"], "left").join(small(marks, "template"), "host", "left")


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url and text of each page; n_template and n_structure count the lines that differencing, and after it structure alone, delete."""
    rows = deletions(staged(parsed(pages, key, url, html), "pages", compression="zstd"))
    lines = F.arrays_zip("texts", "regions", "paths")
    number = lambda x, i: F.struct(x["texts"].alias("text"), x["regions"].alias("region"), ((x["regions"] != ARTICLE) & (F.coalesce(F.array_contains("shared", i), F.lit(False)) | F.coalesce(F.array_contains("template", x["paths"]), F.lit(False)))).alias("template"))
    judged = rows.select("key", "url", F.transform(lines, number).alias("lines"))
    text = F.array_join(F.transform(F.filter("lines", lambda x: ~x["template"] & (x["region"] != DROPPED)), lambda x: x["text"]), "\n")
    count = lambda test: F.size(F.filter("lines", test)).cast("long")
    return judged.select(F.col("key").alias(key), "url", text.alias("text"), count(lambda x: x["template"]).alias("n_template"), count(lambda x: ~x["template"] & (x["region"] == DROPPED)).alias("n_structure"))
