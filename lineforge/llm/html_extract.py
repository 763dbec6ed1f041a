"""HTML extraction: page structure, and differences against the page of the nearest URL.

A page is read into blocks of text, each marked as part of the article, as
page furniture (by element, role, class or id), or as undecided.  A class or
id names furniture only if all its words do ("share-box", not "notice-board"),
and an element so named is none if it holds the page's only article or most of
its text.  An article element inside an article that has begun holds a
reader's comment.  Markup is read in one pass, in time in proportion to its
length whatever is torn in it: an open comment or tag takes the rest.  Pages are
sorted by host and path and each is paired with the page before it on its
host (the first one with the page after it), leaving out its copies: of pages
with equal lines on a host one is paired for all, and a page whose common lines
hold ``COPY`` of the text of the shorter of the two is passed over for the
nearest other one.  The pair's text lines are aligned by their longest common
subsequence; undecided lines that both pages share are furniture too.  A line
inside a marked article is furniture when its page shares it with the nearest
one and so do most different pages of the host, ``SEVERAL`` at least: a passage
that some pages quote from others is text.  Nor is it when such lines hold half
of the article or more: those pages tell one story in several versions.  A page
that marks an article yields the article's other lines; any other page its undecided lines that the nearest page does not share.

A null html is empty (no text); a null or broken url has the host "" and is
paired among its like; a page alone on its host, or among copies of itself
only, loses no line.  Equal rows count as one page when pairing and yield a
row each.  Ties in host and path
are ordered by page_id and content.  Long pages are read and aligned whole, in
memory in proportion to ``WAITING`` pages at most.  An empty table gives no rows.  Extra columns never reach the worker.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from html import unescape
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_batch, map_rows, no_nulls, small, to_arrow, written

ARTICLE, FURNITURE, UNDECIDED = "article", "furniture", "undecided"
#: At most so many pages' deleted line numbers are broadcast.
BROADCAST_PAGES = 500_000
#: Pages are copies when their common lines hold this share of the characters of the shorter one.
COPY = 0.9
#: An element named like furniture that holds this share of the page's text, or its only article, is none.
WRAP = 0.8
#: A line inside an article is furniture when so many different pages of a host, and this part of them, share it with their nearest ones ...
SEVERAL, MOST = 5, 0.5
#: ... and the article's other lines hold more than this share of its text.
REST = 0.5
#: Pages that are no copies of each other kept at hand, on either side of a partition's end.
NEAR = 4
#: Pages before which a host has copies of them only wait for a different one; more than this are settled in a second step.
WAITING = 500
#: Equal lines of two pages beyond this multiple of their lines are aligned bit by bit.
MANY_EQUAL = 32

# Elements by their role in a page.
HIDDEN = frozenset("script style noscript template svg iframe canvas annotation annotation-xml head title audio video select option datalist textarea".split())
AROUND = frozenset("nav header footer aside form menu dialog button fieldset label input".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong "
                   "sub sup time tt u var wbr br math semantics mi mn mo ms mtext mrow mfrac msqrt mroot mstyle msub msup msubsup "
                   "munder mover munderover mmultiscripts mpadded mphantom mspace menclose".split())
EMPTY = frozenset("area base br col embed hr img input link meta mspace param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion sidebar cookie cookies consent gdpr notice "
                  "banner popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended breadcrumb "
                  "breadcrumbs menu nav navbar navigation navigator comment comments commentlist disqus replies respond footer masthead "
                  "toolbar pagination pager widget widgets outbrain taboola paywall toc".split())
#: Words that say nothing beside such a name, and names of several words.
NEUTRAL = frozenset("box block wrapper wrap container area region inner outer unit slot panel pane bar top bottom left right button buttons "
                    "link links icon icons form section".split())
NEUTRAL_COMMENT = frozenset("list thread body item author meta content".split())
COMMENTS = frozenset("comment comments replies respond disqus".split())
PHRASES = frozenset(("read-more", "table-of-contents", "skip-link", "back-to-top"))
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style")}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that a new block of the same kind closes, and the ends that an unclosed inline element lets through.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}


def furniture(tag: str, attrs: dict[str, str | None], in_article: bool) -> bool:
    """Whether an element's tag, role or style marks it as page furniture; an article's own header is not."""
    if tag in AROUND and tag != "form" and not (in_article and tag == "header"):
        return True
    if "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true" or "display:none" in (attrs.get("style") or "").replace(" ", "").lower():
        return True
    return (attrs.get("role") or "").lower() in ROLES


def names_furniture(name: str) -> bool:
    """Whether all words of a class or id name furniture, or say nothing beside one that does."""
    words = [w for w in re.split(r"[^a-z0-9]+", name) if w and not re.fullmatch(r"\d+(x\d+)?", w)]
    neutral = NEUTRAL | NEUTRAL_COMMENT if not COMMENTS.isdisjoint(words) else NEUTRAL
    return name in PHRASES or not NAMES.isdisjoint(words) and all(w in NAMES or w in neutral for w in words)


def named(tag: str, attrs: dict[str, str]) -> bool:
    """Whether an element is a form or has a class or id that names furniture, which may yet hold the article."""
    if tag == "form":
        return True
    if tag in ("body", "html", "main"):
        return False
    return any(map(names_furniture, f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split()))


SPACE, ATTRIBUTE, EQUALS, BARE = (re.compile(x) for x in (r"[\s/]*", r"=?[^\s/>=]*", r"\s*=\s*", r"[^\s>]*"))
TAG, COMMENT_END = re.compile(r"[A-Za-z][^\s/>]*"), re.compile(r"--!?>")


def attributes(html: str, at: int) -> tuple[int, dict[str, str]]:
    """The place after a tag that is open at ``at``, or -1 if it never ends, and its attributes."""
    found: dict[str, str] = {}
    while True:
        at = SPACE.match(html, at).end()
        if at >= len(html):
            return -1, found
        if html[at] == ">":
            return at + 1, found
        name = ATTRIBUTE.match(html, at)
        at, value = name.end(), ""
        if sign := EQUALS.match(html, at):
            at = sign.end()
            if html[at:at + 1] in ('"', "'") and at < len(html):
                end = html.find(html[at], at + 1)
                if end < 0:
                    return -1, found
                at, value = end + 1, html[at + 1:end]
            else:
                bare = BARE.match(html, at)
                at, value = bare.end(), bare.group()
        found.setdefault(name.group().lower(), unescape(value))


class Blocks:
    """Blocks of a page in order: (text, mark, innermost named element, innermost article)."""

    def __init__(self) -> None:
        self.open: list[tuple[str, tuple[str, int, int]]] = []  # element and its mark: kind, named element, article
        self.tags: Counter = Counter()  # open elements by name
        self.text: list[str] = []
        self.found: list[tuple[str, str, int, int]] = []
        self.wraps: list[tuple[int, bool]] = []  # named elements: the one around it, whether it is a block
        self.articles: list[tuple[int, bool, int]] = []  # articles: the one around it, whether that is main, its text before this
        self.own: list[int] = []  # characters of an article's own text, headings aside
        self.mains: list[bool] = []

    def read(self, html: str) -> None:
        """Tags and text in order; what follows an open comment, tag or script is lost, as in a browser."""
        at = 0
        while at < len(html):
            lt = html.find("<", at)
            if lt < 0:
                return self.data(html[at:])
            if lt > at:
                self.data(html[at:lt])
            closing = html.startswith("</", lt)
            if tag := TAG.match(html, lt + 1 + closing):
                at, given = attributes(html, tag.end())
                if at < 0:
                    return None
                name = tag.group().lower()
                if closing:
                    self.end(name)
                    continue
                self.start(name, given)
                if html[at - 2] == "/":
                    self.end(name)
                elif name in RAW:
                    over = RAW[name].search(html, at)
                    if not over:
                        return None
                    at = over.start()
            elif html.startswith("<!--", lt):
                over = re.match("-?>", html[lt + 4:lt + 6])
                over_at = lt + 4 + over.end() if over else (m.end() if (m := COMMENT_END.search(html, lt + 4)) else -1)
                if over_at < 0:
                    return None
                at = over_at
            elif closing and lt + 2 < len(html) or html[lt + 1:lt + 2] in ("!", "?") and lt + 1 < len(html):
                at = html.find(">", lt + 2) + 1
                if not at:
                    return None
            else:
                self.data("<")
                at = lt + 1
        return None

    def mark(self) -> tuple[str, int, int]:
        return self.open[-1][1] if self.open else (UNDECIDED, -1, -1)

    def pop(self) -> str:
        tag = self.open.pop()[0]
        self.tags[tag] -= 1
        return tag

    def end_block(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            kind, wrap, article = self.mark()
            self.found.append((text, kind, wrap, article))
            if article >= 0 and kind == ARTICLE and not any(self.tags[h] for h in HEADINGS):
                self.own[article] += len(text)

    def start(self, tag: str, given: dict[str, str]) -> None:
        if tag == "br":
            self.text.append(" ")
        elif tag not in INLINE:
            self.end_block()
            names = CLOSES.get(tag, ())
            while names and self.open and (self.open[-1][0] in names or self.open[-1][0] in INLINE and any(self.tags[t] for t in names)):
                self.pop()
        if tag in EMPTY:
            return
        now, wrap, inside = self.mark()
        role = given.get("role", "").lower()
        article = tag in ("article", "main") or role in ("main", "article")
        if now == "hidden" or tag in HIDDEN:
            now = "hidden"
        elif now != FURNITURE:
            if furniture(tag, given, now == ARTICLE):
                if tag in INLINE:
                    self.end_block()
                now = FURNITURE
            else:
                if named(tag, given):
                    if tag in INLINE:
                        self.end_block()
                    self.wraps.append((wrap, tag not in INLINE))
                    wrap = len(self.wraps) - 1
                if article:
                    main = tag == "main" or role == "main"
                    self.articles.append((inside, inside >= 0 and self.mains[inside], self.own[inside] if inside >= 0 and not main else 0))
                    self.own.append(0)
                    self.mains.append(main)
                    now, inside = ARTICLE, len(self.articles) - 1
        self.open.append((tag, (now, wrap, inside)))
        self.tags[tag] += 1

    def end(self, tag: str) -> None:
        if tag == "br":
            self.text.append(" ")
            return
        if not self.tags[tag]:
            if tag not in INLINE:
                self.end_block()
            return
        marked = self.mark()
        if tag not in INLINE:
            self.end_block()
        while self.open:
            if self.open[-1][1] != marked:
                self.end_block()
                marked = self.mark()
            if self.pop() == tag:
                break
        if self.mark() != marked and self.text:
            self.open.append((tag, marked))  # an inline element of another mark ends its own block
            self.tags[tag] += 1
            self.end_block()
            self.pop()

    def data(self, text: str) -> None:
        if self.mark()[0] != "hidden":
            self.text.append(unescape(text))


def blocks(html: str) -> list[tuple[str, str]]:
    """A page's blocks of text with their marks, in page order."""
    reader = Blocks()
    reader.read(html)
    reader.end_block()
    found = [x for x in reader.found if x[1] != "hidden"]
    comments = comment_articles(reader, found)
    found = [(text, FURNITURE if article >= 0 and comments[article] else kind, wrap) for text, kind, wrap, article in found]
    if not reader.wraps:
        return [(text, kind) for text, kind, _ in found]
    lifted = lifted_wraps(reader, found)
    return [(text, kind if wrap < 0 or lifted[wrap] else FURNITURE) for text, kind, wrap in found]


def comment_articles(reader: Blocks, found: list[tuple[str, str, int, int]]) -> list[bool]:
    """Which article elements hold a reader's comment: those in an article that has text before them, or in a main
    element with as much text before them as they have."""
    size = [0] * len(reader.articles)
    for text, kind, _, article in found:
        if article >= 0 and kind == ARTICLE:
            size[article] += len(text)
    for n in range(len(size) - 1, -1, -1):
        if reader.articles[n][0] >= 0:
            size[reader.articles[n][0]] += size[n]
    out: list[bool] = []
    for n, (around, in_main, before) in enumerate(reader.articles):
        out.append(around >= 0 and (out[around] or before > 0 and (not in_main or before >= size[n])))
    return out


def lifted_wraps(reader: Blocks, found: list[tuple[str, str, int]]) -> list[bool]:
    """Which named elements are no furniture, and lie in none: blocks with most of the page's text or its only article."""
    wraps = reader.wraps
    size, depth, holds = [0] * len(wraps), [0] * len(wraps), [False] * len(wraps)
    for n, (around, block) in enumerate(wraps):
        depth[n] = block + (depth[around] if around >= 0 else 0)
    for text, kind, wrap in found:
        if kind != FURNITURE and wrap >= 0:
            size[wrap] += len(text)
    # the article is the one with the fewest named elements around it
    inside = [wrap for _, kind, wrap in found if kind == ARTICLE]
    least = min((depth[w] if w >= 0 else 0 for w in inside), default=0)
    for w in inside:
        if w >= 0 and depth[w] == least:
            holds[w] = True
    most = WRAP * sum(len(text) for text, kind, _ in found if kind != FURNITURE)
    for n in range(len(wraps) - 1, -1, -1):
        if wraps[n][0] >= 0:
            size[wraps[n][0]] += size[n]
            holds[wraps[n][0]] |= holds[n]
    out: list[bool] = []
    for n, (around, block) in enumerate(wraps):
        out.append(block and (size[n] >= most > 0 or holds[n]) and (around < 0 or out[around]))
    return out


def place(url: str | None) -> tuple[str, str]:
    """Host and sortable path of a url: no query or fragment, numbers padded."""
    try:
        parts = urlsplit(no_nulls(url))
        host = (parts.hostname or "").lower()
    except ValueError:
        return "", ""
    path = re.sub(r"\.html?$", "", parts.path.rstrip("/"))
    return host, re.sub(r"\d+", lambda m: m.group().zfill(12), path)


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence of ``a`` and ``b``."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    at = defaultdict(list)
    for j in range(len(b) - end - 1, start - 1, -1):
        at[b[j]].append(j)
    if sum(len(at.get(x, ())) for x in a[start:len(a) - end]) > MANY_EQUAL * (len(a) + len(b)):
        middle = dense_common(a[start:len(a) - end], b[start:len(b) - end])
        return [*range(start), *(start + i for i in middle), *range(len(a) - end, len(a))]
    # the least ends in b of common subsequences by length, with the chains that reach them
    ends: list[int] = []
    chains: list[tuple | None] = []
    for i in range(start, len(a) - end):
        for j in at.get(a[i], ()):
            k = bisect_left(ends, j)
            chain = (i, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(chain)
            elif j < ends[k]:
                ends[k], chains[k] = j, chain
    middle, chain = [], chains[-1] if chains else None
    while chain:
        middle.append(chain[0])
        chain = chain[1]
    return [*range(start), *reversed(middle), *range(len(a) - end, len(a))]


def dense_common(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence, by bits: a row of the table is one number with a bit per line of
    ``b``, 0 where the length grows.  Of the rows every ``step``-th is kept and the others are made again on the way back."""
    equal: dict[int, int] = defaultdict(int)
    for j, x in enumerate(b):
        equal[x] |= 1 << j
    full = (1 << len(b)) - 1
    step = max(1, int(len(a) ** 0.5))

    def after(row: int, x: int) -> int:
        u = row & equal.get(x, 0)
        return (row + u | row - u) & full

    kept, row = [full], full
    for i, x in enumerate(a, 1):
        row = after(row, x)
        if i % step == 0:
            kept.append(row)
    out, j, block, first = [], len(b), [], len(a) + 1
    i = len(a)
    while i and j:
        if i <= first:  # rows first .. i of the block that row i - 1 lies in
            first = (i - 1) // step * step
            block = [kept[first // step]]
            for x in a[first:min(first + step, len(a))]:
                block.append(after(block[-1], x))
        grows = lambda n: not block[n - first] >> (j - 1) & 1
        if not grows(i):
            j -= 1
        elif grows(i - 1):
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append(i)
    return out[::-1]


def row_key(pages: DataFrame) -> Column:
    return F.xxhash64("page_id", "url", "html")


def outlines(pages: DataFrame) -> DataFrame:
    """key, page_id, host, path, hashes and lengths of all lines, whether no article is marked, and twin, equal for equal outlines of a host."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def rows(key, page_id, url, html):
        found = blocks(no_nulls(html))
        yield (key, page_id, *place(url), [xxhash.xxh64_intdigest(t) - (1 << 63) for t, _ in found], [len(t) for t, _ in found],
               all(m != ARTICLE for _, m in found))

    return map_rows(pages.select(row_key(pages).alias("key"), "page_id", "url", "html"), ["key", "page_id", "url", "html"],
                    f"key long, page_id {kind}, host string, path string, lines array<long>, sizes array<int>, unmarked boolean",
                    rows).dropDuplicates(["key", "page_id"]).withColumn("twin", F.xxhash64("host", "lines", "unmarked"))


def pair(a: tuple[list[int], list[int]], b: tuple[list[int], list[int]]) -> list[int] | None:
    """Places in ``a`` (line hashes, lengths) of the lines common with ``b``; null when one is a copy of the other."""
    common = common_lines(a[0], b[0])
    least = min(sum(a[1]), sum(b[1]))
    return None if least and sum(a[1][i] for i in common) >= COPY * least else common


def first_pair(a: tuple[list[int], list[int]], others: Iterable[tuple[list[int], list[int]]]) -> list[int] | None:
    """The lines common with the first of ``others`` that is no copy; null without one."""
    return next((x for b in others if (x := pair(a, b)) is not None), None)


def shared_lines(pages: DataFrame) -> DataFrame:
    """key and shared (line numbers, from 0) of the pages that share lines with the page of the nearest url; of a page
    with a marked article only the lines that most pages of its host share so.

    Of pages with equal outlines on a host the first is paired for all.  These
    are range-partitioned by host, path and page_id, so a host of any size
    spreads over many tasks.  Pages that find no other page before them on a
    host that reaches over the partition's end are paired in a second step with
    the ``NEAR`` first and last different pages of the host's partitions.
    """
    order = ["host", "path", "page_id", "key"]
    schema = T._parse_datatype_string("twin long, shared array<int>, part int, at int, host string, lines array<long>, sizes array<int>, "
                                       "unmarked boolean, common array<long>")
    arrow = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: list[tuple] = []
        state = {"host": None, "first": True, "early": False}
        heads: list = []  # the host's first pages that are no copies of each other
        recent: list = []  # the last ones, nearest first
        waiting: list = []  # (twin, page, unmarked) before which the host has no other page

        def end(last: bool) -> None:
            """What waits is settled, or left for the second step when the host reaches over a partition's end."""
            open_ = state["first"] or last or state["early"]
            for twin, page, unmarked in waiting:
                # in one partition the second step is not needed: other pages only follow
                shared = None if open_ else first_pair(page, heads) or []
                out.append((twin, shared, part, 0, state["host"], *(page if open_ else (None, None)), unmarked, [page[0][i] for i in shared or ()]))
            if open_:
                # negative places: the first pages, positive ones: the last pages, in page order
                out.extend((None, None, part, n - NEAR, state["host"], *page, None, None) for n, page in enumerate(heads))
                out.extend((None, None, part, n + 1, state["host"], *page, None, None) for n, page in enumerate(reversed(recent)))
            heads.clear(), recent.clear(), waiting.clear()
            state["early"] = False

        for batch in batches:
            for twin, host, lines, sizes, unmarked in zip(*(c.to_pylist() for c in batch.columns)):
                if host != state["host"]:
                    if state["host"] is not None:
                        end(False)
                        state["first"] = False
                    state["host"] = host
                page = (lines, sizes)
                found = first_pair(page, recent)
                if found is None:
                    waiting.append((twin, page, unmarked))
                    if len(waiting) >= WAITING:  # the second step pairs them with the host's first pages
                        state["early"] = True
                        out.extend((twin_, None, part, 0, host, *page_, unmarked_, None) for twin_, page_, unmarked_ in waiting)
                        waiting.clear()
                else:
                    out.append((twin, found, part, 0, host, None, None, unmarked, [lines[i] for i in found]))
                recent[:] = [page, *(b for b in recent if pair(page, b) is not None)][:NEAR]
                if len(heads) < NEAR and all(pair(page, b) is not None for b in heads):
                    heads.append(page)
                if len(out) >= 2048:
                    yield as_batch(out, arrow)
                    out.clear()
        if state["host"] is not None:
            end(True)
        if out:
            yield as_batch(out, arrow)

    every = written(outlines(pages), "outlines")
    names = ["path", "page_id", "key", "lines", "sizes", "unmarked"]
    one = every.groupBy("host", "twin").agg(F.min(F.struct(*names)).alias("least")).select("host", "twin", "least.*")
    ordered = one.repartitionByRange(*order).sortWithinPartitions(*order)
    settled = written(ordered.select("twin", "host", "lines", "sizes", "unmarked").mapInArrow(run, schema), "pairs")
    edges = (settled.where("twin IS NULL").groupBy("host")  # at most 2 * NEAR rows of a host and partition
             .agg(F.sort_array(F.collect_list(F.struct("part", "at", "lines", "sizes"))).alias("edges")))
    open_ = settled.where("twin IS NOT NULL AND lines IS NOT NULL").join(edges, "host")

    def late(twin, part, lines, sizes, edges, host, unmarked):
        before = [(e["lines"], e["sizes"]) for e in reversed(edges) if e["part"] < part]
        after = [(e["lines"], e["sizes"]) for e in edges if e["part"] > part or e["part"] == part and e["at"] < 0]
        shared = first_pair((lines, sizes), [*before, *after]) or []
        yield twin, shared, host, unmarked, [lines[i] for i in shared]

    done = settled.where("shared IS NOT NULL").select("twin", "shared", "host", "unmarked", "common").union(
        map_rows(open_, ["twin", "part", "lines", "sizes", "edges", "host", "unmarked"],
                 "twin long, shared array<int>, host string, unmarked boolean, common array<long>", late)).where("size(shared) > 0")
    # inside an article the nearest page only proposes: most pages of the host must share the line so
    each = done.select("twin", "host", "unmarked", F.explode(F.arrays_zip("shared", "common")).alias("at")).select("twin", "host", "unmarked", "at.*")
    hosts = every.select("host", "twin").distinct().groupBy("host").agg(F.greatest(F.lit(SEVERAL), F.count("*") * MOST).alias("least"))
    often = each.select("host", "common", "twin").distinct().groupBy("host", "common").count().join(hosts, "host").where("count >= least")
    inside = (each.where("NOT unmarked").join(often, ["host", "common"], "left_semi")
              .groupBy("twin").agg(F.array_sort(F.collect_list("shared")).alias("shared")))
    return every.select("key", "twin").join(done.where("unmarked").select("twin", "shared").union(inside), "twin").select("key", "shared")


def main_lines(html: str, shared: list[int] | None) -> list[str]:
    """The article's lines outside ``shared``, if they hold most of it; where none is marked the undecided lines outside it."""
    found = blocks(html)
    gone = set(shared or ())
    article = [text for text, mark in found if mark == ARTICLE]
    if article:
        rest = [text for n, (text, mark) in enumerate(found) if mark == ARTICLE and n not in gone]
        return rest if sum(map(len, rest)) > REST * sum(map(len, article)) else article
    return [text for n, (text, mark) in enumerate(found) if mark == UNDECIDED and n not in gone]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every row."""
    kind = pages.schema["page_id"].dataType.simpleString()
    keyed = pages.select("page_id", "url", "html", row_key(pages).alias("key"))
    gone = written(shared_lines(pages).dropDuplicates(["key"]), "shared")
    paired = keyed.join(small(gone, BROADCAST_PAGES), "key", "left")
    return map_rows(paired, ["page_id", "url", "html", "shared"], f"page_id {kind}, url string, text string",
                    lambda page_id, url, html, shared: iter([(page_id, url, "\n".join(main_lines(no_nulls(html), shared)))]))
