"""Main text of web pages with site templates removed.

Pages are parsed to a flat list of events. Every element subtree of a page that is not prose of
a marked article is hashed, whatever it is called; Spark counts in how many pages (with different
main texts) of a host each hash occurs, and subtrees that recur across many are deleted.
What does not recur, as a host has few pages or each page has its own menu or advert, goes by
tags, roles and names that declare it to be no article text.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, map_batches, stage

MIN_PAGES = 5  # a template recurs in at least so many pages of different text,
MIN_SHARE = 0.01  # and in at least this part of its host's different main texts,
ENOUGH_PAGES = 50  # but no more than so many are asked for, however large the host

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes iframe".split())
NEVER_TEXT = frozenset(
    "head script style title textarea xmp noframes iframe noscript template svg canvas object audio video math map "
    "nav aside footer form button select option datalist dialog menu input label fieldset".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body center caption dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd dt li figcaption".split())
INLINE_HEAD = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in class, id and role that name page furniture.
FURNITURE = frozenset(
    "nav navbar navigation navigations menu menus breadcrumb breadcrumbs header masthead footer sidebar sidebars aside ad ads advert adverts "
    "advertisement advertisements adsbygoogle sponsor sponsored sponsors promo promotion promotions banner banners cookie cookies consent gdpr "
    "notice notices alert alerts popup popups modal overlay newsletter subscribe subscription signup share sharing social "
    "related recommended recommendations comment comments commentlist respond disqus reply replies form forms login search "
    "toolbar pagination pager widget widgets contentinfo complementary skip".split()
)
MAIN_NAMES = frozenset("content post entry article story maincontent postcontent entrycontent articlebody".split())

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_STOP = re.compile(r"""[>=]""")
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
# Words that only place or wrap the furniture a class names.
PLACES = frozenset(
    "site page main global primary secondary top bottom left right inner outer wrapper wrap container holder box block area section bar "
    "list item items panel slot unit row col column strip group module region text message links link posts articles stories".split()
)
# A start tag that ends open elements of these names, up to one of the limits.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
         "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
         "option": ({"option"}, {"select"})}


@lru_cache(100_000)
def _meanings(text: str) -> frozenset[str]:
    """What the words in class, id and role say: each whole word, and the one part of it that more than places it.

    ``site-footer`` means footer, ``entry-header`` and ``story-share-wrap`` mean neither header nor share.
    """
    out = set()
    for word in text.split():
        out.add(word.lower().replace("-", "").replace("_", ""))
        parts = {p.lower() for p in _PARTS.findall(word)}
        said = parts - PLACES
        if len(said) <= 1 or said <= FURNITURE:
            out |= said or parts
        elif len(parts) > 1 and parts <= MAIN_NAMES | PLACES:
            out |= parts
    return frozenset(out)


_MOD = (1 << 61) - 1
_BASE = 1_000_003


def _tag_end(html: str, at: int, last: dict[str, int]) -> int:
    """Place after the ``>`` that ends a tag whose attributes begin at ``at``; quoted values may hold one.

    A quote that nothing closes counts as none. ``last`` has the last place of each quote. Without an end the
    rest of the page belongs to the tag.
    """
    while True:
        m = _STOP.search(html, at)
        if not m:
            return len(html)
        if m[0] == ">":
            return m.end()
        at = m.end()
        while at < len(html) and html[at].isspace():
            at += 1
        quote = html[at : at + 1]
        if quote in last and at < last[quote]:
            at = html.index(quote, at + 1) + 1


def tokens(html: str):
    """(text, tag, attributes, whether it ends an element, place after it) in one pass; markup that is no tag has tag ``""``."""
    last = {q: html.rfind(q) for q in "\"'"}
    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        while lt >= 0 and not (lt + 1 < n and (html[lt + 1] in "!?" or html[lt + 1].isascii() and (html[lt + 1].isalpha() or html[lt + 1] == "/"))):
            lt = html.find("<", lt + 1)
        if lt < 0:
            yield html[at:], "", "", False, n
            return
        text, ends = html[at:lt], html[lt + 1] == "/"
        name = _NAME.match(html, lt + 1 + ends)
        if html.startswith("<!--", lt):
            stops = [p + len(e) for e in ("-->", "--!>") if (p := html.find(e, lt + 2)) >= 0]
            at, tag, attrs = min(stops, default=n), "", ""
        elif not name:
            at = (html.find(">", lt) + 1) or n
            tag, attrs = "", ""
        else:
            at = _tag_end(html, name.end(), last)
            tag, attrs = name[0].lower(), html[name.end() : at].rstrip(">")
        got = yield text, tag, attrs, ends, at
        if got is not None:  # the reader went on by itself
            at = got
            yield None


class Page:
    """Events of one page. ``nodes``: [tag, names, parent, first event, end event, hidden]."""

    def __init__(self, html: str):
        self.events: list[tuple[int, str | None]] = []  # (node, text), or (node, None) at its start and (~node, None) at its end
        self.nodes: list[list] = []
        self._parse(html)

    def _open(self, tag: str, attrs: str, stack: list[int]) -> int:
        names, hidden = frozenset(), False
        if attrs and not attrs.isspace():
            found = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)}
            text = " ".join(found.get(k, "") for k in ("class", "id", "role"))
            names = _meanings(text)
            hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
        node = len(self.nodes)
        self.nodes.append([tag, names, stack[-1] if stack else -1, len(self.events), -1, hidden])
        self.events.append((node, None))
        return node

    def _close(self, node: int) -> None:
        self.nodes[node][4] = len(self.events)
        self.events.append((~node, None))

    def _parse(self, html: str) -> None:
        stack: list[int] = []
        opened: dict[str, int] = {}  # how many open elements of each name

        def pop() -> None:
            node = stack.pop()
            opened[self.nodes[node][0]] -= 1
            self._close(node)

        def text(piece: str) -> None:
            if piece:
                self.events.append((stack[-1] if stack else -1, unescape(piece) if "&" in piece else piece))

        reader = tokens(html)
        for before, tag, attrs, ends_one, at in reader:
            text(before)
            if not tag:
                continue
            if ends_one:
                if opened.get(tag):
                    while self.nodes[stack[-1]][0] != tag:
                        pop()
                    pop()
                continue
            if tag in BLOCKS and opened.get("p") and self.nodes[stack[-1]][0] == "p":
                pop()
            ends, limits = _ENDS.get(tag, ((), ()))
            if any(opened.get(e) for e in ends):
                for k in range(len(stack) - 1, -1, -1):
                    name = self.nodes[stack[k]][0]
                    if name in limits:
                        break
                    if name in ends:
                        while len(stack) > k:
                            pop()
                        if tag != "tr":
                            break
            node = self._open(tag, attrs, stack)
            if tag in VOID:
                self._close(node)
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                reader.send(end.end() if end else len(html))
                self._close(node)
                continue
            stack.append(node)
            opened[tag] = opened.get(tag, 0) + 1
        while stack:
            pop()

    def _inside(self, node: int) -> range:
        return range(self.nodes[node][3], self.nodes[node][4])

    def _within(self, node: int, outer: int) -> bool:
        return self.nodes[outer][3] < self.nodes[node][3] < self.nodes[outer][4]

    def _sizes(self) -> list[int]:
        """Characters of text before each event, without furniture by tag."""
        out, total, skip = [0], 0, -1
        for k, (node, text) in enumerate(self.events):
            if k >= skip and text is None and node >= 0 and self.nodes[node][0] in NEVER_TEXT:
                skip = self.nodes[node][4]
            if k >= skip and text is not None:
                total += len(text)
            out.append(total)
        return out

    def main(self) -> int | None:
        """The article's element: the largest marked one; None if nothing marks it."""
        sizes = self._sizes()
        length = lambda i: sizes[self.nodes[i][4]] - sizes[self.nodes[i][3]]
        for fits in (
            lambda x: x[0] == "article" and not x[1] & FURNITURE,
            lambda x: x[0] == "main" or "main" in x[1] and x[0] in ("div", "section"),
            lambda x: x[0] in ("div", "section", "td") and x[1] & MAIN_NAMES and not x[1] & FURNITURE,
        ):
            found = [i for i, x in enumerate(self.nodes) if fits(x) and length(i)]
            if found:
                return max(found, key=lambda i: (length(i), -i))
        return None

    def around(self, main: int | None) -> set[int]:
        """The main element and all it lies in."""
        out = set()
        while main is not None and main >= 0:
            out.add(main)
            main = self.nodes[main][2]
        return out

    def furniture(self, main: int | None) -> set[int]:
        """Elements that their own tag or names declare to be no article text; never one that holds most of the text."""
        around, sizes = self.around(main), self._sizes()
        lo, hi = (self.nodes[main][3], self.nodes[main][4]) if main is not None else (0, len(self.events))
        whole = sizes[hi] - sizes[lo]
        out = set()
        for i, (tag, names, _, first, end, hidden) in enumerate(self.nodes):
            if i in around or tag in ("html", "body"):
                continue
            if tag in NEVER_TEXT or hidden or tag == "header" and (main is None or not self._within(i, main)):
                out.add(i)
            elif names & FURNITURE and tag not in INLINE_HEAD and not (lo <= first < hi and 2 * (sizes[end] - sizes[first]) > whole):
                out.add(i)
        return out

    def candidates(self, main: int | None) -> list[tuple[int, int]]:
        """(element, hash) of subtrees a site template could be made of: all that hold text, but prose of the main element."""
        prefix, power, h, texts = [0], [1], 0, [0]
        for node, text in self.events:
            if text is not None:
                key = "t" + " ".join(text.split())
            elif node >= 0:
                key = "s" + self.nodes[node][0] + " " + " ".join(sorted(self.nodes[node][1]))
            else:
                key = "e"
            h = (h * _BASE + xxhash.xxh64_intdigest(key) + 1) % _MOD
            prefix.append(h)
            power.append(power[-1] * _BASE % _MOD)
            texts.append(texts[-1] + (text is not None and not text.isspace()))
        around, out = self.around(main), []
        for i, (tag, _, _, lo, hi, _) in enumerate(self.nodes):
            if i in around or tag in ("html", "body", "article", "main", "head") or texts[hi] == texts[lo]:
                continue
            if tag not in BLOCKS and tag not in NEVER_TEXT or tag in PROSE and main is not None and self._within(i, main):
                continue
            out.append((i, (prefix[hi] - prefix[lo] * power[hi - lo]) % _MOD))
        return out

    def shares(self, templates: set[int], named: set[int]) -> tuple[int, int]:
        """Characters of text that templates take, and that names take besides."""
        taken, until = [0, 0], [-1, -1]
        for k, (node, text) in enumerate(self.events):
            if text is None:
                for j, some in enumerate((templates, named)):
                    if node >= 0 and node in some:
                        until[j] = max(until[j], self.nodes[node][4])
            elif k < until[0]:
                taken[0] += len(text.strip())
            elif k < until[1]:
                taken[1] += len(text.strip())
        return taken[0], taken[1]

    def text(self, main: int | None, gone: set[int]) -> str:
        """Blocks of the kept part, blanks folded, joined by line breaks."""
        blocks: list[str] = []
        current: list[str] = []
        skip, head, header_end = -1, 0, -1

        def flush() -> None:
            line = " ".join("".join(current).split())
            if line:
                blocks.append(line)
            current.clear()

        for k in self._inside(main) if main is not None else range(len(self.events)):
            if k < skip:
                continue
            node, text = self.events[k]
            if text is not None:
                if k > header_end or head:
                    current.append(text)
                continue
            tag = self.nodes[node if node >= 0 else ~node][0]
            if node >= 0 and node in gone:
                skip = self.nodes[node][4]
                flush() if tag in BLOCKS else current.append(" ")
                continue
            if tag == "header" and node >= 0:  # of the article: only its headings
                header_end = max(header_end, self.nodes[node][4])
            if tag in INLINE_HEAD:
                head += 1 if node >= 0 else -1
            if tag in BLOCKS:
                flush()
            elif tag == "br":
                current.append(" ")
        flush()
        return "\n".join(blocks)


_HOST = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")


def host(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _read(html: str | None) -> tuple[Page, int | None, set[int]]:
    page = Page(html or "")
    main = page.main()
    return page, main, page.furniture(main)


def extract_main_text(pages: DataFrame, *, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, enough: int = ENOUGH_PAGES) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars``, ``n_template``, ``n_named`` for every row of ``pages`` (page_id, url, html).

    ``n_template`` counts the characters that went as recurring subtrees, ``n_named`` those that went only by tag or name.

    Null html is an empty page, null url the host "". Null or repeated page_ids are fine: a page is
    known by the digest of its url and html, so repeated rows get equal texts; they count once
    as evidence for a template, as do pages of equal main text. Whole pages are read; other
    columns are ignored; an empty table gives an empty result. ``text`` is never null.
    Counting combines before the shuffle, so a host with a third of all pages is no hot task.
    """

    def hashes(batch):
        urls, htmls = column(batch, "url").to_pylist(), column(batch, "html").to_pylist()
        hosts, texts, found = [], [], []
        for url, html in zip(urls, htmls):
            page, main, gone = _read(html)
            subtrees = sorted({h for _, h in page.candidates(main)})
            hosts.append(host(url))
            texts.append(xxhash.xxh64_intdigest(page.text(main, gone)) >> 1)
            found.append(subtrees)
        yield pa.RecordBatch.from_arrays(
            [column(batch, "page"), pa.array(hosts), pa.array(texts, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
            names=["page", "host", "body", "hashes"],
        )

    key = F.xxhash64(F.coalesce("url", F.lit("")), F.coalesce("html", F.lit("")))
    source = pages.select("page_id", "url", "html", key.alias("page"))
    seen = stage(map_batches(source, hashes, "page long, host string, body long, hashes array<long>"), "subtrees")
    size = seen.select("host", "body").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("bodies"))
    each = seen.select("page", "host", "body", F.explode("hashes").alias("hash"))
    counted = each.select("host", "hash", "body").distinct().groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))
    recurring = counted.where(F.col("n") >= min_pages).join(size, "host").where(F.col("n") >= F.least(F.col("bodies") * min_share, F.lit(enough)))
    hits = each.select("page", "host", "hash").distinct().join(recurring.select("host", "hash"), ["host", "hash"])
    removed = stage(hits.groupBy("page").agg(F.sort_array(F.collect_set("hash")).alias("removed")), "templates")

    def texts(batch):
        out, shares = [], []
        for html, gone_hashes in zip(column(batch, "html").to_pylist(), column(batch, "removed").to_pylist()):
            page, main, named = _read(html)
            wanted = set(gone_hashes or ())
            templates = {node for node, h in page.candidates(main) if h in wanted} if wanted else set()
            out.append(page.text(main, templates | named))
            shares.append(page.shares(templates, named))
        counts = [pa.array(x, pa.int64()) for x in ([len(t) for t in out], *([x[i] for x in shares] for i in (0, 1)))]
        yield pa.RecordBatch.from_arrays(
            [column(batch, "page_id"), column(batch, "url"), pa.array(out, pa.string()), *counts],
            names=["page_id", "url", "text", "n_chars", "n_template", "n_named"],
        )

    # Most pages have hits, so this table grows with the pages; always a merge join, which moves each page once at any size.
    joined = source.join(removed.hint("merge"), "page", "left")
    kind = dict(pages.dtypes)["page_id"]
    return map_batches(joined.select("page_id", "url", "html", "removed"), texts, f"page_id {kind}, url string, text string, n_chars long, n_template long, n_named long")
