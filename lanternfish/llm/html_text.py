"""Main text of web pages by composite text density.

A page is read into nodes once; scripts, styles, forms and elements that name themselves boilerplate (menus,
page headers and footers, sidebars, adverts, notices, reader comments) are left out while reading.  Every other
node gets its composite density: characters per tag, weighted down by the share of its characters and tags that
are links, against the page's own share.  The sum of its children's densities ranks a node.  On every page the node
of the greatest sum sets a threshold, the least density on its path up to the body, and every branch from the body
down that keeps to the threshold gives its best node.  Marks (article, main) are a hint on top of that: a node below
one stands for the outermost marked element around it, and other outermost marked elements are kept too, unless most
of their characters are links.

Blocks are the runs of text between block elements; white space in them becomes one space, references are
decoded, empty ones go, and two line feeds join them.

Defined results: null, empty and tag-free pages: no text for the first two, the whole text for the third; an
unclosed element ends with its parent; rows are handled each by itself, so repeated rows and ties between rows
don't matter; between nodes of equal sums the first wins; extra columns are kept.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternfish import session

_TOKEN = re.compile(r"""<!--(?:.*?-->|.*)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+"?|'[^']*+'?|[^\s"'>]++))?""")
_NO_DISPLAY = re.compile(r"(?<![\w-])display\s*:\s*none", re.I)
_SPACE = re.compile(r"\s+")
_RAW = {n: re.compile(rf"</{n}\s*+[^>]*>", re.I) for n in ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp", "svg", "math", "template", "object")}
_VOID = set("area base basefont br col embed frame hr img input link meta param source track wbr".split())
_BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
_ENDS_P = _BLOCK - {"caption", "html", "body", "tbody", "thead", "tfoot", "tr", "legend", "figcaption", "summary"}
_DROP = set("nav aside form footer button select option dialog menu noscript canvas audio video head label input fieldset".split())
#: Words in class, id or role by which elements call themselves something other than the article.
_BOILERPLATE = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner breadcrumb breadcrumbs comment comments "
    "commentlist disqus respond cookie cookies consent gdpr footer foot menu menubar navbar navigation nav navi sidebar aside rail complementary contentinfo newsletter "
    "subscribe subscription signup notice notices notification notifications alert popup modal overlay dialog related recommended recommendations "
    "share sharing social toolbar pagination pager login search skip copyright disclaimer".split()
)
_HEADER = {"header", "masthead", "banner"}
#: Elements whose names say what they are in the article, such as a heading with an anchor, not that they aren't in it.
_NAMELESS = set("h1 h2 h3 h4 h5 h6 abbr b bdi bdo cite code del dfn em i ins kbd mark q s samp small strong sub sup u var".split())
_SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


class _Page:
    """Nodes in page order, and items: (text) or None for a block's edge."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.begin, self.end = ["#root"], [-1], [0], [0]
        self.chars, self.link_chars = [0], [0]
        self.items: list[str | None] = []
        self._stack, self._links, self._skip, self._marked, self._header, self._title = [0], 0, 0, 0, 0, 0
        self._skipped: list[str] = []
        self._read(source)
        while len(self._stack) > 1:
            self._close()
        self.end[0] = len(self.items)

    def _close(self) -> None:
        node = self._stack.pop()
        tag = self.tag[node].rpartition("!")[2]
        self.end[node] = len(self.items)
        self._links -= tag == "a"
        self._marked -= tag in ("article", "main")
        self._header -= self.tag[node].startswith("!")
        self._title -= tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        if tag in _BLOCK:
            self.items.append(None)

    def _close_to(self, tags: set[str], within: set[str]) -> None:
        for i in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[i]].rpartition("!")[2]
            if tag in tags:
                while len(self._stack) > i:
                    self._close()
                return
            if tag in within:
                return

    def _text(self, text: str) -> None:
        if not text or self._skipped or (self._header and not self._title):
            return
        if "&" in text:
            text = html.unescape(text)
        n = len(text) - text.count(" ")
        node = self._stack[-1]
        self.chars[node] += n
        if self._links:
            self.link_chars[node] += n
        self.items.append(text)

    def _unwanted(self, tag: str, attributes: str) -> bool:
        if tag in _DROP:
            return True
        if tag == "header" and not self._marked:
            return True
        if not attributes or tag in ("html", "body", "article", "main"):
            return False
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or "").strip("\"'")
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _NO_DISPLAY.search(value)):
                return True
            if name in ("class", "id", "role") and tag not in _NAMELESS:
                words = set(re.split(r"[^a-z]+", value.lower()))
                if words & _BOILERPLATE or (not self._marked and words & _HEADER):
                    return True
        return False

    def _open(self, tag: str, attributes: str) -> None:
        if tag in _ENDS_P:
            self._close_to({"p"}, {"button", "table", "td", "th", "div", "article", "section", "body", "li"} - {tag})
        if tag in _SAME:
            self._close_to(*_SAME[tag])
        if tag == "a" and self._links:
            self._close_to({"a"}, {"td", "th", "table", "div", "article"})
        if tag == "br" or tag in ("td", "th"):
            self.items.append(" ")
        if tag in _VOID:
            if tag == "hr":
                self.items.append(None)
            return
        if tag in _BLOCK:
            self.items.append(None)
        head = tag == "header" and self._marked
        node = len(self.tag)
        self.tag.append("!" + tag if head else tag)
        self.parent.append(self._stack[-1])
        self.begin.append(len(self.items))
        self.end.append(0)
        self.chars.append(0)
        self.link_chars.append(0)
        self._stack.append(node)
        self._links += tag == "a"
        self._marked += tag in ("article", "main")
        self._header += head
        self._title += tag in ("h1", "h2", "h3", "h4", "h5", "h6")

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            m = _TOKEN.search(source, at)
            if m is None:
                self._text(source[at:])
                return
            self._text(source[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            tag, closing = name.lower(), m[1] or m[4]
            if self._skipped:  # within something unwanted: only its own end matters
                if closing:
                    if tag in self._skipped:
                        while self._skipped.pop() != tag:
                            pass
                    elif tag in ("body", "html", "article", "main") and tag not in self._skipped:
                        self._skipped.clear()
                        self._ending(tag)
                elif tag in _RAW:
                    at = self._after(tag, source, at)
                elif tag in ("body", "article", "main"):  # an unclosed one before it
                    self._skipped.clear()
                    self._open(tag, m[3] or m[6] or "")
                elif tag not in _VOID and tag not in ("p", "li", "dt", "dd", "tr", "td", "th", "option") or tag == self._skipped[0]:
                    self._skipped.append(tag)
                continue
            if closing:
                self._ending(tag)
            elif tag in _RAW:
                at = self._after(tag, source, at)
            elif self._unwanted(tag, m[3] or m[6] or ""):
                if tag in _BLOCK or tag in ("button", "select"):
                    if tag in _ENDS_P:
                        self._close_to({"p"}, {"td", "th", "div", "article", "section", "body", "li"})
                    self.items.append(None)
                if tag not in _VOID:
                    self._skipped.append(tag)
            else:
                self._open(tag, m[3] or m[6] or "")

    def _after(self, tag: str, source: str, at: int) -> int:
        found = _RAW[tag].search(source, at)
        return found.end() if found else len(source)

    def _ending(self, tag: str) -> None:
        if tag == "br":
            self.items.append(" ")
        for i in range(len(self._stack) - 1, 0, -1):
            if self.tag[self._stack[i]].rpartition("!")[2] == tag:
                while len(self._stack) > i:
                    self._close()
                return

    def blocks(self, node: int) -> list[str]:
        out: list[str] = []
        part: list[str] = []
        for item in [*self.items[self.begin[node] : self.end[node]], None]:
            if item is not None:
                part.append(item)
            elif part:
                if text := _SPACE.sub(" ", "".join(part)).strip():
                    out.append(text)
                part = []
        return out

    def outermost(self) -> list[int]:
        """For each node the outermost marked element that it is or is in, else -1."""
        out: list[int] = []
        for tag, parent in zip(self.tag, self.parent, strict=True):
            above = out[parent] if parent >= 0 else -1
            out.append(above if above >= 0 else len(out) if tag in ("article", "main") else -1)
        return out

    def mostly_links(self, node: int) -> bool:
        chars = links = 0
        for i in range(node, len(self.tag)):
            if self.begin[i] < self.begin[node] or self.end[i] > self.end[node]:
                break
            chars, links = chars + self.chars[i], links + self.link_chars[i]
        return 2 * links > chars

    def densities(self) -> tuple[list[float], list[float]]:
        """Composite density of each node and the sum over its children."""
        n = len(self.tag)
        chars, links = self.chars[:], self.link_chars[:]
        tags, link_tags = [0] * n, [0] * n
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            chars[p] += chars[i]
            links[p] += links[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + (self.tag[i] == "a")
        share = links[0] / max(chars[0], 1)
        density, total = [0.0] * n, [0.0] * n
        for i in range(n):
            c, lc = chars[i], links[i]
            if c:
                weight = math.log(max(c, 1) * max(tags[i], 1) / (max(lc, 1) * max(link_tags[i], 1)) + 1)
                base = math.log(c * lc / max(c - lc, 1) + share * c + math.e) + math.e - 1
                density[i] = c / max(tags[i], 1) * weight / math.log(base)
        for i in range(n - 1, 0, -1):
            total[self.parent[i]] += density[i]
        for i in range(n):
            if not total[i]:
                total[i] = density[i] / 2  # a leaf, below a parent of the same text
        return density, total


def main_blocks(source: str | None) -> list[str]:
    if not source:
        return []
    page = _Page(source)
    density, total = page.densities()
    outer = page.outermost()
    kept = {m for m in set(outer) - {-1} if page.blocks(m) and not page.mostly_links(m)}
    whole = ("#root", "html", "body")
    best = max((i for i, t in enumerate(page.tag) if not kept or t not in whole), key=lambda i: (total[i], -i))
    threshold, node = density[best], best
    while node >= 0 and page.tag[node] not in ("body", "html"):
        threshold, node = min(threshold, density[node]), page.parent[node]
    top = max(node, 0)
    children: dict[int, list[int]] = {}
    for i, p in enumerate(page.parent):
        children.setdefault(p, []).append(i)
    if best == top or not children.get(top):
        return page.blocks(top)
    chosen = set(kept)
    for branch in children[top]:
        if density[branch] >= threshold:
            found, queue = branch, [branch]
            while queue:
                x = queue.pop()
                found = x if total[x] > total[found] else found
                queue += children.get(x, [])
            chosen.add(outer[found] if outer[found] >= 0 else found)
    out: list[str] = []
    stop = -1
    for node in sorted(chosen, key=lambda i: (page.begin[i], -page.end[i])):  # page order; a node within a chosen one is there already
        if page.begin[node] >= stop:
            out += page.blocks(node)
            stop = page.end[node]
    return out


def extract(pages: DataFrame, source: str = "html") -> DataFrame:
    """pages with text and n_chars (its code points) in place of the html.  One narrow pass."""
    session.ship_package(pages.sparkSession)
    kept = [f for f in pages.schema.fields if f.name not in ("text", "n_chars", source)]
    schema = T.StructType(kept + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = ["\n\n".join(main_blocks(x.as_py())) for x in part.column(source)]
                own = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *own], names=names)

    return pages.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{source}`")).mapInArrow(run, schema)
