"""Main text of web pages by tree scoring.

Every paragraph gives points for its length and its commas to its ancestors, less to the farther ones; a
container's sum is discounted by the share of its text that is in links. The best container is kept with
its siblings, but for those that are mostly links or stand before what precedes it; menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments are taken out beforehand by element, role
and name. Where articles are marked as such, the best is looked for in them, and all of them are kept.

A name (a class or an id) says so only as a whole: each of its words is one of ``NAMES`` or tells of layout
(``PLAIN``), such as ``comments``, ``ad-box``, ``usercomments`` or ``left-sidebar``, but not ``share-price-table``. Beside an
article that is marked as one, any word of ``NAMES`` is enough. Parsing and scoring take time in proportion to the page,
however deep or broken it is.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">]++)*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

_set = lambda text: frozenset(text.split())
VOID = _set("area base br col embed hr img input link meta param source track wbr")
RAW = _set("script style title textarea xmp iframe noembed noframes")
BLOCK = _set("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul")
CLOSES_P = BLOCK - _set("br body html head caption tbody td tfoot th thead tr legend option summary")
#: An element's start closes an open one of these, up to the nearest element of the second set.
IMPLIED = {"li": (_set("li"), _set("ul ol menu")), "dt": (_set("dt dd"), _set("dl")), "dd": (_set("dt dd"), _set("dl")), "tr": (_set("tr td th"), _set("table")), "td": (_set("td th"), _set("tr table")), "th": (_set("td th"), _set("tr table")), "option": (_set("option"), _set("select"))}
_P, _P_BOUNDS = _set("p"), _set("td th table button")
DROPPED = _set("nav aside footer form button select dialog menu template noscript head")
ROLES = _set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar status")
#: Words in the name (class or id) of what is not the article.
NAMES = _set(
    "ad ads advert adverts advertisement advertisements advertising adsense alert aside banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies copyright discussion disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pager "
    "pagination paywall popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup social sponsor "
    "sponsored subscribe subscription toast toolbar widget"
)
#: Words that add nothing to such a name.
PLAIN = _set(
    "a all area article bar block blocks body bottom box boxes btn button buttons center col column container content cta entry fixed float foot form "
    "global group head holder inline inner items js left link links list main module network networks outer page panel placeholder post posts "
    "primary reader readers region right row secondary section site slot small span sticky the thread top unit user users wrap wrapper zone"
)
_WHOLE = NAMES | PLAIN | {"header"}
PARAGRAPH = _set("p pre td blockquote li dd div section article main body")
HEADING = _set("h1 h2 h3 h4 h5 h6")


_RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if text.strip(" /") else {}


@lru_cache(100_000)
def _parts(word: str) -> frozenset[str]:
    """The words that a word is glued from, if all of them are known, else the word itself."""
    if word in _WHOLE or len(word) > 40:
        return frozenset([word])
    for k in range(len(word) - 2, 1, -1):
        if word[:k] in _WHOLE and (rest := _parts(word[k:])) <= _WHOLE:
            return rest | {word[:k]}
    return frozenset([word])


def _name_words(attributes: dict[str, str]) -> list[frozenset[str]]:
    """The words of each class name and of the id, in lower case, without numbers."""
    return [frozenset().union(*(_parts(w.lower()) for w in _NAME.findall(name) if not w.isdigit())) for c in ("class", "id") for name in attributes.get(c, "").split()]


class _Page:
    """Nodes in page order (a parent before its children) and the text that each holds."""

    def __init__(self) -> None:
        self.tag, self.parent, self.out, self.inside = ["#"], [0], [False], [False]
        self.maybe: list[int] = []  # nodes whose name has a word of NAMES among others
        self.texts: list[tuple[int, str]] = []

    def open(self, tag: str, attributes: str, parent: int) -> int:
        inside = self.inside[parent] or tag in ("article", "main")
        found = _attributes(attributes)
        out = tag in DROPPED or tag == "header" and not inside or found.get("role", "").lower() in ROLES
        if not out and tag not in ("html", "body", "main") and found:
            for words in _name_words(found):
                named = words & NAMES or not inside and "header" in words
                if named and words <= _WHOLE:
                    out = True
                elif named and not inside:
                    self.maybe.append(len(self.tag))
        self.tag.append(tag)
        self.parent.append(parent)
        self.out.append(out)
        self.inside.append(inside)
        return len(self.tag) - 1

    def settle(self) -> None:
        """Take out what only its name in part speaks against, if there is an article beside it, and all that is inside of what is out."""
        holders = set()
        for i, (tag, out) in enumerate(zip(self.tag, self.out)):
            if tag in ("article", "main") and not out:
                while i and i not in holders:
                    holders.add(i)
                    i = self.parent[i]
        for i in self.maybe if holders else ():
            self.out[i] = self.out[i] or i not in holders
        for i in range(1, len(self.tag)):
            self.out[i] = self.out[i] or self.out[self.parent[i]]


def parse(html: str) -> _Page:
    """A forgiving tree of ``html``: end tags may be left out, be too many, or the page may break off anywhere."""
    page, path, at = _Page(), [0], 0
    depths: dict[str, list[int]] = defaultdict(list)  # of each tag's open elements in the path, outermost first

    def deepest(tags: frozenset[str]) -> int:
        return max(depths[t][-1] if depths[t] else 0 for t in tags)

    def close_to(depth: int) -> None:
        for node in path[depth:]:
            depths[page.tag[node]].pop()
            if page.tag[node] in BLOCK:
                page.texts.append((page.parent[node], " "))
        del path[depth:]

    def close_implied(tags: frozenset[str], bounds: frozenset[str]) -> None:
        lowest = deepest(tags)
        if lowest > deepest(bounds):
            while page.tag[path[lowest - 1]] in tags:
                lowest -= 1
            close_to(lowest)

    while found := _TOKEN.search(html, at):
        if found.start() > at:
            page.texts.append((path[-1], unescape(html[at : found.start()])))
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        if found[1] or found[4]:
            if depths[tag]:
                close_to(depths[tag][-1])
            continue
        if tag in CLOSES_P:
            close_implied(_P, _P_BOUNDS)
        if tag in IMPLIED:
            close_implied(*IMPLIED[tag])
        if tag in BLOCK:
            page.texts.append((path[-1], " "))
        attributes = found[3] or found[6] or ""
        if tag in RAW:
            end = _RAW_END[tag].search(html, at)
            at = end.start() if end else len(html)
        elif tag not in VOID:
            node = page.open(tag, attributes, path[-1])
            if not attributes.endswith("/") or tag not in ("svg", "path", "g"):
                depths[tag].append(len(path))
                path.append(node)
    if at < len(html):
        page.texts.append((path[-1], unescape(html[at:])))
    page.settle()
    return page


def main_text(html: str | None) -> str:
    """The text of the best container and its siblings: one space for white space and between blocks; empty if there is none."""
    page = parse((html or "").replace("\x00", ""))
    n, tag, parent, out = len(page.tag), page.tag, page.parent, page.out
    own, link, commas, own_link = [0] * n, [0] * n, [0] * n, [False] * n
    links = [0] * n
    for i in range(1, n):
        own_link[i] = own_link[parent[i]] or tag[i] == "a"
        links[i] = tag[i] == "a"
    for node, text in page.texts:
        if not out[node] and (size := len(text.strip())):
            own[node] += size
            commas[node] += sum(map(text.count, ",，、،"))
            link[node] += size * own_link[node]
    # What stands in inline elements belongs to the paragraph around them.
    paragraph_size, paragraph_commas = own[:], commas[:]
    size = own[:]
    for i in range(n - 1, 0, -1):
        if tag[i] not in BLOCK:
            paragraph_size[parent[i]] += paragraph_size[i]
            paragraph_commas[parent[i]] += paragraph_commas[i]
        size[parent[i]] += size[i]
        link[parent[i]] += link[i]
        links[parent[i]] += links[i]
    for i in range(1, n):  # outside the article a list or box of links only is a menu, whatever its name
        out[i] = out[i] or out[parent[i]] or not page.inside[i] and tag[i] in ("ul", "ol", "div", "section", "table", "dl") and links[i] >= 3 and link[i] >= 0.9 * size[i] > 0
    holds = [False] * n  # a marked article is inside
    for i in range(n - 1, 0, -1):
        holds[parent[i]] = holds[parent[i]] or holds[i] or page.inside[i]
    density = lambda i: link[i] / size[i] if size[i] else 0.0
    points = [0.0] * n
    for i in range(1, n):
        if tag[i] in PARAGRAPH and not out[i] and paragraph_size[i] >= 25:
            gives, node, level = 1 + paragraph_commas[i] + paragraph_size[i] / 100, parent[i], 0
            if tag[i] in ("div", "section", "article", "main", "body"):  # text of its own makes it a container and a paragraph
                points[i] += gives
            while node and level < 5:
                points[node] += gives / (1 if level == 0 else 2 if level == 1 else 3 * level)
                node, level = parent[node], level + 1
    scored = [p * (1 - density(i)) for i, p in enumerate(points)]
    # Articles that are marked and hold more than a small part of what stands outside come first.
    marked = [i for i in range(1, n) if tag[i] in ("article", "main") and not page.inside[parent[i]] and not out[i] and size[i]]
    inner = [i for i in range(1, n) if page.inside[i] and not out[i]]
    outer = max((size[i] for i in range(1, n) if tag[i] in PARAGRAPH and tag[i] != "body" and not page.inside[i] and not out[i] and not holds[i]), default=0)
    use = inner if marked and 4 * sum(size[i] for i in marked) >= outer else [i for i in range(1, n) if not out[i]]
    best = max(use, key=lambda i: (scored[i], -i), default=0)
    if best == 0 or scored[best] <= 0:  # no paragraph at all
        roots = set(marked) or {next((i for i in range(1, n) if tag[i] == "body" and not out[i] and size[i]), 0)}
    else:
        node, around = best, 0
        while node:
            around = node if tag[node] == "article" or tag[node] == "main" and tag[around] != "article" else around
            node = parent[node]
        best = around or best
        whole = bool(around) and not page.inside[parent[best]]  # a marked article is all of the story but for a heading before it
        while parent[best] and size[parent[best]] == size[best]:  # nothing else is in it
            best = parent[best]
        roots = {best} | {i for i in marked if around and density(i) < 0.5}
        beside = [i for i in range(1, n) if parent[i] == parent[best] and (out[i] or size[i])]
        place = beside.index(best) if beside else 0
        good = lambda i: not out[i] and density(i) < 0.5
        roots.update(filter(good, beside[place + 1 :] if not whole else ()))
        led = [i for i in beside[:place] if not out[i] and (tag[i] in HEADING if whole else scored[i] >= 0.2 * scored[best] or tag[i] in HEADING or tag[i] == "p" and paragraph_size[i] > 80 and density(i) < 0.25)]
        first = beside.index(led[0]) if led else place
        while not whole and first and good(beside[first - 1]):
            first -= 1
        roots.update(filter(good, beside[first:place] if not whole else ()))
        roots.update(led)
    kept = [i in roots for i in range(n)]
    for i in range(1, n):
        kept[i] = (kept[i] or kept[parent[i]]) and not out[i]
    return " ".join("".join(text if kept[node] else " " for node, text in page.texts).split())


def extract_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) for every row of ``pages``, from the whole page.

    Null and empty pages, and pages without text, give an empty text. Rows that repeat stay. Very long pages are
    read whole, in time in proportion to their length.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col(html_col).cast("string").alias("__html")).mapInArrow(read, "page_id long, url string, text string, n_chars long")
