"""Structured cards from HTML pages."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CardSpec:
    """Where a page's card is and what is in it: field name to the tag whose text it takes."""

    card: str = "article"
    fields: dict[str, str] = field(default_factory=lambda: {"title": "h1"})
    link: str = "a"


class _Cards(HTMLParser):
    def __init__(self, spec: CardSpec):
        super().__init__(convert_charrefs=True)
        self.spec, self.cards, self.links, self.open = spec, [], 0, None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == self.spec.card:
            self.cards.append({name: [] for name in self.spec.fields})
        if tag == self.spec.link and any(k == "href" for k, _ in attrs):
            self.links += 1
        self.open = next((n for n, t in self.spec.fields.items() if t == tag), self.open) if self.cards else None

    def handle_endtag(self, tag: str) -> None:
        if self.open and self.spec.fields[self.open] == tag:
            self.open = None

    def handle_data(self, data: str) -> None:
        if self.open:
            self.cards[-1][self.open].append(data)


#: Pages of an Arrow batch that are read before their rows are passed on.
PART = 256


def _parts(batches: Iterator[pa.RecordBatch], read: Callable[..., list[tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows that ``read`` makes of each page, given its columns; a worker holds a batch as Arrow has it, and of a part of it the texts and rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, PART):
            pages = zip(*(c.to_pylist() for c in batch.slice(start, PART).columns))
            rows = [row for page in pages for row in read(*page)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _map_pages(pages: DataFrame, read: Callable[..., list[tuple]], columns: list[tuple[str, str]]) -> DataFrame:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in columns])
    return pages.mapInArrow(lambda batches: _parts(batches, read, schema), ", ".join(f"`{name}` {kind}" for name, kind in columns))


def extract_cards(pages: DataFrame, spec: CardSpec = CardSpec()) -> DataFrame:
    """SRC-5: ``page_id, position, <fields>, links, reason_code`` for every card; a page without cards is one rejection."""
    names = list(spec.fields)

    def read(page: int | None, html: str | None) -> list[tuple]:
        parser = _Cards(spec)
        parser.feed(html or "")
        if not parser.cards:
            return [(page, 0, *[None] * len(names), parser.links, "card_missing")]
        rows = []
        for k, card in enumerate(parser.cards):
            values = [" ".join("".join(card[n]).split()) or None for n in names]
            rows.append((page, k, *values, parser.links, None if all(values) else "card_invalid"))
        return rows

    columns = [("page_id", "long"), ("position", "int"), *[(n, "string") for n in names], ("links", "int"), ("reason_code", "string")]
    return _map_pages(pages.select(F.col("page_id").cast("long"), F.col("html")), read, columns)


@dataclass(frozen=True)
class Selector:
    """An element: its tag, classes that it has, and attributes: with some value (None), one value, or a word among others (``~word``)."""

    tag: str | None = None
    classes: tuple[str, ...] = ()
    attributes: tuple[tuple[str, str | None], ...] = ()

    def takes(self, tag: str, attributes: dict[str, str]) -> bool:
        if self.tag and self.tag != tag or not set(self.classes) <= set(attributes.get("class", "").split()):
            return False
        return all(name in attributes and (wanted is None or (wanted[1:] in attributes[name].split() if wanted.startswith("~") else attributes[name] == wanted)) for name, wanted in self.attributes)


@dataclass(frozen=True)
class Field:
    """A value of a card: the text of the first element that ``where`` takes, or its ``attribute``; must it be there, and what must it look like."""

    where: Selector
    attribute: str | None = None
    required: bool = True
    pattern: str | None = None


def data_field(name: str, attribute: str | None = None, required: bool = True, pattern: str | None = None) -> Field:
    return Field(Selector(attributes=(("data-field", name),)), attribute, required, pattern)


@dataclass(frozen=True)
class Selection:
    """Where a page's cards are, what they hold, and where the next page is."""

    fields: tuple[tuple[str, Field], ...]
    card: Selector = Selector("article", ("vehicle-card",))
    identity: str = "data-listing-id"
    link: Selector = Selector("a", ("vehicle-card__link",), (("href", None),))
    next: Selector = Selector("a", (), (("rel", "~next"), ("href", None)))


_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Tree(HTMLParser):
    """Elements in page order; each one's are those up to its ``end``."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags: list[str] = []
        self.attributes: list[dict[str, str]] = []
        self.end: list[int] = []
        self.texts: list[tuple[int, str]] = []  # how many elements had begun, and the text
        self.path: list[int] = []
        self.open: Counter[str] = Counter()
        self.closed: dict[int, int] = {}  # how many texts there were when an element ended

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags.append(tag)
        self.attributes.append({k: v or "" for k, v in reversed(attrs)})  # of an attribute that repeats the first counts
        self.end.append(len(self.tags))
        if tag not in _VOID:
            self.path.append(len(self.tags) - 1)
            self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        while self.open[tag]:
            node = self.path.pop()
            self.open[self.tags[node]] -= 1
            self.end[node] = len(self.tags)
            self.closed[node] = len(self.texts)
            if self.tags[node] == tag:
                break

    def handle_data(self, data: str) -> None:
        self.texts.append((len(self.tags), data))

    def read(self, html: str) -> _Tree:
        self.feed(html)
        self.close()
        for node in self.path:
            self.end[node] = len(self.tags)
        return self

    def text(self, node: int) -> str:
        """The element's texts, a space between them, in NFKC and with single spaces."""
        first = bisect_left(self.texts, (node + 1, ""))
        parts = (t.strip() for _, t in self.texts[first : self.closed.get(node, len(self.texts))])
        return " ".join(unicodedata.normalize("NFKC", " ".join(p for p in parts if p)).split())


def select_cards(pages: DataFrame, selection: Selection) -> DataFrame:
    """SRC-5: ``page_id, position, listing_id, <fields>, url, next_url, reason_code`` for every card; a page without cards is one row ``card_missing``.

    ``url`` and ``next_url`` are resolved against the page's own. The first fault in order of ``id_missing``,
    ``link_missing`` and, field by field, ``<field>_missing``, ``<field>_empty`` and ``<field>_invalid`` is the reason; what could be
    read is there all the same. Null pages have no cards, pages may be broken off, and rows that repeat stay.
    """
    names = [name for name, _ in selection.fields]
    patterns = {name: re.compile(f.pattern) for name, f in selection.fields if f.pattern}

    def absolute(base: str | None, href: str) -> str | None:
        try:
            return urljoin(base or "", href.strip()) or None
        except ValueError:
            return None

    def card(tree: _Tree, at: int, base: str | None) -> tuple:
        inside = range(at + 1, tree.end[at])
        found: dict[str, int] = {}
        link = None
        for node in inside:
            tag, attributes = tree.tags[node], tree.attributes[node]
            if link is None and selection.link.takes(tag, attributes):
                link = attributes["href"]
            for name, f in selection.fields:
                if name not in found and f.where.takes(tag, attributes):
                    found[name] = node
        identity = tree.attributes[at].get(selection.identity, "").strip() or None
        url = absolute(base, link) if link and link.strip() else None
        faults = [fault for fault, bad in (("id_missing", identity is None), ("link_missing", url is None)) if bad]
        values = []
        for name, f in selection.fields:
            value = None
            if name in found:
                value = tree.text(found[name]) if f.attribute is None else tree.attributes[found[name]].get(f.attribute, "").strip()
            if not value and f.required:
                faults.append(f"{name}_{'empty' if name in found else 'missing'}")
            elif value and name in patterns and not patterns[name].fullmatch(value):
                faults.append(f"{name}_invalid")
            values.append(value or None)
        return identity, *values, url, faults[0] if faults else None

    def read(page: int | None, base: str | None, html: str | None) -> list[tuple]:
        tree = _Tree().read(html or "")
        nodes = range(len(tree.tags))
        following = next((tree.attributes[i]["href"] for i in nodes if selection.next.takes(tree.tags[i], tree.attributes[i])), "")
        next_url = absolute(base, following) if following.strip() else None
        cards = [i for i in nodes if selection.card.takes(tree.tags[i], tree.attributes[i])]
        if not cards:
            return [(page, 0, None, *[None] * len(names), None, next_url, "card_missing")]
        rows = []
        for k, at in enumerate(cards):
            *values, reason = card(tree, at, base)
            rows.append((page, k, *values, next_url, reason))
        return rows

    columns = [("page_id", "long"), ("position", "int"), ("listing_id", "string"), *[(n, "string") for n in names], ("url", "string"), ("next_url", "string"), ("reason_code", "string")]
    return _map_pages(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), read, columns)
