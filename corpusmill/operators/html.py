"""Records of stored pages by rules.

A rule set names by CSS selectors a record's container, its title, and per block of points the block, its items
and the items' fields.  A page's tags are scanned once, start and end tags are matched by a stack, and a field's text is
that of its whole element, nested elements too.  A page is a row, so matching stays in the row: no shuffle, and
built-in functions cannot match nested tags.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.links import decode_references

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package


@dataclass(frozen=True)
class Block:
    """Points of one side.  ``start`` selects the block in the container (None: the container itself), ``item`` the items in it;
    the fields are selected in an item, ``"&"`` is the item itself, and a field without a selector is null."""

    side: str
    start: str | None
    item: str
    claim: str
    argument: str | None = None
    counter: str | None = None


@dataclass(frozen=True)
class Rules:
    container: str
    title: str
    blocks: tuple[Block, ...]


def _side(side: str, n: int, ending: str) -> Block:
    return Block(side, f"div#debatabase-points-{n}", "div.content", *(f"div.field-name-field-{x}{ending} .field-item" for x in ("title", "point", "counterpoint")))


def _for_side() -> Block:
    return Block("for", "div#debatabase-points-1", "div.content", *(f"div.field-name-field-{x}-point-for .field-item" for x in ("title", "point", "counterpoint")))


# --- fixed values -----------------------------------------------------------
# Rules of the debate pages: container, title and the two blocks of points.
DEBATE_RULES = Rules("div.node-debatabase", "div.debatabase-title", (_for_side(), _side("against", 2, "")))
# Elements without content, elements whose content is text, and those that break a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
UNSEEN = frozenset(("script", "style"))
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
                   "h5 h6 head header hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
# An open element of the first kind ends where one of the second begins in the same parent.
ENDS = {"p": BLOCKS - {"body", "head", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr"},
        "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
# ---------------------------------------------------------------------------

_ATTRIBUTE = r"""[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)))?+"""
_TAG_REST = re.sub(r"\((?!\?)", "(?:", _ATTRIBUTE)
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({'|'.join(RAW)})((?=[\s/>])(?:{_TAG_REST})*+[\s/]*+)>(.*?)(?:</\1(?=[\s/>])[^>]*+>|\Z)"
                    rf"|<(/?)([a-z][^\s/>]*+)((?=[\s/>])(?:{_TAG_REST})*+[\s/]*+)>|<[!?][^>]*+>|[^<]++|<", re.I | re.S)
_ATTRIBUTES = re.compile(_ATTRIBUTE, re.S)


@dataclass
class Element:
    """An element of a page: the texts from ``start`` up to ``end`` are inside it."""

    tag: str
    start: int
    end: int
    order: int
    last: int  # order of the last element inside
    id: str = ""
    classes: frozenset[str] = field(default_factory=frozenset)


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTES.findall(text):
        out.setdefault(name.lower(), unescape(value[1:-1] if value[:1] in ("'", '"') else value))
    return out


def scan(html: str) -> tuple[list[Element], list[str]]:
    """Elements of a page in document order, and its texts; a line break is a space of its own.

    An end tag closes the last open element of its name and all opened in it, but an inline one
    leaves blocks open; one that closes nothing is ignored.  What stays open ends with its parent.
    """
    elements: list[Element] = []
    texts: list[str] = []
    stack: list[Element] = []

    def end(e: Element) -> None:
        e.end, e.last = len(texts), len(elements) - 1

    def begin(tag: str, attributes: str) -> Element:
        a = _attributes(attributes) if attributes.strip() else {}
        e = Element(tag, len(texts), -1, len(elements), len(elements), a.get("id", ""), frozenset(a.get("class", "").lower().split()))
        elements.append(e)
        return e

    for m in _TOKEN.finditer(html):
        raw, raw_rest, raw_text, slash, name, rest = m.groups()
        if raw:
            tag = raw.lower()
            e = begin(tag, raw_rest)
            if tag not in UNSEEN:
                texts.append(unescape(raw_text))
            end(e)
        elif name:
            tag = name.lower()
            if tag in BLOCKS or tag == "br":
                texts.append(" ")
            if slash:
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag), None)
                if at is None:
                    continue
                if tag not in BLOCKS and any(e.tag in BLOCKS for e in stack[at + 1:]):
                    end(stack.pop(at))
                    continue
                while len(stack) > at:
                    end(stack.pop())
                continue
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag in BLOCKS), None)
            while at is not None and tag in ENDS.get(stack[at].tag, ()):
                while len(stack) > at:
                    end(stack.pop())
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag in BLOCKS), None)
            e = begin(tag, rest)
            if tag in VOID or rest.endswith("/"):
                end(e)
            else:
                stack.append(e)
        elif not m.group().startswith(("<!", "<?")):
            texts.append(unescape(m.group()))
    while stack:
        end(stack.pop())
    return elements, texts


def parsed(selector: str) -> list[tuple[str, str, frozenset[str]]]:
    """``tag#id.class`` steps of a selector, an ancestor before each descendant."""
    steps = []
    for step in selector.split():
        tag, *parts = re.findall(r"(?:^[a-z0-9]*|[#.][\w-]+)", step, re.I)
        steps.append((tag.lower(), next((x[1:] for x in parts if x[0] == "#"), ""), frozenset(x[1:].lower() for x in parts if x[0] == ".")))
    return steps


def _fits(e: Element, step: tuple[str, str, frozenset[str]]) -> bool:
    return (not step[0] or e.tag == step[0]) and (not step[1] or e.id == step[1]) and step[2] <= e.classes


class Matches:
    """The elements of a page that a selector names, in document order."""

    def __init__(self, elements: list[Element], selector: str):
        *above, last = parsed(selector)
        inside = [True] * len(elements)
        for step in above:  # elements inside one that fits the step, and so on inwards
            reach, now = -1, []
            for e, ok in zip(elements, inside):
                now.append(e.order <= reach)
                if ok and _fits(e, step):
                    reach = max(reach, e.last)
            inside = now
        self.found = [e for e, ok in zip(elements, inside) if ok and _fits(e, last)]
        self.orders = [e.order for e in self.found]

    def within(self, e: Element) -> Iterator[Element]:
        """Those inside an element."""
        for i in range(bisect_right(self.orders, e.order), len(self.found)):
            if self.found[i].order > e.last:
                return
            yield self.found[i]


def records_of(html: str, rules: Rules) -> Iterator[tuple]:
    """``(title, side, pos, claim, argument, counter)`` of a page, texts with their white space as it stands."""
    elements, texts = scan(html)
    box = next(iter(Matches(elements, rules.container).found), None)
    if box is None:
        return

    def text(e: Element | None) -> str | None:
        return None if e is None else "".join(texts[e.start:e.end])

    title = text(next(Matches(elements, rules.title).within(box), None))
    for b in rules.blocks:
        start = box if b.start is None else next(Matches(elements, b.start).within(box), None)
        if start is None:
            continue
        fields = [None if s is None or s == "&" else Matches(elements, s) for s in (b.claim, b.argument, b.counter)]
        pos = 0
        for item in Matches(elements, b.item).within(start):
            claim, argument, counter = (item if s == "&" else None if m is None else next(m.within(item), None)
                                        for s, m in zip((b.claim, b.argument, b.counter), fields))
            if claim is not None:
                yield title, b.side, pos, text(claim), text(argument), text(counter)
                pos += 1


def folded(c: Column) -> Column:
    """White space of a text folded and trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def element_text(inner: Column) -> Column:
    """X4 as a column: text of inner HTML, character references decoded; a line break is a space."""
    spaced = F.regexp_replace(inner, rf"(?i)</?(?:br|{'|'.join(sorted(BLOCKS))})(?=[\s/>])[^>]*+>", " ")
    return folded(decode_references(F.regexp_replace(spaced, "<[^>]*>", "")))


def _records(rules: Rules):
    schema = pa.schema([*((c, pa.string()) for c in ("url", "title", "side")), ("pos", pa.int32()), *((c, pa.string()) for c in ("claim", "argument", "counter"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for url, html in zip(b.column("url").to_pylist(), b.column("html")):
                rows = [(url, *r) for r in records_of(html.as_py() or "", rules)]
                for at in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at:at + 1000]), schema)], schema=schema)
    return run


def page_records(pages: DataFrame, rules: Rules = DEBATE_RULES, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """X3 over a page table: ``(url, title, side, pos, claim, argument, counter)``.

    No container - no rows (P5); an item without a claim is skipped (P6); title, argument and
    counter may be missing; a missing block gives no rows.
    """
    found = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(
        _records(rules), "url string, title string, side string, pos int, claim string, argument string, counter string")
    return found.select("url", folded(F.col("title")).alias("title"), "side", "pos", *[folded(F.col(c)).alias(c) for c in ("claim", "argument", "counter")])
