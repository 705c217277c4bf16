"""Operator 8, HTML extraction by equivalence-class template deduction.

Tokens are elements, told apart by their path of tags and first classes.  A token's occurrence vector holds its count
on every page of a host; tokens with equal vectors form an equivalence class.  The vectors never meet in
one place: a sum over pages of ``hash(page, count)`` stands for a vector, so classes come from two partial aggregations even
when a host has a third of all pages.  A class is valid when it has several tokens, stands on enough of
the host's pages and each of its tokens once a page; paths nest the valid classes into the host's template.

The template's slot for the main text is its innermost container that holds nearly all text of the host that is not the same on most
pages; ``article`` and ``main`` that do come first, the outermost one.  The text of that slot is extracted from each page without menus, forms and
the like; a page whose slot is missing or empty falls back to its own ``article`` or ``main`` elements, then to the whole body.
Blocks of text are tokens too: one that stands on nearly all different pages of a host is template and goes, even inside the
slot, unless the page would be empty without it; pages that are copies of one another count once, so copies keep their text.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import table, written
from corpusmill.llm.host_reputation import with_host_and_path

MIN_SUPPORT, NEARLY, CLOSE, BROADCAST_HOSTS, SALTS = 0.5, 0.99, 0.95, 500_000, 16
CONSTANT, LEAST_PAGES = 0.9, 4  # share of a host's different pages that a block of its template stands on; fewer pages tell nothing

# HTML's elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Empty where no end tag follows or the tag closes itself, so that they take nothing else with them.
CLOSED = frozenset("svg noscript template object canvas button select iframe math".split())
INLINE = CLOSED | frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var "
                   "wbr br img".split())
BOILERPLATE = frozenset("nav header footer aside form script style noscript template button select textarea iframe svg head dialog "
                        "menu object canvas".split())
# What a class says beside a word of boilerplate without changing it: "comment-list", "banner-top".
NEUTRAL_WORDS = frozenset("area bar block bottom box column container element form group inner item items left link links list main outer panel post posts "
                          "right section site slot top unit user users wrap wrapper zone".split())
BOILERPLATE_WORDS = frozenset("ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
                              "cookies footer masthead menu modal nav navbar navigation newsletter notice notices popup promo related "
                              "respond share sharing sidebar signup social sponsor sponsored subscribe widget".split())
MAIN = frozenset("article main".split())
WHOLE = frozenset("html body".split())
NEVER_SLOT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre figcaption caption summary legend title".split())
CONTAINERS = CLOSED | frozenset("html body article main section div td th li ul ol table blockquote nav header footer aside form figure dd".split())

_EVENT = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea|title)\b[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attrs>(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>|<(?P<lend>/?)(?P<ltag>[a-z][^\s/>]*+)[^>]*+>"
    r"|<[!?][^>]*+>|(?P<text>[^<]++|<)", re.S | re.I)
_MARK = re.compile(r"""(?<![\w:.-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_SAYING = BOILERPLATE_WORDS | NEUTRAL_WORDS


class _Node:
    __slots__ = ("chars", "depth", "holds", "main", "name", "path", "skip", "tag", "up", "worded")

    def __init__(self, tag: str, attrs: str, up: _Node | None):
        marks = _MARK.findall(attrs) if "=" in attrs else ()
        # A class counts when its words are boilerplate's and neutral ones: "cookie-notice", not "no-sidebar".
        worded = any(BOILERPLATE_WORDS.intersection(w := _WORD.findall(x)) and _SAYING.issuperset(w) for m in marks for x in "".join(m[1:]).lower().split())
        first = next(("".join(m[1:]).split() for m in marks if m[0].lower() == "class"), None)
        self.tag, self.name = tag, f"{tag}.{first[0]}" if first else tag
        self.depth = up.depth + 1 if up else 0
        seed = up.path & 0xFFFFFFFFFFFFFFFF if up else 0
        self.path = xxhash.xxh64_intdigest(self.name.encode("utf-8", "replace"), seed) if tag not in INLINE else up.path if up else 0
        if self.path >= 1 << 63:
            self.path -= 1 << 64
        self.main = tag in MAIN or "main" in {"".join(m[1:]).lower() for m in marks if m[0].lower() == "role"}
        self.worded = worded and tag not in WHOLE and not self.main
        self.skip = bool(up and up.skip) or tag in BOILERPLATE
        self.up, self.chars, self.holds = up, 0, False


def walk(page: str) -> Iterator[tuple[str, object, list[_Node]]]:
    """Events of a page with the open elements: ``open`` (node), ``text`` (raw string), ``close`` (node), ``space``.

    Open paragraphs, list items and cells end where HTML ends them; end tags without a start are ignored.  Elements of ``CLOSED`` that
    close themselves or have no end tag behind them are empty.
    """
    stack: list[_Node] = []
    last_end: dict[str, int] = {}

    def never_ends(tag: str, at: int) -> bool:
        if tag not in last_end:
            found = [m.start() for m in re.finditer(rf"</{tag}[\s/>]", page, re.I)]
            last_end[tag] = found[-1] if found else -1
        return last_end[tag] < at

    def closes(tags: frozenset | set) -> int | None:
        """Depth of the innermost open element of ``tags`` within its container."""
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].tag in tags:
                return i
            if stack[i].tag in CONTAINERS:
                return None
        return None

    for m in _EVENT.finditer(page):
        if (t := m["text"]) is not None:
            yield "text", t, stack
            continue
        tag = m["tag"] or m["ltag"]
        if not tag:
            continue
        tag = tag.lower()
        if m["end"] or m["lend"]:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag), None)
        else:
            same = {"li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}.get(tag)
            at = closes(same) if same else None if tag in INLINE else closes({"p", "h1", "h2", "h3", "h4", "h5", "h6"})
        if at is not None:
            for node in reversed(stack[at:]):
                stack.pop()
                yield "close", node, stack
        if not (m["end"] or m["lend"]):
            if tag in VOID:
                yield "space", tag, stack
            elif tag in CLOSED and ((m["attrs"] or "").endswith("/") or never_ends(tag, m.end())):
                pass
            else:
                stack.append(node := _Node(tag, m["attrs"] or "", stack[-1] if stack else None))
                yield "open", node, stack
    for node in reversed(stack):
        yield "close", node, []


def events(page: str | None, slot: int | None = None) -> list[tuple[str, object, _Node | None]]:
    """Events of ``walk`` with the innermost open element, boilerplate marked.

    An element whose class, id or role says boilerplate is taken for it unless it holds the slot, a ``main``, or
    most of the page's text.
    """
    out, nodes, total = [], [], 0
    for kind, x, stack in walk(page or ""):
        up = stack[-1] if stack else None
        out.append((kind, x, up))
        if kind == "text":
            if not (up and up.skip) and not x.isspace():
                total += len(x)
                if up:
                    up.chars += len(x)
        elif kind == "open":
            nodes.append(x)
            x.holds = not x.skip and (x.path == slot and x.tag not in INLINE or x.main and x.tag != "article")
        elif kind == "close" and x.up:
            x.up.chars += x.chars
            x.up.holds |= x.holds
    for x in nodes:
        x.skip |= bool(x.up and x.up.skip) or x.worded and not x.holds and x.chars * 2 <= total
        x.chars = 0
    return out


def page_tokens(found: list[tuple[str, object, _Node | None]]) -> dict[int, list]:
    """``path -> [name, depth, says main, count, characters of text, own characters, own text's hash, can be the slot]`` of the
    elements outside boilerplate among a page's events; own is what stands in the element but in no other block within it."""
    out: dict[int, list] = {}
    own: dict[int, list[str]] = {}
    for kind, x, up in found:
        if kind == "text" and up:
            if not up.skip and not x.isspace():
                up.chars += len(x)
                own.setdefault(up.path, []).append(x)
        elif kind == "close":
            if up:
                up.chars += x.chars
            if x.tag not in INLINE and not x.skip:
                t = out.setdefault(x.path, [x.name, x.depth, x.main, 0, 0, 0, 0, x.tag not in NEVER_SLOT])
                t[3] += 1
                t[4] += x.chars
    for path, texts in own.items():
        if path in out:
            text = "\n".join(texts)
            out[path][5:7] = sum(map(len, texts)), xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) >> 1
    return out


def _parts(found: list[tuple[str, object, _Node | None]], slot: int | None) -> dict[str, list[str]]:
    """Blocks of the slot, of the ``main`` elements and of the whole body: white space folded, references decoded."""
    slots: dict[str, list[str]] = {"slot": [], "main": [], "body": []}
    parts: dict[str, list[str]] = {k: [] for k in slots}
    depth = {"slot": None, "main": None}

    def end_block() -> None:
        for k, p in parts.items():
            if p:
                if block := " ".join(entities.unescape("".join(p)).split()):
                    slots[k].append(block)
                p.clear()

    for kind, x, up in found:
        if kind == "text":
            if not (up and up.skip):
                for k, p in parts.items():
                    if k == "body" or depth[k] is not None:
                        p.append(x)
            continue
        if kind != "space" and x.up and x.up.skip:
            continue  # within boilerplate nothing ends a block
        tag = x if kind == "space" else x.tag
        if kind == "space" and tag != "hr" or tag in INLINE:
            if tag in ("br", "img"):
                for p in parts.values():
                    p.append(" ")
            continue
        end_block()
        if kind == "open" and not x.skip:
            for k, fits in (("slot", x.path == slot), ("main", x.main)):
                if depth[k] is None and fits:
                    depth[k] = x.depth
        elif kind == "close":
            for k in depth:
                if depth[k] == x.depth:
                    depth[k] = None
    end_block()
    return slots


def block_hash(block: str) -> int:
    return xxhash.xxh64_intdigest(block.encode("utf-8", "replace")) >> 1


def main_text(page: str | None, slot: int | None, constant: frozenset[int] = frozenset()) -> str:
    """Text of the template's main slot: blocks in page order, one a line, without the template's own blocks ``constant`` (unless there are no others)."""
    blocks = next((t for t in _parts(events(page, slot), slot).values() if t), [])
    return "\n".join([b for b in blocks if block_hash(b) not in constant] or blocks if constant else blocks)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["host", "page", "path", "depth", "main", "n", "chars", "own", "words", "fit", "version"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
    for b in batches:
        rows = []
        for h, p, page in zip(*(b.column(c).to_pylist() for c in ("host", "page", "html"))):
            found = events(page)
            blocks = [block_hash(x) for x in _parts(found, None)["body"]]
            version = xxhash.xxh64_intdigest(repr(blocks)) >> 1
            rows += [(h, p, path, *x, None) for path, (_, *x) in page_tokens(found).items()]
            rows += [(h, None, x, None, None, None, None, None, None, None, version) for x in set(blocks)]  # a block of text is a token too
        cols = list(zip(*rows)) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(p, s, frozenset(c or ())) for p, s, c in zip(*(b.column(x).to_pylist() for x in ("html", "slot", "constant")))]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()),
                                          pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def host_templates(pages: DataFrame, min_support: float = MIN_SUPPORT) -> DataFrame:
    """``host, slot, constant, classes, tokens``: each host's main slot (null without one), the hashes of its template's blocks of text
    (null without any) and the size of its template.

    ``pages``: ``host, page`` (a hash that tells pages apart)``, html``.
    """
    t = pages.mapInArrow(_tokens, "host string, page long, path long, depth int, main boolean, n long, chars long, own long, words long, fit boolean, version long")
    found = t.groupBy("host", "path", "version").agg(  # the version is null but for blocks: one row per page that differs
        F.count(F.lit(1)).alias("support"), F.sum(F.xxhash64("page", "n").cast("decimal(20,0)")).alias("vector"), F.max("n").alias("most"),
        F.sum("chars").alias("chars"), F.max("depth").alias("depth"), F.max("main").alias("main"), F.max("fit").alias("fit"),
        F.sum("own").alias("own"), (F.min("words") != F.max("words")).alias("varies"))
    found = written(found, "template-vectors")
    vectors, blocks = found.where("version is null").drop("version"), found.where("version is not null").select("host", "path", "version")
    versions = blocks.groupBy("host").agg(F.countDistinct("version").alias("versions"))
    constant = (blocks.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= CONSTANT * LEAST_PAGES).join(versions, "host")
                .where((F.col("versions") >= LEAST_PAGES) & (F.col("n") >= CONSTANT * F.col("versions")))
                .groupBy("host").agg(F.collect_set("path").alias("constant")))  # no more than about a page's blocks
    classes = vectors.groupBy("host", "support", "vector").agg(F.count(F.lit(1)).alias("size"), F.max("most").alias("most"))
    hosts = vectors.groupBy("host").agg(F.max("support").alias("pages"), F.max("chars").alias("most_chars"))
    # Text that is the same on most pages is template, unless the host has nothing else.
    varies = F.col("varies") | (F.col("support") * 2 <= F.col("pages")) | (F.col("pages") == 1)
    texts = vectors.join(hosts, "host").groupBy("host").agg(F.sum(F.when(varies, F.col("own")).otherwise(0)).alias("varying"))
    hosts = hosts.join(texts, "host").withColumn("all_chars", F.when(F.col("varying") > 0, F.col("varying")).otherwise(F.col("most_chars")))
    valid = classes.join(hosts, "host").where((F.col("most") == 1) & (F.col("support") >= min_support * F.col("pages"))
                                              & ((F.col("size") > 1) | (F.col("support") == F.col("pages"))))
    nodes = vectors.join(valid, ["host", "support", "vector"]).select("host", "path", "depth", vectors["main"], "fit", "chars", "all_chars", "support", "vector")
    # The outermost main element that holds NEARLY all, or else the innermost other one that does; without any (pages of
    # several roots) the fullest that comes close.
    holds, close = (F.col("chars") >= share * F.col("all_chars") for share in (NEARLY, CLOSE))
    order = F.struct(holds.alias("holds"), "main", F.when(~holds, F.col("chars")).when(F.col("main"), -F.col("depth")).otherwise(F.col("depth")).alias("rank"), "chars", "path")
    slots = nodes.groupBy("host").agg(
        F.max_by("path", F.when(F.col("fit") & close, order)).alias("slot"),
        F.countDistinct("support", "vector").alias("classes"), F.count(F.lit(1)).alias("tokens"))
    return slots.join(constant, "host", "full").select("host", "slot", "constant", "classes", "tokens")


def extract_main_text(pages: DataFrame, min_support: float = MIN_SUPPORT, broadcast_hosts: int = BROADCAST_HOSTS,
                      salts: int = SALTS) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages (page_id, url, html)``.

    Null html counts as empty and gives an empty text; pages without a host in their url share the empty host;
    repeated rows give repeated results; an empty table gives an empty result.  Up to ``broadcast_hosts`` templates (some 60 bytes each) are
    broadcast; more are joined on host and salt, so a host's pages spread over ``salts`` tasks.
    """
    p = with_host_and_path(pages.select("page_id", "url", "html")).select("page_id", "url", "host", "html")
    slots = written(host_templates(p.withColumn("page", F.xxhash64("page_id", "url", F.length("html"))), min_support).select("host", "slot", "constant"), "templates")
    if slots.limit(broadcast_hosts + 1).count() <= broadcast_hosts:
        joined = p.join(F.broadcast(slots), "host", "left")
    else:
        spread = slots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(spread, ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "slot", "constant").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")


def op8_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of ``pages``."""
    return extract_main_text(table(spark, sf_dir, "pages"))
