"""Links of stored pages (X1, X2, X8, P3, P4, G2) as column expressions.

X1: one linear scan cuts the page into comments, raw elements, links and other tags;
the parts are taken from each link, and character references in hrefs are decoded.  All
of it stays inside the JVM.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import cache
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import trim_controls

# --- fixed values -----------------------------------------------------------
# An attribute as the HTML syntax has it: a name, and a double-quoted, single-quoted or bare value.  Loops are
# possessive, so a page of any length is scanned once and without recursion.
ATTRIBUTE = r"""[\s/]*+[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)))?+"""
# What a start tag's name is followed by, to the tag's end.
TAG_REST = rf"(?=[\s/>])(?:{ATTRIBUTE})*+[\s/]*+>"
# Elements whose content is text, whatever it looks like.
RAW_ELEMENTS = ["script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"]
COMMENT = r"<!--.*?(?:-->|\z)"
RAW = "|".join(rf"<{x}{TAG_REST}.*?(?:</{x}(?=[\s/>])[^>]*+>|\z)" for x in RAW_ELEMENTS)
TAG = rf"</?[a-z][^\s/>]*+{TAG_REST}"
# Comments, raw elements, links with all that they hold (to their end tag or the next link), other tags.
LINK_OR_OTHER = rf"(?is){COMMENT}|{RAW}|<a{TAG_REST}(?:{COMMENT}|{RAW}|(?!</?a[\s/>])(?:{TAG}|[^<]++|<))*+(?:</a(?=[\s/>])[^>]*+>)?+|{TAG}"
# The href of a link: its first attribute of just this name (group 1: the value, with its quotes).
HREF = rf"""(?is)^<a(?=[\s/>])(?:(?![\s/]*+href(?=[\s/>=])){ATTRIBUTE})*+[\s/]*+href(?=[\s/>=])(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)))?+"""
# The inner HTML of a link (group 1).
INNER = rf"(?is)^<a{TAG_REST}(.*?)(?:</a(?=[\s/>])[^>]*+>)?\z"
# Character references, and the text between them; the named ones that most hrefs use.
REFERENCE_PIECE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);|[^&]+|&"
NAMED_REFERENCES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": "\u00a0"}
SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
# Protocols java.net.URL accepts; any other makes the href malformed.
KNOWN_PROTOCOLS = ["http", "https", "ftp", "file", "jar", "mailto"]
# Default ports filled into a site key.
DEFAULT_PORTS = {"http": 80, "https": 443, "ftp": 21}
# Link-follow rule of the reference crawl (P3): prefix, and substrings to avoid.
FOLLOW_PREFIX = "https://idebate.org/debatabase"
FOLLOW_EXCLUDE = ["rate=", "user/login", "offices-services"]
# ---------------------------------------------------------------------------


def _code_point(ref: Column) -> Column:
    """Character of a numeric reference (``&#38;``, ``&#x26;``); U+FFFD where there is none."""
    is_hex = F.lower(F.substring(ref, 3, 1)) == "x"
    digits = F.regexp_extract(ref, r"^&#[xX]?([0-9a-fA-F]+);$", 1)
    n = F.when(is_hex, F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("long")
    valid = (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise("\ufffd")


@cache
def _all_names() -> str:
    """Every named reference of HTML, as JSON text; the standard library's table."""
    return json.dumps({f"&{name}": char for name, char in html5.items() if name.endswith(";")})


def decode_references(c: Column) -> Column:
    """Character references of a short text (an href) decoded; unknown names stay as they are."""
    names = F.from_json(F.lit(_all_names()), "map<string,string>")  # a constant: parsed once

    def piece(p: Column) -> Column:
        out = F.when(p.rlike(r"^&#(?:[0-9]+|[xX][0-9a-fA-F]+);$"), _code_point(p))
        for name, char in NAMED_REFERENCES.items():
            out = out.when(p == name, F.lit(char))
        return out.when(p.rlike("^&[a-zA-Z]"), F.coalesce(F.try_element_at(names, p), p)).otherwise(p)
    decoded = F.array_join(F.transform(F.regexp_extract_all(c, F.lit(REFERENCE_PIECE), 0), piece), "")
    return F.when(F.instr(c, "&") > 0, decoded).otherwise(c)


def extract_links(html: Column) -> Column:
    """``array<struct<pos, href, anchor>>`` in document order; ``anchor`` is the inner HTML.

    One scan cuts the page into comments, raw elements, links and other tags, so what looks like a link inside a comment,
    a script, a text area or a quoted attribute is none, and ``>`` inside quotes ends no tag.  A link that is
    not closed ends before the next one.
    """
    found = F.filter(F.regexp_extract_all(html, F.lit(LINK_OR_OTHER), 0), lambda m: m.rlike(HREF))

    def link(m: Column, i: Column) -> Column:
        value = F.regexp_extract(m, HREF, 1)
        bare = F.when(F.substring(value, 1, 1).isin("'", '"'), F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)
        return F.struct(i.cast("int").alias("pos"), decode_references(bare).alias("href"), F.regexp_extract(m, INNER, 1).alias("anchor"))
    return F.transform(found, link)


def _scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, SCHEME, 1))


def _authority(u: Column) -> Column:
    return F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def url_path(u: Column) -> Column:
    """Path of an absolute URL ('' when there is none), as ``URL.getPath()``."""
    return F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def _remove_dots(path: Column) -> Column:
    """RFC 3986 dot-segment removal over the ``/``-separated segments."""
    segs = F.split(path, "/", -1)
    kept = F.aggregate(
        segs, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1))
                              .otherwise(acc))
        .when(s == ".", acc).otherwise(F.array_append(acc, s)))
    last = F.element_at(segs, -1)
    kept = F.when(last.isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    return F.array_join(kept, "/")


def _with_clean_path(origin: Column, ref: Column) -> Column:
    path = F.regexp_extract(ref, r"^([^?#]*)", 1)
    rest = F.substr(ref, F.length(path) + 1)
    return F.concat(origin, _remove_dots(path), rest)


def resolve_url(base: Column, href: Column) -> Column:
    """X2, first half: absolute URL of ``href`` against ``base`` (RFC 3986 merge)."""
    h = trim_controls(href)
    scheme = F.regexp_extract(base, SCHEME, 1)
    origin = F.concat(scheme, F.lit("://"), _authority(base))
    base_path = url_path(base)
    base_nofrag = F.regexp_replace(base, r"#.*$", "")
    base_dir = F.when(base_path == "", F.lit("/")).otherwise(F.regexp_extract(base_path, r"^(.*/)", 1))
    return (F.when(h.rlike(SCHEME), h)
            .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
            .when(h == "", base_nofrag)
            .when(h.startswith("#"), F.concat(base_nofrag, h))
            .when(h.startswith("?"), F.concat(origin, base_path, h))
            .when(h.startswith("/"), _with_clean_path(origin, h))
            .otherwise(_with_clean_path(origin, F.concat(base_dir, h))))


def cut_fragment(u: Column) -> Column:
    """X2, second half: drop everything from the last ``#``."""
    return F.regexp_replace(u, r"#[^#]*$", "")


def well_formed(u: Column) -> Column:
    """The protocol is one ``java.net.URL`` knows."""
    return _scheme(u).isin(KNOWN_PROTOCOLS)


def site_key(u: Column) -> Column:
    """``protocol://host:port`` with the protocol's default port filled in."""
    scheme = _scheme(u)
    auth = F.regexp_replace(_authority(u), r"^[^@]*@", "")
    host = F.regexp_extract(auth, r"^([^:]*)", 1)
    port = F.regexp_extract(auth, r":([0-9]+)$", 1)
    default = F.coalesce(*[F.when(scheme == k, F.lit(str(v))) for k, v in DEFAULT_PORTS.items()],
                         F.lit("-1"))
    return F.concat(scheme, F.lit("://"), host, F.lit(":"),
                    F.when(port != "", port).otherwise(default))


def follow_rule(prefix: str = FOLLOW_PREFIX, exclude: Sequence[str] = FOLLOW_EXCLUDE
                ) -> Callable[[Column, Column], Column]:
    """A ``(dest, anchor) -> Column`` predicate: prefix and none of the substrings."""
    def rule(dest: Column, anchor: Column) -> Column:  # noqa: ARG001 - anchor is part of the interface
        cond = dest.startswith(prefix)
        for s in exclude:
            cond = cond & ~dest.contains(s)
        return cond
    return rule


def anchor_rule(words: Sequence[str]) -> Callable[[Column, Column], Column]:
    """V1: a rule that looks at the anchor: its text, without tags and whatever the case, has one of ``words``."""
    def rule(dest: Column, anchor: Column) -> Column:  # noqa: ARG001 - dest is part of the interface
        text = F.lower(F.regexp_replace(anchor, "<[^>]*>", ""))
        return F.arrays_overlap(F.split(text, r"[^\p{L}\p{N}]+"), F.array(*[F.lit(w.lower()) for w in words]))
    return rule


def link_table(pages: DataFrame, url_col: str = "url", html_col: str = "html",
               follow: Callable[[Column, Column], Column] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """``(src, pos, dest, anchor)`` - every well-formed link, fragment cut,
    kept by the ``follow`` predicate (all links when ``None``); ``keep`` names page columns to carry along."""
    ex = pages.select(F.col(url_col).alias("src"), *keep,
                      F.explode(extract_links(F.col(html_col))).alias("l"))
    out = ex.select("src", *keep, F.col("l.pos").alias("pos"),
                    cut_fragment(resolve_url(F.col("src"), F.col("l.href"))).alias("dest"),
                    F.col("l.anchor").alias("anchor"))
    out = out.filter(well_formed(F.col("dest")))
    if follow is not None:
        out = out.filter(follow(F.col("dest"), F.col("anchor")))
    return out
