"""Column functions for text.

Every function takes and returns ``Column`` objects built from Spark built-ins and
runs in the JVM; those with lambdas are interpreted, the others are code-generated.
Their SQL twins are in ``corpusmill.plans.sqlparts``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Python's str.split() separators: Unicode whitespace plus the four
# information separators U+001C..U+001F.
WHITESPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
# Sentence = a run of URL tokens or non-terminal characters, closed by a run of
# . ! ? or the end of the text; a lone terminal run is also a sentence.  Possessive
# loops: the matcher neither recurses nor backtracks, whatever the text's length.
SENTENCE_PATTERN = r"(?:[^.!?h]++|https?:\S*+|h)++(?:[.!?]++|$)|[.!?]++"
# Token = a URL-ish token (http:/https: then non-space), a word of letters,
# digits and underscores with inner apostrophes, or one punctuation mark.
# A double quote is a separator, not a token.
TOKEN_PATTERN = r"https?:\S*+|[\p{L}\p{N}_]++(?:['’][\p{L}\p{N}_]++)*+|[^\s\p{L}\p{N}_\"]"
# Reference-list marker: the text after the first " 1: " is a citation list.
REFERENCE_MARKER = " 1: "
# Content-type charset parameter, default charset.
CHARSET_PATTERN = r"charset=([^\s;]+)"
DEFAULT_CHARSET = "UTF-8"
# Characters that a trim removes: the space and everything below it.
TRIMMED = r"^[\x00-\x20]+|[\x00-\x20]+$"
# Stored-page timestamp format.
ISO_TIMESTAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSZ"
# ---------------------------------------------------------------------------


def lower(c: Column) -> Column:
    """F1."""
    return F.lower(c)


def ws_tokens(c: Column) -> Column:
    """Python ``str.split()``: runs of whitespace, no empty tokens
    (``array_remove`` is code-generated, unlike a lambda filter)."""
    return F.array_remove(F.split(c, WHITESPACE_RUN), "")


def space_split_len(c: Column) -> Column:
    """``len(x.split(' '))`` - counts empty pieces (a leading space adds one)."""
    return F.size(F.split(c, " ", -1))


def remove_quotes(c: Column) -> Column:
    """F4."""
    return F.replace(c, F.lit('"'), F.lit(""))


def trim_controls(c: Column) -> Column:
    """Spaces, tabs, line breaks and other control characters cut from both ends."""
    return F.regexp_replace(c, TRIMMED, "")


def robots_line(c: Column) -> Column:
    """text before the first ``#``, trimmed."""
    return trim_controls(F.substring_index(c, "#", 1))


def id_string(*cols: Column) -> Column:
    """``%d_%d_...`` id."""
    return F.format_string("_".join(["%d"] * len(cols)), *cols)


def parse_iso_ts(c: Column) -> Column:
    """parse the store's timestamp format."""
    return F.to_timestamp(c, ISO_TIMESTAMP)


def format_iso_ts(c: Column) -> Column:
    """print in the store's timestamp format."""
    return F.date_format(c, ISO_TIMESTAMP)


def pct4(c: Column) -> Column:
    """F8: ``round(x, 4) * 100`` as double."""
    return (F.round(c.cast("double"), 4) * F.lit(100.0)).cast("double")


def iequals(a: Column, b: Column) -> Column:
    """case-insensitive equality."""
    return F.lower(a) == F.lower(b)


def join_words(c: Column, sep: str = " ") -> Column:
    """F10."""
    return F.array_join(c, sep)


def l2_norm(v: Column) -> Column:
    """Euclidean norm of an array<float>."""
    return F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalize(v: Column) -> Column:
    """unit vector (a zero vector stays zero)."""
    n = l2_norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two equal-length arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def sentences(c: Column) -> Column:
    """X5, first half: sentence strings of a text."""
    return F.regexp_extract_all(c, F.lit(SENTENCE_PATTERN), 0)


def tokens(c: Column) -> Column:
    """X5, second half: tokens of one sentence, punctuation kept as tokens."""
    return F.regexp_extract_all(c, F.lit(TOKEN_PATTERN), 0)


def clean_sentence_tokens(toks: Column) -> Column:
    """P8 then F4: drop ``http:`` tokens (not ``https:``), strip ``"`` inside tokens."""
    return F.transform(F.filter(toks, lambda t: ~t.startswith("http:")),
                       lambda t: F.replace(t, F.lit('"'), F.lit("")))


def split_argument(c: Column) -> Column:
    """X5 + P7 + P8 + F4: the sentence list of an argument text.

    Sentences of at most one token are dropped before the ``http:`` tokens are
    removed, so a sentence of two ``http:`` tokens survives as an empty string.
    """
    toks = F.transform(sentences(c), lambda s: tokens(s))
    kept = F.filter(toks, lambda t: F.size(t) > 1)
    return F.transform(kept, lambda t: F.array_join(clean_sentence_tokens(t), " "))


def cut_references(c: Column) -> Column:
    """Text before the first ``" 1: "``."""
    return F.substring_index(c, REFERENCE_MARKER, 1)


def charset_of(content_type: Column) -> Column:
    """Charset parameter of a content type, default UTF-8."""
    cs = F.regexp_extract(content_type, CHARSET_PATTERN, 1)
    return F.coalesce(F.nullif(cs, F.lit("")), F.lit(DEFAULT_CHARSET))
