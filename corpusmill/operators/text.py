"""Pair and corpus projections (P1, P2) and token tables (F2 + explode).

Claims carry their argument sentences either as a map ``sentence id -> text``
(the JSON form) or as an already ordered array.  Map entries are ordered by the
integer after the last ``_`` of the sentence id, never by map order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import ws_tokens


def ordered_sentences(sentence_map: Column) -> Column:
    """Values of a ``map<id, sentence>`` ordered by the number after the last ``_``."""
    entries = F.transform(
        F.map_entries(sentence_map),
        lambda e: F.struct(F.substring_index(e["key"], "_", -1).cast("long").alias("n"),
                           e["value"].alias("v")))
    return F.transform(F.array_sort(entries), lambda e: e["v"])


def make_pairs(claims: DataFrame, id_col: str = "pair_id", sentences_col: str = "sentences",
               claim_col: str = "claim", sep: str = "") -> DataFrame:
    """``text`` = ``' '`` + lower-cased sentences joined by ``sep``; ``summary`` = claim.

    ``sep=''`` is the reference's behaviour (the last word of a sentence fuses
    with the first of the next); ``sep=' '`` keeps words apart.  A missing
    sentence list gives the text ``' '``.
    """
    sents = F.coalesce(F.col(sentences_col), F.array().cast("array<string>"))
    return claims.select(
        F.col(id_col).alias("pair_id"),
        F.concat(F.lit(" "), F.lower(F.array_join(sents, sep))).alias("text"),
        F.col(claim_col).alias("summary"))


def corpus_tokens(claims: DataFrame, id_col: str = "pair_id", sentences_col: str = "sentences",
                  fuse: bool = False) -> DataFrame:
    """Word stream of all argument sentences, case kept.

    Rows ``(doc, pos, word)``; ``(doc, pos)`` is the stream order.  ``fuse=True``
    joins the sentences of a claim with no separator, as the reference's string
    concatenation does.
    """
    sents = F.coalesce(F.col(sentences_col), F.array().cast("array<string>"))
    joined = F.array_join(sents, "" if fuse else " ")
    return claims.select(F.col(id_col).cast("long").alias("doc"),
                         F.posexplode(ws_tokens(joined)).alias("pos", "word"))


def token_rows(df: DataFrame, id_col: str, text_col: str, src: int = 0) -> DataFrame:
    """Whitespace tokens of ``text_col`` as rows ``(src, doc, pos, word)``."""
    return df.select(F.lit(src).cast("int").alias("src"), F.col(id_col).cast("long").alias("doc"),
                     F.posexplode(ws_tokens(F.col(text_col))).alias("pos", "word"))


def pair_tokens(pairs: DataFrame) -> DataFrame:
    """Text tokens (src 0) then summary tokens (src 1) as one bag."""
    return token_rows(pairs, "pair_id", "text", 0).unionByName(
        token_rows(pairs, "pair_id", "summary", 1))


def pair_streams(pairs: DataFrame) -> tuple[DataFrame, str, list[tuple[int, Column]]]:
    """U1 as ``word_stats`` arguments: texts (src 0) then summaries (src 1) of one scan."""
    return pairs, "pair_id", [(0, F.col("text")), (1, F.col("summary"))]


def corpus_arrays(claims: DataFrame, id_col: str = "pair_id", sentences_col: str = "sentences",
                  fuse: bool = False) -> DataFrame:
    """P2 as ``(doc, toks)``: the word stream of each claim's argument sentences, case kept."""
    sents = F.coalesce(F.col(sentences_col), F.array().cast("array<string>"))
    return claims.select(F.col(id_col).cast("long").alias("doc"),
                         ws_tokens(F.array_join(sents, "" if fuse else " ")).alias("toks"))
