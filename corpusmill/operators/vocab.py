"""Word counts and vocabularies.

A vocabulary is one table ``(id, word)`` (plus ``cnt`` where it exists) used in
both directions: word -> id (J4) and id -> word (J7).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from corpusmill.functions.text import pct4, ws_tokens
from corpusmill.operators.buckets import bucketed, items_of, looked_up
from corpusmill.operators.ranking import global_row_number, one_row
from corpusmill.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

# --- fixed values -----------------------------------------------------------
# Special tokens of the first-seen vocabulary, appended in this order.
SPECIALS_FIRST_SEEN = ["<UNK>", "<PAD>", "<EOS>", "<GO>"]
# Dictionary vocabulary: <PAD> = 0 before the words, <GO> and <EOS> after them,
# with constant vectors 0, 1 and 2.
PAD, GO, EOS = "<PAD>", "<GO>", "<EOS>"
# Frequency vocabulary: id 0 is this token.
FREQ_UNK = "UNK"
# ---------------------------------------------------------------------------

# Token sources in stream order: 0 = texts, 1 = summaries.
SOURCES = (0, 1)


SLICE_TOKENS = 1 << 20  # tokens that a task counts at a time


def _doc_slices(docs: pa.Array, column: pa.Array) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """Documents, tokens (of lists, or the words of texts) and the row of each, some ``SLICE_TOKENS`` at a time."""
    size = pc.list_value_length(column) if pa.types.is_list(column.type) else pc.divide(pc.binary_length(column), 6)
    part = np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64)) // SLICE_TOKENS
    cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(column)] if len(column) else [0]
    for a, b in zip(cuts, cuts[1:]):
        tokens, lengths = items_of(pa.chunked_array([column[a:b]]))
        yield docs[a:b], tokens, np.repeat(np.arange(b - a), lengths)


def _partial_stats(sources: list[int]):
    def count(src: int, docs: pa.Array, tokens: pa.Array, row: np.ndarray) -> pa.RecordBatch:
        coded = tokens.dictionary_encode()
        words, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        firsts = np.sort(np.unique(row * max(len(words), 1) + codes, return_index=True)[1])  # of each word in each document
        r, c = row[firsts], codes[firsts]
        k = np.arange(len(firsts)) - np.searchsorted(r, r)
        rank = pc.rank(docs, null_placement="at_end").to_numpy().astype(np.int64)[r]
        order = np.argsort(-rank, kind="stable")
        order = order[~docs.is_null().to_numpy(zero_copy_only=False)[r[order]]]
        best = np.full(len(words), -1)
        best[c[order]] = order  # the smallest document comes last
        lost = best < 0
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(len(words), src, dtype=np.int32)), words, pa.array(np.bincount(codes, minlength=len(words))),
            docs.take(pa.array(r[best] if len(r) else best, mask=lost)), pa.array((k[best] if len(k) else best).astype(np.int32), mask=lost)],
            ["src", "word", "n", "doc", "k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, src in enumerate(sources):
                for docs, tokens, row in _doc_slices(batch.column(0), batch.column(i + 1)):
                    yield count(src, docs, tokens, row)
    return run


def word_stats(df: DataFrame, doc_col: str, token_cols: list[tuple[int, Column]]) -> DataFrame:
    """A1 + U1 on token arrays: ``(word, cnt, cnt0, cnt1, first)``, ``cnt0`` and ``cnt1`` per source.

    ``token_cols`` are ``(src, column)`` of ``df`` with ``src`` in ``SOURCES``; a column holds
    tokens (array<string>), or texts whose words (``ws_tokens``) are the tokens.  ``first = (src, doc, k)`` orders words by first appearance:
    ``k`` is the word's index among the document's distinct words of that source, in
    first-occurrence order.  Each task counts its tokens some million at a time, one row per word, source and
    slice with the smallest document there; one shuffle with hash aggregates adds them up
    (``min(doc)`` and ``min_by(k, doc)`` per source).
    """
    for src, _ in token_cols:
        if src not in SOURCES:
            raise ValueError(f"source {src} not in {SOURCES}")
    sources = df.select(F.col(doc_col).alias("doc"), *[c.alias(f"t{i}") for i, (_, c) in enumerate(token_cols)])
    schema = StructType([StructField("src", IntegerType()), StructField("word", StringType()), StructField("n", LongType()),
                         StructField("doc", sources.schema["doc"].dataType), StructField("k", IntegerType())])
    u = sources.mapInArrow(_partial_stats([src for src, _ in token_cols]), schema)
    aggs = [F.sum("n").alias("cnt")]
    for s in SOURCES:
        d = F.when(F.col("src") == s, F.col("doc"))
        aggs += [F.sum(F.when(F.col("src") == s, F.col("n")).otherwise(0)).alias(f"cnt{s}"),
                 F.min(d).alias(f"d{s}"), F.min_by(F.when(F.col("src") == s, F.col("k")), d).alias(f"k{s}")]
    b = u.groupBy("word").agg(*aggs)
    first = None
    for s in reversed(SOURCES):
        here = F.struct(F.lit(s).alias("src"), F.col(f"d{s}").alias("doc"), F.col(f"k{s}").alias("pos"))
        first = here if first is None else F.when(F.col(f"d{s}").isNotNull(), here).otherwise(first)
    return b.select("word", "cnt", *[f"cnt{s}" for s in SOURCES], first.alias("first"))


def distinct_words(tokens: DataFrame) -> DataFrame:
    """A2: vocabulary size."""
    return tokens.agg(F.countDistinct("word").cast("long").alias("n_words"))


def with_dictionary_flag(counts: DataFrame, dict_words: DataFrame) -> DataFrame:
    """Add ``has_vec`` (word present in the vector dictionary)."""
    d = dict_words.select("word").distinct().withColumn("has_vec", F.lit(True))
    return (counts.join(d, "word", "left")
            .withColumn("has_vec", F.coalesce(F.col("has_vec"), F.lit(False))))


def missing_words(counts_flagged: DataFrame, threshold: int = 2) -> DataFrame:
    """A3: words with ``cnt > threshold`` and no vector; percent of all words."""
    return counts_flagged.agg(
        F.sum(F.when((F.col("cnt") > threshold) & ~F.col("has_vec"), 1).otherwise(0))
        .cast("long").alias("missing_words"),
        F.count(F.lit(1)).cast("long").alias("n_words"),
    ).withColumn("missing_pct", pct4(F.col("missing_words") / F.col("n_words")))


def vocab_predicate(threshold: int = 2) -> Column:
    """P10: keep a word seen at least ``threshold`` times or having a vector."""
    return (F.col("cnt") >= threshold) | F.col("has_vec")


def first_seen_vocab(counts_flagged: DataFrame, threshold: int = 2) -> DataFrame:
    """W2 + U3: ids in first-appearance order after P10, then the four specials.

    The rank is a distributed global row number (no single-partition window);
    the specials take ids ``n .. n+3`` from a one-row count.  A text word equal
    to a special is the special, as where a dictionary key is set again: words
    and ids stay unique.
    """
    kept = counts_flagged.filter(vocab_predicate(threshold) & ~F.col("word").isin(SPECIALS_FIRST_SEEN)).select("word", "cnt", "first")
    ranked = global_row_number(kept, [F.col("first")], "id").select(
        "id", "word", F.col("cnt").cast("long").alias("cnt"))
    n = ranked.agg(F.count(F.lit(1)).cast("long").alias("n"))
    specials = n.select(F.posexplode(F.array(*[F.lit(s) for s in SPECIALS_FIRST_SEEN]))
                        .alias("k", "word"), "n").select(
        (F.col("n") + F.col("k")).cast("long").alias("id"), "word",
        F.lit(None).cast("long").alias("cnt"))
    return ranked.unionByName(specials)


def unknown_tokens(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """A5 from word counts: ``word_count, unk_count, unk_pct``; unknown are the tokens of words outside
    ``vocab`` and those that read like its <UNK>."""
    known = vocab.filter(F.col("word") != SPECIALS_FIRST_SEEN[0]).select("word", F.lit(True).alias("known"))
    return counts.join(known, "word", "left").agg(
        F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("word_count"),
        F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("cnt"))), F.lit(0)).cast("long").alias("unk_count")).withColumn(
        "unk_pct", pct4(F.col("unk_count") / F.col("word_count")))


def usage_ratio(vocab: DataFrame, counts: DataFrame) -> DataFrame:
    """A4: vocabulary size (with specials) over distinct words, percent."""
    v = vocab.agg(F.count(F.lit(1)).cast("long").alias("vocab_size"))
    c = counts.agg(F.count(F.lit(1)).cast("long").alias("n_words"))
    return one_row(v, c).withColumn("usage_pct", pct4(F.col("vocab_size") / F.col("n_words")))


def frequency_vocab(counts: DataFrame, size: int) -> DataFrame:
    """W1 + A7: ``UNK`` = 0 then the ``size - 1`` most common words of ``counts``
    (``word, cnt, first``).

    Ties go to the word seen first.  Words that are too rare are cut by the counts alone (how many words
    have each count), and only the others are ranked, over all tasks.  Row 0 carries the number of tokens outside the
    vocabulary, tokens that read ``UNK`` among them.
    """
    counts = cut_lineage(counts.select("word", "cnt", "first"))
    words = counts.filter(F.col("word") != FREQ_UNK)
    with_count = words.groupBy("cnt").agg(F.count(F.lit(1)).alias("n"))  # one row per count: its number grows as the root of the tokens
    ahead = F.sum("n").over(Window.orderBy(F.col("cnt").desc()).rowsBetween(Window.unboundedPreceding, -1))
    least = with_count.select("cnt", F.coalesce(ahead, F.lit(0)).alias("ahead")).where(F.col("ahead") < size - 1).agg(F.min("cnt")).first()[0]
    ranked = frequency_ranks(words.where(F.col("cnt") >= (least or 0))).filter(F.col("id") < size)
    total = counts.agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("total"))
    kept = ranked.agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("kept"))
    unk = one_row(total, kept).select(
        F.lit(0).cast("long").alias("id"), F.lit(FREQ_UNK).alias("word"),
        (F.col("total") - F.col("kept")).cast("long").alias("cnt"))
    return unk.unionByName(ranked)


def frequency_ranks(counts: DataFrame, cnt: str = "cnt") -> DataFrame:
    """``(id, word, cnt)``: words by falling ``cnt``, then first appearance; ids from 1."""
    return global_row_number(counts.select("word", F.col(cnt).cast("long").alias("cnt"), "first"),
                             [F.col("cnt").desc(), F.col("first")], "id", start=1).select("id", "word", "cnt")


def dictionary_vocab(dictionary: DataFrame) -> DataFrame:
    """``<PAD>`` = 0, dictionary words 1..N in file order, ``<GO>`` = N+1, ``<EOS>`` = N+2.

    ``dictionary`` is ``(pos, word, vec)``; special vectors are all 0, 1 and 2.
    Dictionary words equal to a special give way to it.
    """
    words = dictionary.filter(~F.col("word").isin(PAD, GO, EOS))
    ids = global_row_number(words.select("pos"), [F.col("pos")], "id", start=1)
    ranked = words.join(ids, "pos").select("id", "word", "vec")
    stats = ranked.agg(F.count(F.lit(1)).cast("long").alias("n"),
                       F.max(F.size("vec")).alias("dim"))
    fill = lambda v: F.array_repeat(F.lit(float(v)).cast("float"), F.col("dim"))
    specials = stats.select(F.explode(F.array(
        F.struct(F.lit(0).cast("long").alias("id"), F.lit(PAD).alias("word"), fill(0).alias("vec")),
        F.struct((F.col("n") + 1).cast("long").alias("id"), F.lit(GO).alias("word"), fill(1).alias("vec")),
        F.struct((F.col("n") + 2).cast("long").alias("id"), F.lit(EOS).alias("word"), fill(2).alias("vec")),
    )).alias("s")).select("s.*")
    return specials.unionByName(ranked)


def lookup_id(vocab: DataFrame, word: str) -> int:
    """Id of one word of a vocabulary (a single scalar read on the driver)."""
    row = vocab.filter(F.col("word") == word).select("id").first()
    if row is None:
        raise ValueError(f"{word!r} is not in the vocabulary")
    return int(row[0])


def encode_many(df: DataFrame, id_col: str, text_cols: list[str], vocab: DataFrame, unk_id: int,
                broadcast_vocab: bool | None = None, limits: dict[str, int] | None = None) -> DataFrame:
    """Q1 for several text columns at once: ``(id_col, <col>_ids ...)``.

    Whitespace tokens are mapped by J4 (unknown -> ``unk_id``), in order.  Texts are dealt by ``id_col`` into
    buckets, and the different words of a bucket are joined with the vocabulary (broadcast or not, by size if not
    said): neither tokens nor a vocabulary of any size travel once per token.  Empty texts give empty arrays.
    ``limits`` are the most tokens of a text column: ids of which a row has more give no row, as if filtered by the
    sizes of their arrays, and the texts of such rows are not shuffled.
    """
    v = vocab.select(F.col("word").alias("key"), F.col("id").cast("int").alias("value"))
    if broadcast_vocab:
        v = F.broadcast(v)
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in text_cols), F.lit(16))
    docs, over = df.select(id_col, *text_cols), None
    if limits:
        over = "__over"
        # n + 1 tokens take more than 2 n bytes, so short texts are not split.
        longer = [F.when(F.octet_length(c) > 2 * n, F.size(ws_tokens(F.col(c))) > n).otherwise(False) for c, n in limits.items()]
        docs = docs.withColumn(over, reduce(or_, longer)).withColumns({c: F.when(~F.col(over), F.col(c)) for c in text_cols})
    docs = bucketed(docs, id_col, size).withColumnsRenamed({c: f"{c}_ids" for c in text_cols})
    return looked_up(docs, id_col, [f"{c}_ids" for c in text_cols], v, IntegerType(), unk_id, over=over)


def encode_texts(df: DataFrame, id_col: str, text_col: str, vocab: DataFrame, unk_id: int,
                 broadcast_vocab: bool | None = None) -> DataFrame:
    """Q1: ``(id_col, ids array<int>)`` - whitespace tokens mapped by J4, in order."""
    return encode_many(df, id_col, [text_col], vocab, unk_id, broadcast_vocab).withColumnRenamed(
        f"{text_col}_ids", "ids")


def decode_many(df: DataFrame, id_col: str, ids_cols: list[str], vocab: DataFrame,
                sep: str = " ", broadcast_vocab: bool | None = None) -> DataFrame:
    """J7 for several id columns at once: ``(id_col, ids_cols)`` as texts, buckets as in ``encode_many``."""
    v = vocab.select(F.col("id").cast("int").alias("key"), F.col("word").alias("value"))
    if broadcast_vocab:
        v = F.broadcast(v)
    size = sum((F.coalesce(F.size(c), F.lit(0)).cast("long") * 8 for c in ids_cols), F.lit(16))
    ids = bucketed(df.select(id_col, *[F.col(c).cast("array<int>").alias(c) for c in ids_cols]), id_col, size)
    return looked_up(ids, id_col, ids_cols, v, StringType(), "", sep)


def decode_ids(df: DataFrame, id_col: str, ids_col: str, vocab: DataFrame,
               sep: str = " ", broadcast_vocab: bool | None = None) -> DataFrame:
    """``(id_col, text)`` - ids mapped back to words and joined in order.

    An id outside the vocabulary becomes an empty word.
    """
    return decode_many(df, id_col, [ids_col], vocab, sep, broadcast_vocab).withColumnRenamed(ids_col, "text")
