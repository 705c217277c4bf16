"""Summary scores by their published definitions (M1 ROUGE-N, M2 corpus BLEU-4).

Each side is a token array per pair.  N-grams are counted per (pair, side,
gram) in buckets of whole pairs, and the candidate counts clipped by the reference
counts of the same gram there.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from corpusmill.operators.buckets import BUCKET, bucketed, flat, numbered

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package


def _gram_codes(words: np.ndarray, of: np.ndarray, tokens: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and code of every ``n``-gram of the rows ``of`` tokens; equal codes are equal texts, joined by one space."""
    at = np.flatnonzero(of[:len(of) - n + 1] == of[n - 1:]) if len(of) >= n else np.empty(0, dtype=np.int64)
    if len(at) and (tokens.null_count or pc.any(pc.match_substring(tokens, " ")).as_py()):  # words do not tell where one ends
        all_tokens = tokens.to_pylist()
        grams = pa.array([" ".join(t for t in all_tokens[i:i + n] if t is not None) for i in at], pa.string())
        return of[at], grams.dictionary_encode().indices.to_numpy().astype(np.int64)
    codes = words[at]
    for k in range(1, n):
        codes = np.unique(codes * (int(words.max()) + 1) + words[at + k], return_inverse=True)[1] if len(at) else codes
    return of[at], codes


def _counter(id_col: str, cand: str, ref: str, ns: list[int]):
    def count(rows: pa.Table) -> pa.Table:
        ids, group = numbered(rows[id_col])
        items, lengths = zip(*(flat(rows[c]) for c in (cand, ref)))
        tokens = pa.concat_arrays(items)
        words = tokens.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(2 * len(group)), np.concatenate(lengths))  # candidates, then references
        out = []
        for n in ns:
            of, codes = _gram_codes(words, row, tokens, n)
            owner, is_ref = group[of % len(group)] if len(of) else of, of >= len(group)
            width = int(codes.max()) + 1 if len(codes) else 1
            key = owner * width + codes
            c, cc = np.unique(key[~is_ref], return_counts=True)
            r, rc = np.unique(key[is_ref], return_counts=True)
            both, i, j = np.intersect1d(c, r, assume_unique=True, return_indices=True)
            clipped = np.bincount(both // width, np.minimum(cc[i], rc[j]), len(ids))
            totals = [np.bincount(owner[side], minlength=len(ids)) for side in (~is_ref, is_ref)]
            out.append(pa.table([ids, *(pa.array(x.astype(np.int64)) for x in (clipped, *totals)), pa.array(np.full(len(ids), n, dtype=np.int32))],
                                names=[id_col, "overlap", "cand_total", "ref_total", "n"]))
        return pa.concat_tables(out)
    return count


def clipped_counts(df: DataFrame, id_col: str, cand: str, ref: str, ns: list[int]) -> DataFrame:
    """Per (pair, n): clipped overlap and candidate / reference n-gram totals.

    Pairs are dealt by id into buckets, one shuffle of the texts for all orders, and a task counts the n-grams of a
    bucket as whole numbers, per (pair, side, gram).
    """
    df = df.select(id_col, cand, ref)
    size = sum((F.coalesce(F.size(c), F.lit(0)).cast("long") * 8 for c in (cand, ref)), F.lit(16))
    schema = StructType([StructField(id_col, df.schema[id_col].dataType), *[StructField(c, LongType()) for c in ("overlap", "cand_total", "ref_total")],
                         StructField("n", IntegerType())])
    return bucketed(df, id_col, size).groupBy(BUCKET).applyInArrow(_counter(id_col, cand, ref, ns), schema)


def rouge_n(df: DataFrame, id_col: str, cand: str, ref: str, n: int = 2) -> DataFrame:
    """M1: ``(id, recall, precision, f1)``; a side with no n-grams gives 0."""
    t = clipped_counts(df, id_col, cand, ref, [n])
    rec = F.when(F.col("ref_total") > 0, F.col("overlap") / F.col("ref_total")).otherwise(0.0)
    pre = F.when(F.col("cand_total") > 0, F.col("overlap") / F.col("cand_total")).otherwise(0.0)
    t = t.select(id_col, "overlap", rec.alias("recall"), pre.alias("precision"))
    f1 = F.when(F.col("recall") + F.col("precision") > 0,
                2 * F.col("recall") * F.col("precision") / (F.col("recall") + F.col("precision"))).otherwise(0.0)
    return t.withColumn("f1", f1)


def corpus_bleu(df: DataFrame, id_col: str, cand: str, ref: str, max_n: int = 4) -> DataFrame:
    """M2: corpus BLEU-``max_n``: clipped precisions summed over the corpus,
    geometric mean, brevity penalty ``exp(1 - r/c)`` when the candidates are shorter."""
    t = clipped_counts(df, id_col, cand, ref, list(range(1, max_n + 1)))
    p = t.groupBy("n").agg(F.sum("overlap").alias("o"), F.sum("cand_total").alias("c"), F.sum("ref_total").alias("r"))
    single = F.col("n") == 1  # as many 1-grams as tokens
    both = p.agg(
        F.max(F.when(single, F.col("c"))).alias("cand_len"), F.max(F.when(single, F.col("r"))).alias("ref_len"),
        F.sum(F.when((F.col("o") > 0) & (F.col("c") > 0), F.log(F.col("o") / F.col("c")))).alias("logsum"),
        F.min(F.when(F.col("c") > 0, F.col("o")).otherwise(0)).alias("min_o"))
    bp = F.when(F.col("cand_len") > F.col("ref_len"), F.lit(1.0)).otherwise(
        F.exp(1 - F.col("ref_len") / F.col("cand_len")))
    bleu = F.when(F.col("min_o") > 0, bp * F.exp(F.col("logsum") / max_n)).otherwise(0.0)
    return both.select("cand_len", "ref_len", bp.alias("bp"), bleu.alias("bleu"))
