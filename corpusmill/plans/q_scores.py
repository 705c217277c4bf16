"""Summary scores: M1 (ROUGE-N), M2 (corpus BLEU-4), on document lead line vs the rest."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.text import ws_tokens
from corpusmill.operators import scores as SC
from corpusmill.plans import bindings as B
from corpusmill.plans import sqlparts as S
from corpusmill.plans.registry import query


def _sides(spark, sf):
    p = B.pairs(spark, sf)
    return p.select("pair_id", ws_tokens(F.lower(F.col("summary"))).alias("cand"),
                    ws_tokens(F.col("text")).alias("ref"))


def _ngram_sql(col: str, n: int) -> str:
    return f"list_transform(range(0, greatest(len({col}) - {n} + 1, 0)), lambda i: array_to_string({col}[i + 1:i + {n}], ' '))"


def _clip_sql(n: int) -> str:
    return f"""c{n} AS (SELECT pair_id, g, count(*) AS cc FROM (SELECT pair_id, unnest({_ngram_sql('cand', n)}) AS g FROM sides) GROUP BY ALL),
r{n} AS (SELECT pair_id, g, count(*) AS rc FROM (SELECT pair_id, unnest({_ngram_sql('ref', n)}) AS g FROM sides) GROUP BY ALL),
o{n} AS (SELECT c.pair_id, sum(least(cc, rc)) AS overlap FROM c{n} c JOIN r{n} r ON c.pair_id = r.pair_id AND c.g = r.g GROUP BY c.pair_id),
t{n} AS (SELECT s.pair_id, coalesce(o.overlap, 0)::BIGINT AS overlap, greatest(len(cand) - {n} + 1, 0) AS ct,
               greatest(len(ref) - {n} + 1, 0) AS rt FROM sides s LEFT JOIN o{n} o ON o.pair_id = s.pair_id)"""


SIDES_SQL = f"""{S.PAIRS},
sides AS (SELECT pair_id, {S.ws('lower(summary)')} AS cand, {S.ws('text')} AS ref FROM pairs)"""


def _rouge_sql(n: int) -> str:
    return f"""WITH {SIDES_SQL}, {_clip_sql(n)},
pr AS (SELECT pair_id, overlap, CASE WHEN rt > 0 THEN overlap / rt ELSE 0.0 END AS recall,
              CASE WHEN ct > 0 THEN overlap / ct ELSE 0.0 END AS precision FROM t{n})
SELECT pair_id, overlap, round(recall, 6) AS recall, round(precision, 6) AS precision,
       round(CASE WHEN recall + precision > 0 THEN 2 * recall * precision / (recall + precision) ELSE 0.0 END, 6) AS f1
FROM pr"""


def _rouge(spark, sf, n):
    r = SC.rouge_n(_sides(spark, sf), "pair_id", "cand", "ref", n)
    return r.select("pair_id", "overlap", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "f1")])


@query("rouge1", _rouge_sql(1))
def rouge1(spark, sf):
    """M1: ROUGE-1 recall, precision, F1 of the lower-cased lead line against the rest."""
    return _rouge(spark, sf, 1)


@query("rouge2", _rouge_sql(2))
def rouge2(spark, sf):
    """M1: ROUGE-2 (clipped bigram overlap) of the lower-cased lead line against the rest."""
    return _rouge(spark, sf, 2)


@query("bleu4", f"""WITH {SIDES_SQL}, {', '.join(_clip_sql(n) for n in (1, 2, 3, 4))},
p AS ({' UNION ALL '.join(f'SELECT {n} AS n, sum(overlap) AS o, sum(ct) AS c FROM t{n}' for n in (1, 2, 3, 4))}),
l AS (SELECT sum(len(cand))::BIGINT AS cand_len, sum(len(ref))::BIGINT AS ref_len FROM sides),
agg AS (SELECT sum(CASE WHEN o > 0 AND c > 0 THEN ln(o / c) END) AS logsum,
               min(CASE WHEN c > 0 THEN o ELSE 0 END) AS min_o FROM p)
SELECT cand_len, ref_len,
       round(CASE WHEN cand_len > ref_len THEN 1.0 ELSE exp(1 - ref_len / cand_len) END, 6) AS bp,
       round(CASE WHEN min_o > 0 THEN (CASE WHEN cand_len > ref_len THEN 1.0 ELSE exp(1 - ref_len / cand_len) END)
                                       * exp(logsum / 4) ELSE 0.0 END, 6) AS bleu
FROM l, agg""")
def bleu4(spark, sf):
    """M2: corpus BLEU-4 of the lower-cased lead lines against the rest of each document."""
    b = SC.corpus_bleu(_sides(spark, sf), "pair_id", "cand", "ref", 4)
    return b.select("cand_len", "ref_len", F.round("bp", 6).alias("bp"), F.round("bleu", 6).alias("bleu"))
