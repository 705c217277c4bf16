"""Previews, samples and splits: T3-T8."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import sampling as M
from corpusmill.operators import sequences as Q
from corpusmill.plans import bindings as B
from corpusmill.plans import sqlparts as S
from corpusmill.plans.q_sequences import BATCH, example_lengths, kept_examples
from corpusmill.plans.q_vocab import W1_SIZE, _frequency_vocab
from corpusmill.plans.registry import query
from corpusmill.session import cut_lineage

SEED = 42
VALID_WINDOW, VALID_SIZE = 100, 16  # word-vector pipeline: 16 of the first 100 ids
HOLDOUT = 30                        # pipeline v2 batch size


@query("preview_pairs", f"""WITH {S.PAIRS}
SELECT pair_id, summary FROM pairs ORDER BY pair_id LIMIT 5""")
def preview_pairs(spark, sf):
    """First five pairs."""
    return M.preview(B.pairs(spark, sf).select("pair_id", "summary"), ["pair_id"], 5)


@query("pair_at_position", f"""WITH {S.PAIRS}
SELECT pair_id, text, summary FROM pairs WHERE pair_id = 1""")
def pair_at_position(spark, sf):
    """One row by position."""
    return B.pairs(spark, sf).filter(F.col("pair_id") == 1)


@query("sample_ids", f"""WITH {S.freq_vocab(W1_SIZE - 1)}
SELECT id, word FROM fv WHERE id < {VALID_WINDOW}
ORDER BY md5('{SEED}:' || id::VARCHAR), id LIMIT {VALID_SIZE}""")
def sample_ids(spark, sf):
    """T4: 16 of the first 100 frequency-vocabulary ids, without replacement."""
    fv = _frequency_vocab(spark, sf, W1_SIZE)
    return M.sample_ids(fv, "id", VALID_WINDOW, VALID_SIZE, SEED).select("id", "word")


@query("random_pair", f"""WITH {S.PAIRS}
SELECT pair_id, summary FROM pairs ORDER BY md5('{SEED}:' || pair_id::VARCHAR), pair_id LIMIT 1""")
def random_pair(spark, sf):
    """T5: one random pair."""
    return M.pick_one(B.pairs(spark, sf).select("pair_id", "summary"), "pair_id", SEED)


@query("random_batch", f"""WITH {S.SEQ},
pick AS (SELECT batch_id FROM (SELECT DISTINCT batch_id FROM batched)
         ORDER BY md5('{SEED}:' || batch_id::VARCHAR), batch_id LIMIT 1)
SELECT b.batch_id, b.slot, b.pair_id FROM batched b JOIN pick USING (batch_id)""")
def random_batch(spark, sf):
    """T5: one random full batch (the pick never falls past the last batch)."""
    kept, _ = kept_examples(spark, sf)
    b = cut_lineage(Q.assign_batches(example_lengths(kept), [F.col("len"), F.col("pair_id")], BATCH).select("batch_id", "slot", "pair_id"))
    pick = M.pick_one(b.select("batch_id").distinct(), "batch_id", SEED)
    return b.join(F.broadcast(pick), "batch_id")


@query("split_parts", f"""WITH {S.PAIRS}
SELECT * FROM {S.exact_split_sql('pairs', 'pair_id', f"'{SEED}'", 0.2, 0.5)}""")
def split_parts(spark, sf):
    """80/10/10 exact split (train, then test and eval halves of the held-out fifth)."""
    return M.exact_split(B.pairs(spark, sf), "pair_id", SEED, 0.2, 0.5)


@query("split_parts_60_20_20", f"""WITH {S.PAIRS}
SELECT * FROM {S.exact_split_sql('pairs', 'pair_id', f"'{SEED}'", 0.4, 0.5)}""")
def split_parts_60_20_20(spark, sf):
    """60/20/20 exact split (pipeline v1)."""
    return M.exact_split(B.pairs(spark, sf), "pair_id", SEED, 0.4, 0.5)


@query("split_per_epoch", f"""WITH {S.PAIRS}
SELECT 1::BIGINT AS epoch, * FROM {S.exact_split_sql('pairs', 'pair_id', "'1'", 0.2, 0.5)}
UNION ALL SELECT 2, * FROM {S.exact_split_sql('pairs', 'pair_id', "'2'", 0.2, 0.5)}
UNION ALL SELECT 3, * FROM {S.exact_split_sql('pairs', 'pair_id', "'3'", 0.2, 0.5)}""")
def split_per_epoch(spark, sf):
    """A new split each epoch (seed = epoch), epochs 1-3."""
    p = B.pairs(spark, sf)
    out = None
    for epoch in (1, 2, 3):
        s = M.exact_split(p, "pair_id", epoch, 0.2, 0.5).select(F.lit(epoch).cast("long").alias("epoch"), "*")
        out = s if out is None else out.unionByName(s)
    return out


@query("holdout_first_batch", f"""WITH {S.PAIRS}
SELECT pair_id, CASE WHEN row_number() OVER (ORDER BY pair_id) <= {HOLDOUT} THEN 'valid' ELSE 'train' END AS part
FROM pairs""")
def holdout_first_batch(spark, sf):
    """The first batch (30 rows in pair order) held out for validation."""
    return M.holdout_first(B.pairs(spark, sf), "pair_id", HOLDOUT)


_CUT_A = 1.0 - 0.2
_CUT_B = _CUT_A + 0.2 * (1.0 - 0.5)


@query("threshold_split_sizes", f"""WITH {S.PAIRS},
u AS (SELECT pair_id, ((('0x' || substr(md5('{SEED}:' || pair_id::VARCHAR), 1, 8))::UBIGINT)::DOUBLE / 4294967296.0) AS u
      FROM pairs)
SELECT CASE WHEN u < {_CUT_A!r} THEN 'train' WHEN u < {_CUT_B!r} THEN 'test' ELSE 'eval' END AS part,
       count(*)::BIGINT AS count
FROM u GROUP BY ALL""")
def threshold_split_sizes(spark, sf):
    """T6, threshold form for very large tables: part sizes from a hash threshold (no sort)."""
    return M.threshold_split(B.pairs(spark, sf), "pair_id", SEED).groupBy("part").agg(
        F.count(F.lit(1)).cast("long").alias("count"))
