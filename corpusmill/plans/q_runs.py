"""Run-log queries: A12, A13, A14, W6, W7, W8."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import runlog as RL
from corpusmill.plans import bindings as B
from corpusmill.plans.registry import query

EVERY = 10          # A12 report interval on the stand-in log (the reference's is 2,000 steps)
DISPLAY_STEP = 2    # A12 batch form
UPDATE_CHECK = 5    # A13 on the stand-in epochs of 20 batches
PATIENCE = 3        # W7
SPE = B.STEPS_PER_EPOCH

LOG_SQL = f"""log AS (
  SELECT user_id::BIGINT AS run, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS step,
         value::DOUBLE AS loss FROM events),
tlog AS (SELECT run, step, (floor(step / {SPE}) + 1)::BIGINT AS epoch, (step % {SPE})::BIGINT AS batch, loss FROM log)"""

CHECKS_SQL = LOG_SQL + f""",
chk0 AS (SELECT run, epoch, greatest(1, ceil(batch / {UPDATE_CHECK}))::BIGINT AS g, sum(loss) AS update_loss, max(batch) AS last
         FROM tlog GROUP BY ALL),
checks AS (SELECT run, epoch, g * {UPDATE_CHECK} AS check_batch, update_loss FROM chk0 WHERE last = g * {UPDATE_CHECK}),
flags AS (SELECT *, update_loss <= min(update_loss) OVER (PARTITION BY run ORDER BY epoch, check_batch
                                                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS is_min FROM checks)"""


def _checks(spark, sf):
    return RL.update_checks(B.training_log(spark, sf), UPDATE_CHECK)


@query("loss_step_means", f"""WITH {LOG_SQL},
g AS (SELECT run, ceil(step / {EVERY})::BIGINT AS g, sum(loss) AS s, max(step) AS last FROM log GROUP BY ALL)
SELECT run, g * {EVERY} AS report_step, round(CASE WHEN g = 0 THEN s ELSE s / {EVERY} END, 6) AS avg_loss
FROM g WHERE last = g * {EVERY}""")
def loss_step_means(spark, sf):
    """Mean loss every N steps (step 0 alone, incomplete last group dropped)."""
    out = RL.step_means(B.run_log(spark, sf), EVERY)
    return out.withColumn("avg_loss", F.round("avg_loss", 6))


@query("loss_batch_means", f"""WITH {LOG_SQL},
g AS (SELECT run, epoch, greatest(1, ceil(batch / {DISPLAY_STEP}))::BIGINT AS g, sum(loss) AS s, max(batch) AS last
      FROM tlog GROUP BY ALL)
SELECT run, epoch, g * {DISPLAY_STEP} AS report_batch, round(s / {DISPLAY_STEP}, 6) AS avg_loss
FROM g WHERE last = g * {DISPLAY_STEP}""")
def loss_batch_means(spark, sf):
    """A12, batch form: summed loss since the last report / 2, reset each epoch."""
    out = RL.batch_means(B.training_log(spark, sf), DISPLAY_STEP)
    return out.withColumn("avg_loss", F.round("avg_loss", 6))


@query("update_checks", f"""WITH {CHECKS_SQL}
SELECT run, epoch, check_batch, round(update_loss, 6) AS update_loss FROM checks""")
def update_checks(spark, sf):
    """Summed loss per update check within each epoch."""
    return _checks(spark, sf).withColumn("update_loss", F.round("update_loss", 6))


@query("new_minimum", f"""WITH {CHECKS_SQL}
SELECT run, epoch, check_batch, is_min FROM flags""")
def new_minimum(spark, sf):
    """Update loss at a new minimum of its run."""
    return RL.new_minimum(_checks(spark, sf)).select("run", "epoch", "check_batch", "is_min")


@query("early_stop", f"""WITH {CHECKS_SQL},
isl AS (SELECT *, sum(CASE WHEN is_min THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY epoch, check_batch
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM flags),
cnt AS (SELECT *, (row_number() OVER (PARTITION BY run, island ORDER BY epoch, check_batch) - 1)::INTEGER AS stop_count FROM isl),
cut AS (SELECT *, coalesce(sum(CASE WHEN stop_count >= {PATIENCE} THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY epoch, check_batch
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cnt)
SELECT run, epoch, check_batch, is_min, stop_count FROM cut WHERE before = 0""")
def early_stop(spark, sf):
    """Update checks kept until 3 checks in a row bring no new minimum."""
    return RL.early_stop(_checks(spark, sf), PATIENCE).select("run", "epoch", "check_batch", "is_min", "stop_count")


@query("lr_schedule", f"""WITH {LOG_SQL}
SELECT DISTINCT epoch, round(greatest(0.01 * pow(0.95, epoch - 1), 0.0001), 10) AS lr FROM tlog""")
def lr_schedule(spark, sf):
    """Learning rate per epoch, x0.95 each epoch from 0.01, floor 0.0001."""
    e = B.training_log(spark, sf).select("epoch").distinct()
    return RL.lr_schedule(e).withColumn("lr", F.round("lr", 10))


@query("epoch_eval_loss", f"""WITH {LOG_SQL}
SELECT run, epoch, round(avg(loss), 6) AS eval_loss FROM tlog GROUP BY run, epoch""")
def epoch_eval_loss(spark, sf):
    """Mean evaluation loss per epoch."""
    return RL.epoch_eval_mean(B.training_log(spark, sf)).withColumn("eval_loss", F.round("eval_loss", 6))


@query("masked_loss", f"""WITH {LOG_SQL}
SELECT round(sum(loss) / count(*), 6) AS masked_loss, count(*)::BIGINT AS mask_sum FROM tlog""")
def masked_loss(spark, sf):
    """Masked mean of per-step losses; each (run, epoch) is a sequence padded to the epoch length."""
    t = B.training_log(spark, sf)
    seqs = t.groupBy("run", "epoch").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("batch", "loss"))), lambda s: s["loss"]).alias("l"))
    padded = seqs.select(F.slice(F.concat("l", F.array_repeat(F.lit(0.0), SPE)), 1, SPE).alias("losses"),
                         F.size("l").alias("len"))
    return RL.masked_mean(padded).withColumn("masked_loss", F.round("masked_loss", 6))
