"""Training-log analysis (A12-A14, W6-W8) on a metrics table ``(run, epoch, batch, loss)``.

The reference keeps these numbers in Python loops while training; here they are
group keys and running aggregates over the logged losses.  Running aggregates work
in two levels, so one long run does not fill a task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.ranking import global_row_number


def step_means(log: DataFrame, every: int, step_col: str = "step") -> DataFrame:
    """A12 (word-vector form): ``(run, report_step, avg_loss)``.

    Step 0 is reported alone; then steps ``1..N``, ``N+1..2N`` are averaged by
    ``N``.  A group is reported only when its last step was logged.
    """
    key = F.ceil(F.col(step_col) / every).cast("long")
    g = log.groupBy("run", key.alias("g")).agg(F.sum("loss").alias("s"), F.max(step_col).alias("last"))
    g = g.filter(F.col("last") == F.col("g") * every)
    return g.select("run", (F.col("g") * every).alias("report_step"),
                    F.when(F.col("g") == 0, F.col("s")).otherwise(F.col("s") / every).alias("avg_loss"))


def batch_means(log: DataFrame, display_step: int = 2) -> DataFrame:
    """A12 (batch form): ``(run, epoch, report_batch, avg_loss)`` per epoch.

    Reported at batches ``k * display_step`` (k >= 1) with the sum since the
    last report divided by ``display_step``; batch 0 falls into the first report.
    """
    key = F.greatest(F.lit(1), F.ceil(F.col("batch") / display_step)).cast("long")
    g = log.groupBy("run", "epoch", key.alias("g")).agg(F.sum("loss").alias("s"), F.max("batch").alias("last"))
    g = g.filter(F.col("last") == F.col("g") * display_step)
    return g.select("run", "epoch", (F.col("g") * display_step).alias("report_batch"),
                    (F.col("s") / display_step).alias("avg_loss"))


def update_checks(log: DataFrame, update_check: int) -> DataFrame:
    """``(run, epoch, check_batch, update_loss)`` - summed loss per update check.

    ``update_check <= 0`` is refused (a division by zero in the reference).
    """
    if update_check <= 0:
        raise ValueError("update_check must be positive")
    key = F.greatest(F.lit(1), F.ceil(F.col("batch") / update_check)).cast("long")
    g = log.groupBy("run", "epoch", key.alias("g")).agg(F.sum("loss").alias("update_loss"),
                                                       F.max("batch").alias("last"))
    g = g.filter(F.col("last") == F.col("g") * update_check)
    return g.select("run", "epoch", (F.col("g") * update_check).alias("check_batch"), "update_loss")


CHUNK = 1024  # checks of a run that one task goes through


_PART = ["run", "__chunk"]


def _running(rows: DataFrame, value: Column, agg: Callable[[Column], Column], name: str) -> DataFrame:
    """Running aggregate ``name`` of ``value`` along ``rn`` within a run, in two levels: per chunk of ``CHUNK`` rows, then over
    the chunks' totals, so a run with a third of all rows spreads over many tasks.  Rows move once, to their chunk; after that only the totals do."""
    inside = Window.partitionBy(*_PART).orderBy("rn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("run").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__v", value)
    carry = rows.groupBy(*_PART).agg(agg(F.col("__v")).alias("__c")).select(*_PART, agg(F.col("__c")).over(earlier).alias("__carry"))
    both = F.least if agg is F.min else F.greatest
    return (rows.withColumn("__own", agg(F.col("__v")).over(inside)).join(carry, _PART)
            .withColumn(name, both("__own", "__carry")).drop("__v", "__own", "__carry"))  # nulls are skipped


def new_minimum(checks: DataFrame) -> DataFrame:
    """``is_min`` - the update loss is <= every earlier one of the run (itself included)."""
    return _flagged(checks).drop("rn", "__chunk")


def _flagged(checks: DataFrame) -> DataFrame:
    rows = global_row_number(checks, [F.col("epoch"), F.col("check_batch")], "rn", partition_by=["run"])
    rows = rows.withColumn("__chunk", F.floor(F.col("rn") / CHUNK))
    rows = _running(rows, F.col("update_loss"), F.min, "__low")
    return rows.withColumn("is_min", F.col("update_loss") <= F.col("__low")).drop("__low")


def early_stop(checks: DataFrame, patience: int = 3) -> DataFrame:
    """Keep checks up to the one where ``patience`` checks in a row brought no new minimum.

    ``stop_count`` is the distance to the last new minimum, a running maximum of its row number; the
    smallest row number per run whose count reaches ``patience`` is the last one kept.
    """
    rows = _running(_flagged(checks), F.when(F.col("is_min"), F.col("rn")), F.max, "__last")
    rows = rows.withColumn("stop_count", (F.col("rn") - F.coalesce("__last", F.lit(-1))).cast("int")).drop("__last")
    stops = rows.where(F.col("stop_count") >= patience).groupBy("run").agg(F.min("rn").alias("__stop"))
    return (rows.join(stops, "run", "left").where(F.col("__stop").isNull() | (F.col("rn") <= F.col("__stop")))
            .drop("__stop", "rn", "__chunk"))


def lr_schedule(epochs: DataFrame, lr0: float = 0.01, decay: float = 0.95, floor: float = 0.0001) -> DataFrame:
    """Learning rate of each epoch: ``max(lr0 * decay^(epoch-1), floor)``."""
    return epochs.withColumn("lr", F.greatest(F.lit(lr0) * F.pow(F.lit(decay), F.col("epoch") - 1), F.lit(floor)))


def epoch_eval_mean(log: DataFrame) -> DataFrame:
    """Mean evaluation loss per (run, epoch)."""
    return log.groupBy("run", "epoch").agg(F.avg("loss").alias("eval_loss"))


def masked_mean(seqs: DataFrame, losses_col: str = "losses", len_col: str = "len") -> DataFrame:
    """``sum(mask * loss) / sum(mask)`` over all sequences, mask = position < length."""
    kept = F.slice(F.col(losses_col), 1, F.col(len_col))
    total = F.aggregate(kept, F.lit(0.0).cast("double"), lambda a, x: a + x)
    return seqs.agg((F.sum(total) / F.sum(F.size(kept))).alias("masked_loss"),
                    F.sum(F.size(kept)).cast("long").alias("mask_sum"))
