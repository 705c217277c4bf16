"""Run-log analysis: A12, A13, W6, W7, W8 (FIXTURES.md run-log cases)."""

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import runlog as RL


def checks(spark, losses, run=1):
    rows = [(run, 1, (i + 1) * 5, float(x)) for i, x in enumerate(losses)]
    return spark.createDataFrame(rows, "run long, epoch long, check_batch long, update_loss double")


def test_new_minimum_and_stop(spark):
    out = RL.early_stop(checks(spark, [5, 4, 4, 6, 7, 8, 1]), 3).orderBy("check_batch").collect()
    assert [r.is_min for r in out] == [True, True, True, False, False, False]
    assert [r.stop_count for r in out] == [0, 0, 0, 1, 2, 3]


def test_never_always_one(spark):
    never = RL.early_stop(checks(spark, [1, 2, 3, 4, 5]), 3).collect()
    assert len(never) == 4
    always = RL.early_stop(checks(spark, [5, 4, 3, 2, 1]), 3).collect()
    assert len(always) == 5 and all(r.is_min for r in always)
    assert len(RL.early_stop(checks(spark, [3]), 3).collect()) == 1


def test_update_checks_and_refusal(spark):
    log = spark.createDataFrame([(1, 1, b, float(b)) for b in range(12)], "run long, epoch long, batch long, loss double")
    got = [(r.check_batch, r.update_loss) for r in RL.update_checks(log, 5).orderBy("check_batch").collect()]
    # batches 0..5 go to the first check, 6..10 to the second; 11 is an incomplete group
    assert got == [(5, 15.0), (10, 40.0)]
    with pytest.raises(ValueError):
        RL.update_checks(log, 0)


def test_batch_and_step_means(spark):
    log = spark.createDataFrame([(1, 1, b, 1.0) for b in range(6)], "run long, epoch long, batch long, loss double")
    got = [(r.report_batch, r.avg_loss) for r in RL.batch_means(log, 2).orderBy("report_batch").collect()]
    assert got == [(2, 1.5), (4, 1.0)]   # batches 0,1,2 summed and divided by 2; batch 5 incomplete
    steps = log.select("run", F.col("batch").alias("step"), "loss")
    got = [(r.report_step, r.avg_loss) for r in RL.step_means(steps, 2).orderBy("report_step").collect()]
    assert got == [(0, 1.0), (2, 1.0), (4, 1.0)]


def test_lr_schedule(spark):
    e = spark.createDataFrame([(1,), (2,), (200,)], "epoch long")
    got = {r.epoch: r.lr for r in RL.lr_schedule(e).collect()}
    assert got[1] == 0.01 and abs(got[2] - 0.0095) < 1e-12 and got[200] == 0.0001
