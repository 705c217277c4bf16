"""Id-sequence preparation on ``array<int>`` columns.

Sequences stay one row per example; batches are rows ``(batch_id, slot, ...)``.
Per-batch windows are bounded by the batch size, and the global order that
defines batches is a distributed row number (``ranking.global_row_number``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.ranking import global_row_number
from corpusmill.session import cut_lineage


def append_eos(ids: Column, eos_id: int) -> Column:
    """Q2."""
    return F.array_append(ids, F.lit(eos_id).cast("int"))


def truncate(ids: Column, n: int) -> Column:
    """Q3: first ``n`` ids."""
    return F.slice(ids, 1, n)


def pad_to(ids: Column, n: Column | int, pad_id: int) -> Column:
    """Q4: cut or pad with ``pad_id`` to exactly ``n`` ids."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad_id).cast("int"), n)), 1, n)


def capped_len(ids: Column, n: int) -> Column:
    """Q6 (v1): true length capped at ``n``."""
    return F.least(F.size(ids), F.lit(n))


def decoder_input(ids: Column, go_id: int) -> Column:
    """Q7: ``<GO>`` then the ids without the last one."""
    keep = F.greatest(F.size(ids) - 1, F.lit(0))
    return F.concat(F.array(F.lit(go_id).cast("int")), F.slice(ids, 1, keep))


def mask(length: Column, width: Column) -> Column:
    """Q8: ``width`` floats, 1.0 for positions below ``length``."""
    return F.when(width > 0, F.transform(F.sequence(F.lit(1), width),
                                         lambda i: F.when(i <= length, 1.0).otherwise(0.0))
                  ).otherwise(F.array().cast("array<double>"))


def reverse(ids: Column) -> Column:
    """Q9."""
    return F.reverse(ids)


def remove_pad(ids: Column, pad_id: int) -> Column:
    """P11."""
    return F.array_remove(ids, F.lit(pad_id).cast("int"))


def unk_count(ids: Column, unk_id: int) -> Column:
    """A6."""
    return F.size(F.filter(ids, lambda x: x == unk_id))


MAX_TEXT_LENGTH, MAX_SUMMARY_LENGTH = 400, 30  # of P9: the first is not reached, the second is


def example_filter(text_ids: Column, summary_ids: Column, unk_id: int, *,
                   min_length: int = 2, max_text_length: int = MAX_TEXT_LENGTH, max_summary_length: int = MAX_SUMMARY_LENGTH,
                   unk_text_limit: int = 30, unk_summary_limit: int = 5) -> Column:
    """P9 as one predicate.

    The reference walks lengths from the smallest text length upward, which
    every text satisfies, so only ``len(text) < max_text_length`` remains of
    that loop.  Text lengths include ``<EOS>``.
    """
    tl, sl = F.size(text_ids), F.size(summary_ids)
    return ((sl >= min_length) & (sl <= max_summary_length) & (tl >= min_length)
            & (tl < max_text_length)
            & (unk_count(summary_ids, unk_id) <= unk_summary_limit)
            & (unk_count(text_ids, unk_id) <= unk_text_limit))


def assign_batches(df: DataFrame, order: list[Column], batch_size: int, id_col: str = "pair_id",
                   keep_remainder: bool = False) -> DataFrame:
    """T1 + W5: global row ``rn`` in ``order``, ``batch_id = rn // size``, ``slot = rn % size``.

    The last partial batch is dropped (``batch_id < n // size``) unless ``keep_remainder``.
    Only the order columns and the row's id (unique) are ranked and checkpointed.
    """
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    keys = [f"__o{i}" for i in range(len(order))]
    narrow = df.select(F.col(id_col), *[c.alias(k) for c, k in zip(order, keys)])
    ranked = global_row_number(narrow, [F.col(k) for k in keys], "rn").select(id_col, "rn")
    if not keep_remainder:
        n_full = ranked.count() // batch_size  # one scalar; the ranked table is checkpointed
        ranked = ranked.filter(F.col("rn") < n_full * batch_size)
    return (df.join(ranked, id_col)
            .withColumn("batch_id", F.floor(F.col("rn") / batch_size).cast("long"))
            .withColumn("slot", (F.col("rn") % batch_size).cast("int")))


def pad_in_batch(batched: DataFrame, ids_col: str, pad_id: int, prefix: str) -> DataFrame:
    """Q5 + Q6: pad ``ids_col`` to the longest in its batch.

    Adds ``{prefix}_len`` (true) and ``{prefix}_padded_len``.  The window holds
    one batch, a bounded group.
    """
    w = Window.partitionBy("batch_id")
    width = F.max(F.size(ids_col)).over(w)
    return (batched.withColumn(f"{prefix}_len", F.size(ids_col))
            .withColumn(f"{prefix}_padded_len", width)
            .withColumn(ids_col, pad_to(F.col(ids_col), F.col(f"{prefix}_padded_len"), pad_id)))


def length_summary(lengths: DataFrame, group: str, length: str) -> DataFrame:
    """Count, mean, std (sample), min, quartiles (linear), max per group."""
    q = F.percentile(F.col(length), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return lengths.groupBy(group).agg(
        F.count(F.lit(1)).cast("long").alias("count"),
        F.avg(length).alias("mean"), F.stddev_samp(length).alias("std"),
        F.min(length).cast("long").alias("min"), q.alias("__q"),
        F.max(length).cast("long").alias("max")).select(
        group, "count", "mean", "std", "min",
        F.col("__q")[0].alias("p25"), F.col("__q")[1].alias("p50"), F.col("__q")[2].alias("p75"), "max")


def length_percentiles(lengths: DataFrame, group: str, length: str,
                       ps: tuple[float, ...] = (0.9, 0.95, 0.99)) -> DataFrame:
    """A10: exact percentiles with linear interpolation."""
    q = F.percentile(F.col(length), F.array(*[F.lit(p) for p in ps]))
    out = lengths.groupBy(group).agg(q.alias("__q"))
    return out.select(group, *[F.col("__q")[i].alias(f"p{int(round(p * 100))}")
                               for i, p in enumerate(ps)])


def length_histogram(lengths: DataFrame, group: str, length: str, bins: int = 20) -> DataFrame:
    """Equal-width histogram, last bin closed at the right; empty bins kept.

    Rows are counted per (group, length) first; bounds, bins and the join work on
    that small table, which has one row per length that occurs.
    """
    lengths = cut_lineage(lengths.groupBy(group, length).agg(F.count(F.lit(1)).alias("__n")))
    stats = lengths.groupBy(group).agg(F.min(length).cast("double").alias("lo"),
                                       F.max(length).cast("double").alias("hi"))
    stats = stats.select(group,
                         F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
                         F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    idx = (F.col(length) - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))
    b = F.least(F.floor(idx).cast("int") + 1, F.lit(bins))
    counted = (lengths.join(stats, group)
               .select(group, b.alias("bin"), "__n").groupBy(group, "bin")
               .agg(F.sum("__n").cast("long").alias("n")))
    grid = stats.select(group, "lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    return (grid.join(counted, [group, "bin"], "left")
            .select(group, "bin",
                    (F.col("lo") + (F.col("bin") - 1) * width).alias("lo"),
                    (F.col("lo") + F.col("bin") * width).alias("hi"),
                    F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))
