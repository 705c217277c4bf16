"""Global row numbers without a single-partition window.

``row_number().over(Window.orderBy(...))`` with no partition moves the whole table
into one task.  Here the table is range-partitioned and sorted by the key
(``orderBy``), each row is tagged with its partition and its position in it,
the tagged table is checkpointed (so a lost executor cannot renumber rows), and
a per-partition count - one row per partition, so a proven small table - gives
each partition its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import cut_lineage

_PID, _MID, _OFF = "__pid", "__mid", "__off"


def global_row_number(df: DataFrame, order: list[Column | str], name: str = "rn",
                      start: int = 0, partition_by: list[str] | None = None) -> DataFrame:
    """Add ``name`` = position of each row in ``order`` (a total order), from ``start``.

    With ``partition_by`` the numbering restarts for each key.  The table is
    range-partitioned by ``(keys, order)``, so a key holding a third of all rows
    spans many partitions; its offsets come from the per-(partition, key) counts
    (at most partitions + keys rows), never from one task holding the key.
    """
    keys = list(partition_by or [])
    tagged = (df.orderBy(*keys, *order)
              .withColumn(_PID, F.spark_partition_id())
              .withColumn(_MID, F.monotonically_increasing_id()))
    tagged = cut_lineage(tagged)
    counts = tagged.groupBy(_PID, *keys).agg(F.count(F.lit(1)).alias("__n"), F.min(_MID).alias("__m0"))
    w = Window.partitionBy(*keys).orderBy(_PID) if keys else Window.orderBy(_PID)
    offsets = counts.select(
        _PID, *keys, "__m0",
        F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(_OFF))
    if not keys:
        offsets = F.broadcast(offsets)  # one row per partition
    local = F.col(_MID) - F.col("__m0")
    return (tagged.join(offsets, [_PID, *keys])
            .withColumn(name, (F.col(_OFF) + local + F.lit(start)).cast("long"))
            .drop(_PID, _MID, _OFF, "__m0"))


def one_row(*aggs: DataFrame) -> DataFrame:
    """Put the columns of several one-row aggregates side by side.

    A union of the rows (each padded with nulls) and one ``max`` per column;
    no join, so no cartesian product appears in the plan.
    """
    cols: list[tuple[str, str]] = []
    for a in aggs:
        cols.extend((f.name, f.dataType.simpleString()) for f in a.schema.fields)
    names = [c for c, _ in cols]
    padded = []
    for a in aggs:
        own = set(a.columns)
        padded.append(a.select(*[F.col(c) if c in own else F.lit(None).cast(t).alias(c)
                                 for c, t in cols]))
    u = padded[0]
    for p in padded[1:]:
        u = u.unionByName(p)
    return u.agg(*[F.max(c).alias(c) for c in names])
