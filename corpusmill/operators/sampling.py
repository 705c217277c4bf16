"""Previews, samples and splits.

Randomness is a hash of ``(seed, id)`` - never ``rand()`` - so a retried task, a
different partition count and the SQL oracle all see the same draw.  The hash
order is ``md5('<seed>:<id>')`` as hex text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.ranking import global_row_number


def hash_key(id_col: str | Column, seed: int) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def hash_unit(id_col: str | Column, seed: int) -> Column:
    """A uniform number in [0, 1) from the first 32 bits of the hash."""
    return F.conv(F.substring(hash_key(id_col, seed), 1, 8), 16, 10).cast("double") / float(1 << 32)


def preview(df: DataFrame, order: list[str | Column], n: int) -> DataFrame:
    """First ``n`` rows in ``order`` (a distributed top-k)."""
    return df.orderBy(*order).limit(n)


def sample_ids(df: DataFrame, id_col: str, below: int, k: int, seed: int) -> DataFrame:
    """T4: ``k`` distinct ids among those ``< below``, without replacement."""
    return (df.filter(F.col(id_col) < below)
            .orderBy(hash_key(id_col, seed), F.col(id_col)).limit(k))


def pick_one(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    """T5: one row chosen by hash (always inside the table)."""
    return df.orderBy(hash_key(id_col, seed), F.col(id_col)).limit(1)


def split_sizes(n: int, first_test: float, second_test: float) -> tuple[int, int, int]:
    """Sizes of two successive exact splits: test parts are rounded up (as sklearn does)."""
    held = math.ceil(n * first_test)
    second = math.ceil(held * second_test)
    return n - held, held - second, second


def exact_split(df: DataFrame, id_col: str, seed: int, first_test: float = 0.2,
                second_test: float = 0.5, names: tuple[str, str, str] = ("train", "test", "eval")
                ) -> DataFrame:
    """``(id, part)`` with exact part sizes.

    Rows are ranked by hash (distributed global row number over the id column
    only); the first ``n - ceil(n*p1)`` are the first part, the held-out rest is
    cut in two with the second part rounded up.
    """
    ids = df.select(F.col(id_col))
    ranked = global_row_number(ids, [hash_key(id_col, seed), F.col(id_col)], "__r")
    n = ranked.count()
    a, b, _ = split_sizes(n, first_test, second_test)
    part = (F.when(F.col("__r") < a, F.lit(names[0]))
            .when(F.col("__r") < a + b, F.lit(names[1])).otherwise(F.lit(names[2])))
    return ranked.select(F.col(id_col), part.alias("part"))


def threshold_split(df: DataFrame, id_col: str, seed: int, first_test: float = 0.2,
                    second_test: float = 0.5, names: tuple[str, str, str] = ("train", "test", "eval")
                    ) -> DataFrame:
    """T6 for very large tables: parts by hash threshold, no sort; sizes are expected, not exact."""
    u = hash_unit(id_col, seed)
    cut_a = 1.0 - first_test
    cut_b = cut_a + first_test * (1.0 - second_test)
    part = (F.when(u < cut_a, F.lit(names[0])).when(u < cut_b, F.lit(names[1]))
            .otherwise(F.lit(names[2])))
    return df.select(F.col(id_col), part.alias("part"))


def holdout_first(df: DataFrame, id_col: str, size: int,
                  names: tuple[str, str] = ("valid", "train")) -> DataFrame:
    """The first ``size`` rows by id are held out; the cut is a bounded top-k, broadcast."""
    head = df.select(F.col(id_col)).orderBy(id_col).limit(size).withColumn("__h", F.lit(True))
    return (df.select(id_col).join(F.broadcast(head), id_col, "left")
            .select(id_col, F.when(F.col("__h"), F.lit(names[0])).otherwise(F.lit(names[1])).alias("part")))
