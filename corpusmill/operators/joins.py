"""Joins of many rows with one small row per key, where a key may hold a third of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16  # tasks that one key's rows spread over


def spread_join(rows: DataFrame, heads: DataFrame, keys: list[str], by: Column, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``rows`` joined with ``heads`` on ``keys``; rows of one key are dealt over ``salts`` tasks by ``by``, for which each row of
    ``heads`` is repeated as often."""
    salted = heads.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(salted, [*keys, "__salt"], how).drop("__salt")
