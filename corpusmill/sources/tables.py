"""Parquet tables of a scale-factor folder (``{sf_dir}/{name}.parquet``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Row key of each text table: used to spread a scan that has too few splits.
KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id", "events": "event_id",
        "embeddings": "vec_id", "benchmark": "item_id", "labels": "doc_id"}


#: Partitions that the registered queries spread a small table over before row-wise work.
SPREAD = 16


def read_table(spark: SparkSession, sf_dir: str, name: str, spread: int = SPREAD) -> DataFrame:
    """Read one table.

    A Parquet file that is a single row group is a single scan task, and all per-row work before the
    first shuffle (tokenising, regex extraction, partial aggregation) would then run on one core.  A table
    whose scan has fewer than ``spread`` splits is dealt over ``spread`` partitions by its key; 0 reads it as
    it lies.  Large tables have more splits and are never reshuffled.
    """
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    key = KEYS.get(name)
    if spread and key is not None and df.rdd.getNumPartitions() < spread:
        df = df.repartition(spread, key)
    return df
