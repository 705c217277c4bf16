"""Pipeline from ``documents`` to token files.

Toxic documents go, one document of each near-duplicate group stays, documents that leak the benchmark
go, the rest are put in the order of the source mix, and their ids are written as token blocks in that order.
Every stage but the last returns the columns of ``documents``.  The mix drops nothing: its decision is the
order of rows in the files it writes, by which the last stage reads them.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import pfair_mix, simhash_dedup, string_tiling, token_blocks, toxic_neighbours
from corpusmill.llm.common import table, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    return toxic_neighbours.without_toxic(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, the one with the smallest id."""
    return simhash_dedup.keep_one_per_group(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return string_tiling.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix."""
    return pfair_mix.in_mix_order(docs)


def file_order(docs: DataFrame) -> list[Column] | None:
    """Order of rows in the files that ``docs`` was read from; None where it was not read from files."""
    order = [F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("int"), F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    try:
        docs.select(*order)
    except AnalysisException:
        return None
    return order


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of the input's files (by ``doc_id`` if it comes from none), read back per document."""
    return token_blocks.token_output(docs, order=file_order(docs))


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mix", source_mix),
    ("token_output", token_output),
]

#: The scores of nearest examples, XXH64 fingerprints and the tokenizer's merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
