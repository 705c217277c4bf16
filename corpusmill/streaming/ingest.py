"""Incremental page ingest.

New page files under a folder are read as a file stream; each micro-batch is
written by ``foreachBatch`` into its own ``batch=<id>`` directory of the store
and of the link table, with overwrite.  A replayed batch (after a failure
between the write and the commit) rewrites the same directory, so the store
never holds a batch twice, and the store reader's keep-last rule (latest
retrieval per url) gives the same pages whatever the batch split.  Pages are decoded
by their content type; one in an unknown charset is stored but has no links.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.operators.links import link_table
from corpusmill.sources.store import BLOCK_BYTES, dealt_by_bucket, decode_page, store_rows

PAGE_SCHEMA = T.StructType([
    T.StructField("url", T.StringType()), T.StructField("retrieved", T.TimestampType()),
    T.StructField("content_type", T.StringType()), T.StructField("content", T.BinaryType()),
])


Consumer = Callable[[DataFrame, int], None]


def _write_batch(store_dir: str, links_dir: str, consumer: Consumer | None):
    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read once for the store, the links and the consumer
        try:
            (dealt_by_bucket(store_rows(batch)).write.mode("overwrite").option("parquet.block.size", BLOCK_BYTES).partitionBy("bucket")
             .parquet(posixpath.join(store_dir, f"batch={batch_id}")))
            pages = batch.select("url", "retrieved", decode_page(F.col("content"), F.col("content_type"), unknown="null").alias("html"))
            link_table(pages, keep=("retrieved",)).write.mode("overwrite").parquet(posixpath.join(links_dir, f"batch={batch_id}"))
            if consumer is not None:
                consumer(pages, batch_id)
        finally:
            batch.unpersist()
    return run


def ingest(spark: SparkSession, source_dir: str, store_dir: str, links_dir: str, checkpoint: str,
           max_files_per_trigger: int | None = None, consumer: Consumer | None = None) -> None:
    """Process every page file not yet seen (``availableNow``) and stop.

    ``consumer`` (V2) is called with the decoded pages ``(url, retrieved, html)`` and the id of every
    batch, after the batch is written; like the writes it may see a batch again after a failure.
    """
    reader = spark.readStream.schema(PAGE_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    q = (reader.parquet(source_dir).writeStream
         .foreachBatch(_write_batch(store_dir, links_dir, consumer))
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def read_links(spark: SparkSession, links_dir: str, stored: DataFrame) -> DataFrame:
    """Links ``(src, pos, dest, anchor)`` of the stored retrievals; a repeated retrieval counts once."""
    kept = stored.select(F.col("url").alias("src"), "retrieved")
    return (spark.read.parquet(links_dir).join(kept, ["src", "retrieved"], "left_semi")
            .select("src", "pos", "dest", "anchor").distinct())
