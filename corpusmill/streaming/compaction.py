"""Compaction of a streamed page store.

The stream leaves one folder per micro-batch.  ``compact`` merges those that have come since the last time with the last merged
version, the latest retrieval of each url wins, and writes the next version.  A file ``current`` names the
version that counts and the last batch in it; it is replaced by one rename after the version is complete.  A
merge that fails or runs twice therefore changes nothing: it writes the same next version again.

The merge's state is one narrow row per url (its latest place); page bytes are read at these places and written by
the same task.  Batches of a stream have rising ids, and one that is replayed after it was merged holds what it held before.
"""

from __future__ import annotations

import json
import posixpath

from pyspark.sql import DataFrame, SparkSession

from corpusmill.session import cut_lineage
from corpusmill.sources.files import read_rows
from corpusmill.sources.store import BLOCK_BYTES, latest_of

STORED = "url string, retrieved timestamp, length long, content_type string, content binary, bucket string"


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path(posixpath.join(*parts))


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, merged_dir: str) -> tuple[int, int]:
    """Version that counts and the last batch in it; ``(-1, -1)`` before the first."""
    fs, at = _fs(spark, merged_dir), _path(spark, merged_dir, "current")
    if not fs.exists(at):
        return -1, -1
    said = json.loads(spark.read.text(at.toString()).first()[0])
    return said["version"], said["batch"]


def batches(spark: SparkSession, store_dir: str, after: int) -> list[int]:
    """Ids of the complete batches after one, in order."""
    fs, root = _fs(spark, store_dir), _path(spark, store_dir)
    if not fs.exists(root):
        return []
    ids = [int(s.getPath().getName()[len("batch="):]) for s in fs.listStatus(root) if s.getPath().getName().startswith("batch=")]
    return sorted(i for i in ids if i > after and fs.exists(_path(spark, store_dir, f"batch={i}", "_SUCCESS")))


def _latest(spark: SparkSession, store_dir: str, merged_dir: str, version: int, fresh: list[int]) -> DataFrame | None:
    parts = [spark.read.schema(STORED).parquet(posixpath.join(merged_dir, f"version={version}"))] if version >= 0 else []
    if fresh:
        parts.append(spark.read.schema(STORED).option("basePath", store_dir).parquet(*[posixpath.join(store_dir, f"batch={i}") for i in fresh]))
    return latest_of(*parts) if parts else None


def compact(spark: SparkSession, store_dir: str, merged_dir: str) -> int:
    """Merge the batches of ``store_dir`` that are not in the current version of ``merged_dir``; returns the current version."""
    version, last = current(spark, merged_dir)
    fresh = batches(spark, store_dir, last)
    if not fresh:
        return version
    rows = read_rows(cut_lineage(_latest(spark, store_dir, merged_dir, version, fresh)))
    (rows.write.mode("overwrite").option("parquet.block.size", BLOCK_BYTES).partitionBy("bucket")
     .parquet(posixpath.join(merged_dir, f"version={version + 1}")))
    fs, new = _fs(spark, merged_dir), _path(spark, merged_dir, "current.new")
    out = fs.create(new, True)
    out.write(bytearray(json.dumps({"version": version + 1, "batch": fresh[-1]}).encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark._jsc.hadoopConfiguration())
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(new, _path(spark, merged_dir, "current"), options)
    return version + 1


def read_merged(spark: SparkSession, store_dir: str, merged_dir: str, content: bool = True) -> DataFrame:
    """The latest retrieval of each url over the current version and the batches after it."""
    version, last = current(spark, merged_dir)
    rows = _latest(spark, store_dir, merged_dir, version, batches(spark, store_dir, last))
    if rows is None:
        return spark.createDataFrame([], STORED).select("url", "retrieved", "length", "bucket", "content_type", *(["content"] if content else []))
    return read_rows(cut_lineage(rows)) if content else rows.drop("__f", "__i")


def remove_superseded(spark: SparkSession, store_dir: str, merged_dir: str) -> int:
    """Delete the batches and versions that the current version replaces; returns how many folders went.

    To be called when no reader that began before the last ``compact`` is left.
    """
    version, last = current(spark, merged_dir)
    gone = 0
    for folder, prefix, keep in ((store_dir, "batch=", lambda i: i > last), (merged_dir, "version=", lambda i: i >= version)):
        fs, root = _fs(spark, folder), _path(spark, folder)
        for s in fs.listStatus(root) if fs.exists(root) else []:
            name = s.getPath().getName()
            if name.startswith(prefix) and not keep(int(name[len(prefix):])):
                gone += bool(fs.delete(s.getPath(), True))
    return gone
