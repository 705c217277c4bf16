"""Page store.

Two layouts:

* the reference layout - a tab-separated manifest (``url, retrieved, length,
  file, offset, content_type``; later lines replace earlier ones) and data files
  holding many pages at byte offsets; written with ``append_page_files`` (data source
  ``pagefiles``), read with ``read_manifest`` or ``read_page_files`` and ``read_contents``;
* the Spark layout this library writes - Parquet rows ``(url, retrieved,
  length, bucket, content_type, content)`` partitioned by bucket, appended,
  never rewritten; ``read_store`` applies the same keep-last rule.
"""

from __future__ import annotations

import posixpath
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import charset_of, parse_iso_ts
from corpusmill.session import cut_lineage
from corpusmill.sources.files import TASK_BYTES, read_ranges, read_rows, tasks_for
from corpusmill.sources.pagefiles import MANIFEST, ROLL_BYTES, manifest_files, write_page_files

# --- fixed values -----------------------------------------------------------
N_BUCKETS = 16
BLOCK_BYTES = 16 << 20  # of a Parquet row group: what a task holds of a file that it takes rows from
MANIFEST_COLUMNS = ["url", "retrieved", "length", "file", "offset", "content_type"]
# Charsets that Spark decodes, and other names of these and of windows-1252.
DECODABLE = ["UTF-8", "US-ASCII", "ISO-8859-1", "UTF-16BE", "UTF-16LE", "UTF-16", "UTF-32"]
CHARSET_NAMES = {"UTF-8": ["UTF8"], "US-ASCII": ["ASCII"], "ISO-8859-1": ["ISO8859-1", "ISO_8859-1", "LATIN1", "LATIN-1"],
                 "WINDOWS-1252": ["CP1252", "X-CP1252", "WINDOWS1252"]}
# Where windows-1252 differs from ISO-8859-1.
WINDOWS_1252 = dict(zip(
    (0x80, *range(0x82, 0x8D), 0x8E, *range(0x91, 0x9D), 0x9E, 0x9F),
    map(ord, "\u20ac\u201a\u0192\u201e\u2026\u2020\u2021\u02c6\u2030\u0160\u2039\u0152\u017d"
             "\u2018\u2019\u201c\u201d\u2022\u2013\u2014\u02dc\u2122\u0161\u203a\u0153\u017e\u0178")))
# ---------------------------------------------------------------------------

MANIFEST_SCHEMA = T.StructType([
    T.StructField("url", T.StringType()), T.StructField("retrieved", T.StringType()),
    T.StructField("length", T.LongType()), T.StructField("file", T.StringType()),
    T.StructField("offset", T.LongType()), T.StructField("content_type", T.StringType()),
])


def bucket_of(url: Column) -> Column:
    """One of 16 buckets, the first hex digit of the url's md5 (the policy is free)."""
    return F.substring(F.md5(F.coalesce(url, F.lit(""))), 1, 1)


def data_file_name(bucket: Column) -> Column:
    return F.concat(F.lit("data_"), bucket, F.lit(".txt"))


def read_manifest(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Manifest lines; for each url the last line wins.

    Line order within a manifest file is kept by ``monotonically_increasing_id``
    taken right at the scan (file splits are numbered in offset order), and
    ``max_by`` keeps the last one per url - a grouped aggregate, no global sort.
    """
    raw = (spark.read.schema(MANIFEST_SCHEMA).option("sep", "\t").option("quote", "")
           .option("header", False).option("mode", "PERMISSIVE").csv(path)
           .withColumn("__f", F.input_file_name()).withColumn("__l", F.monotonically_increasing_id()))
    last = raw.groupBy("url").agg(F.max_by(F.struct(*MANIFEST_COLUMNS), F.struct("__f", "__l")).alias("m"))
    return last.select("m.*").withColumn("retrieved", parse_iso_ts(F.col("retrieved")))


def read_contents(manifest: DataFrame, store_dir: str) -> DataFrame:
    """``(url, content binary)`` - bytes at (file, offset, length) of each manifest row, files named below ``store_dir``.

    Only the places are dealt over the tasks; a task seeks to its places, so no file is read whole and no byte of one
    goes through an exchange.
    """
    return read_ranges(manifest, store_dir)


def read_page_files(spark: SparkSession, store_dir: str) -> DataFrame:
    """S4 on a folder of ``pagefiles``: the manifest's last line of each url over all complete writes."""
    parts = [posixpath.join(store_dir, MANIFEST, n) for n in manifest_files(store_dir)]
    return read_manifest(spark, parts) if parts else spark.createDataFrame([], MANIFEST_SCHEMA).withColumn("retrieved", F.col("retrieved").cast("timestamp"))


def decode_page(content: Column, content_type: Column, unknown: str = "fail", extra: tuple[str, ...] = ()) -> Column:
    """Content decoded with the charset of its content type (X7), default UTF-8.

    Known are Spark's charsets, windows-1252 and the usual names of these.  A page in another charset
    fails the job, or with ``unknown="null"`` gives a null text; it is never read as something else.
    ``extra`` names further charsets of the JVM, for sessions with ``spark.sql.legacy.javaCharsets``.
    """
    if unknown not in ("fail", "null"):
        raise ValueError(f"unknown={unknown!r}")
    names = {n: c for c in (*DECODABLE, *(x.upper() for x in extra), "WINDOWS-1252") for n in (c, *CHARSET_NAMES.get(c, []))}
    raw = F.upper(F.regexp_replace(charset_of(content_type), "[\"']", ""))
    cs = F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), raw)  # null: not known
    latin = F.translate(F.decode(content, "ISO-8859-1"), "".join(map(chr, WINDOWS_1252)), "".join(map(chr, WINDOWS_1252.values())))
    text = F.when(cs == "WINDOWS-1252", latin)
    for c in dict.fromkeys(names.values()):
        if c != "WINDOWS-1252":
            text = text.when(cs == c, F.decode(content, c))
    if unknown == "fail":
        text = text.when(content.isNotNull() & cs.isNull(), F.raise_error(F.concat(F.lit("unknown charset "), raw)))
    return text


def store_rows(pages: DataFrame) -> DataFrame:
    """Rows of the Parquet store of ``(url, retrieved, content_type, content)``."""
    return pages.select("url", "retrieved", F.length("content").cast("long").alias("length"),
                        bucket_of(F.col("url")).alias("bucket"), "content_type", "content")


def dealt_by_bucket(rows: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Store rows dealt over as many tasks per bucket as their bytes ask for, a url's retrievals too."""
    parts = -(-tasks_for(rows, "length", task_bytes) // N_BUCKETS)
    part = F.pmod(F.xxhash64("url", "retrieved"), F.lit(parts))
    return rows.repartition(N_BUCKETS * parts, "bucket", part).sortWithinPartitions("bucket", "url", "retrieved")


def append_pages(pages: DataFrame, store_dir: str) -> None:
    """Append ``(url, retrieved, content_type, content)`` rows to the Parquet store."""
    dealt_by_bucket(store_rows(pages)).write.mode("append").option("parquet.block.size", BLOCK_BYTES).partitionBy("bucket").parquet(store_dir)


def append_page_files(pages: DataFrame, store_dir: str, roll: int = ROLL_BYTES) -> None:
    """S6 in the reference layout: append rows to rolling data files and their manifest."""
    write_page_files(dealt_by_bucket(store_rows(pages)), store_dir, roll)


def latest_of(*stored: DataFrame) -> DataFrame:
    """The latest retrieval of each url (ties: larger length, then the later place) with its place ``__f, __i``, from metadata.

    Rows without a url count as one url.
    """
    order = F.struct("retrieved", "length", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.row_index").alias("__i"),
                     F.col("bucket").cast("string").alias("bucket"), "content_type")
    places = reduce(DataFrame.unionByName, (s.select("url", order.alias("m")) for s in stored))
    last = places.groupBy("url").agg(F.max("m").alias("m"))
    return last.select("url", *[F.col(f"m.{c}").alias(c) for c in ("retrieved", "length", "bucket", "content_type", "__f", "__i")])


def read_store(spark: SparkSession, store_dir: str, content: bool = True) -> DataFrame:
    """S4 on the Parquet store: the latest retrieval of each url.

    The latest places come from the metadata alone; the bytes are then read at these places, file by file, and
    go through no exchange.  ``content=False`` leaves the bytes unread.
    """
    last = latest_of(spark.read.parquet(store_dir))
    return read_rows(cut_lineage(last)) if content else last.drop("__f", "__i")


def write_url_list(visited: DataFrame, path: str) -> None:
    """Visited urls, one per line, in visit order (range-partitioned files in order)."""
    visited.orderBy("rank").select("url").write.mode("overwrite").text(path)
