"""Streamed ingest equals the batch keep-last result, also across a restart."""

import datetime as dt
import os

from pyspark.sql import functions as F

from corpusmill.sources import store as ST
from corpusmill.streaming import compaction as CP
from corpusmill.streaming import ingest as IN


def test_stream_equals_batch(spark, scratch):
    src, store, links, ckpt = (os.path.join(scratch, x) for x in ("src", "store", "links", "ckpt"))
    t0 = dt.datetime(2024, 1, 1)
    rows1 = [(f"http://s.org/{i}", t0, "text/html", f'<a href="/l{i}">x</a>'.encode()) for i in range(6)]
    rows2 = [(f"http://s.org/{i}", t0 + dt.timedelta(days=1), "text/html", f"v2 {i}".encode()) for i in range(3)]
    spark.createDataFrame(rows1, IN.PAGE_SCHEMA).repartition(3).write.parquet(os.path.join(src, "a"))
    seen = []
    IN.ingest(spark, os.path.join(src, "*"), store, links, ckpt, max_files_per_trigger=1,
              consumer=lambda pages, batch: seen.extend(r.url for r in pages.collect()))
    assert sorted(seen) == sorted(r[0] for r in rows1)
    spark.createDataFrame(rows2, IN.PAGE_SCHEMA).repartition(2).write.parquet(os.path.join(src, "b"))
    IN.ingest(spark, os.path.join(src, "*"), store, links, ckpt, max_files_per_trigger=1)
    IN.ingest(spark, os.path.join(src, "*"), store, links, ckpt)   # restart with nothing new
    got = {r.url: r.content for r in ST.read_store(spark, store).collect()}
    batch = {}
    for u, t, _, c in rows1 + rows2:
        if u not in batch or t > batch[u][0]:
            batch[u] = (t, c)
    assert got == {u: bytearray(c) if isinstance(got[u], bytearray) else c for u, (_, c) in batch.items()}
    assert spark.read.parquet(store).count() == len(rows1) + len(rows2)   # no batch stored twice
    assert spark.read.parquet(links).filter(F.col("dest").startswith("http://s.org/l")).count() == 6


def write_batch(spark, store, batch, rows):
    df = spark.createDataFrame(rows, IN.PAGE_SCHEMA)
    ST.store_rows(df).write.mode("overwrite").partitionBy("bucket").parquet(os.path.join(store, f"batch={batch}"))


def test_compaction_keeps_the_latest_and_is_repeatable(spark, scratch):
    store, merged = os.path.join(scratch, "store"), os.path.join(scratch, "merged")
    t0 = dt.datetime(2024, 1, 1)
    want = {}

    def batch(k, urls):
        rows = [(None if u is None else f"http://s.org/{u}", t0 + dt.timedelta(days=k), "text/html", f"{u} of {k}".encode()) for u in urls]
        want.update((u, c) for u, _, _, c in rows)
        write_batch(spark, store, k, rows)

    def read():
        got = [(r.url, bytes(r.content)) for r in CP.read_merged(spark, store, merged).collect()]
        assert len(got) == len(dict(got))
        return dict(got)

    assert CP.compact(spark, store, merged) == -1 and CP.read_merged(spark, store, merged).count() == 0
    batch(0, [1, 2, 3, None])
    batch(1, [2, 4])
    assert read() == want                                        # batches alone
    assert CP.compact(spark, store, merged) == 0 and read() == want
    assert CP.compact(spark, store, merged) == 0                 # nothing new: nothing happens
    batch(2, [3, 5, None])
    assert read() == want                                        # version and a later batch
    batch(1, [2, 4])                                             # a replayed batch holds what it held
    assert read() == want
    os.makedirs(os.path.join(store, "batch=7"))                  # begun, not complete
    os.makedirs(os.path.join(merged, "version=1", "bucket=0"))   # a merge that died before it was current
    assert CP.current(spark, merged) == (0, 1) and read() == want
    assert CP.compact(spark, store, merged) == 1 and CP.current(spark, merged) == (1, 2) and read() == want
    assert CP.remove_superseded(spark, store, merged) == 4 and read() == want
    assert sorted(os.listdir(store)) == ["batch=7"]
    assert CP.read_merged(spark, store, merged, content=False).columns == ["url", "retrieved", "length", "bucket", "content_type"]
