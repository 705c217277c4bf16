"""Page store: S4, S5, S7, S11 on the hand-made manifest and data files."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import FIXTURES
from corpusmill.sources import store as ST


def test_manifest_keep_last_and_contents(spark):
    d = os.path.join(FIXTURES, "store")
    m = ST.read_manifest(spark, os.path.join(d, "contents.txt"))
    rows = {r.url: r for r in m.collect()}
    assert rows["http://a.org/x"].offset == 36 and rows["http://a.org/x"].length == 19
    c = ST.read_contents(m, d).join(m.select("url", "content_type"), "url")
    text = {r.url: r.t for r in c.select("url", ST.decode_page(F.col("content"), F.col("content_type")).alias("t")).collect()}
    assert text == {"http://a.org/x": "<html>one v2</html>", "http://a.org/y": "<html>two été</html>",
                    "http://a.org/z": "<html>café</html>"}


def test_buckets(spark):
    df = spark.createDataFrame([("http://a.org/x",), ("",), (None,)], "u string")
    assert {r[0] for r in df.select(ST.bucket_of(F.col("u"))).collect()} <= set("0123456789abcdef")


def decoded(spark, content, content_type, **kw):
    df = spark.createDataFrame([(content, content_type)], "c binary, t string")
    return df.select(ST.decode_page(F.col("c"), F.col("t"), **kw)).first()[0]


def test_charsets(spark):
    every = bytes(b for b in range(256) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
    assert decoded(spark, every, "text/html; charset=windows-1252") == every.decode("cp1252")
    assert decoded(spark, every, 'text/html; charset="cp1252"') == every.decode("cp1252")
    assert decoded(spark, "é".encode("latin-1"), "text/html; charset=latin1") == "é"
    assert decoded(spark, "é中".encode(), "text/html") == "é中" == decoded(spark, "é中".encode("utf-16-le"), "text/html; charset=utf-16le")
    assert decoded(spark, b"x", "text/html; charset=koi8-r", unknown="null") is None
    with pytest.raises(Exception, match="unknown charset KOI8-R"):
        decoded(spark, b"x", "text/html; charset=koi8-r")


def test_url_list_in_visit_order(spark, scratch):
    import os as _os
    v = spark.createDataFrame([(2, "c"), (0, "a"), (1, "b")], "rank long, url string").repartition(3)
    path = _os.path.join(scratch, "urls")
    ST.write_url_list(v, path)
    lines = [r.value for r in spark.read.text(path).collect()]
    files = sorted(f for f in _os.listdir(path) if f.startswith("part-"))
    ordered = [ln for f in files for ln in open(_os.path.join(path, f)).read().split()]
    assert ordered == ["a", "b", "c"] and sorted(lines) == ["a", "b", "c"]


def test_parquet_store_keep_last(spark, scratch):
    import datetime as dt
    import os as _os
    t0 = dt.datetime(2024, 1, 1)
    rows = [("http://a.org/x", t0, "text/html", b"old"), ("http://a.org/x", t0 + dt.timedelta(days=1), "text/html", b"newer"),
            ("http://a.org/y", t0, "text/html", b"y1"), ("http://a.org/y", t0, "text/html", b"y-longer")]
    df = spark.createDataFrame(rows, "url string, retrieved timestamp, content_type string, content binary")
    path = _os.path.join(scratch, "store")
    ST.append_pages(df.limit(2), path)
    ST.append_pages(df.filter(F.col("url").endswith("y")), path)
    got = {r.url: bytes(r.content) for r in ST.read_store(spark, path).collect()}
    assert got == {"http://a.org/x": b"newer", "http://a.org/y": b"y-longer"}   # tie on time: longer wins
    meta = ST.read_store(spark, path, content=False)
    assert "content" not in meta.columns and meta.count() == 2
    plan = meta._jdf.queryExecution().executedPlan().toString()
    assert "content:binary" not in plan


def pages_frame(spark, rows):
    return spark.createDataFrame(rows, "url string, retrieved timestamp, content_type string, content binary")


def hostile_pages():
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(f"http://a.org/{i}", t0 + dt.timedelta(seconds=i), "text/html", bytes([i % 256]) * (i * 37 % 900)) for i in range(400)]
    rows += [("http://hot.org/", t0 + dt.timedelta(seconds=i), "text/html", b"\n\t\x00%d" % i) for i in range(200)]  # a third of all rows
    return rows + [(None, t0, None, b"no url"), ("http://n.org/", t0, None, None), ("http://e.org/", None, "", b""), ("http://t.org/a\tb", t0, "x", b"tab")]


def test_page_files_roll_and_read_back(spark, scratch):
    import collections
    rows = hostile_pages()
    ST.append_page_files(pages_frame(spark, rows), scratch, roll=5000)
    stored = spark.read.format("pagefiles").load(scratch)
    got = collections.Counter((r.url, r.content and bytes(r.content)) for r in stored.collect())
    want = collections.Counter(((u.replace("\t", "%09") if u else u), c) for u, _, _, c in rows)
    assert {k: v for k, v in got.items()} == {(u, c or c): v for (u, c), v in want.items()}
    files = stored.where("file is not null").groupBy("file").agg(F.sum("length").alias("n"), F.max("length").alias("most")).collect()
    assert len(files) > 16 and all(f.n < 5000 + f.most for f in files)   # closed at the first page that reaches the size
    sizes = {f.file: os.path.getsize(os.path.join(scratch, f.file)) for f in files}
    assert sizes == {f.file: f.n for f in files}


def test_page_files_keep_last_and_seek(spark, scratch):
    rows = hostile_pages()
    ST.append_page_files(pages_frame(spark, rows), scratch, roll=5000)
    ST.append_page_files(pages_frame(spark, [(u, t, k, b"second") for u, t, k, _ in rows[:5]]), scratch, roll=5000)
    m = ST.read_page_files(spark, scratch)
    got = {r.url: r.content and bytes(r.content) for r in ST.read_contents(m, scratch).collect()}
    assert got["http://a.org/3"] == b"second" and got["http://a.org/7"] == rows[7][3]
    assert got["http://hot.org/"] == rows[599][3] and got["http://n.org/"] is None and got[None] == b"no url"
    assert len(got) == len({r[0] for r in rows})
    plan = ST.read_contents(m, scratch)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "content#" in x and ("Exchange" in x or "Sort" in x)]


def test_unfinished_writes_are_not_seen(spark, scratch):
    from corpusmill.sources import pagefiles as PF
    PF.register(spark)
    assert ST.read_page_files(spark, scratch).collect() == []
    ST.append_page_files(pages_frame(spark, hostile_pages()[:3]), scratch)
    os.makedirs(os.path.join(scratch, "manifest"), exist_ok=True)
    open(os.path.join(scratch, "manifest", "99999999999999999999-x-000000-0"), "w").write("http://a.org/0\t\t5\tnone\t0\t\n")
    assert sorted(r.url for r in ST.read_page_files(spark, scratch).collect()) == [f"http://a.org/{i}" for i in range(3)]
    assert spark.read.format("pagefiles").load(scratch).count() == 3
    bad = spark.createDataFrame([("u", "nowhere", 0, 5)], "url string, file string, offset long, length long")
    with pytest.raises(Exception, match="nowhere"):
        ST.read_contents(bad, scratch).collect()
    short = spark.createDataFrame([("u", os.path.relpath(os.path.join(FIXTURES, "store", "contents.txt"), scratch), 0, 10 ** 9)], bad.schema)
    with pytest.raises(Exception, match="file ends"):
        ST.read_contents(short, scratch).collect()


def test_near_ranges_share_reads():
    from corpusmill.sources import files as FS
    data = bytes(range(256)) * 2000
    calls = []

    class File:
        def read_at(self, n, at):
            calls.append((at, n))
            return data[at:at + n]
    places = [(0, 10), (5, 10), (20, 0), (30, 100), (200_000, 50), (200_040, 60)]
    assert list(FS.ranges_of(File(), places)) == [data[a:a + n] for a, n in places]
    assert calls == [(0, 130), (200_000, 100)]


def test_parquet_store_bytes_stay_out_of_exchanges(spark, scratch):
    rows = hostile_pages()
    path = os.path.join(scratch, "store")
    ST.append_pages(pages_frame(spark, rows), path)
    ST.append_pages(pages_frame(spark, [(u, t, k, b"a longer second content" * 50) for u, t, k, _ in rows[:5]]), path)
    df = ST.read_store(spark, path)
    got = {r.url: r.content and bytes(r.content) for r in df.collect()}
    assert len(got) == len({r[0] for r in rows}) and got[None] == b"no url" and got["http://n.org/"] is None
    assert got["http://a.org/2"] == b"a longer second content" * 50 and got["http://hot.org/"] == rows[599][3]
    plan = df._jdf.queryExecution().toString()
    assert not [x for x in plan.splitlines() if "content#" in x and ("Exchange" in x or "Sort" in x or "Repartition" in x)]
