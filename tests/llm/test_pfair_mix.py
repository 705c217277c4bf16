from collections import Counter
from fractions import Fraction

from pyspark.sql import functions as F

from corpusmill.llm import pfair_mix as M
from helpers import EXTRA, documents, same_as_sql


def test_less_than_one_block_off(spark):
    q = {"a": 7, "b": 1, "c": 4, "d": 11}
    phases = spark.createDataFrame([(0, [(k, v) for k, v in q.items()])], "phase long, sources array<struct<source: string, q: long>>")
    order = [r.source for r in M.cycle_schedule(phases).orderBy("slot").collect()]
    total, seen = sum(q.values()), Counter()
    assert len(order) == total
    for t, s in enumerate(order, 1):
        seen[s] += 1
        assert all(abs(Fraction(t * w, total) - seen[k]) < 1 for k, w in q.items())
    assert seen == q


def test_whole_mix_keeps_every_row_and_target(spark):
    sizes = {"big": 3000, "mid": 500, "small": 40, None: 7}
    rows = [(i, f"t{i}", s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    weights = spark.createDataFrame([("big", 3), ("mid", 2), ("small", 1)], "source string, q int")
    mixed = M.mix(docs, weights, block_docs=10)
    out = mixed.orderBy("cycle", "slot", "nr").collect()
    assert sorted(r.doc_id for r in out) == list(range(len(rows)))
    blocks = list(dict.fromkeys((r.source, r.block) for r in out))
    assert Counter(s for s, _ in blocks[:7]) == {"big": 3, "mid": 2, "small": 1, None: 1}
    for c in range(3):  # the null source has ended, the others keep their proportions
        assert Counter(s for s, _ in blocks[7 + 6 * c:13 + 6 * c]) == {"big": 3, "mid": 2, "small": 1}
    assert Counter(s for s, _ in blocks[25:30]) == {"big": 3, "mid": 2}


def test_edge_rows_and_sql(spark):
    docs = documents(spark)
    got = M.mix(docs.select("doc_id", "text", "source")).select("doc_id", "source", "nr", "block", "cycle", "slot")
    pdf = docs.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"})
    same_as_sql(got, {"documents": pdf}, M.SQL)
    ordered = M.in_mix_order(docs)
    assert ordered.columns == docs.columns and ordered.count() == docs.count()
    assert ordered.select(*EXTRA).distinct().count() == 1  # clashing columns keep their values


def test_empty(spark):
    assert M.in_mix_order(documents(spark).limit(0)).count() == 0


def test_main_path_is_native(spark):
    plan = M.in_mix_order(documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_hot_source_is_numbered_in_buckets(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), F.lit("hot").alias("source"))
    nr = sorted(r.nr for r in M.numbered_by_source(docs, digits=2).select("nr").collect())
    assert nr == list(range(5000))


def test_clashing_columns_are_replaced_or_stay(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "s", -1, f"k{i}", f"b{i}") for i in range(5)], "doc_id long, text string, source string, slot int, `__key` string, `__row` string")
    got = M.mix(docs)
    assert sorted(got.columns) == sorted([*docs.columns, "nr", "block", "cycle"])
    rows = got.orderBy("nr").collect()
    assert [r.nr for r in rows] == list(range(5)) and all(r["__key"] == f"k{r.doc_id}" and r["__row"] == f"b{r.doc_id}" and r.slot >= 0 for r in rows)
    ordered = M.in_mix_order(docs)
    assert ordered.columns == docs.columns and {r.slot for r in ordered.collect()} == {-1}
