"""Hot keys: one key holding most rows still gets exact results and is not one task."""

from pyspark.sql import functions as F

from corpusmill.operators import ranking as RK
from corpusmill.operators import vocab as V


def test_per_key_row_number_with_a_hot_key(spark):
    rows = [("hot", i) for i in range(3000)] + [(f"k{j}", i) for j in range(20) for i in range(10)]
    df = spark.createDataFrame(rows, "key string, t long").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    out = RK.global_row_number(df, [F.col("t")], "rn", partition_by=["key"])
    got = {}
    for r in out.collect():
        got.setdefault(r.key, []).append((r.t, r.rn))
    for key, pairs in got.items():
        pairs.sort()
        assert [rn for _, rn in pairs] == list(range(len(pairs))), key
    # the hot key's rows sit in several range partitions, so several tasks number them
    # (AQE would merge this tiny input into one partition; at scale partitions are large)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = (df.orderBy("key", "t").withColumn("p", F.spark_partition_id())
                  .filter(F.col("key") == "hot").select("p").distinct().count())
        again = RK.global_row_number(df, [F.col("t")], "rn", partition_by=["key"])
        assert sorted((r.key, r.t, r.rn) for r in again.collect()) == sorted(
            (k, t, rn) for k, ps in got.items() for t, rn in ps)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert spread > 1


def test_word_stats_with_a_hot_word(spark):
    docs = [(d, ["the"] * 300 + [f"w{d}", "the"]) for d in range(40)]
    df = spark.createDataFrame(docs, "doc long, toks array<string>").repartition(5)
    s = {r.word: (r.cnt, r.first["doc"], r.first["pos"]) for r in
         V.word_stats(df, "doc", [(0, F.col("toks"))]).collect()}
    assert s["the"] == (40 * 301, 0, 0)
    assert s["w7"] == (1, 7, 1)


def test_claims_of_a_long_conversation(spark):
    import random

    from corpusmill.operators import records as D
    from corpusmill.plans import bindings as B
    rng = random.Random(2)
    talk = {c: [(t * 3, rng.choice(["user", "assistant", "system"]), f"{c}.{t}") for t in range(n)] for c, n in ((1, 700), (2, 9), (3, 1), (4, 40))}
    rows = [(c, *t) for c, turns in talk.items() for t in turns]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    claims = B.turn_claims(df, size=16)
    names = df.groupBy(F.col("conv_id").alias("debate_key")).agg(F.min("text").alias("name"))
    got = D.flatten_claims(claims, D.number_debates(names)).orderBy("debate_id", "claim_no").collect()
    want = []
    for d, turns in enumerate(talk.values()):
        users = [i for i, t in enumerate(turns) if t[1] == "user"]

        def reply(i, k):
            return turns[i + k][2] if i + k < len(turns) and turns[i + k][1] != "user" else None
        order = users[::2] + users[1::2]
        want += [(1000000 + d, n, n >= len(users[::2]), turns[i][2], reply(i, 1), reply(i, 3)) for n, i in enumerate(order)]
    assert [(r.debate_id, r.claim_no, r.is_opposing, r.claim, r.argument, r.counter) for r in got] == want
    parts = claims.where("debate_key = 1").withColumn("t", F.spark_partition_id()).groupBy("t").count().count()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = max(parts, B.turn_claims(df, size=16).where("debate_key = 1").withColumn("t", F.spark_partition_id()).groupBy("t").count().count())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert parts > 1   # one conversation, several tasks


def test_spread_join_is_a_join(spark):
    from corpusmill.operators.joins import spread_join
    rows = spark.createDataFrame([("hot", i) for i in range(200)] + [("x", 1), ("none", 2), (None, 3)], "key string, v long")
    heads = spark.createDataFrame([("hot", "h"), ("x", "y")], "key string, w string")
    for how in ("inner", "left"):
        a = spread_join(rows, heads, ["key"], F.col("v"), how)
        assert sorted(map(str, a.collect())) == sorted(map(str, rows.join(heads, "key", how).collect())) and a.columns == ["key", "v", "w"]
