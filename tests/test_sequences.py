"""Sequence preparation: Q2-Q9, P9, P11, W5, T6, J4/J7 invariants (FIXTURES.md sequence cases)."""

from pyspark.sql import functions as F

from corpusmill.operators import ranking as RK
from corpusmill.operators import sampling as M
from corpusmill.operators import sequences as Q
from corpusmill.operators import vocab as V


def test_pad_truncate_lengths(spark):
    rows = [(n, list(range(1, n + 1))) for n in (0, 1, 399, 400, 401)]
    df = spark.createDataFrame(rows, "n int, ids array<int>")
    out = df.select("n", Q.pad_to(F.col("ids"), 400, 0).alias("p"), Q.capped_len(F.col("ids"), 400).alias("l")).collect()
    for r in out:
        assert len(r.p) == 400 and r.l == min(r.n, 400)
        assert r.p[:r.l] == list(range(1, r.l + 1)) and all(x == 0 for x in r.p[r.l:])


def test_decoder_input_mask_reverse_remove_pad(spark):
    df = spark.createDataFrame([([5, 6, 7], 2, 3)], "ids array<int>, len int, width int")
    r = df.select(Q.decoder_input(F.col("ids"), 9).alias("d"), Q.mask(F.col("len"), F.col("width")).alias("m"),
                  Q.reverse(F.col("ids")).alias("r"), Q.remove_pad(F.array_append("ids", F.lit(0)), 0).alias("u")).first()
    assert r.d == [9, 5, 6] and r.m == [1.0, 1.0, 0.0] and r.r == [7, 6, 5] and r.u == [5, 6, 7]
    e = spark.createDataFrame([([], 0, 0)], "ids array<int>, len int, width int")
    r = e.select(Q.decoder_input(F.col("ids"), 9).alias("d"), Q.mask(F.col("len"), F.col("width")).alias("m")).first()
    assert r.d == [9] and r.m == []


def test_example_filter_bounds(spark):
    unk = 99
    rows = [(1, [1, 2], [1]), (2, [1, 2], [1, 2]), (3, list(range(399)), [1] * 30), (4, list(range(400)), [1, 2]),
            (5, [1, 2], [1] * 31), (6, [unk] * 30 + [1], [1, 2]), (7, [unk] * 31, [1, 2]),
            (8, [1, 2], [unk] * 5 + [1]), (9, [1, 2], [unk] * 6)]
    df = spark.createDataFrame(rows, "id int, t array<int>, s array<int>")
    kept = sorted(r.id for r in df.filter(Q.example_filter(F.col("t"), F.col("s"), unk)).collect())
    assert kept == [2, 3, 6, 8]


def test_batches_drop_partial_and_are_partition_independent(spark):
    df = spark.range(0, 130).select(F.col("id").alias("pair_id"), (F.col("id") % 7).alias("len"))
    a = Q.assign_batches(df.repartition(3), [F.col("len"), F.col("pair_id")], 64).collect()
    b = Q.assign_batches(df.repartition(11), [F.col("len"), F.col("pair_id")], 64).collect()
    key = lambda r: (r.pair_id, r.rn, r.batch_id, r.slot)
    assert sorted(map(key, a)) == sorted(map(key, b))
    assert len(a) == 128 and {r.batch_id for r in a} == {0, 1}
    expect = sorted(range(130), key=lambda i: (i % 7, i))
    assert [r.pair_id for r in sorted(a, key=lambda r: r.rn)] == expect[:128]


def test_global_row_number_dense(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("k"))
    rn = RK.global_row_number(df.repartition(5), [F.col("k")], "rn").collect()
    assert sorted((r.k, r.rn) for r in rn) == [(i, i) for i in range(1000)]


def test_exact_split_sizes_and_disjoint(spark):
    df = spark.range(0, 1001).withColumnRenamed("id", "pair_id")
    parts = M.exact_split(df, "pair_id", 7).groupBy("part").count().collect()
    sizes = {r.part: r["count"] for r in parts}
    assert sizes == {"train": 800, "test": 100, "eval": 101}
    assert M.split_sizes(1001, 0.2, 0.5) == (800, 100, 101)


def test_encode_decode_round_trip(spark):
    vocab = spark.createDataFrame([(0, "a"), (1, "b"), (2, "<UNK>")], "id long, word string")
    docs = spark.createDataFrame([(1, "a b a"), (2, ""), (3, "b zz")], "doc long, text string")
    enc = V.encode_texts(docs, "doc", "text", vocab, 2)
    got = {r.doc: r.ids for r in enc.collect()}
    assert got == {1: [0, 1, 0], 2: [], 3: [1, 2]}
    dec = {r.doc: r.text for r in V.decode_ids(enc, "doc", "ids", vocab).collect()}
    assert dec[1] == "a b a" and dec[2] == "" and dec[3] == "b <UNK>"
    for flag in (True, False):
        assert {r.doc: r.ids for r in V.encode_texts(docs, "doc", "text", vocab, 2, flag).collect()} == got


def test_frequency_vocab_ties_by_first_seen(spark):
    arr = spark.createDataFrame([(0, "b a c a b d".split())], "doc long, toks array<string>")
    v = [(r.id, r.word, r.cnt) for r in V.frequency_vocab(V.word_stats(arr, "doc", [(0, F.col("toks"))]), 3).orderBy("id").collect()]
    assert v == [(0, "UNK", 2), (1, "b", 2), (2, "a", 2)]


def test_special_tokens_in_the_text(spark):
    docs = spark.createDataFrame([(0, "a <UNK> b a <UNK> b UNK <PAD> UNK")], "doc long, text string")
    stats = V.word_stats(docs, "doc", [(0, F.split("text", " "))])
    vocab = V.first_seen_vocab(stats.withColumn("has_vec", F.lit(False)))
    rows = vocab.collect()
    assert len({r.word for r in rows}) == len({r.id for r in rows}) == len(rows)
    unk = V.lookup_id(vocab, "<UNK>")
    ids = V.encode_texts(spark.createDataFrame([(1, "a <UNK> b a <UNK> b")], "doc long, text string"), "doc", "text", vocab, unk).first().ids
    assert len(ids) == 6 and ids[1] == ids[4] == unk
    n = V.unknown_tokens(stats, vocab).first()
    assert (n.word_count, n.unk_count) == (9, 2)  # <UNK> twice; <PAD> and UNK are known words
    freq = V.frequency_vocab(stats, 10).collect()
    assert [r.word for r in freq].count("UNK") == 1 and len({r.id for r in freq}) == len(freq)
    d = spark.createDataFrame([(0, "<GO>", [1.0]), (1, "x", [2.0])], "pos long, word string, vec array<float>")
    v = V.dictionary_vocab(d).collect()
    assert sorted((r.id, r.word) for r in v) == [(0, "<PAD>"), (1, "x"), (2, "<GO>"), (3, "<EOS>")]


def test_batches_keep_the_remainder_on_request(spark):
    df = spark.range(10).select(F.col("id").alias("pair_id"), F.lit("x").alias("payload"))
    assert Q.assign_batches(df, [F.col("pair_id")], 4).count() == 8
    rest = Q.assign_batches(df, [F.col("pair_id")], 4, keep_remainder=True)
    assert sorted((r.batch_id, r.slot) for r in rest.collect())[-2:] == [(2, 0), (2, 1)]


def test_threshold_split_sizes_close(spark):
    df = spark.range(0, 20000).withColumnRenamed("id", "pair_id")
    sizes = {r.part: r["count"] for r in M.threshold_split(df, "pair_id", 5).groupBy("part").count().collect()}
    assert abs(sizes["train"] - 16000) < 400 and abs(sizes["test"] - 2000) < 250 and abs(sizes["eval"] - 2000) < 250
