"""Lookups bucket by bucket: rows with the same or no id, and plans that do not take every token apart."""

from pyspark.sql import functions as F

from corpusmill.operators import vocab as V


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_encode_of_repeated_and_missing_ids(spark):
    docs = spark.createDataFrame([(1, "b a", "x"), (1, "c c  a", None), (None, "a", ""), (None, None, "b"), (3, None, None), (4, " a zz b ", "a")],
                                 "doc long, t string, s string").repartition(3)
    vocab = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "id long, word string")
    want = {1: ([1, 2, 0, 2, 0], [9]), None: ([0], [1]), 3: ([], []), 4: ([0, 9, 1], [0])}
    for flag in (None, True, False):
        got = V.encode_many(docs, "doc", ["t", "s"], vocab, 9, flag)
        assert {r.doc: (r.t_ids, r.s_ids) for r in got.collect()} == want
    words = V.decode_many(got, "doc", ["t_ids", "s_ids"], vocab)
    assert {r.doc: (r.t_ids, r.s_ids) for r in words.collect()} == {1: ("b c a c a", ""), None: ("a", "b"), 3: ("", ""), 4: ("a  b", "a")}


def test_words_of_a_bucket_are_looked_up_once(spark):
    docs = spark.createDataFrame([(i, "the a the b") for i in range(500)], "doc long, text string")
    vocab = spark.createDataFrame([(0, "a"), (1, "the")], "id long, word string")
    got = V.encode_many(docs, "doc", ["text"], vocab, 2, False)
    assert {tuple(r.text_ids) for r in got.collect()} == {(1, 0, 1, 2)} and got.count() == 500
    assert "FlatMapCoGroupsInArrow" in plan(got) and "posexplode" not in plan(got).lower()


def test_texts_of_a_bucket_are_shuffled_once_and_whole(spark):
    docs = spark.createDataFrame([(i, f"w{i} the a") for i in range(200)], "doc long, text string")
    vocab = spark.createDataFrame([(0, "a"), (1, "the")], "id long, word string")
    got = V.encode_many(docs, "doc", ["text"], vocab, 2, False)
    assert {tuple(r.text_ids) for r in got.collect()} == {(2, 1, 0)}
    final = plan(got).split("Initial Plan")[0]
    assert "ReusedExchange" in final and "split(" not in final
    assert "split(" not in plan(V.word_stats(docs, "doc", [(0, F.col("text"))]))


def test_words_of_texts_are_those_of_token_arrays(spark):
    import pyarrow as pa

    from corpusmill.functions.text import ws_tokens
    from corpusmill.operators import buckets as BU
    texts = [None, "", " ", "one", *(f"{chr(c)}a{chr(c)}{chr(c)}b {c}" for c in [*range(1, 0xD800), *range(0xE000, 0x10000), 0x1F600])]
    want = [r.t for r in spark.createDataFrame([(t,) for t in texts], "t string").select(ws_tokens(F.col("t")).alias("t")).collect()]
    items, lengths = BU.items_of(pa.chunked_array([texts[:7], texts[7:]], pa.string()))
    assert items.to_pylist() == [w for ws in want for w in ws or []] and lengths.tolist() == [len(ws or []) for ws in want]
    rows = [(d, t) for d, t in enumerate(["b a\u2003b", None, "c\x1ca", ""])]
    df = spark.createDataFrame(rows, "doc long, t string")
    stats = [sorted(V.word_stats(df, "doc", [(0, c)]).collect()) for c in (F.col("t"), ws_tokens(F.col("t")))]
    assert stats[0] == stats[1] and len(stats[0]) == 3


def test_word_stats_counts_before_the_shuffle(spark):
    docs = spark.createDataFrame([(5, ["x", "y", "x"], ["z"]), (2, None, ["z", "x"]), (None, ["n", "y"], []), (2, ["q", "y"], None)],
                                 "doc long, a array<string>, b array<string>")
    stats = V.word_stats(docs, "doc", [(0, F.col("a")), (1, F.col("b"))])
    got = {r.word: (r.cnt, r.cnt0, r.cnt1, tuple(r.first)) for r in stats.collect()}
    assert got == {"x": (3, 2, 1, (0, 5, 0)), "y": (3, 3, 0, (0, 2, 1)), "z": (2, 0, 2, (1, 2, 0)), "q": (1, 1, 0, (0, 2, 0)), "n": (1, 1, 0, (1, None, None))}
    assert "Generate" not in plan(stats)


def test_ngrams_of_repeated_and_missing_ids(spark):
    from corpusmill.operators import scores as SC
    rows = [(1, "a b a b".split(), "a b c".split()), (1, ["a", "b"], ["a", "b"]), (2, [], ["a"]), (3, None, None), (None, ["x", "y"], ["x", "y", "x y"]), (4, ["p q", "r"], ["p", "q r"])]
    df = spark.createDataFrame(rows, "id long, c array<string>, r array<string>").repartition(3)
    got = SC.clipped_counts(df, "id", "c", "r", [1, 2, 3])
    assert {(r.id, r.n): (r.overlap, r.cand_total, r.ref_total) for r in got.collect()} == {
        (1, 1): (4, 6, 5), (1, 2): (2, 4, 3), (1, 3): (0, 2, 1), (2, 1): (0, 0, 1), (2, 2): (0, 0, 0), (2, 3): (0, 0, 0), (3, 1): (0, 0, 0), (3, 2): (0, 0, 0),
        (3, 3): (0, 0, 0), (None, 1): (2, 2, 3), (None, 2): (1, 1, 2), (None, 3): (0, 0, 1), (4, 1): (0, 2, 2), (4, 2): (1, 1, 1), (4, 3): (0, 0, 0)}
    # All orders from one shuffle of whole pairs.
    first = plan(got).split("Initial Plan")[0]
    assert "Generate" not in first and first.count("Exchange hashpartitioning") == 1


def test_rows_subtracted_as_subtract_at_does():
    import numpy as np

    from corpusmill.operators import skipgram as SG
    rng = np.random.default_rng(1)
    for width in (1, 7, 129):
        table = rng.standard_normal((40, width), dtype=np.float32)
        rows, change = rng.integers(0, 9, 300), rng.standard_normal((300, width + 1), dtype=np.float32)[:, :-1]
        want = table.copy()
        np.subtract.at(want, rows, change)
        SG.subtract_rows(table, rows, change)
        assert np.array_equal(table, want)


def test_texts_over_their_limits_are_not_shuffled(spark):
    import random
    rng = random.Random(3)
    rows = [(1, "a b", "a"), (1, "a b a", "b"), (2, "a  b c ", "a"), (3, "a b c a", "a"), (4, None, None), (5, "a", "b a a"), (None, "a", None), (None, "c c c c c", "b"),
            (6, "", "a"), (7, "a bb ccc", "b a")]
    rows += [(rng.randrange(8, 300), " ".join(rng.choices(["a", "b", "zz"], k=rng.randrange(7))), " ".join(rng.choices("ab", k=rng.randrange(4)))) for _ in range(400)]
    docs = spark.createDataFrame(rows, "doc long, t string, s string").repartition(3)
    vocab = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "id long, word string")
    # An id with a longer row goes; several rows of an id may be longer together, which is for the filter behind.
    fits = (F.size("t_ids") <= 3) & (F.size("s_ids") <= 2)
    want = V.encode_many(docs, "doc", ["t", "s"], vocab, 9, False).where(fits)
    got = V.encode_many(docs, "doc", ["t", "s"], vocab, 9, False, limits={"t": 3, "s": 2})
    assert sorted(map(str, got.where(fits).collect())) == sorted(map(str, want.collect()))
    assert {1, 2, 4, 6, 7} <= {r.doc for r in got.collect()} and not {3, 5, None} & {r.doc for r in got.collect()}
    from corpusmill.operators import buckets as BU
    before, seen = BU.bucketed, []
    try:
        V.bucketed = lambda df, *a: seen.append(df) or before(df, *a)
        V.encode_many(docs, "doc", ["t", "s"], vocab, 9, False, limits={"t": 3, "s": 2})
    finally:
        V.bucketed = before
    assert {(r.doc, r.t, r.s) for r in seen[0].where("doc in (3, 5)").collect()} == {(3, None, None), (5, None, None)}


def test_examples_too_long_for_p9_are_not_encoded(spark):
    import tempfile

    from corpusmill.operators import sequences as Q
    from corpusmill.plans import q_sequences as S
    folder = tempfile.mkdtemp(prefix="corpusmill-test-")
    words = [(i, "a b " + "c " * 5 + "\n" + "a b " * n + "c") for i, n in enumerate([1, 198, 199, 200, 300])]
    words += [(9, "a " * n + "\na b") for n in (2,)] + [(10, "a " * 30 + "\na b"), (11, "a " * 31 + "\na b"), (12, "a b\na b"), (12, "a b\n" + "b " * 399), (13, "a b\na b"), (13, "a b\n" + "b " * 397)]
    spark.createDataFrame(words, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    ex, sp = S.encoded_examples(spark, folder)
    want = ex.filter(Q.example_filter(F.col("t"), F.col("s"), sp["<UNK>"])).collect()
    kept, _ = S.kept_examples(spark, folder)
    got = kept.collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and {r.pair_id for r in got} == {0, 1, 9, 10}
    assert {r.pair_id for r in S.encoded_examples(spark, folder, limits={"text": Q.MAX_TEXT_LENGTH - 2, "summary": Q.MAX_SUMMARY_LENGTH})[0].collect()} == {0, 1, 9, 10, 13}
