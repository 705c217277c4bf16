"""Vector files and word-vector jobs: S2, S3, Q11-Q13, F11, T2, W3."""

import os

from pyspark.sql import functions as F

from conftest import FIXTURES
from corpusmill.operators import vectors as VX
from corpusmill.operators import vocab as V
from corpusmill.sources import vectors as SV


def _check(rows):
    d = {r.word: (r.pos, [round(x, 4) for x in r.vec]) for r in rows}
    assert d["the"] == (0, [9.0, 9.0, 9.0])          # first position, last vector
    assert d["unk"] == (1, [0.001, -25.0, 0.0])     # exponent notation
    assert d["café"][0] == 4                         # line position (the repeat of "the" is line 3)


def test_vector_file_utf8_and_latin1(spark):
    _check(SV.read_vector_file(spark, os.path.join(FIXTURES, "vectors.txt")).collect())
    _check(SV.read_vector_file(spark, os.path.join(FIXTURES, "vectors_latin1.txt"), "ISO-8859-1").collect())


def test_dictionary_vocab_specials(spark):
    d = SV.read_vector_file(spark, os.path.join(FIXTURES, "vectors.txt"))
    v = {r.word: (r.id, r.vec) for r in V.dictionary_vocab(d).collect()}
    assert v["<PAD>"][0] == 0 and v["the"][0] == 1 and v["café"][0] == 4
    assert v["<GO>"] == (5, [1.0] * 3) and v["<EOS>"] == (6, [2.0] * 3)


def test_skipgram_golden(spark):
    seqs = spark.createDataFrame([(1, [10, 11, 12, 13])], "doc long, ids array<int>")
    p = sorted((r.center, r.context) for r in VX.skipgram_pairs(seqs, "doc", "ids", 1, 2).collect())
    assert p == [(10, 11), (11, 10), (11, 12), (12, 11), (12, 13), (13, 12)]
    one = VX.skipgram_pairs(seqs, "doc", "ids", 2, 1, seed=3).collect()
    assert len(one) == 4 and all(abs(r.center - r.context) <= 2 for r in one)
    try:
        VX.skipgram_pairs(seqs, "doc", "ids", 1, 3)
        raise AssertionError("num_skips > 2 * window must be refused")
    except ValueError:
        pass


def test_nearest_excludes_self(spark):
    vecs = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (3, [-1.0, 0.0])],
                                 "id long, vec array<float>")
    n = VX.nearest(vecs, vecs.filter(F.col("id") == 0), 2).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.id) for r in n] == [(0, 1, 1), (0, 2, 2)]


def test_negative_samples_range(spark):
    seqs = spark.createDataFrame([(1, list(range(130))), (2, [])], "doc long, ids array<int>")
    s = VX.negative_samples(seqs, "doc", "ids", 100, k=8, centers_per_batch=64).collect()
    assert len(s) == 3 * 8 and all(0 <= r.class_id < 100 for r in s)


def test_pca_matches_numpy(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5)) @ np.diag([5.0, 2.0, 1.0, 0.5, 0.1])
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vec array<double>")
    got = {r.id: (r.x, r.y) for r in VX.project_2d(df).collect()}
    # Spark's PCA projects the raw (uncentred) rows on the covariance's top components
    _, _, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    proj = x @ vt[:2].T
    for k in range(2):
        col = np.array([got[i][k] for i in range(60)])
        assert min(np.abs(col - proj[:, k]).max(), np.abs(col + proj[:, k]).max()) < 1e-6


def test_vector_file_positions_across_part_files(spark, scratch):
    vecs = spark.createDataFrame([(i, f"w{i}", [float(i)]) for i in range(50)], "pos long, word string, vec array<float>")
    path = os.path.join(scratch, "vecs")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # keep several part files
    try:
        SV.write_vector_file(vecs.repartition(4), path)   # range-partitioned: part files in pos order
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len([f for f in os.listdir(path) if f.startswith("part-")]) > 1
    back = {r.word: r.pos for r in SV.read_vector_file(spark, path).collect()}
    assert back == {f"w{i}": i for i in range(50)}


def test_nearest_takes_any_number_of_queries(spark, monkeypatch):
    import numpy as np
    monkeypatch.setattr(VX, "QUERY_BLOCK", 7)
    monkeypatch.setattr(VX, "VECTOR_BLOCK", 11)
    m = np.random.default_rng(4).normal(size=(60, 5))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "id long, vec array<double>").repartition(3)
    got = {(r.query_id, r.rank): r.id for r in VX.nearest(df, df, 3).collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    sim = u @ u.T
    np.fill_diagonal(sim, -2)
    want = np.argsort(-sim, axis=1)[:, :3]
    assert got == {(i, k + 1): int(want[i, k]) for i in range(60) for k in range(3)}


def test_word2vec_knows_every_word_of_long_documents(spark):
    docs = spark.createDataFrame([([f"w{i}" for i in range(2500)],), (["w1", "w2"],)], "words array<string>")
    vecs = VX.train_word2vec(docs, "words", vector_size=4, num_partitions=1)
    assert {r.word for r in vecs.select("word").collect()} == {f"w{i}" for i in range(2500)}


def test_plan_of_nearest_does_not_grow_with_the_queries(spark):
    def plan(n):
        df = spark.range(n).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vec"))
        return VX.nearest(df, df, 2)._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert plan(5) == plan(5000)
    none = spark.createDataFrame([], "id long, vec array<double>")
    one = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], none.schema)
    assert VX.nearest(one, none).collect() == [] and VX.nearest(none, one).collect() == [] and VX.nearest(one, one).collect() == []


def test_negative_draws_do_not_repeat(spark):
    seqs = spark.createDataFrame([(i, list(range(100))) for i in range(30)], "doc long, ids array<int>")
    for vocab, k in ((1000, 16), (20, 16), (16, 16), (5, 5)):   # few classes: later rounds, then the ids left
        got = {}
        for r in VX.negative_samples(seqs, "doc", "ids", vocab, k).collect():
            got.setdefault((r.doc, r.batch), []).append((r.k, r.class_id))
        assert len(got) == 60
        for rows in got.values():
            assert sorted(p for p, _ in rows) == list(range(k)) and len({c for _, c in rows}) == k and all(0 <= c < vocab for _, c in rows)
    try:
        VX.negative_samples(seqs, "doc", "ids", 4, 5)
        raise AssertionError("more classes than there are must be refused")
    except ValueError:
        pass


def topics(spark, n=400):
    """Documents of two topics whose words never meet."""
    import random
    rng = random.Random(1)
    return spark.createDataFrame([(i, [rng.randrange(0, 10) * 2 + i % 2 for _ in range(30)]) for i in range(n)], "id long, ids array<int>")


def test_skipgram_vectors_are_the_same_for_any_partitions(spark):
    import numpy as np

    from corpusmill.operators import skipgram as SG
    t = SG.Training(vocab_size=20, dim=8, negatives=4, batch=16, shards=3, rounds=2)
    docs = topics(spark)
    a, b = (SG.train_skipgram(docs.repartition(n), t) for n in (1, 7))
    assert np.array_equal(a, b) and not np.array_equal(a, SG.first_vectors(t)[0])
    assert np.array_equal(SG.train_skipgram(docs.limit(0), t), SG.first_vectors(t)[0])


def test_skipgram_vectors_know_what_stands_together(spark):
    import numpy as np

    from corpusmill.operators import skipgram as SG
    t = SG.Training(vocab_size=20, dim=16, negatives=6, batch=32, shards=2, rounds=6, rate=2.0)
    v = SG.train_skipgram(topics(spark), t)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sim, same = u @ u.T, np.add.outer(np.arange(20), np.arange(20)) % 2 == 0
    np.fill_diagonal(same, False)
    off = ~same & ~np.eye(20, dtype=bool)
    assert sim[same].mean() > sim[off].mean() + 0.3


def test_skipgram_pairs_and_gradient():
    import numpy as np

    from corpusmill.operators import skipgram as SG
    c, x = SG.pairs_of([np.array([1, 2, 3]), np.array([7]), np.array([4, 5])], 1)
    assert list(zip(c.tolist(), x.tolist())) == [(1, 2), (2, 1), (2, 3), (3, 2), (4, 5), (5, 4)]
    t = SG.Training(vocab_size=9, dim=5, negatives=3, batch=4, rate=1e-3)
    rng = np.random.default_rng(2)
    negatives = SG.distinct_negatives(rng, t)
    assert len(set(negatives.tolist())) == 3 and sorted(SG.distinct_negatives(rng, SG.Training(vocab_size=9, negatives=20)).tolist()) == list(range(9))
    centres, contexts = (a.astype(float) for a in SG.first_vectors(t))
    c, x = np.array([1, 2, 2, 8]), np.array([3, 3, 4, 0])

    def loss(e, w):
        true = (e[c] * w[x, :-1]).sum(axis=1) + w[x, -1] - SG.log_expected(x, t)
        noise = e[c] @ w[negatives, :-1].T + w[negatives, -1] - SG.log_expected(negatives, t)
        return (np.log1p(np.exp(-true)).sum() + np.log1p(np.exp(noise)).sum()) / len(c)

    new = centres.copy(), contexts.copy()
    SG.learn(*new, c, x, negatives, t)
    for table, was, now in ((0, centres, new[0]), (1, contexts, new[1])):
        for i, j in ((1, 0), (2, 3), (3, 1), (0, 2), (int(negatives[0]), was.shape[1] - 1)):
            step = np.zeros_like(was)
            step[i, j] = 1e-5
            both = [(centres + step * s, contexts) if table == 0 else (centres, contexts + step * s) for s in (1, -1)]
            slope = (loss(*both[0]) - loss(*both[1])) / 2e-5
            assert abs((was[i, j] - now[i, j]) / t.rate - slope) < 1e-4


def test_negative_draws_are_those_of_the_stream(spark):
    seqs = spark.createDataFrame([(i, list(range(150))) for i in range(20)] + [(None, [1]), (77, None), (78, [])], "doc long, ids array<int>")
    for vocab, k in ((20000, 64), (70000, 8), (70, 64)):
        key = F.concat_ws(":", F.lit("3"), F.col("doc").cast("string"), F.col("batch").cast("string"))
        draws = F.array_distinct(F.transform(VX.hash_units(key, 64 * k), lambda u: VX.log_uniform(u, vocab)))  # noqa: B023
        rest = F.array_union(draws, F.sequence(F.lit(0).cast("long"), F.lit(vocab - 1).cast("long")))
        s = VX.negative_samples(seqs, "doc", "ids", vocab, k, seed=3)
        got = {(r.doc, r.batch): [x[1] for x in sorted(r.c)] for r in s.groupBy("doc", "batch").agg(F.collect_list(F.struct("k", "class_id")).alias("c")).collect()}
        want = {(r.doc, r.batch): r.c for r in s.select("doc", "batch").distinct().select("doc", "batch", F.slice(rest, 1, k).alias("c")).collect()}
        assert got == want and len(got) == 61
    assert "MapInArrow" in s._jdf.queryExecution().executedPlan().toString()


def test_lookup_sums(spark):
    e = spark.createDataFrame([(1, [0, 1, 1], [2]), (1, [1], None), (None, [3, 9], []), (6, [5, 5], [9]), (4, [], [0, 3])], "pair long, t array<int>, s array<int>").repartition(3)
    m = spark.createDataFrame([(0, 1.0, 0.5), (1, 2.0, None), (2, None, None), (3, float("nan"), 4.0), (5, 1.0, 1.0), (5, 3.0, None)], "id long, a double, b double")
    got = VX.lookup_sums(e, "pair", {"text": "t", "summary": "s"}, m, ["a", "b"])
    assert {(r.pair, r.side): str((r.n, r.a, r.b)) for r in got.collect()} == {
        (1, "text"): "(4, 7.0, 0.5)", (1, "summary"): "(1, None, None)", (None, "text"): "(1, nan, 4.0)", (4, "summary"): "(2, nan, 4.5)",
        (6, "text"): "(4, 8.0, 2.0)"}
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()


def test_skipgram_step_scores_a_word_once_a_batch(monkeypatch):
    import numpy as np

    from corpusmill.operators import skipgram as SG
    t = SG.Training(vocab_size=30, dim=6, negatives=4, batch=128)
    rng = np.random.default_rng(5)
    c, x, negatives = rng.integers(0, 5, 128), rng.integers(2, 9, 128), SG.distinct_negatives(rng, t)
    centres, contexts = (a.astype(float) for a in SG.first_vectors(t))
    new, scored, probability = (centres.copy(), contexts.copy()), [], SG.probability
    monkeypatch.setattr(SG, "probability", lambda score: scored.append(score.size) or probability(score))
    SG.learn(*new, c, x, negatives, t)
    assert sum(scored) == 128 + 5 * 4  # of the pairs, and of each different centre with each negative
    e, true, noise = centres[c], contexts[x], contexts[negatives]
    miss = (1 / (1 + np.exp(-((e * true[:, :-1]).sum(axis=1) + true[:, -1] - SG.log_expected(x, t)))) - 1) / 128
    false = 1 / (1 + np.exp(-(e @ noise[:, :-1].T + noise[:, -1] - SG.log_expected(negatives, t)))) / 128
    np.subtract.at(centres, c, miss[:, None] * true[:, :-1] + false @ noise[:, :-1])
    np.subtract.at(contexts, x, np.c_[miss[:, None] * e, miss])
    contexts[negatives] -= np.c_[false.T @ e, false.sum(axis=0)]
    assert np.allclose(new[0], centres, rtol=0, atol=1e-12) and np.allclose(new[1], contexts, rtol=0, atol=1e-12)


def test_negatives_of_many_batches_are_those_of_one_after_another():
    from itertools import islice

    import numpy as np

    from corpusmill.operators import skipgram as SG
    for size, k in ((20000, 64), (70, 64), (9, 20), (1, 3)):
        t = SG.Training(vocab_size=size, negatives=k)
        one = np.random.default_rng(4)
        for got in islice(SG.all_negatives(np.random.default_rng(4), t), 600):
            assert np.array_equal(got, SG.distinct_negatives(one, t))


def test_skipgram_vectors_stay_bounded_where_few_words_fill_the_text():
    import numpy as np

    from corpusmill.operators import skipgram as SG
    t = SG.Training(vocab_size=2000)
    rng = np.random.default_rng(6)
    tables, draws = [a.copy() for a in SG.first_vectors(t)], SG.all_negatives(rng, t)
    for _ in range(400):
        c, x = (rng.choice([0, 1, 1500], 128, p=[0.7, 0.2, 0.1]) for _ in range(2))
        SG.learn(*tables, c, x, next(draws), t)
    assert all(np.isfinite(a).all() and np.abs(a).max() < 100 for a in tables)
