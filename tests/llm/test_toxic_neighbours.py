import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import toxic_neighbours as N
from helpers import documents


def corpus(spark, n=400):
    rng = np.random.default_rng(3)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe") for b in ("ra", "se", "ti", "vo", "zu", "ba")]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        text = rng.choice(words, 20).tolist() + (rng.choice(["moron", "scumbag", "vileness"], 2).tolist() if toxic else [])
        rows.append((i, " ".join(rng.permutation(text))))
        labels.append((i, int(toxic)))
    return rows, spark.createDataFrame([(a, b, "x") for a, b in labels], "doc_id long, toxic int, score string")


def index(n=60, terms=8, block=4, seed=0, common=3):
    rng = np.random.default_rng(seed)
    tf = rng.integers(0, 6, (n, terms)) * (rng.random((n, terms)) < 0.4)
    tf[tf.sum(axis=1) == 0, 0] = 1
    idf = np.round(rng.random(terms) + 0.5, 1)
    m = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * idf
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    t, e = np.nonzero(tf.T)
    arrays = dict(N.layout([f"t{i}" for i in range(terms)], idf, t, e, tf.T[t, e], np.zeros(n), np.arange(n), block, common))
    return m, arrays | {"base": 0.3, "block": block, "slope": 1.0, "shift": 0.0}


@given(st.integers(0, 10 ** 6), st.integers(1, 20), st.integers(0, 8))
@settings(max_examples=150, deadline=None)
def test_block_max_search_is_exact(seed, k, common):
    m, ix = index(seed=seed, common=common)
    rng = np.random.default_rng(seed + 1)
    texts = [(np.sort(rng.choice(8, rng.integers(1, 6), replace=False)), int(rng.integers(-1, 60))) for _ in range(4)]
    row = np.repeat(np.arange(4), [len(t) for t, _ in texts])
    v = N.Vectors(4, row, np.concatenate([t for t, _ in texts]), rng.random(len(row)) + 0.01)
    got = N.NearestExamples(ix).nearest(v, k, np.array([own for _, own in texts]))
    for (t, own), (a, b), (place, cos) in zip(texts, zip(v.start, v.start[1:]), got):
        exact = m[:, t] @ v.weight[a:b]
        exact[own if own >= 0 else len(m):][:1] = 0
        want = np.lexsort((np.arange(len(m)), -np.round(exact, 12)))[:k]
        want = want[exact[want] > 0]
        assert np.allclose(cos, exact[want]) and np.allclose(exact[place], cos)


def test_bounds_are_never_below_a_weight():
    for seed in range(20):
        m, ix = index(seed=seed)
        top = ix["top"].astype(float) * ix["unit"][0]
        assert (top + 1e-6 >= np.array([[m[b:b + 4, j].max() for b in range(0, 60, 4)] for j in range(8)])).all()


def test_scale_is_fitted_and_rises():
    rng = np.random.default_rng(1)
    p = rng.random(5000)
    toxic = (rng.random(5000) < 1 / (1 + np.exp(-(3 * np.log(p / (1 - p)) - 1)))).astype(int)
    slope, shift = N.logistic(p, toxic)
    assert abs(slope - 3) < 0.3 and abs(shift + 1) < 0.3
    at = [N.scaled(x, slope, shift) for x in np.linspace(0, 1, 50)]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    assert N.logistic(p, 1 - toxic) == (1.0, 0.0) and N.scaled(0.3, 1.0, 0.0) == 0.3


def test_held_out_accuracy_and_folds(spark):
    rows, labels = corpus(spark)
    extra = [(1000, None), (1001, ""), (1002, "unknown words only"), (None, "moron scumbag"), (1003, "moron " * 50_000), (5, "MORON, scumbag!"), (5, "MORON, scumbag!")]
    got = N.toxicity(documents(spark, rows + extra), labels).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [by[i] for i, _ in rows if by[i].held_out and i != 5]
    assert len(held) > 80 and all(r.predicted == (r.doc_id % 4 == 0) for r in held)
    assert by[1000].score == by[1001].score == by[1002].score and by[1002].evidence == [] and by[1002].predicted == 0
    assert by[None].predicted == by[1003].predicted == by[5].predicted == 1 and 0 <= min(r.score for r in got) <= max(r.score for r in got) <= 1
    assert not any(zlib.crc32(str(e.doc_id).encode()) % 3 == 1 for r in got for e in r.evidence)


def test_scores_ignore_ids_and_other_columns(spark):
    rows, labels = corpus(spark)
    ix = N.fit(documents(spark, rows), labels)
    a = N.score_texts(documents(spark, [(1, "moron kara"), (2, "kara")]), ix, ["doc_id"]).orderBy("doc_id").collect()
    b = N.score_texts(documents(spark, [(7, "moron kara"), (8, "kara")], source=lambda i: "z"), ix, ["doc_id"]).orderBy("doc_id").collect()
    assert [r.score for r in a] == [r.score for r in b]


def test_filter_keeps_clean_rows_whole(spark):
    rows, labels = corpus(spark)
    docs = documents(spark, rows)
    kept = N.without_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, _ in rows if i % 4}


def test_no_labels_and_empty(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert {r.score for r in N.toxicity(docs, labels).collect()} == {0.5}
    assert N.toxicity(docs.limit(0), labels).count() == 0
    rows, labels = corpus(spark, 40)
    assert len(N.opened(N.fit(documents(spark, rows), labels, max_examples=10))["doc_id"]) <= 20


def test_every_labelled_text_is_an_example_and_ordinary_words_count(spark):
    rng = np.random.default_rng(5)
    words = [f"w{a}{b}" for a in "abcdefgh" for b in "klmnopqr"]
    pair = ("wak", "wbl")  # toxic only together; each alone is as common among clean texts
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        has = pair if toxic else rng.permutation(pair)[:1] if i % 5 < 4 else ()
        rows.append((i, " ".join([*rng.choice(words[20:], 3), *has])))
        labels.append((i, int(toxic)))
    ix = N.fit(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), block=64)
    ix = N.opened(ix)
    trained = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1}
    assert set(ix["doc_id"].tolist()) == trained and set(np.unique(ix["toxic"])) == {0.0, 1.0}
    search = N.NearestExamples(ix)
    assert {w for i, t in rows if i in trained for w in t.split()} <= set(search.terms.to_pylist())
    score, evidence = search.score("wak wbl")
    assert score > search.score("wak")[0] and score > search.score("wbl")[0] and all(e["toxic"] for e in evidence)
    score, evidence = search.score("wgk whl")
    assert len(evidence) == 3 and evidence[0]["toxic"] == 0 and score != search.score("")[0] and score < N.THRESHOLD
    texts = [t for _, t in rows[:40]] + ["", None, "zzz"]
    assert search.scores(texts) == [search.score(t) for t in texts]
    clean = spark.createDataFrame([(1, "ka lo"), (2, "lo mi")], "doc_id long, text string")
    got = N.toxicity(clean, spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")).collect()
    assert {r.score for r in got} == {0.0}


def test_terms_are_counted_some_texts_at_a_time():
    import pyarrow as pa
    n = 3 * N.COUNTED + 1
    b = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([0] * n, pa.int32()), pa.array(range(n)), pa.array([f"word w{i}" for i in range(n)])], ["doc_id", "toxic", "row", "text"])
    got = list(N._terms(iter([b])))
    assert [x.num_rows for x in got] == [N.COUNTED] * 3 + [1]
    assert [r for x in got for r in x["doc_id"].to_pylist()] == list(range(n)) and all("word" in t for x in got for t in x["terms"].to_pylist())


def test_few_texts_of_a_batch_are_python_strings_when_scored():
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    from corpusmill.llm import toxic_neighbours as T
    texts = [f"{i} " + "x" * 4000 for i in range(6000)]
    batch = pa.record_batch([pa.array(range(6000), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))
    search = SimpleNamespace(scores=lambda some: [(int(t.split()[0]) / 6000, []) for t in some])
    run = T._scored(SimpleNamespace(value={"search": search}), pa.schema([("score", pa.float64()), ("evidence", kind)]), ["doc_id"])
    del texts
    seen = []
    tracemalloc.start()
    for out in run(iter([batch])):
        seen += zip(out.column("doc_id").to_pylist(), out.column("score").to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == [(i, round(i / 6000, 6)) for i in range(6000)]
    assert peak < batch.nbytes / 2


def test_words_found_by_code_points_are_those_of_the_pattern():
    import pyarrow as pa
    texts = ["Ünï_çödé ΟΔΟΣ Σ İstanbul 4abc5 a1b ²x٣y", None, "", "  ", "中文字 𝒳yz \U0001f600no ẞß ab abcd abcde abcdef", "x" * 3000 + " x", "moron\nmoron Moron's", "tail"]
    words = sorted({w for t in texts for w in N._WORD.findall((t or "").lower())})
    names = sorted({x for w in words for x in N.terms_of(w)})
    size = len(names)
    arrays = dict(N.layout(names, np.arange(size) + 1.0, np.arange(size), np.zeros(size, dtype=np.int64), np.ones(size, dtype=np.int64), np.zeros(1), np.zeros(1, dtype=np.int64), 4))
    search = N.NearestExamples(arrays | {"base": 0.5, "block": 4, "slope": 1.0, "shift": 0.0})
    n = len(texts)
    b = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([0] * n, pa.int32()), pa.array(range(n)), pa.array(texts)], ["doc_id", "toxic", "row", "text"])
    counted = next(iter(N._terms(iter([b]))))
    a, c = search.vectors(texts), search.vectors_of_terms(counted["terms"], counted["tf"])
    assert (a.row == c.row).all() and (a.term == c.term).all() and (a.weight == c.weight).all()
    assert [names[i] for i in a.term[a.row == 4]] == sorted({x for w in N._WORD.findall(texts[4].lower()) for x in N.terms_of(w)})
    assert search.vectors([None, ""]).rows == 2 and len(search.vectors([]).row) == 0
    some = pa.array(["skipped", *words, "skipped"]).slice(1, len(words))
    assert len(set(N._hashes_of(some).tolist())) == len(words) and (N._hashes_of(some) == [N._hashes_of(pa.array([w]))[0] for w in words]).all()
    assert (search._ids(pa.array(["nowhere", *names])) == [-1, *range(size)]).all()
