import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.llm import simhash_dedup as H
from corpusmill.llm.common import components
from helpers import LONG, TEXTS, documents


def plain(text):
    w = [x for x in (text or "").translate({i: i + 32 for i in range(65, 91)}).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ")
         .replace("\x0c", " ").split(" ") if x]
    sh = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@given(st.text(st.sampled_from("aAbÉé \t\n\x0b\x1c .,"), max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert H.fingerprint(text) & (1 << 64) - 1 == plain(text)


def test_hash_is_sparks(spark):
    assert spark.sql("select xxhash64('some words here now')").first()[0] == H.fingerprint("some words here now")


@given(st.lists(st.tuples(st.integers(0, 3), st.lists(st.integers(0, 63), max_size=4)), min_size=2, max_size=14))
@settings(max_examples=25, deadline=None)
def test_every_close_pair_shares_a_variant(spec):
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 2 ** 63, 4, dtype=np.uint64)
    fps = np.unique([int(centre[c]) ^ sum(1 << b for b in set(bits)) for c, bits in spec]).astype(np.uint64)
    keys = []
    for f in fps.tolist():
        own = set()
        for first, n in H.segments(4):
            seg = f >> first & (1 << n) - 1
            own |= {(first + j, seg & ~(1 << j)) for j in range(n)}
        keys.append(own)
    for i, a in enumerate(fps):
        for j, b in enumerate(fps[:i]):
            if np.bitwise_count(a ^ b) <= 4:
                assert keys[i] & keys[j]


def test_links_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 2 ** 64, 30, dtype=np.uint64)
    fps = {0, 2 ** 64 - 1}
    for c in centres.tolist():
        for _ in range(12):
            fps.add(c ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)))
    fps |= {int(centres[0]) ^ b for b in range(300)}  # a crowded run
    u = np.array(sorted(fps), dtype=np.uint64)
    up = list(range(len(u)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[:i] ^ u[i]) <= 4).tolist():
            up[find(i)] = find(j)
    df = spark.createDataFrame([(int(x),) for x in u.view(np.int64)], "fp long").repartition(3)
    got = {r.node: r.component for r in components(H.fingerprint_links(df)).collect()}
    for i, x in enumerate(u.view(np.int64).tolist()):
        for j, y in enumerate(u[:i].view(np.int64).tolist()):
            assert (find(i) == find(j)) == (got.get(x, x) == got.get(y, y))


def test_rows(spark):
    got = H.near_duplicates(documents(spark).repartition(4)).collect()
    assert sorted((r.doc_id or -1, r.fingerprint) for r in got) == sorted((i or -1, f"{plain(t):016x}") for i, t in TEXTS)
    by = {r.doc_id: r.component_id for r in got}
    assert by[2] == by[3] == by[1] == 1 and by[5] == 4 and by[7] == 6 and by[9] == 9
    assert H.near_duplicates(documents(spark).limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    docs = documents(spark, [*TEXTS, (9, "solo"), (9, "another text of the same id, unlike it"), (20, LONG + " tail")])
    kept = H.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, (r.text or "")[:4]) for r in kept.collect()) == [(-1, "no i"), (1, ""), (4, "one "), (6, "w0x0"), (8, "Ünï "), (9, "anot"), (9, "solo")]


def test_components(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    chain = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    more = spark.createDataFrame([(100, 101), (101, 100), (103, 101), (7, 7), (None, 5)], "a long, b long")
    got = {r.node: r.component for r in components(chain.unionByName(more)).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in (100, 101, 103)} == {100}


def test_clashing_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x", "y"), (2, "a b c d e f", "z", "w"), (3, "q r s t u v w", "k", "l")], "doc_id long, text string, `__row` string, `__c0` string")
    kept = H.keep_one_per_group(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [(1, "a b c d e f", "x", "y"), (3, "q r s t u v w", "k", "l")]


def test_few_texts_of_a_batch_are_python_strings_at_a_time():
    import tracemalloc

    import pyarrow as pa
    texts = pa.array([None, "", *("x" * 10_000 + f" {i}" for i in range(2000))], pa.string())
    tracemalloc.start()
    got = H.fingerprints(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == [H.fingerprint(t) for t in texts.to_pylist()]
    assert peak < texts.nbytes / 3
