"""Operator 11 against numpy over all rows."""

import math

import numpy as np
import pytest

from corpusmill.llm import vector_whitening as W

SCHEMA = "vec_id long, embedding array<double>, label int, key string, whitened string"


def rows_of(vectors):
    return [(i, v, 0, "k", "w") for i, v in vectors]


def frame(spark, vectors):
    return spark.createDataFrame(rows_of(vectors), SCHEMA)


def brute(vectors, components=8, once=False):
    """``{(vec_id, place): (deviation, whitened by component)}`` and the eigenvalues' shares."""
    ok = [(i, v) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for _, v in ok], dtype=object)
    fit = np.unique(x.astype(np.int64), axis=0).astype(object) if once else x
    n, s = len(fit), fit.sum(axis=0)
    y = (fit - s / n).astype(float)
    v = y.T @ y / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    dev = [int(sum((n * a - b) ** 2 for a, b in zip(r, s))) for r in x]
    white = ((x - s / n).astype(float) @ q) / np.sqrt(e)
    return [i for i, _ in ok], n, dev, white, e / np.trace(v)


def check(got, vectors, components=8, once=False):
    ids, n, dev, white, share = brute(vectors, components, once)
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in got) == sorted((i is None, i or 0, k + 1) for i in ids for k in range(len(share)))
    by = {i: (d, w) for i, d, w in zip(ids, dev, white)}
    signs = {}
    for r in got:
        d, w = by[r.vec_id]
        assert r.n == n and r.deviation == d
        assert abs(r.explained - share[r.component - 1]) <= 1e-9 and r.identity_error <= 1e-9
        if abs(w[r.component - 1]) > 1e-6:
            signs.setdefault(r.component, set()).add(round(float(r.whitened / w[r.component - 1]), 6))
    assert all(s in ({1.0}, {-1.0}) for s in signs.values()) and len(signs) == len(share)


def vectors(n=300, dim=12):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((n, dim)) * np.linspace(0.1, 1, dim)
    base[n // 3:2 * n // 3] = base[0]  # one vector with a third of all rows
    return [(i, v.tolist()) for i, v in enumerate(base)]


def test_whitening_equals_numpy(spark):
    rows = vectors() + [(1000, None), (1001, []), (1002, [None] * 12), (1003, [float("nan")] * 12), (1004, [float("inf")] + [0.0] * 11), (7, vectors()[7][1])]
    check(W.whiten(frame(spark, rows)).collect(), rows)


def test_weights_of_one_fit_on_distinct_vectors(spark):
    rows = vectors()
    check(W.whiten(frame(spark, rows), weights="one", components=3).collect(), rows, 3, once=True)
    with pytest.raises(ValueError):
        W.whiten(frame(spark, rows), weights="rows")


def test_no_variance_no_rows_and_other_lengths_go(spark):
    assert W.whiten(frame(spark, [])).collect() == []
    assert W.whiten(frame(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])])).collect() == []
    assert W.whiten(frame(spark, [(1, None)])).collect() == []
    rows = [(1, [0.1, 0.2]), (2, [0.3, -0.2]), (None, [0.5, 0.9]), (4, [1.0, 2.0, 3.0])]
    check(W.whiten(frame(spark, rows)).collect(), rows[:3])


def test_huge_entries_are_cut_and_wide_deviations_null(spark):
    rows = [(1, [1e300, 0.0]), (2, [0.0, 1.0]), (3, [-1e300, 2.0])]
    got = W.whiten(frame(spark, rows)).collect()
    assert {r.deviation for r in got} == {None, } | {r.deviation for r in got if r.vec_id == 2}
    assert all(math.isfinite(r.whitened) for r in got)


def test_sums_beyond_64_bits_are_exact():
    import pyarrow as pa
    x = np.array([[1 << 52, -(1 << 52)]] * 5000, dtype="<i8")
    batch = pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), pa.array([1 << 10] * 5000, pa.int64())], ["x", "weight"])
    total = next(W._exact_sums(iter([batch]))).column("total").to_pylist()
    assert list(map(int, total)) == [(1 << 62) * 5000, -(1 << 62) * 5000]


def test_query_equals_numpy(spark, testdata="/root/testdata/sf0.001"):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{testdata}/embeddings.parquet").collect()]
    check(W.op11_vector_whitening(spark, testdata).collect(), rows)
