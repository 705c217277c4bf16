import numpy as np
import pytest

from corpusmill.llm import subspace_join as J


def brute(rows, c):
    def good(v):
        return v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and any(v)
    n = len(rows)
    links, up = [0] * n, list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(n):
        for j in range(i):
            a, b = rows[i][1], rows[j][1]
            if good(a) and good(b) and len(a) == len(b) and np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)) >= c:
                links[i] += 1
                links[j] += 1
                up[find(i)] = find(j)
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if find(j) == find(i) and rows[j][0] is not None]
        least = rows[i][0] if not good(rows[i][1]) else min(ids, default=None)
        yield rows[i][0], links[i], least, rows[i][0] == least


def near(x, eps, rng):
    return (x + rng.standard_normal(len(x)) * eps).tolist()


@pytest.mark.parametrize("chunk, dim", [(4096, 64), (8, 64), (5, 3), (16, 1)])
def test_against_brute_force(spark, chunk, dim):
    rng = np.random.default_rng(dim)
    centres = rng.standard_normal((12, dim))
    rows = [(i, near(centres[i % 12], 0.25, rng)) for i in range(150)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), (201, rows[3][1]), (202, (np.array(rows[5][1]) * 7.5).tolist()), (None, rows[9][1]),
             (300, None), (301, [0.0] * dim), (302, [float("nan")] + [1.0] * (dim - 1)), (303, [float("inf")] * dim), (304, [None] + [1.0] * (dim - 1)),
             (305, []), (None, None), (306, [1.0] * (dim + 1)), (307, [1.0] * (dim + 1)), (308, [1e300] * dim), (309, [1e-300] * dim)]
    df = spark.createDataFrame([(i, v, 0, "k") for i, v in rows], "vec_id long, embedding array<double>, n_links int, key string").repartition(3)
    scaled = [(i, v if v is None or not len(v) or None in v or not np.isfinite(v).all() or not any(v) else (np.array(v) / np.abs(v).max()).tolist()) for i, v in rows]
    got = [tuple(r) for r in J.near_duplicates(df, chunk=chunk).collect()]
    assert sorted(got, key=str) == sorted(brute(scaled, 0.9), key=str)


def test_empty(spark):
    df = spark.createDataFrame([(1, None)], "vec_id int, embedding array<float>")
    assert J.near_duplicates(df.limit(0)).count() == 0
    assert [tuple(r) for r in J.near_duplicates(df).collect()] == [(1, 0, 1, True)]


def test_no_vector_is_copied_to_the_cells_it_meets(spark, monkeypatch):
    plans = {}

    def written(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return kept(df, label)

    kept = J.written
    monkeypatch.setattr(J, "written", written)
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, rng.standard_normal(64).tolist()) for i in range(300)], "vec_id long, embedding array<float>")
    assert J.near_duplicates(df, chunk=64).where("kept and n_links = 0").count() == 300
    assert "MapInArrow" in plans["vector-links"] and "Exchange" not in plans["vector-links"]


def test_one_large_group_of_near_copies(spark):
    rng = np.random.default_rng(2)
    centre, other = rng.standard_normal(64), rng.standard_normal(64)
    df = spark.createDataFrame([(i, near(centre if i < 400 else other, 0.01, rng)) for i in range(500)], "vec_id long, embedding array<float>")
    got = {tuple(r)[1:] for r in J.near_duplicates(df, chunk=32).where("not kept").collect()}
    assert got == {(399, 0, False), (99, 400, False)}
