"""Operator 11, embedding whitening by a weighted covariance of the distinct vectors.

1. Every usable vector is put on an integer grid; equal grid vectors form one class, told apart by SHA-256,
   with its number of rows.
2. Tasks add up the classes' sums, then the products of the centred classes, each class weighted by its rows (or
   by one), as one matrix product per batch; only a ``dim x dim`` matrix reaches the driver.
3. Each class is projected on the largest eigenvectors once, and rows take the result of their class by its
   digest.  Classes with a thousandth of all rows or more (a thousand at most) are joined by broadcast, so that no
   task gets a class' rows; all others by shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import table, written

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
HOT_SHARE = 1000  # classes with a thousandth of all rows: at most a thousand of them
EXACT = 1 << 53  # grid values beyond it are cut to it
ROWS = 4096
FLAT = 1e-12  # a component below this share of the variance is rounding only


def on_grid(c: np.ndarray) -> np.ndarray:
    """``floor(SCALE * c) + SHIFT`` as 64-bit integers."""
    return np.clip(np.floor(SCALE * c.astype(float)) + SHIFT, -EXACT, EXACT).astype(np.int64)


def _grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, keys, packed, dims = [], [], [], []
        vectors = b.column("embedding")
        for i, (v, known) in enumerate(zip(vectors, vectors.is_valid().to_pylist())):
            values = v.values if known else None
            if values is None or not len(values) or values.null_count:
                continue
            c = values.to_numpy(zero_copy_only=False)
            if np.isfinite(c).all():
                x = on_grid(c).astype("<i8").tobytes()
                ids.append(i)
                keys.append(hashlib.sha256(x).digest())
                packed.append(x)
                dims.append(len(c))
        yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(ids, pa.int64())), pa.array(keys, pa.binary()),
                                          pa.array(packed, pa.binary()), pa.array(dims, pa.int32())], ["vec_id", "key", "x", "dim"])


def _matrix(b: pa.RecordBatch, column: str, kind: str) -> np.ndarray:
    """The packed vectors of a batch as rows."""
    return np.frombuffer(b"".join(b.column(column).to_pylist()), dtype=kind).reshape(b.num_rows, -1)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for a in range(0, b.num_rows, ROWS):
            yield b.slice(a, ROWS)


def _exact_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(i, total)``: per dimension the weighted sum of a task's classes, as text of any length."""
    total = None
    for b in _slices(batches):
        x, w = _matrix(b, "x", "<i8"), b.column("weight").to_numpy()
        # In two halves no sum of a batch can leave 64 bits.
        part = [int(h) * (1 << 27) + int(low) for h, low in zip((x >> 27).astype(object).T @ w.astype(object), (x & ((1 << 27) - 1)).astype(object).T @ w.astype(object))] \
            if int(np.abs(x).max()) * int(w.sum()) >= 1 << 62 else (w @ x).tolist()
        total = part if total is None else [a + c for a, c in zip(total, part)]
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(map(str, total), pa.string())], ["i", "total"])


def _centred(column: str, kind: str, mean: np.ndarray):
    """``(i, j, total)``: sums of products of a task's centred classes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(mean), len(mean)))
        for b in _slices(batches):
            y = _matrix(b, column, kind) - mean
            total += (y * b.column("weight").to_numpy()[:, None]).T @ y
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], ["i", "j", "total"])
    return run


def covariance(classes: DataFrame, column: str, kind: str, mean: np.ndarray, n: int) -> np.ndarray:
    """Covariance (divisor ``n``) of the packed vectors of ``classes``, centred before multiplying."""
    parts = classes.select(column, "weight").mapInArrow(_centred(column, kind, mean), "i int, j int, total double")
    out = np.zeros((len(mean), len(mean)))
    for i, j, v in parts.groupBy("i", "j").agg(F.sum("total")).collect():  # one row per pair of dimensions
        out[i, j] = v / n
    return (out + out.T) / 2


def eigen(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of ``v`` and their unit vectors as columns; none without variance."""
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    real = e > FLAT * max(float(np.trace(v)), 0.0)
    e, q = e[real], q[:, real]
    return e, q * np.where(q[np.abs(q).argmax(axis=0), range(len(e))] < 0, -1.0, 1.0)


def _whiten(n: int, sums: list[int], axes: np.ndarray, count: int):
    mean = np.array([s / n for s in sums])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            x = _matrix(b, "x", "<i8")
            wide = max(int(np.abs(x).max()) * n, max(map(abs, sums)))
            if 2 * wide < 1 << 62:
                d = n * x - np.array(sums, dtype=np.int64)
                centred = d / n
            else:
                d = n * x.astype(object) - np.array(sums, dtype=object)
                centred = x - mean
            if float(np.abs(d).max()) ** 2 * d.shape[1] < 1 << 62:
                deviation = (d * d).sum(axis=1).tolist()
            else:
                deviation = [s if s < 1 << 63 else None for s in (sum(int(v) ** 2 for v in row) for row in d)]
            y = np.ascontiguousarray(centred.astype(float) @ axes)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("count"), b.column("weight"), pa.array(deviation, pa.int64()),
                                              pa.array([r.tobytes() for r in y], pa.binary()), pa.array(list(y), pa.list_(pa.float64()))],
                                             ["key", "count", "weight", "deviation", "packed", "whitened"])
    return run


def whiten(rows: DataFrame, components: int = COMPONENTS, weights: str = "count") -> DataFrame:
    """Whitened grid vectors of ``rows (vec_id, embedding)``.

    ``weights="count"`` fits on all rows, ``"one"`` on each distinct vector once; ``n`` and the sums are those of
    the fit list.  Returns per usable row and component ``vec_id, component, n, deviation, whitened, explained,
    identity_error``.

    Vectors that are null or empty or hold null or non-finite entries are dropped, and so are vectors whose length is not
    the most frequent one (ties: the longer).  Grid values are cut to +-2^53; a deviation beyond 64 bits is
    null.  Components without variance are left out, so one distinct vector alone gives no rows, nor does an
    empty table.  Repeated rows and null ids give rows like any other.
    """
    if weights not in ("count", "one"):
        raise ValueError(f"weights={weights!r}")
    spark = rows.sparkSession
    grid = rows.select("vec_id", "embedding").mapInArrow(_grid, f"vec_id {dict(rows.dtypes)['vec_id']}, key binary, x binary, dim int")
    keys = written(grid.select("vec_id", "key", "dim"), "whiten-rows")
    sizes = keys.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    schema = f"vec_id {dict(rows.dtypes)['vec_id']}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim, total = sizes
    keys = keys.where(F.col("dim") == dim).select("vec_id", "key")
    weight = F.col("count") if weights == "count" else F.lit(1).cast("long")
    classes = written(grid.where(F.col("dim") == dim).groupBy("key").agg(F.count(F.lit(1)).alias("count"), F.first("x").alias("x"))
                      .withColumn("weight", weight), "whiten-classes")
    n = classes.agg(F.sum("weight")).first()[0]
    sums = [0] * dim
    for i, s in classes.select("x", "weight").mapInArrow(_exact_sums, "i int, total string").groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)"))).collect():
        sums[i] = int(s)
    v = covariance(classes, "x", "<i8", np.array([s / n for s in sums]), n)
    e, q = eigen(v, components)
    if not len(e):
        return spark.createDataFrame([], schema)
    done = written(classes.mapInArrow(_whiten(n, sums, q / np.sqrt(e), len(e)),
                                      "key binary, count long, weight long, deviation long, packed binary, whitened array<double>"), "whiten-classes-done")
    means = done.agg(*[F.sum(F.col("weight") * F.element_at("whitened", i + 1)).alias(f"m{i}") for i in range(len(e))]).first()
    error = float(np.abs(covariance(done, "packed", "<f8", np.array([m / n for m in means]), n) - np.eye(len(e))).max())

    parts = done.select("key", "deviation", "whitened", (F.col("count") * HOT_SHARE >= total).alias("hot"))
    hot = parts.where("hot").drop("hot")  # at most HOT_SHARE rows
    cold = keys.join(F.broadcast(hot.select("key")), "key", "left_anti").join(parts.where("not hot").drop("hot").hint("shuffle_hash"), "key")
    joined = keys.join(F.broadcast(hot), "key").unionByName(cold)
    share = F.array(*[F.lit(float(x)) for x in e / np.trace(v)])
    return (joined.select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
            .select("vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                    F.get(share, F.col("i")).alias("explained"), F.lit(error).alias("identity_error")))


def op11_vector_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened embeddings: the eight largest components of every usable vector."""
    return whiten(table(spark, sf_dir, "embeddings"))
