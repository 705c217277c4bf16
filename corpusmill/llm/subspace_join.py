"""Operator 7, embedding near-dedup: subspace pigeonhole join.

Unit vectors of cosine ``c`` or more are at most ``2 (1 - c)`` apart in squared distance.  After one seeded
rotation the coordinates are split into blocks, and each block gets a budget in proportion to its
coordinates: of any close pair at least one block lies within its budget.  Each block is range-joined on a grid over its
first two coordinates, cells as wide as the budget's root, so a vector meets its own cell and the eight around it.
Whole cells of vectors are compared at once, and every candidate's cosine is verified in double precision.

A pair is counted in the first block whose budget it meets, so it counts once without a pass to make
pairs distinct.  Tasks return sums of links and a spanning forest of them, never all pairs.  Equal vectors form one class with a
multiplicity.  The classes are written once, in files of at most ``CHUNK`` vectors, and no vector is copied to the cells it meets:
a task reads a chunk and the ``STRIP`` chunks that it meets from the shared folder and joins them block by block.  So the disk
grows with the vectors and only the comparisons with their square, dealt evenly over tasks of bounded memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import components, scratch_path, table, written
from corpusmill.sources.files import open_file

MIN_COSINE, BLOCK_DIMS, CHUNK, TILE, SEED = 0.9, 8, 4096, 1024, 7
VERIFY = 65536  # candidates whose cosine is computed at a time
STRIP = 8  # chunks that a chunk meets at a time
_ROW = 1 << 20  # between the numbers of two rows of a grid; a row has less than a tenth of it


class Subspaces:
    """Rotation, blocks and budgets for vectors of ``dim`` components."""

    def __init__(self, dim: int, min_cosine: float, block_dims: int):
        q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
        self.rotation = q * np.sign(np.diag(r))
        n = max(1, dim // block_dims)
        cuts = [dim * i // n for i in range(n + 1)]
        self.blocks = [slice(a, b) for a, b in zip(cuts, cuts[1:])]
        # 1e-7 covers rounding in the rotation; what it lets in is verified like any candidate.
        self.budgets = [2 * (1 - min_cosine) * (b.stop - b.start) / dim + 1e-7 for b in self.blocks]
        self.widths = [np.sqrt(x) + 1e-6 for x in self.budgets]

    def rotate(self, x: np.ndarray) -> np.ndarray:
        """Rotated unit vectors, rounded so that they do not depend on the batch."""
        return np.round((x / np.linalg.norm(x, axis=1, keepdims=True)) @ self.rotation, 9)

    def first_block(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The first block of each pair of rotated vectors that meets its budget (or the number of blocks)."""
        out = np.full(len(a), len(self.blocks))
        for i in range(len(self.blocks) - 1, -1, -1):
            d = a[:, self.blocks[i]] - b[:, self.blocks[i]]
            out[(d * d).sum(axis=1) <= self.budgets[i]] = i
        return out


def _keys(kind: str, with_x: bool):
    """Digest and length of each usable vector, and its components stored as ``kind`` (as wide as the column's)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, data, dims = [], [], []
            column = b.column("embedding")
            flat = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False).astype("<f8", copy=False) + 0.0  # null: NaN
            ends = column.offsets.to_numpy().tolist()
            for lo, hi, known in zip(ends, ends[1:], column.is_valid().to_pylist()):
                x = flat[lo:hi]
                good = known and hi > lo and np.isfinite(x).all() and x.any()
                keys.append(hashlib.md5(x.tobytes()).digest() if good else None)
                dims.append(hi - lo if good else None)
                if with_x:
                    # Scaled by a power of two, so that squares neither overflow nor vanish; of floats only parts
                    # below 2 ** -149 of the largest are lost, far below the rounding of the cosine.
                    data.append(np.ldexp(x, -np.frexp(np.abs(x).max())[1]).astype(kind).tobytes() if good else None)
            out = {"vec_id": b.column("vec_id"), "key": pa.array(keys, pa.binary()), "dim": pa.array(dims, pa.int32())}
            if with_x:
                out["x"] = pa.array(data, pa.binary())
            yield pa.RecordBatch.from_arrays([*out.values()], [*out])
    return run


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Stored vectors in double precision."""
    data = column.to_pylist()
    kind = "<f4" if data and len(data[0]) == 4 * dim else "<f8"
    return np.frombuffer(b"".join(data), kind).astype("<f8", copy=False).reshape(-1, dim)


class _Side:
    """Vectors of one length; per block in the order of its grid, with their cells."""

    def __init__(self, s: Subspaces, rows: pa.Table, dim: int):
        x = _matrix(rows["x"], dim)
        self.key, self.n = rows["key"].to_pylist(), rows["n"].to_numpy()
        self.unit, self.y = x / np.linalg.norm(x, axis=1, keepdims=True), s.rotate(x)
        self.single = self.unit.astype(np.float32)
        self.blocks = []
        for at, width in zip(s.blocks, s.widths):
            z = self.y[:, at]
            cell = np.floor(z[:, :2] / width).astype(np.int64)
            code = cell[:, 0] * _ROW + (cell[:, 1] if cell.shape[1] > 1 else 0)
            order = np.argsort(code, kind="stable")
            z = z[order].astype(np.float32)
            self.blocks.append((order, code[order], z, (z * z).sum(axis=1, keepdims=True)))


def _near(s: Subspaces, a: _Side, b: _Side, min_cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of close vectors of ``a`` and ``b``, each in the first block whose budget it meets, some at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def verified() -> tuple[np.ndarray, np.ndarray]:
        """Those of the held pairs of block ``i`` that are close and not in an earlier block; none is held then."""
        u, v = (np.concatenate(x) for x in zip(*held)) if held else (np.empty(0, dtype=np.int64),) * 2
        held.clear()
        maybe = np.einsum("ij,ij->i", a.single[u], b.single[v]) >= min_cosine - 1e-4
        u, v = u[maybe], v[maybe]
        close = np.einsum("ij,ij->i", a.unit[u], b.unit[v]) >= min_cosine
        u, v = u[close], v[close]
        mine = s.first_block(a.y[u], b.y[v]) == i
        return u[mine], v[mine]

    distance, mask = np.empty(TILE * TILE // 4, dtype=np.float32), np.zeros(TILE * TILE // 4, dtype=bool)
    for i, budget in enumerate(s.budgets):
        (row, code, z, zz), (col, there, w, ww) = a.blocks[i], b.blocks[i]
        one, most = np.ones_like, np.float32(budget + 2e-5)
        waiting = 0
        left, right = np.hstack([z, zz, one(zz)]), np.hstack([-2 * w, one(ww), ww])  # their product: squared distances
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        near = code[starts][:, None] + np.array([-_ROW, 0, _ROW])  # a cell and its neighbours in three rows of the grid
        lo, hi = np.searchsorted(there, near - 1, "left").tolist(), np.searchsorted(there, near + 1, "right").tolist()
        for start, end, los, his in zip(starts.tolist(), [*starts[1:].tolist(), len(code)], lo, hi):
            for p in range(start, end, TILE // 4):
                rows = left[p:min(p + TILE // 4, end)]
                for first, last in zip(los, his):
                    for q in range(first, last, TILE):
                        cols = right[q:min(q + TILE, last)]
                        n = len(rows) * len(cols)
                        np.less_equal(np.matmul(rows, cols.T, out=distance[:n].reshape(len(rows), -1)).reshape(-1), most, out=mask[:n])
                        mask[n:n + 7] = False
                        eight = np.flatnonzero(mask[:-(-n // 8) * 8].view(np.uint64)) * 8  # few are set: looked for eight at a time
                        found = (eight[:, None] + np.arange(8))[mask[eight[:, None] + np.arange(8)]]
                        for at in range(0, len(found), VERIFY):
                            r, c = np.divmod(found[at:at + VERIFY], len(cols))
                            held.append((row[p + r], col[q + c]))
                            waiting += len(r)
                            if waiting >= VERIFY:
                                yield verified()
                                waiting = 0
        yield verified()


class _Found:
    """Sums of links and a spanning forest of the vectors of two sides."""

    def __init__(self, a: _Side, b: _Side):
        self.key, self.n = a.key + b.key, np.r_[a.n, b.n]
        self.sums = np.zeros(len(self.key), dtype=np.int64)
        self.tree = np.arange(len(self.key))  # a vector's tree in the forest
        self.forest: list[tuple[int, int]] = []
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        self.held.append((u, v))
        if sum(len(x) for x, _ in self.held) >= 65536:
            self.fold()

    def fold(self) -> None:
        if not self.held:
            return
        u, v = (np.concatenate(x) for x in zip(*self.held))
        self.held = []
        np.add.at(self.sums, u, self.n[v])
        np.add.at(self.sums, v, self.n[u])
        p, q = self.tree[u], self.tree[v]
        other = np.flatnonzero(p != q)
        if not len(other):
            return
        other = other[np.unique(np.minimum(p, q)[other] * len(self.tree) + np.maximum(p, q)[other], return_index=True)[1]]
        up: dict[int, int] = {}

        def root(k: int) -> int:
            while (above := up.get(k, k)) != k:
                up[k] = k = up.get(above, above)
            return k

        for i, j, r, t in zip(u[other].tolist(), v[other].tolist(), p[other].tolist(), q[other].tolist()):
            r, t = root(r), root(t)
            if r != t:
                up[max(r, t)] = min(r, t)
                self.forest.append((i, j))
        now = np.arange(len(self.tree))
        for k in list(up):
            now[k] = root(k)
        self.tree = now[self.tree]

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.fold()
        linked, k = np.flatnonzero(self.sums), self.key
        if len(linked):
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for i in linked.tolist()] + [k[i] for i, _ in self.forest], pa.binary()),
                                              pa.array([None] * len(linked) + [k[j] for _, j in self.forest], pa.binary()),
                                              pa.array(np.r_[self.sums[linked], np.zeros(len(self.forest), dtype=np.int64)])], ["key", "other", "n"])


def _chunks(classes: DataFrame, chunk: int) -> list[list[str]]:
    """The files of ``classes``, none with more than ``chunk`` rows, in groups of no more."""
    files = sorted((r["file"], r["n"]) for r in classes.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n")).collect())
    out, size = [], chunk
    for file, n in files:
        if size + n > chunk:
            out.append([])
            size = 0
        out[-1].append(file)
        size += n
    return out


def _links(chunks: list[list[str]], strips: int, min_cosine: float, block_dims: int):
    """Links of each strip: a chunk at home, among its own and with the ``STRIP`` chunks that follow it in a ring."""
    def read(numbers: list[int]) -> dict[int, pa.Table]:
        tables = []
        for path in (p for k in numbers for p in chunks[k]):
            with open_file(path) as f:
                tables.append(pq.read_table(f, columns=["key", "dim", "n", "x"]))
        if not tables:
            return {}
        rows = pa.concat_tables(tables)
        dims = rows["dim"].to_numpy()
        return {d: rows if (dims == d).all() else rows.filter(pa.array(dims == d)) for d in np.unique(dims).tolist()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Subspaces] = {}
        home, here = None, {}

        def sides(rows: dict[int, pa.Table]) -> dict[int, _Side]:
            return {d: _Side(made.setdefault(d, Subspaces(d, min_cosine, block_dims)), t, d) for d, t in rows.items()}

        for number in (x for b in batches for x in b.column("id").to_pylist()):
            i, strip = divmod(number, strips)
            if i != home:
                home, here = i, sides(read([i]))
            if strip == 0:
                for d, a in here.items():
                    found = _Found(a, a)
                    for u, v in _near(made[d], a, a, min_cosine):
                        found.add(u[u < v], v[u < v])
                    yield from found.rows()
            steps = [k for k in range(max(1, strip * STRIP), min((strip + 1) * STRIP, len(chunks) // 2 + 1)) if 2 * k < len(chunks) or i < k]
            there = read([(i + k) % len(chunks) for k in steps])
            for d, b in sides({d: t for d, t in there.items() if d in here}).items():
                found = _Found(here[d], b)
                for u, v in _near(made[d], here[d], b, min_cosine):
                    found.add(u, v + len(here[d].key))
                yield from found.rows()
    return run


def near_duplicates(vectors: DataFrame, min_cosine: float = MIN_COSINE, block_dims: int = BLOCK_DIMS, chunk: int = CHUNK) -> DataFrame:
    """Links and components of ``vectors (vec_id, embedding)``: ``vec_id, n_links, component_id, kept``.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and keep themselves;
    vectors of different lengths never link.  Equal vectors (ids repeated or not) link with each other.  A null id
    takes part; its component is the smallest id reached.  An empty table gives an empty result.
    """
    spark, kinds = vectors.sparkSession, dict(vectors.dtypes)
    stored = "<f4" if kinds["embedding"] == "array<float>" else "<f8"
    vectors, columns = vectors.select("vec_id", "embedding"), f"vec_id {kinds['vec_id']}, key binary, dim int"
    prep = written(vectors.mapInArrow(_keys(stored, False), columns).select("vec_id", "key"), "vectors")
    path = scratch_path(spark, "vector-classes")
    classes = vectors.mapInArrow(_keys(stored, True), f"{columns}, x binary").where("key is not null").groupBy("key", "dim").agg(
        F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"), F.max("x").alias("x"))
    classes.write.option("maxRecordsPerFile", chunk).parquet(path)
    classes = spark.read.schema(classes.schema).parquet(path)
    chunks = _chunks(classes, chunk)
    strips = len(chunks) // 2 // STRIP + 1
    parts = max(1, min(len(chunks) * strips, max(len(chunks) * strips // 4, 4 * spark.sparkContext.defaultParallelism), 20_000))
    found = written(spark.range(0, len(chunks) * strips, 1, parts).mapInArrow(
        _links(chunks, strips, min_cosine, block_dims), "key binary, other binary, n long"), "vector-links")
    sums = found.groupBy("key").agg(F.sum("n").alias("links"))
    comp = components(found.where("other is not null"), "key", "other").withColumnRenamed("node", "key")
    c = (classes.select("key", "n", "first").join(sums, "key", "left").join(comp, "key", "left")
         .withColumn("component", F.coalesce("component", "key")))
    least = c.groupBy("component").agg(F.min("first").alias("component_id"))
    c = c.join(least, "component").select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    linked = prep.join(c, "key", "left")
    own_id = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return linked.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), own_id.alias("component_id"),
                         F.col("vec_id").eqNullSafe(own_id).alias("kept"))


def op7_subspace_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine 0.9 or more, components and kept vectors of ``embeddings``."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
