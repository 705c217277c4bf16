"""Skip-gram word vectors by noise-contrastive estimation (E1) on shards of the corpus.

Documents are dealt by hash into a fixed number of shards, and each shard into rounds.  In a round every shard starts from
the same vectors and goes through its documents in order of their ids, in batches of pairs with negatives drawn
without repeats from the log-uniform sampler.  The changes of a word are then averaged over the shards that saw it.  They are added
as whole numbers, so neither the order in which tasks end nor the cluster's size changes the result; a task that
runs again gives the same changes again.

The vectors (vocabulary x dimensions) are broadcast to the tasks and gathered on the driver once a round; their size is set
by the parameters and does not grow with the corpus.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.vectors import first_different

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

UNIT = float(1 << 36)  # changes are counted in its parts
CENTRES, CONTEXTS = 0, 1
DRAWN = 256  # batches whose negatives are drawn at a time


@dataclass(frozen=True)
class Training:
    vocab_size: int
    dim: int = 128
    window: int = 1
    negatives: int = 64
    batch: int = 128
    rate: float = 1.0
    shards: int = 16
    rounds: int = 4
    seed: int = 42


def first_vectors(t: Training) -> tuple[np.ndarray, np.ndarray]:
    """Centre vectors, uniform from -1 to 1; context vectors, normal and within two deviations, with a bias as last column."""
    rng = np.random.default_rng(t.seed)
    centres = rng.random((t.vocab_size, t.dim), dtype=np.float32) * 2 - 1
    contexts = np.clip(rng.standard_normal((t.vocab_size, t.dim), dtype=np.float32), -2, 2) / np.float32(np.sqrt(t.dim))
    return centres, np.c_[contexts, np.zeros((t.vocab_size, 1), dtype=np.float32)]


def log_expected(ids: np.ndarray, t: Training) -> np.ndarray:
    """Logarithm of how often the log-uniform sampler draws an id among the negatives of a batch."""
    return np.log(t.negatives * np.log((ids + 2.0) / (ids + 1.0)) / np.log(t.vocab_size + 1.0))


def distinct_negatives(rng: np.random.Generator, t: Training) -> np.ndarray:
    """Different ids from the log-uniform sampler, in the order in which they first come."""
    k, drawn = min(t.negatives, t.vocab_size), np.empty(0, dtype=np.int64)
    while len(drawn) < k:
        more = np.exp(rng.random(2 * t.negatives) * np.log(t.vocab_size + 1.0)).astype(np.int64) - 1
        both = np.r_[drawn, np.minimum(more, t.vocab_size - 1)]
        drawn = both[np.sort(np.unique(both, return_index=True)[1])]
    return drawn[:k]


def all_negatives(rng: np.random.Generator, t: Training) -> Iterator[np.ndarray]:
    """What ``distinct_negatives`` gives again and again with ``rng``, drawn for many batches at once."""
    k = min(t.negatives, t.vocab_size)

    def blocks() -> Iterator[tuple[np.ndarray, bool, np.ndarray | None]]:
        while True:
            more = np.exp(rng.random((DRAWN, 2 * t.negatives)) * np.log(t.vocab_size + 1.0)).astype(np.int64) - 1
            ids = np.minimum(more, t.vocab_size - 1)
            enough, first = first_different(ids.astype(np.uint16 if t.vocab_size <= 1 << 16 else np.int64), k)
            found = iter(first.astype(np.int64))
            for some, done in zip(ids, enough.tolist()):
                yield some, done, next(found) if done else None

    draws = blocks()
    for some, done, first in draws:
        if done:
            yield first
            continue
        drawn = some
        while True:
            drawn = drawn[np.sort(np.unique(drawn, return_index=True)[1])]
            if len(drawn) >= k:
                break
            drawn = np.r_[drawn, next(draws)[0]]
        yield drawn[:k]


def pairs_of(docs: list[np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres and contexts of all pairs within ``window`` of a document."""
    ids = np.concatenate(docs) if docs else np.empty(0, dtype=np.int64)
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    at, centres, contexts = [], [], []
    for step in [s for w in range(1, window + 1) for s in (-w, w)]:
        i = np.arange(max(0, -step), len(ids) - max(0, step))
        i = i[doc[i] == doc[i + step]]
        at.append(i)
        centres.append(ids[i])
        contexts.append(ids[i + step])
    order = np.argsort(np.concatenate(at), kind="stable")  # in the order of the text
    return np.concatenate(centres)[order], np.concatenate(contexts)[order]


def subtract_rows(table: np.ndarray, rows: np.ndarray, change: np.ndarray) -> None:
    """``np.subtract.at(table, rows, change)``, also in its order of additions, by numpy's faster way over single numbers."""
    flat = table.reshape(-1)  # a view: tables are contiguous
    np.subtract.at(flat, (rows[:, None] * table.shape[1] + np.arange(table.shape[1])).reshape(-1), np.ascontiguousarray(change).reshape(-1))


def different(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each of ``ids``, all below ``size``, once, and the place there of each of them."""
    at, n = np.empty(size, dtype=np.int64), np.arange(len(ids))
    at[ids] = n
    some = ids[at[ids] == n]
    at[some] = n[:len(some)]
    return some, at[ids]


def probability(score: np.ndarray) -> np.ndarray:
    p = np.minimum(score, 30)
    np.maximum(p, -30, out=p)
    np.negative(p, out=p)
    np.exp(p, out=p)
    p += 1
    return np.divide(1, p, out=p)


def bounded(change: np.ndarray, t: Training) -> np.ndarray:
    """Rows over ten times as long as any first centre vector cut to that length: where few words fill the batches, steps of the full length would
    overshoot more and more and the vectors grow without end."""
    most, length = 10 * float(np.sqrt(t.dim)), np.sqrt(np.einsum("ij,ij->i", change, change))
    over = np.flatnonzero(length > most)
    if len(over):
        change[over] *= (most / length[over])[:, None]
    return change


def learn(centres: np.ndarray, contexts: np.ndarray, c: np.ndarray, x: np.ndarray, negatives: np.ndarray, t: Training, expected: np.ndarray | None = None) -> None:
    """One step over a batch of pairs: gradient of the mean loss, both tables changed in place.

    A word scores the same wherever it stands in the batch, so each different centre meets each different context and each
    negative once; pairs are summed in a matrix of centres and contexts.  ``expected``: ``log_expected`` of all ids.
    """
    expected = log_expected(np.arange(t.vocab_size), t) if expected is None else expected
    (u, i), (v, j) = different(c, len(centres)), different(x, len(contexts))
    e = np.ones((len(u), contexts.shape[1]), dtype=centres.dtype)  # the last column meets the bias
    e[:, :-1] = centres[u]
    met = np.concatenate([v, negatives])
    w = contexts[met]
    score = e @ w.T
    score -= expected[met].astype(score.dtype)
    weight = np.empty_like(score)
    weight[:, :len(v)] = np.bincount(i * len(v) + j, (probability(score[i, j]) - 1) * (t.rate / len(c)), len(u) * len(v)).reshape(len(u), -1)
    times = (np.bincount(i, minlength=len(u)) * (t.rate / len(c))).astype(score.dtype)
    np.multiply(probability(score[:, len(v):]), times[:, None], out=weight[:, len(v):])
    centres[u] = e[:, :-1] - bounded((weight @ w)[:, :-1], t)
    change = bounded(weight.T @ e, t)
    contexts[v] -= change[:len(v)]
    contexts[negatives] -= change[len(v):]


def _train(held, t: Training, turn: int):
    def shard(number: int, docs: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        old = held.value
        tables = [a.copy() for a in old]
        seen = [np.zeros(t.vocab_size, dtype=bool) for _ in old]
        draws, expected = all_negatives(np.random.default_rng([t.seed, turn, number]), t), log_expected(np.arange(t.vocab_size), t)
        c = x = np.empty(0, dtype=np.int64)
        part: list[np.ndarray] = []

        def steps(last: bool) -> None:
            nonlocal c, x
            more = pairs_of(part, t.window)
            part.clear()
            c, x = np.r_[c, more[0]], np.r_[x, more[1]]
            end = len(c) if last else len(c) - len(c) % t.batch
            seen[CENTRES][c[:end]] = seen[CONTEXTS][x[:end]] = True
            for a in range(0, end, t.batch):
                b = slice(a, min(a + t.batch, end))
                negatives = next(draws)
                learn(*tables, c[b], x[b], negatives, t, expected)
                seen[CONTEXTS][negatives] = True
            c, x = c[end:], x[end:]

        for d in docs:
            part.append(d)
            if len(part) == 256:
                steps(False)
        steps(True)
        for kind, (now, before, which) in enumerate(zip(tables, old, seen)):
            ids = np.flatnonzero(which)
            for a in range(0, len(ids), 1024):
                some = ids[a:a + 1024]
                change = np.rint((now[some].astype(float) - before[some]) * UNIT).astype("<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), kind, dtype=np.int32)), pa.array(some.astype(np.int32)),
                                                  pa.array([r.tobytes() for r in change], pa.binary()), pa.array(np.ones(len(some), dtype=np.int64))], ["kind", "id", "change", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        rows = ((s.as_py(), ids.values.to_numpy(zero_copy_only=False).astype(np.int64)) for b in batches for s, ids in zip(b.column("shard"), b.column("ids")))
        for number, group in groupby(rows, lambda r: r[0]):
            yield from shard(number, (ids for _, ids in group))
    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The changes of each word, which follow one another, as one row."""
    held: dict[tuple[int, int], tuple[np.ndarray, int]] = {}

    def batch(some: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int32()), pa.array([i for _, i in some], pa.int32()),
                                           pa.array([c.astype("<i8").tobytes() for c, _ in some.values()], pa.binary()), pa.array([n for _, n in some.values()], pa.int64())],
                                          ["kind", "id", "change", "n"])

    for b in batches:
        for kind, i, change, n in zip(*(b.column(c).to_pylist() for c in ("kind", "id", "change", "n"))):
            was = held.pop((kind, i), None)
            if was is None and len(held) >= 1024:
                yield batch(held)
                held.clear()
            c = np.frombuffer(change, dtype="<i8")
            held[kind, i] = (c, n) if was is None else (was[0] + c, was[1] + n)
    if held:
        yield batch(held)


def own_partitions(spark: SparkSession, n: int) -> list[int]:
    """Numbers that ``repartition(n, ...)`` deals into partitions 0 to ``n`` - 1, one into each."""
    tried = spark.range(100 * n).select(F.col("id").cast("int").alias("key"))
    found = tried.groupBy(F.pmod(F.hash("key"), F.lit(n)).alias("part")).agg(F.min("key").alias("key")).collect()
    return [r["key"] for r in sorted(found, key=lambda r: r["part"])]


def train_skipgram(seqs: DataFrame, t: Training, id_col: str = "id", ids_col: str = "ids") -> np.ndarray:
    """Centre vectors (one row per id) trained on ``seqs``, arrays of ids from 0 below ``vocab_size``."""
    spark = seqs.sparkSession
    h = F.xxhash64(F.lit(t.seed), id_col)
    rows = seqs.select(F.pmod(h, F.lit(t.shards)).cast("int").alias("shard"), F.pmod(F.shiftright(h, 20), F.lit(t.rounds)).cast("int").alias("turn"),
                       F.col(id_col).alias("doc"), F.col(ids_col).alias("ids")).where(F.size("ids") > 1)
    tables = first_vectors(t)
    keys = F.array(*map(F.lit, own_partitions(spark, t.shards)))
    rows = rows.withColumn("key", keys[F.col("shard")])  # dealt by their own numbers, shards would share some partitions and leave others empty
    schema = "kind int, id int, change binary, n long"
    for turn in range(t.rounds):
        held = spark.sparkContext.broadcast(tables)
        dealt = rows.where(F.col("turn") == turn).repartition(t.shards, "key").sortWithinPartitions("shard", "doc", "ids")
        changes = dealt.select("shard", "ids").mapInArrow(_train(held, t, turn), schema)
        added = changes.repartition("kind", "id").sortWithinPartitions("kind", "id").mapInArrow(_added, schema).toArrow()  # at most a row per word and table
        tables = tuple(a.copy() for a in tables)
        for kind, i, change, n in zip(*(added.column(c).to_pylist() for c in ("kind", "id", "change", "n"))):
            tables[kind][i] += (np.frombuffer(change, dtype="<i8") / (UNIT * n)).astype(np.float32)
        held.unpersist()
    return tables[CENTRES]
