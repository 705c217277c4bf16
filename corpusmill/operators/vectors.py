"""Word-vector jobs.

Skip-gram pairs come from array expressions inside each document (the
position range join J9 never leaves the row); nearest neighbours multiply blocks
of vectors with blocks of queries, and keep the top k per query with a window
limit (partial top-k before the shuffle).
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from corpusmill.functions.text import l2_norm, normalize
from corpusmill.operators.buckets import BUCKET, bucketed, items_of, met, numbered, whole

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

QUERY_BLOCK, VECTOR_BLOCK = 1000, 8192  # query vectors in a task at a time; vectors that they meet there
SHARDS = 16  # of the text that word vectors are trained on


def hash_unit(key: Column) -> Column:
    """Uniform [0, 1) from the first 32 bits of ``md5(key)``."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / float(1 << 32)


# --- fixed values -----------------------------------------------------------
# MINSTD generator (Park-Miller, multiplier 48271, modulus 2^31 - 1).
MINSTD_A, MINSTD_M = 48271, 2 ** 31 - 1
# ---------------------------------------------------------------------------


def minstd_powers(n: int) -> list[int]:
    """``A^k mod M`` for k = 1..n (so draw k is ``x0 * A^k mod M``, no sequential state)."""
    return [pow(MINSTD_A, k, MINSTD_M) for k in range(1, n + 1)]


def first_state(key: Column) -> Column:
    """State from 1 to ``MINSTD_M - 1`` that ``md5(key)`` seeds a MINSTD stream with."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % (MINSTD_M - 1) + 1


def hash_units(key: Column, n: int) -> Column:
    """``n`` uniforms in (0, 1): one ``md5(key)`` seeds a MINSTD stream, expanded in
    closed form - one hash per key, one multiply and modulo per draw."""
    x0 = first_state(key)
    powers = F.lit(np.array(minstd_powers(n), dtype=np.int64))
    # Bound by an outer one-element transform: inside the inner one the hash would run once per draw.
    return F.transform(F.array(x0), lambda x: F.transform(
        powers, lambda p: ((x * p) % MINSTD_M).cast("double") / float(MINSTD_M)))[0]


def skipgram_pairs(seqs: DataFrame, id_col: str, ids_col: str, window: int = 1, num_skips: int = 2,
                   seed: int = 0, batch_size: int | None = None) -> DataFrame:
    """Q11 + J9: ``(doc, pos, center, context)``; contexts within ``window`` of the
    centre, inside the document; ``num_skips`` of them by hash when there are more."""
    if num_skips > 2 * window:
        raise ValueError("num_skips must be <= 2 * window")
    if batch_size is not None and batch_size % num_skips != 0:
        raise ValueError("batch_size must be a multiple of num_skips")
    seqs = seqs.select(F.col(id_col).alias("doc"), F.col(ids_col).alias("ids"))
    ids = F.col("ids")
    n = F.size(ids)
    doc = F.col("doc")

    def contexts(i):
        cand = F.filter(F.sequence(i - window, i + window), lambda j: (j != i) & (j >= 0) & (j < n))
        if num_skips == 2 * window:
            return cand  # every context in range is used; no draw needed
        keyed = F.transform(cand, lambda j: F.struct(
            F.md5(F.concat_ws(":", F.lit(str(seed)), doc.cast("string"), i.cast("string"), j.cast("string"))).alias("h"),
            j.alias("j")))
        picked = F.slice(F.array_sort(keyed), 1, num_skips)
        return F.array_sort(F.transform(picked, lambda s: s["j"]))

    per = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1),
                                    lambda i: F.struct(i.alias("pos"), contexts(i).alias("ctx"))))
    rows = seqs.select("doc", "ids", F.explode(per).alias("p"))
    rows = rows.select("doc", "ids", "p.pos", F.explode("p.ctx").alias("j"))
    return rows.select("doc", "pos", F.col("ids")[F.col("pos")].alias("center"),
                       F.col("ids")[F.col("j")].alias("context"))


def log_uniform(u: Column, vocab_size: int) -> Column:
    """Class id drawn from the log-uniform (Zipf) sampler for uniform ``u``."""
    return (F.floor(F.exp(u * math.log(vocab_size + 1))) - 1).cast("long")


DRAWS = (4, 64)  # draws per sample that is wanted, first and in the second round
STREAMS = 1024  # that are drawn from at a time


def first_different(classes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have ``k`` different numbers, and the first ``k`` of each such row in the order they came."""
    order = np.argsort(classes, axis=1, kind="stable")
    ordered = np.take_along_axis(classes, order, axis=1)
    new = np.zeros(classes.shape, dtype=bool)
    np.put_along_axis(new, order, np.c_[np.ones(len(classes), dtype=bool), ordered[:, 1:] != ordered[:, :-1]], axis=1)
    nth = np.cumsum(new, axis=1)
    enough = nth[:, -1] >= k
    return enough, classes[enough][(new & (nth <= k))[enough]].reshape(-1, k)


def _drawn(vocab_size: int, k: int):
    """The first ``k`` different classes of each batch's stream, which starts at ``x0``."""
    small = np.uint16 if vocab_size <= 1 << 16 else np.int64

    def classes(x0: np.ndarray, n: int) -> np.ndarray:
        u = (x0[:, None] * np.array(minstd_powers(n), dtype=np.int64) % MINSTD_M).astype(float) / float(MINSTD_M)
        return (np.floor(np.exp(u * math.log(vocab_size + 1))) - 1).astype(small)

    def all_of(x0: int) -> np.ndarray:
        stream = np.r_[classes(np.array([x0]), DRAWS[1] * k)[0].astype(np.int64), np.arange(vocab_size)]
        return stream[np.sort(np.unique(stream, return_index=True)[1])][:k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(a, STREAMS) for b in batches for a in range(0, b.num_rows, STREAMS)):
            x0, out, left = b.column("x0").to_numpy(), np.empty((b.num_rows, k), dtype=np.int64), np.arange(b.num_rows)
            for n in (2 * k, DRAWS[0] * k):  # beginnings of one stream
                enough, first = first_different(classes(x0[left], n), k) if len(left) else (np.empty(0, dtype=bool), out[:0])
                out[left[enough]] = first
                left = left[~enough]
            for i in left.tolist():
                out[i] = all_of(int(x0[i]))
            ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * k)
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("batch"), pa.ListArray.from_arrays(ends, pa.array(out.reshape(-1)))], ["doc", "batch", "classes"])
    return run


def negative_samples(seqs: DataFrame, id_col: str, ids_col: str, vocab_size: int, k: int = 64,
                     centers_per_batch: int = 64, seed: int = 0) -> DataFrame:
    """Q12: ``k`` different log-uniform class ids per batch of ``centers_per_batch`` centres of a document.

    The stream of a batch (``hash_units`` of (seed, doc, batch)) is drawn from without repeats: a class that has come
    already is passed over, until there are ``k``.  Its first 2 draws a sample have them nearly always, its first 4 more often; if
    not, it goes on to 64, and what is then still missing are the smallest ids that have not come.  Streams are drawn from in
    blocks of ``STREAMS``.
    """
    if k > vocab_size:
        raise ValueError("no more than vocab_size different classes can be drawn")
    n_batches = F.ceil(F.size(ids_col) / centers_per_batch).cast("int")
    batches = F.when(n_batches > 0, F.sequence(F.lit(0), n_batches - 1))
    b = seqs.select(F.col(id_col).alias("doc"), F.explode(batches).alias("batch"))
    key = F.concat_ws(":", F.lit(str(seed)), F.col("doc").cast("string"), F.col("batch").cast("string"))
    schema = StructType([StructField("doc", b.schema["doc"].dataType), StructField("batch", IntegerType()), StructField("classes", ArrayType(LongType()))])
    drawn = b.select("doc", "batch", first_state(key).alias("x0")).mapInArrow(_drawn(vocab_size, k), schema)
    return drawn.select("doc", "batch", F.posexplode("classes").alias("k", "class_id"))


def embedding_matrix(vocab: DataFrame, dictionary: DataFrame, dim: int, seed: int = 0) -> DataFrame:
    """Q13: ``(id, word, has_vec, vec)`` - the dictionary vector, else uniform(-1, 1)
    drawn from ``hash_units`` of (seed, word) so re-runs give the same matrix."""
    d = dictionary.select("word", F.col("vec").alias("dvec"))
    j = vocab.select("id", "word").join(d, "word", "left")
    rnd = F.transform(hash_units(F.concat_ws(":", F.lit(str(seed)), F.col("word")), dim),
                      lambda u: (u * 2 - 1).cast("float"))
    return j.select("id", "word", F.col("dvec").isNotNull().alias("has_vec"),
                    F.coalesce(F.col("dvec"), rnd).alias("vec"))


def _summed(id_col: str, sides: dict[str, str], values: list[str]):
    def add(rows: pa.Table, table: pa.Table) -> pa.Table:
        ids, group = numbered(rows[id_col])
        keys, code = numbered(table["key"])  # an id may have several rows
        columns = [whole(table[v]) for v in values]
        known = [~x.is_null().to_numpy(zero_copy_only=False) for x in columns]
        has = [np.bincount(code[y], minlength=len(keys)) for y in known]
        total = [np.bincount(code[y], x.drop_null().to_numpy(), len(keys)) for x, y in zip(columns, known)]
        times, out = np.bincount(code, minlength=len(keys)), []

        def added(owner: np.ndarray, x: np.ndarray) -> np.ndarray:
            return np.bincount(owner, x, len(ids)).astype(float)  # of none: whole numbers

        for name, c in sides.items():
            items, lengths = items_of(rows[c])
            at = pc.index_in(items, value_set=keys)
            owner = np.repeat(group, lengths)[~at.is_null().to_numpy(zero_copy_only=False)]
            at = at.drop_null().to_numpy()
            n = added(owner, times[at])
            here = pa.array(np.flatnonzero(n))
            sums = [pa.array(added(owner, t[at]), mask=added(owner, h[at]) == 0).take(here) for t, h in zip(total, has)]
            out.append(pa.table([ids.take(here), pa.array([name] * len(here), pa.string()), pa.array(n.astype(np.int64)).take(here), *sums],
                                names=[id_col, "side", "n", *values]))
        return pa.concat_tables(out)
    return add


def lookup_sums(df: DataFrame, id_col: str, sides: dict[str, str], matrix: DataFrame, values: list[str]) -> DataFrame:
    """``(id_col, side, n, values)``: how many rows of ``matrix (id, values)`` the items of the id arrays ``sides`` (name: column) of ``df`` meet, an
    id may have several, and the sums of its ``values`` (double; nulls left out) over them; no row for a side without any.

    Rows are dealt by ``id_col`` into buckets and the different ids of a bucket are joined with the matrix.
    """
    cols = list(dict.fromkeys(sides.values()))
    size = sum((F.coalesce(F.size(c), F.lit(0)).cast("long") * 4 for c in cols), F.lit(16))
    rows = bucketed(df.select(id_col, *cols), id_col, size).select(BUCKET, id_col, *cols)
    schema = StructType([StructField(id_col, df.schema[id_col].dataType), StructField("side", StringType()), StructField("n", LongType()),
                         *[StructField(v, DoubleType()) for v in values]])
    return met(rows, cols, matrix.select(F.col("id").cast("int").alias("key"), *values), _summed(id_col, sides, values), schema)


def normalized(vectors: DataFrame, vec_col: str = "vec") -> DataFrame:
    """E2 + F11: ``norm`` and the unit vector ``unit``."""
    return vectors.withColumn("norm", l2_norm(F.col(vec_col))).withColumn("unit", normalize(F.col(vec_col)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 8, id_col: str = "id",
            vec_col: str = "vec") -> DataFrame:
    """J8 + T2: ``(query_id, rank, id, sim)`` - the k most cosine-similar vectors of
    each query, the query itself excluded, ties by id.

    Vectors and queries are dealt into blocks by hash and every block of queries meets every block of vectors in one
    task, where they are multiplied batch by batch and the k best of a batch go on; the plan is the same for
    any number of queries and nothing passes through the driver but the two row counts.  Null vectors are left out.
    """
    def rows(df: DataFrame, kind: int) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.lit(kind).alias("kind")).where("vec is not null")

    q, v = rows(queries, 0), rows(vectors, 1)
    counts = {r["kind"]: r["n"] for r in q.unionByName(v).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    q_blocks, v_blocks = -(-counts.get(0, 1) // QUERY_BLOCK), -(-counts.get(1, 1) // VECTOR_BLOCK)

    def own(n: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    met = q.withColumn("qb", own(q_blocks)).withColumn("vb", each(v_blocks)).unionByName(v.withColumn("qb", each(q_blocks)).withColumn("vb", own(v_blocks)))
    dealt = met.repartition("qb", "vb").sortWithinPartitions("qb", "vb", "kind")
    scored = dealt.mapInArrow(_scores(k), "query_id long, id long, sim double")
    w = Window.partitionBy("query_id").orderBy(F.col("sim").desc(), F.col("id"))
    return (scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int"), "id", "sim"))


def _units(vectors: pa.ListArray) -> np.ndarray:
    """Rows of unit vectors; a zero vector stays zero."""
    m = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def _scores(k: int):
    """The k best vectors of each batch per query; a block's queries come before its vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, qid, q = None, [], []
        for b in batches:
            at = np.stack([b.column(c).to_numpy() for c in ("qb", "vb", "kind")], axis=1)
            cuts = np.flatnonzero(np.any(np.diff(at, axis=0), axis=1)) + 1
            for lo, hi in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(at)].tolist()):
                if hi == lo:
                    continue
                ids, m = b.column("id").slice(lo, hi - lo).to_numpy(), _units(b.column("vec").slice(lo, hi - lo))
                if tuple(at[lo][:2]) != block:
                    block, qid, q = tuple(at[lo][:2]), [], []
                if at[lo][2] == 0:
                    qid, q = [*qid, ids], [*q, m]
                elif q:
                    qid, q = [np.concatenate(qid)], [np.concatenate(q)]
                    sim = q[0] @ m.T
                    sim[qid[0][:, None] == ids[None, :]] = -np.inf
                    # Everything at least as similar as the k-th stays, so ties at the cut are decided later.
                    last = np.partition(sim, -min(k, sim.shape[1]), axis=1)[:, -min(k, sim.shape[1])]
                    i, j = np.nonzero((sim >= last[:, None]) & np.isfinite(sim))
                    yield pa.RecordBatch.from_arrays([pa.array(qid[0][i]), pa.array(ids[j]), pa.array(sim[i, j])], ["query_id", "id", "sim"])
    return run


def train_word2vec(sentences: DataFrame, tokens_col: str, vector_size: int = 128, window: int = 1,
                   min_count: int = 1, max_iter: int = 1, seed: int = 42,
                   num_partitions: int = SHARDS) -> DataFrame:
    """E1 (re-aimed): Spark ML skip-gram Word2Vec (hierarchical softmax); ``(word, vector)``.

    The longest document sets ``maxSentenceLength``, so none is cut and no pair is lost.  Documents are dealt by their hash into a
    fixed number of shards and sorted in them, so the vectors depend neither on the cluster's size nor on the input's partitions.
    """
    from pyspark.ml.feature import Word2Vec
    longest = sentences.agg(F.max(F.size(tokens_col))).first()[0] or 1
    dealt = sentences.select(tokens_col).repartition(num_partitions, tokens_col).sortWithinPartitions(tokens_col)
    w2v = Word2Vec(vectorSize=vector_size, windowSize=window, minCount=min_count, maxIter=max_iter,
                   maxSentenceLength=max(1, int(longest)),
                   seed=seed, numPartitions=num_partitions, inputCol=tokens_col, outputCol="__v")
    return w2v.fit(dealt).getVectors()


def project_2d(vectors: DataFrame, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """E3 (re-aimed): PCA to two components; ``(id, x, y)``."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    v = vectors.select(id_col, array_to_vector(F.transform(vec_col, lambda x: x.cast("double"))).alias("__f"))
    model = PCA(k=2, inputCol="__f", outputCol="__p").fit(v)
    out = model.transform(v).select(id_col, vector_to_array("__p").alias("p"))
    return out.select(id_col, F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
