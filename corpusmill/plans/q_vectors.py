"""Word-vector queries: Q11, Q12, Q13, E1, E2, E3, F11, J6, J8, T2, S2, S13."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from corpusmill.functions.text import l2_norm, ws_tokens
from corpusmill.operators import sampling as M
from corpusmill.operators import skipgram as SG
from corpusmill.operators import vectors as VX
from corpusmill.operators import vocab as V
from corpusmill.operators.ranking import one_row
from corpusmill.plans import bindings as B
from corpusmill.plans import sqlparts as S
from corpusmill.plans.q_vocab import W1_SIZE, _frequency_vocab, first_seen
from corpusmill.plans.registry import query
from corpusmill.session import cut_lineage, ensure_checkpoint_dir
from corpusmill.sources import vectors as SV
from corpusmill.sources.tables import read_table

SEED = 42
NEG_K, CENTERS = 64, 64          # 64 negatives per batch of 64 centres (128 pairs)
QUERY_WINDOW, QUERY_COUNT, TOP_K = 100, 16, 8


def vprinted(col, places):
    """A vector for comparison: its components as whole numbers of ``10 ** -places``, joined by spaces."""
    return F.array_join(F.transform(col, lambda x: F.round(x.cast("double") * 10 ** places).cast("long")), " ").alias(col)


def encoded_corpus(spark, sf):
    """``(pair_id, ids)``: the corpus stream of each document through the frequency vocabulary (UNK = 0)."""
    fv = _frequency_vocab(spark, sf, W1_SIZE)
    return V.encode_texts(B.corpus_text(spark, sf), "pair_id", "text", cut_lineage(fv), 0)


@query("skipgram_pairs", f"""WITH {S.corpus_encoded(W1_SIZE - 1)}
SELECT doc, u.i::BIGINT AS pos, ids[u.i + 1] AS center, ids[v.j + 1] AS context
FROM cenc, unnest(range(len(ids))) AS u(i), unnest([u.i - 1, u.i + 1]) AS v(j)
WHERE v.j >= 0 AND v.j < len(ids)""")
def skipgram_pairs(spark, sf):
    """Q11 + J9: skip-gram (centre, context) ids, window 1, 2 skips, within each document."""
    p = VX.skipgram_pairs(encoded_corpus(spark, sf), "pair_id", "ids", window=1, num_skips=2, seed=SEED,
                          batch_size=128)
    return p.select("doc", F.col("pos").cast("long"), "center", "context")


# The twin draws as many as the first round does; the test tables need no second one.
@query("negative_samples", f"""WITH {S.corpus_encoded(W1_SIZE - 1)},
b AS (SELECT doc, unnest(range(ceil(len(ids) / {CENTERS})::BIGINT)) AS batch FROM cenc),
s AS (SELECT doc, batch, unnest(range({NEG_K * VX.DRAWS[0]})) AS j FROM b),
d AS (SELECT doc, batch, j, (floor(exp({S.hash_units_sql(f"'{SEED}:' || doc || ':' || batch", 'j', NEG_K * VX.DRAWS[0])} * ln({W1_SIZE + 1}))) - 1)::BIGINT AS class_id FROM s),
firsts AS (SELECT doc, batch, class_id, min(j) AS j FROM d GROUP BY doc, batch, class_id)
SELECT doc, batch::INTEGER AS batch, (row_number() OVER (PARTITION BY doc, batch ORDER BY j) - 1)::INTEGER AS k, class_id
FROM firsts QUALIFY k < {NEG_K}""")
def negative_samples(spark, sf):
    """Q12: 64 different log-uniform negative class ids per batch of 64 centres."""
    return VX.negative_samples(encoded_corpus(spark, sf), "pair_id", "ids", W1_SIZE, NEG_K, CENTERS, SEED)


def _matrix(spark, sf, words=None, vocab=None, d=None):
    words = B.word_table(spark, sf) if words is None else words
    d = B.dictionary(spark, sf, words) if d is None else d
    dim = d.select(F.max(F.size("vec"))).first()[0]
    return VX.embedding_matrix(first_seen(spark, sf, d, words) if vocab is None else vocab, d, int(dim), SEED)


MATRIX_SQL = f"""WITH {S.FIRST_SEEN_VOCAB},
dim AS (SELECT max(len(vec)) AS dim FROM dict),
mx AS (
  SELECT v.id, v.word, d.vec IS NOT NULL AS has_vec,
         coalesce(d.vec, list_transform(range((SELECT dim FROM dim)),
                  lambda k: ({S.hash_units_sql(f"'{SEED}:' || v.word", 'k', 512)} * 2 - 1)::FLOAT)) AS vec
  FROM vocab v LEFT JOIN dict d ON d.word = v.word)"""


@query("embedding_matrix", MATRIX_SQL + f"""
SELECT id, word, has_vec, len(vec)::INTEGER AS dim,
       list_sum(list_transform(vec, lambda x, i: i * round(x::DOUBLE * 100000)::BIGINT))::BIGINT AS checksum FROM mx""")
def embedding_matrix(spark, sf):
    """Q13: dictionary vector, or a hash-seeded uniform(-1, 1) vector, for every vocabulary id."""
    # Every component counts with its place: sum of i * round(x_i * 10 ** 5), exact in 64 bits.
    total = F.aggregate(F.transform("vec", lambda x, i: (i + 1) * F.round(x.cast("double") * 100000).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return _matrix(spark, sf).select("id", "word", "has_vec", F.size("vec").alias("dim"), total.alias("checksum"))


@query("vector_lookup", MATRIX_SQL + f""",
es AS ({S.encoded('summary')}), et AS ({S.encoded('text')}),
ids AS (SELECT pair_id, 'summary' AS side, unnest(ids) AS id FROM es UNION ALL SELECT pair_id, 'text', unnest(ids) FROM et),
v AS (SELECT i.pair_id, i.side, m.vec, {S.norm_sql('m.vec')} AS norm FROM ids i JOIN mx m ON m.id = i.id)
SELECT pair_id, side, count(*)::BIGINT AS n_ids, round(avg(norm), 4) AS mean_norm, round(avg(vec[1]::DOUBLE), 4) AS mean_first
FROM v GROUP BY pair_id, side""")
def vector_lookup(spark, sf):
    """Id -> vector lookup of every text and summary token; per pair and side the count, the mean
    norm and the mean first component."""
    words = B.word_table(spark, sf)
    d = B.dictionary(spark, sf, words)
    vocab = first_seen(spark, sf, d, words)
    m = VX.normalized(_matrix(spark, sf, words, vocab, d)).select("id", "norm", F.col("vec")[0].cast("double").alias("v0"))
    e = V.encode_many(B.pairs(spark, sf), "pair_id", ["text", "summary"], vocab, V.lookup_id(vocab, "<UNK>"))
    e = cut_lineage(e)  # weighed, then looked up: encoded once
    # Each different id of a bucket of pairs is joined once.
    sums = VX.lookup_sums(e, "pair_id", {"text": "text_ids", "summary": "summary_ids"}, m, ["norm", "v0"])
    return sums.select("pair_id", "side", F.col("n").alias("n_ids"), F.round(F.col("norm") / F.col("n"), 4).alias("mean_norm"),
                       F.round(F.col("v0") / F.col("n"), 4).alias("mean_first"))


@query("normalized_vectors", f"""SELECT vec_id, round({S.norm_sql('embedding')}, 6) AS norm,
       {S.vprint_sql(f"list_transform(embedding, lambda x: CASE WHEN {S.norm_sql('embedding')} > 0 THEN x::DOUBLE / {S.norm_sql('embedding')} ELSE 0.0 END)", 6)} AS unit
FROM embeddings""")
def normalized_vectors(spark, sf):
    """E2 + F11: L2 norm and unit vector of every vector."""
    e = VX.normalized(read_table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec")))
    return e.select("vec_id", F.round("norm", 6).alias("norm"), vprinted("unit", 6))


@query("nearest_words", f"""WITH e AS (SELECT vec_id AS id, embedding AS v, {S.norm_sql('embedding')} AS n FROM embeddings),
u AS (SELECT id, list_transform(v, lambda x: CASE WHEN n > 0 THEN x::DOUBLE / n ELSE 0.0 END) AS unit FROM e),
q AS (SELECT id AS qid, unit AS qu FROM u WHERE id < {QUERY_WINDOW} ORDER BY md5('{SEED}:' || id::VARCHAR), id LIMIT {QUERY_COUNT}),
s AS (SELECT q.qid AS query_id, u.id,
             list_reduce(list_transform(range(len(u.unit)), lambda i: q.qu[i + 1] * u.unit[i + 1]), lambda a, b: a + b) AS sim
      FROM q JOIN u ON u.id <> q.qid)
SELECT query_id, rank::INTEGER AS rank, id, round(sim, 6) AS sim
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s) WHERE rank <= {TOP_K}""")
def nearest_words(spark, sf):
    """J8 + T2 + T4: 8 nearest vectors by cosine for 16 sampled query ids among the first 100."""
    e = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    queries = M.sample_ids(e, "id", QUERY_WINDOW, QUERY_COUNT, SEED)
    n = VX.nearest(e, queries, TOP_K)
    return n.withColumn("sim", F.round("sim", 6))


def _word2vec(spark, sf):
    fv = cut_lineage(_frequency_vocab(spark, sf, W1_SIZE))
    encoded = cut_lineage(V.encode_texts(B.corpus_text(spark, sf), "pair_id", "text", fv, 0))
    vectors = SG.train_skipgram(encoded, SG.Training(vocab_size=W1_SIZE, seed=SEED), "pair_id")
    rows = spark.createDataFrame(pa.table({"id": pa.array(range(len(vectors)), pa.int64()), "vec": pa.array(list(vectors), pa.list_(pa.float32()))}))
    return fv.where("cnt > 0").join(rows, "id").select("word", "vec")


@query("word2vec_vectors")
def word2vec_vectors(spark, sf):
    """Skip-gram vectors by noise-contrastive estimation, dim 128, window 1, 64 negatives, over the corpus with words
    outside the 20,000-word frequency vocabulary replaced by UNK; ``(word, norm)``."""
    return _word2vec(spark, sf).select("word", l2_norm(F.col("vec")).alias("norm"))


@query("word2vec_words", f"""WITH {S.freq_vocab(W1_SIZE - 1)}
SELECT DISTINCT coalesce(f.word, 'UNK') AS word, 128 AS dim, true AS finite FROM ctok t LEFT JOIN fv f ON f.word = t.word""")
def word2vec_words(spark, sf):
    """Every word of the mapped corpus has one vector of 128 finite numbers, not all zero."""
    good = F.forall("vec", lambda x: ~F.isnan(x) & (F.abs(x) < 1e6)) & F.exists("vec", lambda x: x != 0)
    return _word2vec(spark, sf).select("word", F.size("vec").alias("dim"), good.alias("finite"))


@query("pca_projection")
def pca_projection(spark, sf):
    """E3 (re-aimed): 2-D PCA projection of all vectors."""
    e = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return VX.project_2d(e)


@query("pca_axes", """SELECT count(*)::BIGINT AS n, true AS uncorrelated, true AS falling, true AS above_average FROM embeddings""")
def pca_axes(spark, sf):
    """What holds for the two principal components only: uncorrelated, the first with the larger variance,
    each with more than a 64th of all variance."""
    e = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    total = e.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(F.var_samp(F.col("x").cast("double")).alias("v")).agg(F.sum("v").alias("total"))
    p = VX.project_2d(e).agg(F.count(F.lit(1)).cast("long").alias("n"), F.corr("x", "y").alias("r"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"))
    share = F.col("total") / 64
    return one_row(p, total).select("n", (F.abs("r") < 1e-6).alias("uncorrelated"), (F.col("vx") >= F.col("vy")).alias("falling"),
                                    ((F.col("vx") > share) & (F.col("vy") > share)).alias("above_average"))


@query("vector_file_roundtrip", f"""WITH {S.DICTIONARY}
SELECT pos, word, {S.vprint_sql('vec', 6)} AS vec FROM dict""")
def vector_file_roundtrip(spark, sf):
    """S2 + S13: the dictionary written as ``word f1 .. fN`` lines and read back
    (first position, last vector per word)."""
    path = os.path.join(ensure_checkpoint_dir(spark), f"vectors-{uuid.uuid4().hex}")
    SV.write_vector_file(B.dictionary(spark, sf), path)
    v = SV.read_vector_file(spark, path)
    return v.select(F.col("pos").cast("long"), "word", vprinted("vec", 6))


@query("latin1_vector_file", f"""WITH {S.DICTIONARY}
SELECT pos, word, {S.vprint_sql('vec', 6)} AS vec FROM dict
WHERE NOT regexp_matches(word, '[^\x00-\xFF]')""")
def latin1_vector_file(spark, sf):
    """S3 + S2: the Latin-1 words of the dictionary written as ISO-8859-1 lines and read back with that charset."""
    path = os.path.join(ensure_checkpoint_dir(spark), f"latin1-{uuid.uuid4().hex}")
    d = B.dictionary(spark, sf).filter(~F.col("word").rlike(r"[^\x00-\xFF]"))
    SV.write_vector_file(d, path, "ISO-8859-1")
    v = SV.read_vector_file(spark, path, "ISO-8859-1").withColumnRenamed("pos", "line")
    # Lines are numbered anew; the dictionary's own position is joined back by word.
    return v.join(d.select("word", "pos"), "word").select("pos", "word", vprinted("vec", 6))


@query("saved_vocab_roundtrip", f"""WITH {S.FIRST_SEEN_VOCAB}
SELECT id, word, cnt FROM vocab""")
def saved_vocab_roundtrip(spark, sf):
    """The first-seen vocabulary saved as Parquet and read back."""
    path = os.path.join(ensure_checkpoint_dir(spark), f"vocab-{uuid.uuid4().hex}")
    SV.save_table(first_seen(spark, sf), path)
    return spark.read.parquet(path).select("id", "word", "cnt")
