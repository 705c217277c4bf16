"""Vocabulary-stage queries: A1-A7, W1-W3, J4, J5, J7, P10, U1, U3."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import text as T
from corpusmill.operators import vocab as V
from corpusmill.plans import bindings as B
from corpusmill.plans import sqlparts as S
from corpusmill.plans.registry import query
from corpusmill.session import cut_lineage

W1_SIZE = 20000  # vocabulary_size of the word-vector pipeline


def _flagged_counts(spark, sf, dictionary=None, words=None):
    words = B.word_table(spark, sf) if words is None else words
    d = B.dictionary(spark, sf, words) if dictionary is None else dictionary
    return V.with_dictionary_flag(words, d)


def first_seen(spark, sf, dictionary=None, words=None):
    """The first-seen vocabulary, materialised: its ids are looked up and joined several times."""
    return cut_lineage(V.first_seen_vocab(_flagged_counts(spark, sf, dictionary, words)))


@query("word_counts", f"""WITH {S.PAIR_TOKENS}
SELECT word, count(*)::BIGINT AS cnt FROM ptok GROUP BY word""")
def word_counts(spark, sf):
    """A1 + U1: counts of whitespace tokens over texts and summaries."""
    counts = V.word_stats(*T.pair_streams(B.pairs(spark, sf)))
    return counts.select("word", F.col("cnt").cast("long").alias("cnt"))


@query("distinct_words", f"""WITH {S.PAIR_TOKENS}
SELECT count(DISTINCT word)::BIGINT AS n_words FROM ptok""")
def distinct_words(spark, sf):
    """A2."""
    return V.distinct_words(T.pair_tokens(B.pairs(spark, sf)))


FREQ_SQL = f"""WITH {S.CORPUS_TOKENS},
cnt AS (SELECT word, count(*) AS cnt, min({{'doc': doc, 'pos': pos}}) AS first FROM ctok GROUP BY word),
top AS (SELECT row_number() OVER (ORDER BY cnt DESC, first)::BIGINT AS id, word, cnt::BIGINT AS cnt
        FROM cnt WHERE word <> 'UNK' QUALIFY id <= __N__)
SELECT 0::BIGINT AS id, 'UNK' AS word,
       ((SELECT count(*) FROM ctok) - coalesce((SELECT sum(cnt) FROM top), 0))::BIGINT AS cnt
UNION ALL SELECT id, word, cnt FROM top"""


def _frequency_vocab(spark, sf, size):
    return V.frequency_vocab(V.word_stats(B.corpus_text(spark, sf), "pair_id", [(0, F.col("text"))]), size)


@query("frequency_vocab", FREQ_SQL.replace("__N__", str(W1_SIZE - 1)))
def frequency_vocab(spark, sf):
    """W1 + A7: UNK = 0 (count = tokens outside), then the 19,999 most common words."""
    return _frequency_vocab(spark, sf, W1_SIZE)


@query("top_words", FREQ_SQL.replace("__N__", "99"))
def top_words(spark, sf):
    """W1 cut to 100 entries: the flagship slice documents -> pairs -> tokens -> counts -> top."""
    return _frequency_vocab(spark, sf, 100)


@query("dictionary_coverage", f"""WITH {S.FIRST_SEEN_VOCAB}
SELECT word, cnt::BIGINT AS cnt, has_vec FROM wcf""")
def dictionary_coverage(spark, sf):
    """Every counted word with its dictionary membership."""
    return _flagged_counts(spark, sf).select("word", F.col("cnt").cast("long").alias("cnt"), "has_vec")


@query("missing_words", f"""WITH {S.FIRST_SEEN_VOCAB}
SELECT sum(CASE WHEN cnt > 2 AND NOT has_vec THEN 1 ELSE 0 END)::BIGINT AS missing_words,
       count(*)::BIGINT AS n_words,
       round((round(sum(CASE WHEN cnt > 2 AND NOT has_vec THEN 1 ELSE 0 END) / count(*), 4) * 100)::DOUBLE, 6) AS missing_pct
FROM wcf""")
def missing_words(spark, sf):
    """A3: frequent words (count > 2) without a vector."""
    return V.missing_words(_flagged_counts(spark, sf)).withColumn("missing_pct", F.round("missing_pct", 6))


@query("first_seen_vocab", f"""WITH {S.FIRST_SEEN_VOCAB}
SELECT id, word, cnt FROM vocab""")
def first_seen_vocab(spark, sf):
    """W2 + P10 + U3: first-appearance ids of kept words, then <UNK> <PAD> <EOS> <GO>."""
    return first_seen(spark, sf)


@query("usage_ratio", f"""WITH {S.FIRST_SEEN_VOCAB}
SELECT (SELECT count(*) FROM vocab)::BIGINT AS vocab_size, (SELECT count(*) FROM wc)::BIGINT AS n_words,
       round((round((SELECT count(*) FROM vocab) / (SELECT count(*) FROM wc), 4) * 100)::DOUBLE, 6) AS usage_pct""")
def usage_ratio(spark, sf):
    """A4."""
    counts = cut_lineage(_flagged_counts(spark, sf))
    return V.usage_ratio(V.first_seen_vocab(counts), counts).withColumn("usage_pct", F.round("usage_pct", 6))


@query("dictionary_vocab", f"""WITH {S.DICTIONARY},
ranked AS (SELECT (row_number() OVER (ORDER BY pos))::BIGINT AS id, word, vec FROM dict WHERE word NOT IN ('<PAD>', '<GO>', '<EOS>')),
n AS (SELECT count(*) AS n, max(len(vec)) AS dim FROM ranked)
SELECT id, word, len(vec)::INTEGER AS dim,
       {S.vprint_sql('vec', 6)} AS vec
FROM ranked
UNION ALL SELECT 0, '<PAD>', dim::INTEGER, {S.vprint_sql('list_transform(range(dim), lambda i: 0)', 6)} FROM n
UNION ALL SELECT n + 1, '<GO>', dim::INTEGER, {S.vprint_sql('list_transform(range(dim), lambda i: 1)', 6)} FROM n
UNION ALL SELECT n + 2, '<EOS>', dim::INTEGER, {S.vprint_sql('list_transform(range(dim), lambda i: 2)', 6)} FROM n""")
def dictionary_vocab(spark, sf):
    """<PAD> = 0, dictionary words in file order, <GO>, <EOS>, with their vectors."""
    v = V.dictionary_vocab(B.dictionary(spark, sf))
    return v.select("id", "word", F.size("vec").alias("dim"), F.array_join(F.transform("vec", lambda x: F.round(x.cast("double") * 10 ** 6).cast("long")), " ").alias("vec"))


def encode_side(spark, sf, side, vocab=None, unk="<UNK>"):
    vocab = first_seen(spark, sf) if vocab is None else vocab
    unk_id = V.lookup_id(vocab, unk)
    return V.encode_texts(B.pairs(spark, sf), "pair_id", side, vocab, unk_id)


@query("encode_text", f"""WITH {S.FIRST_SEEN_VOCAB},
enc AS ({S.encoded('text')})
SELECT pair_id, array_to_string(ids, ' ') AS ids, len(ids)::INTEGER AS n_ids FROM enc""")
def encode_text(spark, sf):
    """Q1 + J4: text -> ids through the first-seen vocabulary, unknown -> <UNK>."""
    e = encode_side(spark, sf, "text")
    return e.select("pair_id", F.array_join("ids", " ").alias("ids"), F.size("ids").alias("n_ids"))


@query("unk_stats", f"""WITH {S.FIRST_SEEN_VOCAB},
et AS ({S.encoded('text')}), es AS ({S.encoded('summary')}),
u AS (SELECT (SELECT id FROM vocab WHERE word = '<UNK>') AS unk),
allids AS (SELECT ids FROM et UNION ALL SELECT ids FROM es)
SELECT sum(len(ids))::BIGINT AS word_count,
       sum(len(list_filter(ids, lambda x: x = unk)))::BIGINT AS unk_count,
       round((round(sum(len(list_filter(ids, lambda x: x = unk))) / sum(len(ids)), 4) * 100)::DOUBLE, 6) AS unk_pct
FROM allids, u""")
def unk_stats(spark, sf):
    """A5: tokens, UNKs and UNK percent over texts and summaries (no <EOS> counted)."""
    words = B.word_table(spark, sf)
    return V.unknown_tokens(words, first_seen(spark, sf, words=words)).withColumn("unk_pct", F.round("unk_pct", 6))


@query("unk_per_sequence", f"""WITH {S.FIRST_SEEN_VOCAB},
et AS ({S.encoded('text')}), es AS ({S.encoded('summary')}),
u AS (SELECT (SELECT id FROM vocab WHERE word = '<UNK>') AS unk)
SELECT pair_id, 'text' AS side, len(list_filter(ids, lambda x: x = unk))::INTEGER AS unk FROM et, u
UNION ALL
SELECT pair_id, 'summary', len(list_filter(ids, lambda x: x = unk))::INTEGER FROM es, u""")
def unk_per_sequence(spark, sf):
    """UNK count of every encoded text and summary."""
    vocab = first_seen(spark, sf)
    unk = V.lookup_id(vocab, "<UNK>")
    e = V.encode_many(B.pairs(spark, sf), "pair_id", ["text", "summary"], vocab, unk)
    n_unk = lambda c: F.size(F.filter(c, lambda x: x == unk)).alias("unk")
    sides = F.array(*[F.struct(F.lit(s).alias("side"), n_unk(f"{s}_ids")) for s in ("text", "summary")])  # each pair is encoded once
    return e.select("pair_id", F.explode(sides).alias("x")).select("pair_id", "x.side", "x.unk")


@query("decode_text", f"""WITH {S.FIRST_SEEN_VOCAB},
et AS ({S.encoded('text')}), es AS ({S.encoded('summary')}),
e AS (SELECT pair_id, 'text' AS side, ids FROM et UNION ALL SELECT pair_id, 'summary', ids FROM es),
d AS (SELECT e.pair_id, e.side, u.pos, e.ids[u.pos + 1] AS tid FROM e, unnest(range(len(e.ids))) AS u(pos))
SELECT e.pair_id, e.side, coalesce(string_agg(coalesce(v.word, ''), ' ' ORDER BY d.pos), '') AS text
FROM e LEFT JOIN d ON d.pair_id = e.pair_id AND d.side = e.side LEFT JOIN vocab v ON v.id = d.tid
GROUP BY e.pair_id, e.side""")
def decode_text(spark, sf):
    """Text and summary ids back to words (unknown words come back as <UNK>)."""
    vocab = first_seen(spark, sf)
    e = cut_lineage(V.encode_many(B.pairs(spark, sf), "pair_id", ["text", "summary"], vocab, V.lookup_id(vocab, "<UNK>")))
    d = V.decode_many(e, "pair_id", ["text_ids", "summary_ids"], vocab)
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_ids").alias("text")) for s in ("text", "summary")])
    return d.select("pair_id", F.explode(sides).alias("x")).select("pair_id", "x.side", "x.text")
