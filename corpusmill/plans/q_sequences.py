"""Length statistics, example filter and batches: A8-A11, P9, P11, T1, W5, Q2-Q10."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import join_words, ws_tokens
from corpusmill.operators import sequences as Q
from corpusmill.operators import vocab as V
from corpusmill.plans import bindings as B
from corpusmill.plans import sqlparts as S
from corpusmill.plans.q_vocab import first_seen
from corpusmill.plans.registry import query
from corpusmill.session import cut_lineage

BATCH = 64          # batch_size of pipeline v3
FIXED = 400         # fixed pad width of pipeline v1
SUMMARY_CAP = 50    # summary limit of pipeline v4


def specials(vocab: DataFrame) -> dict[str, int]:
    """Ids of the four special tokens (one bounded read of four rows)."""
    rows = vocab.filter(F.col("word").isin(V.SPECIALS_FIRST_SEEN)).select("word", "id").collect()
    return {r["word"]: int(r["id"]) for r in rows}


def encoded_examples(spark, sf, sides=("text", "summary"), limits=None):
    """``(pair_id, t, s)``: text ids with ``<EOS>`` (Q2, v3) and summary ids, or one of them, within ``limits`` of tokens; plus special ids."""
    vocab = first_seen(spark, sf)
    sp = specials(vocab)
    e = V.encode_many(B.pairs(spark, sf), "pair_id", list(sides), vocab, sp["<UNK>"], limits=limits)
    cols = {"text": lambda: Q.append_eos(F.col("text_ids"), sp["<EOS>"]).alias("t"), "summary": lambda: F.col("summary_ids").alias("s")}
    return e.select("pair_id", *[cols[s]() for s in sides]), sp


def kept_examples(spark, sf):
    # Encoding keeps lengths, so texts that P9 drops for their length need not be encoded (<EOS> is one of the text's ids).
    ex, sp = encoded_examples(spark, sf, limits={"text": Q.MAX_TEXT_LENGTH - 2, "summary": Q.MAX_SUMMARY_LENGTH})
    return ex.filter(Q.example_filter(F.col("t"), F.col("s"), sp["<UNK>"])), sp


def example_lengths(kept):
    """``(pair_id, len)`` of the examples, materialised: all that the order of batches depends on, encoded once."""
    return cut_lineage(kept.select("pair_id", F.size("t").alias("len")))


def batches(spark, sf):
    """T1 + W5 + Q5 + Q6 on the kept examples."""
    kept, sp = kept_examples(spark, sf)
    kept = cut_lineage(kept)  # ranked, counted and joined: encoded once (an example has at most 430 ids)
    b = Q.assign_batches(kept, [F.size("t"), F.col("pair_id")], BATCH)
    b = Q.pad_in_batch(b, "t", sp["<PAD>"], "text")
    b = Q.pad_in_batch(b, "s", sp["<PAD>"], "summary")
    return b, sp


def _ids(c):
    return join_words(c)


@query("max_lengths", f"""WITH {S.PAIRS}
SELECT max(len({S.ws('text')}))::INTEGER AS max_text_len,
       max(len({S.ws('summary')}))::INTEGER AS max_summary_len FROM pairs""")
def max_lengths(spark, sf):
    """Longest text and summary in whitespace tokens."""
    p = B.pairs(spark, sf)
    return p.agg(F.max(F.size(ws_tokens(F.col("text")))).alias("max_text_len"),
                 F.max(F.size(ws_tokens(F.col("summary")))).alias("max_summary_len"))


def _side_lengths(spark, sf, eos=1):
    """Lengths per side from one scan; encoding keeps lengths, so none is needed (texts count ``eos`` end ids)."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), (F.size(ws_tokens(F.col(s))) + n).alias("len"))
                      for s, n in (("text", eos), ("summary", 0))])
    return B.pairs(spark, sf).select(F.explode(sides).alias("x")).select("x.side", "x.len")


SIDE_LENGTHS = """lens AS (SELECT 'text' AS side, len(t) AS len FROM ex UNION ALL SELECT 'summary', len(s) FROM ex)"""


@query("length_summary", f"""WITH {S.SEQ}, {SIDE_LENGTHS}
SELECT side, count(*)::BIGINT AS count, round(avg(len), 6) AS mean, round(stddev_samp(len), 6) AS std,
       min(len)::BIGINT AS min, round(quantile_cont(len, 0.25), 6) AS p25, round(quantile_cont(len, 0.5), 6) AS p50,
       round(quantile_cont(len, 0.75), 6) AS p75, max(len)::BIGINT AS max
FROM lens GROUP BY side""")
def length_summary(spark, sf):
    """describe() of encoded lengths per side (text lengths include <EOS>)."""
    out = Q.length_summary(_side_lengths(spark, sf), "side", "len")
    for c in ("mean", "std", "p25", "p50", "p75"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@query("length_percentiles", f"""WITH {S.SEQ}, {SIDE_LENGTHS}
SELECT side, round(quantile_cont(len, 0.9), 6) AS p90, round(quantile_cont(len, 0.95), 6) AS p95,
       round(quantile_cont(len, 0.99), 6) AS p99
FROM lens GROUP BY side""")
def length_percentiles(spark, sf):
    """A10: 90th, 95th and 99th percentile of encoded lengths, linear interpolation."""
    out = Q.length_percentiles(_side_lengths(spark, sf), "side", "len")
    for c in ("p90", "p95", "p99"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@query("length_histogram", f"""WITH {S.PAIRS},
lens AS (SELECT 'text' AS side, len({S.ws('text')}) AS len FROM pairs
         UNION ALL SELECT 'summary', len({S.ws('summary')}) FROM pairs),
st0 AS (SELECT side, min(len)::DOUBLE AS lo, max(len)::DOUBLE AS hi FROM lens GROUP BY side),
st AS (SELECT side, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo,
              CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi FROM st0),
c AS (SELECT l.side, least(floor((l.len - st.lo) * 20 / (st.hi - st.lo))::INTEGER + 1, 20) AS bin, count(*) AS n
      FROM lens l JOIN st ON l.side = st.side GROUP BY ALL),
g AS (SELECT side, lo, hi, unnest(range(1, 21)) AS bin FROM st)
SELECT g.side, g.bin::INTEGER AS bin, round(g.lo + (g.bin - 1) * (g.hi - g.lo) / 20, 6) AS lo,
       round(g.lo + g.bin * (g.hi - g.lo) / 20, 6) AS hi, coalesce(c.n, 0)::BIGINT AS n
FROM g LEFT JOIN c ON g.side = c.side AND g.bin = c.bin""")
def length_histogram(spark, sf):
    """20 equal-width bins of whitespace-token lengths per side, empty bins kept."""
    h = Q.length_histogram(_side_lengths(spark, sf, eos=0), "side", "len", 20)
    return h.withColumn("lo", F.round("lo", 6)).withColumn("hi", F.round("hi", 6))


@query("encode_text_eos", f"""WITH {S.SEQ}
SELECT pair_id, array_to_string(t, ' ') AS ids FROM ex""")
def encode_text_eos(spark, sf):
    """Q2: text ids with <EOS> appended (pipeline v3)."""
    ex, _ = encoded_examples(spark, sf, ["text"])
    return ex.select("pair_id", _ids(F.col("t")).alias("ids"))


@query("example_filter", f"""WITH {S.SEQ}
SELECT pair_id, len(t)::INTEGER AS text_len, len(s)::INTEGER AS summary_len FROM kept""")
def example_filter(spark, sf):
    """2 <= summary <= 30, 2 <= text < 400 (with <EOS>), UNKs <= 5 / <= 30."""
    kept, _ = kept_examples(spark, sf)
    return kept.select("pair_id", F.size("t").alias("text_len"), F.size("s").alias("summary_len"))


@query("batch_assignment", f"""WITH {S.SEQ}
SELECT pair_id, rn, batch_id, slot FROM batched""")
def batch_assignment(spark, sf):
    """T1 + W5: kept examples by (text length, pair id), batches of 64, last partial batch dropped."""
    kept, _ = kept_examples(spark, sf)
    return Q.assign_batches(example_lengths(kept), [F.col("len"), F.col("pair_id")], BATCH).select(
        "pair_id", "rn", "batch_id", "slot")


@query("batch_table", f"""WITH {S.SEQ}
SELECT batch_id, slot, pair_id, array_to_string(tp, ' ') AS text_ids, array_to_string(spd, ' ') AS summary_ids,
       text_len, summary_len, text_padded_len, summary_padded_len FROM padded2""")
def batch_table(spark, sf):
    """Q10 + Q5 + Q6: each side padded with <PAD> to its batch maximum; true and padded lengths."""
    b, _ = batches(spark, sf)
    return b.select("batch_id", "slot", "pair_id", _ids(F.col("t")).alias("text_ids"),
                    _ids(F.col("s")).alias("summary_ids"), "text_len", "summary_len",
                    "text_padded_len", "summary_padded_len")


@query("decoder_inputs", f"""WITH {S.SEQ}
SELECT batch_id, slot, array_to_string(list_prepend(sp.go, spd[1:len(spd) - 1]), ' ') AS dec_ids FROM padded2, sp""")
def decoder_inputs(spark, sf):
    """Q7: <GO> then the padded summary without its last id."""
    b, sp = batches(spark, sf)
    return b.select("batch_id", "slot", _ids(Q.decoder_input(F.col("s"), sp["<GO>"])).alias("dec_ids"))


@query("batch_masks", f"""WITH {S.SEQ}
SELECT batch_id, slot,
       array_to_string(list_transform(range(1, summary_padded_len + 1), lambda i: CASE WHEN i <= summary_len THEN 1 ELSE 0 END), ' ') AS mask,
       summary_len::DOUBLE AS mask_sum
FROM padded2""")
def batch_masks(spark, sf):
    """Q8: summary mask, 1 below the true length, up to the batch maximum."""
    b, _ = batches(spark, sf)
    m = Q.mask(F.col("summary_len"), F.col("summary_padded_len"))
    return b.select("batch_id", "slot",
                    _ids(F.transform(m, lambda x: x.cast("int"))).alias("mask"),
                    F.aggregate(m, F.lit(0.0), lambda a, x: a + x).alias("mask_sum"))


@query("reversed_inputs", f"""WITH {S.SEQ}
SELECT batch_id, slot, array_to_string(list_reverse(tp), ' ') AS rev_ids FROM padded2""")
def reversed_inputs(spark, sf):
    """Q9: padded text reversed."""
    b, _ = batches(spark, sf)
    return b.select("batch_id", "slot", _ids(Q.reverse(F.col("t"))).alias("rev_ids"))


@query("remove_pad", f"""WITH {S.SEQ}
SELECT batch_id, slot, array_to_string(list_filter(spd, lambda x: x <> sp.pad), ' ') AS ids FROM padded2, sp""")
def remove_pad(spark, sf):
    """Pad ids removed from the padded summaries."""
    b, sp = batches(spark, sf)
    return b.select("batch_id", "slot", _ids(Q.remove_pad(F.col("s"), sp["<PAD>"])).alias("ids"))


@query("pad_fixed", f"""WITH {S.SEQ}
SELECT pair_id, array_to_string(list_resize(t, {FIXED}, sp.pad), ' ') AS ids, least(len(t), {FIXED})::INTEGER AS len
FROM ex, sp""")
def pad_fixed(spark, sf):
    """Q4 + Q6 (v1): text ids cut or padded to 400, length capped at 400."""
    ex, sp = encoded_examples(spark, sf, ["text"])
    return ex.select("pair_id", _ids(Q.pad_to(F.col("t"), FIXED, sp["<PAD>"])).alias("ids"),
                     Q.capped_len(F.col("t"), FIXED).alias("len"))


@query("truncate_summaries", f"""WITH {S.SEQ}
SELECT pair_id, array_to_string(s[1:{SUMMARY_CAP}], ' ') AS ids FROM ex""")
def truncate_summaries(spark, sf):
    """Q3: summary ids cut to 50 (each side has its own limit)."""
    ex, _ = encoded_examples(spark, sf, ["summary"])
    return ex.select("pair_id", _ids(Q.truncate(F.col("s"), SUMMARY_CAP)).alias("ids"))


@query("split_lengths", f"""WITH {S.PAIRS}
SELECT pair_id, len(string_split(text, ' '))::INTEGER AS text_len,
       len(string_split(summary, ' '))::INTEGER AS summary_len FROM pairs""")
def split_lengths(spark, sf):
    """F3 / Q6 (v4): lengths by split(' '), empty pieces counted."""
    from corpusmill.functions.text import space_split_len
    p = B.pairs(spark, sf)
    return p.select("pair_id", space_split_len(F.col("text")).alias("text_len"),
                    space_split_len(F.col("summary")).alias("summary_len"))
