"""Debate records: flatten (X10), sentence rows (X11), outline (X12), ids (W4),
and the flat claim-record shape of the JSON sink (S8).

A debate is ``(debate_key, name)`` with claim rows ``(debate_key, is_opposing, pos, claim, argument,
counter)`` (``flatten_claims``), or, where it is small, ``(debate_key, name, for_claims, against_claims)`` with
lists ``array<struct<claim, argument, counter>>`` in page order (``flatten_debates``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import cut_references, id_string, remove_quotes, split_argument
from corpusmill.operators.joins import spread_join
from corpusmill.operators.ranking import global_row_number

# --- fixed values -----------------------------------------------------------
FIRST_DEBATE_ID = 1000000
OUTLINE_FOR, OUTLINE_AGAINST = "  for: ", "  against: "
OUTLINE_ARGUMENT, OUTLINE_COUNTER = "    argument: ", "    counter: "
# ---------------------------------------------------------------------------

CLAIM_TYPE = "array<struct<claim:string,argument:string,counter:string>>"


def number_debates(debates: DataFrame, key: str = "debate_key") -> DataFrame:
    """``debate_id = 1000000 + rank`` of the (unique) debate key, a deterministic order; only
    the keys are ranked, the debates are joined back."""
    ids = global_row_number(debates.select(key), [F.col(key)], "__r", start=FIRST_DEBATE_ID)
    return debates.join(ids, key).withColumn("debate_id", F.col("__r").cast("long")).drop("__r")


def flatten_debates(debates: DataFrame) -> DataFrame:
    """One row per claim - supporting claims first, then opposing ones;
    ``claim_no`` counts across both lists."""
    tagged = F.concat(
        F.transform(F.coalesce(F.col("for_claims"), F.array().cast(CLAIM_TYPE)),
                    lambda c: F.struct(F.lit(False).alias("is_opposing"), c["claim"].alias("claim"),
                                       c["argument"].alias("argument"), c["counter"].alias("counter"))),
        F.transform(F.coalesce(F.col("against_claims"), F.array().cast(CLAIM_TYPE)),
                    lambda c: F.struct(F.lit(True).alias("is_opposing"), c["claim"].alias("claim"),
                                       c["argument"].alias("argument"), c["counter"].alias("counter"))))
    return debates.select("debate_id", "name", F.posexplode(tagged).alias("claim_no", "c")).select(
        "debate_id", "name", F.col("claim_no").cast("long").alias("claim_no"), "c.*")


def flatten_claims(claims: DataFrame, debates: DataFrame) -> DataFrame:
    """X10 over claim rows, for debates of any length.

    ``claims (debate_key, is_opposing, pos, claim, argument, counter)``, ``pos`` = place on its side from 0;
    ``debates (debate_key, debate_id, name)``.  Opposing claims count on from the supporting ones.
    """
    n_for = claims.where(~F.col("is_opposing")).groupBy("debate_key").agg(F.count(F.lit(1)).alias("__for"))
    heads = debates.select("debate_key", "debate_id", "name").join(n_for, "debate_key", "left")
    rows = spread_join(claims, heads, ["debate_key"], F.col("pos"))
    number = F.col("pos") + F.when(F.col("is_opposing"), F.coalesce("__for", F.lit(0))).otherwise(0)
    return rows.select("debate_id", "name", number.cast("long").alias("claim_no"), "is_opposing", "claim", "argument", "counter")


def claim_sentences(claims: DataFrame) -> DataFrame:
    """X11 + X5 + P7 + P8: sentence rows of each claim, argument first then counter,
    numbered by one running counter (it does not restart for the counter)."""
    arg = F.transform(F.coalesce(split_argument(F.col("argument")), F.array().cast("array<string>")),
                      lambda s: F.struct(F.lit("argument").alias("side"), s.alias("sentence")))
    ctr = F.transform(F.coalesce(split_argument(F.col("counter")), F.array().cast("array<string>")),
                      lambda s: F.struct(F.lit("counter").alias("side"), s.alias("sentence")))
    rows = claims.select("debate_id", "claim_no", F.posexplode(F.concat(arg, ctr)).alias("sno", "s"))
    return rows.select("debate_id", "claim_no", F.col("sno").cast("long").alias("sno"),
                       id_string(F.col("debate_id"), F.col("claim_no"), F.col("sno")).alias("sentence_id"),
                       "s.side", "s.sentence")


def claim_records(claims: DataFrame) -> DataFrame:
    """S8 shape: the flat claim object, sentence maps keyed ``debate_claim_sentence``.

    Quotes are removed from claim and debate name as the reference does; the JSON
    writer escapes everything else, so the output is valid JSON.
    """
    none = F.array().cast("array<string>")
    c = claims.withColumn("__a", F.coalesce(split_argument(F.col("argument")), none)).withColumn(
        "__c", F.coalesce(split_argument(F.col("counter")), none))

    def entries(col: str, first: Column) -> Column:
        return F.map_from_entries(F.transform(F.col(col), lambda s, i: F.struct(
            F.format_string("%d_%d_%d", F.col("debate_id"), F.col("claim_no"), i + first).alias("key"), s.alias("value"))))
    return c.select(
        F.col("debate_id").cast("string").alias("_debate_id"),
        remove_quotes(F.col("claim")).alias("_claim"),
        F.when(F.col("is_opposing"), "true").otherwise("false").alias("_is_opposing"),
        entries("__a", F.lit(0)).alias("_argument_sentences"),
        entries("__c", F.size("__a")).alias("_counter_sentences"),
        remove_quotes(F.col("name")).alias("_debate_name"),
        id_string(F.col("debate_id"), F.col("claim_no")).alias("_claim_id"))


def outline(claims: DataFrame, debates: DataFrame) -> DataFrame:
    """Report lines ``(debate_id, line_no, kind, text)`` of ``debates (debate_id, name)``.

    Every debate has its name line, also one without claims.  Per debate: its name, then per claim ``for:``/``against:``, its argument
    sentences and its counter sentences, each cut at the reference list (X6).
    """
    def sent_lines(col: str, kind: str, prefix: str, order: int) -> Column:
        s = F.coalesce(split_argument(cut_references(F.col(col))), F.array().cast("array<string>"))
        return F.transform(s, lambda x, i: F.struct(F.lit(order).alias("o"), i.alias("i"), F.lit(kind).alias("kind"),
                                                    F.concat(F.lit(prefix), x).alias("text")))

    head = F.array(F.struct(F.lit(0).alias("o"), F.lit(0).alias("i"),
                            F.when(F.col("is_opposing"), "against").otherwise("for").alias("kind"),
                            F.concat(F.when(F.col("is_opposing"), OUTLINE_AGAINST).otherwise(OUTLINE_FOR),
                                     F.col("claim")).alias("text")))
    per_claim = claims.select("debate_id", "claim_no", F.explode(F.concat(
        head, sent_lines("argument", "argument", OUTLINE_ARGUMENT, 1),
        sent_lines("counter", "counter", OUTLINE_COUNTER, 2))).alias("l"))
    lines = per_claim.select("debate_id", F.struct(F.lit(1).alias("t"), "claim_no", "l.o", "l.i").alias("k"),
                             "l.kind", "l.text")
    names = debates.select(
        "debate_id", F.struct(F.lit(0).alias("t"), F.lit(0).cast("long").alias("claim_no"), F.lit(0).alias("o"),
                              F.lit(0).alias("i")).alias("k"),
        F.lit("debate").alias("kind"), F.col("name").alias("text"))
    allr = names.unionByName(lines)
    # Per-debate line numbers from the distributed row number: a debate holding
    # a third of all claims still spreads over many tasks.
    return global_row_number(allr, [F.col("k")], "line_no", partition_by=["debate_id"]).select(
        "debate_id", "line_no", "kind", "text")
