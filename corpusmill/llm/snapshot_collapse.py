"""Operator 5, chat formatting: cumulative-snapshot collapse.

Chat logs often hold the same conversation several times, each snapshot a few turns longer.  Every turn gets the
rolling hash of the turns up to it; a conversation whose last hash appears inside a longer one is a
prefix of it and goes, and of equal conversations the one with the smallest id stays.  What remains is
rendered turn by turn.

The rolling hash is a sum of hashes of ``(place, role, text)``, so prefixes are running sums and a long
conversation's rows can lie in many tasks: rows are numbered and summed per range of turns first, and
every range then takes the total of the ranges before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import table, written

TURNS_PER_RANGE = 1024


def _hash(seed: int) -> Column:
    """Part of the rolling hash: 64 bits of the turn's place, role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return F.xxhash64(F.lit(seed), "place", F.col("role").isNull(), role, F.length(role), text).cast("decimal(20,0)")


def _ordered() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]


def with_prefix_hashes(turns: DataFrame, per_range: int = TURNS_PER_RANGE) -> DataFrame:
    """Add ``place`` (1, 2, ... in a conversation) and ``prefix``, a 128-bit rolling hash, to each row.

    ``turns``: ``conv_id, turn, role, text``.  Turns are ordered by number, then role and text; numbers may have gaps
    or repeat.  Null texts count as empty.
    """
    t = turns.select("conv_id", "turn", "role", "text").withColumn("__range", F.floor(F.coalesce("turn", F.lit(-1)) / per_range))
    part = ["conv_id", "__range"]
    t = t.withColumn("__row", F.row_number().over(Window.partitionBy(*part).orderBy(*_ordered())))
    sizes = turns.select("conv_id", F.floor(F.coalesce("turn", F.lit(-1)) / per_range).alias("__range")).groupBy(*part).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("conv_id").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("conv_id").alias("__c"), F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    same = F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("__range") == F.col("__r"))
    t = (t.join(offsets, same).withColumn("place", F.col("__before") + F.col("__row"))
         .select("conv_id", "turn", "role", "text", "place", "__range", _hash(1).alias("__h1"), _hash(2).alias("__h2")))
    upto = Window.partitionBy(*part).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = t.groupBy(*part).agg(F.sum("__h1").alias("__s1"), F.sum("__h2").alias("__s2"))
    zero = F.lit(0).cast("decimal(38,0)")
    sums = sums.select(F.col("conv_id").alias("__c"), F.col("__range").alias("__r"),
                       *[F.coalesce(F.sum(s).over(before), zero).alias(b) for s, b in (("__s1", "__b1"), ("__s2", "__b2"))])
    both = [(F.col(b) + F.sum(h).over(upto)).cast("decimal(38,0)") for h, b in (("__h1", "__b1"), ("__h2", "__b2"))]
    return t.join(sums, same).select("conv_id", "turn", "role", "text", "place", F.struct(both[0].alias("a"), both[1].alias("b")).alias("prefix"))


def maximal_conversations(hashed: DataFrame) -> DataFrame:
    """``conv_id, n_turns`` of the conversations that are no prefix (and no later copy) of another.

    ``hashed``: rows of ``with_prefix_hashes``.  Prefixes are made distinct before the anti-join, so an opening that a
    third of all conversations share is one row.
    """
    whole = hashed.groupBy("conv_id").agg(F.max("place").alias("n_turns"), F.max_by("prefix", "place").alias("prefix"))
    first = whole.groupBy("n_turns", "prefix").agg(F.min("conv_id").alias("conv_id"))
    ends = whole.select("conv_id", F.col("n_turns").alias("n"))
    inside = (hashed.select("conv_id", "place", "prefix").join(ends.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")))
              .where("place < n").select(F.col("place").alias("n_turns"), "prefix").distinct())
    return first.join(inside, ["n_turns", "prefix"], "left_anti").select("conv_id", "n_turns")


def rendered(text: Column, role: Column) -> Column:
    """One turn in the chat template."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def collapse(turns: DataFrame) -> DataFrame:
    """Rendered turns of the maximal conversations: ``conv_id, place, n_turns, rendered``.

    The pieces of a conversation in order of ``place`` are its rendered text; they stay apart because a conversation may be longer than a
    task can hold.  Null conversation ids form one conversation; rows with null roles or texts render them empty;
    an empty table gives an empty result.
    """
    h = written(with_prefix_hashes(turns), "chat-prefixes")
    m = maximal_conversations(h).withColumnRenamed("conv_id", "c")
    return (h.join(m, F.col("conv_id").eqNullSafe(F.col("c")))
            .select("conv_id", "place", "n_turns", rendered(F.col("text"), F.col("role")).alias("rendered")))


def op5_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered turns of all conversations that are no prefix of another one."""
    return collapse(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, chr(1)) AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place
           FROM conversations),
n AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n_turns,
             list(concat(role, chr(2), text)) OVER (PARTITION BY conv_id ORDER BY place) AS prefix FROM t),
whole AS (SELECT conv_id, n_turns, prefix FROM n WHERE place = n_turns),
kept AS (SELECT n_turns, min(conv_id) AS conv_id, prefix FROM whole GROUP BY n_turns, prefix),
inside AS (SELECT DISTINCT place AS n_turns, prefix FROM n WHERE place < n_turns),
maximal AS (SELECT conv_id FROM kept ANTI JOIN inside USING (n_turns, prefix))
SELECT conv_id, place, n_turns,
       concat('<|', CASE WHEN role = chr(1) THEN '' ELSE role END, '|>', chr(10), text, '<|end|>', chr(10)) AS rendered
FROM n JOIN maximal USING (conv_id)
"""
