"""Operator 2, mixing sources to target weights: Pfair scheduling (DataFrame and SQL functions only).

Each source's documents form blocks.  With integer weights ``q`` that add up to ``Q``, block ``i`` of a
source is released at slot ``floor(i * Q / q)`` and due at slot ``ceil((i + 1) * Q / q)``.  Earliest
deadline first over the released blocks serves every block in its window, so after any number of
slots each source is less than one block away from its target share.  The windows repeat every ``Q``
slots, so one cycle is scheduled and every block gets ``(cycle, slot)`` by arithmetic; sorting by these
mixes any number of documents.

Every document stays.  When a source has no blocks left, later cycles are scheduled for the remaining
sources, whose weights keep their proportions; there are at most as many such phases as sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import table

BLOCK_DOCS = 64
WEIGHT_UNITS = 200
ALPHA = 0.5


NEEDED, PLACE = ("doc_id", "text", "source"), ("nr", "block", "cycle", "slot")


def order_key() -> Column:
    """Order of documents within a source: a digest of id and text, the same on every run."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))).cast("binary"))


def tempered_weights(counts: DataFrame, alpha: float = ALPHA, units: int = WEIGHT_UNITS) -> DataFrame:
    """Integer weights ``(source, q)`` in proportion to ``n ** alpha`` (1 at least), about ``units`` in all."""
    total = Window.partitionBy(F.lit(1))  # one row per source
    x = F.pow(F.col("n").cast("double"), F.lit(alpha))
    return counts.select("source", F.greatest(F.lit(1), F.floor(x / F.sum(x).over(total) * units + 0.5)).cast("int").alias("q"))


def cycle_schedule(phases: DataFrame) -> DataFrame:
    """Earliest deadline first over one cycle of each phase.

    ``phases``: ``phase, sources`` with ``sources`` an array of ``struct(source, q)``.  Returns ``phase,
    source, i, slot``: block ``i`` of the cycle runs at ``slot``.  Ties go to the earlier release, then to
    the source's place in the array.  The work is ``Q * sources`` per phase and does not depend on the
    number of documents.
    """
    total = "aggregate(sources, 0L, (s, x) -> s + x.q)"
    # The released source with the earliest deadline; `done` counts the blocks each source has had.
    pick = """
      array_min(filter(transform(sources, (x, j) -> struct(
          CAST(ceil((done[j] + 1) * total / CAST(x.q AS DOUBLE)) AS BIGINT) AS due, done[j] * total DIV x.q AS release, j AS at,
          done[j] AS i, x.q AS q)), y -> y.i < y.q AND y.release <= t))"""
    step = f"""
      aggregate(sequence(0L, total - 1), struct(transform(sources, x -> 0L) AS done,
          CAST(array() AS ARRAY<STRUCT<at: INT, i: BIGINT, slot: BIGINT>>) AS served),
        (acc, t) -> transform(array(transform(array(acc.done), done -> {pick})[0]), p -> if(p IS NULL, acc, struct(
            transform(acc.done, (d, j) -> if(j = p.at, d + 1, d)) AS done,
            concat(acc.served, array(struct(p.at AS at, p.i AS i, t AS slot))) AS served)))[0],
        acc -> acc.served)"""
    return (phases.withColumn("total", F.expr(total)).withColumn("x", F.explode(F.expr(step)))
            .select("phase", F.expr("sources[x.at].source").alias("source"), F.col("x.i").alias("i"), F.col("x.slot").alias("slot")))


def mix_schedule(counts: DataFrame, weights: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Rows ``source, q, first_cycle, last_cycle, i, slot``: the schedule of every phase.

    ``counts``: ``source, n``; ``weights``: ``source, q`` (a source without a weight, or with one below
    1, takes weight 1).  Sources and their weights are parameters of a mix, so these tables are small.
    """
    w = Window.partitionBy(F.lit(1)).orderBy("cycles", F.col("source").asc_nulls_first())
    s = (counts.join(weights.withColumnRenamed("source", "ws"), F.col("source").eqNullSafe(F.col("ws")), "left")
         .withColumn("q", F.greatest(F.coalesce("q", F.lit(1)), F.lit(1)).cast("long"))
         .withColumn("cycles", F.ceil(F.ceil(F.col("n") / block_docs) / F.col("q")))
         .withColumn("first_cycle", F.coalesce(F.max("cycles").over(
             Window.partitionBy(F.lit(1)).orderBy("cycles").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)))
         .withColumn("later", F.collect_list(F.struct("source", "q")).over(
             w.rowsBetween(Window.currentRow, Window.unboundedFollowing))))
    # Phase = the cycles after the last shorter source has ended; its sources are all that still have blocks.
    phases = s.groupBy("first_cycle", F.col("cycles").alias("last_cycle")).agg(
        F.max_by("later", F.size("later")).alias("sources"))
    phases = phases.withColumn("sources", F.array_sort("sources")).withColumn("phase", F.col("first_cycle"))
    plan = cycle_schedule(phases.select("phase", "sources"))
    return (plan.join(phases.select("phase", "first_cycle", "last_cycle"), "phase")
            .withColumnRenamed("source", "ps").join(s.select("source", "q"), F.col("ps").eqNullSafe(F.col("source")))
            .select("source", "q", "first_cycle", "last_cycle", "i", "slot"))


def numbered_by_source(docs: DataFrame, digits: int = 3) -> DataFrame:
    """Add ``nr``, the place of each row in its source by ``order_key`` (from 0).

    Rows are numbered within ``(source, leading digits of the key)``; the counts of these buckets, at most
    ``16 ** digits`` per source, give each bucket its offset.  No task holds a whole source.
    """
    keyed = (docs.withColumn("__key", order_key()).withColumn("__bucket", F.substring("__key", 1, digits))
             .withColumn("__src", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))))
    sizes = keyed.groupBy("__src", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__src").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__src", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    at = Window.partitionBy("__src", "__bucket").orderBy("__key")
    return (keyed.withColumn("__row", F.row_number().over(at)).join(offsets, ["__src", "__bucket"])
            .withColumn("nr", F.col("__before") + F.col("__row") - 1)
            .drop("__before", "__row", "__bucket", "__src"))


def mix(docs: DataFrame, weights: DataFrame | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Add ``block``, ``cycle``, ``slot`` and ``nr`` to every row of ``docs`` (``doc_id, text, source, ...``).

    Sorting by ``cycle, slot, nr`` gives the mix.  ``weights``: ``source, q``; without it, weights in
    proportion to the square root of the sources' sizes.  A null source is a source of its own; rows with
    equal id and text are numbered one after another; a null or empty text is an ordinary document.  Columns of
    these names that ``docs`` has already are replaced.  An empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c not in PLACE]
    docs = docs.select(*[F.col(f"`{c}`").alias(c if c in NEEDED else f"__c{i}") for i, c in enumerate(kept)])
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    plan = mix_schedule(counts, tempered_weights(counts) if weights is None else weights, block_docs)
    q = plan.select(F.col("source").alias("__qs"), F.col("q").alias("__q")).distinct()
    plan = plan.select(F.col("source").alias("__ps"), F.col("first_cycle").alias("__from"), F.col("last_cycle").alias("__to"),
                       F.col("i").alias("__i"), "slot")
    n = numbered_by_source(docs).withColumn("block", F.floor(F.col("nr") / block_docs))
    n = (n.join(F.broadcast(q), F.col("source").eqNullSafe(F.col("__qs")))  # one row per source
         .withColumn("cycle", F.floor(F.col("block") / F.col("__q"))))
    on = (F.col("source").eqNullSafe(F.col("__ps")) & (F.col("block") % F.col("__q") == F.col("__i"))
          & (F.col("cycle") >= F.col("__from")) & (F.col("cycle") < F.col("__to")))
    # The plan's size is set by the weights (about WEIGHT_UNITS rows a phase), not by the documents.
    return (n.join(F.broadcast(plan), on)
            .select(*[F.col(c if c in NEEDED else f"__c{i}").alias(c) for i, c in enumerate(kept)], *PLACE))


def in_mix_order(docs: DataFrame, weights: DataFrame | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``docs`` sorted by their place in the mix, columns unchanged whatever their names; written files keep this order."""
    own = [c if c in NEEDED else f"__c{i}" for i, c in enumerate(docs.columns)]
    mixed = mix(docs.toDF(*own), weights, block_docs).orderBy("cycle", "slot", "nr")
    return mixed.select(*[F.col(x).alias(c) for x, c in zip(own, docs.columns)])


def op2_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document in the mix of all sources, square-root weights, blocks of 64 documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "source", "nr", "block", "cycle", "slot").orderBy("cycle", "slot", "nr")


SQL = f"""
WITH RECURSIVE c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
w AS (SELECT source, n, greatest(1, floor(pow(n, {ALPHA}) / sum(pow(n, {ALPHA})) OVER () * {WEIGHT_UNITS} + 0.5))::BIGINT AS q FROM c),
s AS (SELECT *, ceil(ceil(n / {BLOCK_DOCS}.0) / q)::BIGINT AS cycles FROM w),
f AS (SELECT a.cycles AS last_cycle, coalesce((SELECT max(cycles) FROM s b WHERE b.cycles < a.cycles), 0) AS first_cycle
      FROM (SELECT DISTINCT cycles FROM s) a),
m AS (SELECT f.first_cycle, f.last_cycle, s.source, s.q, sum(s.q) OVER (PARTITION BY f.first_cycle) AS total
      FROM f JOIN s ON s.cycles > f.first_cycle),
jobs AS (SELECT *, (i * total // q)::BIGINT AS release, ceil((i + 1) * total / q::DOUBLE)::BIGINT AS due,
                row_number() OVER (PARTITION BY first_cycle ORDER BY ceil((i + 1) * total / q::DOUBLE), (i * total // q), source NULLS FIRST) AS job
         FROM m, LATERAL (SELECT unnest(generate_series(0, q - 1)) AS i)),
-- one slot after another: the released job that is due first
edf AS (
  SELECT first_cycle, 0::BIGINT AS slot, (SELECT min(job) FROM jobs j WHERE j.first_cycle = f.first_cycle AND j.release <= 0) AS job,
         [(SELECT min(job) FROM jobs j WHERE j.first_cycle = f.first_cycle AND j.release <= 0)] AS done FROM f
  UNION ALL
  SELECT first_cycle, slot, job, list_append(done, job) FROM (
    SELECT e.first_cycle, e.slot + 1 AS slot, e.done,
           min(j.job) AS job
    FROM edf e JOIN jobs j ON j.first_cycle = e.first_cycle AND j.release <= e.slot + 1 AND NOT list_contains(e.done, j.job)
    GROUP BY 1, 2, 3)),
plan AS (SELECT j.first_cycle, j.last_cycle, j.source, j.q, j.i, e.slot FROM edf e JOIN jobs j USING (first_cycle, job)),
d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY
        md5(concat(coalesce(doc_id::VARCHAR, ''), chr(10), coalesce(text, '')))) - 1 AS nr FROM documents),
b AS (SELECT *, nr // {BLOCK_DOCS} AS block FROM d)
SELECT b.doc_id, b.source, b.nr, b.block, b.block // p.q AS cycle, p.slot
FROM b JOIN plan p ON b.source IS NOT DISTINCT FROM p.source AND b.block % p.q = p.i
  AND b.block // p.q >= p.first_cycle AND b.block // p.q < p.last_cycle
"""
