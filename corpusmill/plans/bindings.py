"""Stand-in inputs built from the test tables.

These only put rows of the test tables into the shapes the operators take; they
do none of the operators' work.

* claims / pairs: ``documents`` - claim (summary) = text before the first
  newline, argument sentences = the following lines; ``pair_id = doc_id``.
* debates: ``conversations`` - a conversation is a debate, a ``user`` turn a
  claim, the next turn its argument.
* pages: ``pages`` (url, html) as stored UTF-8 text.
* vector dictionary: the ``embeddings`` rows, ``vec_id`` = file position, each
  bound to the word of frequency rank ``vec_id + 1`` among the pair texts.
* run log: ``events`` - run = user_id, step = row number by (ts, event_id),
  loss = value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import ws_tokens
from corpusmill.operators import text as T
from corpusmill.operators import vocab as V
from corpusmill.session import cut_lineage
from corpusmill.sources.tables import read_table

NL = "\n"


def document_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(pair_id, claim, sentences)`` from ``documents``."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    has_nl = F.instr("text", NL) > 0
    rest = F.substr(F.col("text"), F.instr("text", NL) + 1)
    return d.select(
        F.col("doc_id").cast("long").alias("pair_id"),
        F.substring_index("text", NL, 1).alias("claim"),
        F.when(has_nl, F.split(rest, NL, -1)).otherwise(F.array().cast("array<string>"))
        .alias("sentences"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(pair_id, text, summary)`` - P1 over the document claims, lines kept apart."""
    return T.make_pairs(document_claims(spark, sf_dir), sep=" ")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2 word stream ``(doc, pos, word)`` of the document claims."""
    return T.corpus_tokens(document_claims(spark, sf_dir))


def corpus_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2 word stream as ``(doc, toks)`` arrays."""
    return T.corpus_arrays(document_claims(spark, sf_dir))


def word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts of the pair texts (``cnt0``) and summaries (``cnt1``), materialised: one scan of
    the documents from which dictionary, flags, vocabulary and statistics of a query follow."""
    return cut_lineage(V.word_stats(*T.pair_streams(pairs(spark, sf_dir))))


def dictionary(spark: SparkSession, sf_dir: str, words: DataFrame | None = None) -> DataFrame:
    """Vector dictionary ``(pos, word, vec)``, built once and used several times.

    The word of row ``vec_id`` is the pair-text word of frequency rank ``vec_id + 1`` (W1 order), a
    distributed global rank.
    """
    words = word_table(spark, sf_dir) if words is None else words
    emb = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    ranked = V.frequency_ranks(words.filter("cnt0 > 0"), "cnt0")
    d = (emb.join(ranked, emb["vec_id"] + 1 == ranked["id"])
         .select(F.col("vec_id").cast("long").alias("pos"), "word", F.col("embedding").alias("vec")))
    return cut_lineage(d)


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(run, step, loss)``; step = 0-based row number by (ts, event_id) within the run
    (a distributed per-run row number, so one busy run is not one task)."""
    from corpusmill.operators.ranking import global_row_number
    e = read_table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("run"), "ts",
                                                   "event_id", F.col("value").cast("double").alias("loss"))
    return global_row_number(e, [F.col("ts"), F.col("event_id")], "step", partition_by=["run"]).select(
        "run", "step", "loss")


# --- fixed values: stand-in robots files ------------------------------------
ROBOTS_AGENT = "corpusmill"
ROBOTS_TEXTS = [
    None,  # site without a robots.txt
    "User-agent: corpusmill\nDisallow: /A\nAllow: /\n\nUser-agent: *\nDisallow: /\n",
    "User-agent: *\nAllow: /The\nDisallow: /T  # no T pages\nCrawl-delay: 5\n",
    "User-agent: Other\nUser-agent: CORPUSMILL\n\nUser-agent: *\nDisallow: /e\nAllow:\n",
]
# ---------------------------------------------------------------------------


def robots_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(site, text)``: one of the stand-in robots files per site of ``pages``,
    chosen by the length of the site key; sites given ``None`` have no file."""
    from corpusmill.operators.links import site_key
    sites = read_table(spark, sf_dir, "pages").select(site_key(F.col("url")).alias("site")).distinct()
    k = F.length("site") % len(ROBOTS_TEXTS)
    text = F.coalesce(*[F.when(k == i, F.lit(t)) for i, t in enumerate(ROBOTS_TEXTS) if t is not None])
    return sites.select("site", text.alias("text")).filter(F.col("text").isNotNull())


def link_graph(spark: SparkSession, sf_dir: str, follow=None) -> DataFrame:
    """Walkable stand-in graph ``(src, pos, dest)``: page -> link path and link path -> page.

    Page hrefs never name other pages, so a link path (e.g. ``/The``) is a node
    of its own, linked back to every page that carries it (position = page_id).
    """
    from corpusmill.operators.links import link_table, url_path
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    links = link_table(pages.select("page_id", "url", "html"), keep=("page_id",))
    path = url_path(F.col("dest"))
    # Each link gives both directions, so the pages are read once.
    both = F.array(F.struct("src", F.col("pos").cast("long").alias("pos"), path.alias("dest")),
                   F.struct(path.alias("src"), F.col("page_id").cast("long").alias("pos"), F.col("src").alias("dest")))
    g = links.select(F.explode(both).alias("e")).select("e.*")
    if follow is not None:
        g = g.filter(follow(F.col("dest"), F.lit(None).cast("string")))
    return g


HALO = 3  # turns that a claim looks ahead
TURNS = 1024  # turns of a conversation in one window


def conversation_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debates ``(debate_key, name)``: a conversation is a debate named by the first line of its first turn."""
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return c.groupBy(F.col("conv_id").cast("long").alias("debate_key")).agg(F.substring_index(F.min_by("text", "turn"), NL, 1).alias("name"))


def conversation_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims ``(debate_key, is_opposing, pos, claim, argument, counter)`` from ``conversations``."""
    return turn_claims(read_table(spark, sf_dir, "conversations"))


def turn_claims(conversations: DataFrame, size: int = TURNS) -> DataFrame:
    """Claims of ``(conv_id, turn, role, text)`` rows.

    Each ``user`` turn is a claim: its argument is the next turn when that turn is not a user turn, its counter is the
    turn three ahead under the same condition (the reply to the following claim).  Claims alternate for / against in
    turn order.  Turns are numbered over all tasks and looked at in ranges of ``size``, each with a halo of the three turns
    behind it, so a conversation of any length spreads over many tasks.
    """
    from corpusmill.operators.ranking import global_row_number
    c = conversations.select("conv_id", "turn", "role", "text")
    turns = global_row_number(c, [F.col("turn"), F.col("role"), F.col("text")], "nr", partition_by=["conv_id"])
    own = F.floor(F.col("nr") / size)
    parts = F.when((F.col("nr") % size < HALO) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    turns = turns.select("conv_id", "nr", "role", "text", F.explode(parts).alias("part"))
    w = Window.partitionBy("conv_id", "part").orderBy("nr")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def reply(k):
        return F.when(F.lead("role", k).over(w) != "user", F.lead("text", k).over(w))

    is_user = F.col("role") == "user"
    seen = turns.select("conv_id", "nr", "part", is_user.alias("is_user"), F.col("text").alias("claim"), reply(1).alias("argument"),
                        reply(HALO).alias("counter"), F.sum(is_user.cast("long")).over(so_far).alias("k"))
    users = seen.where(F.col("is_user") & (F.col("part") == own))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    earlier = users.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n")).select(
        "conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    k = F.col("k") + F.col("earlier") - 1
    # Merged: the rows lie by (conv_id, part) already, while a broadcast of them would leave a conversation to one task.
    return users.join(earlier.hint("merge"), ["conv_id", "part"]).select(
        F.col("conv_id").cast("long").alias("debate_key"), (k % 2 == 1).alias("is_opposing"), F.floor(k / 2).cast("long").alias("pos"),
        "claim", "argument", "counter")


STEPS_PER_EPOCH = 20  # stand-in epoch length of the run log


def training_log(spark: SparkSession, sf_dir: str, steps_per_epoch: int = STEPS_PER_EPOCH) -> DataFrame:
    """``(run, step, epoch, batch, loss)``: the run log cut into epochs of ``steps_per_epoch``."""
    r = run_log(spark, sf_dir)
    return r.select("run", "step", (F.floor(F.col("step") / steps_per_epoch) + 1).cast("long").alias("epoch"),
                    (F.col("step") % steps_per_epoch).cast("long").alias("batch"), "loss")


def corpus_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(pair_id, text)``: the argument sentences of each document claim joined by spaces."""
    c = document_claims(spark, sf_dir)
    return c.select("pair_id", F.array_join("sentences", " ").alias("text"))
