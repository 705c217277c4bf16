"""robots.txt rules (X9, S10) and the prefix-rule join.

Parsing is a window job per site: lines are numbered, a group starts at a
``User-agent:`` line that does not follow another one, and the group is chosen
per site by aggregates.  One site's robots file is bounded (a few hundred KB),
so per-site windows hold bounded groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import iequals, robots_line, trim_controls
from corpusmill.operators.joins import spread_join
from corpusmill.operators.links import site_key, url_path

# --- fixed values -----------------------------------------------------------
UA, ALLOW, DISALLOW = "User-agent:", "Allow:", "Disallow:"
LINE_BREAK = r"\R"
# ---------------------------------------------------------------------------


def write_robots_files(robots: DataFrame, path: str) -> None:
    """Fetched robots files ``(site, text)``, one file per site in a folder ``site=...`` of its own."""
    robots.select("site", "text").repartition("site").write.partitionBy("site").text(path)


def read_robots_files(spark: SparkSession, path: str) -> DataFrame:
    """``(site, text)`` of fetched robots files, each read whole; the folder's name gives the site."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("site").cast("string").alias("site"), F.col("value").alias("text"))


def robots_lines(robots: DataFrame, site_col: str = "site", text_col: str = "text") -> DataFrame:
    """Non-empty, comment-free lines ``(site, ln, line)`` of each robots file."""
    raw = robots.select(F.col(site_col).alias("site"),
                        F.posexplode(F.split(F.col(text_col), LINE_BREAK, -1)).alias("ln", "raw"))
    return raw.select("site", "ln", robots_line(F.col("raw")).alias("line")).filter(F.col("line") != "")


def parse_robots(robots: DataFrame, agent: str, site_col: str = "site",
                 text_col: str = "text") -> DataFrame:
    """``(site, rule_no, allow, prefix)``; ``prefix = ''`` matches every path.

    The first group naming ``agent`` (any letter case) is used when it has
    rules, else the first group naming ``*``.  ``Disallow:`` with no path
    allows everything and ``Allow:`` with no path refuses everything.
    """
    lines = robots_lines(robots, site_col, text_col)
    w = Window.partitionBy("site").orderBy("ln")
    is_ua = F.col("line").startswith(UA)
    lines = (lines.withColumn("is_ua", is_ua)
             .withColumn("start", F.col("is_ua") & ~F.coalesce(F.lag("is_ua").over(w), F.lit(False)))
             .withColumn("grp", F.sum(F.col("start").cast("int")).over(
                 w.rowsBetween(Window.unboundedPreceding, 0))))
    def after(word: str):
        return trim_controls(F.substr(F.col("line"), F.lit(len(word) + 1)))

    name = after(UA)
    is_allow, is_dis = F.col("line").startswith(ALLOW), F.col("line").startswith(DISALLOW)
    path = F.when(is_allow, after(ALLOW)).otherwise(after(DISALLOW))
    is_rule = ~F.col("is_ua") & (is_allow | is_dis)
    rules = (lines.filter(is_rule)
             .select("site", "grp", "ln",
                     F.when(is_allow, path != "").otherwise(path == "").alias("allow"),
                     path.alias("prefix")))
    # One aggregate per (site, group): which agents it names and how many rules it has.
    g = lines.groupBy("site", "grp").agg(
        F.max(F.col("is_ua") & iequals(name, F.lit(agent))).alias("names_agent"),
        F.max(F.col("is_ua") & (name == "*")).alias("names_star"),
        F.sum(is_rule.cast("int")).alias("n_rules"))
    agent_grp = F.when(F.col("names_agent"), F.col("grp"))
    pick = g.groupBy("site").agg(
        F.min(agent_grp).alias("a_grp"), F.min_by(F.col("n_rules"), agent_grp).alias("a_rules"),
        F.min(F.when(F.col("names_star"), F.col("grp"))).alias("star"))
    pick = pick.select("site", F.when(F.col("a_rules") > 0, F.col("a_grp"))
                       .otherwise(F.col("star")).alias("grp")).filter(F.col("grp").isNotNull())
    chosen = rules.join(pick, ["site", "grp"], "left_semi")
    rw = Window.partitionBy("site").orderBy("ln")
    return chosen.select("site", (F.row_number().over(rw) - 1).cast("int").alias("rule_no"),
                         "allow", "prefix")


def allowed(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """Add ``allowed`` - the first rule whose prefix starts the URL path decides;
    no match or no robots file allows.  The query string is not looked at.

    A path is cut to the lengths that its site's rules have and these prefixes are looked up by equality, so a url
    costs as many lookups as there are lengths, however many rules there are; the least rule number
    of its hits decides.  Sites with many urls are spread over tasks.
    """
    first = rules.groupBy("site", "prefix").agg(F.min(F.struct("rule_no", "allow")).alias("__rule"))
    lengths = first.groupBy("site").agg(F.collect_set(F.length("prefix")).alias("__lengths"))  # of one robots file
    u = urls.withColumn("__site", site_key(F.col(url_col))).withColumn("__path", url_path(F.col(url_col)))
    paths = u.select(F.col("__site").alias("site"), F.col("__path").alias("path"))
    cut = spread_join(paths, lengths, ["site"], F.col("path"))
    cut = cut.select("site", "path", F.explode(F.filter("__lengths", lambda n: n <= F.length("path"))).alias("n"))
    cut = cut.select("site", "path", F.substr("path", F.lit(1), F.col("n")).alias("prefix"))
    hits = spread_join(cut, first, ["site", "prefix"], F.col("path")).groupBy("site", "path").agg(F.min("__rule").alias("__rule"))
    hits = hits.select(F.col("site").alias("__site"), F.col("path").alias("__path"), F.col("__rule.allow").alias("allowed"))
    return (u.join(hits, ["__site", "__path"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))
            .select(*urls.columns, "allowed"))
