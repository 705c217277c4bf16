"""Operator 1, URL filters: empirical-Bayes host reputation.

Labelled page outcomes (good or bad) are counted per host and shrunk through beta-binomial priors:
host -> registered domain -> suffix -> all pages.  The strength of each level's prior comes from the
data (moments of the spread of the rates around their parents' means).  A page is blocked when the
upper credible bound of its host's share of good pages lies below ``min_good``, or its share of bad pages is credibly
over ``times`` that of all pages.  Fixed URL rules overrule the reputation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import table
from corpusmill.session import cut_lineage

NUMERIC = "^[0-9.]+$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Public suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au",
                      "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")


@dataclass(frozen=True)
class Rule:
    """``allow`` or ``block`` for a host with its subdomains and the paths that start with ``path``."""

    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the registered query.
RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
         Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))


def with_host_and_path(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` (A-Z lower-cased) and ``path``; both are empty for a null url or one without ``://``."""
    rest = F.when(F.instr(F.col(url), "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    df = df.withColumn("__rest", F.coalesce(rest, F.lit(""))).withColumn(
        "__host", F.regexp_extract("__rest", r"^[^/?#]*", 0))
    return (df.withColumn("path", F.regexp_extract(F.expr("substring(__rest, length(__host) + 1)"), r"^[^?#]*", 0))
            .withColumn("host", F.translate("__host", UPPER, LOWER)).drop("__rest", "__host"))


def registered_domain(host: Column) -> Column:
    """The name under the public suffix, without port; hosts of fewer labels and numeric addresses are their own domain."""
    bare = F.regexp_replace(host, r":[0-9]*$", "")
    return F.when(bare.rlike(NUMERIC), bare).when(F.substring_index(bare, ".", -2).isin(*TWO_LABEL_SUFFIXES),
                  F.substring_index(bare, ".", -3)).otherwise(F.substring_index(bare, ".", -2))


def suffix_of(domain: Column) -> Column:
    """What follows the first label of a registered domain; the domain itself when it is one label or a numeric address."""
    return F.when(domain.rlike(NUMERIC), domain).otherwise(F.regexp_replace(domain, r"^[^.]*\.", ""))


def first_rule(rules, host: Column, path: Column, value) -> Column:
    """``value(rule)`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(value(r))).otherwise(out)
    return out


def _strength(level: DataFrame) -> float:
    """Prior strength of a level with columns ``n, k, prior``: (1 - rho) / rho of the beta-binomial moments."""
    p, m = F.col("k") / F.col("n"), F.col("prior")
    s, e, d = level.where("n > 0").agg(F.sum(F.col("n") * (p - m) * (p - m)), F.sum(m * (1 - m)),
                                       F.sum(m * (1 - m) * (F.col("n") - 1))).first()
    rho = (s - e) / d if d else 0.5
    rho = min(max(rho, 0.001), 0.999)
    return (1 - rho) / rho


def host_reputation(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """Posterior of every host.

    ``outcomes``: rows ``(host, good)``, good 1 or 0, null where a page has no label.  Hosts without
    labelled pages get their domain's (or suffix's, or overall) prior.  Returns ``host, n, k, mean,
    upper, overall`` (credible bound of the share of good pages; that share among all labelled pages).  No labelled row at all: both means 0.5.
    """
    hosts = (outcomes.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0)).alias("k"))
             .withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", suffix_of(F.col("domain"))))
    hosts = cut_lineage(hosts)
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()

    def shrink(level: DataFrame) -> tuple[DataFrame, float]:
        m = _strength(level)
        return level.withColumn("mean", (F.col("k") + m * F.col("prior")) / (F.col("n") + m)), m

    overall = F.lit((total[1] + 1) / (total[0] + 2))
    suffixes, _ = shrink(suffixes.withColumn("prior", overall))
    domains, _ = shrink(domains.join(suffixes.select("suffix", F.col("mean").alias("prior")), "suffix"))
    hosts, m = shrink(hosts.join(domains.select("domain", F.col("mean").alias("prior")), "domain"))
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + m + 1))
    return hosts.select("host", "n", "k", "mean", (F.col("mean") + z * sd).alias("upper"), overall.alias("overall"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES, min_good: float = 0.5, times: float = 2.0, z: float = 1.645,
               salts: int = 16) -> DataFrame:
    """Verdict for every page.

    ``pages``: ``page_id, url`` (other columns are ignored); ``labels``: ``page_id, good``.  A page with
    several labels counts with the worst; null ids and null labels count as unlabelled.  A page id that
    occurs in several rows gives as many rows.  Null or malformed urls share the empty host.
    Returns ``page_id, host, path, rule, verdict, n_labelled, mean_good, upper_good``; an empty table
    gives an empty result.

    The table of hosts is joined back on ``(host, salt)``, each host once per salt, so the pages of a
    host that holds a third of all rows go to ``salts`` tasks.
    """
    p = with_host_and_path(pages.select("page_id", "url")).select("page_id", "host", "path")
    marks = labels.where("page_id is not null and good is not null").groupBy("page_id").agg(F.min("good").alias("good"))
    rep = host_reputation(p.join(marks, "page_id", "left").select("host", "good"), z)
    rep = rep.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    host, path = F.col("host"), F.col("path")
    least = F.greatest(F.lit(min_good), 1 - times * (1 - F.col("overall")))
    by_method = F.when(F.col("upper") < least, "block").otherwise("allow")
    return (p.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(salts)).cast("int"))
            .join(rep, ["host", "salt"])
            .select("page_id", "host", "path", first_rule(rules, host, path, lambda r: r.text).alias("rule"),
                    F.coalesce(first_rule(rules, host, path, lambda r: r.action), by_method).alias("verdict"),
                    F.col("n").alias("n_labelled"), F.round("mean", 4).alias("mean_good"),
                    F.round("upper", 4).alias("upper_good")))


def op1_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict for every row of ``pages``; ``labels.quality`` of the same id serves as page outcome."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return judge_urls(table(spark, sf_dir, "pages"), labels)


_TWO = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)


def _sql_level(name: str, source: str, keys: str, prior: str, join: str) -> str:
    return f"""
{name}_p AS (SELECT {keys}, n, k, {prior} AS prior FROM {source} {join}),
{name}_r AS (SELECT coalesce((sum(n * (k / n - prior) * (k / n - prior)) - sum(prior * (1 - prior)))
                    / nullif(sum(prior * (1 - prior) * (n - 1)), 0), 0.5) AS raw FROM {name}_p WHERE n > 0),
{name}_m AS (SELECT (1 - rho) / rho AS m FROM (SELECT least(greatest(raw, 0.001), 0.999) AS rho FROM {name}_r)),
{name}_e AS (SELECT *, (k + m * prior) / (n + m) AS mean FROM {name}_p, {name}_m)"""


SQL = f"""
WITH a AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN ''
                               ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
p AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
marks AS (SELECT doc_id AS page_id, min(quality) AS good FROM labels
          WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
h0 AS (SELECT host, count(good)::DOUBLE AS n, coalesce(sum(good), 0)::DOUBLE AS k
       FROM p LEFT JOIN marks USING (page_id) GROUP BY 1),
h1 AS (SELECT *, regexp_replace(host, ':[0-9]*$', '') AS bare, string_split(bare, '.') AS parts FROM h0),
h2 AS (SELECT host, n, k, CASE WHEN regexp_matches(bare, '{NUMERIC}') THEN bare WHEN array_to_string(parts[-2:], '.') IN ({_TWO})
                          THEN array_to_string(parts[-3:], '.') ELSE array_to_string(parts[-2:], '.') END AS domain FROM h1),
hosts AS (SELECT *, CASE WHEN strpos(domain, '.') > 0 AND NOT regexp_matches(domain, '{NUMERIC}') THEN substr(domain, strpos(domain, '.') + 1) ELSE domain END AS suffix FROM h2),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY 1, 2),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY 1),
total AS (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) AS mean FROM suffixes),
{_sql_level("s", "suffixes", "suffix", "mean", ", total")},
{_sql_level("d", "domains", "domain, domains.suffix", "pm", "JOIN (SELECT suffix AS ps, mean AS pm FROM s_e) ON suffix = ps")},
{_sql_level("h", "hosts", "host", "pm", "JOIN (SELECT domain AS pd, mean AS pm FROM d_e) ON domain = pd")},
ruled AS (SELECT p.*, n, h_e.mean, greatest(0.5, 1 - 2 * (1 - total.mean)) AS least, h_e.mean + 1.645 * sqrt(h_e.mean * (1 - h_e.mean) / (n + m + 1)) AS upper,
    CASE WHEN regexp_matches(host, '(^|[.])www[.]example[.]com$') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN regexp_matches(host, '(^|[.])example[.]com$') AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN regexp_matches(host, '(^|[.])net$') AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN regexp_matches(host, '(^|[.])net$') AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN regexp_matches(host, '(^|[.])com$') AND starts_with(path, '/') THEN 'com/' END AS rule
    FROM p JOIN h_e USING (host), total)
SELECT page_id, host, path, rule,
       CASE rule WHEN 'com/' THEN 'allow' WHEN 'www.example.com/en/' THEN 'allow' WHEN 'example.com/en/' THEN 'block'
                 WHEN 'net/es/' THEN 'block' WHEN 'net/fr/' THEN 'block'
                 ELSE CASE WHEN upper < least THEN 'block' ELSE 'allow' END END AS verdict,
       n::BIGINT AS n_labelled, round(mean, 4) AS mean_good, round(upper, 4) AS upper_good
FROM ruled
"""
