"""Debate records: X3-X6, X10-X12, W4, P1 (JSON form), P2, P5-P8, F4-F6, S1, S8."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from corpusmill.functions.text import cut_references, sentences
from corpusmill.operators import html as H
from corpusmill.operators import records as D
from corpusmill.operators import text as T
from corpusmill.plans import bindings as B
from corpusmill.plans import sqlparts as S
from corpusmill.plans.registry import query
from corpusmill.session import cut_lineage, ensure_checkpoint_dir
from corpusmill.sources import claims as C
from corpusmill.sources.tables import read_table

# Stand-in rules for the test pages (no debate markup there): the article's paragraphs with a bold lead.
PAGE_RULES = H.Rules("article", "h1", (H.Block("for", None, "p", "b", "&"),))


def debates(spark, sf):
    return cut_lineage(D.number_debates(B.conversation_names(spark, sf)))


def claims(spark, sf, numbered=None):
    return D.flatten_claims(B.conversation_claims(spark, sf), debates(spark, sf) if numbered is None else numbered)


@query("debate_claims", f"""WITH {S.DEBATES}
SELECT debate_id, claim_no, debate_id || '_' || claim_no AS claim_id, is_opposing, claim,
       argument IS NOT NULL AS has_argument, counter IS NOT NULL AS has_counter FROM claims""")
def debate_claims(spark, sf):
    """X10 + W4: claim rows, supporting first; debate id 1000000 + n, claim id ``debate_n``."""
    c = claims(spark, sf)
    return c.select("debate_id", "claim_no", F.format_string("%d_%d", "debate_id", "claim_no").alias("claim_id"),
                    "is_opposing", "claim", F.col("argument").isNotNull().alias("has_argument"),
                    F.col("counter").isNotNull().alias("has_counter"))


@query("claim_sentences", f"""WITH {S.SENTENCES}
SELECT sentence_id, debate_id, claim_no, sno, side, sentence FROM sents""")
def claim_sentences(spark, sf):
    """X11 + X5 + P7 + P8 + F4 + F6: sentence rows, one running number over argument and counter."""
    return D.claim_sentences(claims(spark, sf))


@query("debate_outline", f"""WITH {S.DEBATES},
cl AS (
  SELECT debate_id, claim_no, is_opposing, claim,
         {S.split_argument_sql("split_part(argument, ' 1: ', 1)")} AS a,
         {S.split_argument_sql("split_part(counter, ' 1: ', 1)")} AS c FROM claims),
lines AS (
  SELECT debate_id, 0 AS t, 0 AS claim_no, 0 AS o, 0 AS i, 'debate' AS kind, name AS text FROM dids
  UNION ALL
  SELECT debate_id, 1, claim_no, 0, 0, CASE WHEN is_opposing THEN 'against' ELSE 'for' END,
         CASE WHEN is_opposing THEN '  against: ' ELSE '  for: ' END || claim FROM cl
  UNION ALL
  SELECT debate_id, 1, claim_no, 1, u.i, 'argument', '    argument: ' || a[u.i + 1] FROM cl, unnest(range(len(a))) AS u(i)
  UNION ALL
  SELECT debate_id, 1, claim_no, 2, u.i, 'counter', '    counter: ' || c[u.i + 1] FROM cl, unnest(range(len(c))) AS u(i))
SELECT debate_id, (row_number() OVER (PARTITION BY debate_id ORDER BY t, claim_no, o, i) - 1)::BIGINT AS line_no, kind, text
FROM lines""")
def debate_outline(spark, sf):
    """X12 + X6: the printed outline of every debate, references cut at ' 1: '."""
    d = debates(spark, sf)
    return D.outline(claims(spark, sf, d), d)


@query("reference_cut", f"""WITH {S.DEBATES}
SELECT debate_id, claim_no, split_part(argument, ' 1: ', 1) AS body FROM claims WHERE argument IS NOT NULL""")
def reference_cut(spark, sf):
    """Argument text before the first ' 1: '."""
    c = claims(spark, sf).filter(F.col("argument").isNotNull())
    return c.select("debate_id", "claim_no", cut_references(F.col("argument")).alias("body"))


RECORDS_SQL = f"""WITH {S.SENTENCES},
agg AS (SELECT debate_id, claim_no,
               string_agg(sentence_id || '=' || sentence, '|' ORDER BY sno) FILTER (WHERE side = 'argument') AS args,
               string_agg(sentence_id || '=' || sentence, '|' ORDER BY sno) FILTER (WHERE side = 'counter') AS ctrs
        FROM sents GROUP BY debate_id, claim_no)
SELECT c.debate_id::VARCHAR AS _debate_id, replace(c.claim, '"', '') AS _claim,
       CASE WHEN c.is_opposing THEN 'true' ELSE 'false' END AS _is_opposing,
       coalesce(a.args, '') AS args, coalesce(a.ctrs, '') AS ctrs, replace(c.name, '"', '') AS _debate_name,
       c.debate_id || '_' || c.claim_no AS _claim_id
FROM claims c LEFT JOIN agg a ON a.debate_id = c.debate_id AND a.claim_no = c.claim_no"""


def _record_summary(r):
    def listed(col):
        e = F.array_sort(F.transform(F.map_entries(col), lambda x: F.struct(
            F.substring_index(x["key"], "_", -1).cast("long").alias("n"), F.concat(x["key"], F.lit("="), x["value"]).alias("t"))))
        return F.array_join(F.transform(e, lambda x: x["t"]), "|")
    return r.select("_debate_id", "_claim", "_is_opposing", listed("_argument_sentences").alias("args"),
                    listed("_counter_sentences").alias("ctrs"), "_debate_name", "_claim_id")


@query("claim_records", RECORDS_SQL)
def claim_records(spark, sf):
    """S8 shape: flat claim objects with sentence maps (printed as ``key=sentence`` in key order)."""
    return _record_summary(D.claim_records(claims(spark, sf)))


@query("claims_json_roundtrip", RECORDS_SQL)
def claims_json_roundtrip(spark, sf):
    """S8 then S1: write the claim records as JSON into the checkpoint folder and read them back."""
    path = os.path.join(ensure_checkpoint_dir(spark), f"claims-{uuid.uuid4().hex}")
    C.write_claims_json(D.claim_records(claims(spark, sf)), path)
    return _record_summary(C.read_claims_json(spark, path, multi_line=False))


@query("claim_pairs", f"""WITH {S.SENTENCES},
o AS (SELECT debate_id, claim_no, string_agg(sentence, '' ORDER BY sno) FILTER (WHERE side = 'argument') AS t
      FROM sents GROUP BY debate_id, claim_no)
SELECT c.debate_id || '_' || c.claim_no AS claim_id, ' ' || lower(coalesce(o.t, '')) AS text, replace(c.claim, '"', '') AS summary
FROM claims c LEFT JOIN o ON o.debate_id = c.debate_id AND o.claim_no = c.claim_no""")
def claim_pairs(spark, sf):
    """P1 on claim records: ' ' + lower-cased argument sentences joined with no separator; summary = claim."""
    r = D.claim_records(claims(spark, sf))
    s = r.select("_claim_id", F.col("_claim").alias("claim"),
                 T.ordered_sentences(F.col("_argument_sentences")).alias("sentences"))
    return T.make_pairs(s, id_col="_claim_id", sep="").withColumnRenamed("pair_id", "claim_id")


@query("corpus_sentences", f"""WITH {S.SENTENCES}
SELECT debate_id || '_' || claim_no AS claim_id, sno, sentence FROM sents WHERE side = 'argument'""")
def corpus_sentences(spark, sf):
    """Every argument sentence of every claim, case kept, with its position."""
    r = D.claim_records(claims(spark, sf))
    e = r.select("_claim_id", F.explode("_argument_sentences").alias("k", "sentence"))
    return e.select(F.col("_claim_id").alias("claim_id"),
                    F.substring_index("k", "_", -1).cast("long").alias("sno"), "sentence")


@query("document_sentences", f"""WITH s AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {S.q(S.SENTENCE_RE)}) AS l FROM documents)
SELECT doc_id, u.i::INTEGER AS sno, l[u.i + 1] AS sentence FROM s, unnest(range(len(l))) AS u(i)""")
def document_sentences(spark, sf):
    """X5, first half, over whole documents: every sentence with its position."""
    d = read_table(spark, sf, "documents").select("doc_id", F.posexplode(sentences(F.coalesce("text", F.lit("")))).alias("sno", "sentence"))
    return d.select("doc_id", "sno", "sentence")


def _text_sql(x):
    spaced = f"regexp_replace({x}, '(?i)<(br|/?p)[^>]*>', ' ', 'g')"
    return f"trim(regexp_replace({S.references_sql(f"regexp_replace({spaced}, '<[^>]*>', '', 'g')")}, '\\s+', ' ', 'g'))"


@query("page_records", f"""WITH a AS (
  SELECT url, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script\\b.*?</script\\s*>', '', 'g'),
                             '(?is)<style\\b.*?</style\\s*>', '', 'g') AS h FROM pages),
b AS (SELECT url, regexp_extract(h, '(?is)<article[^>]*>(.*)', 1) AS box FROM a WHERE regexp_matches(h, '(?is)<article[^>]*>')),
c AS (SELECT url, CASE WHEN regexp_matches(box, '(?is)<h1[^>]*>.*?</h1>') THEN {_text_sql("regexp_extract(box, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} END AS title,
             string_split_regex(regexp_extract(regexp_extract(box, '(?is)</h1>(.*)', 1), '(?is)^(.*?)(?:</article>|$)', 1), '(?is)<p[^>]*>')[2:] AS items FROM b),
d AS (SELECT url, title, list_filter(items, lambda x: regexp_matches(x, '(?is)<b>')) AS items FROM c)
SELECT url, title, 'for' AS side, u.i::INTEGER AS pos, {_text_sql("regexp_extract(items[u.i + 1], '(?is)<b>(.*?)(?:</b>|<br>|$)', 1)")} AS claim,
       {_text_sql("items[u.i + 1]")} AS argument, NULL::VARCHAR AS counter
FROM d, unnest(range(len(items))) AS u(i)""")
def page_records(spark, sf):
    """X3 + X4 + P5 + P6: records of every page by rules (article, h1, paragraphs with a bold claim)."""
    return H.page_records(read_table(spark, sf, "pages"), PAGE_RULES)


@query("movies_json_roundtrip", f"""WITH {S.CLAIMS}
SELECT claim AS _movie_name, pair_id::VARCHAR AS _movie_id, array_to_string(list_transform(range(len(sentences)), lambda i: 'c' || i || '=' || sentences[i + 1]), '|') AS critics,
       coalesce(sentences[-1], '') AS _critic_consensus FROM claims""")
def movies_json_roundtrip(spark, sf):
    """Movie records (critics as a map, consensus) written as JSON lines and read back."""
    c = B.document_claims(spark, sf)
    n = F.size("sentences")
    critics = F.map_from_entries(F.transform("sentences", lambda s, i: F.struct(F.concat(F.lit("c"), i.cast("string")).alias("key"), s.alias("value"))))
    m = c.select(F.col("claim").alias("_movie_name"), F.col("pair_id").cast("string").alias("_movie_id"), critics.alias("_critics"),
                 F.when(n > 0, F.element_at("sentences", -1)).otherwise("").alias("_critic_consensus"))
    path = os.path.join(ensure_checkpoint_dir(spark), f"movies-{uuid.uuid4().hex}")
    m.write.json(path)
    r = C.read_movies_json(spark, path, multi_line=False)
    e = F.array_sort(F.transform(F.map_entries("_critics"), lambda x: F.struct(F.substr(x["key"], F.lit(2)).cast("int").alias("n"), F.concat(x["key"], F.lit("="), x["value"]).alias("t"))))
    return r.select("_movie_name", "_movie_id", F.array_join(F.transform(e, lambda x: x["t"]), "|").alias("critics"), "_critic_consensus")
