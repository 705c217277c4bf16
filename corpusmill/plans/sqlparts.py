"""DuckDB SQL fragments shared by the oracle queries (same stand-ins as ``bindings``)."""

from __future__ import annotations


def ws(x: str) -> str:
    """F2 in DuckDB: split on whitespace runs, drop empty tokens."""
    return rf"list_filter(regexp_split_to_array({x}, '[\s\x0b\x1c-\x1f]+'), lambda t: t <> '')"


def explode(table: str, id_expr: str, list_expr: str, extra: str = "") -> str:
    """Rows ``(doc, pos, word)`` of a list column, pos 0-based."""
    ex = f", {extra}" if extra else ""
    return (f"SELECT t.doc AS doc, u.pos::BIGINT AS pos, t.l[u.pos + 1] AS word{ex} "
            f"FROM (SELECT {id_expr} AS doc, {list_expr} AS l{ex} FROM {table}) t, "
            f"unnest(range(len(t.l))) AS u(pos)")


CLAIMS = """claims AS (
  SELECT doc_id::BIGINT AS pair_id,
         split_part(text, chr(10), 1) AS claim,
         CASE WHEN strpos(text, chr(10)) > 0
              THEN string_split(substr(text, strpos(text, chr(10)) + 1), chr(10))
              ELSE []::VARCHAR[] END AS sentences
  FROM documents)"""

PAIRS = CLAIMS + """,
pairs AS (SELECT pair_id, ' ' || lower(array_to_string(sentences, ' ')) AS text, claim AS summary
          FROM claims)"""

PAIR_TOKENS = PAIRS + f""",
ptok AS (
  SELECT 0 AS src, doc, pos, word FROM ({explode('pairs', 'pair_id', ws('text'))})
  UNION ALL
  SELECT 1 AS src, doc, pos, word FROM ({explode('pairs', 'pair_id', ws('summary'))}))"""

CORPUS_TOKENS = CLAIMS + f""",
ctok AS ({explode('claims', 'pair_id', ws("array_to_string(sentences, ' ')"))})"""

# Vector dictionary: embeddings row vec_id <-> pair-text word of frequency rank vec_id + 1.
DICTIONARY = PAIR_TOKENS + """,
dict_rank AS (
  SELECT word, row_number() OVER (ORDER BY count(*) DESC, min({'src': src, 'doc': doc, 'pos': pos})) AS r
  FROM ptok WHERE src = 0 GROUP BY word),
dict AS (
  SELECT e.vec_id::BIGINT AS pos, d.word, e.embedding AS vec
  FROM embeddings e JOIN dict_rank d ON d.r = e.vec_id + 1)"""

# Word counts with dictionary flag, and the first-seen vocabulary.
FIRST_SEEN_VOCAB = DICTIONARY + """,
wc AS (
  SELECT word, count(*) AS cnt, min({'src': src, 'doc': doc, 'pos': pos}) AS first
  FROM ptok GROUP BY word),
wcf AS (
  SELECT wc.*, (wc.word IN (SELECT word FROM dict)) AS has_vec FROM wc),
vwords AS (
  SELECT (row_number() OVER (ORDER BY first) - 1)::BIGINT AS id, word, cnt::BIGINT AS cnt
  FROM wcf WHERE (cnt >= 2 OR has_vec) AND word NOT IN ('<UNK>', '<PAD>', '<EOS>', '<GO>')),
vocab AS (
  SELECT id, word, cnt FROM vwords
  UNION ALL
  SELECT (SELECT count(*) FROM vwords) + k::BIGINT AS id, w AS word, NULL::BIGINT AS cnt
  FROM (VALUES (0, '<UNK>'), (1, '<PAD>'), (2, '<EOS>'), (3, '<GO>')) s(k, w))"""


def encoded(side: str, vocab: str = "vocab", unk: str = "<UNK>") -> str:
    """Id list per pair of one side (``text`` or ``summary``), in token order."""
    return f"""SELECT p.pair_id,
       coalesce(list_transform(list_sort(list({{'pos': t.pos, 'id': coalesce(v.id, (SELECT id FROM {vocab} WHERE word = '{unk}'))::INTEGER}})
                 FILTER (WHERE t.pos IS NOT NULL)), lambda s: s.id), []::INTEGER[]) AS ids
FROM pairs p
LEFT JOIN ({explode('pairs', 'pair_id', ws(side))}) t ON t.doc = p.pair_id
LEFT JOIN {vocab} v ON v.word = t.word
GROUP BY p.pair_id"""

# Encoded examples of pipeline v3: text ids + <EOS>, summary ids; special ids.
SEQ = FIRST_SEEN_VOCAB + f""",
sp AS (SELECT (SELECT id FROM vocab WHERE word = '<UNK>')::INTEGER AS unk,
              (SELECT id FROM vocab WHERE word = '<PAD>')::INTEGER AS pad,
              (SELECT id FROM vocab WHERE word = '<EOS>')::INTEGER AS eos,
              (SELECT id FROM vocab WHERE word = '<GO>')::INTEGER AS go),
et AS ({encoded('text')}), es AS ({encoded('summary')}),
ex AS (SELECT et.pair_id, list_append(et.ids, sp.eos) AS t, es.ids AS s
       FROM et JOIN es ON et.pair_id = es.pair_id, sp),
kept AS (SELECT ex.* FROM ex, sp
         WHERE len(s) >= 2 AND len(s) <= 30 AND len(t) >= 2 AND len(t) < 400
           AND len(list_filter(s, lambda x: x = sp.unk)) <= 5
           AND len(list_filter(t, lambda x: x = sp.unk)) <= 30),
ranked AS (SELECT kept.*, (row_number() OVER (ORDER BY len(t), pair_id) - 1)::BIGINT AS rn FROM kept),
batched AS (SELECT pair_id, t, s, rn, (rn // 64)::BIGINT AS batch_id, (rn % 64)::INTEGER AS slot
            FROM ranked WHERE rn < (SELECT count(*) FROM ranked) // 64 * 64),
padded AS (SELECT b.*, len(t)::INTEGER AS text_len, len(s)::INTEGER AS summary_len,
                  (max(len(t)) OVER (PARTITION BY batch_id))::INTEGER AS text_padded_len,
                  (max(len(s)) OVER (PARTITION BY batch_id))::INTEGER AS summary_padded_len
           FROM batched b),
padded2 AS (SELECT padded.*, list_resize(t, text_padded_len, sp.pad) AS tp, list_resize(s, summary_padded_len, sp.pad) AS spd
            FROM padded, sp)"""


def freq_vocab(n_words: int) -> str:
    """W1 over the corpus stream: ``fv(id, word, cnt)`` with UNK = 0 and ``n_words`` words."""
    return CORPUS_TOKENS + f""",
fcnt AS (SELECT word, count(*) AS cnt, min({{'doc': doc, 'pos': pos}}) AS first FROM ctok GROUP BY word),
ftop AS (SELECT row_number() OVER (ORDER BY cnt DESC, first)::BIGINT AS id, word, cnt::BIGINT AS cnt
         FROM fcnt WHERE word <> 'UNK' QUALIFY id <= {n_words}),
fv AS (SELECT 0::BIGINT AS id, 'UNK' AS word,
              ((SELECT count(*) FROM ctok) - coalesce((SELECT sum(cnt) FROM ftop), 0))::BIGINT AS cnt
       UNION ALL SELECT id, word, cnt FROM ftop)"""


def exact_split_sql(table: str, id_col: str, seed: str, p1: float, p2: float, names=("train", "test", "eval")) -> str:
    """Rows ``(id, part)`` of T6 (seed is an SQL expression)."""
    return f"""(SELECT {id_col}, CASE WHEN r < a THEN '{names[0]}' WHEN r < a + b THEN '{names[1]}' ELSE '{names[2]}' END AS part
FROM (SELECT {id_col}, (row_number() OVER (ORDER BY md5({seed} || ':' || {id_col}::VARCHAR), {id_col}) - 1) AS r FROM {table}) x,
     (SELECT n - ceil(n * {p1}::DOUBLE) AS a,
             ceil(n * {p1}::DOUBLE) - ceil(ceil(n * {p1}::DOUBLE) * {p2}::DOUBLE) AS b
      FROM (SELECT count(*) AS n FROM {table})) s)"""

# --- pages ------------------------------------------------------------------
SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def _site_sql(u: str) -> str:
    auth = f"regexp_replace(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1), '^[^@]*@', '')"
    scheme = f"lower(regexp_extract({u}, {q(SCHEME_RE)}, 1))"
    port = f"regexp_extract({auth}, ':([0-9]+)$', 1)"
    return (f"({scheme} || '://' || regexp_extract({auth}, '^([^:]*)', 1) || ':' || "
            f"CASE WHEN {port} <> '' THEN {port} WHEN {scheme} = 'http' THEN '80' "
            f"WHEN {scheme} = 'https' THEN '443' WHEN {scheme} = 'ftp' THEN '21' ELSE '-1' END)")


def site_sql(u: str) -> str:
    return _site_sql(u)


def path_sql(u: str) -> str:
    return f"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1)"


def trim_sql(x: str) -> str:
    """Control characters and spaces cut from both ends."""
    return f"regexp_replace({x}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"


def references_sql(x: str) -> str:
    """Character references decoded piece by piece."""
    number = "CASE WHEN lower(p[3]) = 'x' THEN ('0x' || p[4:-2])::BIGINT ELSE p[3:-2]::BIGINT END"
    named = ("CASE p WHEN '&amp;' THEN '&' WHEN '&lt;' THEN '<' WHEN '&gt;' THEN '>' WHEN '&quot;' THEN chr(34) "
             "WHEN '&apos;' THEN chr(39) WHEN '&nbsp;' THEN chr(160) ELSE p END")
    char = f"CASE WHEN {number} BETWEEN 1 AND 1114111 AND NOT {number} BETWEEN 55296 AND 57343 THEN chr(({number})::INTEGER) ELSE chr(65533) END"
    piece = f"CASE WHEN regexp_full_match(p, '&#([0-9]{{1,7}}|[xX][0-9a-fA-F]{{1,6}});') THEN {char} ELSE {named} END"
    return f"array_to_string(list_transform(regexp_extract_all({x}, '&#?[0-9a-zA-Z]+;|[^&]+|&'), lambda p: {piece}), '')"


# Links in another wording than the operator's: the page as a list of tokens; a link's parts are the tokens up to the next
# start or end of a link, its attributes are listed and the first href is taken.
_REST = r"""(?:[\s/](?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|[="'])*?)?>"""
PAGE_TOKEN_RE = ("(?is)<!--.*?(?:-->|$)|" + "|".join(rf"<{x}{_REST}.*?(?:</{x}(?:[\s/][^>]*)?>|$)" for x in
                 ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")) + rf"|</?[a-z][^\s/>]*{_REST}|[^<]+|<")
ATTRIBUTES_RE = r"""[^\s/>=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+))?"""
HREF_VALUE = "CASE WHEN quoted[1] IN (chr(34), chr(39)) THEN quoted[2:-2] ELSE quoted END"

LINKS = f"""page_tokens AS (
  SELECT url AS src, u.i AS i, l[u.i] AS tok
  FROM (SELECT url, regexp_extract_all(html, {q(PAGE_TOKEN_RE)}) AS l FROM pages), unnest(range(1, len(l) + 1)) AS u(i)),
link_parts AS (
  SELECT src, i, tok, regexp_matches(tok, '(?i)^</?a[\\s/>]') AS edge,
         sum(CASE WHEN regexp_matches(tok, '(?i)^</?a[\\s/>]') THEN 1 ELSE 0 END) OVER (PARTITION BY src ORDER BY i) AS part FROM page_tokens),
link_whole AS (
  SELECT src, min(i) FILTER (WHERE edge) AS i, any_value(tok) FILTER (WHERE edge) AS start_tag,
         coalesce(string_agg(tok, '' ORDER BY i) FILTER (WHERE NOT edge), '') AS anchor
  FROM link_parts WHERE part > 0 GROUP BY src, part),
link_attributes AS (
  SELECT src, i, anchor, list_filter(regexp_extract_all(start_tag[3:], {q(ATTRIBUTES_RE)}), lambda x: regexp_matches(x, '(?i)^href(\\s*=|$)')) AS h
  FROM link_whole WHERE start_tag[2] <> '/'),
hrefs0 AS (
  SELECT src, (row_number() OVER (PARTITION BY src ORDER BY i) - 1)::INTEGER AS pos, regexp_extract(h[1], '(?s)=\\s*(.*)$', 1) AS quoted, anchor
  FROM link_attributes WHERE len(h) > 0),
hrefs AS (
  SELECT src, pos, {trim_sql(references_sql(HREF_VALUE))} AS h, anchor,
         regexp_extract(src, {q(SCHEME_RE)}, 1) AS scheme,
         regexp_extract(src, {q(SCHEME_RE)}, 1) || '://' || regexp_extract(src, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1) AS origin,
         {path_sql('src')} AS bpath, regexp_replace(src, '#.*$', '') AS bnofrag
  FROM hrefs0),
resolved AS (
  SELECT src, pos, anchor, regexp_replace(
    CASE WHEN regexp_matches(h, {q(SCHEME_RE)}) THEN h
         WHEN starts_with(h, '//') THEN scheme || ':' || h
         WHEN h = '' THEN bnofrag
         WHEN starts_with(h, '#') THEN bnofrag || h
         WHEN starts_with(h, '?') THEN origin || bpath || h
         WHEN starts_with(h, '/') THEN origin || h
         ELSE origin || CASE WHEN bpath = '' THEN '/' ELSE regexp_extract(bpath, '^(.*/)', 1) END || h END,
    '#[^#]*$', '') AS dest
  FROM hrefs),
links AS (
  SELECT src, pos, dest, anchor FROM resolved
  WHERE lower(regexp_extract(dest, {q(SCHEME_RE)}, 1)) IN ('http', 'https', 'ftp', 'file', 'jar', 'mailto'))"""

# --- records ----------------------------------------------------------------
# Sentences and tokens in RE2, which needs no possessive loops.
SENTENCE_RE = r"(?:https?:\S*|[^.!?])+(?:[.!?]+|$)|[.!?]+"
TOKEN_RE = r"https?:\S*|[\p{L}\p{N}_]+(?:['’][\p{L}\p{N}_]+)*|[^\s\p{L}\p{N}_\"]"


def split_argument_sql(x: str) -> str:
    toks = f"list_transform(regexp_extract_all(coalesce({x}, ''), {q(SENTENCE_RE)}), lambda s: regexp_extract_all(s, {q(TOKEN_RE)}))"
    return (f"list_transform(list_filter({toks}, lambda t: len(t) > 1), lambda t: array_to_string("
            f"list_transform(list_filter(t, lambda w: NOT starts_with(w, 'http:')), lambda w: replace(w, '\"', '')), ' '))")


DEBATES = """turns AS (
  SELECT conv_id, turn, role, text,
         CASE WHEN lead(role, 1) OVER w <> 'user' THEN lead(text, 1) OVER w END AS argument,
         CASE WHEN lead(role, 3) OVER w <> 'user' THEN lead(text, 3) OVER w END AS counter
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
users AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM turns WHERE role = 'user'),
dnames AS (SELECT conv_id, split_part(arg_min(text, turn), chr(10), 1) AS name FROM conversations GROUP BY conv_id),
dids AS (SELECT conv_id, (1000000 + row_number() OVER (ORDER BY conv_id) - 1)::BIGINT AS debate_id, name FROM dnames),
claims AS (
  SELECT d.debate_id, d.name, (row_number() OVER (PARTITION BY u.conv_id ORDER BY u.k % 2, u.turn) - 1)::BIGINT AS claim_no,
         (u.k % 2 = 1) AS is_opposing, u.text AS claim, u.argument, u.counter
  FROM users u JOIN dids d ON d.conv_id = u.conv_id)"""

SENTENCES = DEBATES + f""",
sents0 AS (
  SELECT debate_id, claim_no,
         list_concat(list_transform({split_argument_sql('argument')}, lambda s: {{'side': 'argument', 'sentence': s}}),
                     list_transform({split_argument_sql('counter')}, lambda s: {{'side': 'counter', 'sentence': s}})) AS l
  FROM claims),
sents AS (
  SELECT debate_id, claim_no, u.i::BIGINT AS sno, debate_id || '_' || claim_no || '_' || u.i AS sentence_id,
         l[u.i + 1].side AS side, l[u.i + 1].sentence AS sentence
  FROM sents0, unnest(range(len(l))) AS u(i))"""

# --- vectors ----------------------------------------------------------------


def norm_sql(v: str) -> str:
    return f"sqrt(list_reduce(list_transform({v}, lambda x: x::DOUBLE * x::DOUBLE), lambda a, b: a + b))"


def vprint_sql(v: str, places: int) -> str:
    return f"array_to_string(list_transform({v}, lambda y: round(y::DOUBLE * {10 ** places})::BIGINT), ' ')"


def corpus_encoded(n_words: int) -> str:
    return freq_vocab(n_words) + """,
cenc AS (
  SELECT c.pair_id AS doc,
         coalesce(list_transform(list_sort(list({'pos': t.pos, 'id': coalesce(f.id, 0)::INTEGER}) FILTER (WHERE t.pos IS NOT NULL)),
                                 lambda s: s.id), []::INTEGER[]) AS ids
  FROM claims c LEFT JOIN ctok t ON t.doc = c.pair_id LEFT JOIN fv f ON f.word = t.word
  GROUP BY c.pair_id)"""


def hash_units_sql(key: str, j: str, n: int) -> str:
    """Draw ``j`` (0-based, ``j < n``) of ``hash_units(key, m)`` for any ``m > j``
    (draw j uses the power A^(j+1) whatever the stream length)."""
    from corpusmill.operators.vectors import MINSTD_M, minstd_powers
    powers = "([" + ", ".join(str(p) for p in minstd_powers(n)) + "]::BIGINT[])"
    x0 = f"(((('0x' || substr(md5({key}), 1, 8))::UBIGINT)::BIGINT % {MINSTD_M - 1}) + 1)"
    return f"((({x0} * {powers}[{j} + 1]) % {MINSTD_M})::DOUBLE / {MINSTD_M}.0)"
