"""Debate extraction and claim records: X3-X6, X10-X12, W4, P1, P2, S1, S8, S12 fixtures."""

import os

from pyspark.sql import functions as F

from conftest import FIXTURES
from corpusmill.operators import html as H
from corpusmill.operators import records as D
from corpusmill.operators import text as T
from corpusmill.sources import claims as C


def records(spark, *htmls):
    df = spark.createDataFrame([(f"http://d.org/{i}", h) for i, h in enumerate(htmls)], "url string, html string")
    return H.page_records(df).orderBy("url", F.desc("side"), "pos").collect()


def test_debate_html_records(spark):
    html = open(os.path.join(FIXTURES, "debates.html")).read()
    rows = records(spark, html, "<html><p>no container</p></html>", None, "")
    assert [(r.side, r.pos, r.claim) for r in rows] == [("for", 0, "Homework is harmful"), ("for", 1, "Teachers overload pupils"),
                                                        ("against", 0, "Homework teaches discipline")]
    assert rows[0].title == 'This House would ban "homework"'
    assert rows[1].argument is None and rows[1].counter is None   # missing argument and counter
    assert rows[2].argument.startswith("Discipline") and rows[2].counter is None


def test_container_without_blocks_gives_no_rows(spark):
    assert records(spark, '<div class="node-debatabase"><div class="debatabase-title">T</div></div>') == []


def test_unclosed_markup_does_not_break_extraction(spark):
    html = '<div class="node-debatabase"><div id="debatabase-points-1">' + "<p>" * 3000 + \
        '<div class="content"><div class="field-name-field-title-point-for"><div class="field-item">A &amp; <i>B</div>'
    assert [r.claim for r in records(spark, html)] == ["A & B"]


def point(title, point="", quote='"'):
    def item(name, inner):
        return f"<div class={quote}field {name}{quote}><div class={quote}field-items{quote}><div class={quote}field-item even{quote}>{inner}</div></div></div>"
    return (f"<div class={quote}content clearfix{quote}>" + item("field-name-field-title-point-for", title)
            + (item("field-name-field-point-point-for", point) if point else "") + "</div>")


def debate(points, quote='"', extra=""):
    return (f"<body><div class={quote}node node-debatabase{quote}><div class={quote}debatabase-title{quote}>T &eacute; <b>x</b></div>"
            f"<div id={quote}debatabase-points-1{quote}>{points}</div>{extra}</div><div class={quote}content{quote}>outside</div></body>")


def test_nested_elements_belong_to_their_field(spark):
    rows = records(spark, debate(point("c <div>in <div>deep</div></div> rest", "<p>one</p><p>two<br>three</p><ul><li>four<li>five</ul> six") + point("next")))
    assert [(r.pos, r.claim, r.argument) for r in rows] == [(0, "c in deep rest", "one two three four five six"), (1, "next", None)]
    assert rows[0].title == "T é x"


def test_single_quotes_bare_values_and_case(spark):
    rows = records(spark, debate(point("a", "b", "'"), "'"), debate(point("a", "b")).replace("div", "DIV").replace("field-item even", "Field-Item"),
                   "<div class=node-debatabase><div id=debatabase-points-1><div class=content><div class=field-name-field-title-point-for><p class=field-item>a<p>no</div></div></div></div>")
    assert [(r.url[-1], r.claim, r.argument) for r in rows] == [("0", "a", "b"), ("1", "a", "b"), ("2", "a", None)]


def test_tags_in_attributes_comments_and_scripts_match_nothing(spark):
    inner = "x <!-- </div> --> <i title='</div>'>y</i> <script>'</div>'</script> z <div/> w <img src=a> </span> v"
    assert [r.claim for r in records(spark, debate(point(inner)))] == ["x y z w v"]


def test_items_in_items_and_fields_outside(spark):
    nested = '<div class="content">' + point("inner") + "</div>"
    rows = records(spark, debate(nested, extra=point("not in the block")))
    assert [(r.pos, r.claim) for r in rows] == [(0, "inner"), (1, "inner")]   # both contents select it
    deep = "<div>" * 3000 + "a" + "</div>" * 3000
    assert [r.claim for r in records(spark, debate(point(deep)))] == ["a"]
    assert records(spark, debate("")) == []


def test_flatten_sentences_outline(spark):
    html = open(os.path.join(FIXTURES, "debates.html")).read()
    pages = spark.createDataFrame([("http://d.org/1", html)], "url string, html string")
    recs = H.page_records(pages).toPandas()
    grp = recs.sort_values(["side", "pos"], ascending=[False, True])
    claim = lambda r: {"claim": r.claim, "argument": r.argument, "counter": r.counter}
    deb = spark.createDataFrame([(
        "http://d.org/1", recs.title[0],
        [claim(r) for r in grp.itertuples() if r.side == "for"],
        [claim(r) for r in grp.itertuples() if r.side == "against"])],
        f"debate_key string, name string, for_claims {D.CLAIM_TYPE}, against_claims {D.CLAIM_TYPE}")
    silent = spark.createDataFrame([("http://d.org/2", "Nobody spoke", None, [])], deb.schema)
    numbered = D.number_debates(deb.unionByName(silent))
    every = D.flatten_debates(numbered)
    claims = every.filter("debate_id = 1000000")
    c = claims.orderBy("claim_no").collect()
    assert [(r.debate_id, r.claim_no, r.is_opposing) for r in c] == [
        (1000000, 0, False), (1000000, 1, False), (1000000, 2, True)]
    s = D.claim_sentences(claims).orderBy("claim_no", "sno").collect()
    first = [(r.sentence_id, r.side) for r in s if r.claim_no == 0]
    # one running counter over argument then counter sentences
    assert first[-2:] == [("1000000_0_4", "counter"), ("1000000_0_5", "counter")]
    assert [r.sentence for r in s if r.claim_no == 2] == ["Discipline matters later .", ""]
    lines = [r.text for r in D.outline(every, numbered).filter("debate_id = 1000000").orderBy("line_no").collect()]
    assert [r.text for r in D.outline(every, numbered).filter("debate_id = 1000001").collect()] == ["Nobody spoke"]
    assert lines[0] == 'This House would ban "homework"'
    assert lines[1] == "  for: Homework is harmful"
    assert all("Smith" not in x for x in lines)               # reference list cut at " 1: "
    rec = D.claim_records(claims).filter(F.col("_claim_id") == "1000000_0").first()
    assert '"' not in rec["_debate_name"] and len(rec["_counter_sentences"]) == 2


def test_claims_json_read_and_pairs(spark, scratch):
    c = C.read_claims_json(spark, os.path.join(FIXTURES, "claims.json"))
    rows = {r["_claim_id"]: r for r in c.collect()}
    assert rows["1000000_1"]["_counter_sentences"] is None
    assert rows["1000000_0"]["_argument_sentences"]["1000000_0_3"] == "A back\\slash too ."
    s = c.select("_claim_id", F.col("_claim").alias("claim"),
                 T.ordered_sentences(F.col("_argument_sentences")).alias("sentences"))
    p = {r.pair_id: r for r in T.make_pairs(s, id_col="_claim_id", sep="").collect()}
    # numeric order 2 < 3 < 10, no separator, lower-cased text, claim unchanged
    assert p["1000000_0"].text == ' second comes "first" here .a back\\slash too .tenth comes last .'
    assert p["1000000_0"].summary == "Homework Is Harmful"
    assert p["1000000_1"].text == " "
    C.write_claims_json(c, os.path.join(scratch, "out"))
    back = C.read_claims_json(spark, os.path.join(scratch, "out"), multi_line=False)
    assert sorted(map(str, back.collect())) == sorted(map(str, c.collect()))


def test_movie_schema(spark, scratch):
    path = os.path.join(scratch, "movies.json")
    open(path, "w").write('[{"_movie_name": "M", "_movie_id": "1", "_critics": {"c1": "good"}, '
                          '"_critic_consensus": "fine"}]')
    m = C.read_movies_json(spark, path).first()
    assert m["_critics"] == {"c1": "good"} and m["_critic_consensus"] == "fine"
