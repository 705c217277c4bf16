"""Link extraction and URL handling: X1, X2, X4, X8, P3, P4 (FIXTURES.md link cases)."""

from pyspark.sql import functions as F

from corpusmill.operators import links as L

BASE = "http://site.org/dir/page?q=1#top"
HTML = ("<p><a href='/root'>r</a> <a href=\"../up\">u</a> <A HREF=\"https://abs.org:8443/p#x\">a</A>"
        "<a href=\"?only\">q</a><a href=\"#frag\">f</a><a href=\"x#a#b\">h</a><a href=\"mailto:me@x.org\">m</a>"
        "<a href=\"\">empty</a><a class=k href=bare>in <b>bold</b></a><a href=\"javascript:go()\">js</a></p>")


def test_link_table(spark):
    pages = spark.createDataFrame([(BASE, HTML)], "url string, html string")
    rows = [(r.pos, r.dest, r.anchor) for r in L.link_table(pages).orderBy("pos").collect()]
    assert rows == [
        (0, "http://site.org/root", "r"),
        (1, "http://site.org/up", "u"),
        (2, "https://abs.org:8443/p", "a"),
        (3, "http://site.org/dir/page?only", "q"),
        (4, "http://site.org/dir/page?q=1", "f"),
        (5, "http://site.org/dir/x#a", "h"),
        (6, "mailto:me@x.org", "m"),
        (7, "http://site.org/dir/page?q=1", "empty"),
        (8, "http://site.org/dir/bare", "in <b>bold</b>"),
    ]  # the javascript: link is malformed for java.net.URL and dropped


def test_site_key_default_ports(spark):
    df = spark.createDataFrame([("http://a.org/x",), ("https://b.org",), ("https://c.org:8443/y",),
                                ("http://u:p@d.org:81/",)], "u string")
    got = [r[0] for r in df.select(L.site_key(F.col("u"))).collect()]
    assert got == ["http://a.org:80", "https://b.org:443", "https://c.org:8443", "http://d.org:81"]


def test_follow_rule(spark):
    rule = L.follow_rule()
    df = spark.createDataFrame([("https://idebate.org/debatabase/x",), ("https://idebate.org/debatabase?rate=5",),
                                ("https://idebate.org/user/login",), ("http://other.org/debatabase",)], "u string")
    got = [r[0] for r in df.select(rule(F.col("u"), F.lit(None))).collect()]
    assert got == [True, False, False, False]


def test_references_comments_and_control_characters(spark):
    html = ("<!-- <a href='/c'>no</a> --><script>var s=\"<a href='/s'>no</a>\"</script><a href='/a?x=1&amp;y=2'>1</a><a href='\n\t/b '>2</a>"
            "<a href='&#47;d&#x2F;e&unknown;&amp'>3</a><a href='&#x110000;'>4</a><a name=x>none</a>")
    pages = spark.createDataFrame([("http://s.org/p", html)], "url string, html string")
    assert [r.dest for r in L.link_table(pages).orderBy("pos").collect()] == [
        "http://s.org/a?x=1&y=2", "http://s.org/b", "http://s.org/d/e&unknown;&amp", "http://s.org/\ufffd"]


def test_anchor_rule(spark):
    html = "<a href='/1'>The <b>Next</b> page</a><a href='/2'>nextly</a>"
    pages = spark.createDataFrame([("http://s.org/p", html)], "url string, html string")
    assert [r.dest for r in L.link_table(pages, follow=L.anchor_rule(["NEXT"])).collect()] == ["http://s.org/1"]


def links(spark, html):
    pages = spark.createDataFrame([("http://s.org/p", html)], "url string, html string")
    return [(r.pos, r.dest, r.anchor) for r in L.link_table(pages).orderBy("pos").collect()]


def test_attributes_are_scanned_by_name_and_quotes(spark):
    assert links(spark, """<a data-href='/no' href='/yes'>1</a><a title="a>b" href=/b>2</a><a title="x href='/no'" HREF = "/c">3</a>"""
                        """<a xhref=/no>4</a><a href=/d href=/no>5</a><a/href=/e>6</a><a href>7</a><a href=>8</a><abbr href=/no>9</abbr>"""
                        """<a title='it"s' href=/it's>10</a><a\nhref\n=\n"/f g"\n>11</a><a b="c"href=/h>12</a>""") == [
        (0, "http://s.org/yes", "1"), (1, "http://s.org/b", "2"), (2, "http://s.org/c", "3"), (3, "http://s.org/d", "5"),
        (4, "http://s.org/e", "6"), (5, "http://s.org/p", "7"), (6, "http://s.org/p", "8"), (7, "http://s.org/it's", "10"),
        (8, "http://s.org/f g", "11"), (9, "http://s.org/h", "12")]


def test_what_only_looks_like_a_link(spark):
    assert links(spark, "<textarea><a href='/t'>t</a></textarea><title><a href=/i>i</a></title><p title=\"<a href='/q'>q</a>\">"
                        "<!-- <a href=/c>c</a> --><script>'<a href=/s>s</a>'</script><a href=/ok>x<!-- </a> -->y<b title='</a>'>z</b></a>") == [
        (0, "http://s.org/ok", "x<!-- </a> -->y<b title='</a>'>z</b>")]
    assert links(spark, "<a href=/1>one<a href=/2>two</a><a href=/3>three") == [
        (0, "http://s.org/1", "one"), (1, "http://s.org/2", "two"), (2, "http://s.org/3", "three")]
    assert links(spark, "<!-- <a href=/c>never ends") == [] and links(spark, "<script><a href=/c>x</a>") == []


def test_all_named_references_and_long_pages(spark):
    assert links(spark, "<a href='/&eacute;&rarr;&nosuch;&ne;'>x</a>") == [(0, "http://s.org/é→&nosuch;≠", "x")]
    many = " ".join(f"a{i}='{i}>'" for i in range(50_000))
    assert links(spark, f"<a {many} href=/far>{'<b>y</b>' * 50_000}</a>" + "<" * 50_000 + "<a href=/last>z</a>")[-1][1:] == ("http://s.org/last", "z")
