"""Scalar text functions: F2-F5, X5-X7 (FIXTURES.md token and sentence cases)."""

from pyspark.sql import functions as F

from corpusmill.functions import text as TX
from corpusmill.operators.html import element_text


def one(spark, col, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]


def test_ws_tokens_python_split(spark):
    cases = ["", "   ", " lead space", "a b", "a\u001cb\u001fc", "tab\tand\nnewline", "x  y"]
    for c in cases:
        assert one(spark, TX.ws_tokens(F.col("x")), c) == c.split(), repr(c)


def test_space_split_len_counts_empty_pieces(spark):
    for c in [" a b", "a", "", "a  b"]:
        assert one(spark, TX.space_split_len(F.col("x")), c) == len(c.split(" "))


def test_robots_line_and_quotes(spark):
    assert one(spark, TX.robots_line(F.col("x")), "  Disallow: /a  # c") == "Disallow: /a"
    assert one(spark, TX.robots_line(F.col("x")), "\t\x0bDisallow: /a\t\r\n") == "Disallow: /a"
    assert one(spark, TX.remove_quotes(F.col("x")), 'say "hi"') == "say hi"


def test_split_argument_rules(spark):
    text = 'Children need rest. Hi. It "hurts" sleep, see http://x.org/a and https://y.org/b now. http:a http:b'
    got = one(spark, TX.split_argument(F.col("x")), text)
    # "Hi." has two tokens (Hi, .) and stays; http: tokens go, https: stays;
    # a sentence of two http: tokens survives as an empty string.
    assert got[0] == "Children need rest ."
    assert got[1] == "Hi ."
    assert "http://x.org/a" not in got[2] and "https://y.org/b" in got[2]
    assert '"' not in got[2]
    assert got[-1] == ""


def test_long_texts_without_full_stops(spark):
    text = "word and http://x.y/z.w then h " * 32_000  # 1 MB, one sentence
    assert [len(s) for s in one(spark, TX.sentences(F.col("x")), text)] == [len(text)]
    assert one(spark, TX.sentences(F.col("x")), "." * 500_000 + "a" * 500_000 + "!") == ["." * 500_000, "a" * 500_000 + "!"]
    toks = one(spark, TX.tokens(F.col("x")), "'".join("a" * 20_000) + " b")
    assert len(toks) == 2


def test_sentences_with_urls(spark):
    assert one(spark, TX.sentences(F.col("x")), "See http://a.b/c.d. Then h! the end") == ["See http://a.b/c.d. Then h!", " the end"]


def test_one_token_sentence_dropped(spark):
    assert one(spark, TX.split_argument(F.col("x")), "Then two words. Yes") == ["Then two words ."]


def test_cut_references_and_charset(spark):
    assert one(spark, TX.cut_references(F.col("x")), "Body text 1: Ref one 2: two") == "Body text"
    assert one(spark, TX.charset_of(F.col("x")), "text/html; charset=ISO-8859-1") == "ISO-8859-1"
    assert one(spark, TX.charset_of(F.col("x")), "text/html") == "UTF-8"


def test_pct4(spark):
    assert one(spark, TX.pct4(F.col("x")), 0.123456, "x double") == round(round(0.123456, 4) * 100, 6)


def test_element_text_iequals_join(spark):
    assert one(spark, element_text(F.col("x")), "  a <b>x</b>\n\t &amp; b  ") == "a x & b"
    df = spark.createDataFrame([("User-Agent", "user-agent")], "a string, b string")
    assert df.select(TX.iequals(F.col("a"), F.col("b"))).first()[0] is True
    arr = spark.createDataFrame([(["a", "b"],)], "x array<string>")
    assert arr.select(TX.join_words(F.col("x"), "|")).first()[0] == "a|b"
