"""robots.txt parsing and the prefix-rule join: X9, J3, S10 (FIXTURES.md robots table)."""

from corpusmill.operators import robots as R

AGENT = "corpusmill"


def decide(spark, text, paths):
    site = "http://s.org:80"
    robots = spark.createDataFrame([] if text is None else [(site, text)], "site string, text string")
    rules = R.parse_robots(robots, AGENT)
    urls = spark.createDataFrame([("http://s.org" + p,) for p in paths], "url string")
    got = {r.url[len("http://s.org"):]: r.allowed for r in R.allowed(urls, rules).collect()}
    return [got[p] for p in paths]


def test_named_group_wins_over_star(spark):
    t = "User-agent: *\nDisallow: /\n\nUser-agent: corpusmill\nDisallow: /private\n"
    assert decide(spark, t, ["/a", "/private/x"]) == [True, False]


def test_named_group_without_rules_falls_back(spark):
    t = "User-agent: corpusmill\n\nUser-agent: *\nDisallow: /x\n"
    assert decide(spark, t, ["/x", "/y"]) == [False, True]


def test_stacked_agents_and_case(spark):
    t = "User-agent: other\nUser-agent: CorpusMill\nDisallow: /a\nuser-agent: *\nDisallow: /b\n"
    # the lower-case "user-agent:" line is not a directive, so /b stays in the same group
    assert decide(spark, t, ["/a", "/b", "/c"]) == [False, False, True]


def test_first_match_decides(spark):
    assert decide(spark, "User-agent: *\nAllow: /a\nDisallow: /\n", ["/a/x", "/b"]) == [True, False]
    assert decide(spark, "User-agent: *\nDisallow: /\nAllow: /a\n", ["/a/x"]) == [False]


def test_empty_directives(spark):
    assert decide(spark, "User-agent: *\nDisallow:\n", ["/a"]) == [True]
    assert decide(spark, "User-agent: *\nAllow:\n", ["/a"]) == [False]


def test_comments_blank_lines_crawl_delay(spark):
    t = "# hello\n\nUser-agent: * # all\nCrawl-delay: 5\n\nDisallow: /t # no t\n"
    assert decide(spark, t, ["/t", "/u"]) == [False, True]


def test_agent_in_two_groups_first_only(spark):
    t = "User-agent: corpusmill\nDisallow: /one\n\nUser-agent: corpusmill\nDisallow: /two\n"
    assert decide(spark, t, ["/one", "/two"]) == [False, True]


def test_missing_file_allows(spark):
    assert decide(spark, None, ["/anything"]) == [True]


def test_tabs_and_other_control_characters(spark):
    assert decide(spark, "User-agent:\tcorpusmill \r\nDisallow:\t/private\t# no\n", ["/private/a", "/x"]) == [False, True]


def test_files_read_back(spark, scratch):
    rows = [("http://a.org:80", "User-agent: *\nDisallow: /x\n"), ("https://b.org:443", "")]
    path = f"{scratch}/robots"
    R.write_robots_files(spark.createDataFrame(rows, "site string, text string"), path)
    got = {r.site: r.text for r in R.read_robots_files(spark, path).collect()}
    assert got["http://a.org:80"].startswith(rows[0][1]) and set(got) >= {"http://a.org:80"}


def test_ten_thousand_rules_on_one_site(spark):
    import random

    from pyspark.sql import Row
    rng = random.Random(6)
    rules = [("http://a.org:80", i, rng.random() < 0.5, "/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, 13)))) for i in range(10_000)]
    rules += [("http://b.org:80", 0, False, ""), ("http://b.org:80", 1, True, "/x")]
    paths = ["/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, 20))) for _ in range(300)]
    urls = [(f"http://a.org{p}?q=1", i) for i, p in enumerate(paths)] + [("http://b.org/x", 1), ("http://c.org/", 2), (None, 3), ("http://a.org/aa", 4), ("http://a.org/aa", 4)]
    got = R.allowed(spark.createDataFrame(urls, "url string, n int"), spark.createDataFrame(rules, "site string, rule_no int, allow boolean, prefix string"))
    assert got.columns == ["url", "n", "allowed"]

    def want(url):
        if url is None:
            return True
        site, path = url[:12] + ":80", url[12:].split("?")[0]
        return next((a for s, _, a, p in rules if s == site and path.startswith(p)), True)
    assert sorted(map(str, got.collect())) == sorted(str(Row(url=u, n=n, allowed=want(u))) for u, n in urls)
