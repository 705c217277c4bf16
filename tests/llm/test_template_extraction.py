import pytest

from corpusmill.llm import template_extraction as X

ARTICLE = ("<html><body><nav><ul><li><a href=/x>menu</a></ul></nav><div class='cookie-notice'>we use</div><main><article class='post'><header>H</header>"
           "<h1>A &amp; B</h1><p>one<p>two <b>x</b>\n y<br>z&nbsp;!<!-- c --><script>var t='</p>';</script><ul><li>l1<li>l2</ul>"
           "<section class=comments><p>c</section><form>f</form></article></main><aside>s</aside><footer>&copy;</footer></body>")


def plain(i, words):
    return (f"<div id=top><a href=/>home</a></div><div class=sidebar>{i}</div><div class=box><div class=story><p>{words}</p><p>more {i}</p></div>"
            f"<div class='share'>tell</div></div><div class=foot><span>{i}</span></div>")


@pytest.mark.parametrize("html, text", [
    (ARTICLE, "A & B\none\ntwo x y z !\nl1\nl2"), (None, ""), ("", ""), ("just text", "just text"), ("<p>a<p>b</p></p>c", "a\nb\nc"),
    ("<article>cut <p>off &am", "cut\noff &am"), ("<nav>only menu</nav>", ""), ("a < b <c", "a < b <c"), ("<p title='>'>q</p><p>&lt;p&gt;</p>", "q\n<p>"),
    ("<article>1</article><p>x</p><article>2</article>", "1\n2"), ("<script>never ends <p>x", ""), ("<p>a<br>b<hr>c", "a b\nc")])
def test_one_page(html, text):
    assert X.main_text(html, None) == text


def test_hostile_pages():
    assert X.main_text("<p>" * 5000 + "x", None) == "x"
    assert X.main_text("<div>" * 5000 + "deep", None) == "deep"
    assert X.main_text("<" * 20_000, None) == "<" * 20_000
    assert X.main_text("<a '" + "x" * 200_000, None) == "<a '" + "x" * 200_000
    assert len(X.main_text("<article>" + "word " * 400_000, None)) == 1_999_999


@pytest.mark.parametrize("hosts", [500_000, 0])
def test_template_finds_the_slot_without_saying_tags(spark, hosts):
    rows = [(i, f"http://h.org/{i}", plain(i, f"long story number {i} " * 20)) for i in range(12)]
    rows += [(20, "http://other.org/", ARTICLE), (21, None, None), (22, "nohost", "<article>t</article>"), (None, "http://h.org/n", plain(99, "w")), (20, "http://other.org/", ARTICLE)]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "page_id long, url string, html string, salt int, slot string").repartition(3)
    got = X.extract_main_text(df, broadcast_hosts=hosts).collect()
    by = {r.page_id: r.text for r in got}
    assert by[3] == "long story number 3 " * 19 + "long story number 3\nmore 3"
    assert by[20].startswith("A & B\none") and by[21] == "" and by[22] == "t" and by[None] == "w\nmore 99"
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)


def test_copies_keep_their_text(spark):
    page = "<html><body><nav>m</nav><article><h1>T</h1><p>same words</p></article><footer>f</footer></body></html>"
    df = spark.createDataFrame([(i, f"http://c.org/{i}", page) for i in range(6)], "page_id long, url string, html string")
    assert {r.text for r in X.extract_main_text(df).collect()} == {"T\nsame words"}


def test_classes_share_occurrence_vectors(spark):
    df = spark.createDataFrame([("h", i, plain(i, "story " * 30) + "<ul>" + "<li>x</li>" * i + "</ul>") for i in range(1, 8)], "host string, page long, html string")
    r = X.host_templates(df).collect()
    assert len(r) == 1 and r[0].tokens >= 4 and r[0].classes >= 1 and r[0].slot is not None


def test_empty(spark):
    df = spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string")
    assert X.extract_main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("around", [
    "<body class='no-sidebar'>{}</body>", "<div id='content-with-sidebar'>{}</div>", "<article class='post comments-open'>{}</article>",
    "<main class='has-footer'>{}</main>", "<div class='social-science'>{}</div>", "<body class='sidebar'>{}</body>", "<article class='related'>{}</article>",
    "<div class='widget'>{}</div>", "<div data-id='ad' data-class='menu'>{}</div>", "<div class='promo'><main>{}</main></div>"])
def test_marks_of_boilerplate_do_not_take_the_article(spark, around):
    rows = [(i, f"http://a.org/{i}", around.format(f"<h1>T{i}</h1><p>{f'words of {i} ' * 20}</p><div class='ad'>buy</div>")) for i in range(4)]
    got = X.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"T{i}\n{(f'words of {i} ' * 20).strip()}" for i in range(4)}


LAYOUTS = {
    "lead": ("<body><div class=content><div class=lead>{}</div><div class=body>{}</div></div></body>", 4, 6),
    "paragraph": ("<div><h1>{}</h1><p>{}</p></div>", 1, 20),
    "rest of main": ("<body><main><div>{}</div><article>{}</article></main></body>", 4, 6),
    "beside article": ("<body><div class=lead>{}</div><article>{}</article></body>", 4, 6),
}


@pytest.mark.parametrize("pages", [1, 6])
@pytest.mark.parametrize("layout", LAYOUTS)
def test_the_slot_holds_all_of_the_article(spark, layout, pages):
    page, a, b = LAYOUTS[layout]
    rows = [(i, f"http://b.org/{i}", page.format(f"one {i} " * a, f"two {i} " * b)) for i in range(pages)]
    got = X.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"{(f'one {i} ' * a).strip()}\n{(f'two {i} ' * b).strip()}" for i in range(pages)}


def test_an_empty_slot_falls_back():
    slot = next(p for p, t in X.page_tokens(X.events("<body><div class=story>x</div></body>")).items() if t[0] == "div.story")
    assert X.main_text("<body><div class=story></div><p>text</p></body>", slot) == "text"
    assert X.main_text("<body><div class=story> </div><main>m</main><p>text</p></body>", slot) == "m"


@pytest.mark.parametrize("html, text", [
    ('<article><h1>T</h1><svg class="i"/><p>article</p></article>', "T\narticle"), ("<header><svg/></header><p>a</p>", "a"),
    ("<article><p>a<noscript>b</p><p>c</p></article>", "ab\nc"), ("<p>a<svg><path d=M0 /><text>no</text></svg>b</p>", "ab"),
    ("<iframe src=x /><p>a</p>", "a"), ("<p>a<template><p>no</p></template>b", "ab"), ("<p>a<button>no</button> b<select><option>no</select></p>", "a b"),
    ("<div class='comment-list'>x</div><div class='user-comments'>x</div><div class=adsense>x</div><div class='banner-top'>x</div><p>the long text that stays</p>", "the long text that stays"),
    ("<article><div class='content-list'>stays</div></article>", "stays")])
def test_closed_elements_and_marks(html, text):
    assert X.main_text(html, None) == text


def test_blocks_of_the_template_go_copies_stay(spark):
    def page(body):
        return f"<html><body><article><h1>{body}</h1><p>Sign up for our letter today.</p><p>{f'story of {body} ' * 9}</p></article></body></html>"
    rows = [(i, f"http://c.org/{i}", page(f"n{i}")) for i in range(8)]                       # one sentence on all pages
    rows += [(100 + i, f"http://d.org/{i}", page("same")) for i in range(30)]                # thirty copies and three others
    rows += [(200 + i, f"http://d.org/x{i}", page(f"x{i}")) for i in range(3)]
    rows += [(300 + i, f"http://e.org/{i}", page(f"y{i}")) for i in range(3)]                # too few pages to tell
    rows += [(400 + i, f"http://f.org/{i}", "<article><p>only this</p></article>" + f"<p>{'z' * i}</p>") for i in range(5)]
    got = {r.page_id: r.text for r in X.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    story = lambda b: f"{b}\n{(f'story of {b} ' * 9).strip()}"
    assert all(got[i] == story(f"n{i}") for i in range(8))
    assert all(got[100 + i] == story("same") for i in range(30)) and got[201] == story("x1")
    assert got[301] == "y1\nSign up for our letter today.\n" + ("story of y1 " * 9).strip()
    assert all("only this" in got[400 + i] for i in range(1))


def test_template_against_brute_force_deduction(spark):
    """Occurrence vectors and classes by their definition, over all pages of a host at once."""
    import random
    rng = random.Random(4)
    hosts = {}
    for h in range(6):
        extra = [rng.randrange(3) for _ in range(9)]
        hosts[f"h{h}"] = [f"<body><div class=top><span>m</span></div><main><div class=a>{'w ' * rng.randrange(20, 60)}{i}</div><div class=b>"
                          + f"<p>{i} t</p>" * rng.randrange(1, 4) + "</div></main>" + "<div class=opt>o</div>" * extra[i] + "</body>" for i in range(rng.randrange(2, 9))]
    df = spark.createDataFrame([(h, 1000 * n + i, p) for n, (h, pages) in enumerate(hosts.items()) for i, p in enumerate(pages)], "host string, page long, html string")
    got = {r.host: (r.classes, r.tokens) for r in X.host_templates(df.repartition(3)).collect()}
    for h, pages in hosts.items():
        counts = [{path: t[3] for path, t in X.page_tokens(X.events(p)).items()} for p in pages]
        vectors = {path: tuple(c.get(path, 0) for c in counts) for path in {x for c in counts for x in c}}
        classes = {}
        for path, v in vectors.items():
            classes.setdefault(v, []).append(path)
        most = max(sum(map(bool, v)) for v in classes)
        valid = {v: p for v, p in classes.items() if max(v) == 1 and sum(v) >= 0.5 * most and (len(p) > 1 or sum(v) == most)}
        assert got[h] == (len(valid), sum(map(len, valid.values())))
