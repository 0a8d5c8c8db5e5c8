import re
import time

import pytest

from waymesh.llm import html_extract as hx

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></ul></nav>
<div class="cookie-notice">We use cookies</div><aside>Side</aside>
<article class="post"><header><h1>Title &amp; more</h1><span>by me</span></header>
<p><b>First<br><p>Second&nbsp; para <i>it</i>alic</p><ul><li>one<li>two</ul><!-- no --><form>Mail <input></form>
<table><tr><td>c1<td>c2<tr><td>c3</table><section id="comments"><p>Nice post</p></section><div hidden>gone</div></article>
<div class="ad-box">Buy</div><footer>&copy; us</footer>"""


def test_one_page():
    assert hx.main_text(PAGE) == "Title & more First Second para italic one two c1 c2 c3"


@pytest.mark.parametrize("source", [None, "", "   ", "<", "<article", "<script>x", "<!-- x", "</p></div>", "<nav>a</nav>", "<article></article>"])
def test_pages_without_text(source):
    assert hx.main_text(source) in ("", "<", "<article")


def test_plain_and_unclosed():
    assert hx.main_text("just text &lt;b&gt; &#233;") == "just text <b> é"
    assert hx.main_text("<div><p>a<p>b</div>c") == "a b c"
    assert hx.main_text("<main>in</main> out") == "in"
    assert hx.main_text("<p>a" * 3000).split() == ["a"] * 3000


@pytest.mark.parametrize(
    "wrapper",
    ['<div class="layout has-sidebar">', '<div class="container header-fixed">', '<div class="no-sidebar">', '<div class="search-page">']
    + ['<div class="with-related">', '<form action="/x">', '<div id="header">', '<div class="sidebar">', '<div class="menu"><form>'],
)
def test_marks_of_a_wrapper_do_not_reach_its_article(wrapper):
    page = "<nav>n</nav>{}<div class='share-bar'>Like</div><article><p>one</p><p>two</p></article></div></form><footer>f</footer>"
    assert hx.main_text(page.format(wrapper)) == "one two"
    assert hx.main_text(f"<aside>{wrapper}<article>no</article></div></form></aside>") == ""


@pytest.mark.parametrize("wrapper", ['<div class="layout has-sidebar">', '<div class="header-fixed">', '<div class="search-page">', "<form>"])
def test_wrappers_without_article(wrapper):
    assert hx.main_text(f"<nav>n</nav>{wrapper}<p>one</p><div class='site-footer'>f</div><p>two</p></div></form>") == "one two"


def test_names_of_paragraphs_and_of_branches():
    assert hx.main_text("<article><p class='popular'>a<p class='response'>b<p class='notice-board'>c<div class='ad'>d</div></article>") == "a b c"
    for name in ("site-header", "main-nav", "post-comments", "ad-box", "related", "header header-fixed"):
        assert hx.main_text(f"<div><p>story</p></div><div class='{name}'>no</div>") == "story"
    comments = "<div id='comments'><article class='comment'>Nice</article></div>"
    assert hx.main_text(f"<article>story</article>{comments}") == hx.main_text(f"<div>story</div>{comments}") == "story"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, paths string")


def test_site_tree_cuts_what_does_not_vary(spark):
    rows = []
    for i in range(30):
        body = f"<div class='top'>Welcome to the site</div><div class='text'><p>story {i} of many</p><p>goes on {i * 7}</p></div><div class='end'>Read on</div>"
        rows.append((i, f"https://one.example/{i}", body))
    rows.append((100, "https://two.example/", "<div class='top'>Welcome to the site</div>"))
    rows += [(101, None, None), (None, "x", ""), (102, "", "<p>alone</p>"), (102, "", "<p>alone</p>")]
    got = sorted(((r.page_id, r.text, r.n_chars) for r in hx.extract_pages(pages_of(spark, rows)).collect()), key=repr)
    want = [(i, f"story {i} of many goes on {i * 7}") for i in range(30)] + [(100, "Welcome to the site"), (101, ""), (None, ""), (102, "alone"), (102, "alone")]
    assert got == sorted(((i, t, len(t)) for i, t in want), key=repr)
    tree = {r.path: r for r in hx.site_tree(pages_of(spark, rows).where("page_id < 30").withColumn("host", hx.host_of(hx.F.col("url")))).collect()}
    assert tree["html/div.top"].importance == pytest.approx(0) and tree["html/div.text/p"].content == pytest.approx(1)
    assert tree["html/div.text/p"].occurrences == 60 and tree["html/div.text/p"].pages == 30


def test_equal_articles_stay(spark):
    rows = [(i, "https://one.example/", "<nav>n</nav><article><p>same text</p></article>") for i in range(20)]
    assert {r.text for r in hx.extract_pages(pages_of(spark, rows)).collect()} == {"same text"}
    assert hx.extract_pages(pages_of(spark, [])).count() == 0


def several(k, n):
    return " ".join(f"page {k} part {i}" for i in range(n)), "".join(f"<p>page {k} part {i}</p>" for i in range(n))


@pytest.mark.parametrize(("copies", "paragraphs"), [(20, 2), (200, 10)])
@pytest.mark.parametrize("frame", ["<article>{}</article>", "<div class='text'>{}</div>"])
@pytest.mark.parametrize("others", [0, 12])
def test_equal_pages_of_several_paragraphs_stay(spark, copies, paragraphs, frame, others):
    pages = [several(0, paragraphs)] * copies + [several(k, 3) for k in range(1, others + 1)]
    rows = [(i, "https://one.example/", f"<body><script>{i}</script><div class='top'>Welcome</div>{frame.format(p)}</body>") for i, (_, p) in enumerate(pages)]
    got = {r.page_id: r.text for r in hx.extract_pages(pages_of(spark, rows)).collect()}
    cut = "article" in frame or others == 12  # the rule for articles, or enough different pages to tell
    assert got == {i: ("" if cut else "Welcome ") + t for i, (t, _) in enumerate(pages)}


def test_small_sites_learn_from_all(spark):
    page = "<div class='top'>Welcome to {0}</div><div class='text'><p>story {0} {1}</p><p>goes on {1}</p></div>"
    hosts = [(h, i) for h in range(4) for i in range(5)] + [(9, 0)]
    rows = [(100 * h + i, f"https://h{h}.example/{i}", page.format(h, i)) for h, i in hosts]
    got = {r.page_id: r.text for r in hx.extract_pages(pages_of(spark, rows)).collect()}
    assert got == {100 * h + i: f"story {h} {i} goes on {i}" for h, i in hosts}


def test_an_article_shown_again_counts_once(spark):
    text, body = several(0, 2)
    rows = [(i, "https://one.example/", f"<div class='time'>at {i}</div><article>{body}</article>") for i in range(20)]
    assert {r.text for r in hx.extract_pages(pages_of(spark, rows)).collect()} == {text}


def test_what_holds_a_kept_branch_is_kept(spark):
    tree = [("h", p, p.endswith("p"), 20, 20, v) for p, v in (("html", 0.0), ("html/body", 0.0), ("html/body/p", 1.0), ("html/body/div", 0.1), ("html/body/div/ul", 0.2))]
    frame = spark.createDataFrame(tree, "host string, path string, inside boolean, occurrences long, pages long, importance double")
    assert [r.paths for r in hx.low_branches(frame).collect()] == [["html/body/div", "html/body/div/ul"]]


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in hx.extract_pages(pages).collect()}
    for row in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|<footer>)", row.html, re.S)[1]
        words = hx.html.unescape(re.sub(r"<[^>]*>", " ", article)).split()
        assert got[row.page_id].split() == words


def test_any_depth_in_linear_time():
    """Recursion and searches of the open elements would end such pages, or never end."""
    for inner in ("<div>", "<span class=x>", "<ul><li>"):
        source = "<html><body><article><p>Start" + inner * 50_000 + "deep" + "<p>er"
        start = time.perf_counter()
        assert hx.main_text(source) == ("Start deep er" if inner != "<span class=x>" else "Startdeep er")
        assert hx.features_of(source)
        assert time.perf_counter() - start < 6
    assert hx.main_text("<p><button>" + "<span>" * 20_000 + "<div>x" * 20_000) == ""


def test_equal_contents_have_equal_hashes():
    one, two, other = (dict((f[0], f[3]) for f in hx.features_of(f"<div><p>a <b>b</b></p>{more}</div>")) for more in ("", "<p> </p>", "<p>c</p>"))
    assert one["html/div"] == two["html/div"] != other["html/div"] and one["html/div/p"] == one["html/div"]
