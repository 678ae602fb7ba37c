import html
import re

from pyspark.sql import functions as F

from siftline.llm.html_extract import Page, extract, host_of, main_text

SF = "/root/testdata/sf0.01"


def by_pattern(page):
    """The text of the given pages' article, by patterns that fit these pages only."""
    article = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>|<br>", article)]
    return " ".join(x for x in blocks if x)


def test_given_pages(spark):
    for row in extract(spark.read.parquet(f"{SF}/pages.parquet")).collect():
        assert row.text == by_pattern(row.html)


STORY = "<p>A long first paragraph of the story, with much to say.</p><p>And a second one &amp; more&nbsp;of it.</p>"
WANT = "A long first paragraph of the story, with much to say. And a second one & more of it."


def test_clutter_goes():
    page = f"""<html><body><header><p>Site name</p></header><div class="cookie-banner">We use cookies on this site.</div><nav><a href=/>Home</a></nav>
    <div class="has-sidebar"><aside>Aside words</aside><div class="content">{STORY}<form><p>Your mail</p></form><script>var x = "<p>no</p>";</script>
    <style>p {{}}</style><div class="ad">Buy this now, really.</div><div id="comments"><p>What a comment this is, by a reader.</p></div></div></div><footer>End</footer>"""
    assert main_text(page, None) == WANT


def test_broken_markup():
    assert main_text(f"<body><article><p>One<p>Two<b>x<br>Three</article>", None) == "One Twox Three"
    assert main_text("plain &lt;text&gt;", None) == "plain <text>"
    assert main_text("<article><p>a < b and c</p></article>", None) == "a < b and c"
    for broken in ("", None, "<", "<div", "</p></div>", "<!-- open", "<script>var x", "<p" * 2000, "<div>" * 3000):
        assert isinstance(main_text(broken, "/html/body"), str)


def test_white_space_and_references():
    assert main_text("<article><p> a\n\t b &#8212; &eacute;&#x41; </p><pre>c   d</pre></article>", None) == "a b — éA c d"


def test_host_votes_for_one_path(spark):
    other = "<div class='extra-7'>" + "<p>Some long other box with a lot of text to fool the score, on and on.</p>" * 4 + "</div>"
    pages = [(i, f"https://WWW.Example.com:80/{i}", f"<html><body><div class='post-{i}'>{STORY * 3}</div></body></html>") for i in range(5)]
    pages.append((9, "https://www.example.com/9", f"<html><body><div class='post-9'>{STORY}</div>{other}</body></html>"))
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert got[0] == " ".join([WANT] * 3) and got[9] == WANT


def test_hosts(spark):
    urls = [("http://u@A.b:8/x", "a.b"), ("https://x.org?q", "x.org"), (None, ""), ("/relative", ""), ("ftp://H/", "h")]
    found = spark.createDataFrame(urls, "url string, want string").select(host_of(F.col("url")).alias("got"), "want")
    assert all(r.got == r.want for r in found.collect())


def test_edges(spark):
    rows = [(1, None, None, "x"), (2, "u", "", "x"), (None, None, f"<article>{STORY}</article>", "x"), (3, "u", f"<article>{'<p>long</p>' * 20000}</article>", "x"), (3, "u", "", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string").selectExpr("*", "'x' AS host", "'y' AS path", "'z' AS row")
    out = extract(pages)
    assert set(out.columns) == set(pages.columns)
    got = sorted(((r.page_id, len(r.text)) for r in out.collect()), key=repr)
    assert got == sorted([(1, 0), (2, 0), (3, 20000 * 5 - 1), (3, 0), (None, len(WANT))], key=repr)
    assert extract(pages.limit(0)).count() == 0


def test_generalised_paths():
    assert Page("<body><div class='b a-12'><p>x</p></div></body>").nodes[2].path == "/body/div.a-#.b"


def test_one_word_does_not_decide():
    for name in ("class='post type-post tag-python'", "class='entry category-legal'", "class='related'", "id='comments'"):
        assert main_text(f"<body><p>Site</p><div {name}>{STORY}</div></body>", None).endswith(WANT), name
    for name in ("discussion", "related-work", "results-and-discussion", "side-effects", "search", "legal"):
        for tag in ("div", "section"):
            page = f"<article>{STORY}<{tag} id='{name}'><h2 id='{name}'>Title</h2><p>Its own words.</p></{tag}></article>"
            assert main_text(page, None) == f"{WANT} Title Its own words.", (tag, name)
    links = "<div class='related'><a href=/a>Another story</a> <a href=/b>And one more</a></div>"
    assert main_text(f"<article>{STORY}{links}<div class='search'><input name=q> Find</div></article>", None) == WANT


def test_captions_and_formulas_stay():
    page = f"<article>{STORY}<figure><img src=x><figcaption>A caption.</figcaption></figure><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p></article>"
    assert main_text(page, None) == f"{WANT} A caption. So x=1 holds."


def test_siblings_of_the_best_container(spark):
    page = f"<body><h1>The title</h1><div class='lead'>{STORY}</div><div class='links'><a href=/>Home</a></div><div class='text'>{STORY * 3}</div></body>"
    want = " ".join(["The title", WANT, *[WANT] * 3])
    assert main_text(page, None) == want
    pages = spark.createDataFrame([(i, "http://a.b/", page) for i in range(3)], "page_id bigint, url string, html string")
    assert {r.text for r in extract(pages).collect()} == {want}


def test_two_templates_on_one_host(spark):
    """A short summary at the path that wins on the host doesn't stand for an article elsewhere on the page."""
    usual = f"<body><div class='summary'>{STORY * 3}</div></body>"
    other = f"<body><table><tr><td><div class='summary'><p>A short summary.</p></div></td></tr></table><main>{STORY * 9}</main></body>"
    swapped = f"<body><div class='summary'><p>A short summary.</p></div><main>{STORY * 9}</main></body>"
    pages = [(i, "http://a.b/", usual) for i in range(5)] + [(8, "http://a.b/", other), (9, "http://a.b/", swapped)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert got[0] == " ".join([WANT] * 3) and got[8] == got[9] == " ".join([WANT] * 9)
