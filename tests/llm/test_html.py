"""Main text: planted boilerplate, broken markup, linear time."""
import re
import time
from html import unescape

from evq.llm.html import extract, main_text
from evq.llm.queries import op8

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><header><h1>Site, name</h1></header>
<nav><ul><li><a href=/>Home</a><li><a href=/b>Blog</a></ul></nav><div id="cookie-notice">We use cookies, and more cookies, for reasons that take long to tell</div>
<div class="wrap"><div class="content"><h2>Title here</h2><p>First para, with commas, and words that go on for a good while, so it counts.</p><ul><li>item one, of the list</li><li>item two</li></ul>
<blockquote>Quoted, text</blockquote><div class="ad-slot">buy now, buy</div><p>Second <a href=x>para</a>,   with an&nbsp;entity &amp; more &lt;tags&gt; in<b>side</b>, so that it is long.<p>Unclosed, third<br>line.
<table><tr><td>a<td>b</table></div><div class="sidebar"><p>Sidebar, text, that is rather long, and has commas, many of them, in it.</p></div></div>
<section id="comments"><h3>Comments</h3><p>Great, post, really, I liked it, very, very, much, and I say so at great length, again and again, my friend.</p></section>
<form><p>Sign up, please, now, now, now for our long long newsletter of things</p></form><footer>foot &copy;</footer></body></html>"""
TEXT = ("Title here First para, with commas, and words that go on for a good while, so it counts. item one, of the list item two Quoted, text "
        "Second para, with an entity & more <tags> inside, so that it is long. Unclosed, third line. a b")


def test_planted_page():
    assert main_text(PAGE) == TEXT


def test_article_element_wins_and_is_whole():
    long = "word, " * 50
    page = f"<body><div>{long}</div><article><h1>Head</h1><section><p>One, two.</p></section><section><p>{long}</p></section><aside>no</aside><article class='comment'><p>{long}</p></article></article></body>"
    assert main_text(page) == f"Head One, two. {long.strip()}"


def test_small_and_broken():
    cases = {None: "", "": "", "hi": "hi", "<p>a<p>b<div>c</div>d": "a b c d", "<div>x, y<br>z &eacute;</div><!-- <p>": "x, y z é", "</div></p>stray": "stray", "<script>x": "", "a < b": "a < b"}
    assert {k: main_text(k) for k in cases} == cases


def test_blocks_of_one_link_stay():
    long = "word, " * 50
    two = f"<p>{long}<a href=1>one</a> and <a href=2>two</a></p>"
    assert main_text(f"<article><div><a href=0>Read the full report here</a></div>{two}</article>") == f"Read the full report here {long}one and two"
    for tag, row in (("ul", "<li>{}"), ("ol", "<li>{}"), ("table", "<tr><td>{}"), ("div", "{}")):
        block = f"<{tag}>{row.format('<a href=0>The report</a>')}</{tag}>"
        assert main_text(f"<body><div class=text>{block}{two}</div></body>") == f"The report {long}one and two"
        many = f"<{tag}>{''.join(row.format(f'<a href={k}>Item {k}</a> ') for k in range(300))}</{tag}>"
        assert "Item" not in main_text(f"<body><div class=text>{two}{many}</div></body>")
        assert "Item 299" in main_text(f"<article>{two}{many}</article>")
        assert "Item" not in main_text(f"<article>{two}{many.replace(tag, f'{tag} class=menu', 1)}</article>")


def test_hidden_elements_keep_what_follows():
    long = "word, " * 50
    for tag in ("svg", "select", "template", "noscript", "iframe"):
        for mark in (f"<{tag} a='1'/>", f"<{tag}>", f"<{tag}><{tag}>" if tag in ("svg", "template") else f"<{tag}>", f"<{tag}></{tag}>", f"<{tag}><b>gone<p>gone</p></b></{tag}>"):
            assert main_text(f"<article><p>{long}in{mark}side</p><p>tail</p></article>") == f"{long}inside tail", mark
            assert main_text(f"<article><p>{long}in{mark}side</p><p>tail</p></article><div>x<{tag}>gone</{tag}></div>") == f"{long}inside tail", mark


def test_deep_pages():
    long = "word, " * 50
    for depth in (10, 399, 400, 401, 5000):
        tower = "<div>" * depth
        page = f"<body><article><p>{long}</p>{tower}<nav>menu</nav><aside>no</aside><footer>no</footer><form>no</form><p>deep</p>{'</div>' * depth}<p>end</p></article><p>outside</p></body>"
        assert main_text(page) == f"{long}deep end", depth
    t = time.time()
    n = 40000
    for page in ("<div>" * n + "</x>" * n, "<i><div>" + "<b>" * n + "</i>" * n, "<y>" * n + "<p>" * n, "<b>" * n + "<li>" * n, "<div>" * n + "<body>" * n, "<template>" * n + "</template>" * n, "<select>" * n):
        main_text(page)
    assert time.time() - t < 60


def test_linear_time():
    t = time.time()
    for page in ("<div>" * 100000 + "x", "<" * 200000, "<a " + 'x="' * 60000, "<!--" * 50000, "<p>a" * 50000, "<ul>" * 300 + "<li><a>x</a>" * 20000, "&" * 200000):
        main_text(page)
    assert time.time() - t < 60


def test_query(spark, sf):
    """On the sample pages the article element is the truth."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op8(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        source = pages[r.page_id].html
        inner = re.search(r"<article>(.*?)(</article>|\Z)", source, re.S)[1]
        want = " ".join(unescape(re.sub(r"<(?!/?b>)[^>]*>", " ", inner).replace("<b>", "").replace("</b>", "")).split())
        assert r.text == want and r.n_chars == len(want) and r.url == pages[r.page_id].url


def test_edges(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", PAGE), (3, "u", PAGE), (None, "u", "<p>x")]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, `TEXT` string")
    assert sorted(r.text for r in extract(pages).collect()) == sorted(["", "", TEXT, TEXT, "x"])
    assert extract(pages.limit(0)).count() == 0
