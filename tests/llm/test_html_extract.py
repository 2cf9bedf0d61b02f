import random

import numpy as np
from wordloom.llm import html_extract as H

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head>
<body><header class="site"><a href=/>Home</a></header><nav><ul><li><a href="/a">A</a></ul></nav><!-- <p>gone</p> -->
<div class="cookie-notice">We use cookies</div><div id="sideBar">Side</div>
<article><header><h1>Title &eacute;&#x41;</h1></header><p><b>First &lt;b&gt;
  line<br>goes on.<p>Second&nbsp;one <a href="#">linked</a>.</p><div class="ad">Buy</div><form><p>Send</p></form>
<ul><li>one<li>two</ul><section class="comments"><p>Me first</p></section><footer>By me</footer></article>
<footer>&copy; x</footer>"""


def text_of(page):
    return "\n\n".join(H.main_text(*H.tokens(page), {}))


def test_article_of_a_page_with_everything_around():
    assert text_of(PAGE) == "Title éA\n\nFirst <b> line goes on.\n\nSecond one linked.\n\none\n\ntwo"


def test_pages_without_article_element():
    page = "<body><div class=menu><a>x</a></div><div><a href=1>only links here</a></div><div id=c><h2>Head</h2><p>Some text</p>loose</div><div class='footer'>f</div>"
    assert text_of(page) == "Head\n\nSome text\n\nloose"


def test_broken_pages():
    for page in ("", "   ", "<", "<p", "a < b", "<p>x</q></p", "<script>never closed", "<!-- never closed"):
        text_of(page)
    assert text_of("plain a < b") == "plain a < b"


def test_template_text_goes_and_articles_stay(spark):
    rows = [(i, f"https://h.example/{i}", f"<body><p>Top of all pages</p><div><p>Text number {i} stands here.</p></div><p>Bottom of all pages</p>", "x") for i in range(12)]
    rows += [(100, None, None, "x"), (101, "nonsense", "", "x"), (102, "http://other.example/", "<p>Top of all pages</p>", "x"), (102, "http://other.example/", "<p>Again</p>", "x")]
    out = {(r.page_id, r.text): r.n_chars for r in H.extract_digest(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()}
    want = {(i, f"Text number {i} stands here.") for i in range(12)} | {(100, ""), (101, ""), (102, "Top of all pages"), (102, "Again")}
    assert set(out) == want and all(len(t) == n for (_, t), n in out.items())


def plain_page(i, r, extra=""):
    """A page without any tell-tale tag or class: constant heads and feet, an article of its own, a constant line inside it."""
    words = lambda n: " ".join(f"w{r.randint(0, 5000)}" for _ in range(n))
    article = [words(6)] + [words(r.randint(8, 40)) for _ in range(r.randint(1, 5))]
    body = "".join(f"<div>{x}</div>" for x in article[:1]) + "<div>Read this first</div>" + "".join(f"<div>{x}</div>" for x in article[1:])
    return f"<html><body><div><div>The Daily Page</div><div>Weather and sport</div></div><section>{body}{extra}</section><div><div>All wrongs reversed</div></div></body></html>", article


def extracted(spark, rows):
    return {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_the_template_matters_without_tell_tale_names(spark):
    r = random.Random(1)
    made = [plain_page(i, r) for i in range(30)]
    out = extracted(spark, [(i, "http://h.example/x", page) for i, (page, _) in enumerate(made)])
    assert all(out[i] == "\n\n".join(article) for i, (_, article) in enumerate(made))
    bare = {i: "\n\n".join(H.main_text(*H.tokens(page), {})) for i, (page, _) in enumerate(made)}
    assert all(bare[i] != out[i] for i in bare)


def test_optional_parts_form_a_class_of_their_own(spark):
    r = random.Random(2)
    part = "<ul><li><p>Our shop sells cups</p></li></ul>"
    made = [plain_page(i, r, part if i % 2 else "") for i in range(30)]
    out = extracted(spark, [(i, "http://h.example/x", page) for i, (page, _) in enumerate(made)])
    assert all(out[i] == "\n\n".join(article) for i, (_, article) in enumerate(made))


def test_template_text_inside_articles_goes_and_copied_articles_stay(spark):
    r = random.Random(3)
    line = lambda n: " ".join(f"w{r.randint(0, 5000)}" for _ in range(n))
    copied = [line(9), line(20), line(30)]
    rows, want = [], {}
    for i in range(30):
        article = copied if i % 3 == 0 else [line(8), line(25)]
        nav = "".join(f"<li><a href=/>{line(1)}</a></li>" for _ in range(4))
        rows.append((i, "http://h.example/x", f"<body><nav><ul>{nav}</ul></nav><article><div>Written by our staff</div>{''.join(f'<p>{x}</p>' for x in article)}</article></body>"))
        want[i] = "\n\n".join(article)
    assert extracted(spark, rows) == want


def test_hosts_of_one_and_two_pages(spark):
    r = random.Random(4)
    (one, a), (two, b), (three, c) = (plain_page(i, r) for i in range(3))
    out = extracted(spark, [(1, "http://one.example/", one), (2, "http://two.example/a", two), (3, "http://two.example/b", three)])
    assert out[2] == "\n\n".join(b) and out[3] == "\n\n".join(c)
    assert out[1].startswith("The Daily Page") and all(x in out[1] for x in a)


def test_classes_in_another_order_or_crossing_are_not_valid():
    template = {1: (7, 0, 9, 3), 2: (7, 1, 9, 3), 3: (7, 2, 9, 3), 4: (8, 0, 5, 2), 5: (8, 1, 5, 2)}
    places = lambda *ids: sorted(H.of_template(np.array(ids), template))
    assert places(1, 9, 2, 3) == [0, 2, 3] and places(2, 1, 3) == [] and places(1, 2) == []
    assert places(1, 4, 9, 5, 2, 3) == [0, 1, 3, 4, 5] and places(1, 4, 2, 5, 3) == [0, 2, 4]
    assert places(1, 2, 3, 1, 2, 3) == [0, 1, 2, 3, 4, 5] and places(1, 2, 3, 1, 3, 2) == []


def test_very_long_pages(spark):
    page = "<article>" + "<p>" + "word " * 400000 + "</p>" + "<div>" * 3000 + "x" + "</article>"
    out = extracted(spark, [(1, "http://h.example/", page), (2, None, "<" * 50000)])
    assert len(out[1]) > 1_900_000


def test_empty_table(spark):
    assert H.extract_digest(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
