"""Page extraction on layouts outside the training templates, and its decoder against all labellings."""
import itertools

import numpy as np
import pytest

from surveykit.llm import html_extract

SAY = "Some words of an article that goes on and on, for a while at least."
NAV = '<nav><ul><li><a href=/>Home</a></li><li><a href=/x>More news</a></li></ul></nav>'
FOOT = "<footer>&copy; 2020 Somebody, all rights reserved</footer>"


def page(inner, body="body", article="article"):
    return f"<html><head><title>t</title></head><{body}>{NAV}<{article}>{inner}</{article.split()[0]}>{FOOT}</body></html>"


LONG = " ".join([SAY] * 3)
PAGES = {
    "letter": (page(f"<h1>A</h1><p>{LONG}</p>"), ["A", LONG]),
    "list": (page(f"<h1>Title</h1><p>{LONG}</p><ul><li>one<li>two words</ul><p>{SAY}</p>"), ["Title", LONG, "one", "two words", SAY]),
    "table": (page(f"<h1>Title</h1><p>{LONG}</p><table><tr><th>name<td>x<tr><td>1<td>2</table>"), ["Title", LONG, "name", "x", "1", "2"]),
    "quote": (page(f"<h1>Title</h1><p>{LONG}</p><blockquote>To be or not</blockquote><p>{SAY}</p>"), ["Title", LONG, "To be or not", SAY]),
    "pre": (page(f"<h1>Title</h1><p>{LONG}</p><pre>x  =\n1</pre><p>{SAY}</p>"), ["Title", LONG, "x = 1", SAY]),
    "caption": (page(f"<h1>Title</h1><figure><img src=a><figcaption>A view</figcaption></figure><p>{LONG}</p>"), ["Title", "A view", LONG]),
    "body class": (page(f"<h1>Title</h1><p>{LONG}</p>", body='body class="single post search-enabled"'), ["Title", LONG]),
    "odd class": (page(f'<h1>Title</h1><div class="contact-history"><p>{LONG}</p><p>{SAY}</p></div>'), ["Title", LONG, SAY]),
    "two short paragraphs": (f"<html><body>{NAV}<p>Two short words.</p><p>And more of it.</p></body></html>", ["Two short words.", "And more of it."]),
    "plain menu": ('<html><body><ul><li><a href="/">Home</a></li><li><a href="/a">About</a></li></ul><p>Two short words.</p>'
                   "<p>And more of it.</p></body></html>", ["Two short words.", "And more of it."]),
    "closed svg": (page(f'<h1>Title</h1><svg width="1"/><p>{LONG}</p><svg><title>no</title><text>no</text></svg><p>{SAY}</p>'), ["Title", LONG, SAY]),
    "open noscript": (page(f"<h1>Title</h1><noscript><p>{LONG}</p><p>{SAY}</p>"), ["Title", LONG, SAY]),
    "open head": (f"<html><head><title>t</title><h1>Title here</h1><p>{LONG}</p>", ["Title here", LONG]),
    "no marks": (f'<html><body><div id="menu">{NAV}</div><div class="ad"><p>Buy now cheap</p></div><div class="x"><h1>Title</h1><p>{LONG}</p>'
                 f"<ul><li>one</ul></div>{FOOT}</body></html>", ["Title", LONG, "one"]),
    "related and comments": (page(f'<h1>Title</h1><p>{LONG}</p><div class="related-articles"><ul><li><a href=a>Other one</a><li><a href=b>Other two</a></ul></div>'
                                  '<section id="comments"><div class="comment-body"><p>I liked it a lot really, yes.</p></div></section>'), ["Title", LONG]),
}


@pytest.fixture(scope="module")
def trees(spark):
    return html_extract.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


@pytest.mark.parametrize("name", PAGES)
def test_article_stays_whole(trees, name):
    source, want = PAGES[name]
    assert html_extract.main_text([source], trees)[0].split("\n") == want


def test_class_names():
    group = html_extract.group_of
    assert group("comment-list") == ("comment", True) and group("site-header wide") == ("head", True)
    assert group("contact-history") == (None, True) and group("ad-728x90")[1]
    assert group("main-content") == (None, False) and group("") == (None, False)


def test_string_ids_and_unclosed_elements(spark):
    df = spark.createDataFrame([(f"p{i}", "u", page(f"<h1>Title {i}</h1><p>{LONG}</p>")) for i in range(5)], "page_id string, url string, html string")
    trees = html_extract.train(df)
    assert {r.page_id: r.text for r in html_extract.extract(df, trees).collect()}["p3"] == f"Title 3\n{LONG}"
    text = lambda s: " ".join(html_extract.run_text(v) for v in html_extract.parse(s) if v.pieces is not None)
    assert text("<p>a<select>" * 20000 + "z").endswith("a z")
    assert text("a<script>b</script>c<style>d") == "a c" and text("x<title>y") == "x y" and text("<head>q</head>r") == "q r"


def test_decoding_is_the_likeliest_of_all_labellings():
    rng = np.random.default_rng(5)
    for _ in range(60):
        nodes = [html_extract.Node("html", None)]
        for _ in range(int(rng.integers(0, 10))):
            nodes.append(html_extract.Node("div", nodes[int(rng.integers(0, len(nodes)))]))
            nodes[-1].parent.children.append(nodes[-1])
        at = {id(v): i for i, v in enumerate(nodes)}
        odds = rng.normal(size=len(nodes)) * 2

        def value(kept, odds=odds):
            return sum(-np.logaddexp(0, -o if k else o) for k, o in zip(kept, odds))

        best = max(value((True, *kept)) for kept in itertools.product([False, True], repeat=len(nodes) - 1)
                   if all(not k or (True, *kept)[at[id(v.parent)]] for v, k in zip(nodes[1:], kept)))
        assert abs(value(html_extract.decode(nodes, odds)) - best) < 1e-9
