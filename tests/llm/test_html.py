import itertools
import random

import pytest

from notegraph.llm import html_extraction as h

PAGE = """<html><body class="has-sidebar"><header><h1>Site name</h1><a href=/>home</a></header><nav><a>x</a></nav>
<div class="cookie-notice">We use cookies. Please accept them all now.</div>
<main><article><header><h1>Real  title</h1></header><p>First para of text, with <a href=x>link</a>
 and more text&nbsp;here &amp; there.</p><p>Short.</p><aside><p>Related: read this other story about stuff.</p></aside>
<ul><li>one item<li>two items</ul><script>var t="</p>";</script><p>Last para of the article is here.</article>
<section id="comments"><h2>Comments</h2><p>Great article, I loved it very much, thank you for it.</p></section>
<form><label>Name</label><input><button>Send</button></form></main><footer>&copy; 2020 Site</footer></body></html>"""


def test_page():
    assert h.main_text(PAGE).split("\n\n") == [
        "Real title", "First para of text, with link and more text here & there.", "Short.", "one item", "two items", "Last para of the article is here.",
    ]


@pytest.mark.parametrize("page", ["", "no tags at all", "<", "<p", "<!-- never closed", "<script>x", '<a href="never', "</p></div>", "<p><b>x<p>y", "<" * 5000, "<a " * 3000, "&amp;&am"])
def test_broken_pages(page):
    assert isinstance(h.main_text(page), str)


def test_nothing_is_cut_from_long_pages():
    paras = [f"Paragraph number {i} has some words in it." for i in range(3000)]
    page = "<article>" + "".join(f"<p>{p}</p>" for p in paras) + "</article>"
    assert h.main_text(page) == "\n\n".join(paras)


def energy(odds, near, label):
    cost = sum(-o if x and o < 0 else o if not x and o > 0 else 0.0 for o, x in zip(odds, label, strict=True))
    return cost + sum(w for i, e in enumerate(near) for j, w in e.items() if i < j and label[i] != label[j])


@pytest.mark.parametrize("seed", range(60))
def test_min_cut_is_the_cheapest_labelling(seed):
    r = random.Random(seed)
    n = r.randint(1, 9)
    odds = [r.uniform(-1, 1) for _ in range(n)]
    near = [{} for _ in range(n)]
    for i, j in itertools.combinations(range(n), 2):
        if r.random() < 0.5:
            near[i][j] = near[j][i] = r.uniform(0, 1)
    got = h.min_cut(odds, near)
    best = min(energy(odds, near, x) for x in itertools.product([False, True], repeat=n))
    assert energy(odds, near, got) == pytest.approx(best)


def test_query(spark):
    rows = [(1, "u", PAGE), (2, None, None), (None, "u", "")]
    got = {x.page_id: x for x in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].n_chars == len(got[1].text) > 50
    assert (got[2].text, got[2].n_chars, got[2].url) == ("", 0, None) and got[None].text == ""


P1 = "This is the first long paragraph of the article, which goes on for quite some time so that it is prose beyond doubt. It has two sentences."
P2 = "The second long paragraph follows here, and it also goes on at some length about the matter at hand, as articles are wont to do."
MAIN = f"<h1>The title</h1><p>{P1}</p><p>{P2}</p>"
NAV = "<nav><a href=/>Home</a> <a href=/a>About</a></nav>"
FOOT = "<footer><p>Copyright 2020 Example. All rights reserved by the owners of this site.</p></footer>"
SIDE = '<div class="sidebar"><h3>Popular</h3><ul><li><a href=x>One story</a></li><li><a href=y>Another story</a></li></ul></div>'
COMMENTS = (
    '<section class="comments"><h2>Comments</h2><div class="comment"><p>I liked this article very much and will read it again some day soon.</p></div>'
    '<div class="comment"><p>Not so sure about that, the second paragraph is rather wrong in my view of it.</p></div></section>'
)
SIGNUP = '<div class="newsletter-signup"><p>Sign up for our newsletter and never miss a story again.</p><input><button>Go</button></div>'
TEASERS = (
    '<aside class="related"><article><h3>Other</h3><p>Teaser text of another article that one may read later on.</p></article>'
    "<article><p>Second teaser text of another article that one may read too.</p></article></aside>"
)
TEMPLATES = {
    "has sidebar": f'{NAV}<div class="layout has-sidebar"><article>{MAIN}</article>{SIDE}</div>{FOOT}',
    "has sidebar, no article": f'{NAV}<div class="layout has-sidebar"><div class="content">{MAIN}</div>{SIDE}{COMMENTS}</div>{FOOT}',
    "with sidebar": f'{NAV}<div class="content with-sidebar">{MAIN}{SIDE}</div>{FOOT}',
    "names of the page": f'<div id="page" class="sticky-header no-footer">{NAV}{MAIN}{FOOT}</div>',
    "legal analysis": f'{NAV}<article><div class="legal-notice-analysis">{MAIN}</div></article>{FOOT}',
    "comment free": f'{NAV}<article><div class="comment-free">{MAIN}</div></article>{FOOT}',
    "form round a page": f"<form action=x>{NAV}<div class=main>{MAIN}</div>{SIDE}<label>Search</label><input name=q>{FOOT}</form>",
    "form round an article": f"<form action=x>{NAV}<article>{MAIN}</article>{SIDE}{COMMENTS}{FOOT}</form>",
    **{f"unclosed {tag}": f"{NAV}<article><{tag} x=y>{MAIN}</article>{FOOT}" for tag in ("svg", "video", "object", "canvas", "template", "math", "audio")},
    "nested svg": f"{NAV}<article><h1>The title</h1><svg><svg><text>inner leak</text></svg><text>outer leak</text></svg><p>{P1}</p><p>{P2}</p></article>{FOOT}",
    "video": f"{NAV}<article><h1>The title</h1><video><p>Your browser does not support the video tag, please upgrade.</p></video><p>{P1}</p><p>{P2}</p></article>{FOOT}",
    "many comments": f"{NAV}<article>{MAIN}</article>{COMMENTS * 6}{FOOT}",
    "comments, no article": f"{NAV}<div id=wrap><div class=post>{MAIN}</div>{COMMENTS * 3}</div>{FOOT}",
    "aside inside": f"{NAV}<main>{MAIN}<aside><p>Related: read this other story about stuff that matters to you.</p></aside></main>{FOOT}",
    "teasers": f"{NAV}<main>{MAIN}</main>{TEASERS}{FOOT}",
    "table layout": f"<table><tr><td><a href=x>Home</a><br><a href=y>News</a></td><td>{MAIN}</td></tr></table>{FOOT}",
    "paywall": f'{NAV}<div class="paywall-content">{MAIN}</div>{FOOT}',
    "shown by a script": f'{NAV}<div style="display:none">{MAIN}</div>{FOOT}',
    "cookies": f'<div class="cookie-banner"><p>We use cookies to improve your experience on this site. Accept them all now please.</p><button>OK</button></div><div>{MAIN}</div>{FOOT}',
    "sign-up": f"{NAV}<div class=story>{MAIN}{SIGNUP}</div>{FOOT}",
    "related list": f'{NAV}<div class="post-body">{MAIN}<div class="related-posts"><h3>Related</h3><ul><li><a href=a>Other thing</a></li></ul></div></div>{FOOT}',
    "promotion": f'<div class="promo-page">{NAV}<div>{MAIN}</div></div>{FOOT}',
    "widget": f'{NAV}<div class="widget-area"><div class="text">{MAIN}</div></div>{FOOT}',
    "upper case": f"{NAV}<ARTICLE><H1>The title</H1><P>{P1}<P>{P2}</ARTICLE>{FOOT}",
    "breadcrumbs": f'<header class="site-header"><a href=/>Site</a></header><ol class="breadcrumb"><li><a href=/a>A</a><li>B</ol><main>{MAIN}</main>{FOOT}',
    "adverts between": f'{NAV}<article><h1>The title</h1><p>{P1}</p><div class="ad-slot"><p>Buy this fine product today and be happy for ever after.</p></div><p>{P2}</p></article>{FOOT}',
}


@pytest.mark.parametrize("name", TEMPLATES)
@pytest.mark.parametrize("body", ["<body>", '<body class="has-sidebar promo">', ""])
def test_templates(name, body):
    assert h.main_text(f"<!DOCTYPE html><html><head><title>T</title></head>{body}{TEMPLATES[name]}").split("\n\n") == ["The title", P1, P2]


def test_a_small_article_beside_a_large_footer():
    foot = "<footer>" + f"<p>{P2}</p>" * 6 + "</footer>"
    assert h.main_text(f"<body>{NAV}<article><h1>Hi</h1><p>A short article of a few words.</p></article>{foot}</body>") == "Hi\n\nA short article of a few words."


def test_formulas_are_part_of_a_sentence():
    page = f"<article><p>We know that <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> is positive, as is well known.</p><p>{P1}</p></article>"
    assert h.main_text(page) == f"We know that x=1 is positive, as is well known.\n\n{P1}"


@pytest.mark.parametrize("page", ["<form>" * 20_000 + "x" * 300 + ". ", "<div>" * 20_000 + "</p>" * 20_000, "<div class=sidebar><p>" * 5000 + ("word " * 80 + ".<p>") * 500, "<svg>" * 20_000, "<p>a" * 20_000 + "</svg>" * 20_000])
def test_odd_pages_take_no_long(page):
    h.main_text(page)


def test_repeated_and_long_rows(spark):
    long = "<article>" + f"<p>{P1}</p>" * 8000 + "</article>"
    rows = [(1, "u", PAGE)] * 3 + [(2, "u", long), (None, None, None)]
    got = h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((x.page_id or 0, x.n_chars) for x in got) == sorted([(1, len(h.main_text(PAGE)))] * 3 + [(2, 8000 * len(P1) + 7999 * 2), (0, 0)])
