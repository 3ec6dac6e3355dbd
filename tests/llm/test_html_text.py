"""Main texts of pages, against an extraction by regular expressions on the pages' own template and against pages with known articles."""

import html
import random
import re

import pytest

from noticelake.llm import html_text

WORDS = "the wind turned over night and ships kept to their moorings until early light came through clouds".split()


def sentence(rng, least=8, most=40):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randrange(least, most))).capitalize() + "."


def article(rng):
    return [sentence(rng, 3, 8), *(rng.choice((sentence(rng), sentence(rng, 60, 120), "Yes.", sentence(rng))) for _ in range(rng.randrange(3, 12)))]


def pages(seed):
    """(page, main text) in several templates."""
    rng = random.Random(seed)
    lines = article(rng)
    body = f"<h1>{lines[0]}</h1>" + "".join(f"<p>{x}</p>" for x in lines[1:])
    loose = f"<h1>{lines[0]}" + "".join(f"<p><b>{x}<br>" for x in lines[1:])
    menu = "<ul>" + "".join(f'<li><a href="/{k}">{rng.choice(WORDS)}</a></li>' for k in range(9)) + "</ul>"
    comments = "".join(f'<li class="comment"><b>{rng.choice(WORDS)}</b> says <p>{sentence(rng)}</p></li>' for _ in range(4))
    ad = f'<div class="ad-slot">{sentence(rng)}</div>'
    aside = f"<aside><h3>More</h3><p>{sentence(rng)}</p><article class='teaser'><p>{sentence(rng)}</p></article></aside>"
    form = '<form action="/s"><label>Your mail</label><input name="m"><button>Join us now</button></form>'
    note = f'<div id="cookieNotice" role="dialog"><p>{sentence(rng)}</p><button>Fine</button></div>'
    head = '<!DOCTYPE html><html><head><title>A title</title><style>p{a:b}</style><script>var t="</p><p>no text</p>";</script></head>'
    foot = f"<footer><p>&copy; {sentence(rng)}</p></footer>"
    made = [
        f"{head}<body><nav>{menu}</nav><!-- ad -->{ad}<article>{body}</article>{foot}</body></html>",
        f"{head}<body><header>{menu}<p>{sentence(rng)}</p></header>{note}<main><article>{body}{ad}</article>{aside}<section id='comments'><ol>{comments}</ol></section></main>{foot}",
        f"{head}<body class='has-sidebar'><div class='menu'>{menu}</div><div id='page'><div class='entry-content'>{body}</div><div class='sidebar'><p>{sentence(rng)}</p></div></div><div class='footer'>{sentence(rng)}</div></body></html>",
        f"{head}<body>{form}<div class='post'>{body}</div><div class='comments-area'>{comments}</div>{foot}</body></html>",
        f"{head}<body><nav>{menu}</nav><article>{loose}</article>{foot}",
        f"{head}<body><nav>{menu}</nav>{body}{foot}</body></html>",
        f"{head}<body><form id='page'><nav>{menu}</nav><article><header><h1>{lines[0]}</h1></header>" + "".join(f"<p>{x}</p>" for x in lines[1:]) + f"<footer>{sentence(rng)}</footer></article></form></body>",
        f"{head}<body><div class='top'>{menu}</div><article>{body}<div class='share-links'>{menu}</div><article><p>{sentence(rng)}</p></article></article><noscript><p>{sentence(rng)}</p></noscript><!-- unended {sentence(rng)}",
    ]
    return [(page, "\n".join(lines)) for page in made]


@pytest.mark.parametrize("seed", range(60))
def test_articles_of_several_templates(seed):
    for k, (page, want) in enumerate(pages(seed)):
        assert html_text.main_text(page) == want, k


@pytest.mark.parametrize("name", ["cookiebanner", "siteFooter", "mainmenu", "ad-slot", "AdBox", "post-comments", "readercomments", "notice", "sidebar left", "newsletter_box", "search-form"])
def test_parts_by_name(name):
    text = "A long enough sentence that stands in the article and is read by many people. " * 3
    for page in (f"<body><article><p>{text}</p><div class='{name}'><p>{text}</p></div><p>End.</p></article>", f"<body><div class='story'><h1>Title</h1><p>{text}</p><p>End.</p></div><div id='{name}'><p>{text}</p></div>"):
        got = html_text.main_text(page).split("\n")
        assert got[-2:] == [text.strip(), "End."] and len(got) == 2 + ("Title" in got), page


def test_names_that_only_tell_of_others():
    text = "A long enough sentence that stands in the article and is read by many people."
    assert html_text.main_text(f"<body class='no-sidebar'><div class='page with-comments'><h1 class='header'>Title</h1><p class='additional'>{text}</p></div>") == f"Title\n{text}"


def test_references_space_and_breaks():
    page = "<article><h1>A&amp;B &lt;c&gt; &eacute;&#233;&#x20AC;</h1><p> one\n\ttwo&nbsp; <i>thr</i>ee<br>four </p>loose <b>text</b><ul><li>x<li>y</ul><pre>a\n  b</pre><p>5 < 6 &am</article>"
    assert html_text.main_text(page) == "A&B <c> éé€\none two three four\nloose text\nx\ny\na b\n5 < 6 &am"


def test_pages_without_a_main_text():
    for page in (None, "", " \n", "<nav><a>x</a></nav>", "<!-- x", "<script>var x", "<html><body></body></html>", "<p", "&"):
        assert html_text.main_text(page) == ("&" if page == "&" else "")


def test_smoothing_leaves_even_ratios_as_they_are():
    assert abs(html_text.smoothed(html_text.np.full(9, 7.0)) - 7).max() < 1e-12
    assert html_text.clusters(html_text.np.array([1.0, 1, 1, 90, 80, 0, 70, 1, 1, 1, 1])).tolist()[3:5] == [True, True]


def template_text(page):
    """The text of this page's article, for pages in the template of the given tables."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(b for b in blocks if b)


def test_given_pages_whole(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in html_text.extract_text(rows).collect()}
    for r in rows.collect():
        want = template_text(r.html)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_nulls_repeats_clashing_names_and_long_pages(spark):
    long = "<article>" + "".join(f"<p>word {k}" for k in range(60_000)) + "</article>"
    deep = "<div>" * 30_000 + "<article><p>deep</article>"
    rows = [(1, None, None), (None, "u", "<article><p>x</article>"), (1, "u", "<article><p>x</article>"), (1, "u", "<article><p>x</article>"), (2, "u", long), (3, "u", deep), (4, "u", "<b>" * 30_000)]
    frame = spark.createDataFrame([(*r, "t", 9, 8) for r in rows], "page_id long, url string, html string, text string, n_chars long, id long")
    got = sorted((r.page_id or 0, r.n_chars, r.text[:6]) for r in html_text.extract_text(frame).collect())
    assert got == [(0, 1, "x"), (1, 0, ""), (1, 1, "x"), (1, 1, "x"), (2, len("\n".join(f"word {k}" for k in range(60_000))), "word 0"), (3, 4, "deep"), (4, 0, "")]
    assert html_text.extract_text(frame.limit(0)).collect() == []
