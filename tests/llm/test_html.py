"""Main text against the known structure of pages and against hand-made ones."""

import html
import re

from verispark.llm.html_text import between_surge_and_dive, extract, main_text


def article_of(page):
    """What the plain pages of the given tables say, read by splitting at their tags."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<(?!/?(?:p|h\d)\b)[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h\d)>", body)]
    return "\n\n".join([b for b in blocks if b])


def test_pages_of_the_table(spark, sf):
    from verispark.llm.queries import op6
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op6(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == article_of(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


RICH = """<html><head><title>Drop &amp; this</title><script>if (a < b) document.write("<p>no</p>")</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><div class="cookieNotice">We use <b>cookies</b></div><ul id="top-menu"><li><a href=/>Home</a></li></ul>
<div class="content with-sidebar"><main><article><h1>Real&nbsp;title</h1><p class="lead">First &lt;para&gt;
 with	<i>white</i> space<!-- no --></p><p>x</p><div class="ad">Buy!<div>more</div></div><aside><p>one</p><p>two</p><p>three</p><p>four</p></aside>
<ul><li>item <a href="#">link</a><li>second</ul><p hidden>unseen</p><form><p>Sign up</p></form><style>p{}</style><p>Caf&eacute; &#8212; end</p>
<section id="comments"><h2>Comments</h2><article class="comment"><p>nice</p></article></section></article></main></div>
<div id="sidebar"><p>aside text</p></div><footer>foot</footer></body></html>"""


def test_rich_page():
    assert main_text(RICH) == "Real title\n\nFirst <para> with white space\n\nx\n\nitem link\n\nsecond\n\nCafé — end"


def test_page_without_article():
    words = "plain words that make up a paragraph of the story. " * 3
    page = (f"<body><div><a href=/a>Home</a></div><div><a href=/b>News</a></div><div><a href=/c>Sport</a></div><div><a href=/d>More</a></div>"
            f"<div>{words}</div><div>short</div><div>{words}</div><div><a>x</a></div><div><a>y</a></div><div><a>z</a></div><div>tiny</div></body>")
    assert main_text(page) == f"{words.strip()}\n\nshort\n\n{words.strip()}"


def test_interrupted_page_without_article():
    story = [f"Part {k} of the story, told in a sentence that is long enough to count. " * 2 for k in range(3)]
    links = "".join(f"<div><a href=/{k}>See also {k}</a></div>" for k in range(4))
    items = "".join(f"<div>item {k}</div>" for k in range(6))
    page = (f"<body><div><a href=/>Home</a></div><div>{story[0]}</div>{links}<div><a href=/h>A linked heading</a></div><div>{story[1]}</div>"
            f"<div class=ad>Buy!</div>{items}<div>{story[2]}</div><div><a href=/x>x</a></div></body>")
    assert main_text(page).split("\n\n") == [
        story[0].strip(), *[f"See also {k}" for k in range(4)], "A linked heading", story[1].strip(), *[f"item {k}" for k in range(6)], story[2].strip()]


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (None, "u", "<p>only text</p>"), (2, "u", "no markup at all &am &amp x"), (3, "u", "<nav>menu"), (4, "u", "<article><p>cut off &amp"),
            (5, "u", "<article>" + "<p>word</p>" * 30_000 + "</article>"), (6, "u", '<article><p title="a > b">quoted</p><p>a < b</p></article>'), (7, "u", "<script>x")]
    frame = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = [(r.page_id, r.text) for r in extract(frame).collect()]
    assert got[:4] == [(1, ""), (2, ""), (None, "only text"), (2, "no markup at all &am & x")]
    assert got[5] == (4, "cut off &") and got[6][1].count("word") == 30_000 and got[7] == (6, "quoted\n\na < b") and got[8] == (7, "")
    assert extract(frame.limit(0)).count() == 0


def test_broken_pages_take_time_in_proportion():
    import time
    for piece in ("<a ", "<nav>", "<div class=ad>", "<a \">", "<!-- <a", "<a b='\"><p>x", "</", "<![CDATA[", "<p>word", "<title", "&am", "<a \"<b>\"", "<article class=ad>"):
        start = time.perf_counter()
        main_text(piece * (1_000_000 // len(piece)))
        assert time.perf_counter() - start < 8, piece  # quadratic ones take minutes
    nested = "<div>" * 90_000 + "deep" + "</div>" * 90_000
    assert main_text(nested) == "deep"


def test_unclosed_quotes_end_at_the_next_bracket():
    assert main_text("<p>a<b x='>c</b> d</p><p>e</p>") == "ac d\n\ne"
    assert main_text("<p>one <!-- never closed <p>two") == "one"
    assert main_text("<a <!-- x") == "<a"


def test_the_distribution_decides_within_a_named_article():
    words = "a sentence that is long enough to be the story itself, and more of it. "
    strays = "".join(f"<div>{c}</div>" for c in "xyz")
    page = f"<body>{strays * 3}<article><p>{words}</p>{strays}<p>{words}</p></article>{strays * 3}</body>"
    assert main_text(page).split("\n\n")[2:-2] == [words.strip(), "x", "y", "z", words.strip()]
    # Without a surge outside, text beside the article stays out however the article is cut.
    assert "advert" not in main_text(f"<div>advert in the margin</div><div></div>{'<div>.</div>' * 4}<article><p>{words}</p></article>")


def test_surge_and_dive():
    assert between_surge_and_dive([0, 0, 5, 0, 7, 0, 0, 0, 9, 0], 0, True) == (2, 9)
    assert between_surge_and_dive([0, 0, 5, 0, 7, 0, 0, 0, 9, 0], 0, False) == (2, 5)
    assert between_surge_and_dive([], 0, True) == (0, 0)
