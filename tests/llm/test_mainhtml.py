import html
import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ctxloom.llm import mainhtml as mh
from ctxloom.llm.queries import op10_block_tree_html

FULL = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "</p><p>no";</script></head><body class="page-with-sidebar">
<header><h1>Site</h1></header><nav><a href=/a>One</a> <a href='/b>c'>Two</a></nav><div id="cookie-notice">We use cookies to make it better</div>
<aside class=side><p>Popular this week are many things to read on the side</p></aside>
<article><h1>A &lt;title&gt;</h1><p>First &amp; only
   line with <a href="#">a link</a> and <b>bold</b> text.<p>Short.<ul><li>item one is here<li>item two is here</ul>
<div class="ad">Buy now</div><form><label>Mail</label><button>Send</button></form><!-- <p>hidden</p> -->
<div class="comments"><p>Great article, I liked every word of it and more</p></div><p>Last&nbsp;one.<br>After break</article>
<footer>&copy; 2024</footer><script>if (a < b) { x("<p>") }"""


def test_page():
    assert mh.main_text(FULL).split("\n") == ["A <title>", "First & only line with a link and bold text.", "Short.", "item one is here", "item two is here", "Last one.", "After break"]


def test_page_without_article_elements():
    para = "word " * 40
    page = f"<body><ul class=x><li><a>Home</a><li><a>News</a></ul><div><h2>Headline of the story</h2><p>{para}</p><p>{para}</p></div><div id=footer>all rights</div>"
    assert mh.main_text(page) == f"Headline of the story\n{para.strip()}\n{para.strip()}"


def test_markup_around_an_article_does_not_lose_it():
    body = "<article><h1>Title of it</h1><p>" + "word " * 30 + "</p></article>"
    want = "Title of it\n" + ("word " * 30).strip()
    for before in ("<datalist><option value=a><option value=b></datalist>", "<datalist><option value=a>A<option>B <b>bold</b>", "<datalist><option>A</option><option>B</option></datalist>", "<div class='layout has-sidebar'>", "<div class=search><div id=widgets><form>"):
        assert mh.main_text(f"<body>{before}{body}") == want, before
    for before in ("<div hidden>", "<div class=comments>", "<aside>", "<div class=related>", "<main><div class=sidebar>"):
        assert "Title of it" not in mh.main_text(f"<body>{before}{body}"), before
    math = "<article><p>Where <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x = 2 in source</annotation></math> holds for all of the values.</p></article>"
    assert mh.main_text(math) == "Where x=2 holds for all of the values."


WORDS = ("word " * 40).strip()


def test_word_counts_and_link_density_decide():
    """Root and most splits of the tree are numbers of words and link densities; no mark rejects a long link-free block."""
    assert mh.TREE.root[0] == 1
    for inside in (False, True):
        for weak in (False, True):
            x = mh.features([(60, 0, inside, False), (40, 0, inside, weak), (50, 0, inside, False), (9, 9, inside, weak)])
            assert mh.TREE.predict(x).tolist() == [True, True, True, False]


def test_pages_of_many_layouts():
    """Hand-written truth; most without an article element."""
    menu = "<ul class=x><li><a href=/>Home</a><li><a>News</a><li><a>About us</a></ul>"
    tail = "<div><a>Privacy</a> <a>Terms</a></div><div>Made by us</div>"
    pages = [
        (f'<div class="post"><p>{WORDS}</p><p>Short line.</p><p>{WORDS}</p></div>', [WORDS, "Short line.", WORDS]),
        (f'<div class="layout has-sidebar"><article><h1>T</h1><p>{WORDS}</p></article></div>', ["T", WORDS]),
        (f'<article><p title="the hidden gem">Some words.</p><p data-x=\'style="display:none"\'>{WORDS}</p></article>', ["Some words.", WORDS]),
        (f'<article><div class="entry-header"><h1>The headline</h1></div><p class="social">We met at the social club.</p><p>{WORDS}</p><p class="ad">Buy</p></article>', ["The headline", "We met at the social club.", WORDS]),
        ("<article><p>one <svg><text>t</text></svg>two <math><mi>x</mi></math> three<script>a</script> four</p></article>", ["one two x three four"]),
        (f"{menu}<div><h2>Headline of the story</h2><p>{WORDS}</p><p>{WORDS} <a>with a link</a></p></div>{tail}", ["Headline of the story", WORDS, f"{WORDS} with a link"]),
        (f"{menu}<table><tr><td><a>One</a><td>{WORDS}<br>{WORDS}</table>{tail}", [WORDS, WORDS]),
        (f"{menu}<div id=main><h1>A story told</h1>{WORDS}<br><br>And then<br><br>{WORDS}</div><div class=comments><p>{WORDS}</p></div>{tail}", ["A story told", WORDS, "And then", WORDS]),
        (f"<form><div class=header><h1>Site</h1></div>{menu}<main><h1>In a form</h1><p>{WORDS}</p></main></form>", ["In a form", WORDS]),
        (f"{menu}{tail}", []),
        (f"<article><p>First <span class=ad>buy</span>and <span>last</span>.<p>{WORDS}</article><aside><p>{WORDS}</p></aside>", ["First and last.", WORDS]),
        (f"<article class=comment><p>{WORDS}</p></article><article><p>Own text.</p></article>", ["Own text."]),
        (f"<article><p>It's <b title='a > b'>bold</b> &amp; \"x\"</p><p>{WORDS}</p><p cut=", ['It\'s bold & "x"', WORDS]),
    ]
    for page, want in pages:
        assert mh.main_text(f"<html><body>{page}").split("\n") == (want or [""]), page


def test_deep_and_long_pages_are_linear():
    began = time.time()
    assert mh.main_text("<div>" * 100_000 + f"<p>{WORDS}</p>" + "</span>" * 100_000 + "</div>" * 100_000) == WORDS
    mh.main_text("<p title='a\" b=\"'>" * 50_000 + "<a href=\"x" * 50_000)
    assert time.time() - began < 10
    assert len(mh.main_text("<article><p>" + "ab cd " * 2_000_000)) == 11_999_999


def test_tree_learns_its_table_and_held_out_pages():
    pages = mh.labelled_pages()
    x, y = mh.labelled_table()
    assert (mh.TREE.predict(x) == y).mean() > 0.95
    hits = []
    for k, (rows, truth) in enumerate(pages):
        fit = [p for j, p in enumerate(pages) if j != k]
        hits += (mh.DecisionTree().fit(np.concatenate([a for a, _ in fit]), np.concatenate([b for _, b in fit])).predict(rows) == truth).tolist()
    assert np.mean(hits) > 0.9


def test_generated_pages_without_their_article_element(spark):
    """What the tree finds by numbers alone, against what the element held."""
    lost = total = 0
    for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect():
        plain = mh.main_text(re.sub("<(/?)article>", r"<\1div>", r.html)).split("\n")
        blocks = mh.main_text(r.html).split("\n")
        assert set(plain) <= set(blocks) | {""}
        total += len(blocks)
        lost += sum(b not in plain for b in blocks)
    assert lost < 0.03 * total


@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='ad'>", "</div>", "<a href=x>", "</a>", "<", ">", "'", '"', "&amp;", "x y", "<script>", "</script>", "<!--", "-->", "<article>", "</article>", "\n"]), max_size=30).map("".join))
@settings(max_examples=300, deadline=None)
def test_any_markup_is_read(page):
    for line in mh.main_text(page).split("\n"):
        assert line == " ".join(line.split())


def test_query(spark):
    """On the generated pages the article element is the truth."""
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op10_block_tree_html(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search(r"<article>(.*?)(?:</article>|$)", pages[r.page_id].html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)\b[^>]*>", body)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_edge_rows(spark):
    rows = [(1, None, None), (2, "u", ""), (None, "v", "<article><p>" + "a b " * 200_000), (2, "u", ""), (3, "w", "plain text only")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = {(r.page_id, r.url): r.n_chars for r in mh.extract_main_text(df).collect()}
    assert got[(1, None)] == 0 and got[(2, "u")] == 0 and got[(None, "v")] == 799_999
    assert mh.extract_main_text(df.limit(0)).count() == 0
