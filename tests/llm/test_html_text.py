import itertools
import random

import pytest

from coverlake.llm import html_text as H


def test_minimum_cut_matches_enumeration():
    rng = random.Random(3)
    for _ in range(150):
        n = rng.randint(1, 9)
        gain = [round(rng.uniform(-3, 3), 2) for _ in range(n)]
        edges = [(a, b, round(rng.uniform(0, 2), 2)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.4]

        def cost(keep):
            return sum(max(0, g) if not k else max(0, -g) for g, k in zip(gain, keep)) + sum(c for a, b, c in edges if keep[a] != keep[b])

        assert cost(H.minimum_cut(gain, edges)) == pytest.approx(min(map(cost, itertools.product((False, True), repeat=n))), abs=1e-6)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body class="with-sidebar">
<header><a href="/">Site name</a></header><nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav>
<div id="cookie-notice"><p>We use cookies to make this site better for you and for others who come here.</p></div>
<div class="page"><div class="post-content"><h1>The title</h1>
<p>First&nbsp;paragraph,   with <b>bold</b> words &amp; an <a href=x>inline link</a> that goes on for long enough.<br>After a break.
<p>Second &eacute;t&#233; one, not closed, with a good number of words in it.
<div class="ad">Buy now! The best offer of the whole year is here for you.</div>
<ul><li>an item of the article</ul>
<div class="share"><a>Tweet</a> <a>Mail</a></div></div>
<div class="sidebar"><h3>Popular</h3><p>A long sentence about something else that stands in the sidebar of the page.</p></div>
<section id="comments"><h3>2 comments</h3><article class="comment"><p>I agree with all that this article says about these things, truly.</p></article></section></div>
<form><p>Subscribe to our letters to get more of this every week.</p><textarea>typed</textarea><select><option>one</select></form>
<p hidden>not shown</p><footer><p>&copy; 2020 Site name. All rights are reserved by the owner of this page.</p></footer>"""


def test_article_only():
    assert H.main_text(PAGE).split("\n\n") == [
        "The title", "First paragraph, with bold words & an inline link that goes on for long enough. After a break.",
        "Second été one, not closed, with a good number of words in it.", "an item of the article"]


@pytest.mark.parametrize("html", [None, "", " ", "<", "<p", "&am", "<script>x", "</div></p>", "<!-- open", "<p hidden>x", "<br><hr><img>"])
def test_broken_pages_have_no_text(html):
    assert H.main_text(html) in ("", "<", "&am")


def test_a_page_without_landmarks():
    text = "A paragraph of a plain page with enough words in it to look like prose."
    assert H.main_text(f"<p>{text}<p>{text}") == f"{text}\n\n{text}"


@pytest.mark.parametrize("start", [
    "<html><head><meta charset=utf-8><title>T</title><style>p{}</style><body>", "<head><title>T</title><script>var a;</script>",
    "<head><title>T</title><noscript><style>p{}</style><body>", "<div><select><option>one<option>two</div>", "<div><object><param name=a></div>",
    "<div><noscript><p>Turn it on.</div>", "<ul><li><canvas>none<li hidden>not shown</ul>", "<select><option>one<option>two", "<object><param name=a>",
    "<div><span hidden>not shown</div>", "<p hidden>not shown", "<div><p><svg><title>T</title></div>"])
def test_text_after_an_element_without_an_end(start):
    text = "A paragraph of a plain page with enough words in it to look like prose."
    assert H.main_text(f"{start}<p>{text}</p><p>{text}</p>") == f"{text}\n\n{text}"


def test_silent_elements_with_an_end_stay_silent():
    text = "A paragraph of a plain page with enough words in it to look like prose."
    inside = "<noscript><div><p>{0}</div></noscript><select><option>one<option>two</select><object><p>{0}</p><div>{0}</object><canvas><ul><li>{0}</ul></canvas>".format(text)
    assert H.main_text(f"<head><title>T</title></head><body><p>{text}</p>{inside}<p>{text}</p><textarea>{text}") == f"{text}\n\n{text}"


def test_forms_around_and_inside_an_article():
    text = "Words of a paragraph that is long enough to be content by itself, surely."
    page = f"<form id=f1><div class=top>Site</div><article><header><h1>Head</h1></header><p>{text}<form><p>{text} Subscribe.</p></form></article></form>"
    assert H.main_text(page) == f"Head\n\n{text}"
    assert H.main_text(f"<main><p>{text}</p><div class='comments'><p>{text}</p></div><aside><p>{text}</p></aside></main>") == text


def test_long_pages():
    text = "Words of a paragraph that is long enough to be content by itself, surely."
    blocks = [f"<p>{text}</p>", "<ul><li><a>link</a></li></ul>"] * 3000
    assert H.main_text("<article>" + "".join(blocks) + "</article>").count(text) == 3000
    assert len(H.main_text("<article><p>" + "word " * 400_000 + "</article>")) == 2_000_000 - 1


def test_frames(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as text", "2 as blocks")
    out = H.extract_text(df).collect()
    assert len(out) == 4 and sorted(r.n_chars for r in out) == sorted([0, 0] + [len(H.main_text(PAGE))] * 2)
    assert H.extract_text(df.limit(0)).count() == 0
    labels = H.label_blocks(df).filter("page_id = 1").first().blocks
    assert "\n\n".join(b.text for b in labels if b.content) == H.main_text(PAGE)


def test_query_matches_the_article_elements(spark):
    import html
    import re

    from tests.conftest import SF_SMALL
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}
    out = H.q_html_text(spark, SF_SMALL).collect()
    assert len(out) == len(pages)
    for r in out:
        inner = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


@pytest.mark.parametrize("opening", ['<section id="discussion">', '<section id="privacy">', '<div class="legal-history">', '<div class="banner-image">',
                                     '<div class="social">', '<div class="replies-study">', '<div id="top" class="notice">'])
def test_a_name_does_not_veto_the_prose_of_an_article(opening):
    text = "Words of a paragraph that is long enough to be content by itself, surely."
    close = "</section>" if opening.startswith("<section") else "</div>"
    page = f"<article><h1>Head</h1><p>{text}</p>{opening}<h2>A part</h2><p>{text}</p><ul><li><a>Tweet</a></li><li><a>Mail</a></li></ul>{close}<p>{text}</p></article>"
    got = H.main_text(page).split("\n\n")
    assert got.count(text) == 3 and "Tweet" not in got and "Mail" not in got
    assert H.main_text(f"<p>{text}</p>{opening}<p>{text}</p>{close}<p>{text}</p>") == f"{text}\n\n{text}"      # outside an article it does


@pytest.mark.parametrize("name", ["comments", "comment-list", "replies", "responses", "ad", "ad-slot", "share-buttons", "newsletter", "related-posts", "cookie-notice", "sidebar"])
def test_other_names_still_do(name):
    text = "Words of a paragraph that is long enough to be content by itself, surely."
    assert H.main_text(f'<article><p>{text}</p><div class="{name}"><p>{text} Not this one.</p></div></article>') == text


def test_the_cut_overrules_single_blocks():
    """A bare short line between paragraphs of one element stays with them, one among links goes with those."""
    text = "Words of a paragraph that is long enough to be content by itself, surely."
    page = f"<div><p>{text}</p><div>so be it</div><p>{text}</p></div>"
    labels = {t: (keep, odds) for t, keep, odds in H.label_page(page)}
    assert labels["so be it"][0] and labels["so be it"][1] < 0
    links = "<div><a>One</a></div><div><a>Two</a></div>"
    labels = {t: (keep, odds) for t, keep, odds in H.label_page(f"<div>{links}<p>Go on.</p>{links}</div>")}
    assert not labels["Go on."][0] and labels["Go on."][1] > 0
