from __future__ import annotations

import html
import re

import numpy as np
from conftest import SF

from quayside.llm import html_extract, queries
from quayside.llm.html_extract import main_text


def test_page_parts():
    page = """<html><head><title>T</title><style>p{x:"</p>"}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a></ul></nav>
    <div id="cookie-notice">We use cookies.</div><script>var a = "<p>no</p>";</script>
    <article><header><h1>The  title &amp; more</h1></header><p>First <b>bold
    text</b> here.<p>Second &lt;one&gt; &eacute;<br>third line<!-- <p>gone</p> --><div class="ad">Buy!</div><ul><li>item a<li>item b</ul>
    <form><input value=x>Name</form><p>Last. </p><section class="comments"><p>I disagree with this at great length, says a reader.</p></section></article>
    <aside>Related stories of great length that nobody asked for, with many words in one line.</aside><footer>&copy; me</footer></body></html>"""
    assert main_text(page) == "The title & more\nFirst bold text here.\nSecond <one> é third line\nitem a\nitem b\nLast."


def test_without_marked_article():
    page = "<div class=menu><a href=1>one</a></div>" + "<p>short</p>" + "<p><a href=2>all of this line is one long link to elsewhere</a></p>" * 4
    page += "".join(f"<p>Paragraph {k} has a good deal of text in it.</p>" for k in range(5)) + "<p>End.</p><div class='sidebar'>x</div>" * 1
    assert main_text(page) == "\n".join([*(f"Paragraph {k} has a good deal of text in it." for k in range(5)), "End."])


def test_odd_pages(spark):
    assert [main_text(x) for x in (None, "", "<", "plain text", "<p>a", "</p></div>a<", "a &am b &amp", "<nav>x</nav>", "<p>x<nav>y</p>z</nav>w")] == [
        "", "", "<", "plain text", "a", "a<", "a &am b &", "", "x\nw"]
    long = "<p>" + "word " * 200_000 + "</p>" + "<p>tail</p>" * 20_000
    assert len(main_text(long)) == 5 * 200_000 - 1 + 20_000 * 5
    assert html_extract.stretches(np.array([0, 5, 0, 0, 0, 4, 0, 0, 3])) == [(1, 2), (5, 9)]
    df = spark.createDataFrame([(1, None, None), (1, None, None), (None, "u", "<p>a")], "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    assert sorted((r.text, r.n_chars) for r in html_extract.extract(df).collect()) == [("", 0), ("", 0), ("a", 1)]
    assert html_extract.extract(df.where("false")).collect() == []


PROSE = [f"Paragraph {k} has a good deal of text in it, as paragraphs of articles have." for k in range(8)]
LIST = "<ul class=related>" + "<li>One of the others to read</li>" * 5 + "</ul>"


def paragraphs(texts):
    return "".join(f"<p>{x}</p>" for x in texts)


def test_stretches_decide_pages_with_an_article():
    teaser = "<article><p>A short card.</p></article>"
    assert main_text(f"{teaser}{LIST}<div>{paragraphs(PROSE)}</div>") == "\n".join(PROSE)
    assert main_text(f"<article>{paragraphs(PROSE)}{LIST}<p>Up</p></article>{LIST}<p>{PROSE[0]}</p>") == "\n".join([*PROSE, "Up"])
    assert main_text(f"<p>{PROSE[7]}</p><article>{paragraphs(PROSE[:4])}{LIST}{paragraphs(PROSE[4:6])}</article>") == "\n".join(PROSE[:6])


def test_list_inside_the_text():
    page = f"<p>Hi</p>{LIST}{paragraphs(PROSE[:5])}{LIST}{paragraphs(PROSE[5:])}{LIST}<p>Bye</p>"
    assert main_text(page) == "\n".join(PROSE)


def test_names_around_an_article():
    text = "\n".join(PROSE)
    for name in ("layout with-sidebar", "has-comments", "sidebar", "header", "related", "share"):
        assert main_text(f'<div class="{name}"><article>{paragraphs(PROSE)}</article></div>') == text
    assert main_text(f"<form id=all><main>{paragraphs(PROSE)}</main></form>") == text
    for name in ("entry-header", "header"):
        page = f'<article><header class="{name}"><h1>The title</h1></header>{paragraphs(PROSE)}</article><div class="related"><article>Card</article></div>'
        assert main_text(page) == f"The title\n{text}"
    for element in ("aside", "nav", "div hidden"):
        assert main_text(f"<{element}><article>{paragraphs(PROSE)}</article></{element.split()[0]}>") == ""


def test_links_inside_an_article():
    page = f"<p><a href=1>{PROSE[0]}</a></p><article><p>{PROSE[1]}</p><p><a href=2>{PROSE[2]}</a></p><p>{PROSE[3]}</p></article>"
    assert main_text(page) == "\n".join(PROSE[1:4])


def test_article_text_stays():
    """All of the main article is text, unless its element is named, as a whole, as something else."""
    text = "\n".join(PROSE)
    for name in ("price-alert", "privacy-law", "social-history", "ads-and-politics", "share-prices", "notice-of-motion"):
        assert main_text(f'<article>{paragraphs(PROSE)}<p class="{name}">Real text.</p></article>') == f"{text}\nReal text."
    for name in ("ad", "ad-box", "notice", "cookie-notice", "newsletter signup", "comments", "comment-list", "social_share", "advertisement"):
        assert main_text(f'<article>{paragraphs(PROSE)}<p class="{name}">Real text.</p></article>') == text
        assert main_text(f'<article>{paragraphs(PROSE)}<p id="{name.split()[0]}">Real text.</p></article>') == text
    related = "<ul class=related>" + "<li><a href=x>One of the others</a></li>" * 4 + "</ul>"
    assert main_text(f"<article>{paragraphs(PROSE)}{related}<p>End.</p></article>") == f"{text}\nEnd."
    adverts = "<div class=ad>Buy</div>" * 3
    assert main_text(f"<article>{paragraphs(PROSE)}{adverts}<h2>Ok</h2></article>") == f"{text}\nOk"
    assert main_text(f"<main>{paragraphs(PROSE)}{adverts}<h2>Ok</h2></main>") == f"{text}\nOk"
    # cards beside the article, in one main area
    cards = f"{related}<article><p>Card</p></article>"
    assert main_text(f"<main><article>{paragraphs(PROSE)}{adverts}<p>End.</p></article>{cards}</main>") == f"{text}\nEnd."
    assert main_text("<article><p>One<br>two<br/>\n three</p><p>four</p></article>") == "One two three\nfour"


def test_query(spark):
    """The pages have one form, so that a plain pattern can tell what stands in the article. Line breaks end blocks there."""
    raw = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op4_line_blocks(spark, SF).collect()
    assert {r.page_id for r in rows} == raw.keys() and len(rows) == len(raw)
    for r in rows:
        article = re.search("<article>(.*)</article>", raw[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?p>|</?h1>|</?div[^>]*>", article)]
        assert r.text == "\n".join(x for x in blocks if x) and r.n_chars == len(r.text)
