import html
import re
import time
import tracemalloc

import numpy as np
import pytest

from pitflow.llm import extraction, queries
from pitflow.llm.pages import blocks_of

SF = "/root/testdata/sf0.01"


def article_text(page):
    """The article by its own element, as the test pages have one each."""
    inside = page[page.index("<article>") : page.index("</article>")]
    inside = re.sub(r"</?(p|h1|article)>", "\0", re.sub("<br>", " ", inside))
    parts = (" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in inside.split("\0"))
    return "\n\n".join(p for p in parts if p)


def test_pages_against_their_articles(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op5_html(spark, SF).collect()
    assert len(got) == len(pages)
    wrong = [r.page_id for r in got if r.text != article_text(pages[r.page_id])]
    assert not wrong
    assert all(r.n_chars == len(r.text) for r in got)


@pytest.fixture(scope="module")
def network(spark):
    return extraction.learn(spark.read.parquet(f"{SF}/pages.parquet"))


PAGE = """<!DOCTYPE html><html><head><title>Title</title><script>if (a < b) {}</script></head><body>
<div id="cookie-notice">We use cookies. <button>Accept</button></div>
<header class="site-header"><a href="/">Home</a><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav></header>
<main><article><h1>News &amp; more</h1>
<p>First   paragraph&nbsp;with <b>bold
text</b>.<p>Second one.
<aside class="related">Read also this</aside></article></main>
<div class="sidebar"><p>Most read today.</p></div>
<section id="comments"><h3>Comments</h3><p>Great article, thank you.</p></section>
<form action="/s"><label>Search</label><input name="q"></form>
<footer>&copy; 2024 Someone</footer></body></html>"""


def test_parts_of_a_page(network):
    assert extraction.main_texts(network, [PAGE]) == [
        "News & more\n\nFirst paragraph with bold text.\n\nSecond one."
    ]


def test_blocks(network):
    texts = [b.text for b in blocks_of(PAGE)]
    assert "Accept" in texts and "Second one." in texts and not any("a < b" in t for t in texts)
    assert [b.text for b in blocks_of("1 &lt; 2<!-- <p>no --> and<br>3 < 4 <p title='a>b'>x<li>y")] == [
        "1 < 2 and 3 < 4", "x", "y",
    ]
    assert blocks_of(None) == [] and blocks_of("<script>never closed") == [] and blocks_of("<p></p>") == []


def test_text_of_formulas_and_drawings_stays_in_the_block():
    page = (
        "<p>Thus <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds, see "
        "<svg viewBox='0 0 9 9'><style>a{}</style><text>Figure 1</text><path d='M0'/></svg> there.</p>"
    )
    assert [b.text for b in blocks_of(page)] == ["Thus x=2 holds, see Figure 1 there."]


def test_context_decides_blocks_that_look_alike(network):
    r = network.p["Uf"]
    assert np.abs(r).max() > 0.1  # recurrent weights are in use
    rows = [extraction.features(blocks_of(p)) for p in (PAGE, "<p>Only this.</p>", PAGE * 3)]
    together = network.label(rows)
    assert [t.tolist() for t in together] == [network.label([x])[0].tolist() for x in rows]


def test_gradient(network):
    r = np.random.default_rng(0)
    net = extraction.BiLSTM(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rows = [r.random((n, extraction.INPUT)).astype(np.float32) * 0.2 for n in (5, 3)]
    truth = [np.array([1, 0, 1, 1, 0.0]), np.array([0, 1, 0.0])]

    def loss():
        logit, (_, mask, *_) = net.outputs(rows)
        y = np.zeros_like(logit)
        for k, t in enumerate(truth):
            y[k, : len(t)] = t
        return float(((np.logaddexp(0, logit) - y * logit) * mask).sum() / mask.sum())

    before = loss()
    net.fit(rows, truth, epochs=30)
    assert loss() < before / 2


def test_odd_pages(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "v", "<p>" + "word " * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "1 AS text", "2 AS n_chars", "3 AS h"
    )
    got = extraction.extract_pages(pages).collect()
    assert len(got) == len(rows)
    by_url = {(r.page_id, r.url): r for r in got}
    assert by_url[(2, None)].text == "" and by_url[(3, "u")].n_chars == 0
    assert by_url[(1, "u")].text.startswith("News & more")
    assert extraction.extract_pages(pages.where("false")).count() == 0


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ('<p title="5" tall">abc', ["abc"]),
        ('<a href="x"">abc</a>', ["abc"]),
        ("<b title='x>abc", ["abc"]),
        ("<b title='x>abc</b> <i title=\"y>d", ["abc d"]),
        ("<div class='a'b'>abc", ["abc"]),
        ("abc <a href=\"foo", ["abc"]),
        ("abc <a href=foo", ["abc"]),
        ("abc <p", ["abc"]),
        ("abc </p", ["abc"]),
        ("1 < 2 <3 a<b> c </ d> e <", ["1 < 2 <3 a c e <"]),
        ("<p a = 'x>y' b=>one<p/ >two", ["one", "two"]),
        ("a<!-->b<!--->c<!-- x --!>d<!-- never closed <p>e", ["abcd"]),
        ("a<?php echo 1 ?>b<!doctype html>c", ["abc"]),
        ("<SCRIPT>if (a</scripts) <p></SCRIPT >a<style>p{}</STYLE>b", ["ab"]),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>d<p>e<p>f<div>g</p>h</div>", ["a", "b", "c", "d", "e", "f", "g", "h"]),
        ("<table><tr><td>a<td>b<tr><th>c</table>", ["a", "b", "c"]),
    ],
)
def test_tags_leave_no_markup_and_take_no_text(page, texts):
    assert [b.text for b in blocks_of(page)] == texts


def test_names_of_a_path():
    (block,) = blocks_of("<DIV Class='mainText' data-id=no id=top><span class=x><p role=note>text")
    assert sorted(block.element.path()) == sorted(
        ["tag div", "is main", "is text", "is top", "tag p", "is note"]
    ) and block.leaf == "leaf p"


@pytest.mark.parametrize(
    "piece",
    ['<a "x ', "<a b='x ", "<div>x", "<p>x", "<li>x<div>", "</div>x<div><div>", "<!--", "<!-- -->", "<a b=\"'>", "<script>", "< ", "<div a='", "&amp;<b>", "<td>x<table>x", "<div class=k>"],
)
def test_time_and_memory_grow_with_the_page_alone(piece):
    def measured(size):
        tracemalloc.start()
        start = time.process_time()
        blocks_of(piece * (size // len(piece)))
        seconds, (_, peak) = time.process_time() - start, tracemalloc.get_traced_memory()
        tracemalloc.stop()
        return seconds, peak

    seconds, peak = measured(1_000_000)
    small, _ = measured(125_000)
    assert peak < 300e6 and (seconds < 5 or seconds < 16 * small)


def test_long_page_is_labelled_as_a_whole(network, monkeypatch):
    blocks = blocks_of(PAGE * 40)
    whole = network.label([extraction.features(blocks)])[0]
    monkeypatch.setattr(extraction, "LABEL_BLOCKS", 50)
    assert len(blocks) > 400 and network.label_page(blocks).tolist() == whole.tolist()
    assert extraction.main_texts(network, [PAGE * 40, PAGE])[1].startswith("News & more")


def test_deeply_nested_elements(network):
    deep = "<div>x" * 20_000
    (text,) = extraction.main_texts(network, [deep])
    assert set(text) <= {"x", "\n"}
    assert len(extraction.main_texts(network, ["<div>" * 100_000 + "<p>" + "A sentence. " * 50])[0]) >= 0
