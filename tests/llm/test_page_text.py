import numpy as np
import pytest

from loomrank.llm import page_text
from loomrank.llm.page_text import Trees, labelled_pages, sum_product, texts, train


@pytest.fixture(scope="module")
def model():
    return train(*labelled_pages())


def test_held_out_pages(model):
    pages, content = labelled_pages(120, seed=901)
    trees = Trees()
    for i, p in enumerate(pages):
        trees.add(i, p)
    marginal, _ = sum_product(trees.arrays(), model)
    right = sum((marginal[n] >= 0.5) == (t in content[p]) for p, n, t in trees.texts)
    assert right >= 0.98 * len(trees.texts)


def test_sum_product_is_exact(model):
    trees = Trees()
    trees.add(0, "<div><p>one two three.</p><ul><li>a</li></ul></div>")
    nodes = trees.arrays()
    n = len(nodes.parent)
    own = np.bincount(nodes.node, weights=model.weights[nodes.feature], minlength=n)
    total = np.zeros((n, 2))
    for state in np.ndindex(*[2] * n):
        s = sum(own[i] * state[i] for i in range(n)) + sum(model.pairs[nodes.kind[i], state[nodes.parent[i]], state[i]] for i in range(1, n))
        for i in range(n):
            total[i, state[i]] += np.exp(s)
    marginal, _ = sum_product(nodes, model)
    assert marginal == pytest.approx(total[:, 1] / total.sum(1), abs=1e-9)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><a href="/">Site</a></header><nav><ul><li><a href="/a">Menu one</a></li><li><a href="/b">Menu two</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies. Accept them.</p></div><!-- <p>hidden</p> -->
<article><h1>The  title &amp; more</h1><p><b>First paragraph, with&nbsp;words &#8212; and more of them.<br><p>Second one follows here, as long text would.</p>
<div class="ad">Buy this now, it is cheap.</div><ul><li>An item of the list, with words.</li></ul><form><p>Your name</p><input></form></article>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/x">Other story</a></li></ul></aside>
<section class="comments"><h2>Comments</h2><div class="comment"><p>I liked this text a lot, thanks.</p></div></section>
<footer>&copy; Site &middot; All rights.</footer></body></html>"""


def test_a_page(model):
    assert texts([PAGE], model)[0].split("\n") == ["The title & more", "First paragraph, with words — and more of them.", "Second one follows here, as long text would.", "An item of the list, with words."]


def test_inline_elements_with_names_are_nodes(model):
    html = """<html><body><nav><ul><li><a href="/">Home</a></li></ul></nav><article><h1>A title of the page</h1>
    <p>First paragraph with words, long enough to be one.<span class="ad">Buy cheap stuff now.</span> It goes on <span class="text">behind</span> it, as it should.</p>
    <span class="ad">Buy cheap stuff now.</span><p>Second paragraph, also with <em id="main-text">several</em> words in it.</p></article></body></html>"""
    assert texts([html], model)[0].split("\n") == ["A title of the page", "First paragraph with words, long enough to be one. It goes on behind it, as it should.", "Second paragraph, also with several words in it."]


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("It is <em class='emphasis'>not</em> so.", "It is not so."), ("As the <a class='mw-redirect' href='/x'>study of words</a> shows, this is so.", "As the study of words shows, this is so."),
        ("He lived in <a class='extiw'>Paris</a> for years.", "He lived in Paris for years."), ("See <cite class='book'>The Great Book</cite> for more.", "See The Great Book for more."),
        ("The <code class='highlight'>print</code> function.", "The print function."), ("On <time class='date'>5 May 2020</time> it rained.", "On 5 May 2020 it rained."),
        ("The <abbr class='initialism'>WHO</abbr> said so.", "The WHO said so."), ("Text <b class='keyword'>bold</b> and more of it.", "Text bold and more of it."),
        ("It is <em class='x'>so <b>very</b></em> good, <i>is it</i> not?", "It is so very good, is it not?"), ("<span class='x'>good <span class='ad'>Buy now</span> tail</span>", "good tail"),
        ("Good words here. <span class='ad'>Buy cheap stuff now.</span> And more.", "Good words here. And more."), ("Good words here. <small class='share'>Share this</small>", "Good words here."),
        ("Open <span class='q'>to the end", "Open to the end"), ("An end</em> without <b class='q'>its</i> start</b>.", "An end without its start."),
    ],
)
def test_names_within_sentences(model, line, want):
    html = f"""<html><body><nav class="menu"><ul><li><a href="/">Home</a></li></ul></nav><article><h1>A title of the page</h1><p>First paragraph with words, long enough to be one.</p>
    <p>{line}</p><p>Another paragraph follows it, as it should, with words.</p></article><footer>&copy; us</footer></body></html>"""
    assert texts([html], model)[0].split("\n") == ["A title of the page", "First paragraph with words, long enough to be one.", want, "Another paragraph follows it, as it should, with words."]


def test_broken_markup(model):
    for html in ("", "<", "<p", "<p class='x", "</div></div>", "<!--", "<script>", "a < b > c", "<div " * 50, "<p>" * 3000 + "end.", "<div>" * 5000 + "deep text." + "</div>" * 5000, "&#xFFFFFF; &bogus; &amp", '<a href="' * 2000):
        assert isinstance(texts([html], model)[0], str)


def test_rows(spark, model):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", PAGE), (1, "u", PAGE)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(map(tuple, page_text.extracted(df, model).collect()), key=str)
    text = texts([PAGE], model)[0]
    assert got == sorted([(1, "u", text, len(text)), (1, "u", text, len(text)), (2, None, "", 0), (3, "u", "", 0), (None, "u", text, len(text))], key=str)
    assert page_text.extracted(df.limit(0), model).count() == 0
