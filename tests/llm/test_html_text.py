import time
import tracemalloc

import numpy as np
import pytest

from cardloom.llm import html_text, html_training, queries
from cardloom.llm.html_blocks import blocks, vectors


def expected(html):
    """Main text of a page of the test tables: headings and paragraphs of the article."""
    inside = html[html.index("<article>") : html.index("</article>")]
    return [b.text for b in blocks(inside)]


def test_pages(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.page_id: "\n".join(expected(r.html)) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op9_html_text(spark, sf).collect()
    assert len(got) == len(truth)
    assert np.mean([truth[r.page_id] == r.text for r in got]) > 0.99
    assert all(r.n_chars == len(r.text) for r in got)


def test_held_out_layouts():
    w = html_text.trained()
    xs, ys = html_text.examples(range(500_000, 500_300))
    wrong = [((p >= 0.5) != y).sum() for p, y in zip(html_text.label(w, xs), ys, strict=True)]
    assert sum(wrong) < 0.006 * sum(map(len, ys)) and np.mean([n == 0 for n in wrong]) > 0.85


def test_known_page():
    page = """<html><head><title>T</title><script>if (a<b) document.write("<p>no</p>")</script></head><body>
    <div class="cookie-notice"><p>We use cookies.</p></div><header class="site-header"><a href="/">Daily</a><form><label>Search</label><input></form></header>
    <nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav><aside class="sidebar"><h3>Most read</h3><p>Some long teaser text that is not the story.</p></aside>
    <article><h1>Title &amp; more</h1><p>First   paragraph
    with&nbsp;a <a href="/x">link</a> and &lt;tags&gt;.</p><div class="advert"><p>Buy now, it is cheap.</p></div><p>Second <b>bold.<p>Third.<ul><li>one<li>two</ul></article>
    <section class="comments"><h2>Comments</h2><div class="comment"><p>I do not agree with this at all.</p></div></section><footer>&copy; 2024 Daily</footer></body></html>"""
    found = blocks(page)
    p = html_text.label(html_text.trained(), [vectors([found])])[0]
    assert html_text.main_text(found, p >= 0.5).split("\n") == ["Title & more", "First paragraph with a link and <tags>.", "Second bold.", "Third.", "one", "two"]


@pytest.mark.parametrize("page, text", [
    ("", []), ("plain", ["plain"]), ("a < b <p>c", ["a < b", "c"]), ("<p>a<br>b<!-- <p>x --> c</p>", ["a b c"]), ("<script>never closed <p>x", []), ("<p a='1>2' b=\"</p>\">t</p>", ["t"]),
    ("<p a='>x</p>", ["x"]), ("<ul><li>1<ul><li>2</ul><li>3</ul>", ["1", "2", "3"]), ("&eacute;&#x41;&#66; &copy", ["éAB ©"]), ("<p>x</div></p>y", ["x", "y"]), ("<noscript><p>n</p></noscript>m", ["m"]),
    ("</p></p><p>", []), ("<", ["<"]), ("<p", ["<p"]), ("<script>x</script foo='1'>after", ["after"]), ("<noscript>open <p>in", ["open", "in"]), ("<template>open", ["open"]), ("a<!-- never <p>b", ["a"]), ("<b><p>x</b></p>y", ["x", "y"]), ("<!doctype html><?xml?>z", ["z"]),
])
def test_blocks(page, text):
    assert [b.text for b in blocks(page)] == text


def test_odd_pages(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (2, None, "", "x"), (3, "v", "<p>" + "word " * 100_000, "x"), (None, "w", "<p>a</p>" * 5000, "x"), (4, "q", "<" * 20_000 + "'" * 20_000, "x")]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(str(r.page_id) for r in got) == sorted(str(r[0]) for r in rows)
    assert {r.text for r in got if r.page_id in (1, 2)} == {""}
    assert [r.n_blocks for r in got if r.page_id is None] == [5000]
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_padding_and_chunks_change_nothing(monkeypatch):
    w = html_text.trained()
    xs, _ = html_text.examples(range(700_000, 700_030))
    xs.append(np.concatenate(xs * 6)[:4500])
    alone = [html_text.label(w, [x])[0] for x in xs]
    assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(alone, html_text.label(w, xs), strict=True))
    x, mask = html_text._padded(xs[-1:])
    assert np.allclose(html_text._forward(w, x, mask)[0][:, 0], alone[-1], atol=1e-4)
    monkeypatch.setattr(html_text, "CHUNK", 7)
    assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(alone, html_text.label(w, xs), strict=True))


def test_a_long_page_is_judged_as_a_whole():
    """The head of 10,000 blocks of one article and its tail are labelled alike, and as main text."""
    body = "".join(f"<p>Sentence number {i} of a very long story, told without haste.</p>" for i in range(10_000))
    page = f"<html><body><nav><ul><li><a href='/'>Home</a></ul></nav><article><h1>Long</h1>{body}</article><footer>&copy; 2024</footer></body></html>"
    found = blocks(page)
    p = html_text.label(html_text.trained(), [vectors([found])])[0] >= 0.5
    assert len(found) == 10_003 and p[1:-1].mean() > 0.999 and not p[-1]


@pytest.mark.parametrize("piece", ["<div>x", "<b>x<p>", "<div>x</span>", "<b><div>y</b>", "<svg>z", "<li>i<div>", "<a '", "<td>c<table>", "<div class='n%d m%d'>x"])
def test_unclosed_elements_take_linear_time(piece):
    def took(n):
        page = "".join(piece % (k, k) if "%" in piece else piece for k in range(n))
        tracemalloc.start()
        began = time.process_time()
        found = blocks(page)
        spent, peak = time.process_time() - began, tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return spent, peak, len(found)

    few, many = took(5_000), took(50_000)
    assert many[0] < 30 * few[0] + 0.5 and many[1] < 20 * few[1] + (1 << 20)


def test_weights_are_kept_in_the_shared_folder(spark, monkeypatch):
    first = html_text.weights(spark)
    monkeypatch.setattr(html_text.np, "savez", None)
    again = html_text.weights(spark)
    assert first.keys() == again.keys() and all(np.array_equal(first[k], again[k]) for k in first)


def test_gradients_match_differences():
    xs, ys = html_text.examples(range(3))
    x, mask = html_text._padded(xs)
    y = np.zeros(mask.shape, np.float32)
    for k, v in enumerate(ys):
        y[: len(v), k] = v
    w = {k: v.astype(np.float64) for k, v in html_text.trained().items()}

    def loss():
        p = html_text._forward(w, x, mask)[0].clip(1e-6, 1 - 1e-6)
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum()

    for k in w:
        w[k] = w[k] * 0.5
    grads = html_text._gradients(w, x, mask, y)
    for k, g in grads.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        kept, e = w[k][at], 1e-3
        w[k][at] = kept + e
        up = loss()
        w[k][at] = kept - e
        assert np.isclose((up - loss()) / 2 / e, g[at], rtol=0.03, atol=1e-4), k
        w[k][at] = kept


def test_generated_pages_are_stable():
    assert html_training.page(1) == html_training.page(1) != html_training.page(2)
