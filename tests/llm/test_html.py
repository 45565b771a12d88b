import itertools
import random

import numpy as np
import pytest

from foretally.llm import html


def brute_cut(gain, edges):
    best = None
    for labels in itertools.product((False, True), repeat=len(gain)):
        cost = sum(-g for g, x in zip(gain, labels) if x and g < 0) + sum(g for g, x in zip(gain, labels) if not x and g > 0)
        cost += sum(w for a, b, w in edges if labels[a] != labels[b])
        if best is None or cost < best:
            best = cost
    return best


def cost_of(labels, gain, edges):
    cost = sum(abs(g) for g, x in zip(gain, labels) if x != (g > 0))
    return cost + sum(w for a, b, w in edges if labels[a] != labels[b])


def test_minimum_cut_by_enumeration():
    draw = random.Random(8)
    for _ in range(300):
        n = draw.randint(1, 9)
        gain = [draw.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, draw.uniform(0, 2)) for a in range(n) for b in range(n) if draw.random() < 0.3]
        edges = [e for e in edges if e[0] != e[1]]
        labels = html.minimum_cut(gain, edges)
        assert abs(cost_of(labels, gain, edges) - brute_cut(gain, edges)) < 1e-6


def main(page):
    return html.extract([page], html.PRIOR)[0][0]


LONG = "This is a sentence of the article that says a number of things at some length."


def test_pages():
    page = f"""<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <header><a href="/">Home of the site</a></header><nav><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></nav>
    <!-- a > b --><div class="cookie-notice">We use cookies to make this page better for all of you.</div>
    <article><header><h1>The   title &amp; more</h1></header><p>{LONG}<p>Sh<b>ort</b> one.<div class="ad">Buy now, this is an advert of some length, you will like it.</div>
    <p>{LONG} &eacute;&#65;&lt;<br>next&nbsp;line</p><form><label>Name</label><input value=x></form></article>
    <aside>Other things that you may like to read when you have some time.</aside>
    <section id="comments"><p>First! I like this article very much, thank you for writing it.</p></section>
    <footer>&copy; 2024 the owner of this place, all rights are with them.</footer></body></html>"""
    assert main(page) == f"The title & more {LONG} Short one. {LONG} éA< next line"


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("plain words without any markup, as long as a sentence should be.", "plain words without any markup, as long as a sentence should be."),
        (f"<article><p>{LONG}</p><p>cut off &am", f"{LONG} cut off &am"),
        (f"<article><p>{LONG}</p><p>cut <b cla", f"{LONG} cut"),
        (f"<article><p>{LONG}<script>if (a<b) x()", LONG),
        (f"<article><p>{LONG} a < b and c > d</p></article>", f"{LONG} a < b and c > d"),
        (f'<article title="a>b"><p>{LONG}</article>', LONG),
        (f"<article><svg/><p>{LONG}</p></article>", LONG),
        ("<nav>a</nav>", ""),
        (f'<article style="overflow:hidden"><p>{LONG}</p></article>', LONG),
        (f'<article><p title="the hidden valley">{LONG}</p><p data-x=hidden alt=\'class="ad"\'>{LONG}</p></article>', f"{LONG} {LONG}"),
        (f'<article><p>{LONG}</p><p hidden>{LONG}</p><div aria-hidden=true>{LONG}</div></article>', LONG),
        (f'<article><section class="story related-work"><p>{LONG}</p></section></article>', LONG),
        (f'<article><p>{LONG}</p></article><div><a href=x><div><p>A card that links to another page of the site</p></div></a></div>', LONG),
        (f'<article><a href=x><p>{LONG}</p><p>{LONG}</p></article>', f"{LONG} {LONG}"),
        ("</p></div>" * 50 + f"<main><p>{LONG}</p>", LONG),
    ],
)
def test_odd_pages(page, text):
    assert main(page) == text


def test_link_text_counts_through_blocks():
    card = "<a href=x><div><h3>Title of a card</h3><p>Text of the card.</p></div></a><p>Free text.</p>"
    assert [(b.text, b.linked == len(b.text)) for b in html.blocks_of(card)] == [("Title of a card", True), ("Text of the card.", True), ("Free text.", False)]
    unclosed = "<p><a href=x>one</p><p>two</p><a name=y><p>three</p>"
    assert [b.linked for b in html.blocks_of(unclosed)] == [3, 0, 0]


def test_attributes_by_name():
    found = dict(html.attributes_of(' CLASS="a b" title=\'the "hidden" x\' data-hidden id = main hidden'))
    assert found == {"class": "a b", "title": 'the "hidden" x', "data-hidden": "", "id": "main", "hidden": ""}


def test_main_texts_of_a_table(spark):
    page = f"<nav><a href=x>Menu</a></nav><article><h1>Head</h1><p>{LONG}</p></article><footer>&copy; us</footer>"
    huge = "<article>" + f"<p>{LONG}</p>" * 8000 + "</article>"
    rows = [(i, f"http://h/{i}", page, "x") for i in range(20)] + [(50, None, None, "x"), (None, "u", page, "x"), (51, "u", huge, "x"), (51, "u", huge, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = html.main_texts(pages).collect()
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    texts = {(r.page_id, r.text) for r in found}
    assert texts == {(i, f"Head {LONG}") for i in [*range(20), None]} | {(50, ""), (51, " ".join([LONG] * 8000))}
    assert html.main_texts(pages.limit(0)).collect() == []


def test_fit_moves_from_the_prior():
    blocks = html.blocks_of(f"<article><p>{LONG}</p></article><nav><li><a>x</a></li></nav>" * 30)
    rows = np.array([html.block_features(b) for b in blocks])
    weights = html.fit_weights(rows, np.array([float(b.semantic > 0) for b in blocks]))
    assert np.all((rows @ weights > 0) == [b.semantic > 0 for b in blocks])


@pytest.mark.parametrize(
    "inner, text",
    [
        (f"<svg-icon name=x></svg-icon><p>{LONG}</p>", f"{LONG} {LONG}"),
        (f"<title-bar></title-bar><template-card></template-card><math-field></math-field><p>{LONG}</p>", f"{LONG} {LONG}"),
        (f"<object data=x><p>{LONG}</p>", f"{LONG} {LONG}"),
        (f"<canvas><p>{LONG}</p>", f"{LONG} {LONG}"),
        (f"<p>Here <math><mi>x</mi></math> is said. {LONG}</p>", f"{LONG} Here x is said. {LONG}"),
        (f"<svg width=1><title>No</title><path d=x><p>{LONG}</p>", f"{LONG} {LONG}"),
        (f"<svg width=1><text>no</text></svg><p>{LONG}</p><TITLE\n>no</TITLE>", f"{LONG} {LONG}"),
    ],
)
def test_only_raw_elements_are_dropped_whole(inner, text):
    assert main(f"<article><p>{LONG}</p>{inner}</article>") == text


@pytest.mark.parametrize(
    "open_, close",
    [
        ("<form><select>" + "<option>one of many" * 300, "</select></form>"),
        ("<nav><dl>" + "<dt>a<dd>b" * 200, "</dl></nav>"),
        ("<nav><table>" + "<tr><td>a<th>b" * 200, "</table></nav>"),
        ("<nav>" + "<span>" * 5000, "</nav>"),
    ],
)
def test_end_tags_close_at_any_depth(open_, close):
    last = html.blocks_of(f"{open_}{close}<div>{LONG}</div>")[-1]
    assert (last.text, last.mark, last.below_boiler) == (LONG, 0, False)
    assert main(f"{open_}{close}<div><p>{LONG}</p><p>{LONG}</p></div>") == f"{LONG} {LONG}"


def test_cells_options_and_terms_end_at_the_next_one():
    page = "<table><tr><td>a<td>b<tr><th>c</table><dl><dt>d<dd>e<dt>f</dl><select><option>g<option>h</select>"
    whole = "<table><tr><td>a</td><td>b</td></tr><tr><th>c</th></tr></table><dl><dt>d</dt><dd>e</dd><dt>f</dt></dl><select><option>g</option><option>h</option></select>"
    assert html.blocks_of(page) == html.blocks_of(whole)
