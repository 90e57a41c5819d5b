import random
import re
import time

import numpy as np
import pytest

from driftlab.llm import extract as E
from driftlab.llm.dom import Page, decode

PAGES = "page_id long, url string, html string, text string, n_chars string"


@pytest.fixture(scope="module")
def model():
    return E.train([])


def test_held_out_pages(model):
    r, exact, f1 = random.Random(99), 0, []
    for _ in range(150):
        source = E.synthetic_page(r)
        page, nodes, _, y = E._labelled(source)
        flag = dict(zip(nodes, y.astype(bool)))
        want = page.text([flag[v] and not page.never[v] for v in page.deciding()])
        got = E.main_text(source, model)
        exact += want == got
        a, b = set(want.split("\n")), set(got.split("\n"))
        f1.append(2 * len(a & b) / (len(a) + len(b)))
    assert exact > 0.95 * 150 and np.mean(f1) > 0.98


def test_boilerplate_goes_and_article_stays(model):
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{x:1}</style><script>var a="</p>";</script></head><body>
    <nav><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul></nav><div class="ad">Buy this now.</div>
    <article><h1>A &amp; B</h1><p><b>Bold
      start.<br><p>Second&nbsp;par&eacute; &#8364;5,   with <i>in</i>line.</p><form>Name <input></form><ul><li>one<li>two</ul></article>
    <section id="comments"><div class="comment"><p>I liked it.</p></div></section><aside class=sidebar><p>Other things.</p></aside>
    <div class="cookie-notice"><p>We use cookies.</p></div><footer>&copy; us</footer></body></html>"""
    assert E.main_text(page, model) == "A & B\nBold start.\nSecond paré €5, with inline.\none\ntwo"


def test_decoding_is_the_best_consistent_labelling():
    r = random.Random(1)
    for _ in range(40):
        html, open_ = "", 0
        for _ in range(7):
            if open_ and r.random() < 0.4:
                html += "</div>"
                open_ -= 1
            html += "<div>"
            open_ += 1
        page = Page(html)
        nodes, _ = page.features()
        score = np.array([r.uniform(-3, 3) for _ in nodes])
        size = np.array([r.uniform(0, 2) for _ in nodes])
        gain = score * (1 + size)
        best = -1e9
        for bits in range(1 << len(nodes)):
            lab = [bits >> k & 1 for k in range(len(nodes))]
            if lab[0] and all(not lab[k] or lab[page.parent[k]] for k in range(1, len(nodes))):
                best = max(best, sum(g if b else -g for g, b in zip(gain, lab)))
        got = decode(page, nodes, score, size)
        assert all(not got[k] or got[page.parent[k]] for k in range(1, len(nodes)))
        assert sum(g if b else -g for g, b in zip(gain, got)) == pytest.approx(best)


def test_edge_rows(spark, model):
    long = "<article>" + "".join(f"<p>Paragraph number {i}, with some words in it.</p>" for i in range(3000)) + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", "plain &lt; text"), (3, "u", long), (3, "u", long), (4, "u", "<script>x</script>"), (5, "u", "<p>a <!-- b --> c<p>d"), (6, "u", "< a << b > <" * 50), (7, "u", "<div" * 30), (8, "u", "</p></div></html>")]
    df = spark.createDataFrame([(*r, "clash", "x") for r in rows], PAGES)
    got = E.extract_text(df, model).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    text = [r.text for r in sorted(got, key=lambda r: (r.page_id is not None, r.page_id or 0))]
    assert text[0] == "plain < text" and text[1:3] == ["", ""]
    assert text[3] == text[4] and text[3].count("\n") == 2999
    assert text[5] == "" and text[6] == "a c\nd"
    assert E.extract_text(df.limit(0), model).count() == 0
    assert E.fit(df.limit(0)) is not None


@pytest.mark.parametrize("attrs", ['data-title="The hidden cost of war"', "hidden", 'aria-hidden="true"', 'style="display:none"', "title=don't", 'title=5"', 'a="b"c=\'d\' e', "/", 'x=""', "class", '"', "= b"])
def test_no_attribute_drops_text(model, attrs):
    rest = "<p>It isn't long.</p><p>Second paragraph, it's \"here\".</p>"
    for tag in ("article", "p", "div"):
        got = E.main_text(f"<article><{tag} {attrs}>First paragraph of text, which stays.</{tag}>{rest}</article>", model)
        assert got == "First paragraph of text, which stays.\nIt isn't long.\nSecond paragraph, it's \"here\"."


@pytest.mark.parametrize("page", ["<a " * 350_000, "<!" * 500_000, "<p x='" * 170_000, '<p x="y' * 150_000, "<h1>" * 60_000, "<b>" * 60_000 + "</i>" * 60_000, "<li><ul>" * 30_000, "<p><b>" * 40_000, "</p>" * 250_000, "<title>" * 100_000, "<script>" * 100_000, "< a" * 300_000, "<!--" * 250_000, "<article>" * 30_000])
def test_hostile_pages_take_linear_time(page):
    began = time.perf_counter()
    p = Page(page)
    p.features()
    p.text([True] * len(p.tag))
    E._weak_labels(p, p.deciding())
    assert time.perf_counter() - began < 5


HAND = [
    ("<body><form id=aspnetForm><div class=content><h1>Title</h1><p>First words of it, and more.</p><p>Second words of it, at last.</p></div></form>", "Title\nFirst words of it, and more.\nSecond words of it, at last."),
    ("<form id=aspnetForm action=/ method=post><input type=hidden name=v><nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav><article><h1>The river</h1><p>It rose in the night, and by noon it stood in the street.</p><p>Nobody was hurt.</p></article><form class=search><label>Find</label><input name=q><button>Go</button></form><footer>&copy; us</footer></form>", "The river\nIt rose in the night, and by noon it stood in the street.\nNobody was hurt."),
    ("<article><h1>Bread</h1><p>Mix flour and water, then wait for an hour.</p><form action=/send><p>Your mail</p><input name=mail><button>Send</button></form><p>Bake it until it is brown.</p></article>", "Bread\nMix flour and water, then wait for an hour.\nBake it until it is brown."),
    ("<main><h1>Map</h1><noscript>Enable JavaScript</noscript><svg><text>chart</text><title>t</title></svg><p>The town lies between two hills, south of the lake.</p></main>", "Map\nThe town lies between two hills, south of the lake."),
    ("<div class=header><p>The Daily</p></div><div class=post><h2>Frost</h2><p>The frost came early this year, growers say.</p><ul><li>Apples were lost.<li>Pears were not.</ul></div><div class=comments><div class=comment><p>So sad!</p></div></div>", "Frost\nThe frost came early this year, growers say.\nApples were lost.\nPears were not."),
    ("<div id=cookie-notice><p>We use cookies.</p></div><section class=entry><h1>Two ships</h1><blockquote><p>We saw them at dawn, side by side.</p></blockquote><table><tr><td>Length</td><td>Forty metres</td></tr></table></section><aside class=sidebar><h3>Popular</h3><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></aside>", "Two ships\nWe saw them at dawn, side by side.\nLength\nForty metres"),
    ("<form class=login><label>Name</label><input name=n><label>Word</label><input type=password name=p><button>Enter</button></form><article><h1>A short note</h1><p>Shops open at nine from Monday on.</p></article>", "A short note\nShops open at nine from Monday on."),
]


@pytest.mark.parametrize("page,want", HAND)
def test_pages_labelled_by_hand(model, page, want):
    assert E.main_text(f"<!DOCTYPE html><html><head><title>x</title></head>{page}</html>", model) == want


def test_tags_and_names_are_not_all_that_the_trees_go_by(model):
    """Generated pages keep their text when every telling tag becomes a div and every class, id and role goes."""
    r, same, n = random.Random(41), 0, 100
    for _ in range(n):
        source = E.synthetic_page(r)
        want = E.main_text(source, model)
        bare = re.sub(r'\s(class|id|role)="[^"]*"', "", re.sub(r"(</?)(article|main|nav|aside|footer|header|section)\b", r"\1div", source))
        a, b = set(want.split()), set(E.main_text(bare, model).split())
        same += 2 * len(a & b) / max(1, len(a) + len(b))
    assert same / n > 0.75
