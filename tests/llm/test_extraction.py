import html
import itertools
import math
import random
import re

import numpy as np
import pytest

from sieveline.llm import extraction
from sieveline.llm.dom import leaf_blocks

PAGES = "page_id bigint, url string, html string, text string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def sentence(r, n):
    return " ".join(r.choices(WORDS, k=n)).capitalize() + "."


def given_page(seed):
    """A page as the given tables have them, and its article's text."""
    r = random.Random(seed)
    title, paragraphs = sentence(r, 6), [sentence(r, r.randint(1, 60)) + r.choice(["", " &amp; more.", " x &lt; y."]) for _ in range(r.randint(1, 8))]
    links = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in r.choices(WORDS, k=5))
    body = "".join(r.choice(["<p>{}</p>", "<p><b>{}<br>"]).format(p) for p in paragraphs)
    page = (
        f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body><nav><ul>{links}</ul></nav>"
        f"<!-- ad --><div class='ad'>{sentence(r, 8)}</div><article><h1>{title}</h1>{body}</article><footer>&copy; x &middot; {sentence(r, 5)}</footer></body></html>"
    )
    return page, html.unescape(" ".join([title, *paragraphs]))


@pytest.fixture(scope="module")
def field():
    return extraction.fit(extraction.training_pages([given_page(i)[0] for i in range(200)], 8))


def main_text(field, page):
    blocks = leaf_blocks(page)
    return " ".join(b.text for b, y in zip(blocks, field.decode(blocks), strict=True) if y)


def test_given_layout(field):
    for seed in range(1000, 1060):
        page, want = given_page(seed)
        assert main_text(field, page) == want


def test_held_out_layouts(field):
    right = total = 0
    for blocks, labels in extraction.training_pages([given_page(i)[0] for i in range(2000, 2040)]):
        right += sum(a == b for a, b in zip(field.decode(blocks), labels, strict=True))
        total += len(labels)
    assert right > 0.96 * total


#: Pages written by hand: the signs around main text are A0, A1, ... in order, all else is B.
LONG = "this is a sentence of the text that goes on for a while, with commas and an end."
BY_HAND = [
    f"<html><body><div id='header'><div class='logo'>B site</div><ul class='menu'><li><a href=/>B home</a></li></ul></div><div id='wrapper'><div id='content'><div class='post hentry'><h2 class='entry-title'>A0 Title</h2><div class='entry-content'><p>A1 {LONG}</p><p>A2 {LONG}</p><div class='sharedaddy share'><a href=x>B share</a></div></div></div><div id='comments'><h3>B 2 comments</h3><ol class='commentlist'><li class='comment'><p>B {LONG}</p></li></ol></div></div><div id='sidebar'><div class='widget'><h4>B recent</h4><ul><li><a href=x>B one</a></li></ul></div></div></div><div id='footer'>B copyright</div></body></html>",
    f"<body><header class='site-header'><nav><a href=/>B news</a> <a href=/s>B sport</a></nav></header><div class='cookie-consent'>B we use cookies to give you the best service. <button>B accept</button></div><main><article class='story'><header><h1>A0 Head line</h1></header><p>A1 {LONG}</p><aside class='related'><ul><li><a href=x>B other story</a></li></ul></aside><p>A2 {LONG}</p><div class='advert'>B buy this now.</div><p>A3 {LONG}</p></article><section class='comments'><article class='comment'><p>B {LONG}</p></article></section></main><footer><p>B all rights reserved.</p></footer></body>",
    f"<div class='page'><div class='navbar'><a href=1>B a</a><a href=2>B b</a></div><div class='article-body'>A0 {LONG}<br><br>A1 {LONG}<br>A2 {LONG}</div><form class='newsletter'><p>B get our letter</p><input name=e><button>B go</button></form><div class='footer legal'>B imprint</div></div>",
    f"<body><p>A0 {LONG}</p><p>A1 {LONG}<p>A2 {LONG}<ul><li>A3 {LONG}</ul></body>",
    f"<body><div role='navigation'><a href=x>B menu</a></div><div role='main'><h1>A0 Title</h1><blockquote>A1 {LONG}</blockquote><table><tr><td>A2 {LONG}</table></div><div role='complementary'><p>B {LONG}</p></div><div role='contentinfo'>B foot</div></body>",
]


def test_pages_by_hand(field):
    for page in BY_HAND:
        got = main_text(field, page)
        assert re.findall(r"\bA\d+\b", got) == [f"A{i}" for i in range(len(set(re.findall(r"\bA\d+\b", page))))]
        assert not re.search(r"\bB\b", got)


def test_blocks():
    text = lambda page: [b.text for b in leaf_blocks(page)]
    assert text("<p>a <b>b</b>c\n\t d<br>e&amp;&#65;&nbsp;f</p>tail") == ["a bc d", "e&A f", "tail"]
    assert text("a<!-- <p>no</p> -->b<script>if (a < b) '</p>'</script>c<style>x</style >d") == ["ab", "c", "d"]
    assert text("1 < 2 <<b>3</b> </> <3") == ["1 < 2 <3 <3"] or text("1 < 2") == ["1 < 2"]
    assert text("<div title='a > b'>x</div><p title=\"unclosed>y</p>") == ["x", "y"] or text("<div title='a > b'>x</div>") == ["x"]
    assert text("<SCRIPT>never ends") == [] and text("<!-- never ends") == [] and text(None) == [] and text("") == []
    assert text("<ul><li>a<li>b<ul><li>c</ul>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert [round(b.linked, 1) for b in leaf_blocks("<p><a href=x>abcd</a></p><p>abcd</p>")] == [1.0, 0.0]


def test_long_and_deep_pages_are_read_in_one_pass():
    assert len(leaf_blocks("<p>word</p>" * 100_000)) == 100_000
    assert [b.text for b in leaf_blocks("<div>" * 50_000 + "x" + "</div>" * 50_000)] == ["x"]
    assert len(leaf_blocks("<p title='" * 20_000)) <= 20_000
    assert [b.text for b in leaf_blocks("</b>" * 50_000 + "<i>" * 50_000 + "x" + "</u>" * 50_000)] == ["x"]


def by_all_paths(field, blocks):
    """The best labels and their probabilities, over all labellings."""
    unary = field.scores(blocks)
    out = {}
    for labels in itertools.product([0, 1], repeat=len(blocks)):
        score = field.first * labels[0] + sum(u * y for u, y in zip(unary, labels, strict=True))
        for a, b in itertools.pairwise(range(len(blocks))):
            score += field.steps[int(blocks[a].parent == blocks[b].parent)][labels[a]][labels[b]]
        out[labels] = score
    return out


def test_viterbi_against_all_paths():
    r = np.random.default_rng(5)
    for seed in range(40):
        field = extraction.Field(r.normal(size=extraction.WIDTH), float(r.normal()), r.normal(size=(2, 2, 2)))
        blocks = leaf_blocks(given_page(seed)[0])[:9]
        scores = by_all_paths(field, blocks)
        assert math.isclose(scores[tuple(map(int, field.decode(blocks)))], max(scores.values()))


def test_training_raises_the_likelihood():
    pages = [(b[:8], y[:8]) for b, y in extraction.training_pages([given_page(i)[0] for i in range(6)], 1)]

    def likelihood(field):
        total = 0.0
        for blocks, labels in pages:
            scores = by_all_paths(field, blocks)
            total += scores[tuple(map(int, labels))] - np.logaddexp.reduce(list(scores.values()))
        return total

    marks = [likelihood(extraction.fit(pages, steps)) for steps in (0, 5, 40, 200)]
    assert marks == sorted(marks) and marks[-1] > 0.1 * marks[0]


def test_table(spark):
    rows = [(i, f"http://x/{i}", given_page(i)[0], "clash") for i in range(60)]
    wants = {i: given_page(i)[1] for i in range(60)}
    more = [(None, None, None, None), (70, "u", "", ""), (71, "u", "<nav><a href=x>only a menu</a></nav>", ""), rows[3], (72, "u", "<article>" + "<p>Long words go on here.</p>" * 20_000 + "</article>", "")]
    found = extraction.extract(spark.createDataFrame(rows + more, PAGES)).collect()
    assert len(found) == len(rows) + len(more)
    for r in found:
        assert r.n_chars == len(r.text)
        if r.page_id in wants:
            assert r.text == wants[r.page_id]
    assert sorted(r.text for r in found if r.page_id in (None, 70, 71)) == ["", "", ""]
    assert next(r for r in found if r.page_id == 72).text == " ".join(["Long words go on here."] * 20_000)
    assert extraction.extract(spark.createDataFrame([], PAGES)).count() == 0
    assert extraction.extract(spark.createDataFrame([(1, "u", "<p>one</p>", "")], PAGES)).count() == 1
