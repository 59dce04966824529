"""Main text of pages: a linear-chain conditional random field over leaf blocks.

Every leaf block is main text or not. The weights of its features (tags, classes
and ids of the elements around it, its own element, the look of its text) and of
the steps from block to block (within one element or not) are those that make the
labels of labelled pages most likely; Viterbi decoding finds the most likely labels
of a page. Training reads a bounded sample of pages; every page is decoded whole,
where it lies.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dom import WIDTH, Block, leaf_blocks, slot

#: Pages of the labelled sample, the longest of them, how often each is laid out
#: anew, and the steps of training.
SAMPLE, LONGEST, LAYOUTS, STEPS = 200, 100_000, 5, 150
#: Pages are trained on in pieces of so many blocks.
PIECE = 64
#: Set before main text of labelled pages while they are laid out; private use.
MARK = ""

#: Ways to lay out pages for training, by what stands in a part: its elements, the
#: words that its classes and ids are made of, and the words that go with these
#: anywhere. A part has an element, or a word in a class, or both.
PARTS = {
    "main": ("article main section div", "article post entry story content main text body news blog"),
    "links": ("nav div ul aside", "nav menu navbar navigation breadcrumb breadcrumbs pagination pager tags related share social popular trending recommended topics toc links"),
    "head": ("header div", "header head masthead logo topbar banner brand"),
    "notice": ("div section aside dialog", "cookie cookies notice consent gdpr modal popup overlay alert warning paywall disclaimer banner privacy message"),
    "ad": ("div aside ins section", "ad ads advert advertisement adsbygoogle promo promotion sponsor sponsored banner adslot"),
    "side": ("aside div section", "sidebar side widget bio author rail secondary complementary"),
    "form": ("form fieldset div", "newsletter subscribe signup login search contact register form"),
    "comments": ("section div ol ul", "comment comments commentlist reply replies respond disqus discussion responses reviews"),
    "foot": ("footer div section", "footer foot copyright legal imprint bottom colophon"),
}
ROLES = {"main": "main", "links": "navigation", "head": "banner", "notice": "alert", "side": "complementary", "form": "search", "foot": "contentinfo"}
AROUND = "wrapper container page site layout row col inner outer box area list section wrap block group item body content left right x1 x2"
PLAIN = ["<div>", "<section>", "<main>", "<table><tr><td>"]
HEADLINES = ["<h1>{}</h1>", "<header><h1>{}</h1></header>", '<h2 class="title">{}</h2>', '<div class="headline">{}</div>', '<h1 class="entry-title">{}</h1>', '<header class="article-header"><h1>{}</h1></header>']
PARAGRAPHS = ["<p>{}</p>", "<p>{}", "<div>{}</div>", "<p><b>{}<br>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", '<p class="x3">{}</p>', "<h2>{}</h2>", "<pre>{}</pre>", "<section><p>{}</p></section>", '<p>{}</p><figure><img src="i.png"></figure>', "{}<br>", "{}<br><br>"]


def opening(part: str, r: random.Random) -> str:
    """Elements that open a part of a page: one that says what it is, maybe in
    another or around another that does not."""
    elements, words = (x.split() for x in PARTS[part])
    around = AROUND.split()
    bare = elements[0] not in ("div", "ins")
    if part in ROLES and r.random() < 0.1:
        told = f'<div role="{ROLES[part]}">'
    elif bare and r.random() < 0.35:
        told = f"<{elements[0]}>"
    else:
        names = [r.choice(words)] + [r.choice(words if r.random() < 0.4 else around) for _ in range(r.choice([0, 0, 1, 1, 2]))]
        r.shuffle(names)
        told = f'<{r.choice(elements)} {r.choice(["class", "class", "id"])}="{r.choice(["-", " ", "_", "__"]).join(names)}">'
    more = lambda: f'<div class="{r.choice(around)}">' if r.random() < 0.15 else ""
    return more() + told + more()


def closing(around: str) -> str:
    return "".join(f"</{part.split()[0].rstrip('>')}>" for part in reversed(around.split("<")[1:]))


def layout(main: list[str], other: list[str], r: random.Random) -> str:
    """A page of these texts, laid out by chance; main text is marked."""
    e = lambda text: text.replace("&", "&amp;").replace("<", "&lt;")
    some = lambda most: [e(r.choice(other)) for _ in range(r.randint(1, most))]
    short = lambda text: " ".join(text.split()[: r.randint(1, 4)])
    put = lambda around, body: around + body + closing(around)

    def links() -> str:
        each = r.choice(["<li>{}</li>", "{} ", "<p>{}</p>", "{} | ", "<div>{}</div>"])
        body = "".join(each.format(f'<a href="/x">{short(t)}</a>') for t in some(8))
        return put(opening("links", r), f"<ul>{body}</ul>" if each[1:3] == "li" else body)

    def text(part: str, most: int = 2) -> str:
        each = r.choice(["<p>{}</p>", "{}", "<div>{}</div>", "<span>{}</span><br>", "<h3>{}</h3>", '<p><a href="/x">{}</a></p>'])
        return put(opening(part, r), "".join(each.format(t) for t in some(most)))

    def form() -> str:
        fields = "".join(f"<label>{short(t)}</label><input type=text>" for t in some(2))
        return put(opening("form", r), f"{r.choice(['', '<p>'])}{some(1)[0]}{fields}<button>{short(r.choice(other))}</button>")

    def comments() -> str:
        each = r.choice(["<p>{}</p>", '<div class="comment"><b>{}</b><p>{}</p></div>', "<div>{}</div>", '<article class="comment"><p>{}</p></article>', "<li>{}</li>", "<article><header>{}</header><p>{}</p></article>"])
        body = "".join(each.format(e(t), e(t)) for t in (r.choice(main + other) for _ in range(r.randint(1, 4))))
        return put(opening("comments", r), f"<h3>{short(r.choice(other))}</h3>{body}")

    foot = lambda: put(opening("foot", r), r.choice(["&copy; {}", "<p>{}</p>", "{} &middot; {}", "<a href='/'>{}</a> {}"]).format(some(1)[0], some(1)[0]))
    parts = [links, *((lambda part=part: text(part, 3)) for part in ("head", "notice", "ad", "side")), form]
    maybe = lambda most: "".join(r.choice(parts)() for _ in range(r.randint(0, most)))
    body = [r.choice(HEADLINES).format(MARK + e(main[0]))] if r.random() < 0.8 else []
    usual = r.choice(PARAGRAPHS)
    for t in main[len(body) :]:
        body.append((r.choice(PARAGRAPHS) if r.random() < 0.3 else usual).format(MARK + e(t)))
        if r.random() < 0.15:
            body.append(r.choice(parts)())
    inside = "".join(body)
    at_end = (comments() if r.random() < 0.5 else "") + maybe(1)
    around = "" if r.random() < 0.1 else r.choice(PLAIN) if r.random() < 0.1 else opening("main", r)
    whole = put(around, inside + at_end) if r.random() < 0.4 else put(around, inside) + at_end
    head = f"<html><head><title>{short(e(main[0]))}</title></head><body>" if r.random() < 0.8 else ""
    outer = f'<div class="{r.choice(AROUND.split())}">' if r.random() < 0.5 else ""
    return head + put(outer, maybe(4) + whole + maybe(3)) + (foot() if r.random() < 0.8 else "")


def features(block: Block) -> list[int]:
    """Hashed features of a block, beside those of the elements around it."""
    words = block.text.count(" ") + 1
    long = min(7, words.bit_length())
    linked = 0 if block.linked == 0 else 1 + int(block.linked * 2.99)
    last = block.text[-1]
    ends = "stop" if last in ".!?…。" else "mark" if not last.isalnum() else "none"
    names = [f"p:{block.tag}", f"w:{long}", f"l:{linked}", f"e:{ends}", f"w:{long} l:{linked} e:{ends}", f"p:{block.tag} w:{long}", f"p:{block.tag} l:{linked}", "bias"]
    if "©" in block.text:
        names.append("copyright")
    return [*block.around, *block.near, *map(slot, names)]


@dataclass
class Field:
    """Weights: a number per feature, how far a first block is main text, and
    scores of steps (same element or not, from, to)."""

    weights: np.ndarray
    first: float
    steps: np.ndarray

    def scores(self, blocks: list[Block]) -> np.ndarray:
        return np.array([self.weights[features(b)].sum() for b in blocks])

    def decode(self, blocks: list[Block]) -> list[bool]:
        """Viterbi: the most likely labels; other than main text at a tie."""
        if not blocks:
            return []
        scores, steps = self.scores(blocks).tolist(), self.steps.tolist()
        other, main = 0.0, scores[0] + self.first
        back: list[tuple[bool, bool]] = []
        for k in range(1, len(blocks)):
            step = steps[blocks[k].parent == blocks[k - 1].parent]
            from_main = (main + step[1][0] > other + step[0][0], main + step[1][1] > other + step[0][1])
            other, main = max(other + step[0][0], main + step[1][0]), max(other + step[0][1], main + step[1][1]) + scores[k]
            back.append(from_main)
        labels = [main > other]
        for from_main in reversed(back):
            labels.append(from_main[labels[-1]])
        return labels[::-1]


def fit(pages: list[tuple[list[Block], list[bool]]], steps: int = STEPS, prior: float = 1e-5) -> Field:
    """The weights that make the labels most likely, by gradient steps over
    forward and backward sums; large weights are held back by ``prior``."""
    pages = [(b[k : k + PIECE], y[k : k + PIECE]) for b, y in pages for k in range(0, len(b), PIECE)]
    field = Field(np.zeros(WIDTH), 0.0, np.zeros((2, 2, 2)))
    if not pages:
        return field
    n, most = len(pages), max(len(b) for b, _ in pages)
    rows, slots = [], []
    given, same, there = np.zeros((n, most), int), np.zeros((n, most), int), np.zeros((n, most), bool)
    for i, (blocks, labels) in enumerate(pages):
        there[i, : len(blocks)], given[i, : len(blocks)] = True, labels
        for k, block in enumerate(blocks):
            found = features(block)
            rows += [i * most + k] * len(found)
            slots += found
            same[i, k] = k > 0 and blocks[k - 1].parent == block.parent
    rows, slots = np.array(rows), np.array(slots)
    total = there.sum()
    mean, size, flat = (np.zeros(WIDTH + 9) for _ in range(3))
    row = np.arange(n)
    pairs = there[:, 1:]
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (same[:, 1:][pairs], given[:, :-1][pairs], given[:, 1:][pairs]), 1)
    for at in range(1, steps + 1):
        weights, first, step = flat[:WIDTH], flat[WIDTH], flat[WIDTH + 1 :].reshape(2, 2, 2)
        score = np.zeros((n, most, 2))
        score[:, :, 1] = np.bincount(rows, weights[slots], n * most).reshape(n, most)
        score[:, 0, 1] += first
        forward, backward = score.copy(), np.zeros((n, most, 2))
        for k in range(1, most):
            forward[:, k] += np.logaddexp.reduce(forward[:, k - 1, :, None] + step[same[:, k]], 1)
        for k in range(most - 2, -1, -1):
            ahead = np.logaddexp.reduce(step[same[:, k + 1]] + (score[:, k + 1] + backward[:, k + 1])[:, None, :], 2)
            backward[:, k] = np.where(there[:, k + 1, None], ahead, 0)
        last = there.sum(1) - 1
        whole = np.logaddexp.reduce(forward[row, last], 1)
        likely = np.where(there, np.exp(np.minimum(0, (forward + backward)[:, :, 1] - whole[:, None])), 0)
        missed = given * there - likely
        slope = np.zeros_like(flat)
        slope[:WIDTH] = np.bincount(slots, missed.ravel()[rows], WIDTH)
        slope[WIDTH] = missed[:, 0].sum()
        joint = forward[:, :-1, :, None] + step[same[:, 1:]] + (score + backward)[:, 1:, None, :] - whole[:, None, None, None]
        expected = np.zeros((2, 2, 2))
        np.add.at(expected, same[:, 1:][pairs], np.exp(np.minimum(0, joint[pairs])))
        slope[WIDTH + 1 :] = (seen - expected).ravel()
        slope = slope / total - prior * flat
        mean, size = 0.9 * mean + 0.1 * slope, 0.99 * size + 0.01 * slope**2
        flat = flat + 0.1 * (mean / (1 - 0.9**at)) / (np.sqrt(size / (1 - 0.99**at)) + 1e-6)
    return Field(flat[:WIDTH], float(flat[WIDTH]), flat[WIDTH + 1 :].reshape(2, 2, 2))


def labelled(page: str) -> tuple[list[Block], list[bool]]:
    """Blocks of a page whose main text is marked, and their labels."""
    blocks = leaf_blocks(page)
    labels = [MARK in b.text for b in blocks]
    for b in blocks:
        b.text = " ".join(b.text.replace(MARK, " ").split())
    kept = [(b, y) for b, y in zip(blocks, labels, strict=True) if b.text]
    return [b for b, _ in kept], [y for _, y in kept]


def by_markup(page: str) -> tuple[list[Block], list[bool]] | None:
    """Labels that a page's own markup gives: what its articles hold; null for a
    page without an article."""
    blocks = leaf_blocks(page.replace(MARK, ""))
    article = slot("t:article")
    others = frozenset(map(slot, ("t:nav", "t:aside", "t:footer", "t:form", "c:comment", "c:comments", "c:ad", "c:ads")))
    labels = [article in b.around and not others & b.around for b in blocks]
    return (blocks, labels) if any(labels) else None


def training_pages(sample: list[str], layouts: int = LAYOUTS) -> list[tuple[list[Block], list[bool]]]:
    """Labelled pages: those of the sample whose markup tells, and ``layouts``
    anew laid out pages of the texts of each page of the sample."""
    found, others = [], []
    texts = []
    for page in sample:
        told = by_markup(page)
        blocks = told[0] if told else leaf_blocks(page.replace(MARK, ""))
        labels = told[1] if told else [b.text.count(" ") >= 8 and b.linked < 0.5 for b in blocks]
        if told:
            found.append(told)
        texts.append([b.text for b, y in zip(blocks, labels, strict=True) if y])
        others += [b.text for b, y in zip(blocks, labels, strict=True) if not y]
    others = others or [" ".join(t.split()[:8]) for main in texts for t in main] or ["text"]
    for k, main in enumerate(texts):
        for j in range(layouts if main else 0):
            r = random.Random(f"{k}:{j}")
            stranger = texts[r.randrange(len(texts))] or main
            found.append(labelled(layout(main[: r.randint(2, 40)], [*r.choices(others, k=20), *r.choices(stranger, k=6)], r)))
    return found


def sampled(pages: DataFrame, most: int = SAMPLE, longest: int = LONGEST) -> list[str]:
    """The sample, told by hashes of the rows, so that reruns agree: about four
    times as many rows as wanted come below a bound, the least of them count."""
    n = pages.count()
    at = F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(2**40))
    bound = 2**40 if n <= 4 * most else 2**40 * 4 * most // n
    near = pages.select("html", at.alias("at")).where((F.col("at") < bound) & (F.length("html") <= longest) & (F.length("html") > 0))
    return [row.html for row in near.orderBy("at", "html").limit(most).collect()]


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """Main text of ``pages`` (page_id, url, html).

    Returns per row: page_id, url, text (main blocks in order, joined by one
    space; empty if there are none), n_chars (code points). A null page is empty.
    Pages are read and decoded whole, whatever their length; repeated rows each
    get a row with equal results; an empty table gives an empty result; other
    columns are not read. ``field`` holds the weights; by default they are fitted
    to a sample of at most ``SAMPLE`` pages of this table, each of at most
    ``LONGEST`` characters.
    """
    if field is None:
        field = fit(training_pages(sampled(pages)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page in batch.column("html"):
                blocks = leaf_blocks(page.as_py())
                texts.append(" ".join(b.text for b, main in zip(blocks, field.decode(blocks), strict=True) if main))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
