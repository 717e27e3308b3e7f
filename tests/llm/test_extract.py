"""Extraction: odd markup, what decides where the article stands, alignment against brute force, templates of many pages."""

import random
from itertools import combinations

from sievewright.llm import extract

STORY = "The council met on Tuesday and spoke about the bridge. " * 8


def text_of(html):
    return "\n".join(t for _, t, _ in extract.Page(html).candidates())


def test_deep_pages():
    n = 5000
    assert text_of("<div>" * n + "deep" + "</div>" * n) == "deep"
    page = "<div>x" * n
    assert text_of(page) == "\n".join("x" * n)
    shape = extract.Page(page).shape()
    assert all(path == slot for path, slot in extract.aligned(shape, shape)) and len(shape.split("\n")) == n


def test_names_of_containers():
    for page in (
        f'<body class="single no-sidebar"><p>{STORY}</p>', f'<div class="content with-sidebar"><p>{STORY}</p></div>', f'<article class="market-share"><p>{STORY}</p></article>',
        f'<div class="sidebar"><article><p>{STORY}</p></article></div>', f"<div id=content><p>{STORY}</p></div><article><p>A teaser</p></article>",
        f'<article><p>{STORY}</p><div class="share">Share this</div><section class="comments"><p>Nice</p></section><article>A reply</article></article>',
        f'<main><div class="comment-list"><p>Well said</p></div><p>{STORY}</p></main>', f'<div class="cookie-notice">We use cookies</div><p>{STORY}</p><div id="site-footer">Imprint</div>',
    ):
        assert text_of(page) == STORY.strip(), page
    assert text_of(f"<p>{STORY}</p><p><a href=x>A paragraph that is a link</a></p><ul><li><a href=y>Menu</a></ul>") == STORY.strip() + "\nA paragraph that is a link"
    short = "<div class=ad>An advert that is longer than all of the article</div><article><p>Short.</p><div class=comments>And a long comment on it</div></article>"
    assert text_of(short) == "Short."
    assert text_of('<p class="comments">All that there is</p>') == "All that there is"


def test_odd_attributes():
    assert text_of("<article><p data-t=it's>one</p><p>two</p><p>don't stop</p></article>") == "one\ntwo\ndon't stop"
    assert text_of('<p title="x>Hello</p>') == "Hello" and text_of('<p title="x>Hello</p><div class="foo">more</div>') == "Hello\nmore"
    assert text_of('<p title="a > b" data-x=\'c > d\'>one</p><br/><p a=1 b = "2"c>two</p>') == "one\ntwo"
    assert text_of("1 < 2 and 3 > 2 <!-- no <p> --> &amp;&#x41;&eacute; <!-- open") == "1 < 2 and 3 > 2 &Aé"
    assert text_of('<p data-x="class=\'nav\'">kept</p>') == "kept" and text_of("") == "" and text_of("<b>bold <i>text") == "bold text"


def test_rising_subsequence():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randrange(8)
        places, weights = rng.sample(range(20), n), [rng.randrange(1, 9) for _ in range(n)]
        rising = [c for k in range(n + 1) for c in combinations(range(n), k) if all(places[a] < places[b] for a, b in zip(c, c[1:]))]
        got = extract.heaviest_rising(places, weights)
        assert tuple(got) in rising and sum(weights[i] for i in got) == max(sum(weights[i] for i in c) for c in rising)


def random_tree(rng, depth=3):
    return {name: random_tree(rng, depth - 1) if depth else {} for name in rng.sample("abcdef", rng.randrange(4))}


def lines(tree, path=(), up=-1, out=None):
    out = [] if out is None else out
    for name, below in tree.items():
        out.append(f"{up} {extract.hash64(*(x.encode() for x in (*path, name))):x}")
        lines(below, (*path, name), len(out) - 1, out)
    return out


def matched(a, b):
    """Simple tree matching by its table, without what unique siblings save."""
    a, b = list(a.items()), list(b.items())
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, (x, below) in enumerate(a):
        for j, (y, other) in enumerate(b):
            size[i + 1][j + 1] = max(size[i][j + 1], size[i + 1][j], size[i][j] + 1 + matched(below, other) if x == y else 0)
    return size[-1][-1]


def test_alignment():
    rng = random.Random(7)
    for _ in range(300):
        a, b = random_tree(rng), random_tree(rng)
        found = extract.aligned("\n".join(lines(a)), "\n".join(lines(b)))
        assert sum(path == slot for path, slot in found) == matched(a, b) and len({slot for _, slot in found}) == len(found)


def test_a_host_of_many_pages(spark):
    """Boilerplate without telling names on a host with a third of all pages; on another the same texts are content."""
    page = "<div>Our brand</div><div class='row-{0}'><p>Story {0} of {1}.</p><p>Written by our readers</p></div><div>All rights are ours</div>"
    rows = [(k, f"http://large.a/{k}", page.format(k, "large"), "k") for k in range(400)] + [(1000 + k, f"http://small{k}.a/", page.format(k, "small"), "k") for k in range(40)]
    rows += [(None, None, None, None), (5000, "odd url", "", None), (0, "http://large.a/0", page.format(0, "large"), "k")]
    got = extract.extract_articles(spark.createDataFrame(rows, "page_id long, url string, html string, template string")).collect()
    texts = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and all(texts[k] == f"Story {k} of large." for k in range(400)) and texts[None] == texts[5000] == ""
    assert all(texts[1000 + k] == f"Our brand\nStory {k} of small.\nWritten by our readers\nAll rights are ours" for k in range(40))
    assert all(r["n_chars"] == len(r["text"]) for r in got)
