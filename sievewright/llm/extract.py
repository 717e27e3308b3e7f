"""HTML extraction by wrapper induction.

Every page is parsed once. Its elements become a small tree: tags with their classes, siblings of one kind folded into one node
(lists and paragraphs repeat). Pages of a host mostly share a few such trees, so trees are counted per host, the most frequent
one is the host's reference, and every other tree of the host is aligned to it once by simple tree matching, however many
pages have it. Each text block then has a slot of the reference. A text that fills its slot on at least half of three or more
pages is template; what varies is content, unless its place says otherwise: navigation, forms, adverts, comments and the
like may vary as well. Pages of a host with the same article, under whatever boilerplate, count as one page, so a page that is
repeated is no template of itself.

The parsed pages are stored: hashes of trees, paths and texts, and the text of the blocks that stand where articles stand.
Only texts that a host has three times go into the alignment. Templates meet the pages block by block, by host, path and text
together, so a host of any number of pages has no row, task or copy of its templates to itself.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .shared import settle, slices, table, text_of

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
#: Elements that are never part of the article, by what HTML says of them.
ASIDE = frozenset("nav header footer aside form button select dialog menu head label option".split()) | RAW
#: Elements whose names say nothing of their content.
WHOLE = frozenset("html body main article".split())
PROSE = frozenset("p blockquote pre dd figcaption h1 h2 h3 h4 h5 h6".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var math mi mn mo ms mtext mrow mfrac msqrt msup msub picture svg g path rect circle ellipse line polygon polyline text tspan".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ENDS = {**dict.fromkeys(CLOSES_P, "p"), **{t: t for t in ("li", "tr", "td", "th", "dt", "dd", "option")}}
#: A value ends at its quote where an attribute can end there; else the quote is a stray one and the value ends at white space.
VALUE = r"=\s*(?:\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>])|[^\s>]*)"
MARK = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|{VALUE})*+)(?:>|\Z)", re.S)
NAMED = re.compile(r"([^\s=>/\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
#: Words that name boilerplate: as a whole class, id or role, and as the first or last part of a compound one.
BOILER = frozenset("ad ads banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu nav navbar navigation newsletter notice popup promo promos related replies reply share sharing sidebar social sponsor sponsored subscribe toolbar widget widgets advert adverts advertisement contentinfo complementary search".split())
FIRST = BOILER - frozenset("header notice reply search subscribe".split())
LAST = frozenset("ad ads banner breadcrumb breadcrumbs comments footer menu nav navbar navigation newsletter notice popup sidebar toolbar widget advert".split())
NEGATIVE = frozenset("no not non with without has hide".split())
SPACE = re.compile(r"\s+")
DIGITS = re.compile(r"\d+")


def hash64(*parts: bytes) -> int:
    return xxh64_intdigest(b"\0".join(parts))


@lru_cache(100_000)
def telling(names: str) -> int:
    """Whether one of the names (classes, ids, roles) is one of boilerplate: 2 if all of it is, 1 if its first or last part is."""
    found = 0
    for name in names.lower().split():
        parts = re.split(r"[-_]+", name.strip("-_"))
        if name in BOILER:
            return 2
        if len(parts) > 1 and parts[0] not in NEGATIVE and (parts[0] in FIRST or parts[-1] in LAST):
            found = 1
    return found


class Page:
    """The elements that aren't inline, each after its parent (-1: none), and the text blocks: element, text, whether all of it
    is links."""

    def __init__(self, html: str):
        self.tag: list[str] = []
        self.names: list[str] = []
        self.parent: list[int] = []
        self.path: list[int] = []
        self.blocks: list[tuple[int, str, bool]] = []
        self._parse(html)

    def _open(self, tag: str, names: str, parent: int) -> int:
        name = f"{tag}.{DIGITS.sub('#', names)}" if names else tag
        self.tag.append(tag)
        self.names.append(names)
        self.parent.append(parent)
        self.path.append(hash64(self.path[parent].to_bytes(8, "little") if parent >= 0 else b"", name.encode("utf-8", "surrogatepass")))
        return len(self.tag) - 1

    def _parse(self, html: str) -> None:
        stack: list[int] = []
        held: Counter = Counter()  # open elements by tag
        parts: list[str] = []
        links = [0, 0]  # characters outside and inside links
        link_at = None  # depth of the stack at which a link was opened
        at = 0

        def flush() -> None:
            if parts:
                text = SPACE.sub(" ", unescape("".join(parts))).strip()
                parts.clear()
                if text:
                    self.blocks.append((stack[-1] if stack else -1, text, links[0] == 0))
                links[:] = 0, 0

        def close(depth: int) -> None:
            nonlocal link_at
            for x in stack[depth:]:
                held[self.tag[x]] -= 1
            del stack[depth:]
            if link_at is not None and link_at > depth:
                link_at = None

        while True:
            m = MARK.search(html, at)
            text = html[at : m.start() if m else len(html)]
            if text:
                parts.append(text)
                links[link_at is not None] += len(text.strip())
            if not m:
                break
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                if tag == "a":
                    link_at = None
                elif tag == "p" and not held["p"]:
                    flush()
                elif tag not in INLINE:
                    flush()
                    if held[tag]:
                        close(next(k for k in range(len(stack) - 1, -1, -1) if self.tag[stack[k]] == tag))
                continue
            if tag in RAW:
                end = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(html, at)
                at = end.end() if end else len(html)
                continue
            if tag in INLINE:
                if tag == "a":
                    link_at = len(stack)
                continue
            if tag in VOID and tag not in ("br", "hr"):  # a picture or a field stands inside its block
                continue
            flush()
            if tag in VOID:
                continue
            ends = ENDS.get(tag)
            if ends and stack and self.tag[stack[-1]] == ends:  # an element that ends where the next one begins
                close(len(stack) - 1)
            names = ""
            if "=" in m[3]:
                names = SPACE.sub(" ", " ".join(next(filter(None, g[1:]), "") for g in NAMED.findall(m[3]) if g[0].lower() in ("class", "id", "role"))).strip()
            stack.append(self._open(tag, names, stack[-1] if stack else -1))
            held[tag] += 1
        flush()

    def shape(self) -> str:
        """The folded tree of the elements that hold text: a line a node in order, its parent's line and its name; equal pages
        and pages that repeat elements have equal ones."""
        used = [False] * len(self.tag)
        for at, _, _ in self.blocks:
            while at >= 0 and not used[at]:
                used[at] = True
                at = self.parent[at]
        line: dict[int, int] = {}
        out = []
        for k, (path, up) in enumerate(zip(self.path, self.parent, strict=True)):
            if used[k] and path not in line:
                line[path] = len(out)
                out.append(f"{line[self.path[up]] if up >= 0 else -1} {path:x}")
        return "\n".join(out)

    def candidates(self) -> list[tuple[int, str, bool]]:
        """The blocks that stand where articles stand.

        Elements with a telling name are left out: where the page has an <article> (else <main>) they may not be around it, and
        where it has none they have to hold under half of the text. If articles hold a third of the text that is left, the blocks
        inside those of them count that are at least a quarter of the largest; else what stands outside of them.
        """
        n = len(self.tag)
        aside = [False] * (n + 1)  # the last is the page
        for k in range(n):
            aside[k] = self.tag[k] in ASIDE or aside[self.parent[k]]
        mass = self._mass(aside)
        for wanted in ("article", "main"):
            top = [-1] * (n + 1)  # the outermost wanted element around each one
            for k in range(n):
                up = top[self.parent[k]]
                top[k] = up if up >= 0 else k if self.tag[k] == wanted and not aside[k] else -1
            has = [k for k in range(n) if top[k] == k and mass[k]]
            if has:
                break
        holds = [0] * (n + 1)
        for k in has:
            holds[k] = 1
        for k in range(n - 1, -1, -1):
            holds[self.parent[k]] += holds[k]
        out = aside[:]
        for k in range(n):
            sure = self._named(k) if top[k] < 0 and (not has or holds[k] < len(has)) else 0
            out[k] = out[k] or out[self.parent[k]] or sure > 0 and (2 * mass[k] < mass[n] or bool(has) and sure == 2 and not holds[k])
        left = self._mass(out)
        inside = [k for k in has if not out[k]] or has
        if has and 3 * sum(mass[k] for k in inside) >= left[n]:
            most = max(mass[k] for k in inside)
            chosen = {k for k in inside if 4 * mass[k] >= most}
            out = self._inner(aside, mass, top, chosen)
            return [x for x in self.blocks if top[x[0]] in chosen and not out[x[0]]]
        rest = [x for x in self.blocks if top[x[0]] < 0 and not out[x[0]]]
        return [x for x in rest if not x[2] or x[0] >= 0 and self.tag[x[0]] in PROSE]  # a block of links alone, unless in prose, is a menu

    def _named(self, k: int) -> int:
        return telling(self.names[k]) if self.names[k] and self.tag[k] not in WHOLE else 0

    def _mass(self, out: list[bool]) -> list[int]:
        """Characters of each element, and of the page, that aren't links or in elements that are ``out``."""
        mass = [0] * (len(self.tag) + 1)
        for at, text, link in self.blocks:
            if not out[at] and not link:
                mass[at] += len(text)
        for k in range(len(self.tag) - 1, -1, -1):
            mass[self.parent[k]] += mass[k]
        return mass

    def _inner(self, aside: list[bool], mass: list[int], top: list[int], chosen: set[int]) -> list[bool]:
        """What isn't article inside the chosen elements: asides, elements with a telling name and articles in an article. One with
        half of the text or more stays, unless its whole name tells and the article has other text."""
        out = aside[:]
        for k in range(len(self.tag)):
            if top[k] in chosen and top[k] != k:
                sure = 1 if self.tag[k] == "article" else self._named(k)
                out[k] = out[k] or out[self.parent[k]] or sure > 0 and 2 * mass[k] < mass[top[k]] or sure == 2
        left = self._mass(out)
        if any(mass[k] and not left[k] for k in chosen):
            return aside
        return out


def heaviest_rising(places: list[int], weights: list[int]) -> list[int]:
    """Indexes of the heaviest subsequence of ``places`` (all different) that rises."""
    if all(a < b for a, b in zip(places, places[1:], strict=False)):
        return list(range(len(places)))
    ends: list[int] = []  # places at which a subsequence may end, with rising totals
    best: list[tuple[int, int]] = []  # of these the total and the index
    back: list[int] = []
    for k, (place, weight) in enumerate(zip(places, weights, strict=True)):
        at = bisect_left(ends, place)
        total = weight + (best[at - 1][0] if at else 0)
        back.append(best[at - 1][1] if at else -1)
        to = at
        while to < len(ends) and best[to][0] <= total:
            to += 1
        ends[at:to], best[at:to] = [place], [(total, k)]
    out, k = [], best[-1][1] if best else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def aligned(tree: str, reference: str) -> list[tuple[int, int]]:
    """Path and slot of each node of ``tree``: by simple tree matching the matched node's path in the reference, else a hash of the
    parent's slot and the node's own path.

    Siblings of a folded tree are all different, so a node can match the one of its own path alone; what the matching has to
    choose is which siblings keep their order, the heaviest rising subsequence of their places.
    """
    nodes = [(int(a), int(b, 16)) for a, b in (x.split(" ") for x in tree.split("\n") if x)]
    place = {int(x.split(" ")[1], 16): k for k, x in enumerate(reference.split("\n")) if x}
    children: dict[int, list[int]] = {}
    for k, (up, path) in enumerate(nodes):
        if path in place:
            children.setdefault(up, []).append(k)
    size, chosen = [1] * (len(nodes) + 1), set()
    for k in range(len(nodes) - 1, -2, -1):
        if own := children.get(k):
            kept = heaviest_rising([place[nodes[c][1]] for c in own], [size[c] for c in own])
            size[k] += sum(size[own[i]] for i in kept)
            chosen.update(own[i] for i in kept)
    out: list[tuple[int, int]] = []
    matched = [False] * len(nodes) + [True]
    for k, (up, path) in enumerate(nodes):
        matched[k] = matched[up] and k in chosen
        out.append((path, path if matched[k] else hash64(b"+", (out[up][1] if up >= 0 else 0).to_bytes(8, "little"), path.to_bytes(8, "little"))))
    return out


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _lists(values: list[list[int]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _signed([x for v in values for x in v]))


def _text_hash(text: str) -> int:
    return hash64(text.encode("utf-8", "surrogatepass"))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "html"):
        shapes, articles, paths, texts, own_paths, own_texts, said = ([] for _ in range(7))
        for html in part.column("html").to_pylist():
            page = Page(html)
            own = page.candidates()
            path_of = lambda at, page=page: page.path[at] if at >= 0 else 0
            seen = list({(path_of(at), _text_hash(text)): None for at, text, _ in page.blocks})
            shapes.append(page.shape())
            paths.append([p for p, _ in seen])
            texts.append([t for _, t in seen])
            own_paths.append([path_of(at) for at, _, _ in own])
            own_texts.append([_text_hash(t) for _, t, _ in own])
            said.append([t for _, t, _ in own])
            articles.append(hash64(*(t.encode("utf-8", "surrogatepass") for t in said[-1])))
        columns = [pa.array(shapes, pa.string()), _signed([hash64(x.encode()) for x in shapes]), _signed(articles), *map(_lists, (paths, texts, own_paths, own_texts)), pa.array(said, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("page_id", "url", "host")), *columns], names=["page_id", "url", "host", "shape", "tree", "article", "paths", "texts", "own_paths", "own_texts", "said"])


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            found = aligned(batch.column("shape")[k].as_py(), batch.column("reference_shape")[k].as_py())
            if found:
                path, slot = zip(*found, strict=True)
                take = pa.array([k] * len(found), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("tree").take(take), batch.column("reference").take(take), _signed(path), _signed(slot)], names=["tree", "reference", "path", "slot"])


def templates(parsed: DataFrame, share: float = 0.5, least: int = 3) -> DataFrame:
    """``(host, path, text)``: the texts that are template on ``parsed`` pages, by the paths at which they stand."""
    blocks = parsed.select("host", "article", "tree", F.inline(F.arrays_zip("paths", "texts"))).withColumnsRenamed({"paths": "path", "texts": "text"})
    often = settle(blocks.groupBy("host", "text").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("host", "text"), "often")
    once = blocks.join(often, ["host", "text"], "left_semi").groupBy("host", "article", "path", "text").agg(F.min("tree").alias("tree"))  # of an article's copies, one
    texts = once.groupBy("host", "tree", "path", "text").agg(F.count(F.lit(1)).alias("n"))
    pages = parsed.groupBy("host", "article").agg(F.min("tree").alias("tree")).groupBy("host", "tree").agg(F.count(F.lit(1)).alias("n"))
    pages = settle(pages.join(often.select("host").distinct(), "host", "left_semi"), "host-trees")
    reference = pages.groupBy("host").agg(F.max(F.struct("n", "tree")).alias("x")).select("host", F.col("x.tree").alias("reference"))
    pages = settle(pages.join(reference, "host"), "host-references")
    shapes = parsed.groupBy("tree").agg(F.min("shape").alias("shape"))
    pairs = pages.select("tree", "reference").distinct().join(shapes, "tree").join(shapes.withColumnsRenamed({"tree": "reference", "shape": "reference_shape"}), "reference")
    slots = settle(pairs.select("tree", "reference", "shape", "reference_shape").mapInArrow(_align, "tree long, reference long, path long, slot long"), "slots")
    outside = pages.select("host", "tree", "n", F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("slot"))  # text in no element
    placed = pages.join(slots, ["tree", "reference"]).select("host", "tree", "n", "path", "slot").unionByName(outside)
    pages_of = placed.groupBy("host", "slot").agg(F.sum("n").alias("pages"))
    counts = texts.join(placed.select("host", "tree", "path", "slot"), ["host", "tree", "path"]).groupBy("host", "slot", "text").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    constant = counts.join(pages_of, ["host", "slot"]).where(F.col("n") >= F.col("pages") * F.lit(share)).select("host", "slot", "text")
    return constant.join(placed.select("host", "slot", "path").distinct(), ["host", "slot"]).select("host", "path", "text").distinct()


def extract_articles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` per row of ``pages``: the main text, blocks joined by a line feed.

    Null and empty pages have an empty text; null or odd urls are one host of their own name; repeated rows keep a row each
    (copies of an article count as one page of the host); ids may be null; extra columns are ignored, so none can clash; no pages
    give no rows. Pages may be of any length and nested as deep as they like. Character references are decoded and white space
    inside a block is one space. A host with under three different articles has no template; a text that half of a
    host's articles have in the same slot is template even inside an article, unless nothing else would be left of the page.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    url = pages[url_col].cast("string")
    host = F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    source = pages.select(pages[id_col].alias("page_id"), url.alias("url"), host.alias("host"), text_of(pages, html_col).alias("html"))
    parsed = source.mapInArrow(_parsed, f"page_id {kind}, url string, host string, shape string, tree long, article long, paths array<long>, texts array<long>, own_paths array<long>, own_texts array<long>, said array<string>")
    parsed = settle(parsed.withColumn("uid", F.monotonically_increasing_id()), "parsed")  # stored, so the numbers stay
    own = parsed.select("uid", "host", F.posexplode(F.arrays_zip("own_paths", "own_texts")).alias("pos", "x")).select("uid", "host", "pos", F.col("x.own_paths").alias("path"), F.col("x.own_texts").alias("text"))
    known = settle(templates(parsed), "templates")
    gone = own.join(known, ["host", "path", "text"], "left_semi").groupBy("uid").agg(F.collect_set("pos").alias("gone"))  # of a page's own blocks
    gone = settle(gone, "template-blocks")
    joined = parsed.select("uid", "page_id", "url", "said").join(gone, "uid", "left")
    left = F.filter("said", lambda x, i: ~F.array_contains("gone", i))
    text = F.array_join(F.when(F.col("gone").isNull() | (F.size("gone") == F.size("said")), F.col("said")).otherwise(left), "\n")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_articles(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
