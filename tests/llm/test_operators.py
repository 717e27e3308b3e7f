"""Operators against brute force, and nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import random
from collections import Counter

import numpy as np
import pytest

from sievewright.llm import chat, decontaminate, extract, line_dedup, media, packing, quality, simhash, substring_dedup, token_counts
from sievewright.llm.components import components

public_tokenizers = pytest.importorskip("public_tokenizers")
LONG = "lorem ipsum dolor " * 20000
ODD = [(1, None), (2, ""), (3, "a\nb\nc\nd"), (4, "x\na\nb\nc"), (4, "x\na\nb\nc"), (None, "a\nb\nc"), (6, LONG), (7, "héllo wörld ½ 日本")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "k", 0) for i, t in ODD], "doc_id long, text string, w_key string, n_lines int")


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def vocabulary(name):
    return public_tokenizers.path(name)


def test_lines(spark, odd, none):
    got = {(r["doc_id"], r["text"], r["n_removed"]) for r in line_dedup.line_window_dedup(odd).collect()}
    assert (None, "a\nb\nc", 0) in got and (3, "d", 3) in got and (4, "x", 3) in got and (1, "", 0) in got and (6, LONG, 0) in got
    assert line_dedup.line_window_dedup(none).count() == 0


def test_simhash(spark, odd, none):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = list({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (1 << 64) - 1 for b in base for _ in range(12)})
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for cell in (20_000, 6):  # the second deals hot keys into cells
        root = {r["node"]: r["root"] for r in components(simhash.link_forest(df, cell)).collect()}
        group = {x: root.get(s, s) for x, s in zip(fps, signed, strict=True)}
        want = {x: x for x in fps}

        def find(x, want=want):
            while want[x] != x:
                x = want[x]
            return x

        for i, a in enumerate(fps):
            for b in fps[:i]:
                if (a ^ b).bit_count() <= 4:
                    want[find(a)] = find(b)
        assert len({(group[x], find(x)) for x in fps}) == len({find(x) for x in fps}) == len(set(group.values()))
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD) and {r["component"] for r in got if r["fp"] == 0} == {1}
    assert simhash.near_duplicates(none).count() == 0


def test_substrings(spark, odd, none):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [word(n) for n in (399, 400, 401, 900, 250)]
    texts = [word(rng.randrange(300)) + rng.choice(shared) + word(rng.randrange(500)) + rng.choice(shared) for _ in range(60)] + ["", None, "ab" * 700, "ab" * 500, shared[1], word(3000)]
    rows = substring_dedup.repeated_substrings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 400] for b in raw for i in range(len(b) - 399))
    for r in rows:
        b = raw[r["id"]]
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        assert bytes(r["kept"]) == bytes(x for x, g in zip(b, gone, strict=True) if not g) and r["n_removed"] == gone.sum()
    row = "".join(random.Random(3).choices("abcdefgh", k=900))
    twice = spark.createDataFrame([(1, row), (1, row), (1, row[:300] + "x" + row[300:600]), (None, row[:399]), (None, row[:399])], "doc_id long, text string")
    assert sorted(tuple(r)[1:4] for r in substring_dedup.repeated_substrings(twice).collect()) == [(399, 0, 0), (399, 0, 0), (601, 0, 0), (900, 900, 1), (900, 900, 1)]
    assert substring_dedup.repeated_substrings(odd).count() == len(ODD) and substring_dedup.repeated_substrings(none).count() == 0


def test_decontamination(spark, odd, none):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(1, f"say {item} now"), (2, f"say {item.replace('delta', 'x').replace('eta th', 'y th')} now"), (3, "alpha beta say zeta eta none"), (4, None), (5, item), (5, item)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, "too short"), (9, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.benchmark_matches(docs, items).collect()}
    assert got == {(1, 7, 0), (2, 7, 2), (5, 7, 0)} or got == {(1, 7, 0), (2, 7, 1), (5, 7, 0)}
    assert decontaminate.benchmark_matches(odd, items.where("false")).count() == 0 and decontaminate.benchmark_matches(none, items).count() == 0


def test_packing(spark, odd, none):
    rows = packing.pack_documents(odd, vocabulary("word_bpe_49k.json"), 64).collect()
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:], strict=False)) and sum(p[-1]) <= 64
    assert packing.pack_documents(none, vocabulary("word_bpe_49k.json")).count() == 0
    sizes = sorted((random.Random(3).randrange(1, 65) for _ in range(400)), reverse=True)
    assert packing.bound(np.array(sizes), 64) <= packing.best_fit_decreasing(sizes, 64)[2] <= 1.1 * packing.bound(np.array(sizes), 64)


def test_token_counts(spark, odd, none):
    pieces = [bytes([c]) for c in range(256)] + [b"ab", b"abc", b"bcd", b"abcde", b" a", b"cc"]
    match, rng = token_counts.LongestMatch(pieces), random.Random(4)
    for _ in range(300):
        w = bytes(rng.choice(b" abcde") for _ in range(rng.randrange(12)))
        n = i = 0
        while i < len(w):
            i += next(k for k in range(5, 0, -1) if w[i : i + k] in pieces and len(w[i : i + k]) == k)
            n += 1
        assert match.count(w) == n
    got = token_counts.token_counts(odd, vocabulary("byte_bpe_50k.tiktoken")).collect()
    assert len(got) == len(ODD) and {r["n_tokens"] for r in got if r["id"] in (1, 2)} == {0}
    assert token_counts.token_counts(none, vocabulary("byte_bpe_50k.tiktoken")).count() == 0


def test_media(spark, odd, none):
    samples = np.random.default_rng(5).integers(0, 256, (7, media.SAMPLES), dtype=np.uint8)
    samples[3] = 255
    data, n = media.encode_frames(samples)
    ends = np.cumsum(n)
    pictures = [data.tobytes()[a:b] for a, b in zip(ends - n, ends, strict=True)]
    assert (media.decode_frames(media.read_avi(media.write_avi(pictures))) == samples).all()
    files = media.encode_media(odd)
    assert {r["payload_bytes"] for r in media.read_media(files).where("id IN (1, 2)").collect()} == {576}
    assert media.clips(files).where("clip = 0").count() == len(ODD) and media.read_media(media.encode_media(none)).count() == 0


def test_chat(spark):
    rows = [(1, 1, None, "user", "<|hi|> \\ </s>", 1.0), (1, 2, 1, "assistant", "[INST]", 0.0), (1, 3, 1, "assistant", None, 5.0), (1, 4, 3, None, "z", 1.0), (2, 1, 9, "user", "lone", None), (3, 1, 2, "user", "x", 1.0), (3, 2, 1, "user", "y", 1.0), (None, 1, None, "user", "n", 1.0), (2, 1, 9, "user", "lone", None)]
    df = spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, role string, text string, score double")
    got = {r["tree_id"]: r for r in chat.format_reply_trees(df).withColumn("turns", chat.parse_formatted(chat.F.col("formatted"))).collect()}
    assert set(got) == {1, 2, None} and got[1]["leaf_id"] == 4  # tree 3 is a cycle
    assert [tuple(t) for t in got[1]["turns"]] == [("user", "<|hi|> \\ </s>"), ("assistant", ""), ("user", "z")]
    assert chat.format_reply_trees(df.where("false")).count() == 0


def test_quality(spark, odd, none):
    docs = spark.createDataFrame([(i, "plain words in a row here" if i % 2 else "JUNK!! $$$ JUNK!! $$$") for i in range(60)], "doc_id long, text string")
    marks = docs.selectExpr("doc_id", "doc_id % 2 AS label")
    model = quality.fit(docs, marks)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert min(v for k, v in got.items() if k % 2) > max(v for k, v in got.items() if not k % 2)
    assert quality.score(odd, model, keep=True).count() == len(ODD) and quality.score(none, model).count() == 0
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, marks.where("false"))).collect()} == {0.5}


def test_extract(spark):
    page = "<html><nav>menu</nav><div>Site of ours</div><p>One &amp; <b>two</b>\n three<p>four<div class='comments'>c</div><footer>f</footer>"
    rows = [(1, "http://a.b/1", page), (2, "http://a.b/2", page.replace("One", "Uno").replace("four", "quatre")), (3, "http://a.b/3", page.replace("One", "Eins").replace("four", "vier")), (4, None, None), (None, "x", "<article><h1>T</h1>t</article>")]
    got = {r["page_id"]: r["text"] for r in extract.extract_articles(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "One & two three\nfour", 2: "Uno & two three\nquatre", 3: "Eins & two three\nvier", 4: "", None: "T\nt"}
    assert extract.extract_articles(spark.createDataFrame(rows, "page_id long, url string, html string").where("false")).count() == 0
