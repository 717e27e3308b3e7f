"""What keeps work bounded where data are uneven, and that it loses nothing."""

import random
from collections import Counter

import numpy as np

from sievewright.llm import extract, packing, simhash, substring_dedup
from sievewright.llm.components import components


def test_packing_gives_up_few_pieces():
    rng = np.random.default_rng(4)
    for low, high in ((1100, 1700), (900, 1500), (700, 1100), (1300, 1420), (1, 4097)):
        lengths = np.sort(rng.integers(low, high, 4096))[::-1]
        which, offset, bins = packing.best_fit_decreasing(lengths.tolist(), 4096)
        room = 4096 - np.bincount(which, lengths, bins).astype(np.int64)
        again = packing.given_up(which, room, bins - packing.bound(lengths, 4096), 4096 // packing.FAN)
        assert again[which].sum() <= 4096 // packing.FAN


def test_packing_levels(spark):
    rng = np.random.default_rng(5)
    lengths = rng.integers(1100, 1700, 6000).tolist()
    df = spark.createDataFrame([(k % 10 or None, 0, 0, n, 7) for k, n in enumerate(lengths)], "id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack_pieces(df, group_size=256).collect()
    assert Counter(r["length"] for r in rows) == Counter(lengths)
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in held.values():
        places.sort()
        assert [a for a, _ in places] == np.cumsum([0, *(n for _, n in places)])[:-1].tolist() and sum(places[-1]) <= 4096
    assert len(held) <= packing.best_fit_decreasing(sorted(lengths, reverse=True), 4096)[2] * 1.03


def test_hot_block_key(spark):
    """Fingerprints that all agree on three blocks, more than a cell holds, at every level of finer keys."""
    rng = random.Random(6)
    mask = simhash.mask_at(0, 4)
    fixed = rng.getrandbits(64) & mask
    near = [fixed | rng.getrandbits(64) & ~mask & (1 << 64) - 1 for _ in range(1500)]
    near += [x ^ (1 << rng.choice([b for b in range(64) if not mask >> b & 1])) for x in near[:300]]
    near += [near[7] ^ a ^ b for a in (1 << 60, 1 << 61, 1 << 62) for b in (1, 2, 4)]
    fps = list(dict.fromkeys(near))
    signed = {x: int(np.uint64(x).astype(np.int64)) for x in fps}
    found = simhash.link_forest(spark.createDataFrame([(x,) for x in signed.values()], "fp long"), cell=100)
    assert found.count() <= 30 * 35 * len(fps)
    root = {r["node"]: r["root"] for r in components(found).collect()}
    want = {x: x for x in fps}

    def find(x):
        while want[x] != x:
            x = want[x]
        return x

    a = np.array(fps, np.uint64)
    for i, x in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(a[:i] ^ np.uint64(x)) <= 4).tolist():
            want[find(x)] = find(fps[j])
    groups = {}
    for x in fps:
        groups.setdefault(find(x), set()).add(root.get(signed[x], signed[x]))
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)


def test_finer_masks_hold_every_link():
    rng = random.Random(8)
    for _ in range(200):
        flips = rng.sample(range(64), 4)
        diff = sum(1 << b for b in flips)
        paths = [k for k in range(35) if not simhash.mask_at(0, k) & diff]
        assert paths
        for level in (1, 2, 3):
            paths = [p * 15 + c for p in paths for c in range(15) if not simhash.mask_at(level, p * 15 + c) & diff][:3]
            assert paths


def test_texts_over_a_stretch(spark):
    """Texts that are longer than a stretch, repeats across its edges and periodic stretches."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    shared = [word(n) for n in (400, 700, 1500)]
    texts = [word(rng.randrange(1500)) + rng.choice(shared) + word(rng.randrange(1500)) + rng.choice(shared) for _ in range(12)] + ["ab" * 1500, "xab" * 900, word(5000)]
    rows = substring_dedup.repeated_substrings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), stretch=1000).collect()
    seen = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    for r in rows:
        t, gone = texts[r["id"]], np.zeros(len(texts[r["id"]]), bool)
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i : i + 400] = True
        assert bytes(r["kept"]).decode() == "".join(c for c, g in zip(t, gone, strict=True) if not g)


def test_last_stretch_under_a_string(spark):
    """Last stretches of 1 to 402 bytes, which may hold a cell's core but no whole string, and a repeat that ends there."""
    data = np.random.default_rng(1).integers(97, 123, 2402).astype(np.uint8)
    for tail in (1, 199, 200, 300, 399, 400, 402):
        text = data[: 2000 + tail]
        places = np.arange(len(text) - substring_dedup.HALF + 1)
        assert (substring_dedup._at(text, 0, 1000, [places], [])[0] == substring_dedup._lanes(text, 0)[0]).all()
    word = lambda n: "".join(map(chr, data[:n]))
    texts = [word(2300), "X" + word(2300)[1300:], "Y" + word(2300)[1600:], "Z" + word(2300)[1850:] + "Z"]
    rows = substring_dedup.repeated_substrings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), stretch=1000).collect()
    assert sorted((r["id"], r["n_removed"], r["n_spans"]) for r in rows) == [(0, 1000, 1), (1, 1000, 1), (2, 700, 1), (3, 450, 1)]


def test_template_alone_decides(spark):
    """Boilerplate in plain elements without telling names, between and around the paragraphs, on pages of unlike trees."""
    rng = random.Random(11)
    rows, want = [], {}
    for host in range(3):
        fixed = [f"{w} of host {host}" for w in ("brand", "offices", "terms", "imprint", "our readers say that this site is theirs")]
        for k in range(8):
            own = [f"paragraph {host} {k} {j} {rng.random()}" for j in range(rng.randrange(2, 6))]
            extra = f"<section><div>{fixed[3]}</div></section>" if k % 2 else ""
            body = "".join(f"<p>{p}</p>" for p in own)
            html = f"<body><div><div>{fixed[0]}</div><div>{fixed[1]}</div></div>{extra}<div>{body}<p>{fixed[4]}</p></div><div><div>{fixed[2]}</div></div></body>"
            rows.append((host * 100 + k, f"http://host{host}.test/{k}", html))
            want[host * 100 + k] = "\n".join(own)
        rows += [(host * 100 + 50 + j, f"http://copies{host}.test/{j}", rows[-1][2]) for j in range(3)]
    got = {r["page_id"]: r["text"] for r in extract.extract_articles(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: got[i] for i in want} == want
    assert all(want[h * 100 + 7] in got[h * 100 + 50 + j] for h in range(3) for j in range(3))  # three equal pages keep their text


def test_inline_and_captions():
    page = "<article><p>one <img src=x> two<wbr>three <svg><path/></svg>four<br>five</p><figure><img src=y><figcaption>caption</figcaption></figure></article>"
    assert [t for _, t, _ in extract.Page(page).candidates()] == ["one twothree four", "five", "caption"]
