"""Every opN_ query on the smallest tables against a plain Python version of its contract."""

import hashlib
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow.parquet as pq
import pytest

from sievewright.llm import decontaminate, packing, quality, simhash
from sievewright.llm.queries import QUERIES

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def given(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def texts():
    return {r["doc_id"]: r["text"] or "" for r in given("documents")}


def result(spark, name):
    return QUERIES[name](spark, SF).collect()


def test_op1(spark, texts):
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in result(spark, "op1_decontamination")}
    want = {}
    for i, text in texts.items():
        words = decontaminate.normal(text)
        for item in given("benchmark"):
            own = decontaminate.normal(item["text"])
            most = decontaminate.edits_allowed(len(own), 0.8)
            if sum((Counter(own) - Counter(words)).values()) <= most:  # else no stretch can do
                edits, _ = decontaminate.best_match(own, words)
                if edits <= most:
                    want[i, item["item_id"]] = edits
    assert want and set(got) <= set(want) and all(got[k] == want[k] for k in got)
    assert len(got) >= 0.95 * len(want) and all(k in got for k, edits in want.items() if edits == 0)


def test_op2(spark, texts):
    rows = result(spark, "op2_quality_classifier")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.quality_model(docs, spark, SF)
    assert {r["doc_id"] for r in rows} == set(texts)
    lift = np.concatenate([model.word, model.pair]).astype(float)
    marks = {r["doc_id"]: r["quality"] for r in given("labels")}
    right = []
    for r in rows:
        ids, share = quality.features(texts[r["doc_id"]])
        assert abs(r["score"] - 1 / (1 + np.exp(-(share @ lift[ids] + model.bias)))) < 1e-4
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7)
        if r["held_out"] and r["doc_id"] in marks:
            right.append(r["predicted"] == marks[r["doc_id"]])
    assert np.mean(right) > 0.9


class Article(HTMLParser):
    """Texts of the blocks inside <article>, for pages that close what they open there."""

    ASIDE = "nav header footer aside form script style ul".split()

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside = self.aside = 0
        self.blocks = [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.aside += tag in self.ASIDE or tag == "div"
        if tag in ("p", "br", "h1", "h2", "li", "div", "article"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.aside -= tag in self.ASIDE or tag == "div"
        if tag in ("p", "h1", "h2", "li", "div", "article"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside and not self.aside:
            self.blocks[-1] += data


def test_op4(spark):
    pages = {r["page_id"]: r["html"] or "" for r in given("pages")}
    rows = result(spark, "op4_html_extraction")
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    for r in rows:
        plain = Article()
        plain.feed(pages[r["page_id"]])
        plain.close()
        assert r["text"] == "\n".join(b for b in (" ".join(x.split()) for x in plain.blocks) if b)
        assert r["n_chars"] == len(r["text"])


def test_op5(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, text in texts.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[i, k // 4096] = k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())
    rows = result(spark, "op5_best_fit_packing")
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in held.values():
        places.sort()
        assert [a for a, _ in places] == np.cumsum([0, *(n for _, n in places)])[:-1].tolist() and sum(places[-1]) <= 4096
    assert len(held) <= packing.bound(np.array([n for _, n, _ in want.values()]), 4096) + 1


def test_op6(spark, texts):
    for r in result(spark, "op6_media_columns"):
        raw = texts[r["doc_id"]].encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        frames = [Counter(x >> 4 for x in payload[k : k + 576]) for k in range(0, len(payload), 576)]
        change = [sum(abs(a[g] - b[g]) for g in range(16)) / 1152 for a, b in zip(frames, frames[1:], strict=False)]
        mean = sum(change) / max(1, len(change))
        deviation = max(sum(c * c for c in change) / max(1, len(change)) - mean * mean, 0) ** 0.5
        shots = [k for k, c in enumerate(change, 1) if c > mean + 2 * deviation + 1e-9]
        assert r["feature"] == f"frames={len(frames)};shots={len(shots) + 1};cuts={','.join(map(str, shots))}"
        edges = [0, *shots, len(frames)]
        assert [(c["start_ms"], c["end_ms"]) for c in r["clips"]] == [(a * 40, b * 40) for a, b in zip(edges, edges[1:], strict=False)]


def repeats(raw, length=400):
    """Of each byte string the bytes that stay, and the number of removed runs."""
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    for b in raw:
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i + 1 : i + length + 1] = True
        yield bytes(x for x, g in zip(b, gone[1:], strict=False) if not g), int((gone[1:] & ~gone[:-1]).sum())


def test_op7(spark, texts):
    rows = {r["doc_id"]: r for r in result(spark, "op7_suffix_array_dedup")}
    assert set(rows) == set(texts)
    for (i, text), (kept, spans) in zip(texts.items(), repeats([t.encode() for t in texts.values()]), strict=True):
        n = len(text.encode())
        assert tuple(rows[i])[1:] == (n, n - len(kept), spans, hashlib.sha256(kept).hexdigest())


def plain_fingerprint(text):
    from xxhash import xxh64_intdigest

    words, word = [], ""
    for c in text + " ":
        if c in " \t\n\v\f\r":
            words += [word] * bool(word)
            word = ""
        else:
            word += c.lower() if c.isascii() else c
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    bits = [sum(h >> b & 1 for h in (xxh64_intdigest(s.encode(), 42) for s in shingles)) for b in range(64)]
    return sum((2 * n > len(shingles)) << b for b, n in enumerate(bits)) if shingles else 0


def test_op8(spark, texts):
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert all(simhash.fingerprint(t) == fps[i] for i, t in texts.items())
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in result(spark, "op8_simhash_dedup")}
    assert got == {i: (f"{fps[i]:016x}", find(i)) for i in ids}


def test_op9(spark, texts):
    import base64

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        pieces = {base64.b64decode(line.split()[0]) for line in f if line.strip()}
    longest = max(map(len, pieces))

    def count(word):
        n = i = 0
        while i < len(word):
            i += next(k for k in range(min(longest, len(word) - i), 0, -1) if word[i : i + k] in pieces)
            n += 1
        return n

    for r in result(spark, "op9_token_counts"):
        words = Counter(texts[r["doc_id"]].split())
        assert (r["n_words"], r["n_tokens"]) == (sum(words.values()), sum(n * count(b" " + w.encode()) for w, n in words.items()))


def test_op10(spark):
    turns = {-7: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for r in given("conversations"):
        turns.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = {r["conv_id"]: r for r in result(spark, "op10_chat_format")}
    assert set(rows) == set(turns)
    for i, said in turns.items():
        said.sort()
        loss = "".join(t for _, role, t in said if role == "assistant")
        r = rows[i]
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(said), len(loss), digest(loss))
        assert r["turns_sha256"] == digest("".join(f"{role}\n{t}\n" for _, role, t in said)) and r["formatted_chars"] > sum(len(t) for *_, t in said)
