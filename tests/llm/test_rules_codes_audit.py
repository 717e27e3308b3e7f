"""Quality rules, vector codes and the filter audit against plain Python, on the supplied tables and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest

from sievewright.llm import filter_audit, quality_rules, vector_codes
from sievewright.llm.queries import QUERIES

from .test_contracts import SF, given

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor " * 20000


def plain_counts(text):
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    repeated = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:k] for k, x in enumerate(lines)), len(repeated)


def test_op11(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in given("documents")}
    marks = {r["doc_id"]: r["quality"] for r in given("labels")}
    rows = QUERIES["op11_quality_rules"](spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        if len(texts[r["doc_id"]]) < 12_000:
            assert tuple(r[c] for c in quality_rules.COUNTS) == plain_counts(texts[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["kept"] and r["base_failed"])
    told = [r["kept"] == marks[r["doc_id"]] for r in rows if not r["base_failed"] and r["doc_id"] in marks and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert np.mean(told) > 0.95


def test_counts_of_odd_texts(spark):
    texts = [None, "", " \n\t ", "a b a b a b", "x\nx\n x\n\nx", "a b 　 c\x1cd", "héllo #1 <b> | & ½ 日本", "a b c a b c", LONG, "w" * 300_000, "a b a b a b"]
    docs = spark.createDataFrame([(k if k != 1 else None, t, 1.0) for k, t in enumerate(texts)], "doc_id long, text string, n_words double")
    got = {r["id"]: tuple(r[c] for c in quality_rules.COUNTS) for r in quality_rules.document_statistics(docs).collect()}
    assert got == {k if k != 1 else None: plain_counts(t or "") if t != LONG else (60000, 300000, 0, 0, 60000) for k, t in enumerate(texts)}
    rules = quality_rules.quality_rules(docs, spark.createDataFrame([], "doc_id long, label int"))
    assert {r["score"] for r in rules.collect()} == {0.5} and all(r["kept"] != r["base_failed"] for r in rules.collect())
    assert quality_rules.quality_rules(docs.where("false"), spark.createDataFrame([(1, 1)], "doc_id long, label int")).count() == 0


def test_trees_are_monotone():
    rng = np.random.default_rng(2)
    x = rng.uniform(size=(3000, 3))
    y = (x[:, 0] + 0.5 * np.sin(9 * x[:, 1]) + 0.1 * rng.normal(size=3000) < 0.6).astype(float)
    forest = quality_rules.boost(x, y, np.array([-1, 0, 1]), trees=40)
    assert np.mean((forest.score(x) >= 0.5) == y) > 0.85
    for f, sign in ((0, -1), (2, 1)):
        at = np.repeat(rng.uniform(size=(50, 3)), 200, axis=0)
        at[:, f] = np.tile(np.linspace(0, 1, 200), 50)
        steps = np.diff(forest.score(at).reshape(50, 200), axis=1)
        assert (sign * steps >= -1e-12).all()
    some = x[:20]
    for row, score in zip(some, forest.score(some), strict=True):  # a walk along single nodes
        total = forest.base
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
            total += forest.value[node]
        assert abs(score - 1 / (1 + math.exp(-total))) < 1e-12
    assert quality_rules.boost(x[:0], y[:0], np.zeros(3)).score(x).tolist() == [0.5] * 3000


def plain_codes(rows):
    """Codes, errors by part and codebooks of ``(id, label, vector)`` in Python integers."""
    rows = [r for r in rows if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    width = -(-max((len(v) for *_, v in rows), default=0) // 4)
    cut = lambda v: [[v[p * width + k] if p * width + k < len(v) else 0 for k in range(width)] for p in range(4)]
    whole = [(i, label, cut([math.floor(x * 1024) if abs(x) < 1e15 else int(x) * 1024 for x in v])) for i, label, v in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][2]))[:256]
    books = [[whole[k][2][p] for k in order] for p in range(4)]
    for last in (False,) * 4 + (True,):
        best = [[min((sum((a - b) ** 2 for a, b in zip(x[p], c)), i) for i, c in enumerate(books[p])) for p in range(4)] for *_, x in whole]
        if last:
            break
        for p in range(4):
            for i in range(len(books[p])):
                mine = [x[p] for b, (*_, x) in zip(best, whole) if b[p][1] == i]
                if mine:
                    books[p][i] = [sum(c) // len(mine) for c in zip(*mine)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    total = {}
    for (_, label, _), b in zip(whole, best):
        total[label] = total.get(label, 0) + sum(d for d, _ in b)
    top = (1 << 63) - 1
    return sorted((i is not None, i or 0, "".join(f"{k:02x}" for _, k in b), min(sum(d for d, _ in b), top), min(total[label], top), digest) for (i, label, _), b in zip(whole, best))


def coded(df):
    return sorted((r["id"] is not None, r["id"] or 0, r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vector_codes.vector_codes(df).collect())


@pytest.mark.parametrize("scale", [1.0, 3e30])
def test_codes_of_odd_vectors(spark, scale):
    rng = random.Random(4)
    rows = [(rng.randrange(500), rng.choice([1, 2, None]), [float(rng.choice([-1, 0, 0.25, 1]) * rng.choice([1, 2, scale])) for _ in range(rng.choice([8, 8, 8, 7, 3]))]) for _ in range(300)]
    nan = float("nan")
    rows += [(None, 1, [0.5] * 8), (None, None, [-0.0001] * 8), (7, 1, None), (8, 1, [nan] * 8), (9, 1, [1.0, None] * 4), (10, 2, [float("inf")] * 8), (11, 3, []), rows[0], rows[0]]
    schema = "vec_id long, label int, embedding array<float>, code string, id int"
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], schema)
    float32 = [(i, label, v and [None if x is None else float(np.float32(x)) for x in v]) for i, label, v in rows]
    assert coded(df) == plain_codes(float32)
    assert coded(df.limit(5)) == plain_codes(float32[:5]) and coded(df.where("false")) == coded(df.where("embedding IS NULL")) == []


def test_reassignment_equals_a_full_scan():
    rng = np.random.default_rng(9)
    for _ in range(200):
        parts, old = rng.integers(-2, 3, (40, 2)).astype(float), rng.integers(-2, 3, (12, 2)).astype(float)
        new = old.copy()
        some = rng.integers(0, 12, rng.integers(0, 6))
        new[some] = rng.integers(-2, 3, (len(some), 2))
        at, distance = vector_codes.nearest(parts, old)
        got, want = vector_codes.reassign(parts, new, (old != new).any(axis=1), at, distance), vector_codes.nearest(parts, new)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def plain_audit(docs, labels):
    rows = []
    for i, text, source in docs:
        text = text or ""
        words = WORD.findall(text)
        upper = sum("A" <= c <= "Z" for c in text)
        again = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)
        fails = dict(A=len(words) < 200, B=100 * len(set(words)) < 50 * len(words), C=100 * upper > 2 * len(text), D=bool(re.search(r"[#$%&*|]", text)), E=again)
        mine = [x for x in labels if x[0] == i and i is not None]
        rows.append((source or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        share = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, left = [r for r in left if r[1][f]], [r for r in left if not r[1][f]]
                share[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(r[1][f] for r in own) - len(gone), sum(r[1][f] and sum(r[1].values()) == 1 for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), f]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = share[key[1][key[2] - 1]]
    return out


@pytest.mark.parametrize("cells", [None, 64])
def test_audit_of_odd_rows(spark, cells):
    rng = random.Random(8)
    texts = [None, "", "A B", "a b " * 150, "word " * 250, " ".join(f"w{k}" for k in range(220)), "x|y " * 3, LONG, "ÄÖÜ ÉÈ x", "$ " + " ".join(f"W{k}" for k in range(300))]
    docs = [(rng.choice([None, *range(30)]), rng.choice(texts), rng.choice(["a", "b", None, ""])) for _ in range(120)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in [*range(0, 30, 2), 2, 4, None]]
    df = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, source string, mask int, part string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    columns = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in columns] for r in filter_audit.filter_audit(df, marks, cells).collect()}
    assert got == plain_audit(docs, labels)
    assert filter_audit.filter_audit(df.where("false"), marks, cells).count() == 0
