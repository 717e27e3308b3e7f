"""Substring and edit-distance joins against trying all pairs."""

import random

import pytest

from sievewright.operators import contain, fuzzy, substrings


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize(("few", "fold"), [(100_000, True), (0, True), (0, False)])
def test_contained(spark, monkeypatch, few, fold):
    monkeypatch.setattr(substrings, "FEW", few)
    rng = random.Random(few + fold)
    word = lambda n: "".join(rng.choice("abAB é\n😀") for _ in range(n))
    texts = [(k, word(rng.randrange(40))) for k in range(60)] + [(60, None), (61, ""), (1, "aaaa")]
    needles = [(k, word(rng.randrange(1, 6))) for k in range(80)] + [(80, None), (81, ""), (82, texts[3][1]), (82, "aa")]
    got = {tuple(r) for r in substrings.contained(spark.createDataFrame(texts, "key int, text string"), spark.createDataFrame(needles, "id int, needle string"), fold).collect()}
    low = (lambda x: x.lower()) if fold else (lambda x: x)
    assert got == {(i, k) for i, n in needles for k, t in texts if n and t is not None and low(n) in low(t)}


def test_first_per_text(spark):
    lines = spark.createDataFrame([(1, 0, "x"), (1, 1, "An ERROR here"), (1, 2, "error"), (2, 0, "must be"), (3, 0, None)], "key int, no int, line string")
    asked = spark.createDataFrame([("a", 0, "must"), ("a", 1, "error"), ("b", 0, "zzz")], "id string, place int, needle string")
    assert {tuple(r) for r in substrings.first_per_text(lines, asked).collect()} == {("a", 1, 1, 1), ("a", 2, 0, 0)}


def test_short_needles(spark):
    texts = spark.createDataFrame([(1, "the quick brown fox jumps over it"), (2, "brown"), (3, None)], "key int, text string")
    needles = spark.createDataFrame([("a", "brown"), ("b", " quick brown "), ("c", "quick brown fox jumps over"), ("d", ""), ("e", None), ("f", "row"), ("g", "brown fox red")], "id string, needle string")
    assert {tuple(r) for r in contain.containing(texts, needles).collect()} == {("a", 1), ("a", 2), ("b", 1), ("c", 1), ("f", 1), ("f", 2)}


def test_near_words(spark):
    rng = random.Random(6)
    words = ["", "a", "ab"] + ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))) for _ in range(60)]
    words += [w for n in (15, 16, 17, 18, 19, 20, 21, 22, 40) for w in ["".join(rng.choice("abcd") for _ in range(n))] for _ in (0,)]
    for w in words[-9:]:
        for _ in range(6):
            x = list(w)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(x))
                x[at : at + rng.randrange(2)] = rng.choice(["", "z", "a"])
            words.append("".join(x))
    left, right = [*words[::2], None, words[0]], [*words[1::2], None]
    got = {tuple(r) for r in fuzzy.near_words(spark.createDataFrame([(w,) for w in left], "a string"), spark.createDataFrame([(w,) for w in right], "b string")).collect()}
    assert got == {(a, b, edits(a, b)) for a in left for b in right if a is not None and b is not None and edits(a, b) <= 2}
