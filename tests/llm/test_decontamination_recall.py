"""Recall of op1_decontamination on items that are edited or cut at their head, middle or tail."""

import random
from collections import Counter

import pytest

from sievewright.llm import decontaminate

SIZES = [5, 10, 16, 20, 50, 59, 100, 200, 300]


def changed(words, how, where, share, fresh, rng):
    n = int(share * len(words))
    if where == "spread":
        out = list(words)
        for at in sorted(rng.sample(range(len(words)), n), reverse=True):
            out[at : at + 1] = [fresh()] if how == "edit" else rng.choice(([], [out[at], fresh()]))
        return out
    at = {"head": 0, "middle": (len(words) - n) // 2, "tail": len(words) - n}[where]
    return words[:at] + ([fresh() for _ in range(n)] if how == "edit" else []) + words[at + n :]


def passages(trials, share):
    rng = random.Random(11)
    fresh = lambda: f"w{rng.randrange(1 << 30)}"
    docs, items, want = [], [], {}
    for size in SIZES:
        for _ in range(trials):
            item = [fresh() for _ in range(size)]
            items.append((len(items), " ".join(item)))
            for how in ("edit", "cut"):
                for where in ("head", "middle", "tail", "spread"):
                    for before, behind in ((40, 40), (0, 40), (40, 0)):
                        text = [fresh() for _ in range(before)] + changed(item, how, where, share, fresh, rng) + [fresh() for _ in range(behind)]
                        want[len(docs), len(items) - 1] = size, how, where, before > 0, behind > 0
                        docs.append((len(docs), " ".join(text)))
    return docs, items, want


def recall(spark, trials, share):
    docs, items, want = passages(trials, share)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # the windows of these few texts are larger than they look
    rows = decontaminate.benchmark_matches(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")).collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    found = {(r["doc_id"], r["item_id"]) for r in rows}
    assert found <= set(want)
    return found, want


@pytest.mark.parametrize(("share", "least"), [(0.1, 0.95), (0.2, 0.95)])
def test_edited_and_cut_items(spark, share, least):
    found, want = recall(spark, 3, share)
    of, hit = Counter(v[1:3] for v in want.values()), Counter(want[k][1:3] for k in found)
    shares = {k: hit[k] / of[k] for k in of}
    by_size = {s: sum(want[k][0] == s for k in found) / sum(v[0] == s for v in want.values()) for s in SIZES}
    assert min(shares.values()) >= least and min(by_size.values()) >= least, (shares, by_size)


def test_long_item_edited_at_its_head(spark):
    """An item over 256 words whose first words are all changed has its other stretches."""
    words = [f"v{i}" for i in range(1000)]
    text = " ".join([f"x{i}" for i in range(200)] + words[200:])
    docs = spark.createDataFrame([(1, text), (2, " ".join(words[200:])), (3, " ".join(words[201:]))], "doc_id long, text string")
    rows = decontaminate.benchmark_matches(docs, spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["edits"]) for r in rows} == {(1, 200), (2, 200)}


def test_short_items_are_compared_exactly(spark):
    items = spark.createDataFrame([(1, "zebra"), (2, "two words"), (3, "one two three four"), (4, " ")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a Zebra ran"), (2, "zebras ran two, words"), (3, "two  WORDS"), (4, "x one two three four"), (5, "one two three"), (6, "words two")], "doc_id long, text string")
    rows = decontaminate.benchmark_matches(docs, items).collect()
    assert {(r["doc_id"], r["item_id"], r["edits"], r["end_word"]) for r in rows} == {(1, 1, 0, 2), (3, 2, 0, 2), (4, 3, 0, 5)}
