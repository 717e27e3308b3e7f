"""Running sums and as-of lookups against plain loops, with one key that holds most rows."""

import random

from pyspark.sql import functions as F

from sievewright.operators import running


def test_running_sums_with_a_hot_key(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), k, rng.choice([None, *range(9)])) for k in rng.sample(range(9000), 3000)]
    got = {(r["key"], r["at"]): r["before"] for r in running.running_before(spark.createDataFrame(rows, "key string, at int, n int"), "key", ["at"], "n", cuts=16).collect()}
    total, want = {}, {}
    for key, at, n in sorted(rows, key=lambda r: r[1]):
        want[key, at] = total.get(key, 0)
        total[key] = total.get(key, 0) + (n or 0)
    assert got == want
    cut = running._cut(spark.createDataFrame(rows, "key string, at int, n int"), "key", ["at"], 16)
    sizes = sorted(r["count"] for r in cut.groupBy("key", "cut").count().collect())
    assert sizes[-1] < 2 * 3000 / 16 and cut.where("key = 'hot'").select("cut").distinct().count() >= 6
    assert running.running_before(cut.where("false").drop("cut"), "key", ["at"], "n").count() == 0


def test_latest_before_with_a_hot_key(spark):
    rng = random.Random(4)
    known = [(rng.choice(["hot", "hot", "b", None]), rng.choice([None, *range(200)]), f"v{k:04}") for k in range(900)]
    asked = [(k, rng.choice(["hot", "hot", "b", "c", None]), rng.choice([None, *range(-20, 220)]), "x") for k in range(500)] + [(1, "hot", 7, "x")] * 2
    df = running.latest_before(spark.createDataFrame(asked, "id int, key string, at int, side string"), spark.createDataFrame(known, "key string, at int, value string").select("key", "at", F.col("value").alias("v")), "key", "at", "v", cuts=16)

    def plain(key, at):
        mine = sorted((t, v) for k, t, v in known if k == key and key is not None and t is not None)
        if at is None or not mine:
            return None, "none"
        before = [x for x in mine if x[0] <= at]
        return (before[-1][1], "before") if before else (max(v for t, v in mine if t == mine[0][0]), "first")

    got = sorted((r["id"], r["key"] or "", r["at"] is None, r["at"] or 0, r["side"], r["v"] or "", r["found"]) for r in df.collect())
    assert got == sorted((i, k or "", t is None, t or 0, s, plain(k, t)[0] or "", plain(k, t)[1]) for i, k, t, s in asked)
