"""Every core query against its SQL twin, and sequential operators against plain Python."""

import datetime
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from sievewright.operators import graph
from sievewright.plans import registry
from sievewright.sources.tables import read_jsonl
from sievewright.streaming import deadlines, events

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(round(r[i], 9) if isinstance(r[i], float) else r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_twin(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in registry.ORACLES:
        r = duck.execute(registry.ORACLES[name])
        assert got == rows([d[0] for d in r.description], r.fetchall())


def test_forest_has_no_cycle(spark):
    e = spark.createDataFrame([("g", 1, 1, 2), ("g", 2, 2, 3), ("g", 3, 3, 1), ("g", 4, 4, 4), ("h", 1, 1, 3)], "grp string, ord int, src int, dst int")
    assert sorted(map(tuple, graph.minimal_forest(e).collect())) == [("g", 1, 1, 2), ("g", 2, 2, 3), ("h", 1, 1, 3)]


def test_round_robin_shares_refs(spark):
    h = spark.createDataFrame([("g", "a", 1, 10), ("g", "a", 2, 20), ("g", "b", 1, 10), ("g", "b", 2, 30)], "grp string, role string, ord int, ref long")
    assert [(r["role"], r["ref"]) for r in graph.round_robin(h).orderBy("rank").collect()] == [("a", 10), ("b", 30), ("a", 20)]


def test_diverse_equals_a_greedy_loop(spark):
    rng = random.Random(6)
    rows = [(rng.choice("gh"), k, f"{rng.choice('ab')}/{rng.choice('xyz')}", rng.randrange(40) / 10) for k in range(60)] + [("one", 1, "a/x", 1.0)]
    got = sorted(map(tuple, graph.diverse(spark.createDataFrame(rows, "grp string, ref long, path string, score double")).collect()))
    want = []
    for g in ("g", "h", "one"):
        rest, out = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[3], r[1])), []
        while rest and len(out) < 4:
            value = lambda r: round(r[3] - sum(2.5 * (r[2] == o[2]) + 0.7 * (r[2][0] == o[2][0]) for o in out), 6)  # noqa: B023, E731
            best = max(range(len(rest)), key=lambda i: (value(rest[i]), -i))
            out.append(rest.pop(best))
            want.append((g, len(out), out[-1][1]))
    assert got == want


def test_reach_with_cycle(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src int, dst int")
    got = graph.reach(e, spark.createDataFrame([(1,), (9,)], "root int"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 3), (9, 9, 0)]


def test_stream_equals_batch(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    data = [(1, t0), (1, t0 + datetime.timedelta(minutes=10)), (1, t0 + datetime.timedelta(hours=3)), (2, t0), (7, t0 + datetime.timedelta(days=9))]
    df = spark.createDataFrame(data, "user_id long, ts timestamp")
    df.write.parquet(f"{tmp_path}/in")
    events.run_once(spark, f"{tmp_path}/in", "user_id long, ts timestamp", events.sessions, f"{tmp_path}/out", f"{tmp_path}/cp")
    batch = sorted(map(tuple, events.sessions(df).collect()))
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == [r for r in batch if r[0] != 7]  # the newest is still open


def test_deadlines_of_a_stream_equal_the_batch(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type").where("user_id < 12")
    for k in range(3):  # in the order of time, a file a batch
        df.where(f"pmod(datediff(ts, date'2024-01-01') div 10, 3) = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    build = lambda stream: deadlines.with_deadlines(stream, "purchase", 360)
    events.run_once(spark, f"{tmp_path}/in", "user_id long, ts timestamp, event_type string", build, f"{tmp_path}/out", f"{tmp_path}/cp")
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    want = sorted(map(tuple, deadlines.batch_deadlines(df, "purchase", 360).select("user_id", "day", "started", "deadline", "results", "last", "status").collect()))
    assert got == want and {r[-1] for r in want} == {"complete", "failed"}


def test_jsonl_skips_malformed(spark, tmp_path):
    with open(os.path.join(tmp_path, "a.json"), "w") as f:
        f.write('{"a": 1}\n\nnot json\n{"a": 2}\n')
    assert sorted(r["a"] for r in read_jsonl(spark, str(tmp_path), "a int").collect()) == [1, 2]
