"""Rounds over a table of states against a plain loop item by item."""

import random

from pyspark.sql import functions as F

from sievewright.operators import adaptive as A


def plain(item, deferred, tables, truth):
    first, recover, promote = tables
    refs, counts, promoted = set(), [], []

    def grow(found):
        before = len(refs)
        refs.update(found)
        counts.append(len(refs))
        return len(refs) > before

    grounded = lambda: any(truth[r][0] for r in refs)
    sufficient = lambda: any(truth[r][1] for r in refs)
    grow(first.get(item, []))
    if sufficient():
        return 1, "initial_round_sufficient", promoted, sorted(refs), counts
    rounds = 1
    if not grounded():
        rounds += 1
        gained = grow(recover.get(item, []))
        if sufficient():
            return rounds, "owner_recovery_sufficient", promoted, sorted(refs), counts
        if not grounded():
            return rounds, "partial_no_owner_gain" if not gained else "partial_owner_not_grounded", promoted, sorted(refs), counts
    for objective in A.ORDER:
        mine = [e for i, o, role, e in deferred if (i, o) == (item, objective) and role]
        if not mine:
            continue
        promoted.append(objective)
        if not any(mine):
            continue
        gained = grow(promote.get((item, objective), []))
        stop = "adaptive_round_sufficient" if sufficient() else "adaptive_round_limit" if gained else "partial_no_promoted_evidence_gain"
        return rounds + 1, stop, promoted, sorted(refs), counts
    return rounds, "partial_no_deferred_promotion", promoted, sorted(refs), counts


def test_rounds_equal_a_plain_loop(spark):
    rng = random.Random(12)
    truth = {f"r{k}": (k % 4 == 1, k % 11 == 0) for k in range(24)}
    some = lambda: rng.sample(list(truth), rng.randrange(4))
    items = list(range(60))
    first, recover = {i: some() for i in items}, {i: some() for i in items if i % 7}
    for i in range(0, 60, 9):
        recover[i] = first[i]
    deferred = [(i, o, rng.choice(["x", "y", None]), rng.random() < 0.6) for i in items if i % 5 for o in (*A.ORDER, "unknown") for _ in range(rng.randrange(3))]
    promote = {(i, o): some() for i in items for o in A.ORDER}
    df = lambda pairs, schema: spark.createDataFrame(pairs, schema)
    hits = [df([(i, r) for i, rs in t.items() for r in rs], "item int, ref string") for t in (first, recover)]
    promoted = df([(*k, r) for k, rs in promote.items() for r in rs], "item int, objective string, ref string")
    asked = []

    def judge(refs):
        said = df([(r, *t) for r, t in truth.items()], "ref string, g boolean, s boolean")
        return refs.join(said, "ref").groupBy("item").agg(F.max("g").alias("grounded"), F.max("s").alias("sufficient"))

    def ask(n, table, on):
        def run(open_):
            asked.append((n, {r["item"] for r in open_.select("item").collect()}))
            return open_.select(*on).join(table, on).select("item", "ref")

        return run

    done = A.run_rounds(df([(i,) for i in [*items, 3]], "item int"), df(deferred, "item int, objective string, role string, executable boolean"), ask(0, hits[0], ["item"]), ask(1, hits[1], ["item"]), ask(2, promoted, ["item", "objective"]), judge)
    got = {r["item"]: (r["rounds"], r["stop"], r["promoted"], r["refs"], r["counts"]) for r in done.collect()}
    want = {i: plain(i, deferred, (first, recover, promote), truth) for i in items}
    assert got == want and len({w[1] for w in want.values()}) >= 6
    open_in = dict(asked)
    assert open_in[0] == set(items) and open_in[1] < set(items) and open_in[2] < set(items)  # only open items ask again
