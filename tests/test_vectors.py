"""Inverted lists of vectors against comparing all."""

import numpy as np

from sievewright.operators import vectors as V


def test_recall_and_the_exact_way(spark, tmp_path):
    x = np.array([r["embedding"] for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").collect()], float)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(-1, None)]
    c = V.save(spark.createDataFrame(rows, "key long, embedding array<float>"), f"file://{tmp_path}/v", lists=16)
    assert c.vectors.count() == 2 * len(x) and c.vectors.select("key").distinct().count() == len(x) and c.lists.count() == 16
    queries = spark.createDataFrame([(k, x[k].tolist()) for k in range(0, len(x), 50)], "query long, q array<double>")
    sims = V.unit(x.astype(np.float32).astype(float))
    want = {}
    for k in range(0, len(x), 50):
        s = np.round(sims @ V.unit(x[k : k + 1])[0], 6)
        want[k] = sorted(range(len(x)), key=lambda i: (-s[i], i))[:20]
    exact = {}
    for r in V.search(c, queries, 20, 16).orderBy("query", "rank").collect():
        exact.setdefault(r["query"], []).append(r["key"])
    assert sum(len(set(exact[k]) & set(want[k])) for k in want) >= 20 * len(want) - 2  # roundings of equal similarities
    near = V.search(c, queries, 20, 10).collect()
    assert sum(r["key"] in want[r["query"]] for r in near) >= 0.95 * 20 * len(want)
    one = V.probed(c, queries, 2)
    assert one.groupBy("query").count().where("count <> 2").count() == 0
