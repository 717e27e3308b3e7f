"""The pipeline's SimHash stage on null and repeated ids."""

import random

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402


def test_null_and_repeated_ids(spark):
    rng = random.Random(7)
    a, b, c, d, e = (" ".join(f"w{rng.randrange(1 << 30)}" for _ in range(60)) for _ in range(5))
    rows = [(None, a), (None, a), (None, b), (1, c), (1, d), (1, d), (2, d), (None, e), (3, e), (4, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, extra int")
    out = corpus_pipeline.simhash_stage(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert got == sorted([(None, a), (None, b), (1, c), (1, d), (3, e), (4, "")], key=str)
    assert corpus_pipeline.simhash_stage(spark, docs.where("false"), "").count() == 0
