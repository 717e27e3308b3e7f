"""Every stage of the pipeline, and all of them in a row, against plain Python."""

from collections import Counter

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from sievewright.llm import decontaminate, quality  # noqa: E402

from .test_contracts import SF, given, plain_fingerprint  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MORE = ["score", "n_lines", "n_removed", "q_score", "kept", "tags"]


def key(row):
    return tuple((v is not None, v) for v in row)


def kept_by_quality(rows, model):
    lift = np.concatenate([model.word, model.pair]).astype(float)
    for r in rows:
        ids, share = quality.features(r[1] or "")
        if 1 / (1 + np.exp(-(share @ lift[ids] + model.bias))) >= quality.THRESHOLD:
            yield r


def deduped_lines(rows):
    """Rows with their later three-line windows removed; rows of one id and text are one document."""
    documents = sorted({(r[0], r[1] or "") for r in rows}, key=key)
    first, gone = {}, {}
    for doc in documents:
        lines = doc[1].split("\n")
        for k in range(len(lines) - 2):
            if first.setdefault(tuple(lines[k : k + 3]), (doc, k)) != (doc, k):
                gone.setdefault(doc, set()).update((k, k + 1, k + 2))
    for r in rows:
        doc = r[0], r[1] or ""
        text = "\n".join(x for k, x in enumerate(doc[1].split("\n")) if k not in gone.get(doc, ()))
        yield r[0], text, *r[2:4], len(text)


def near_unique(rows):
    """The documents (id, text) that stay: of each group of near copies the one with the smallest id."""
    documents = {(r[0], r[1] or ""): plain_fingerprint(r[1] or "") for r in rows}
    fps = sorted(set(documents.values()))
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(fps):
        for y in fps[:i]:
            if (x ^ y).bit_count() <= 4:
                root[find(x)] = find(y)
    groups = {}
    for doc, fp in documents.items():
        groups.setdefault(find(fp), []).append(doc)
    return {g: min({d[0] for d in docs if d[0] is not None}, default=None) for g, docs in groups.items()}, lambda r: find(documents[r[0], r[1] or ""])


def clean(rows):
    items = [decontaminate.normal(x["text"]) for x in given("benchmark")]
    for r in rows:
        words = decontaminate.normal(r[1] or "")
        have = Counter(words)
        for item in items:
            most = decontaminate.edits_allowed(len(item), 0.8)
            if sum((Counter(item) - have).values()) <= most and decontaminate.best_match(item, words)[0] <= most:
                break
        else:
            yield r


def rows_of(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """The supplied documents with nulls, empty texts, repeated rows and ids, and columns of helpers' and results' names."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS)
    more = [(None, None, None, None, None), (5, "", "en", "s", 0), (5, "a\nb\nc\nd", "en", "s", 7), (None, "x\na\nb\nc", "en", None, 7), (None, "x\na\nb\nc", "en", None, 7)]
    return docs.unionByName(docs.limit(5)).unionByName(spark.createDataFrame(more, docs.schema)).selectExpr("*", "77.0D AS score", "-5 AS n_lines", "doc_id * 3 AS n_removed", "'q' AS q_score", "CAST(NULL AS STRING) AS kept", "array(source) AS tags")


def test_stages_on_odd_rows(spark, odd):
    before = rows_of(odd)
    model = quality.quality_model(spark.read.parquet(f"{SF}/documents.parquet"), spark, SF)
    got = corpus_pipeline.quality_stage(spark, odd, SF)
    assert got.columns == odd.columns and sorted(rows_of(got), key=key) == sorted(kept_by_quality(before, model), key=key)
    got = corpus_pipeline.line_stage(spark, odd, SF)
    assert got.columns == odd.columns and Counter(rows_of(got)).keys() == Counter(deduped_lines(before)).keys() and got.count() == len(before)
    got = corpus_pipeline.decontamination_stage(spark, odd, SF)
    assert got.columns == odd.columns and sorted(rows_of(got), key=key) == sorted(clean(before), key=key)
    least, group = near_unique(before)
    got = corpus_pipeline.simhash_stage(spark, odd, SF)
    kept = rows_of(got)
    assert got.columns == odd.columns and sorted(map(group, kept)) == sorted(least) and all(r[0] == least[group(r)] for r in kept)
    pieces = corpus_pipeline.packing_stage(spark, odd, SF).where("piece = 0")
    assert Counter(r["doc_id"] for r in pieces.collect()) == Counter(r[0] for r in before)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.where("false"), SF).count() == 0


def everything(df):
    return Counter(tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.collect())


def test_extra_columns_come_back(spark, odd):
    """All columns of what each stage keeps are those that came, except text and n_chars behind line dedup."""
    before = everything(odd)
    for stage in (corpus_pipeline.quality_stage, corpus_pipeline.simhash_stage, corpus_pipeline.decontamination_stage):
        after = everything(stage(spark, odd, SF))
        assert after and not after - before
    cut = [c for c in odd.columns if c not in ("text", "n_chars")]
    assert everything(corpus_pipeline.line_stage(spark, odd, SF).select(*cut)) == everything(odd.select(*cut))


def test_rows_of_one_document_keep_the_same_one(spark):
    rows = [(k % 3, "one text of a few words that many rows have", f"tag{k}", {"k": k}) for k in range(60)]
    kept = {tuple(corpus_pipeline.simhash_stage(spark, spark.createDataFrame(rows[::step], "doc_id long, text string, tag string, extra map<string,int>").repartition(n), SF).select("doc_id", "tag").collect()) for step, n in ((1, 1), (-1, 7), (1, 13))}
    assert len(kept) == 1


def test_pipeline_in_a_row(spark):
    rows = rows_of(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = list(deduped_lines(list(kept_by_quality(rows, quality.quality_model(spark.read.parquet(f"{SF}/documents.parquet"), spark, SF)))))
    least, group = near_unique(rows)
    rows = list(clean([r for r in rows if least[group(r)] == r[0]]))
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == {r[0] for r in rows}
