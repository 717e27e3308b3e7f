"""Queries against their SQL on rows that the supplied tables don't have."""

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from sievewright.plans import registry


def same(spark, folder, name, **tables):
    """The rows of a query over ``tables``, which must be those of its SQL."""
    duck = duckdb.connect()
    for table, columns in tables.items():
        at = f"{folder}/{table}.parquet"
        pq.write_table(pa.table(columns), at)
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{at}')")
    df = registry.QUERIES[name](spark, str(folder))
    found = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in found.description]
    got = sorted((tuple(r) for r in df.select(*names).collect()), key=repr)
    assert got == sorted(found.fetchall(), key=repr)
    return got


def documents(texts, source="s", lang="en"):
    many = lambda x: list(x) if isinstance(x, (list, tuple)) else [x] * len(texts)
    return {"doc_id": list(range(len(texts))), "text": pa.array(texts, "string"), "source": many(source), "lang": many(lang)}


def test_messages_beside_letters_beyond_ascii(spark, tmp_path):
    texts = ["Haus enöau Baum", "first\rline\nhaus ENÖAU baum here", "some other words", "la garde éwas ici", "x\x85y\nla garde éwas ici"]
    got = same(spark, tmp_path, "message_bridge", documents=documents(texts), benchmark={"item_id": [0, 1], "text": ["Haus enöau Baum", "la garde éwas ici"]})
    assert {r[:3] for r in got} == {(0, 1, 2), (1, 4, 2)}


def test_open_files_without_lines(spark, tmp_path):
    many = "\n".join(["The of", *["x"] * 50, "Foo thé", "y"])
    texts = [None, "", "\n", "a\rb\x85c\nd", many, many, "one"]
    asked = [(0, 2, 3.0), (1, 0, 4.5), (1, 9, 0.0), (2, 1, 0.0), (3, 2, 1.0), (4, 50, 9.0), (5, 1, 99.0), (6, 4, 0.0), (7, 1, 1.0), (0, 0, 0.0), (2, None, 1.0), (1, None, 1.0)]
    ids = [k for k, *_ in asked]
    props = ["{}" if k is None else f'{{"k": {k}}}' for _, k, _ in asked]
    events = {"event_id": ids, "ts": [datetime.datetime(2024, 1, 1)] * len(ids), "value": [v for *_, v in asked], "props": props}
    got = same(spark, tmp_path, "open_file", documents=documents(texts), events=events)
    assert {r[3] for r in got} == {"ok", "missing", "rejected"} and any(r[3] == "ok" and r[4] is None for r in got)


def test_sources_of_artifacts(spark, tmp_path, monkeypatch):
    """Groups cut into many blocks, snippets across white space and case, of one or two words, null and empty texts, equal texts; and
    no row for a pair of an artifact and a source."""
    import random

    from sievewright.operators import select

    monkeypatch.setattr(select, "BLOCK", 400)
    monkeypatch.setattr(select, "ARTIFACTS", 3)
    monkeypatch.setattr(select, "TOGETHER", 2)
    rng = random.Random(4)
    word = lambda: rng.choice(["Foo", "foo", "this", "bar$1", "_x9", "éa", "ab", "String", "q", "zeta"])
    texts = [rng.choice(["\n", " ", "  "]).join(word() for _ in range(rng.randrange(1, 9))) for _ in range(200)]
    texts[10], texts[22], texts[34], texts[0], texts[46] = None, "", "zeta", None, "   "
    texts[58], texts[1], texts[13], texts[2] = "Foo  bar$1 q éa", "a fOO\nBAR$1 q ÉA\tb", "a fOO\nBAR$1 q ÉA\tb", ""
    source, lang = [rng.choice(["s", "t", "sd", None]) for _ in texts], [rng.choice(["en", "de", "e"]) for _ in texts]
    for k in (58, 1, 13):
        source[k], lang[k] = "s", "en"
    got = same(spark, tmp_path, "artifact_sources", documents=documents(texts, source, lang))
    assert {r[1] for r in got} == {"found", "partial", "not_found"}
    plan = registry.QUERIES["artifact_sources"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "source_text" not in plan and "CoGroup" in plan
