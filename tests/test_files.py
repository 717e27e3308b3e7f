"""Readers of file trees and the symbols of Python sources, on small trees."""

import json
import os

from sievewright.operators import symbols
from sievewright.sources import files


def put(root, path, content):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "wb") as f:
        f.write(content if isinstance(content, bytes) else content.encode())


def test_source_files_decode_and_filters(spark, tmp_path):
    root = str(tmp_path)
    put(root, "a/one.PY", "x = 'é'\n")
    put(root, "a/wide.txt", "wide".encode("utf-16"))
    put(root, "a/old.md", "caf\xe9 \x93q\x94".encode("latin-1"))
    put(root, "a/empty.md", "")  # the scan passes over empty files
    put(root, "skip/two.py", "y = 1\n")
    put(root, "skipped/three.py", "z = 1\n")
    put(root, "a/pic.png", b"\x89PNG")
    got = {r["path"]: r["text"] for r in files.source_files(spark, root, ("skip",)).collect()}
    assert got == {"a/one.PY": "x = 'é'\n", "a/wide.txt": "wide", "a/old.md": "café “q”", "skipped/three.py": "z = 1\n"}


def test_runs_cases_and_notes(spark, tmp_path):
    root = str(tmp_path)
    put(root, "runs/r1/meta.json", json.dumps({"state": "done"}))
    put(root, "runs/r2/meta.json", json.dumps({"state": "failed"}, indent=1))
    put(root, "runs/r1/trace.jsonl", '{"step": 1}\nbroken\n\n{"step": 2}\n')
    put(root, "cases/c/issue.json", json.dumps({"repository_url": "https://x/own/rep", "number": 7, "title": "t", "events": [1]}))
    put(root, "notes/good.md", "text é")
    put(root, "notes/bad.md", b"\xff\xfe\xff")
    assert sorted(map(tuple, files.run_records(spark, f"{root}/runs", "meta.json", "state string").collect())) == [("r1", "done"), ("r2", "failed")]
    assert sorted(r["step"] for r in files.run_trace(spark, f"{root}/runs", "r1", "trace.jsonl", "step int").collect()) == [1, 2]
    found = files.cases(spark, f"{root}/cases")
    assert found.columns == ["case_id", "repository_url", "number", "title", "created_at", "body"]
    checks = spark.createDataFrame([("other", "g")], "case_id string, grp string")
    assert [(r["case_id"], r["grp"]) for r in files.with_verification(found, checks).collect()] == [("own-rep-7", None)]
    assert [tuple(r) for r in files.notes(spark, f"{root}/notes").collect()] == [("good.md", "text é")]


def test_merged_sources(spark):
    a, b = spark.createDataFrame([(1,)], "id int"), spark.createDataFrame([(2, "t")], "id int, title string")
    got = files.merged_sources({"s": [a, b], "u": [a]}).collect()
    assert sorted(tuple(str(x) for x in r) for r in got) == [("s", "1", "None"), ("s", "2", "t"), ("u", "1", "None")]


def test_symbols_and_edges(spark):
    tree = {
        "pkg/base.py": "class Base:\n    def go(self):\n        return help()\n\ndef help():\n    pass\n",
        "pkg/use.py": "from .base import Base, help as h\nfrom . import base\nimport os\n\n@base.mark\nclass Use(Base):\n    async def run(self):\n        h(); self.go(); help()\n",
        "pkg/__init__.py": "",
        "pkg/bad.py": "def (",
        "pkg/no.txt": "class No: pass",
    }
    table = spark.createDataFrame([*tree.items(), ("pkg/null.py", None)], "path string, text string")
    facts = symbols.python_facts(table)
    names = {(r["path"], r["kind"], r["target"], r["line_start"], r["line_end"]) for r in facts.where("kind IN ('class', 'function')").collect()}
    assert names == {("pkg/base.py", "class", "Base", 1, 3), ("pkg/base.py", "function", "Base.go", 2, 3), ("pkg/base.py", "function", "help", 5, 6), ("pkg/use.py", "class", "Use", 6, 8), ("pkg/use.py", "function", "Use.run", 7, 8)}
    imports = symbols.import_edges(facts, table)
    assert {(r["name"], r["file"]) for r in imports.collect()} == {("Base", "pkg/base.py"), ("h", "pkg/base.py"), ("base", "pkg/base.py"), ("os", None)}
    edges = {(r["kind"], r["scope"], r["name"], r["file"], r["declared"]) for r in symbols.use_edges(facts, imports).where("path = 'pkg/use.py'").collect()}
    assert edges == {("base", "Use", "Base", "pkg/base.py", "Base"), ("call", "Use.run", "go", "pkg/base.py", "Base.go"), ("call", "Use.run", "help", "pkg/base.py", "help")}
    assert {(r["scope"], r["declared"]) for r in symbols.use_edges(facts, imports).where("path = 'pkg/base.py'").collect()} == {("Base.go", "help")}
