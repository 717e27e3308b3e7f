"""Column builders and operators of the repository, its roles and its prompts, on small examples of code."""

import pytest
from pyspark.sql import functions as F

from sievewright.functions import paths as P
from sievewright.functions import records as R
from sievewright.functions import roles
from sievewright.functions import terms as T
from sievewright.operators import chunks as C
from sievewright.operators import contain, evidence, graph, select
from sievewright.operators import index as I
from sievewright.sources import files


def one(spark, column, **values):
    return spark.range(1).select(column(**{k: F.lit(v) for k, v in values.items()}).alias("x")).first()["x"]


def test_chunks_of_code(spark):
    body = "import x\n\nexport class A {\n" + "  f();\n" * 45 + "}\nexport function b() {\n}\n\n\nenum C { }\n"
    blank = "\n\n\n"
    rows = C.chunks(spark.createDataFrame([("a.ts", body), ("b.ts", blank), ("c.ts", ""), ("d.ts", None), ("e.ts", "\n".join("x" for _ in range(40)))], "path string, text string")).collect()
    got = {(r["path"], r["line_start"], r["line_end"], tuple(r["symbols"])) for r in rows}
    assert got == {
        ("a.ts", 1, 2, ()), ("a.ts", 3, 42, ("A",)), ("a.ts", 33, 49, ("A",)), ("a.ts", 50, 53, ("b",)), ("a.ts", 54, 54, ("C",)), ("e.ts", 1, 40, ()), ("e.ts", 31, 40, ()),
    }
    counts = {r["path"]: r["chunks"] for r in C.chunk_counts(spark.createDataFrame([("a.ts", body), ("c.ts", ""), ("d.ts", None)], "path string, text string")).collect()}
    assert counts == {"a.ts": 5, "c.ts": 0, "d.ts": 0}


def test_stored_index_is_used_again(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "beta"), (3, None)], "key long, text string")
    known = {}
    first = I.synced(docs, f"file://{tmp_path}", known, "s")
    assert I.synced(docs, f"file://{tmp_path}", known, "s").folder == first.folder
    other = I.synced(docs.where("key < 3"), f"file://{tmp_path}", known, "s")
    assert other.folder != first.folder and first.table("stats").first()["n"] == 3
    q = spark.createDataFrame([(0, "beta", 2.0), (0, "none", 1.0)], "query int, term string, qtf double")
    assert {(r["key"], tuple(r["terms"])) for r in I.matched_terms(first, q, I.bm25(first, q)).collect()} == {(1, ("beta",)), (2, ("beta",))}


@pytest.mark.parametrize(
    ("path", "role", "category"),
    [("docs/a.ts", "documentation", "documentation"), ("src/x.md", "documentation", "documentation"), ("a/README.rst", "documentation", "source_code"), ("src\\Bin\\x.js", "baseline_or_generated", "source_code"),
     ("src/a.generated.ts", "baseline_or_generated", "source_code"), ("tests/a.ts", "test", "source_code"), ("src/a.spec.ts", "test", "source_code"), ("pkg/src/a.ts", "implementation", "source_code"), ("notes.txt", "other", "documentation"), ("src", "other", "source_code")],
)
def test_roles_of_paths(spark, path, role, category):
    assert one(spark, lambda p: F.concat_ws(" ", P.file_role(p), P.category(p)), p=path) == f"{role} {category}"


@pytest.mark.parametrize(
    ("base", "ref", "target"),
    [("src/a/b.ts", "./c", "src/a/c.ts"), ("src/a/b.js", "../d", "src/d.js"), ("src/a/b.ts", "../../../x", None), ("src/a/b.ts", "react", "src/a/react.ts"), ("src/a/b.ts", "http://x/y", None), ("src/a/b.ts", "/abs", None), ("b.md", "./c.tsx", "c.tsx")],
)
def test_resolved_references(spark, base, ref, target):
    assert one(spark, lambda b, r: P.resolved(b, r), b=base, r=ref) == target


def test_owner_and_artifact_paths(spark):
    match = lambda p, *t: one(spark, lambda path: P.owner_match(path, F.array(*map(F.lit, t))), path=p)
    assert match("src/compiler/parser.ts", "parsing") and match("src/x/typeChecker.ts", "type checker") and not match("src/a.ts", "ab") and not match("src/zzz.ts", "emitter rules")
    a = one(spark, lambda p: P.artifact(p), p="bin/lib.generated.ts")
    assert (a["kind"], a["reasons"]) == ("built_or_distribution_artifact", ["path_contains_bin", "path_contains_generated_marker"])
    agree = lambda s, f: one(spark, lambda a, b: P.role_agreement(a, b), a=s, b=f)
    assert [agree("implementation", "baseline_or_generated"), agree("generated", "baseline_or_generated"), agree("", "other"), agree("other", "baseline_or_generated")] == ["mismatch", "agree", "unknown", "different"]
    assert one(spark, lambda a, b: P.prefix_depth(a, b), a="src/a/b.ts", b="src/a/c/d.ts") == 2 and one(spark, lambda a, b: P.prefix_depth(a, b), a="x", b="x") == 1


def test_terms(spark):
    code = 'import { A } from "./model"; const p = require("../lib/x"); import "./side";\n/// <reference path="types.ts" />'
    assert one(spark, lambda t: T.references(t), t=code) == ["types.ts", "./model", "../lib/x"]
    assert one(spark, lambda t: T.routes(t), t='fetch("/api/run?x=1"); axios.post(\'/api/run/\'); fetch("/a/${b}"); requestJson<T>("/health#x")') == ["/health", "/api/run"]
    assert one(spark, lambda t: T.message_terms(t), t="say 'Cannot find module: x' here\nplain line\nError: it must fail.") == ["Cannot find module: x", "Cannot find module", "say 'Cannot find module: x' here", "say 'Cannot find module", "Error: it must fail"]
    assert one(spark, lambda t: T.code_terms(t), t="return MyType of parseNode and Élan str") == ["MyType", "parseNode"]
    assert one(spark, lambda t: T.prompt_terms(t), t="why does `parseList` fail with --strict in src/a/b.ts") == ["parseList", "src/a/b.ts", "--strict"]
    assert one(spark, lambda t: T.prompt_terms(t), t="Why are abstract classes broken") == ["abstract", "classes", "broken", "abstract classes", "classes broken"]
    assert one(spark, lambda t: T.entities(t), t="see myFunc and some_name or ABC not Word") == ["myFunc", "some_name", "ABC"]
    assert one(spark, lambda t: T.phrases(t), t='it "Must  not be" so, cannot extend abstract class') == ["must not be", "cannot extend abstract class"]
    assert one(spark, lambda t: T.owner_artifacts(t), t="when parsing json or the csv parser, parse error") == ["json parser", "when parser", "csv parser"]
    assert one(spark, lambda t: T.name_tokens(t), t="getPage-by_id URL") == ["get", "page", "by", "id", "u", "r", "l"]
    assert one(spark, lambda t: T.sse_payload(t), t='event: x\ndata: {"a": 1}\ndata: [DONE]\n') == '{"a": 1}'
    assert one(spark, lambda t: T.compact(t, 2), t="a  \n\nb```\nc") == "a\nb'''\n..."


def test_roles(spark):
    c = spark.createDataFrame(
        [("src/compiler/checker.ts", "function checkClass() { validate the abstract rule }", "abstract class check", 2), ("src/compiler/parser.ts", "nothing said", "abstract class check", 0), ("tests/checker.ts", "check", "abstract", 0)],
        "path string, text string, query string, near int",
    ).withColumns({"helpers": F.array("query"), "depends": F.lit(False), "called": F.col("near") > 0})
    table = roles.role_table(spark).where("role = 'validation_checking'")
    v = {r["path"]: r for r in roles.validated(c.crossJoin(table)).collect()}
    # words: abstract in the text, class in the text, check in path and text; all keywords, path and concrete overlap
    assert v["src/compiler/checker.ts"].asDict() | {} and v["src/compiler/checker.ts"]["local"] == 0.35 * 3 + 0.7 + 1.0 + 0.7 and v["src/compiler/checker.ts"]["total"] == 3.45 + 1.4 + 0.9 + 1.5
    assert v["src/compiler/checker.ts"]["accepted"] and v["src/compiler/checker.ts"]["accepted_by"] == "anchor_boosted"
    assert (v["src/compiler/parser.ts"]["local"], v["src/compiler/parser.ts"]["role_path"], v["src/compiler/parser.ts"]["accepted"]) == (-0.5, -1.0, False)
    p = {r["path"]: r for r in roles.profiled(c.crossJoin(table), roles.role_table(spark)).collect()}
    assert (p["src/compiler/checker.ts"]["profile"], p["src/compiler/parser.ts"]["profile"], p["tests/checker.ts"]["profile"]) == ("likely_owner", "support_only", "noise")
    assert p["src/compiler/parser.ts"]["reasons"] == ["adjacent_validation_checking_support_layer", "cross_role_owner_path"]


def test_records(spark):
    first = lambda p: one(spark, lambda p: R.records(p), p=p)
    assert first('{"x": 1, "items": [{"a": 1}, {"a": 2}]}') == ['{"a":1}', '{"a":2}'] and first("[1, 2]") == ["1", "2"] and first('{"total_count": 0}') == [] and first("plain") == ["plain"]
    assert one(spark, lambda p: R.first_scalar(p, ("a", "b", "c")), p='{"a": {"x": 1}, "b": " ", "c": " v "}') == "v" and one(spark, lambda p: R.first_number(p, ("a", "b")), p='{"a": "x", "b": "1.5"}') == 1.5
    assert one(spark, lambda p: R.payload_text(p), p='{"results": [{"body": "B"}]}') == "B" and one(spark, lambda p: R.payload_text(p), p="  t ") == "t"


def test_containment(spark):
    texts = spark.createDataFrame([(1, "x the quick brown fox jumps over y"), (2, "the quick brown fox"), (3, None), (4, "athe quick brown fox jumps overt")], "key long, text string")
    needles = spark.createDataFrame([(7, " the quick brown fox jumps over "), (8, "short one"), (9, None)], "id long, needle string")
    assert sorted(map(tuple, contain.containing(texts, needles).collect())) == [(7, 1), (7, 4)]


def test_graphs(spark):
    chain = spark.createDataFrame([(i, i + 1, "calls" if i % 2 else "imports") for i in range(100)], "src int, dst int, kind string")
    roots = spark.createDataFrame([(0,)], "root int")
    assert graph.reach(chain, roots).agg(F.max("depth")).first()[0] == 100  # no depth ends the walk
    nodes = spark.createDataFrame([(i, "function" if i < 4 else "class") for i in range(101)], "id int, kind string")
    assert graph.traverse(nodes, chain, roots, "downstream", 10, ("function",)).count() == 4
    assert graph.traverse(nodes, chain, spark.createDataFrame([(3,)], "root int"), "both", 1).count() == 3
    said = spark.createDataFrame([("g", 1, "a", "b", "dependency", "l", "d", "direct", "high"), ("g", 2, "b", "a", "other", "l", "d", "inferred", "high"), ("g", 3, "a", "doc", "other", "l", "d", "direct", "low"), ("g", 4, "b", "c", "OTHER", "l", "d", "Inferred", "high"), ("g", 5, "a", "zzz", "other", "l", "d", "direct", "low"), ("g", 6, "c", "c", "other", "l", "d", "direct", "low")], "grp string, ord int, source_ref string, target_ref string, relationship_kind string, label string, description string, grounding string, confidence string")
    items = spark.createDataFrame([("g", r, f"{r}.ts" if r != "doc" else "x.md") for r in ("a", "b", "c", "doc")], "grp string, ref string, path string")
    none = spark.createDataFrame([], "grp string, a string, b string")
    got = evidence.valid_connections(said, items, none)
    assert [(r["ord"], r["confidence"]) for r in got.orderBy("ord").collect()] == [(1, "high"), (4, "medium")]
    state = evidence.coverage(items, got, items.where("ref = 'a'").select("grp", "ref"), items.where("ref IN ('b', 'doc')").select("grp", "ref"))
    assert {r["ref"]: r["state"] for r in state.collect()} == {"a": "connected", "b": "connected", "c": "connected", "doc": "declared"}


def test_selection(spark):
    s = spark.createDataFrame([("q", 1, 1), ("q", 2, 2), ("q", 2, 1), ("q", 3, 1)], "k string, ref int, rank int")
    assert [(r["ref"], r["score"]) for r in select.merge_ranked(s, ["k"], "ref").orderBy("place").collect()] == [(2, 1.5), (1, 1.0), (3, 1.0)]
    a, b = (spark.createDataFrame(x, "k string, ref int, ord int") for x in ([("q", 5, 1), ("q", 6, 2)], [("q", 6, 1), ("q", 7, 2), ("q", 8, 3)]))
    assert [r["ref"] for r in select.append_capped(a, b, ["k"], 3).orderBy("rank").collect()] == [5, 6, 7]
    trace = select.source_trace(
        spark.createDataFrame([(1, "lib.js", "Foo  bar\nbaz"), (2, "lib.js", "Array Map x"), (3, "none.js", "x")], "ref int, target string, snippet string"), spark.createDataFrame([("lib.js", "a.ts"), ("lib.js", "b.ts")], "target string, source string"),
        spark.createDataFrame([("a.ts", "so foo BAR baz it is"), ("b.ts", "Array of Map")], "source string, text string"),
    )
    assert {r["ref"]: (r["status"], r["matched"]) for r in trace.collect()} == {1: ("found", ["a.ts"]), 2: ("partial", ["b.ts"]), 3: ("not_found", [])}


def test_decoding():
    assert files._text("häß".encode()) == "häß" and files._text("häß".encode("cp1252")) == "häß" and files._text(b"\x81a") == "\x81a"
    for code in ("utf-16", "utf-16-le", "utf-16-be"):
        assert files._text(("plain text " * 9).encode(code)) == "plain text " * 9
    assert files._text(b"\0\0\0\0\0a\0\0\0") is None


def test_excerpts_stand_where_a_greedy_loop_finds_them(spark):
    import random

    from sievewright.functions.excerpts import aligned

    rng = random.Random(2)
    line = lambda: rng.choice(["a", " a", "b  ", "c", "", "...", "// ...", "d"])
    rows = [(k, [line() for _ in range(rng.randrange(9))], [line() for _ in range(rng.randrange(5))]) for k in range(300)]

    def plain(full, excerpt):
        at, first = 0, None
        said = [x.strip() for x in excerpt if x.strip() and x.strip() not in ("...", "// ...")]
        for x in said:
            hit = next((i for i in range(at, len(full)) if full[i].strip() == x), None)
            if hit is None:
                return None
            first, at = first or hit + 1, hit + 1
        return (first, at) if said else None

    df = spark.createDataFrame(rows, "k int, f array<string>, e array<string>")
    got = {r["k"]: r["x"] and tuple(r["x"]) for r in df.select("k", aligned(F.col("f"), F.col("e")).alias("x")).collect()}
    assert got == {k: plain(f, e) for k, f, e in rows}


def test_constants_lead_to_documents(spark):
    from sievewright.operators import constants as K

    code = "import x\nconst GUIDE_PATH: string = join(root, \"docs\", 'Guide.MD');\nlet GUIDE_PATH = 'other.md'\nOTHER=\"conf/app.json\"\n  var SHORT = 'guide.md'\nAB = 'guide.md'"
    files = [("src/a.ts", code), ("src/b.ts", "GUIDE_PATH = 1"), ("docs/guide.md", "text"), ("conf/app.json", "{}"), ("null.ts", None)]
    selected = [("a1", "src/a.ts", "use GUIDE_PATH and OTHER, AB"), ("a2", "src/a.ts", "SHORT SHORT"), ("b", "src/b.ts", "GUIDE_PATH"), ("g", "docs/guide.md", "GUIDE_PATH"), ("j", "conf/app.json", ""), ("n", "null.ts", None), ("x", "src/none.ts", "OTHER")]
    got = {tuple(r) for r in K.document_references(spark.createDataFrame(selected, "ref string, path string, snippet string"), spark.createDataFrame(files, "path string, text string")).collect()}
    assert got == {("a1", "g", "GUIDE_PATH", "Guide.MD"), ("a1", "j", "OTHER", "app.json"), ("a2", "g", "SHORT", "guide.md")}
