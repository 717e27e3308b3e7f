"""The best windows of files of code against a plain reading of every window."""

import random
import re

from sievewright.functions import roles as R
from sievewright.operators import windows as W

ROLES = {r: (k.split(), h.split(), s.split()) for r, k, h, s, *_ in R.ROLES}
STOP = set("where find search like with that this from".split())


def unique(xs):
    return list(dict.fromkeys(xs))


def plain(role, query, text):
    lines = text.split("\n")
    lines = lines[:-1] if lines[-1] == "" else lines
    keywords, hints, support = ROLES[role]
    generic = unique([*keywords, *hints, *support])
    said = unique(t for t in re.findall(r"[a-z_][a-z0-9_]{3,}", query.lower()) if t not in STOP)
    specific = [t for t in said if t not in generic]
    terms = [t for t in unique([*specific, *said, *generic]) if len(t) >= 3]
    low = [x.lower() for x in lines]
    count = {t: sum(x.count(t) for x in low) for t in terms}
    phrases = unique(re.sub(r"\s+", " ", x.strip()) for x in re.findall(r"`([^`]+)`", query.lower()) if len(x.strip()) >= 5)
    starts = []
    for index in range(0, len(lines), 40):
        starts.append(index + 1)
        if index + 80 >= len(lines):
            break
    for no, line in enumerate(lines, 1):
        if re.search(W.DECLARATION, line) or re.search(W.NAMED_FUNCTION, line) or any(t in low[no - 1] for t in terms[:18]):
            starts.append(max(1, no - 20))
    best = None
    for s in unique(starts):
        part, body = lines[s - 1 : s + 79], "\n".join(low[s - 1 : s + 79])
        score = 0.0
        for t in terms:
            if count[t] and t in body:
                w = 2.2 if count[t] == 1 else 1.8 if count[t] <= 3 else 1.2 if count[t] <= 8 else 0.8
                w = (w + 0.8 * (t in specific)) * (0.45 if t in generic else 1)
                score += w + min(body.count(t), 4) * min(w * 0.2, 0.5)
        score += 3 * sum(p in body for p in phrases) + 0.6 * sum(k in body for k in keywords)
        if specific:
            hits = sum(t in body for t in specific)
            score += min(hits, 4) * 1.25 if hits else -2.5
        decls = [m.lower() for x in part for m in re.findall(W.DECLARED, x)]
        kind, ctor = any(x in query.lower() for x in ("class", "extends", "implements", "base")), any(x in query.lower() for x in ("constructor", "super"))
        if role == "representation":
            score += 2.2 * any(re.search(r"\b(?:class|interface|enum|type)\s+[a-z_]", x) for x in map(str.lower, part)) + 2.5 * len(decls and [d for d in decls if re.search(W.KINDS, d)])
        elif role == "diagnostics":
            score += 1.8 * bool(re.search(W.REPORTS, body)) + 2.0 * sum(d.startswith("function") and bool(re.search(W.REPORTS, d)) for d in decls)
        else:
            verbs = W.VERBS[role][0]
            named = [d for d in decls if d.startswith("function") and re.search(verbs, d)]
            score += 2.5 * any(re.search(rf"\bfunction\s+[a-z_][a-z0-9_]*({verbs})", x.lower()) for x in part) + 3.0 * len(named)
            if kind and role == "validation_checking":
                score += 4.0 * sum("class" in d for d in named)
            if kind and role == "input_parsing":
                score += 2.0 * sum(bool(re.search("class|member|declaration|statement", d)) for d in named)
            if ctor and role == "validation_checking":
                score += 2.0 * sum("constructor" in d for d in named)
        score = round(score - min(s / 10000, 0.6), 6)
        if best is None or score > best[2]:
            best = s, min(len(lines), s + 79), score
    return best and (best[0], best[1], max(best[2], 0.0))


def test_windows_of_code(spark):
    rng = random.Random(5)
    pieces = ["export class Foo {", "function checkClassConstructor(x) {", "function parseClassMember() {}", "  emitNode(node); function emitNode2() {}", "interface ErrorType {}", "function reportError() {}", "// the decorator must be valid", "let x = checker.check(decorator, decorator)", "}", "", "  return syntax token", "type Alias = string", "plain line", "Another CLASS of DECORATOR words"]
    files = {f"f{k}": "\n".join(rng.choice(pieces if rng.random() < 0.3 else ["x", "y = 1", ""]) for _ in range(rng.choice([1, 5, 79, 80, 81, 120, 121, 300]))) + "\n" * (k % 2) for k in range(12)}
    files |= {"empty": "", "null": None, "one": "decorator"}
    queries = ["Where is the `decorator must be` check of a class constructor?", "find parser tokens", "emit", "zzzz unknown words only"]
    asked = [(i, r, f, q, *ROLES[r]) for i, q in enumerate(queries) for r in ROLES for f in [*files, "missing"]]
    df = spark.createDataFrame(asked, "item_id int, role string, key string, query string, keywords array<string>, hints array<string>, support array<string>")
    got = {(r["item_id"], r["role"], r["key"]): (r["line_start"], r["line_end"], r["score"]) for r in W.best_windows(df, spark.createDataFrame(list(files.items()), "key string, text string")).collect()}
    want = {(i, r, f): plain(r, q, files[f]) for i, r, f, q, *_ in asked if files.get(f)}
    assert got == {k: v for k, v in want.items() if v}
