"""The best window of lines in each file, by positional postings and running sums over lines.

A file is read once: every line gives postings (feature, line, count) of the terms and phrases that anyone asks for in it and
of what its declarations say. Running sums of each feature's counts, kept at the lines where windows begin or end, then give
every window's counts as a difference of two, however many windows overlap, and no window is read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.text import lines
from ..sources.stored import stored
from .chunks import DECLARATION

SIZE, STEP, BEFORE, FIRST_TERMS = 80, 40, 20, 18
#: What begins a declaration, and by role the words of a declared function's name, points for one, and for a
#: window that has one.
DECLARED = r"\b(?:function|class|interface|enum|type)\s+[A-Za-z_][A-Za-z0-9_]*"
NAMED_FUNCTION = r"\bfunction\s+[A-Za-z_][A-Za-z0-9_]*\b"
VERBS = {"validation_checking": ("check|validate|verify", 3.0, 2.5), "input_parsing": ("parse|scan|read", 3.0, 2.5), "behavior_output": ("emit|render|transform|serialize|generate", 3.0, 2.5)}
KINDS, KIND_POINTS, KIND_WINDOW = "interface|enum|type|class", 2.5, 2.2
REPORTS, REPORT_POINTS, REPORT_WINDOW = "report|error|diagnostic|message", 2.0, 1.8
#: Words of a query that ask for classes or constructors, and what they are worth in a declaration.
WANTS_CLASS, WANTS_CONSTRUCTOR = "class|extends|implements|base", "constructor|super"
CLASS_POINTS = {"validation_checking": ("class", 4.0), "input_parsing": ("class|member|declaration|statement", 2.0)}
CONSTRUCTOR_POINTS = {"validation_checking": ("constructor", 2.0)}
ITEM = ["item_id", "role"]


def asked_terms(asked: DataFrame) -> DataFrame:
    """``asked(item_id, role, key, query, keywords, hints, support)`` with ``terms`` in their order, the query's own (``specific``)
    first, its ``phrases`` and what it wants."""
    generic = F.array_distinct(F.concat("keywords", "hints", "support"))
    said = F.array_distinct(T.owner_tokens(F.col("query")))
    q = asked.withColumns({"generic": generic, "specific": F.array_except(said, generic)})
    terms = F.filter(F.array_distinct(F.concat("specific", said, "generic")), lambda t: F.length(t) >= 3)
    low = F.lower("query")
    return q.withColumns({"terms": terms, "phrases": T.phrases(F.col("query")), "wants_class": low.rlike(WANTS_CLASS), "wants_constructor": low.rlike(WANTS_CONSTRUCTOR)})


def _declared(line: Column, pattern: str, function: bool = True) -> Column:
    """How many declarations of a line, of functions only, have one of the words."""
    found = F.transform(F.regexp_extract_all(line, F.lit(DECLARED), F.lit(0)), lambda x: F.lower(x))
    return F.size(F.filter(found, lambda x: x.rlike(pattern) & (x.startswith("function") if function else F.lit(True))))


def line_features(line: Column, declaration: str) -> dict[str, Column]:
    """Counts of a line by feature: ``d`` for a declaration, ``own ROLE`` for what makes a window of the role, ``decl``,
    ``class`` and ``ctor`` for its declarations and those that speak of classes or constructors."""
    low = F.lower(line)
    out = {"d": (line.rlike(declaration) | line.rlike(NAMED_FUNCTION)).cast("int")}
    for role, (verbs, *_) in VERBS.items():
        out[f"own {role}"] = low.rlike(rf"\bfunction\s+[A-Za-z_][A-Za-z0-9_]*({verbs})").cast("int")
        out[f"decl {role}"] = _declared(line, verbs)
    out |= {"own representation": low.rlike(r"\b(?:class|interface|enum|type)\s+[A-Za-z_][A-Za-z0-9_]*").cast("int"), "decl representation": _declared(line, KINDS, False)}
    out |= {"own diagnostics": low.rlike(REPORTS).cast("int"), "decl diagnostics": _declared(line, REPORTS)}
    both = lambda role, words: _declared(line, rf"^(?=.*(?:{VERBS[role][0]})).*(?:{words})")
    out |= {f"class {role}": both(role, words) for role, (words, _) in CLASS_POINTS.items()}
    return out | {f"ctor {role}": both(role, words) for role, (words, _) in CONSTRUCTOR_POINTS.items()}


def positions(files: DataFrame, wanted: DataFrame, declaration: str = DECLARATION) -> DataFrame:
    """Positional postings ``(key, no, feature, n)`` of ``files(key, text)``: of the terms and phrases of ``wanted(key, wanted)`` as
    they stand in lower-case lines, behind ``=``, and of the lines' declarations."""
    per_line = files.join(wanted, "key").select("key", "wanted", F.posexplode(lines(F.col("text"))).alias("no", "line")).withColumns({"no": F.col("no") + 1, "low": F.lower("line")})
    count = lambda t: ((F.length("low") - F.length(F.replace(F.col("low"), t))) / F.length(t)).cast("int")
    said = F.transform(F.filter("wanted", lambda t: F.contains(F.col("low"), t)), lambda t: F.struct(F.concat(F.lit("="), t).alias("feature"), count(t).alias("n")))
    marks = F.array(*(F.struct(F.lit(name).alias("feature"), n.alias("n")) for name, n in line_features(F.col("line"), declaration).items()))
    return per_line.select("key", "no", F.inline(F.concat(said, F.filter(marks, lambda x: x["n"] > 0))))


def window_starts(asked: DataFrame, sizes: DataFrame, postings: DataFrame) -> DataFrame:
    """``(item_id, role, key, a, b, place)``: windows at every fortieth line, then 20 lines before each declaration and each line
    with one of the first terms; a line at which several begin counts once."""
    j = asked.join(sizes, "key")
    last = F.greatest(F.lit(0), F.ceil((F.col("lines") - SIZE) / F.lit(float(STEP))).cast("int") * STEP)
    grid = j.where("lines > 0").select(*ITEM, "key", "lines", F.explode(F.sequence(F.lit(0), last, F.lit(STEP))).alias("a"), F.lit(0).alias("kind")).withColumn("a", F.col("a") + 1)
    first = F.concat(F.array(F.lit("d")), F.transform(F.slice("terms", 1, FIRST_TERMS), lambda t: F.concat(F.lit("="), t)))
    heads = j.select(*ITEM, "key", "lines", F.explode(first).alias("feature"))
    hits = heads.join(postings, ["key", "feature"]).select(*ITEM, "key", "lines", F.greatest(F.lit(1), F.col("no") - BEFORE).alias("a"), F.lit(1).alias("kind")).distinct()
    every = grid.unionByName(hits).groupBy(*ITEM, "key", "lines", "a").agg(F.min("kind").alias("kind"))
    return every.select(*ITEM, "key", "a", F.least(F.col("lines"), F.col("a") + SIZE - 1).alias("b"), F.struct("kind", "a").alias("place"))


def running_counts(postings: DataFrame, bounds: DataFrame) -> DataFrame:
    """``(key, no, counts)``: at each line of ``bounds(key, no)`` how often each feature of the file has come up to it, in the order
    of the features' names."""
    features = postings.select("key", "feature").distinct()
    asked = bounds.join(features, "key").select("key", "feature", "no", F.lit(0).alias("n"), F.lit(True).alias("asked"))
    both = postings.select("key", "feature", "no", "n", F.lit(False).alias("asked")).unionByName(asked)
    run = Window.partitionBy("key", "feature").orderBy("no", "asked").rowsBetween(Window.unboundedPreceding, 0)
    sums = both.withColumn("c", F.sum("n").over(run)).where("asked")
    return sums.groupBy("key", "no").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "c"))), lambda x: x["c"]).alias("counts"))


def term_weight(frequency: Column, specific: Column, generic: Column) -> Column:
    """What a term is worth by how often its file has it; the query's own terms more, the role's less."""
    rare = F.when(frequency == 1, 2.2).when(frequency <= 3, 1.8).when(frequency <= 8, 1.2).otherwise(0.8)
    return (rare + F.when(specific, 0.8).otherwise(0.0)) * F.when(generic, 0.45).otherwise(1.0)


def _score(at) -> Column:
    """A window's points; ``at(place)`` is how often the feature at a place of the file's list is in it, 0 for none."""
    add = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda s, x: s + f(x))
    terms = add("weights", lambda t: F.when(at(t["at"]) > 0, t["w"] + F.least(at(t["at"]), F.lit(4)) * F.least(t["w"] * 0.2, F.lit(0.5))).otherwise(0.0))
    own = add("weights", lambda t: F.when((at(t["at"]) > 0) & t["specific"], 1.0).otherwise(0.0))
    words = add("weights", lambda t: F.when((at(t["at"]) > 0) & t["keyword"], 0.6).otherwise(0.0))
    phrases = add("phrases_at", lambda p: F.when(at(p) > 0, 3.0).otherwise(0.0))
    specific = F.when(F.size("specific") == 0, 0.0).when(own == 0, -2.5).otherwise(F.least(own, F.lit(4.0)) * 1.25)
    marks = add("marks", lambda m: F.when(m["once"], F.least(at(m["at"]), F.lit(1))).otherwise(at(m["at"])) * m["points"])
    return terms + phrases + specific + words + marks - F.least(F.col("a") / 10000.0, F.lit(0.6))


def _marks() -> Column:
    """What the features of a role's declarations are worth to whom asks."""
    role = F.col("role")
    points = {r: (decl, own) for r, (_, decl, own) in VERBS.items()} | {"representation": (KIND_POINTS, KIND_WINDOW), "diagnostics": (REPORT_POINTS, REPORT_WINDOW)}
    out = []
    for r, (decl, own) in points.items():
        out += [(r, f"own {r}", True, own, F.lit(True)), (r, f"decl {r}", False, decl, F.lit(True))]
    out += [(r, f"class {r}", False, p, F.col("wants_class")) for r, (_, p) in CLASS_POINTS.items()]
    out += [(r, f"ctor {r}", False, p, F.col("wants_constructor")) for r, (_, p) in CONSTRUCTOR_POINTS.items()]
    place = lambda name: F.coalesce(F.array_position("features", F.lit(name)).cast("int"), F.lit(0)) - 1
    every = F.array(*(F.struct(((role == r) & wanted).alias("mine"), place(name).alias("at"), F.lit(once).alias("once"), F.lit(p).alias("points")) for r, name, once, p, wanted in out))
    return F.filter(every, lambda m: m["mine"] & (m["at"] >= 0))


def best_windows(asked: DataFrame, files: DataFrame, declaration: str = DECLARATION) -> DataFrame:
    """``(item_id, role, key, line_start, line_end, score)``: of each file of ``asked(item_id, role, key, query, keywords, hints,
    support)`` the 80 lines with the highest score, 0 at least; of equal ones the first of the windows in their order.

    Keys are those of ``files(key, text)``; a file that isn't there or has no lines gives no row. Declarations are
    looked for within lines.
    """
    asked = stored(asked_terms(asked), "asked")
    wanted = asked.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_set(F.concat("terms", "phrases")))).alias("wanted"))  # of one file's askers
    mine = files.join(asked.select("key").distinct(), "key", "left_semi")
    postings = stored(positions(mine, wanted, declaration), "positions")
    sizes = mine.select("key", F.size(lines(F.col("text"))).alias("lines"))
    windows = stored(window_starts(asked, sizes, postings), "windows")
    bounds = windows.select("key", (F.col("a") - 1).alias("no")).union(windows.select("key", "b")).distinct()
    counts = running_counts(postings, bounds)
    total = postings.groupBy("key", "feature").agg(F.sum("n").alias("n")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("feature", "n"))).alias("f"))
    total = total.select("key", F.transform("f", lambda x: x["feature"]).alias("features"), F.transform("f", lambda x: x["n"]).alias("totals"))
    place = lambda t: F.array_position("features", F.concat(F.lit("="), t)).cast("int") - 1
    weigh = lambda t: F.struct(place(t).alias("at"), term_weight(F.get("totals", place(t)), F.array_contains("specific", t), F.array_contains("generic", t)).alias("w"), F.array_contains("specific", t).alias("specific"), F.array_contains("keywords", t).alias("keyword"))
    none = F.array().cast("array<string>")
    known = asked.join(total, "key", "left").withColumn("features", F.coalesce("features", none))
    known = known.select(*ITEM, "key", "specific", F.transform(F.filter("terms", lambda t: place(t) >= 0), weigh).alias("weights"), F.filter(F.transform("phrases", place), lambda p: p >= 0).alias("phrases_at"), _marks().alias("marks"))
    up_to = lambda name, no: counts.select("key", F.col("no").alias(no), F.col("counts").alias(name))
    j = windows.withColumn("before", F.col("a") - 1).join(known, [*ITEM, "key"]).join(up_to("c0", "before"), ["key", "before"], "left").join(up_to("c1", "b"), ["key", "b"], "left")
    scored = j.select(*ITEM, "key", "a", "b", "place", F.round(_score(lambda p: F.get("c1", p) - F.get("c0", p)), 6).alias("score"))
    order = F.struct(F.col("score"), (-F.col("place.kind")).alias("k"), (-F.col("a")).alias("a"))
    best = scored.groupBy(*ITEM, "key").agg(F.max_by(F.struct("a", "b", "score"), order).alias("x"))
    return best.select(*ITEM, "key", F.col("x.a").alias("line_start"), F.col("x.b").alias("line_end"), F.greatest(F.col("x.score"), F.lit(0.0)).alias("score"))
