"""What the five retrieval roles look for, and the scores that validate and rank candidates for them.

Roles enter as a table, one row each with its words; all scores are columns over ``(role..., query, path, text)``. Matches
are by substring, on lower-case text and paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import paths as P

#: Words, path hints, support hints, threshold, roles whose anchors count, whether calls count.
ROLES = (
    ("representation", "model schema type symbol node declaration structure metadata", "types symbols ast nodes schema model", "parser checker binder", 3.0, "input_parsing validation_checking representation", False),
    ("input_parsing", "parse parser parsing scanner syntax token modifier keyword grammar declaration receive request payload endpoint handler route status", "parser scanner syntax api server route handler", "checker binder resolver client", 3.0, "representation input_parsing", False),
    ("validation_checking", "check checker validation constraint rule semantic verify error diagnostic enforce", "checker semantic validator validate resolver rules", "parser scanner types binder", 3.2, "input_parsing representation validation_checking", True),
    ("diagnostics", "diagnostic diagnostics error message report failure", "diagnostic diagnostics message messages error", "checker parser", 2.5, "input_parsing validation_checking diagnostics", False),
    ("behavior_output", "emit output runtime render display show visible component state transform serialize generate behavior", "emitter emit runtime transform renderer output ui component view app", "parser syntax checker", 3.1, "input_parsing validation_checking behavior_output", True),
)
#: Words of queries that say nothing concrete.
COMMON = "about after already also before code context does file find from have implementation into issue logic need needed right shows system that there this through where whether with"
#: Path and text marks of the responsibility profile.
NOISE_PATHS = "/test/ /tests/ /fixture /fixtures/ /baseline /generated/ /node_modules/"
HELPERS = "helper helpers util utils utilities common"
PLUMBING = "commandline services server project config options watch"
LOW_LEVEL = "src/datetime np_datetime npdatetime conversion convert"
PUBLIC_PATHS = "api indexes index arrays series frame timestamp datetimes"
PUBLIC_TEXTS = ("export class", "export function", "public ", "__all__", "api")
SCHEMA = "role string, keywords array<string>, hints array<string>, support array<string>, threshold double, anchors array<string>, calls boolean"


def role_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, k.split(), h.split(), s.split(), t, a.split(), c) for r, k, h, s, t, a, c in ROLES], SCHEMA)


def any_in(words: Column, text: Column) -> Column:
    return F.exists(words, lambda w: F.contains(text, w))


def _words(names: str) -> Column:
    return F.array(*map(F.lit, names.split()))


def _one_of(names: str, text: Column) -> Column:
    return text.rlike("|".join(names.split()))


def query_term_score(query: Column, helpers: Column, path: Column, text: Column) -> Column:
    """0.7 for each longer query word in the path and 0.35 in the text, 0.25 for each helper phrase behind the first in it."""
    p, t = P.folded(path), F.lower(text)
    words = F.filter(F.transform(F.split(F.trim(F.lower(query)), r"\s+"), lambda w: F.regexp_replace(w, r"^[ ?!.,:;()\[\]{}\"']+|[ ?!.,:;()\[\]{}\"']+$", "")), lambda w: F.length(w) >= 4)
    rest = F.filter(F.transform(F.slice(helpers, 2, 1 << 20), lambda h: F.trim(F.lower(h))), lambda h: (h != "") & F.contains(t, h))
    hit = lambda where, points: F.size(F.filter(words, lambda w: F.contains(where, w))) * F.lit(points)
    return hit(p, 0.7) + hit(t, 0.35) + F.size(rest) * F.lit(0.25)


def concrete_overlap(query: Column, helpers: Column, path: Column, text: Column, generic: Column) -> Column:
    """Whether the path or text has a query word of four letters that is neither common nor the role's own."""
    hay = F.lower(F.concat(path, F.lit("\n"), text))
    said = F.lower(F.replace(F.concat_ws(" ", query, helpers), F.lit("_"), F.lit(" ")))
    words = F.transform(F.split(said, r"\s+"), lambda w: F.regexp_replace(w, r"^[ ?!.,:;()\[\]{}\"']+|[ ?!.,:;()\[\]{}\"']+$", ""))
    return F.exists(words, lambda w: (F.length(w) >= 4) & ~F.array_contains(generic, w) & ~F.array_contains(_words(COMMON), w) & F.contains(hay, w))


def validated(candidates: DataFrame, places: int = 3) -> DataFrame:
    """``candidates`` (a role's columns, ``query, helpers, path, text``, ``near`` as depth of the deepest prefix shared with an
    anchor, ``depends`` and ``called`` as whether an anchor's files say so) with the five parts of the validation, their
    sum, what it was accepted by and whether it passed. Parts and sum are rounded half to even."""
    q, h, p, t = (F.col(c) for c in ("query", "helpers", "path", "text"))
    folded = P.folded(p)
    generic = F.concat("keywords", "hints", "support")
    c = candidates.withColumns({
        "said": any_in(F.col("keywords"), F.lower(t)), "own": any_in(F.col("hints"), folded), "aside": any_in(F.col("support"), folded),
        "concrete": concrete_overlap(q, h, p, t, generic), "base": query_term_score(q, h, p, t),
    })
    said, own, concrete = F.col("said"), F.col("own"), F.col("concrete")
    off = F.col("aside") & ~said
    pick = lambda a, b: F.when(concrete, a).otherwise(b)
    local = F.col("base") + F.when(said, pick(1.0, 0.2)).otherwise(0.0) + F.when(said & own, pick(0.7, 0.1)).otherwise(0.0) - F.when(off, 0.5).otherwise(0.0)
    role_path = F.when(own, pick(1.4, 0.4)).otherwise(0.0) - F.when(off, 1.0).otherwise(0.0)
    depends, called = F.when(F.col("depends"), 2.2).otherwise(0.0), F.when(F.col("called") & F.col("calls"), 1.5).otherwise(0.0)
    c = c.withColumns({"local": local, "role_path": role_path, "dependency": depends, "proximity": P.proximity(F.col("near")), "call": called})
    total = F.col("local") + F.col("role_path") + F.col("dependency") + F.col("proximity") + F.col("call")
    by = F.when(F.col("dependency") > 0, "dependency_supported").when((F.col("proximity") > 0) | (F.col("call") > 0), "anchor_boosted").otherwise("local_only")
    c = c.withColumns({"total": F.bround(total, places), "accepted_by": by})
    c = c.withColumns({x: F.bround(x, places) for x in ("local", "role_path", "dependency", "proximity", "call")})
    return c.withColumn("accepted", F.col("total") >= F.col("threshold")).drop("said", "own", "aside", "concrete", "base")


def profiled(candidates: DataFrame, roles: DataFrame) -> DataFrame:
    """``candidates`` (a role's columns, ``path, text``) with owner and support signals, ``profile`` and its reasons."""
    hints_of = {r["role"]: r["hints"] for r in roles.collect()}  # as many rows as there are roles
    p, t, role = P.folded(F.col("path")), F.lower("text"), F.col("role")
    own, said = any_in(F.col("hints"), p), any_in(F.col("keywords"), t)
    other = F.lit(False)
    for name, hints in hints_of.items():
        other = other | ((role != name) & p.rlike("|".join(hints)))
    catalog = (role != "diagnostics") & (p.rlike("|".join(hints_of.get("diagnostics", ["(?!)"]))) | (P.name(p).endswith(".json") & t.rlike("diagnostic|error|message")))
    noise = P.file_role(p).isin("test", "baseline_or_generated") | _one_of(NOISE_PATHS, p)
    signals = [  # owner points, support points, holds, reason
        (3.0, 0, own, F.concat(role, F.lit("_owner_path"))), (2.2, 0, said, F.concat(role, F.lit("_text"))), (1.4, 0, _one_of(PUBLIC_PATHS, p), F.lit("public_api_path")),
        (1.2, 0, any_in(F.array(*map(F.lit, PUBLIC_TEXTS)), t), F.lit("public_surface_text")), (0, 2.5, any_in(F.col("support"), p), F.concat(F.lit("adjacent_"), role, F.lit("_support_layer"))),
        (0, 1.5, (role != "diagnostics") & F.contains(t, F.lit("diagnostic")) & ~said, F.lit("diagnostic_text_without_enforcement")), (0, 2.0, _one_of(HELPERS, p), F.lit("helper_path")),
        (0, 1.8, _one_of(PLUMBING, p) & ~role.isin("config", "docs"), F.lit("plumbing_path")), (0, 2.3, _one_of(LOW_LEVEL, p), F.lit("low_level_leaf")), (0, 3.0, other & ~own, F.lit("cross_role_owner_path")),
    ]
    flags = {f"s{i}": s[2] for i, s in enumerate(signals)}
    c = candidates.withColumns(flags | {"noise": noise, "catalog": catalog})
    points = lambda k: sum((F.when(F.col(f"s{i}"), float(s[k])).otherwise(0.0) for i, s in enumerate(signals) if s[k]), F.lit(0.0))
    why = F.array_compact(F.array(*[F.when(F.col(f"s{i}"), s[3]) for i, s in enumerate(signals)]))
    c = c.withColumns({"owner": points(0), "aids": points(1), "why": why})
    o, a = F.col("owner"), F.col("aids")
    neutral = (a <= 0) & (o < 2.0) & (o < a + 1.2)
    profile = F.when(F.col("noise"), "noise").when(F.col("catalog"), "support_only").when(o >= a + 1.2, "likely_owner").when(o >= 2.0, "possible_owner").when(a > 0, "support_only").otherwise("possible_owner")
    reasons = F.when(F.col("noise"), F.array(F.lit("test_or_generated_path"))).when(F.col("catalog"), F.array(F.lit("diagnostics_catalog"))).when(neutral, F.concat("why", F.array(F.lit("neutral_implementation_file")))).otherwise(F.col("why"))
    return c.withColumns({"profile": profile, "reasons": reasons}).drop(*flags, "why", "noise", "catalog")


def responsibility(c: DataFrame) -> DataFrame:
    """Profiled candidates with ``retrieval``, ``validation`` and ``in_graph``: the responsibility score."""
    profile = F.col("profile")
    bonus = F.when(profile == "likely_owner", 2.0).when(profile == "possible_owner", 0.8).otherwise(0.0)
    penalty = F.when(profile == "noise", 10.0).when(profile == "support_only", 5.0).otherwise(0.0)
    base = F.least("retrieval", F.lit(8.0)) + F.least("validation", F.lit(5.0))
    return c.withColumn("responsibility", base + F.col("owner") + bonus + F.when(F.col("in_graph"), 2.0).otherwise(0.0) - penalty)


def rank_weight(path: Column) -> Column:
    """Weight of a candidate's file role times that of its category."""
    role = P.file_role(path)
    by_role = F.when(role == "implementation", 1.3).when(role == "documentation", 0.85).when(role == "test", 0.2).when(role == "baseline_or_generated", 0.1).otherwise(0.6)
    return by_role * F.when(P.category(path) == "source_code", 1.3).otherwise(0.8)


def final_score(base: Column, quality: Column, stage: Column, is_file: Column) -> Column:
    """Score by which a role's bucket is finally ordered; for rows with a role's columns, ``path`` and ``text``."""
    p, t, role = P.folded(F.col("path")), F.lower("text"), F.col("role")
    said = any_in(F.concat("keywords", "hints", "support"), t)
    own, aside = any_in(F.col("hints"), p), any_in(F.col("support"), p)
    yes = lambda cond, points: F.when(cond, points).otherwise(0.0)
    score = base + F.when(quality == "core", 4.0).when(quality == "secondary", 1.0).when(quality == "noise", -8.0).otherwise(0.0)
    score += yes(stage == "role_completion", -1.25) + yes(stage.startswith("role_followup_"), 1.5) + yes(is_file, -4.0) + yes(said, 2.0) + yes(own, 1.5) + yes(aside & ~said, -1.5)
    score += yes((role == "representation") & t.rlike(r"\b(?:class|interface|enum|type)\s+[a-z_][a-z0-9_]*"), 1.5)
    return score + yes(role.isin("input_parsing", "validation_checking", "behavior_output") & t.rlike(r"\bfunction\s+[a-z_][a-z0-9_]*"), 1.0)
