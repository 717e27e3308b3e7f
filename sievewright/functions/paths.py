"""Column builders that classify paths.

Two normal forms, which are not interchangeable: :func:`clean` keeps the case, :func:`folded` does not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What makes a path documentation, generated, a test or an implementation; the first that holds counts.
DOCUMENTATION = r"(^|/)[^/]+\.(md|rst|adoc)$|(^|/)(docs|documentation)(/|$)"
GENERATED = r"(^|/)(bin|baselines|snapshots)(/|$)|baseline|snapshot|golden|generated"
TEST = r"(^|/)(test|tests|__tests__|spec|fixtures)(/|$)|\.(test|spec)\.(ts|js)$"
IMPLEMENTATION = r"(^|/)(src|lib|app|packages|pkg|core|compiler)/"
#: Documents by category, and marks of files that are authored.
DOCUMENT_CATEGORY = r"(^|/)[^/]+\.(md|txt)$|(^|/)(docs|documentation)(/|$)"
AUTHORED = r"(^|/)(src|source|app|packages)(/|$)"
#: Reasons for which a file counts as built, in this order.
BUILT_MARKS = (("path_contains_bin", r"(^|/)bin(/|$)"), ("path_contains_baseline", "baseline"), ("path_contains_snapshot", "snapshot"), ("path_contains_golden", "golden"), ("path_contains_generated_marker", "generated"))
ROLE_ORDER = ("implementation", "other", "test", "documentation", "baseline_or_generated")
SOURCE_SUFFIXES = r"\.(ts|tsx|js|jsx|py|c|cc|cpp|h|hpp|java|cs)$"


def clean(path: Column) -> Column:
    """Slashes only, none doubled, none at either end."""
    return F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+", "/"), "^/|/$", "")


def folded(path: Column) -> Column:
    return F.lower(F.trim(F.replace(path, F.lit("\\"), F.lit("/"))))


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(name(path), r"(.)\.[^.]+$", "$1")


def file_role(path: Column) -> Column:
    p = folded(path)
    chain = F.when(p.rlike(DOCUMENTATION), "documentation").when(p.rlike(GENERATED), "baseline_or_generated").when(p.rlike(TEST), "test")
    return chain.when(p.rlike(IMPLEMENTATION), "implementation").otherwise("other")


def role_order(role: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ROLE_ORDER)), role)


def category(path: Column) -> Column:
    return F.when(folded(path).rlike(DOCUMENT_CATEGORY), "documentation").otherwise("source_code")


def is_skipped(path: Column) -> Column:
    return (file_role(path) == "baseline_or_generated") | folded(path).rlike("(^|/)bin/")


def phase_allowed(role: Column, path: Column) -> Column:
    """Whether a role may use the file: implementations without test gear, those of diagnostics for diagnostics alone."""
    p, kind = folded(path), file_role(path)
    gear = p.contains("harness") | p.contains("fixture")
    marked = p.contains("diagnostic")
    return (kind == "implementation") & ~gear & F.when(role == "diagnostics", marked | p.endswith(".json")).otherwise(~marked)


def anchor_allowed(path: Column) -> Column:
    p = folded(path)
    return (file_role(path) == "implementation") & ~p.contains("harness") & ~p.contains("fixture")


def variants(token: Column) -> Column:
    """A token, the doer of an -ing form, and the first letters of a long one."""
    doer = F.when(token.endswith("ing") & (F.length(token) > 5), F.concat(F.substring(token, 1, F.length(token) - 3), F.lit("er")))
    return F.array_distinct(F.array_compact(F.array(token, doer, F.when(F.length(token) >= 7, F.substring(token, 1, 3)))))


def owner_match(path: Column, terms: Column) -> Column:
    """Whether the path names an artifact: for some term each of its first three tokens in the compact path or the stem, or
    one token of four letters in the stem."""
    p = folded(path)
    compact, own = F.regexp_replace(p, "[^a-z0-9]+", ""), stem(p)
    tokens = lambda t: F.filter(F.split(F.lower(t), "[^a-z0-9]+"), lambda x: F.length(x) >= 3)

    def hit(t: Column) -> Column:
        first = F.slice(tokens(t), 1, 3)
        every = (F.size(first) > 0) & F.forall(first, lambda x: F.exists(variants(x), lambda v: compact.contains(v) | own.contains(v)))
        return every | F.exists(tokens(t), lambda x: (F.length(x) >= 4) & F.exists(variants(x), lambda v: own.contains(v)))

    return F.exists(terms, hit)


def built_reasons(path: Column) -> Column:
    p = folded(path)
    return F.array_compact(F.array(*[F.when(p.rlike(mark), F.lit(why)) for why, mark in BUILT_MARKS]))


def artifact(path: Column) -> Column:
    """Struct of role, kind, confidence and reasons of a selected file."""
    why, authored = built_reasons(path), folded(path).rlike(AUTHORED)
    built = F.size(why) > 0
    return F.struct(
        F.when(built, "baseline_or_generated").when(authored, "implementation").otherwise("other").alias("role"),
        F.when(F.array_contains(why, "path_contains_bin"), "built_or_distribution_artifact").when(built, "generated_or_baseline_artifact").when(authored, "source_authoring_file").otherwise("unknown").alias("kind"),
        F.when(built, "high").when(authored, "medium").otherwise("low").alias("confidence"),
        F.when(built, why).when(authored, F.array(F.lit("source_path_marker"))).otherwise(F.array(F.lit("no_generated_or_source_marker"))).alias("reasons"),
    )


def role_agreement(said: Column, found: Column) -> Column:
    """Whether a stated role agrees with the classified one."""
    s, f = F.lower(F.trim(said)), F.lower(F.trim(found))
    made, is_made = s.isin("baseline_or_generated", "generated", "built", "symptom_surface"), f == "baseline_or_generated"
    owner = s.isin("implementation_owner", "supporting_implementation", "implementation")
    return F.when(F.coalesce(s, F.lit("")) == "", "unknown").when(made == is_made, "agree").when(is_made & owner, "mismatch").otherwise("different")


def prefix_depth(a: Column, b: Column) -> Column:
    """Leading path parts that are the same."""
    pa, pb = F.split(folded(a), "/"), F.split(folded(b), "/")
    same = F.zip_with(pa, pb, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def proximity(depth: Column) -> Column:
    return F.when(depth >= 3, 1.4).when(depth == 2, 0.9).when(depth == 1, 0.4).otherwise(0.0)


def resolved(base: Column, reference: Column) -> Column:
    """The path that a reference in the file ``base`` names; null for packages, absolute paths, URLs and what leaves the root.

    A reference without a known suffix gets the file's own or ``.ts``.
    """
    b, r = F.trim(F.replace(base, F.lit("\\"), F.lit("/"))), F.trim(F.replace(reference, F.lit("\\"), F.lit("/")))
    own = F.regexp_extract(name(b), r"^.+(\.[^.]+)$", 1)
    suffix = F.when(F.lower(own).rlike(SOURCE_SUFFIXES), own).otherwise(".ts")
    whole = F.when(F.lower(r).rlike(SOURCE_SUFFIXES), r).otherwise(F.concat(r, suffix))
    parts = F.filter(F.split(F.concat(F.regexp_replace(b, "[^/]*$", ""), whole), "/"), lambda x: (x != "") & (x != "."))
    none = F.array().cast("array<string>")
    up = F.lit("..")

    def step(done: Column, x: Column) -> Column:  # null once the root is left
        return F.when(x != up, F.concat(done, F.array(x))).when(F.size(done) > 0, F.slice(done, 1, F.size(done) - 1))

    out = F.aggregate(parts, none, step)
    bad = (r == "") | (b == "") | r.contains(":") | r.startswith("/")
    return F.when(~bad & (F.size(out) > 0), F.array_join(out, "/"))
