"""Queries: candidates of each item validated, profiled and selected for each role."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import roles as R
from ..sources.stored import stored
from ..sources.tables import load, repository
from .repository import _LINES
from .search import ITEMS, PARTS, bm25_ranked
from .shared import GRAPH_SQL, symbol_graph

ITEM = ["item_id", "role"]


def _candidates(spark, d, k=8):
    """The best hits of each item with path and text, for each role."""
    items = load(spark, d, "benchmark")
    hits = bm25_ranked(spark, d, k).withColumnRenamed("score", "retrieval")
    helpers = F.array(F.col("text"), F.regexp_extract("text", r"^\S+ \S+", 0))
    asked = items.select("item_id", F.col("text").alias("query"), helpers.alias("helpers"))
    return hits.join(repository(spark, d), "doc_id").join(asked, "item_id").crossJoin(F.broadcast(R.role_table(spark)))  # one row a role


def _profiled(spark, d):
    """Candidates with their profiles, stored: what follows reads the columns that it needs, texts only where it scores them."""
    return stored(R.profiled(_candidates(spark, d), R.role_table(spark)), "candidates")


def _anchors(profiled):
    """Of each item and role the first candidate that is more than support."""
    own = profiled.where(~F.col("profile").isin("noise", "support_only"))
    return own.groupBy("item_id", F.col("role").alias("anchor_role")).agg(F.min_by("path", F.struct("rank", "doc_id")).alias("anchor"))


def _supported(spark, d):
    """Candidates with what the anchors of compatible roles say about them: prefix depth, dependency, call, graph."""
    profiled = _profiled(spark, d)
    nodes, edges = symbol_graph(spark, d)
    at = lambda x, y: nodes.select(F.col("id").alias(x), F.col("path").alias(y))
    links = edges.join(at("src", "a"), "src").join(at("dst", "b"), "dst").select("a", "b", (F.col("kind") == "calls").alias("call"))
    links = stored(links.union(links.select("b", "a", "call")).groupBy("a", "b").agg(F.max("call").alias("call"), F.min("call").alias("only")), "links")
    anchors = _anchors(profiled)
    pairs = profiled.select("item_id", "role", "doc_id", "path", F.explode("anchors").alias("anchor_role")).join(anchors, ["item_id", "anchor_role"])
    near = F.when(F.col("anchor") != F.col("path"), P.prefix_depth(F.col("path"), F.col("anchor"))).otherwise(0)
    j = pairs.join(links, (F.col("anchor") == F.col("a")) & (F.col("path") == F.col("b")), "left")
    said = j.groupBy("item_id", "role", "doc_id").agg(F.max(near).alias("near"), F.coalesce(F.max("call"), F.lit(False)).alias("called"), F.coalesce(F.max(~F.col("only")), F.lit(False)).alias("linked"), F.count("a").alias("n"))
    c = profiled.join(said, ["item_id", "role", "doc_id"], "left")
    return c.withColumns({"near": F.coalesce("near", F.lit(0)), "called": F.coalesce("called", F.lit(False)), "depends": F.coalesce("linked", F.lit(False)) & (F.col("role") == "representation"), "in_graph": F.coalesce(F.col("n") > 0, F.lit(False))})


def _scored(spark, d):
    c = R.validated(_supported(spark, d)).withColumn("validation", F.col("total"))
    return stored(R.responsibility(c), "scored")


def role_validation(spark, d):
    """The five parts of each candidate's validation, their sum and what it was accepted by."""
    return R.validated(_supported(spark, d)).select("item_id", "role", "doc_id", "local", "role_path", "dependency", "proximity", "call", "total", "accepted", "accepted_by")


def role_profiles(spark, d):
    """Owner and support signals, profile, reasons and responsibility of each candidate."""
    c = _scored(spark, d)
    return c.select("item_id", "role", "doc_id", F.round("owner", 3).alias("owner"), F.round("aids", 3).alias("support"), "profile", F.array_join("reasons", ",").alias("reasons"), F.round("responsibility", 3).alias("score"))


def role_bucket(spark, d, most=2):
    """Of each item and role the candidates that are accepted, by responsibility, with their final score.

    Noise and diagnostics catalogs never are; support only where nothing else is there; and what is not on an owner's path
    gives way where a validated candidate is on one.
    """
    c = _scored(spark, d)
    own = R.any_in(F.col("hints"), P.folded(F.col("path")))
    good = ~F.col("profile").isin("noise", "support_only")
    w = Window.partitionBy(*ITEM)
    c = c.withColumns({"own": own, "some": F.max(good).over(w), "placed": F.max(good & own & F.col("accepted")).over(w)})
    catalog = F.array_contains("reasons", "diagnostics_catalog")
    taken = (F.col("profile") != "noise") & ~catalog & ~(F.col("placed") & ~F.col("own")) & ((F.col("profile") != "support_only") | ~F.col("some"))
    key = F.round(F.col("retrieval") * R.rank_weight(F.col("path")), 6)
    final = R.final_score(F.col("total"), F.when(F.col("rank") <= 2, "core").when(F.col("rank") <= 5, "secondary").otherwise("noise"), F.lit("responsibility_rerank"), F.lit(False))
    kept = c.where(taken).withColumns({"key": key, "final": F.round(final, 3), "r": F.round("responsibility", 6)})
    order = Window.partitionBy(*ITEM).orderBy(F.desc("r"), F.desc("key"), "doc_id")
    return kept.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= most).select("item_id", "role", "doc_id", "place", "final")


def role_coverage(spark, d):
    """The gate: of each item and required role whether it is strong, lacks an owner or is missing, and the item's status."""
    c = _scored(spark, d)
    own = R.any_in(F.col("hints"), P.folded(F.col("path"))) | ((F.col("profile") == "likely_owner") & ~F.arrays_overlap("reasons", F.array(*map(F.lit, ("plumbing_path", "helper_path", "low_level_leaf")))))
    per = c.groupBy(*ITEM).agg(F.max(F.col("accepted")).alias("met"), F.max(F.col("accepted") & own).alias("owned"))
    every = load(spark, d, "benchmark", "item_id").crossJoin(F.broadcast(R.role_table(spark).select("role")))
    status = F.when(~F.coalesce("met", F.lit(False)), "missing").when(~F.col("owned"), "missing_owner").otherwise("strong")
    per = every.join(per, ITEM, "left").withColumn("status", status)
    strong = F.count_if(F.col("status") == "strong")
    whole = F.when(strong == 0, "missing").when(strong == F.count(F.lit(1)), "strong").otherwise("partial")
    names = F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") != "strong", F.concat("role", F.lit(":"), "status")))), ",")
    return per.groupBy("item_id").agg(whole.alias("status"), strong.alias("strong"), names.alias("open"))


def role_intents(spark, d):
    """Searches that each item needs besides: roles without a likely owner but with support, and leaves without an owner."""
    phrase = F.when(F.col("role") == "validation_checking", "semantic validation rules").otherwise("output render display state")
    c = _profiled(spark, d)
    first = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]), 1, 4)
    aside = F.count_if(F.col("profile").isin("support_only", "noise"))
    hinted = F.max(R.any_in(F.col("support"), P.folded(F.col("path"))))
    leaf = F.max((F.col("profile") == "support_only") & F.array_contains("reasons", "low_level_leaf"))
    g = c.groupBy("item_id", "role").agg(F.count_if(F.col("profile") == "likely_owner").alias("likely"), aside.alias("aside"), hinted.alias("hinted"), leaf.alias("leaf"), F.array_join(first, ",").alias("paths"))
    lack = g.where(F.col("role").isin("validation_checking", "behavior_output") & (F.col("likely") == 0) & (F.col("hinted") | (F.col("aside") > 0)))
    reason = F.when(F.col("role") == "validation_checking", "parser_or_representation_without_validation_owner").otherwise("syntax_without_behavior_owner")
    low = g.where("leaf").select("item_id", "role", F.lit("public API type owner high level user visible").alias("query"), F.lit("low_level_leaf_without_public_owner").alias("reason"), "paths")
    return lack.select("item_id", "role", phrase.alias("query"), reason.alias("reason"), "paths").union(low)


QUERIES = {f.__name__: f for f in (role_validation, role_profiles, role_bucket, role_coverage, role_intents)}

_STRIP = r"regexp_replace(w, '^[ ?!.,:;()\[\]{{}}\"'']+|[ ?!.,:;()\[\]{{}}\"'']+$', '', 'g')"
_STRIP = _STRIP.replace("{{", "{").replace("}}", "}")
_OR = lambda names: "|".join(names.split())
_HINTS = {r: h for r, _, h, *_ in R.ROLES}
_ROLES = ", ".join(f"('{r}', {k.split()}, {h.split()}, {s.split()}, {t}e0, {a.split()}, {str(c).lower()})" for r, k, h, s, t, a, c in R.ROLES)
_OTHER = " OR ".join(f"(role <> '{r}' AND regexp_matches(path, '{_OR(h)}'))" for r, h in _HINTS.items())
_SIGNALS = f"""[
      CASE WHEN own THEN role || '_owner_path' END, CASE WHEN said THEN role || '_text' END, CASE WHEN regexp_matches(path, '{_OR(R.PUBLIC_PATHS)}') THEN 'public_api_path' END,
      CASE WHEN {" OR ".join(f"contains(t, '{x}')" for x in R.PUBLIC_TEXTS)} THEN 'public_surface_text' END, CASE WHEN sup THEN 'adjacent_' || role || '_support_layer' END,
      CASE WHEN role <> 'diagnostics' AND contains(t, 'diagnostic') AND NOT said THEN 'diagnostic_text_without_enforcement' END, CASE WHEN regexp_matches(path, '{_OR(R.HELPERS)}') THEN 'helper_path' END,
      CASE WHEN regexp_matches(path, '{_OR(R.PLUMBING)}') THEN 'plumbing_path' END, CASE WHEN regexp_matches(path, '{_OR(R.LOW_LEVEL)}') THEN 'low_level_leaf' END,
      CASE WHEN NOT own AND ({_OTHER}) THEN 'cross_role_owner_path' END]"""
_POINTS = lambda *p: " + ".join(f"CASE WHEN sig[{i}] IS NOT NULL THEN {x}e0 ELSE 0e0 END" for i, x in p)
_ROLE_CASE = "CASE WHEN regexp_matches(path, '{}') THEN 'documentation' WHEN regexp_matches(path, '{}') THEN 'baseline_or_generated' WHEN regexp_matches(path, '{}') THEN 'test' WHEN regexp_matches(path, '{}') THEN 'implementation' ELSE 'other' END".format(P.DOCUMENTATION, P.GENERATED, P.TEST, P.IMPLEMENTATION)
_CAND = f"""WITH {ITEMS}, {PARTS}, {_LINES}, {GRAPH_SQL}, hit AS (
  SELECT query AS item_id, doc_id, round(sum(idf * w), 6) AS retrieval FROM w GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY retrieval DESC, doc_id) AS rank FROM hit
), roles AS (
  SELECT * FROM (VALUES {_ROLES}) AS v(role, keywords, hints, support, threshold, anchors, calls)
), c0 AS (
  SELECT r.item_id, r.doc_id, retrieval, rank, files.path, lower(files.text) AS t, b.text AS query, regexp_extract(b.text, '^\\S+ \\S+') AS helper, roles.*
  FROM ranked r JOIN files USING (doc_id) JOIN benchmark b USING (item_id), roles WHERE rank <= 8
), c1 AS (
  SELECT *, len(list_filter(keywords, lambda x: contains(t, x))) > 0 AS said, len(list_filter(hints, lambda x: contains(path, x))) > 0 AS own,
    len(list_filter(support, lambda x: contains(path, x))) > 0 AS sup, list_transform(regexp_split_to_array(lower(query), '\\s+'), lambda w: {_STRIP}) AS words,
    list_transform(regexp_split_to_array(replace(lower(query || ' ' || query || ' ' || helper), '_', ' '), '\\s+'), lambda w: {_STRIP}) AS more, {_ROLE_CASE} AS file_role
  FROM c0
), c2 AS (
  SELECT *, {_SIGNALS} AS sig, file_role IN ('test', 'baseline_or_generated') OR regexp_matches(path, '{_OR(R.NOISE_PATHS)}') AS noise,
    role <> 'diagnostics' AND (regexp_matches(path, '{_OR(_HINTS["diagnostics"])}') OR (path LIKE '%.json' AND regexp_matches(t, 'diagnostic|error|message'))) AS catalog
  FROM c1
), c3 AS (
  SELECT *, {_POINTS((1, 3.0), (2, 2.2), (3, 1.4), (4, 1.2))} AS owner, {_POINTS((5, 2.5), (6, 1.5), (7, 2.0), (8, 1.8), (9, 2.3), (10, 3.0))} AS aside FROM c2
), c4 AS (
  SELECT *, CASE WHEN noise THEN 'noise' WHEN catalog THEN 'support_only' WHEN owner >= aside + 1.2e0 THEN 'likely_owner' WHEN owner >= 2e0 THEN 'possible_owner'
      WHEN aside > 0 THEN 'support_only' ELSE 'possible_owner' END AS profile,
    CASE WHEN noise THEN ['test_or_generated_path'] WHEN catalog THEN ['diagnostics_catalog']
      WHEN aside <= 0 AND owner < 2e0 AND owner < aside + 1.2e0 THEN list_filter(sig, lambda x: x IS NOT NULL) || ['neutral_implementation_file']
      ELSE list_filter(sig, lambda x: x IS NOT NULL) END AS reasons
  FROM c3
), anchor AS (
  SELECT item_id, role AS anchor_role, arg_min(path, rank) AS anchor FROM c4 WHERE profile NOT IN ('noise', 'support_only') GROUP BY ALL
), link AS (
  SELECT a, b, max(call) AS call, min(call) AS solely FROM (
    SELECT x.path AS a, y.path AS b, edges.kind = 'calls' AS call FROM edges JOIN nodes x ON src = x.id JOIN nodes y ON dst = y.id
    UNION ALL SELECT y.path, x.path, edges.kind = 'calls' FROM edges JOIN nodes x ON src = x.id JOIN nodes y ON dst = y.id
  ) GROUP BY a, b
), pairs AS (
  SELECT c.item_id, c.role, c.doc_id, c.path, anchor,
    len(list_filter(range(1, 6), lambda k: list_slice(string_split(c.path, '/'), 1, k) = list_slice(string_split(anchor, '/'), 1, k) AND k <= least(len(string_split(c.path, '/')), len(string_split(anchor, '/'))))) AS depth
  FROM (SELECT item_id, role, doc_id, path, unnest(anchors) AS anchor_role FROM c4) c JOIN anchor USING (item_id, anchor_role)
), backed AS (
  SELECT item_id, role, doc_id, max(CASE WHEN anchor <> path THEN depth ELSE 0 END) AS near, coalesce(max(call), false) AS called, coalesce(max(NOT solely), false) AS linked, count(a) AS n
  FROM pairs LEFT JOIN link ON anchor = a AND path = b GROUP BY ALL
), c5 AS (
  SELECT c4.*, coalesce(near, 0) AS near, coalesce(called, false) AS called, coalesce(linked, false) AND role = 'representation' AS depends, coalesce(n > 0, false) AS in_graph,
    len(list_filter(words, lambda w: length(w) >= 4 AND contains(path, w))) * 0.7e0 + len(list_filter(words, lambda w: length(w) >= 4 AND contains(t, w))) * 0.35e0
      + CASE WHEN helper <> '' AND contains(t, lower(helper)) THEN 0.25e0 ELSE 0e0 END AS base,
    len(list_filter(more, lambda w: length(w) >= 4 AND NOT list_contains(keywords || hints || support, w) AND NOT list_contains({R.COMMON.split()}, w) AND contains(path || chr(10) || t, w))) > 0 AS concrete
  FROM c4 LEFT JOIN backed USING (item_id, role, doc_id)
), c6 AS (
  SELECT *, base + CASE WHEN said THEN CASE WHEN concrete THEN 1e0 ELSE 0.2e0 END ELSE 0e0 END + CASE WHEN said AND own THEN CASE WHEN concrete THEN 0.7e0 ELSE 0.1e0 END ELSE 0e0 END
      - CASE WHEN sup AND NOT said THEN 0.5e0 ELSE 0e0 END AS local,
    CASE WHEN own THEN CASE WHEN concrete THEN 1.4e0 ELSE 0.4e0 END ELSE 0e0 END - CASE WHEN sup AND NOT said THEN 1e0 ELSE 0e0 END AS role_path,
    CASE WHEN depends THEN 2.2e0 ELSE 0e0 END AS dependency, CASE WHEN near >= 3 THEN 1.4e0 WHEN near = 2 THEN 0.9e0 WHEN near = 1 THEN 0.4e0 ELSE 0e0 END AS proximity,
    CASE WHEN called AND calls THEN 1.5e0 ELSE 0e0 END AS call
  FROM c5
), c7 AS (
  SELECT *, round(local + role_path + dependency + proximity + call, 3) AS total FROM c6
), c8 AS (
  SELECT *, total >= threshold AS accepted,
    least(retrieval, 8) + least(total, 5) + owner + CASE profile WHEN 'likely_owner' THEN 2e0 WHEN 'possible_owner' THEN 0.8e0 ELSE 0e0 END + CASE WHEN in_graph THEN 2e0 ELSE 0e0 END
      - CASE profile WHEN 'noise' THEN 10e0 WHEN 'support_only' THEN 5e0 ELSE 0e0 END AS resp
  FROM c7
)"""
ORACLES = {
    "role_validation": f"""{_CAND}
SELECT item_id, role, doc_id, round(local, 3) AS local, round(role_path, 3) AS role_path, dependency, proximity, call, total, accepted,
  CASE WHEN dependency > 0 THEN 'dependency_supported' WHEN proximity > 0 OR call > 0 THEN 'anchor_boosted' ELSE 'local_only' END AS accepted_by
FROM c8""",
    "role_profiles": f"""{_CAND}
SELECT item_id, role, doc_id, round(owner, 3) AS owner, round(aside, 3) AS support, profile, array_to_string(reasons, ',') AS reasons, round(resp, 3) AS score FROM c8""",
    "role_bucket": f"""{_CAND}, g AS (
  SELECT *, max(profile NOT IN ('noise', 'support_only')) OVER x AS some_good, max(profile NOT IN ('noise', 'support_only') AND own AND accepted) OVER x AS placed,
    round(retrieval * CASE file_role WHEN 'implementation' THEN 1.3e0 WHEN 'documentation' THEN 0.85e0 WHEN 'test' THEN 0.2e0 WHEN 'baseline_or_generated' THEN 0.1e0 ELSE 0.6e0 END
      * CASE WHEN regexp_matches(path, '{P.DOCUMENT_CATEGORY}') THEN 0.8e0 ELSE 1.3e0 END, 6) AS key,
    len(list_filter(keywords || hints || support, lambda x: contains(t, x))) > 0 AS any_term
  FROM c8 WINDOW x AS (PARTITION BY item_id, role)
), k AS (
  SELECT *, row_number() OVER (PARTITION BY item_id, role ORDER BY round(resp, 6) DESC, key DESC, doc_id) AS place,
    round(total + CASE WHEN rank <= 2 THEN 4e0 WHEN rank <= 5 THEN 1e0 ELSE -8e0 END + CASE WHEN any_term THEN 2e0 ELSE 0e0 END + CASE WHEN own THEN 1.5e0 ELSE 0e0 END - CASE WHEN sup AND NOT any_term THEN 1.5e0 ELSE 0e0 END
      + CASE WHEN role = 'representation' AND regexp_matches(t, '\\b(?:class|interface|enum|type)\\s+[a-z_][a-z0-9_]*') THEN 1.5e0 ELSE 0e0 END
      + CASE WHEN role IN ('input_parsing', 'validation_checking', 'behavior_output') AND regexp_matches(t, '\\bfunction\\s+[a-z_][a-z0-9_]*') THEN 1e0 ELSE 0e0 END, 3) AS final
  FROM g WHERE profile <> 'noise' AND NOT list_contains(reasons, 'diagnostics_catalog') AND NOT (placed AND NOT own) AND (profile <> 'support_only' OR NOT some_good)
)
SELECT item_id, role, doc_id, place, final FROM k WHERE place <= 2""",
    "role_coverage": f"""{_CAND}, m AS (
  SELECT item_id, role, max(accepted) AS met,
    max(accepted AND (own OR (profile = 'likely_owner' AND NOT list_has_any(reasons, ['plumbing_path', 'helper_path', 'low_level_leaf'])))) AS owned FROM c8 GROUP BY ALL
), s AS (
  SELECT b.item_id, roles.role, CASE WHEN NOT coalesce(met, false) THEN 'missing' WHEN NOT owned THEN 'missing_owner' ELSE 'strong' END AS status
  FROM benchmark b CROSS JOIN roles LEFT JOIN m ON m.item_id = b.item_id AND m.role = roles.role
)
SELECT item_id, CASE WHEN count_if(status = 'strong') = 0 THEN 'missing' WHEN count_if(status = 'strong') = count(*) THEN 'strong' ELSE 'partial' END AS status,
  count_if(status = 'strong') AS strong, coalesce(string_agg(role || ':' || status, ',' ORDER BY role || ':' || status) FILTER (status <> 'strong'), '') AS open
FROM s GROUP BY item_id""",
    "role_intents": f"""{_CAND}, g AS (
  SELECT item_id, role, count_if(profile = 'likely_owner') AS likely, count_if(profile IN ('support_only', 'noise')) AS n_aside, max(sup) AS hinted,
    max(profile = 'support_only' AND list_contains(reasons, 'low_level_leaf')) AS leaf, string_agg(path, ',' ORDER BY rank) FILTER (rank <= 4) AS paths
  FROM c4 GROUP BY ALL
)
SELECT item_id, role, CASE role WHEN 'validation_checking' THEN 'semantic validation rules' ELSE 'output render display state' END AS query,
  CASE role WHEN 'validation_checking' THEN 'parser_or_representation_without_validation_owner' ELSE 'syntax_without_behavior_owner' END AS reason, paths
FROM g WHERE role IN ('validation_checking', 'behavior_output') AND likely = 0 AND (hinted OR n_aside > 0)
UNION ALL SELECT item_id, role, 'public API type owner high level user visible', 'low_level_leaf_without_public_owner', paths FROM g WHERE leaf""",
}
