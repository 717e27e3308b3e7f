"""Query: the best window of lines in each item's first files, for each role."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import roles as R
from ..functions import terms as T
from ..operators import windows as W
from ..sources.tables import load
from .search import BATCH, bm25_ranked
from .texts import DECLARATION


def window_spans(spark, d, most=2):
    """Of each item's first documents the 80 lines that say most of the item's and the role's terms."""
    items = load(spark, d, "benchmark").select("item_id", F.col("text").alias("query"))
    roles = R.role_table(spark).select("role", "keywords", "hints", "support")
    hits = bm25_ranked(spark, d, most).select("item_id", F.col("doc_id").alias("key"))
    asked = hits.join(items, "item_id").crossJoin(F.broadcast(roles))  # one row a role
    best = W.best_windows(asked, load(spark, d, "documents").select(F.col("doc_id").alias("key"), "text"), DECLARATION)
    return best.select("item_id", "role", F.col("key").alias("doc_id"), F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"), "score")


QUERIES = {"window_spans": window_spans}

_ROLES = ", ".join(f"('{r}', {k.split()}, {h.split()}, {s.split()})" for r, k, h, s, *_ in R.ROLES)
_UNIQUE = lambda x: f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"
_VERB = "CASE role " + " ".join(f"WHEN '{r}' THEN '{v}'" for r, (v, *_) in W.VERBS.items()) + " END"
_HAS = lambda t: f"contains(body, {t})"
_DECLS = rf"flatten(list_transform(part, lambda x: list_transform(regexp_extract_all(x, '{W.DECLARED}'), lambda y: lower(y))))"
_FUNCTIONS = f"list_filter(decls, lambda x: starts_with(x, 'function') AND regexp_matches(x, {_VERB}))"
_LINE_HAS = lambda pattern: f"len(list_filter(part, lambda x: regexp_matches(lower(x), {pattern}))) > 0"
ORACLES = {
    "window_spans": rf"""{BATCH}, roles AS (
  SELECT * FROM (VALUES {_ROLES}) AS v(role, keywords, hints, support)
), asked AS (
  SELECT r.query AS item_id, role, doc_id, b.text AS query, keywords, list_distinct(keywords || hints || support) AS generic, keywords || hints || support AS context,
    list_filter(regexp_extract_all(lower(b.text), '[a-z_][a-z0-9_]{{3,}}'), lambda x: NOT list_contains({T.OWNER_STOP.split()}, x)) AS toks
  FROM r JOIN benchmark b ON b.item_id = r.query, roles WHERE rank <= 2
), t0 AS (
  SELECT *, list_filter(toks, lambda x: NOT list_contains(generic, x)) AS spec, list_filter(toks, lambda x: NOT list_contains(generic, x)) || toks || context AS alls FROM asked
), t1 AS (
  SELECT *, list_filter({_UNIQUE("alls")}, lambda x: length(x) >= 3) AS terms, list_distinct(spec) AS specific,
    list_distinct(list_slice(list_filter(list_transform(regexp_extract_all(lower(query), '`([^`]+)`', 1) || regexp_extract_all(lower(query), '"([^"]+)"', 1), lambda x: regexp_replace(trim(x), '\s+', ' ', 'g')), lambda x: length(x) >= 5)
      || list_transform(regexp_extract_all(lower(query), '\b(?:cannot|must|only|incorrectly|extends|implements)\s+[a-z0-9_ .-]{{4,80}}'), lambda x: regexp_replace(trim(x), '\s+', ' ', 'g')), 1, 12)) AS phrases
  FROM t0
), split AS (
  SELECT doc_id, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)
), f AS (
  SELECT t1.*, a, list_transform(a, lambda x: lower(x)) AS low, lower(array_to_string(a, chr(10))) AS whole, len(a) AS n FROM t1 JOIN split USING (doc_id) WHERE len(a) > 0
), begins AS (
  SELECT item_id, role, doc_id, min(kind) AS kind, s FROM (
    SELECT item_id, role, doc_id, 0 AS kind, unnest(range(0, CAST(greatest(0, ceil((n - 80) / 40e0) * 40) AS BIGINT) + 1, 40)) + 1 AS s FROM f
    UNION ALL SELECT item_id, role, doc_id, 1, greatest(1, no - 20) FROM (SELECT *, unnest(range(1, n + 1)) AS no FROM f)
    WHERE regexp_matches(a[no], '{DECLARATION}') OR regexp_matches(a[no], '{W.NAMED_FUNCTION}') OR len(list_filter(terms[1:18], lambda x: contains(low[no], x))) > 0
  ) GROUP BY ALL
), win AS (
  SELECT f.*, kind, s, least(n, s + 79) AS e, array_to_string(low[s:least(n, s + 79)], chr(10)) AS body, a[s:least(n, s + 79)] AS part,
    list_filter(list_transform(terms, lambda x: {{'t': x, 'f': (length(whole) - length(replace(whole, x, ''))) // length(x)}}), lambda y: y.f > 0) AS known
  FROM begins JOIN f USING (item_id, role, doc_id)
), x AS (
  SELECT *, list_transform(known, lambda y: {{'t': y.t, 'n': (length(body) - length(replace(body, y.t, ''))) // length(y.t),
      'w': (CASE WHEN y.f = 1 THEN 2.2e0 WHEN y.f <= 3 THEN 1.8e0 WHEN y.f <= 8 THEN 1.2e0 ELSE 0.8e0 END + CASE WHEN list_contains(specific, y.t) THEN 0.8e0 ELSE 0e0 END)
        * CASE WHEN list_contains(generic, y.t) THEN 0.45e0 ELSE 1e0 END}}) AS hits,
    len(list_filter(specific, lambda y: {_HAS("y")})) AS own, {_DECLS} AS decls, regexp_matches(lower(query), '{W.WANTS_CLASS}') AS classes, regexp_matches(lower(query), '{W.WANTS_CONSTRUCTOR}') AS ctors
  FROM win
), scored AS (
  SELECT item_id, role, doc_id, kind, s, e, round(
    coalesce(list_sum(list_transform(list_filter(hits, lambda y: y.n > 0), lambda y: y.w + least(y.n, 4) * least(y.w * 0.2e0, 0.5e0))), 0e0)
    + 3e0 * len(list_filter(phrases, lambda y: {_HAS("y")})) + CASE WHEN len(specific) = 0 THEN 0e0 WHEN own = 0 THEN -2.5e0 ELSE least(own, 4) * 1.25e0 END
    + 0.6e0 * len(list_filter(keywords, lambda y: {_HAS("y")}))
    + CASE WHEN role = 'representation' THEN CASE WHEN {_LINE_HAS(r"'\b(?:class|interface|enum|type)\s+[A-Za-z_][A-Za-z0-9_]*'")} THEN 2.2e0 ELSE 0e0 END + 2.5e0 * len(list_filter(decls, lambda y: regexp_matches(y, '{W.KINDS}')))
      WHEN role = 'diagnostics' THEN CASE WHEN {_LINE_HAS(f"'{W.REPORTS}'")} THEN 1.8e0 ELSE 0e0 END + 2e0 * len(list_filter(decls, lambda y: starts_with(y, 'function') AND regexp_matches(y, '{W.REPORTS}')))
      ELSE CASE WHEN {_LINE_HAS(rf"'\bfunction\s+[A-Za-z_][A-Za-z0-9_]*(' || {_VERB} || ')'")} THEN 2.5e0 ELSE 0e0 END + 3e0 * len({_FUNCTIONS})
        + CASE WHEN NOT classes THEN 0e0 WHEN role = 'validation_checking' THEN 4e0 * len(list_filter({_FUNCTIONS}, lambda y: contains(y, 'class')))
          WHEN role = 'input_parsing' THEN 2e0 * len(list_filter({_FUNCTIONS}, lambda y: regexp_matches(y, 'class|member|declaration|statement'))) ELSE 0e0 END
        + CASE WHEN ctors AND role = 'validation_checking' THEN 2e0 * len(list_filter({_FUNCTIONS}, lambda y: contains(y, 'constructor'))) ELSE 0e0 END END
    - least(s / 10000e0, 0.6e0), 6) AS score FROM x
)
SELECT item_id, role, doc_id, s AS line_start, e AS line_end, greatest(score, 0e0) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id, role, doc_id ORDER BY score DESC, kind, s) AS rn FROM scored
) WHERE rn = 1""",
}
