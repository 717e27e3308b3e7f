"""Queries: the supplied documents as files of a repository; chunks, the stored index, filters and sketches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.text import ascii_words
from ..operators import chunks as C
from ..operators import generations as G
from ..operators import index as I
from ..operators import search as S
from ..sources.tables import REPOSITORY, load, repository
from .search import ITEMS, PARTS, ranking
from .shared import index_documents, index_folder, stored_index
from .texts import DECLARATION

SYMBOL = r"^([A-Z][a-z]+) (?:the|and|of|th)\b"


def chunk_rows(spark, d):
    """All chunks of the files: declarations begin spans, spans are cut into windows."""
    c = C.chunks(repository(spark, d), DECLARATION, SYMBOL)
    return c.select("chunk_id", F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"), F.length("text").cast("long").alias("chars"), F.array_join("symbols", ",").alias("symbols"))


def indexing_scope(spark, d):
    """Files, bytes, chunks, first paths and the seconds that indexing may take."""
    t = C.scope_estimate(repository(spark, d), DECLARATION)
    return t.select("file_count", "total_bytes", "estimated_chunks", F.array_join("sample_paths", ",").alias("sample_paths"), F.col("min_s").cast("long").alias("min_s"), F.col("max_s").cast("long").alias("max_s"))


def file_roles(spark, d):
    """Role, category, place in the order of roles and whether indexing skips it, of each file."""
    p, role = F.col("path"), P.file_role(F.col("path"))
    return repository(spark, d).select("path", role.alias("role"), P.category(p).alias("category"), P.role_order(role).cast("long").alias("place"), P.is_skipped(p).alias("skipped"), P.stem(p).alias("stem"))


def scoped_files(spark, d):
    """Files under a scope's prefixes with an allowed suffix, without those under excluded prefixes."""
    from ..sources.files import below

    files = repository(spark, d).select("path")
    kept = below(F.col("path"), ("src", "lib/types", "core")) & ~below(F.col("path"), ("src/services", "src/pars"))
    return files.where(kept & F.regexp_extract("path", r"\.([^./]+)$", 1).isin("ts", "py"))


def repo_sketch(spark, d):
    """Totals, the fullest twenty folders of two levels, files by role, the commonest twenty suffixes."""
    f = repository(spark, d).select("path")
    folder = F.array_join(F.slice(F.split("path", "/"), 1, 2), "/")
    of = lambda kind, what: f.groupBy(what.alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    best = lambda t, k: t.orderBy(F.desc("n"), "name").limit(k)
    total = f.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("kind"), F.lit("files").alias("name"), "n")
    return total.union(best(of("folder", folder), 20)).union(of("role", P.file_role(F.col("path")))).union(best(of("suffix", F.regexp_extract("path", r"(\.[^./]+)$", 1)), 20))


def representative_files(spark, d, most=40):
    """The first path of each role, then the others by path."""
    f = repository(spark, d).select("path", P.file_role(F.col("path")).alias("role"))
    first = f.groupBy("role").agg(F.min("path").alias("path"))
    one = F.col("f.path").isNotNull()
    order = [F.col("later"), F.when(F.col("later"), F.lit(0)).otherwise(P.role_order(F.col("role"))), F.col("path")]
    j = f.alias("a").join(F.broadcast(first.alias("f")), F.expr("a.path = f.path"), "left").select("a.path", "a.role", (~one).alias("later"))
    top = j.orderBy(*order).limit(most)
    return top.withColumn("rn", F.row_number().over(Window.orderBy(*order)).cast("long")).select("path", "role", "rn")


def _terms(spark, d):
    return S.query_terms(load(spark, d, "benchmark"), "item_id", "text")


def _index_terms(index):
    tf = index.table("postings").groupBy("part", "term").agg(F.sum("tf").alias("tf"))
    j = tf.join(index.table("terms"), ["part", "term"]).crossJoin(F.broadcast(index.table("stats")))
    return j.select("term", "df", "tf", F.round(S.idf(F.col("n").cast("double"), F.col("df").cast("double")), 6).alias("idf"))


def _index_search(spark, d, index, k):
    hits = I.matched_terms(index, _terms(spark, d), ranking(spark, d, index, k))
    return hits.select(F.col("query").alias("item_id"), F.col("key").alias("doc_id"), F.col("rank").cast("long").alias("rank"), "score", F.array_join("terms", " ").alias("terms"))


def index_terms(spark, d):
    """Document frequency, total count and idf of the stored index's terms."""
    return _index_terms(stored_index(spark, d))


def index_search(spark, d, k=10):
    """BM25 over paths, file names and texts by the stored index, with the matched terms of the first hits."""
    return _index_search(spark, d, stored_index(spark, d), k)


def _earlier(spark, d):
    """The documents as they may have been: some are missing, some have another text, some have gone since."""
    now = index_documents(spark, d)
    old = now.where("key % 100 <> 3").withColumn("text", F.when(F.col("key") % 100 == 7, F.lower(F.substring("text", 1, 200))).otherwise(F.col("text")))
    return old.unionByName(now.where("key % 100 = 5").withColumn("key", -1 - F.col("key"))).drop("source")


_synced: dict[tuple[str, str], G.Synced] = {}


def synced_index(spark, d) -> G.Synced:
    """The index of the earlier documents, brought to the present ones by a second generation."""
    at = spark.sparkContext.applicationId, d
    if at not in _synced:
        folder = index_folder(spark, d, "sync")
        G.drop(spark, folder)
        G.sync(_earlier(spark, d), folder)
        _synced[at] = G.sync(index_documents(spark, d).drop("source"), folder)
    return _synced[at]


def index_sync(spark, d):
    """What a sync had to tokenize and to end when files changed, and whether one more finds nothing to do."""
    done = synced_index(spark, d)
    again = G.sync(index_documents(spark, d).drop("source"), done.index.folder)
    files = done.index.table("files").agg(F.count(F.lit(1)).alias("files"))
    as_is = again.index.version == done.index.version and not again.tokenized and not again.dead
    return files.select("files", F.lit(done.tokenized).cast("long").alias("tokenized"), F.lit(done.dead).cast("long").alias("ended"), F.lit(as_is).alias("reusable"))


def synced_terms(spark, d):
    """Terms of the index that followed its files: as those of one built anew."""
    return _index_terms(synced_index(spark, d).index)


def synced_search(spark, d, k=10):
    """Ranks by the index that followed its files: as those of one built anew."""
    return _index_search(spark, d, synced_index(spark, d).index, k)


def filtered_search(spark, d, k=8, least=0.02):
    """The hybrid ranking of each item where the payload filter holds before either channel ranks: category, role and a list
    of paths; fused hits below a score go after it."""
    p = F.col("path")
    allowed = repository(spark, d).where((P.category(p) == "source_code") & (P.file_role(p) == "implementation") & ~p.startswith("core/")).select("doc_id", "path")
    sparse = I.sparse_dot(stored_index(spark, d), _terms(spark, d)).join(allowed, F.col("key") == F.col("doc_id")).select("query", "doc_id", F.round("score", 6).alias("score"))
    ranked = S.top(sparse, "query", 3 * k, F.desc("score"), F.col("doc_id"))
    v = load(spark, d, "embeddings", "vec_id", "embedding")
    dense = S.cosine(v, v.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))).join(allowed, F.col("vec_id") == F.col("doc_id"))
    near = dense.select("doc_id", F.round("sim", 6).alias("sim")).orderBy(F.desc("sim"), "doc_id").limit(3 * k).withColumn("g", F.lit(0))
    near = S.top(near, "g", 3 * k, F.desc("sim"), F.col("doc_id")).select("doc_id", "rank")
    both = ranked.select("query", "doc_id", "rank").unionByName(ranked.select("query").distinct().crossJoin(F.broadcast(near)))  # 3 k rows
    fused = both.groupBy("query", "doc_id").agg(F.sum(1.0 / (60.0 + F.col("rank"))).alias("rrf")).select("query", "doc_id", F.round("rrf", 9).alias("rrf"))
    hits = S.top(fused.where(F.col("rrf") >= least), "query", k, F.desc("rrf"), F.col("doc_id"))
    return hits.select(F.col("query").alias("item_id"), "doc_id", F.col("rank").cast("long").alias("rank"), "rrf")


def open_file(spark, d):
    """Line ranges that the events ask for: read, missing or rejected; with the chunks of the file that they touch, the
    first four in order."""
    e = load(spark, d, "events", "event_id", "value", "props").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    files = repository(spark, d)
    asked = e.select("event_id", F.col("event_id").alias("doc"), F.col("k").alias("line_start"), (F.col("k") + F.floor("value").cast("int")).alias("line_end"))
    known = asked.join(files.select(F.col("doc_id").alias("doc"), "path"), "doc", "left").withColumn("path", F.coalesce("path", F.concat(F.lit("gone/"), F.col("doc").cast("string"))))
    said = C.snippets(files, known.select("path", "line_start", "line_end").distinct(), "\n")
    asked_files = files.join(known.select("path").distinct(), "path", "left_semi")
    touched = C.chunks(asked_files, ascii_words(DECLARATION), ascii_words(SYMBOL), end="\n").select(F.col("path").alias("p2"), F.col("line_start").alias("a"), F.col("line_end").alias("b"))
    j = said.join(touched, (F.col("path") == F.col("p2")) & (F.col("b") >= F.col("line_start")) & (F.col("a") <= F.col("line_end")) & (F.col("status") == "ok"), "left")
    first = F.slice(F.array_sort(F.collect_list(F.when(F.col("a").isNotNull(), F.struct("a", "b")))), 1, 4)
    out = j.groupBy("path", "line_start", "line_end", "status", F.length("snippet").cast("long").alias("chars")).agg(first.alias("c"))
    return out.select("path", F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"), "status", "chars", F.array_join(F.transform("c", lambda x: F.concat(x["a"].cast("string"), F.lit("-"), x["b"].cast("string"))), ",").alias("chunks"))


def phase_paths(spark, d):
    """Which roles may use which files, which files may be anchors, and files that name an artifact."""
    roles = spark.createDataFrame([(r,) for r in ("representation", "input_parsing", "validation_checking", "diagnostics", "behavior_output")], "role string")
    terms = F.array(*map(F.lit, ("parsing rules", "type emitter", "d1 checker")))
    p = F.col("path")
    return repository(spark, d).crossJoin(F.broadcast(roles)).select("role", "path", P.phase_allowed(F.col("role"), p).alias("allowed"), P.anchor_allowed(p).alias("anchor"), P.owner_match(p, terms).alias("owner"))


def artifacts(spark, d):
    """Classified artifacts of selected files, how a stated role agrees, and the summary per stated role."""
    said = F.element_at(F.array(*map(F.lit, ("implementation_owner", "generated", "supporting_implementation", "other", ""))), (F.pmod("doc_id", F.lit(5)) + 1).cast("int"))
    f = repository(spark, d).select(said.alias("said"), P.artifact(F.col("path")).alias("a")).withColumn("agreement", P.role_agreement(F.col("said"), F.col("a.role")))
    built = F.col("a.role") == "baseline_or_generated"
    g = f.groupBy("said").agg(F.count(F.lit(1)).alias("selected"), F.count_if(built).alias("built"), F.bool_and(built).alias("all_built"), F.count_if(F.col("agreement") == "mismatch").alias("mismatches"), F.count_if(F.array_contains("a.reasons", "path_contains_baseline")).alias("baselines"))
    return g.withColumn("coverage", F.when(F.col("all_built"), "partial").otherwise("strong"))


QUERIES = {f.__name__: f for f in (chunk_rows, indexing_scope, file_roles, scoped_files, repo_sketch, representative_files, index_terms, index_search, index_sync, synced_terms, synced_search, filtered_search, open_file, phase_paths, artifacts)}

_LINES = """l AS (
  SELECT path, unnest(a) AS line, unnest(range(len(a))) AS no, len(a) AS n
  FROM (SELECT path, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM (SELECT path, string_split(text, chr(10)) AS a FROM files))
), marks AS (
  SELECT DISTINCT path, n, no AS s FROM l WHERE regexp_matches(line, '""" + DECLARATION + """')
  UNION SELECT path, n, 0 FROM l WHERE no = 0
), spans AS (
  SELECT path, s, coalesce(lead(s) OVER (PARTITION BY path ORDER BY s), n) AS e, n FROM marks
), said AS (
  SELECT spans.path, s, e FROM spans JOIN l ON l.path = spans.path AND no >= s AND no < e
  GROUP BY spans.path, s, e HAVING bool_or(regexp_matches(line, '\\S'))
), kept AS (
  SELECT * FROM said
  UNION ALL SELECT DISTINCT path, 0, n FROM l WHERE path NOT IN (SELECT path FROM said)
), syms AS (
  SELECT path, s, string_agg(sym, ',' ORDER BY no) AS symbols FROM (
    SELECT kept.path, s, no, regexp_extract(line, '""" + SYMBOL.replace("(?:", "(?:") + """', 1) AS sym,
      row_number() OVER (PARTITION BY kept.path, s ORDER BY no) AS r
    FROM kept JOIN l ON l.path = kept.path AND no >= s AND no < e WHERE regexp_matches(line, '""" + SYMBOL + """')
  ) WHERE r <= 4 GROUP BY path, s
), win AS (
  SELECT path, s, unnest(range(s, e, 30)) AS a, e FROM kept
), c AS (
  SELECT win.path, win.s, win.a + 1 AS line_start, least(win.a + 40, win.e) AS line_end, string_agg(line, chr(10) ORDER BY no) AS text
  FROM win JOIN l ON l.path = win.path AND no >= win.a AND no < least(win.a + 40, win.e)
  GROUP BY ALL HAVING bool_or(regexp_matches(line, '\\S'))
)"""
_ROLE = f"""CASE
    WHEN regexp_matches(lower(path), '{P.DOCUMENTATION}') THEN 'documentation'
    WHEN regexp_matches(lower(path), '{P.GENERATED}') THEN 'baseline_or_generated'
    WHEN regexp_matches(lower(path), '{P.TEST}') THEN 'test'
    WHEN regexp_matches(lower(path), '{P.IMPLEMENTATION}') THEN 'implementation'
    ELSE 'other' END"""
_CATEGORY = f"CASE WHEN regexp_matches(lower(path), '{P.DOCUMENT_CATEGORY}') THEN 'documentation' ELSE 'source_code' END"
#: Postings of paths, names and texts.
POSTINGS = f"{ITEMS}, {PARTS}"
_COS = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings ORDER BY vec_id LIMIT 1))"
_VARIANT_TERMS = (("parsing", "rules"), ("type", "emitter"), ("checker",))


def _owner_sql() -> str:
    """The owner match of phase_paths for its three terms, written out."""
    forms = lambda t: [t, *([t[:-3] + "er"] if t.endswith("ing") and len(t) > 5 else []), *([t[:3]] if len(t) >= 7 else [])]
    either = lambda t: "(" + " OR ".join(f"contains(compact, '{v}') OR contains(stem, '{v}')" for v in forms(t)) + ")"
    every = [" AND ".join(map(either, term)) for term in _VARIANT_TERMS]
    some = [f"contains(stem, '{v}')" for term in _VARIANT_TERMS for t in term if len(t) >= 4 for v in forms(t)]
    return " OR ".join([f"({e})" for e in every] + some)


ORACLES = {
    "chunk_rows": f"""
WITH {REPOSITORY}, {_LINES}
SELECT 'repo-pre:' || c.path || ':L' || line_start || '-L' || line_end AS chunk_id, line_start, line_end, length(text) AS chars, coalesce(symbols, '') AS symbols
FROM c LEFT JOIN syms ON c.path = syms.path AND c.s = syms.s""",
    "indexing_scope": f"""
WITH {REPOSITORY}, {_LINES}, t AS (
  SELECT (SELECT count(*) FROM files) AS file_count, (SELECT CAST(sum(strlen(text)) AS BIGINT) FROM files) AS total_bytes, (SELECT count(*) FROM c) AS estimated_chunks,
    (SELECT string_agg(path, ',' ORDER BY path) FROM (SELECT path FROM files ORDER BY path LIMIT 20)) AS sample_paths
), m AS (
  SELECT *, greatest(10, CAST(floor(0.05e0 * estimated_chunks + 0.002e0 * file_count) AS BIGINT)) AS min_s FROM t
)
SELECT *, greatest(min_s + 10, CAST(floor(0.15e0 * estimated_chunks + 0.006e0 * file_count) AS BIGINT)) AS max_s FROM m""",
    "file_roles": f"""
WITH {REPOSITORY}, r AS (SELECT path, {_ROLE} AS role, {_CATEGORY} AS category FROM files)
SELECT path, role, category, list_position({list(P.ROLE_ORDER)}, role) AS place, role = 'baseline_or_generated' OR regexp_matches(path, '(^|/)bin/') AS skipped,
  regexp_extract(path, '([^/]+)\\.[^./]+$', 1) AS stem
FROM r""",
    "scoped_files": f"""
WITH {REPOSITORY}
SELECT path FROM files
WHERE (path LIKE 'src/%' OR path LIKE 'lib/types/%' OR path LIKE 'core/%') AND path NOT LIKE 'src/services/%' AND regexp_matches(path, '\\.(ts|py)$')""",
    "repo_sketch": f"""
WITH {REPOSITORY}, f AS (SELECT path, {_ROLE} AS role, string_split(path, '/')[1] || '/' || string_split(path, '/')[2] AS folder, regexp_extract(path, '\\.[^./]+$') AS suffix FROM files)
SELECT 'total' AS kind, 'files' AS name, count(*) AS n FROM f
UNION ALL (SELECT 'folder', folder, count(*) AS n FROM f GROUP BY folder ORDER BY n DESC, folder LIMIT 20)
UNION ALL SELECT 'role', role, count(*) FROM f GROUP BY role
UNION ALL (SELECT 'suffix', suffix, count(*) AS n FROM f GROUP BY suffix ORDER BY n DESC, suffix LIMIT 20)""",
    "representative_files": f"""
WITH {REPOSITORY}, r AS (SELECT path, {_ROLE} AS role FROM files), o AS (
  SELECT *, row_number() OVER (PARTITION BY role ORDER BY path) > 1 AS later FROM r
), k AS (
  SELECT path, role, row_number() OVER (ORDER BY later, CASE WHEN later THEN 0 ELSE list_position({list(P.ROLE_ORDER)}, role) END, path) AS rn FROM o
)
SELECT path, role, rn FROM k WHERE rn <= 40""",
    "index_terms": f"""
WITH {POSTINGS}
SELECT term, CAST(df AS BIGINT) AS df, CAST(sum(tf) AS BIGINT) AS tf, round(ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0)), 6) AS idf
FROM post JOIN dfs USING (term), st GROUP BY term, df, n""",
    "index_search": f"""
WITH {POSTINGS}, s AS (
  SELECT query, doc_id, round(sum(idf * w), 6) AS score, string_agg(term, ' ' ORDER BY term) AS terms FROM w GROUP BY ALL
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM s
)
SELECT query AS item_id, doc_id, rank, score, terms FROM r WHERE rank <= 10""",
    "index_sync": f"""
WITH {REPOSITORY}, x AS (SELECT doc_id AS k, path || chr(10) || regexp_extract(path, '[^/]*$') || chr(10) || coalesce(text, '') AS t FROM files)
SELECT count(*) AS files, count(*) FILTER (k % 100 = 3 OR k % 100 = 7 AND t <> lower(substr(t, 1, 200))) AS tokenized,
  count(*) FILTER (k % 100 = 5) + count(*) FILTER (k % 100 = 7 AND t <> lower(substr(t, 1, 200))) AS ended, true AS reusable FROM x""",
    "filtered_search": f"""
WITH {POSTINGS}, allowed AS (
  SELECT doc_id FROM (SELECT doc_id, path, {_ROLE} AS role, {_CATEGORY} AS category FROM files)
  WHERE role = 'implementation' AND category = 'source_code' AND NOT starts_with(path, 'core/')
), a AS (
  SELECT query, doc_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank
  FROM (SELECT query, doc_id, round(sum(qtf * idf * w), 6) AS score FROM w JOIN allowed USING (doc_id) GROUP BY ALL)
), b AS (
  SELECT vec_id AS doc_id, row_number() OVER (ORDER BY round({_COS}, 6) DESC, vec_id) AS rank FROM embeddings JOIN allowed ON vec_id = doc_id
), u AS (
  SELECT query, doc_id, rank FROM a WHERE rank <= 24
  UNION ALL SELECT query, doc_id, rank FROM (SELECT DISTINCT query FROM a), b WHERE rank <= 24
), f AS (
  SELECT query, doc_id, round(sum(1e0 / (60e0 + rank)), 9) AS rrf FROM u GROUP BY ALL
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY rrf DESC, doc_id) AS rank FROM f WHERE rrf >= 0.02e0
)
SELECT query AS item_id, doc_id, rank, rrf FROM r WHERE rank <= 8""",
    "open_file": f"""
WITH {REPOSITORY}, {_LINES}, e AS (
  SELECT DISTINCT coalesce(path, 'gone/' || event_id) AS path, CAST(json_extract_string(props, '$.k') AS INT) AS line_start,
    CAST(json_extract_string(props, '$.k') AS INT) + CAST(floor(value) AS INT) AS line_end
  FROM events LEFT JOIN files ON event_id = doc_id
), s AS (
  SELECT e.*, fl.path IS NOT NULL AS there, (SELECT max(n) FROM l WHERE l.path = e.path) AS n FROM e LEFT JOIN files fl ON fl.path = e.path
), t AS (
  SELECT path, line_start, line_end, greatest(line_start, 1) AS a, least(line_end, n) AS b,
    CASE WHEN NOT there THEN 'missing' WHEN greatest(line_start, 1) > n OR least(line_end, n) < greatest(line_start, 1) THEN 'rejected' ELSE 'ok' END AS status
  FROM s
), x AS (
  SELECT t.path, line_start, line_end, status, string_agg(line, chr(10) ORDER BY no) AS snippet
  FROM t LEFT JOIN l ON status = 'ok' AND l.path = t.path AND no + 1 BETWEEN a AND b GROUP BY ALL
), k AS (
  SELECT x.path, x.line_start, x.line_end, c.line_start AS a, c.line_end AS b,
    row_number() OVER (PARTITION BY x.path, x.line_start, x.line_end ORDER BY c.line_start, c.line_end) AS r
  FROM x JOIN c ON x.status = 'ok' AND c.path = x.path AND c.line_end >= x.line_start AND c.line_start <= x.line_end
)
SELECT x.path, x.line_start, x.line_end, status, length(snippet) AS chars, coalesce(string_agg(k.a || '-' || k.b, ',' ORDER BY r), '') AS chunks
FROM x LEFT JOIN k ON k.path = x.path AND k.line_start = x.line_start AND k.line_end = x.line_end AND r <= 4
GROUP BY ALL""",
    "phase_paths": f"""
WITH {REPOSITORY}, p AS (
  SELECT path, {_ROLE} AS kind, contains(path, 'diagnostic') AS marked, contains(path, 'harness') OR contains(path, 'fixture') AS gear,
    regexp_replace(path, '[^a-z0-9]+', '', 'g') AS compact, regexp_extract(path, '([^/]+)\\.[^./]+$', 1) AS stem FROM files
), r AS (
  SELECT unnest(['representation', 'input_parsing', 'validation_checking', 'diagnostics', 'behavior_output']) AS role
)
SELECT role, path, kind = 'implementation' AND NOT gear AND CASE WHEN role = 'diagnostics' THEN marked OR path LIKE '%.json' ELSE NOT marked END AS allowed,
  kind = 'implementation' AND NOT gear AS anchor, {_owner_sql()} AS owner
FROM p, r""",
    "artifacts": f"""
WITH {REPOSITORY}, a AS (
  SELECT ['implementation_owner', 'generated', 'supporting_implementation', 'other', ''][CAST(doc_id % 5 AS INT) + 1] AS said,
    regexp_matches(path, '(^|/)bin(/|$)|baseline|snapshot|golden|generated') AS built, contains(path, 'baseline') AS base FROM files
)
SELECT said, count(*) AS selected, count_if(built) AS built, bool_and(built) AS all_built,
  count_if(built AND said IN ('implementation_owner', 'supporting_implementation')) AS mismatches, count_if(base) AS baselines,
  CASE WHEN bool_and(built) THEN 'partial' ELSE 'strong' END AS coverage
FROM a GROUP BY said""",
}
ORACLES |= {"synced_terms": ORACLES["index_terms"], "synced_search": ORACLES["index_search"]}
