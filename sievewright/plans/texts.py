"""Queries: lines, chunks, spans, paths and text decisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.excerpts import aligned
from ..operators.running import running_before
from ..sources.tables import load

DECLARATION = r"^[A-Z][a-z]+ (the|and|of|th)\b"
#: SQL for the lines of each document; the supplied texts only have line feeds.
LINES = """
l AS (SELECT doc_id, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS no, len(a) AS n
  FROM (SELECT doc_id, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a
  FROM (SELECT doc_id, string_split(text, chr(10)) AS a
  FROM documents)))"""
PATH = r"regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '[?#].*$', ''), '^/+|/+$', '', 'g')"


def _lines(spark, d):
    docs = load(spark, d, "documents", "doc_id", "text").select("doc_id", T.lines(F.col("text")).alias("a"))
    return docs.select("doc_id", F.size("a").alias("n"), F.posexplode("a").alias("no", "line")).withColumn("no", F.col("no") + 1)


def line_chunks(spark, d, count=40, overlap=10):
    """Windows of ``count`` lines that overlap; a text of exactly ``count`` lines has two."""
    docs = load(spark, d, "documents", "doc_id", "text").select("doc_id", F.size(T.lines(F.col("text"))).alias("n"))
    starts = docs.where("n > 0").select("doc_id", "n", F.explode(F.sequence(F.lit(1), F.col("n"), F.lit(count - overlap))).alias("line_start"))
    return starts.select("doc_id", F.col("line_start").cast("long").alias("line_start"), F.least(F.col("line_start") + count - 1, F.col("n")).cast("long").alias("line_end"))


def _spans(ls, n):
    """Declarations of an array of lines as (start, end), each up to the line before the next; found inside the array."""
    starts = F.array_compact(F.transform(ls, lambda x, i: F.when(x.rlike(DECLARATION), i + 1)))
    return F.transform(starts, lambda s, i: F.struct(s.alias("start"), F.coalesce(F.get(starts, i + 1) - 1, n).alias("end")))


def declaration_spans(spark, d):
    """From each declaration to the line before the next."""
    docs = load(spark, d, "documents", "doc_id", "text").select("doc_id", T.lines(F.col("text")).alias("a"))
    found = docs.select("doc_id", F.inline(_spans(F.col("a"), F.size("a"))))
    return found.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def nearest_declaration(spark, d, back=40):
    """For each line with a colon or bar, the nearest declaration at most ``back`` lines before."""
    w = Window.partitionBy("doc_id").orderBy("no").rowsBetween(-back, 0)
    marked = _lines(spark, d).withColumn("decl", F.last(F.when(F.col("line").rlike(DECLARATION), F.col("no")), True).over(w))
    return marked.where(F.col("line").contains("|") & F.col("decl").isNotNull()).select("doc_id", F.col("no").cast("long").alias("no"), F.col("decl").cast("long").alias("decl"))


def scope_estimate(spark, d):
    """Files, bytes, chunks and the seconds that indexing them may take."""
    chunks = F.ceil(F.size(T.lines(F.col("text"))) / F.lit(30.0))
    t = load(spark, d, "documents", "text").agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("text")).cast("long").alias("bytes"), F.sum(chunks).cast("long").alias("chunks"))
    low = F.greatest(F.lit(10), F.floor(0.05 * F.col("chunks") + 0.002 * F.col("files"))).cast("long")
    return t.withColumn("min_s", low).withColumn("max_s", F.greatest(F.col("min_s") + 10, F.floor(0.15 * F.col("chunks") + 0.006 * F.col("files"))).cast("long"))


def file_role_counts(spark, d):
    return load(spark, d, "pages", "url").select(T.file_role(T.url_path(F.col("url"))).alias("role")).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def repo_sketch_dirs(spark, d):
    p = T.url_path(F.col("url"))
    return load(spark, d, "pages", "url").select(F.regexp_extract(p, "^([^/]*/?[^/]?)", 1).alias("dir")).groupBy("dir").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dir").limit(20)


def url_canonical(spark, d):
    """Slug, path and a stable point id of each page."""
    return load(spark, d, "pages", "page_id", "url").select("page_id", T.slug(F.col("url")).alias("slug"), T.url_path(F.col("url")).alias("path"))


def char_budget(spark, d, each=2400, total=24000):
    """Characters that each document may use when a source's budget is spent in order."""
    t = load(spark, d, "documents", "doc_id", "source", "text").select("doc_id", "source", F.least(F.length("text"), F.lit(each)).cast("long").alias("want"))
    spent = running_before(t, "source", ["doc_id"], "want")
    return spent.select("doc_id", F.greatest(F.lit(0), F.least(F.col("want"), F.lit(total) - F.col("before"))).cast("long").alias("used_chars")).where("used_chars > 0")


def stale_guidance(spark, d):
    """Documents with all required terms and any stale one."""
    t = F.lower("text")
    return load(spark, d, "documents", "doc_id", "text").where(t.contains("the") & t.contains("and") & (t.contains("idiot") | t.contains("password"))).select("doc_id")


def decision_gate(spark, d):
    """Context and evidence use of labelled documents: sources' best four and, of these, two."""
    j = load(spark, d, "labels").join(load(spark, d, "documents", "doc_id", "source", "n_chars"), "doc_id").where("quality = 1 AND toxic = 0")
    r = j.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")))
    return r.where("r <= 4").select("doc_id", F.lit(True).alias("context_use"), (F.col("r") <= 2).alias("evidence_use"))


def salient_line(spark, d):
    """Of each document the line with the most weighted query terms; the first of equals."""
    low = F.lower("line")
    score = sum((F.when(low.contains(t), w).otherwise(0.0) for t, w in (("thtion", 2.2), ("onre", 1.8), ("erin", 1.2))), F.lit(0.0))
    r = _lines(spark, d).select("doc_id", "no", F.round(score, 3).alias("score")).where("score > 0")
    return r.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "no"))).where("r = 1").select("doc_id", F.col("no").cast("long").alias("no"), "score")


def interval_overlap(spark, d, count=40, overlap=10):
    """Chunks and declaration spans of a document that overlap; both come from one split of the text, so nothing is joined."""
    docs = load(spark, d, "documents", "doc_id", "text").select("doc_id", T.lines(F.col("text")).alias("a")).where("size(a) > 0")
    rows = docs.select("doc_id", F.size("a").alias("n"), F.inline(_spans(F.col("a"), F.size("a"))))
    step = count - overlap
    first = F.greatest(F.lit(0), F.ceil((F.col("start") - count) / F.lit(step)))  # the first window that ends behind the start
    last = F.floor((F.least("end", "n") - 1) / F.lit(step))
    w = rows.withColumns({"first": first, "last": last}).where("first <= last").select("doc_id", "n", "start", "end", F.explode(F.sequence("first", "last")).alias("k"))
    w = w.withColumn("line_start", F.col("k") * step + 1).withColumn("line_end", F.least(F.col("line_start") + count - 1, F.col("n")))
    return w.where("line_end >= start").select("doc_id", "line_start", "start", (F.least("line_end", "end") - F.greatest("line_start", "start") + 1).alias("lines"))


def role_scores(spark, d):
    """Generic role score of each document: term, path and support parts, their sum and whether it passes."""
    t, p = F.lower("text"), F.lower(F.concat(F.col("source"), F.lit("/"), F.col("lang")))
    local = F.when(t.contains("thtion"), 0.35).otherwise(0.0) + F.when(t.contains("onre"), 0.35).otherwise(0.0) + F.when(t.contains("error"), 1.0).otherwise(0.2)
    path = F.when(p.contains("en"), 1.4).otherwise(0.0)
    support = F.when(p.contains("src1") & ~t.contains("error"), -1.5).otherwise(0.0)
    return load(spark, d, "documents", "doc_id", "text", "source", "lang").select("doc_id", F.round(local, 3).alias("local"), path.alias("path"), support.alias("support"), F.round(local + path + support, 3).alias("total")).withColumn("accepted", F.col("total") >= 1.5)


def responsibility(spark, d):
    """Owner and support signals, their profile and score."""
    t, p = F.lower("text"), F.lower("source")
    owner = F.when(p.contains("src2"), 3.0).otherwise(0.0) + F.when(t.contains("thtion"), 2.2).otherwise(0.0)
    support = F.when(p.contains("src1"), 2.5).otherwise(0.0) + F.when(t.contains("password"), 1.5).otherwise(0.0)
    x = load(spark, d, "documents", "doc_id", "text", "source").select("doc_id", owner.alias("owner"), support.alias("support"))
    profile = F.when(F.col("owner") >= F.col("support") + 1.2, "likely_owner").when(F.col("owner") >= 2.0, "possible_owner").when(F.col("support") > 0, "support_only").otherwise("possible_owner")
    bonus = F.when(F.col("profile") == "likely_owner", 2.0).when(F.col("profile") == "possible_owner", 0.8).otherwise(-5.0)
    return x.withColumn("profile", profile).select("doc_id", "profile", F.round(F.col("owner") + bonus, 3).alias("score"))


def neutral_order(spark, d):
    """Order by a hash of the prompt and the item, so that no rank shows through."""
    key = F.sha2(F.concat(F.sha2(F.lit("prompt"), 256), F.lit("|"), F.col("item_id").cast("string")), 256)
    return load(spark, d, "benchmark", "item_id").select("item_id", key.alias("key"))


def index_signature(spark, d):
    """Content hash of each document and of the order-free set of a source's."""
    t = load(spark, d, "documents", "doc_id", "source", "text").select("source", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("\n"), F.col("text"))).alias("h"))
    return t.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))


def history_tail(spark, d, last=6):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return load(spark, d, "conversations", "conv_id", "turn").withColumn("rn", F.row_number().over(w).cast("long")).where(F.col("rn") <= last)


def request_type(spark, d):
    """Markers in users' turns decide what kind of request they are."""
    t = F.lower("text")
    kind = F.when(t.rlike(r"\?"), "question").when(t.rlike(r"\b(the|and)\b"), "statement").otherwise("other")
    return load(spark, d, "conversations").where("role = 'user'").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def excerpt_alignment(spark, d):
    """Where excerpts stand: of even documents every second line, indented and with a gap mark, in the document itself; of odd ones
    the lines of the one before it."""
    docs = load(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL").select("doc_id", T.lines(F.col("text")).alias("a"))
    half = F.transform(F.filter("a", lambda x, i: i % 2 == 1), lambda x: F.concat(F.lit("  "), x))
    cited = docs.where("doc_id % 2 = 0").select("doc_id", F.concat(F.array(F.lit("...")), half).alias("e")).unionByName(docs.where("doc_id % 2 = 0").select((F.col("doc_id") + 1).alias("doc_id"), F.col("a").alias("e")))
    j = cited.join(docs, "doc_id").withColumn("x", aligned(F.col("a"), F.col("e")))
    return j.select("doc_id", F.col("x.first").cast("long").alias("first"), F.col("x.last").cast("long").alias("last"))


QUERIES = {f.__name__: f for f in (line_chunks, declaration_spans, nearest_declaration, scope_estimate, file_role_counts, repo_sketch_dirs, url_canonical, char_budget, stale_guidance, decision_gate, salient_line, interval_overlap, role_scores, responsibility, neutral_order, index_signature, history_tail, request_type)}
_CHUNKS = "c AS (SELECT doc_id, s AS line_start, least(s + 39, n) AS line_end FROM (SELECT doc_id, n, unnest(range(1, n + 1, 30)) AS s FROM (SELECT DISTINCT doc_id, n FROM l)))"
_DECL = f"dcl AS (SELECT doc_id, no AS start, coalesce(lead(no) OVER (PARTITION BY doc_id ORDER BY no) - 1, n) AS \"end\" FROM l WHERE regexp_matches(line, '{DECLARATION}'))"
ORACLES = {
    "line_chunks": f"WITH {LINES}, {_CHUNKS} SELECT * FROM c",
    "declaration_spans": f"WITH {LINES}, {_DECL} SELECT * FROM dcl",
    "nearest_declaration": f"""
WITH {LINES}, m AS (SELECT doc_id, no, line, max(CASE WHEN regexp_matches(line, '{DECLARATION}') THEN no END) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN 40 PRECEDING AND CURRENT ROW) AS decl
  FROM l) SELECT doc_id, no, decl
  FROM m
  WHERE contains(line, '|') AND decl IS NOT NULL""",
    "scope_estimate": f"""
WITH {LINES}, c AS (SELECT count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes
  FROM documents),
k AS (SELECT CAST(sum(ceil(n / 30e0)) AS BIGINT) AS chunks
  FROM (SELECT DISTINCT doc_id, n
  FROM l)),
m AS (SELECT *, greatest(10, CAST(floor(0.05e0 * chunks + 0.002e0 * files) AS BIGINT)) AS min_s
  FROM c, k) SELECT *, greatest(min_s + 10, CAST(floor(0.15e0 * chunks + 0.006e0 * files) AS BIGINT)) AS max_s
  FROM m""",
    "file_role_counts": f"""
SELECT CASE WHEN regexp_matches(p, '\\.(md|txt|rst|html)$') OR regexp_matches(p, '(^|/)docs?(/|$)') THEN 'documentation' WHEN regexp_matches(p, '(^|/)tests?(/|$)') THEN 'test' WHEN regexp_matches(p, '(^|/)[a-z]{{2}}/[0-9]+$') THEN 'implementation' ELSE 'other' END AS role, count(*) AS n
  FROM (SELECT lower({PATH}) AS p
  FROM pages)
  GROUP BY role""",
    "repo_sketch_dirs": f"SELECT regexp_extract({PATH}, '^([^/]*/?[^/]?)', 1) AS dir, count(*) AS n FROM pages GROUP BY dir ORDER BY n DESC, dir LIMIT 20",
    "url_canonical": f"SELECT page_id, substr(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 120) AS slug, {PATH} AS path FROM pages",
    "char_budget": """
SELECT doc_id, used_chars
  FROM (SELECT doc_id, CAST(greatest(0, least(want, 24000 - coalesce(sum(want) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS used_chars
  FROM (SELECT doc_id, source, least(length(text), 2400) AS want
  FROM documents))
  WHERE used_chars > 0""",
    "stale_guidance": "SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'and') AND (contains(lower(text), 'idiot') OR contains(lower(text), 'password'))",
    "decision_gate": """
SELECT doc_id, true AS context_use, r <= 2 AS evidence_use
  FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r
  FROM labels JOIN documents USING (doc_id)
  WHERE quality = 1 AND toxic = 0)
  WHERE r <= 4""",
    "salient_line": f"""
WITH {LINES}, s AS (SELECT doc_id, no, round(0e0 + CASE WHEN contains(lower(line), 'thtion') THEN 2.2e0 ELSE 0e0 END + CASE WHEN contains(lower(line), 'onre') THEN 1.8e0 ELSE 0e0 END + CASE WHEN contains(lower(line), 'erin') THEN 1.2e0 ELSE 0e0 END, 3) AS score
  FROM l) SELECT doc_id, no, score
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, no) AS r
  FROM s
  WHERE score > 0)
  WHERE r = 1""",
    "interval_overlap": f"""
WITH {LINES}, {_CHUNKS}, {_DECL} SELECT c.doc_id, line_start, start, least(line_end, "end") - greatest(line_start, start) + 1 AS lines
  FROM c JOIN dcl ON c.doc_id = dcl.doc_id AND start <= line_end AND "end" >= line_start""",
    "role_scores": """
WITH x AS (SELECT doc_id, CASE WHEN contains(t, 'thtion') THEN 0.35e0 ELSE 0e0 END + CASE WHEN contains(t, 'onre') THEN 0.35e0 ELSE 0e0 END + CASE WHEN contains(t, 'error') THEN 1e0 ELSE 0.2e0 END AS l, CASE WHEN contains(p, 'en') THEN 1.4e0 ELSE 0e0 END AS path, CASE WHEN contains(p, 'src1') AND NOT contains(t, 'error') THEN -1.5e0 ELSE 0e0 END AS support
  FROM (SELECT doc_id, lower(text) AS t, lower(source || '/' || lang) AS p
  FROM documents)) SELECT doc_id, round(l, 3) AS local, path, support, round(l + path + support, 3) AS total, round(l + path + support, 3) >= 1.5e0 AS accepted
  FROM x""",
    "responsibility": """
WITH x AS (SELECT doc_id, CASE WHEN contains(p, 'src2') THEN 3e0 ELSE 0e0 END + CASE WHEN contains(t, 'thtion') THEN 2.2e0 ELSE 0e0 END AS o, CASE WHEN contains(p, 'src1') THEN 2.5e0 ELSE 0e0 END + CASE WHEN contains(t, 'password') THEN 1.5e0 ELSE 0e0 END AS s
  FROM (SELECT doc_id, lower(text) AS t, lower(source) AS p
  FROM documents)),
y AS (SELECT *, CASE WHEN o >= s + 1.2e0 THEN 'likely_owner' WHEN o >= 2e0 THEN 'possible_owner' WHEN s > 0 THEN 'support_only' ELSE 'possible_owner' END AS profile
  FROM x) SELECT doc_id, profile, round(o + CASE profile WHEN 'likely_owner' THEN 2e0 WHEN 'possible_owner' THEN 0.8e0 ELSE -5e0 END, 3) AS score
  FROM y""",
    "neutral_order": "SELECT item_id, sha256(sha256('prompt') || '|' || CAST(item_id AS VARCHAR)) AS key FROM benchmark",
    "index_signature": "SELECT source, count(*) AS n, min(h) AS low, max(h) AS high FROM (SELECT source, md5(CAST(doc_id AS VARCHAR) || chr(10) || text) AS h FROM documents) GROUP BY source",
    "history_tail": "SELECT conv_id, turn, rn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 6",
    "request_type": r"""
SELECT CASE WHEN regexp_matches(lower(text), '\?') THEN 'question' WHEN regexp_matches(lower(text), '\b(the|and)\b') THEN 'statement' ELSE 'other' END AS kind, count(*) AS n
  FROM conversations
  WHERE role = 'user'
  GROUP BY kind""",
}
QUERIES["excerpt_alignment"] = excerpt_alignment
ORACLES["excerpt_alignment"] = r"""
WITH l AS (
  SELECT doc_id, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL)
), c AS (
  SELECT doc_id, ['...'] || list_transform(list_filter(a, lambda x, i: i % 2 = 0), lambda x: '  ' || x) AS e FROM l WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id + 1, a FROM l WHERE doc_id % 2 = 0
), t AS (
  SELECT doc_id, list_transform(a, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS a,
    list_filter(list_transform(e, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND x NOT IN ('...', '// ...')) AS e FROM c JOIN l USING (doc_id)
), f AS (
  SELECT doc_id, list_reduce([{'line': '', 'pos': 0::BIGINT, 'head': 0::BIGINT}] || list_transform(e, lambda x: {'line': x, 'pos': 0::BIGINT, 'head': 0::BIGINT}),
    lambda s, x: {'line': '', 'pos': CASE WHEN s.pos < 0 OR coalesce(list_position(a[s.pos + 1:], x.line), 0) = 0 THEN -1 ELSE s.pos + list_position(a[s.pos + 1:], x.line) END,
      'head': CASE WHEN s.head <> 0 THEN s.head WHEN s.pos < 0 OR coalesce(list_position(a[s.pos + 1:], x.line), 0) = 0 THEN -1 ELSE s.pos + list_position(a[s.pos + 1:], x.line) END}) AS r FROM t
)
SELECT doc_id, CASE WHEN r.pos > 0 THEN r.head END AS first, CASE WHEN r.pos > 0 THEN r.pos END AS last FROM f"""
