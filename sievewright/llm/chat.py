"""Chat formatting from reply trees, with DataFrame functions only.

Iterative self-joins by doubling: after k joins every message knows its ancestor 2^k replies up, and the sum of the
scores and the number of messages on the way. A tree of depth d takes log2(d) joins to give each leaf the score of its
root-to-leaf path. Leaves are ranked per tree, and for the chosen ones the same ancestor tables, taken in turn, double
the marked part of each path until it is whole. Every round is written to the shared folder.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import settle, table

#: Strings that mark turns here or in other common templates; texts never hold one of them unescaped.
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
HEAD, MID, TAIL = "<|turn:", "|>", "<|end|>"


def _put(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escape(text: Column) -> Column:
    """Backslashes are doubled, then one is put behind the first character of each control string. A single backslash
    in such a place can come from nothing else, so :func:`unescape` gives the text back."""
    text = _put(text, "\\", "\\\\")
    for c in CONTROLS:
        text = _put(text, c, f"{c[0]}\\{c[1:]}")
    return text


def unescape(text: Column) -> Column:
    for c in reversed(CONTROLS):
        text = _put(text, f"{c[0]}\\{c[1:]}", c)
    return _put(text, "\\\\", "\\")


def _same(a: DataFrame, b: DataFrame, on: list[tuple[str, str]]) -> Column:
    first, second = on
    return a[first[0]].eqNullSafe(b[first[1]]) & (a[second[0]] == b[second[1]])


def format_reply_trees(messages: DataFrame, top: int = 1, tree: str = "tree_id", node: str = "node_id", parent: str = "parent_id", score: str = "score") -> DataFrame:
    """One row per chosen root-to-leaf path: ``tree_id, leaf_id, branch_rank, branch_score, n_turns, formatted,
    loss_spans`` (start and length in code points of each assistant text, as it stands in ``formatted``).

    ``messages`` also has ``role`` and ``text``. Each tree gives its ``top`` branches by mean score, ties by the smaller
    leaf. Null texts and scores count as empty and 0, null roles as "user"; a null tree is a tree of its own. A parent that
    isn't there makes a root; messages that only reach a cycle have no root-to-leaf path, and rows without a node id
    can't be on one: both are left out. Of rows that repeat a node the least (parent, role, text, score) counts. Extra
    columns are ignored; an empty table gives no rows.
    """
    m = messages.select(messages[tree].alias("t"), messages[node].alias("n"), messages[parent].alias("p"), F.coalesce(messages["role"], F.lit("user")).alias("role"), F.coalesce(messages["text"], F.lit("")).alias("text"), F.coalesce(messages[score].cast("double"), F.lit(0.0)).alias("s"))
    m = m.where("n IS NOT NULL").groupBy("t", "n").agg(F.min(F.struct("p", "role", "text", "s")).alias("x"))
    base = settle(m.select("t", "n", "x.*"), "messages")
    real = base.select(F.col("t").alias("t2"), F.col("n").alias("n2"))
    size = base.groupBy("t").agg(F.count(F.lit(1)).alias("k")).agg(F.max("k")).first()[0] or 1
    linked = base.join(real, _same(base, real, [("t", "t2"), ("p", "n2")]), "left")
    up = settle(linked.select("t", "n", F.col("n2").alias("up"), "s", F.lit(1).cast("long").alias("k")), "up")
    state = ["t", "n", "up", "s", "k"]
    whole, active, jumps = up.where("up IS NULL").select(*state), up.where("up IS NOT NULL").select(*state), []
    for _ in range(ceil(log2(size)) + 1):  # what is still active then hangs on a cycle
        if not active.take(1):
            break
        jumps.append(active.select(F.col("t").alias("t2"), F.col("n").alias("n2"), F.col("up").alias("up2")))
        b = whole.union(active).select(F.col("t").alias("t2"), F.col("n").alias("n2"), F.col("up").alias("up2"), F.col("s").alias("s2"), F.col("k").alias("k2"))
        step = active.join(b, _same(active, b, [("t", "t2"), ("up", "n2")]))
        up = settle(step.select("t", "n", F.col("up2").alias("up"), (F.col("s") + F.col("s2")).alias("s"), (F.col("k") + F.col("k2")).alias("k")), "up")
        whole, active = whole.union(up.where("up IS NULL")), up.where("up IS NOT NULL")
    parents = base.select(F.col("t").alias("t2"), F.col("p").alias("p2")).where("p2 IS NOT NULL").distinct()
    leaves = whole.join(parents, _same(whole, parents, [("t", "t2"), ("n", "p2")]), "left_anti")
    ranked = leaves.withColumn("mean", F.col("s") / F.col("k")).withColumn("r", F.row_number().over(Window.partitionBy("t").orderBy(F.desc("mean"), "n")))
    chosen = settle(ranked.where(F.col("r") <= top).select("t", F.col("n").alias("leaf"), "r", "mean", "k"), "branches")
    path = chosen.select("t", "leaf", "n" if "n" in chosen.columns else F.col("leaf").alias("n"))
    for jump in jumps:
        more = path.join(jump, _same(path, jump, [("t", "t2"), ("n", "n2")])).select("t", "leaf", F.col("up2").alias("n"))
        path = settle(path.union(more), "paths")

    depth = whole.select(F.col("t").alias("t2"), F.col("n").alias("n2"), F.col("k").alias("depth"))
    said = base.select(F.col("t").alias("t3"), F.col("n").alias("n3"), "role", "text")
    rows = path.join(depth, _same(path, depth, [("t", "t2"), ("n", "n2")]))
    rows = rows.join(said, _same(rows, said, [("t", "t3"), ("n", "n3")])).select("t", "leaf", "depth", "role", escape(F.col("text")).alias("body"), F.concat(F.lit(HEAD), escape(F.col("role")), F.lit(MID)).alias("head"))
    end = F.sum(F.length("head") + F.length("body") + F.lit(len(TAIL))).over(Window.partitionBy("t", "leaf").orderBy("depth"))
    rows = rows.withColumn("start", end - F.length("body") - F.lit(len(TAIL)))
    turn = F.struct("depth", F.concat("head", "body", F.lit(TAIL)).alias("piece"), F.when(F.col("role") == "assistant", F.struct("start", F.length("body").cast("long").alias("length"))).alias("loss"))
    done = rows.groupBy("t", "leaf").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    formatted = done.select("t", "leaf", F.array_join(F.transform("turns", lambda x: x["piece"]), "").alias("formatted"), F.filter(F.transform("turns", lambda x: x["loss"]), lambda x: x.isNotNull()).alias("loss_spans"))
    about = chosen.select(F.col("t").alias("t2"), F.col("leaf").alias("l2"), "r", "mean", "k")
    out = formatted.join(about, _same(formatted, about, [("t", "t2"), ("leaf", "l2")]))
    return settle(out.select(F.col("t").alias("tree_id"), F.col("leaf").alias("leaf_id"), F.col("r").alias("branch_rank"), F.col("mean").alias("branch_score"), F.col("k").alias("n_turns"), "formatted", "loss_spans"), "formatted")


def parse_formatted(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        head = F.substring_index(p, MID, 1)
        return F.struct(unescape(F.replace(head, F.lit(HEAD), F.lit(""))).alias("role"), unescape(p.substr(F.length(head) + F.lit(len(MID) + 1), F.length(p))).alias("text"))

    return F.transform(pieces, turn)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = said.union(spark.sql("SELECT id AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (-7L, 0L, 'user'), (-7L, 1L, 'assistant') AS v(id, turn, role)"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    nodes = said.withColumn("node_id", F.row_number().over(order).cast("long"))  # each turn answers the one before it
    nodes = nodes.withColumn("parent_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1)).withColumn("score", F.lit(1.0))
    out = format_reply_trees(nodes, tree="conv_id")
    turns = parse_formatted(F.col("formatted"))
    loss = F.array_join(F.transform("loss_spans", lambda x: unescape(F.substring(F.col("formatted"), (x["start"] + 1).cast("int"), x["length"].cast("int")))), "")
    return out.select(
        F.col("tree_id").alias("conv_id"), F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _oracle() -> str:
    esc = "replace({}, '\\', '\\\\')"
    for c in CONTROLS:
        esc = f"replace({esc}, '{c}', '{c[0]}\\{c[1:]}')"
    fixed = len(HEAD) + len(MID) + len(TAIL)
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length({esc.format("role")}) + length({esc.format("text")}) + {fixed}) AS chars
  FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(chars AS BIGINT) AS formatted_chars
FROM g
"""


ORACLE = _oracle()
