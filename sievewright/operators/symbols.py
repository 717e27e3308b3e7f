"""Declarations, imports, calls and bases of Python sources, and the edges that they make.

Parsing is one small step per file inside Arrow batches; names are resolved by joins over the whole table.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FACT = "path string, kind string, scope string, name string, target string, line_start int, line_end int"


def _dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Call):
        return _dotted(node.func)
    if isinstance(node, ast.Attribute):
        head = _dotted(node.value)
        return f"{head}.{node.attr}" if head else node.attr
    return node.id if isinstance(node, ast.Name) else None


def facts_of(path: str, text: str | None) -> list[tuple]:
    """Facts of one file; a file that doesn't parse has none."""
    try:
        todo = [("", ast.parse(text or ""))]
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out = []
    while todo:
        scope, node = todo.pop()
        inner = scope

        def note(kind, name, target=None, at=node, scope=scope):
            out.append((path, kind, scope, name, target, at.lineno, at.end_lineno))

        if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            inner = f"{scope}.{node.name}" if scope else node.name
            note("class" if isinstance(node, ast.ClassDef) else "function", node.name, inner)
            for kind, used in (("base", getattr(node, "bases", ())), ("decorator", node.decorator_list)):
                for x in used:
                    if name := _dotted(x):
                        out.append((path, kind, inner, name.rsplit(".", 1)[-1], name, x.lineno, x.end_lineno))
        elif isinstance(node, ast.Call) and (name := _dotted(node.func)):
            note("call", name.rsplit(".", 1)[-1], name)
        elif isinstance(node, ast.Import):
            for x in node.names:
                note("import", x.asname or x.name, x.name)
        elif isinstance(node, ast.ImportFrom):
            base = path.split("/")[: -node.level] if node.level else []
            module = ".".join([*base, *filter(None, [node.module])])
            for x in node.names:
                note("import", x.asname or x.name, f"{module}:{x.name}")
        todo.extend((inner, child) for child in ast.iter_child_nodes(node))
    return out


def python_facts(files: DataFrame) -> DataFrame:
    """Facts of ``files(path, text)``: classes and functions (``target`` is the qualified name), imports, calls, bases, decorators."""
    columns = [c.split()[0] for c in FACT.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([f for p, t in zip(part["path"], part["text"], strict=True) for f in facts_of(p, t)], columns=columns)

    return files.where(F.col("path").endswith(".py")).select("path", "text").mapInPandas(run, FACT)


def import_edges(facts: DataFrame, files: DataFrame) -> DataFrame:
    """``(path, name, target, file)``: the file that each import names, as a submodule, a module or a package, in this order; else null."""
    i = facts.where("kind = 'import'").select("path", "name", "target", "line_start")
    module, item = F.get(F.split("target", ":"), F.lit(0)), F.get(F.split("target", ":"), F.lit(1))
    whole, deep = F.replace(module, F.lit("."), F.lit("/")), F.concat_ws("/", F.nullif(F.replace(module, F.lit("."), F.lit("/")), F.lit("")), F.replace(item, F.lit("."), F.lit("/")))
    forms = [F.when(item.isNotNull(), F.concat(deep, F.lit(end))) for end in (".py", "/__init__.py")] + [F.concat(whole, F.lit(end)) for end in (".py", "/__init__.py")]
    tried = i.select("*", F.posexplode(F.array(*forms)).alias("place", "form"))
    known = files.select(F.col("path").alias("form"), F.col("path").alias("file")).distinct()
    first = F.min(F.when(F.col("file").isNotNull(), F.struct("place", "file")))["file"]
    return tried.join(known, "form", "left").groupBy("path", "name", "target").agg(first.alias("file"))


def use_edges(facts: DataFrame, imports: DataFrame) -> DataFrame:
    """``(kind, path, scope, name, file, declared)``: calls, bases and decorators with the declaration that they mean.

    A declaration of the same file comes before one of an imported file; uses that neither has are left out.
    """
    uses = facts.where("kind IN ('call', 'base', 'decorator')").select("kind", "path", "scope", "name").distinct()
    declared = facts.where("kind IN ('class', 'function')").select(F.col("path").alias("file"), "name", F.col("target").alias("declared"))
    reach = uses.select("path").distinct().select("path", F.col("path").alias("file"), F.lit(0).alias("far"))
    reach = reach.union(imports.where("file IS NOT NULL").select("path", "file").distinct().select("*", F.lit(1)))
    seen = reach.join(declared, "file").select("path", "name", "file", "declared", "far")
    best = Window.partitionBy("path", "name").orderBy("far", "file", "declared")
    chosen = seen.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n", "far")
    return uses.join(chosen, ["path", "name"]).select("kind", "path", "scope", "name", "file", "declared")
