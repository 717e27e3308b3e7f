"""Readers of the supplied tables, and of event logs kept as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.selectExpr(*columns) if columns else df


#: Folders under which the supplied documents stand as the files of a repository.
FOLDERS = ("src/parser", "src/checker", "lib/types", "app/emitter", "core/api", "docs", "tests", "src/diagnostics", "lib/util", "packages/server", "build/baselines", "src/services/parser")
SUFFIX = {"en": ".ts", "de": ".py", "fr": ".js"}


def repository(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """``(doc_id, path, text)`` and ``more`` (columns or ``expression AS name``): the supplied documents as files, in a folder by
    their id, with a suffix by their language."""
    docs = load(spark, sf_dir, "documents", "doc_id", "source", "lang", "text", *more)
    folder = F.element_at(F.array(*map(F.lit, FOLDERS)), (F.pmod("doc_id", F.lit(len(FOLDERS))) + 1).cast("int"))
    suffix = F.coalesce(*[F.when(F.col("lang") == k, v) for k, v in SUFFIX.items()], F.lit(".md"))
    return docs.select("doc_id", F.concat(folder, F.lit("/"), "source", F.lit("/d"), F.col("doc_id").cast("string"), suffix).alias("path"), "text", *(x.split(" AS ")[-1] for x in more))


#: The same files in SQL.
REPOSITORY = f"""files AS (
  SELECT *, list_extract({list(FOLDERS)}, CAST(doc_id % {len(FOLDERS)} AS INT) + 1) || '/' || source || '/d' || doc_id ||
    CASE lang {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SUFFIX.items())} ELSE '.md' END AS path
  FROM documents
)"""


def write_jsonl(df: DataFrame, path: str) -> None:
    """Appends one JSON object per line."""
    df.write.mode("append").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a JSON-lines folder; blank and malformed lines are skipped."""
    df = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    first = df.columns[:-1]
    return df.where(F.col("_corrupt_record").isNull() & F.coalesce(*[F.col(c).isNotNull() for c in first])).drop("_corrupt_record")
