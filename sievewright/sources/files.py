"""Source trees, run folders, cases and notes as DataFrames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .tables import read_jsonl

SUFFIXES = ("py", "js", "ts", "java", "go", "rs", "c", "h", "cpp", "md", "rst", "txt", "json", "yaml", "toml", "sql")
#: Bytes without a letter in Windows code page 1252, and the share of NULs up to which a decoding counts as text.
UNDEFINED = frozenset(b"\x81\x8d\x8f\x90\x9d")
NUL_SHARE = 200


def _text(raw: bytes) -> str | None:
    """The text of a file: its NULs tell 16-bit from 8-bit encodings; of the latter UTF-8 counts where it is valid. A UTF-8
    byte order mark stays in the text. Null for what is no text."""
    nuls = raw.count(0)
    if nuls <= max(1, len(raw) // NUL_SHARE):
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return raw.decode("latin-1" if UNDEFINED & set(raw) else "cp1252")
    marked = raw[:2] in (b"\xff\xfe", b"\xfe\xff")
    big = not marked and raw[::2].count(0) > raw[1::2].count(0)
    text = raw.decode("utf-16" if marked else "utf-16-be" if big else "utf-16-le", "replace")
    broken = len(raw) % 2 or "\ufffd" in text or text.count("\0") > max(1, len(text) // NUL_SHARE)
    return None if broken else text


def decoded(content: Column) -> Column:
    """The text of a binary column."""

    def run(raw: pd.Series) -> pd.Series:
        return raw.map(_text, na_action="ignore")

    return pandas_udf(run, "string")(content)


def below(path: Column, prefixes: tuple[str, ...]) -> Column:
    """Whether a path is one of ``prefixes`` or lies under one."""
    hit = F.lit(False)
    for p in prefixes:
        hit |= (path == p) | path.startswith(p.rstrip("/") + "/")
    return hit


def _relative(path: Column, root: str) -> Column:
    bare = root.split("://")[-1].removeprefix("file:").rstrip("/")
    return F.get(F.split(path, rf"\Q{bare}\E/", 2), F.lit(1))


def source_files(spark: SparkSession, root: str, excluded: tuple[str, ...] = (), suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """``(path, length, text)`` of the text files under ``root``; files that no encoding fits are left out, and
    so are empty files, which Spark's scan passes over.

    Path filters use the listing's columns alone, so content is read for the files that stay.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).withColumn("path", _relative(F.col("path"), root))
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.where(suffix.isin(*suffixes) & ~below(F.col("path"), excluded)).select("path", "length", decoded(F.col("content")).alias("text")).where("text IS NOT NULL")


def run_records(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """One JSON object per run folder under ``root`` (file ``name``), with the folder's name as ``run``."""
    df = spark.read.schema(schema).option("multiLine", True).json(f"{root}/*/{name}")
    return df.select(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("run"), "*")


def run_trace(spark: SparkSession, root: str, run: str, name: str, schema: str) -> DataFrame:
    """Events of one run's JSON lines; blank and malformed lines are skipped."""
    return read_jsonl(spark, f"{root}/{run}/{name}", schema).select(F.lit(run).alias("run"), "*")


def cases(spark: SparkSession, root: str) -> DataFrame:
    """Visible fields of the issues under ``root``, keyed ``owner-repo-number``; the schema reads no hidden field."""
    df = spark.read.schema("repository_url string, number long, title string, created_at string, body string").option("multiLine", True).json(f"{root}/*/issue.json")
    parts = F.split("repository_url", "/")
    owner, repo = (F.element_at(parts, k) for k in (-2, -1))
    return df.select(F.concat_ws("-", owner, repo, F.col("number").cast("string")).alias("case_id"), "*")


def with_verification(found: DataFrame, checks: DataFrame) -> DataFrame:
    """Cases with their verification, null where there is none."""
    return found.join(checks, "case_id", "left")


def notes(spark: SparkSession, root: str) -> DataFrame:
    """``(path, text)`` of the UTF-8 notes under ``root``; a file that isn't UTF-8 is skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select(_relative(F.col("path"), root).alias("path"), text.alias("text")).where("text IS NOT NULL")


def merged_sources(sources: dict[str, list[DataFrame]]) -> DataFrame:
    """Results of several searchers of each source, with their ``source_key``; missing columns are null."""
    every = [df.select(F.lit(key).alias("source_key"), "*") for key, found in sources.items() for df in found]
    out = every[0]
    for df in every[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
