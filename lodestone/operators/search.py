"""Global search, outlines, prefixes and two-file differences."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lint import lines
from .parse import KEYS

# What a line must look like to be in the outline.
OUTLINE = [("class", r"^\s*(?:export\s+)?class\s+(\w+)"), ("function", r"^\s*(?:export\s+)?(?:async\s+)?(?:def|function)\s+(\w+)"), ("function", r"^\s*(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?\("), ("interface", r"^\s*(?:export\s+)?interface\s+(\w+)"), ("type", r"^\s*(?:export\s+)?type\s+(\w+)\s*=")]


def grep(files: DataFrame, query: str, regex: bool = False, case: bool = False) -> DataFrame:
    """Lines that hold the query. A pattern that the engine does not compile raises ValueError."""
    if regex:
        try:
            files.sparkSession.sparkContext._jvm.java.util.regex.Pattern.compile(query)
        except IllegalArgumentException as e:
            raise ValueError(f"invalid pattern: {query}") from e
        found = F.col("text").rlike(query if case else f"(?i){query}")
    else:
        found = F.contains("text", F.lit(query)) if case else F.contains(F.lower("text"), F.lit(query.lower()))
    return lines(files).where(found)


def grep_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy(*KEYS).agg(F.count("*").alias("lines"))


def grep_total(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count("*").alias("lines"), F.countDistinct("project_id", "file_ord").alias("files"))


def grep_shown(hits: DataFrame, most: int = 50) -> DataFrame:
    """Each file's first hits; `more` on the last one says how many are left out."""
    w = Window.partitionBy(*KEYS)
    ranked = hits.withColumns({"k": F.row_number().over(w.orderBy("line")), "n": F.count("*").over(w)})
    return ranked.where(F.col("k") <= most).withColumn("more", F.when(F.col("k") == most, F.greatest(F.col("n") - most, F.lit(0))).otherwise(0)).drop("k", "n")


def outline(files: DataFrame) -> DataFrame:
    """Symbols by line patterns, for files without a parse."""
    kind, name = None, None
    for k, p in OUTLINE:
        hit = F.regexp_extract("text", p, 1)
        kind = F.when(hit != "", k) if kind is None else kind.when(hit != "", k)
        name = F.when(hit != "", hit) if name is None else name.when(hit != "", hit)
    return lines(files).select(*KEYS, "line", kind.alias("kind"), name.alias("name")).where(F.col("kind").isNotNull())


def outline_groups(rows: DataFrame) -> DataFrame:
    """A file's symbols by kind; a file's outline is small, so lists are bounded by it."""
    return rows.groupBy(*KEYS, "kind").agg(F.transform(F.sort_array(F.collect_list(F.struct("line", "name"))), lambda x: x["name"]).alias("names"))


def diff(files: DataFrame, before: str, after: str) -> DataFrame:
    """The unified difference of two files of each project, a row a project."""

    @F.pandas_udf("string")
    def unified(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(difflib.unified_diff((x or "").splitlines(), (y or "").splitlines(), before, after, lineterm="")) for x, y in zip(a, b, strict=True)])

    side = lambda p, n: files.where(F.col("path") == p).select("project_id", F.col("content").alias(n))
    return side(before, "a").join(side(after, "b"), "project_id").select("project_id", unified("a", "b").alias("diff"))
