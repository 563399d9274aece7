"""Directory trees as flat tables, project info and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: Projects kept, levels of a tree.
KEPT, DEPTH = 20, 10
CODE = [".py", ".js", ".ts", ".jsx", ".tsx", ".c", ".cpp", ".h", ".hpp", ".html", ".css", ".json", ".md", ".txt", ".yml", ".yaml", ".toml", ".rs", ".sh", ".sql"]


def tree(files: DataFrame, depth: int = DEPTH) -> DataFrame:
    """`project_id`, `path`, `parent`, `depth`, `name`, `is_file`, `bytes`, `size`: every file and every folder above it.

    A folder comes from each of its files and is reduced before the shuffle. `extension`
    and `is_code` are null for folders; `modified` is the latest of `mtime`, if files have it.
    """
    parts = F.split("path", "/")
    n = F.size(parts)
    prefixes = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(depth))), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("path"), F.array_join(F.slice(parts, F.lit(1), k - 1), "/").alias("parent"), k.alias("depth"), F.get(parts, k - 1).alias("name"), (k == n).alias("is_file")))
    timed = ["mtime"] if "mtime" in files.columns else []
    rows = files.select("project_id", F.octet_length(F.coalesce("content", F.lit(""))).cast("long").alias("bytes"), *timed, F.explode(prefixes).alias("x"))
    out = rows.groupBy("project_id", "x.path", "x.parent", "x.depth", "x.name", "x.is_file").agg(F.sum("bytes").alias("bytes"), *(F.max(c).alias("modified") for c in timed))
    suffix = text.suffix(F.col("path"))
    return out.withColumns({"size": text.human_size(F.col("bytes")), "extension": F.when(F.col("is_file"), suffix), "is_code": F.when(F.col("is_file"), suffix.isin(CODE))})


def ordered_tree(nodes: DataFrame) -> DataFrame:
    """Folders before files, by name without regard to case."""
    return nodes.orderBy("project_id", "parent", "is_file", F.lower("name"), "name")


def tree_with_stats(nodes: DataFrame, stats: DataFrame) -> DataFrame:
    """A tree's rows with the figures of their files; folders have none."""
    return nodes.join(stats.drop("file_ord"), ["project_id", "path"], "left")


def merged_tree(pending: DataFrame, loaded: DataFrame) -> DataFrame:
    """Both trees; a path that is in both is the loaded one's."""
    rows = pending.withColumn("source", F.lit(1)).unionByName(loaded.withColumn("source", F.lit(0)))
    cols = [c for c in pending.columns if c not in ("project_id", "path")]
    return rows.groupBy("project_id", "path").agg(F.min_by(F.struct(*cols), "source").alias("x")).select("project_id", "path", "x.*")


def project_info(files: DataFrame) -> DataFrame:
    s = text.suffix(F.col("path"))
    size = F.octet_length(F.coalesce("content", F.lit(""))).cast("long")
    return files.groupBy("project_id").agg(F.count("*").alias("files"), F.sum(size).alias("bytes"), F.count_if(s.isin(CODE)).alias("code_files"))


def extension_histogram(files: DataFrame, most: int = 10) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("files"), "extension"))
    return files.groupBy("project_id", text.suffix(F.col("path")).alias("extension")).agg(F.count("*").alias("files")).withColumn("k", rank).where(F.col("k") <= most).drop("k")


def retention(projects: DataFrame, kept: int = KEPT) -> DataFrame:
    """`project_id`, `mtime` rows with `keep`: the newest stay. The newest are found by a top-k; nothing is ranked whole."""
    newest = projects.orderBy(F.desc("mtime"), "project_id").limit(kept).select("project_id", F.lit(True).alias("keep"))
    return projects.join(newest, "project_id", "left").withColumn("keep", F.coalesce("keep", F.lit(False)))
