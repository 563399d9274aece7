"""Log lines: levels, counts and capped lists; endpoint checks and their history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

# The first level with a word in the line counts; letters' case matters.
LEVELS = {"critical": ["CRITICAL", "FATAL"], "error": ["ERROR", "Exception", "Traceback", "Error:"], "warning": ["WARNING", "WARN", "DEPRECATED"], "info": ["INFO"]}
HISTORY, SHOWN, SERVER_LINES, CLIENT_LINES = 50, 10, 200, 300


def level_of(line: Column) -> Column:
    out = None
    for level, words in LEVELS.items():
        found = line.rlike("|".join(words))
        out = F.when(found, level) if out is None else out.when(found, level)
    return out


def log_lines(logs: DataFrame) -> DataFrame:
    """`name`, `content` rows to `name`, `line_no`, `line`, `level`."""
    return logs.select("name", F.posexplode(text.py_lines(F.coalesce("content", F.lit("")))).alias("k", "line")).select("name", (F.col("k") + 1).alias("line_no"), "line", level_of(F.col("line")).alias("level"))


def level_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("name").agg(F.count("*").alias("total_lines"), *(F.count_if(F.col("level") == level).alias(level) for level in LEVELS))


def error_lines(rows: DataFrame, most: int = 100) -> DataFrame:
    """The first critical and error lines by file and line."""
    return rows.where(F.col("level").isin("critical", "error")).select("name", "line_no", "level", F.substring(text.strip(F.col("line")), 1, 200).alias("line")).orderBy("name", "line_no").limit(most)


def warning_lines(rows: DataFrame, most: int = 100) -> DataFrame:
    return rows.where(F.col("level") == "warning").select("name", "line_no", F.substring(text.strip(F.col("line")), 1, 200).alias("line")).orderBy("name", "line_no").limit(most)


def problems(rows: DataFrame, most: int = 100) -> DataFrame:
    """The errors, then the warnings, each up to `most`."""
    both = error_lines(rows, most).withColumn("part", F.lit(0)).unionByName(warning_lines(rows, most).withColumns({"part": F.lit(1), "level": F.lit("warning")}))
    return both.orderBy("part", "name", "line_no").drop("part")


def error_numbers(rows: DataFrame, most: int = 20) -> DataFrame:
    """Each file's first error line numbers."""
    rank = F.row_number().over(Window.partitionBy("name").orderBy("line_no"))
    return rows.where(F.col("level").isin("critical", "error")).withColumn("k", rank).where(F.col("k") <= most).groupBy("name").agg(F.sort_array(F.collect_list("line_no")).alias("error_lines"))


def newest(events: DataFrame, order: list[str], most: int = SERVER_LINES) -> DataFrame:
    """The last `most` events, oldest of them first."""
    return events.orderBy(*[F.desc(c) for c in order]).limit(most).orderBy(*order)


def probe_status(code: Column, error: Column) -> Column:
    return F.when(error.isNotNull(), "down").when(code < 400, "ok").otherwise("error")


def history(probes: DataFrame, kept: int = HISTORY, shown: int = SHOWN) -> DataFrame:
    """Of each url's probes (`url`, `ts`, `seq`, …) the last `shown` among the last `kept`, numbered from the newest."""
    rank = F.row_number().over(Window.partitionBy("url").orderBy(F.desc("ts"), F.desc("seq")))
    return probes.withColumn("back", rank).where(F.col("back") <= min(kept, shown))


def histories(probes: DataFrame, shown: int = SHOWN) -> DataFrame:
    """Each probe with the last `shown` of its url up to it, oldest first: the state of the ring after it, at any time."""
    upto = Window.partitionBy("url").orderBy("ts", "seq").rowsBetween(1 - shown, Window.currentRow)
    return probes.withColumn("ring", F.collect_list(F.struct("seq", "ms")).over(upto))


def ping_status(error: Column) -> Column:
    """Of a probe that sees no answer: what times out is down, what fails otherwise a warning."""
    return F.when(error.isNull(), "ok").when(F.lower(error).rlike("timed? ?out|abort"), "down").otherwise("warning")


def cards(probes: DataFrame, query: str) -> DataFrame:
    """Endpoint cards whose url, status or error holds the query."""
    return probes.where(F.contains(F.lower(F.concat_ws(" ", "url", "status", "error")), F.lit(query.lower())))


def all_badges(probes: DataFrame, issues: DataFrame, files: DataFrame) -> DataFrame:
    """The badges of endpoints, issues and files, as one row."""
    return badges(probes).crossJoin(issues.agg(F.count("*").alias("issues"))).crossJoin(files.agg(F.count("*").alias("files")))


def badges(probes: DataFrame) -> DataFrame:
    return probes.agg(F.count("*").alias("apis"), *(F.count_if(F.col("status") == s).alias(s) for s in ("ok", "down", "error")))
