"""Line and syntax-tree lint, issue lists, de-duplication and grouping."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels, text
from .parse import KEYS

# Line rules as (code, pattern, severity); a line has one hit of a rule at most.
SCRIPT_RULES = [
    ("TS001", r"\bconsole\.(log|debug|error|warn)\s*\(", "info"),
    ("TS002", r":\s*any\b", "warning"),
    ("TS003", r"\bdebugger\b", "error"),
    ("TS004", r"^\s*var\s+", "warning"),
    ("TS005", r"[^=!<>]==[^=]", "warning"),
    ("W100", r"(?i)\b(TODO|FIXME|HACK)\b", "hint"),
]
PYTHON_RULES = [("W100", r"(?i)\b(TODO|FIXME|HACK)\b", "hint")]
CLIENT_RULES = [("DEBUG", r"\bdebugger\b", "error"), ("TODO", r"(TODO|FIXME|HACK):", "info")]
TREE_SEVERITY = {"E001": "error", "W001": "warning", "W002": "warning", "W003": "warning", "C001": "info", "C002": "info", "E501": "warning"}
TOOL_ORDER = {"ast": 0, "flake8": 1, "pylint": 2}
LONG_LINE = 120


def lines(files: DataFrame, content: Column | None = None) -> DataFrame:
    """A row for each line: keys, `line` from 1, `text`."""
    body = F.coalesce(F.col("content") if content is None else content, F.lit(""))
    return files.select(*KEYS, F.posexplode(text.py_lines(body)).alias("k", "text")).select(*KEYS, (F.col("k") + 1).alias("line"), "text")


def line_issues(rows: DataFrame, rules: list[tuple[str, str, str]], tool: str, long_lines: bool = True) -> DataFrame:
    """Hits of the rules on line rows; all rules are tried on a line in one pass."""

    def hit(code: str, found: Column, col: Column, severity: str) -> Column:
        return F.when(found, F.struct(F.lit(code).alias("code"), col.cast("int").alias("col"), F.lit(severity).alias("severity")))

    tried = [hit(code, F.col("text").rlike(p), F.length(F.get(F.split("text", p, 2), F.lit(0))) + 1, s) for code, p, s in rules]
    if long_lines:
        tried.append(hit("E501", F.length("text") > LONG_LINE, F.lit(LONG_LINE + 1), "warning"))
    return rows.select(*KEYS, "line", F.lit(tool).alias("tool"), F.explode(F.array_compact(F.array(*tried))).alias("x")).select(*KEYS, "tool", "line", "x.col", "x.severity", "x.code")


def script_lint(files: DataFrame) -> DataFrame:
    return line_issues(lines(files.where(text.suffix(F.col("path")).isin(".ts", ".tsx", ".js", ".jsx"))), SCRIPT_RULES, "ts-lint")


def client_lint(files: DataFrame) -> DataFrame:
    return line_issues(lines(files), CLIENT_RULES, "client")


def python_lint(files: DataFrame, parsed: DataFrame, quick: bool = False) -> DataFrame:
    """Rules on the tree and on long lines. `quick`: without docstrings, with to-do words; of a file that does not parse the error alone."""
    python = parsed.where(F.col("language") == "python")
    found = python.select(*KEYS, F.explode("lint").alias("x")).select(*KEYS, F.lit("ast").alias("tool"), F.col("x.line").alias("line"), F.col("x.col").alias("col"), labels.mapped(F.col("x.code"), TREE_SEVERITY, "info").alias("severity"), "x.code")
    if quick:
        found = found.where(F.col("code") != "C001")
    broken = python.where(F.col("error").isNotNull())
    errors = broken.select(*KEYS, F.lit("ast").alias("tool"), F.col("error_line").alias("line"), F.col("error_col").alias("col"), F.lit("error").alias("severity"), F.lit("E001").alias("code"))
    whole = files.where(text.suffix(F.col("path")) == ".py").join(broken.select(*KEYS[:2]), KEYS[:2], "left_anti")
    return found.unionByName(errors).unionByName(line_issues(lines(whole), PYTHON_RULES if quick else [], "ast"))


def first_of(issues: DataFrame, by: list[str | Column], order: list[str | Column]) -> DataFrame:
    """The first row of each group: a min of a struct, so it combines before the shuffle."""
    keys = [(F.col(k) if isinstance(k, str) else k).alias(f"__k{n}") for n, k in enumerate(by)]
    ranked = issues.select(*keys, F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"__o{n}") for n, o in enumerate(order)], *issues.columns).alias("x"))
    return ranked.groupBy(*[f"__k{n}" for n in range(len(by))]).agg(F.min("x").alias("x")).select(*[f"x.{c}" for c in issues.columns])


def merge_issues(*tools: DataFrame) -> DataFrame:
    """All tools' issues, of those of one file, line and first 40 letters of the message the first tool's."""
    out = tools[0]
    for t in tools[1:]:
        out = out.unionByName(t)
    return first_of(out, [*KEYS, F.coalesce("line", F.lit(0)), F.substring("message", 1, 40)], [labels.mapped(F.col("tool"), TOOL_ORDER, 9), "seq"])


def markers(issues: DataFrame) -> DataFrame:
    """Issues as editor markers, each line and code once."""
    rows = issues.withColumn("marker", labels.mapped(F.col("severity"), labels.MARKER_SEVERITY, 2))
    return first_of(rows, [*KEYS, "line", "code"], ["col", "tool"])


def by_location(issues: DataFrame) -> DataFrame:
    """Issues of one file and line together, with the worst severity."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    out = issues.withColumn("rank", rank).groupBy(*KEYS, "line").agg(F.count("*").alias("issues"), F.min("rank").alias("rank"), F.array_sort(F.collect_set("code")).alias("codes"))
    return out.withColumn("worst", F.element_at(F.array(F.lit("error"), F.lit("warning"), F.lit("info")), F.col("rank") + 1)).drop("rank")


def filter_issues(issues: DataFrame, severity: str = "all", tool: str = "", query: str = "") -> DataFrame:
    if severity != "all":
        issues = issues.where(F.col("severity") == severity)
    if tool:
        issues = issues.where(F.col("tool") == tool)
    if query:
        issues = issues.where(F.contains(F.lower(F.concat_ws(" ", "path", "message", "code")), F.lit(query.lower())))
    return issues


def is_security_issue() -> Column:
    return F.lower("message").rlike("security|injection|eval") | (F.col("code") == "S001")


def issue_summary(issues: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("severity") == s)
    return issues.groupBy("project_id").agg(F.count("*").alias("issues"), n("error").alias("errors"), n("warning").alias("warnings"), F.countDistinct("path").alias("files"))


def issue_cards(issues: DataFrame, most: int = 15) -> DataFrame:
    """The first issues of each file, as its card shows them."""
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy("line", "col", "code"))
    return issues.withColumn("k", rank).where(F.col("k") <= most)


def run_summary(files: DataFrame, issues: DataFrame, apis: DataFrame) -> DataFrame:
    """One row: files, issues, errors, warnings, endpoints and those that are ok."""
    n = lambda c: F.count_if(c)
    i = issues.agg(F.count("*").alias("issues"), n(F.col("severity") == "error").alias("errors"), n(F.col("severity") == "warning").alias("warnings"))
    a = apis.agg(F.count("*").alias("apis"), n(F.col("status") == "ok").alias("apis_ok"))
    # a row each
    return files.agg(F.count("*").alias("files")).crossJoin(i).crossJoin(a)


def mean_score(scores: DataFrame) -> DataFrame:
    """The mean of the files that have a score, in two decimals."""
    return scores.groupBy("project_id").agg(F.round(F.avg("score"), 2).alias("score"), F.count("score").alias("files"))


def json_errors(files: DataFrame) -> DataFrame:
    """An issue for each .json file that is none, where it breaks."""

    @F.pandas_udf("line int, col int, message string")
    def broken(content: pd.Series) -> pd.DataFrame:
        rows = []
        for x in content:
            try:
                json.loads(x or "")
                rows.append((None, None, None))
            except json.JSONDecodeError as e:
                rows.append((e.lineno, e.colno, e.msg))
            except RecursionError:
                rows.append((1, 1, "nested too deep"))
        return pd.DataFrame(rows, columns=["line", "col", "message"]).astype({"line": "Int32", "col": "Int32"})

    rows = files.where(text.suffix(F.col("path")) == ".json").select(*KEYS, broken("content").alias("x")).where(F.col("x.line").isNotNull())
    return rows.select(*KEYS, F.lit("json").alias("tool"), "x.line", "x.col", F.lit("error").alias("severity"), F.lit("E999").alias("code"), "x.message")


def overall_status(apis: DataFrame, issues: DataFrame, logs: DataFrame) -> DataFrame:
    """One row: down, warning or ok."""
    a = apis.agg(F.coalesce(F.bool_or(F.col("status") == "down"), F.lit(False)).alias("down"))
    i = issues.agg(F.coalesce(F.bool_or(F.col("severity") == "error"), F.lit(False)).alias("error"), F.coalesce(F.bool_or(F.col("severity") == "warning"), F.lit(False)).alias("warning"))
    g = logs.agg(F.coalesce(F.bool_or(F.col("level").isin("critical", "error")), F.lit(False)).alias("bad"))
    # a row each
    row = a.crossJoin(i).crossJoin(g)
    return row.select(F.when(F.col("down") | F.col("error"), "down").when(F.col("warning") | F.col("bad"), "warning").otherwise("ok").alias("status"))


def rename_edits(references: DataFrame, files: DataFrame, name: str, new_name: str) -> DataFrame:
    """Every whole-word occurrence of `name` on the lines that refer to it, each place once; both names must be identifiers."""
    for n in (name, new_name):
        if not n.isidentifier() or not n.isascii():
            raise ValueError(f"{n!r} is no identifier")
    wanted = references.where(F.col("name") == name).select(*KEYS, "line").distinct()
    rows = lines(files).join(wanted, [*KEYS, "line"])
    pieces = F.split("text", rf"\b{name}\b")
    starts = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda k: F.aggregate(F.slice(pieces, F.lit(1), k), F.lit(0), lambda a, p: a + F.length(p)) + (k - 1) * len(name) + 1)
    return rows.where(F.size(pieces) > 1).select(*KEYS, "line", F.explode(starts).alias("col"), F.lit(name).alias("old"), F.lit(new_name).alias("new"))
