"""Endpoint probes, external linters and capabilities, as sources of rows."""

from __future__ import annotations

import importlib.metadata
import importlib.util
import json
import re
import subprocess
import sys
import tempfile
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.logs import probe_status

PROBE = "url string, ms double, code int, reason string, content_type string, headers map<string,string>, preview string, error string"


def probe(url: str, timeout: float, headers: dict[str, str]) -> dict:
    """One GET; what fails is a row with an `error`."""
    row: dict = {"url": url, "code": None, "reason": None, "content_type": None, "headers": None, "preview": None, "error": None}
    began = time.perf_counter()
    try:
        try:
            answer = urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout)
        except urllib.error.HTTPError as e:
            answer = e
        with answer:
            body = answer.read(4096).decode("utf-8", "replace")
            kind = answer.headers.get("Content-Type", "")
            row |= {"code": answer.status, "reason": answer.reason, "content_type": kind, "headers": list(answer.headers.items())[:10], "preview": body[:200] if "json" in kind else None}
    except (OSError, ValueError) as e:
        row["error"] = str(e)
    return row | {"ms": round((time.perf_counter() - began) * 1000, 1)}


def probes(urls: DataFrame, timeout: float = 6.0, headers: dict[str, str] | None = None) -> DataFrame:
    """Probes every `url`; `status`: ok, error or down."""
    kind = pa.schema([("url", pa.string()), ("ms", pa.float64()), ("code", pa.int32()), ("reason", pa.string()), ("content_type", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("preview", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pylist([probe(u, timeout, headers or {}) for u in b.column(0).to_pylist()], kind)

    return urls.select("url").mapInArrow(run, PROBE).withColumn("status", probe_status(F.col("code"), F.col("error")))


ISSUE = "project_id string, file_ord long, path string, tool string, line int, col int, severity string, code string, message string"
#: The external tools' kinds of message.
PYLINT = {"error": "error", "fatal": "error", "warning": "warning", "convention": "info", "refactor": "info"}


def external_lint(files: DataFrame, tool: str, timeout: float = 60.0) -> DataFrame:
    """flake8 or pylint over Python files, one process a batch of files; no rows where the tool is not installed."""
    if tool not in ("flake8", "pylint"):
        raise ValueError(tool)

    def rows_of(folder: str) -> Iterator[tuple[str, int, int, str, str, str]]:
        form = ["--format=%(path)s|%(row)d|%(col)d|%(code)s|%(text)s"] if tool == "flake8" else ["--output-format=json"]
        done = subprocess.run([sys.executable, "-m", tool, *form, folder], capture_output=True, text=True, timeout=timeout, cwd=folder)
        if tool == "flake8":
            for line in done.stdout.splitlines():
                path, row, col, code, message = line.split("|", 4)
                yield Path(path).name, int(row), int(col), "error" if code.startswith("E") else "warning", code, message
        else:
            for m in json.loads(done.stdout or "[]"):
                yield Path(m["path"]).name, m["line"], m["column"], PYLINT.get(m["type"], "info"), m["message-id"], m["message"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("project_id", pa.string()), ("file_ord", pa.int64()), ("path", pa.string()), ("tool", pa.string()), ("line", pa.int32()), ("col", pa.int32()), ("severity", pa.string()), ("code", pa.string()), ("message", pa.string())])
        if importlib.util.find_spec(tool) is None:
            return
        for b in batches:
            own = b.to_pylist()
            with tempfile.TemporaryDirectory() as folder:
                for k, r in enumerate(own):
                    Path(folder, f"f{k}.py").write_text(r["content"] or "", encoding="utf-8")
                try:
                    found = list(rows_of(folder))
                except (subprocess.TimeoutExpired, OSError, ValueError):
                    found = []
            by_name = {f"f{k}.py": r for k, r in enumerate(own)}
            out = [{"project_id": by_name[n]["project_id"], "file_ord": by_name[n]["file_ord"], "path": by_name[n]["path"], "tool": tool, "line": row, "col": col, "severity": s, "code": c, "message": m} for n, row, col, s, c, m in found if n in by_name]
            yield pa.RecordBatch.from_pylist(out, kind)

    return files.where(F.col("path").endswith(".py")).select("project_id", "file_ord", "path", "content").mapInArrow(run, ISSUE)


def rating(output: str) -> float | None:
    """The score that pylint's text ends with."""
    found = re.search(r"Your code has been rated at (-?\d+(?:\.\d+)?)/", output)
    return float(found[1]) if found else None


def lint_scores(files: DataFrame, timeout: float = 60.0) -> DataFrame:
    """pylint's score of each Python file, null where it gives none; no rows where pylint is not installed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("project_id", pa.string()), ("file_ord", pa.int64()), ("path", pa.string()), ("score", pa.float64())])
        if importlib.util.find_spec("pylint") is None:
            return
        for b in batches:
            out = []
            for r in b.to_pylist():
                with tempfile.TemporaryDirectory() as folder:
                    Path(folder, "f.py").write_text(r["content"] or "", encoding="utf-8")
                    try:
                        done = subprocess.run([sys.executable, "-m", "pylint", "--score=y", "f.py"], capture_output=True, text=True, timeout=timeout, cwd=folder)
                        score = rating(done.stderr + done.stdout)
                    except (subprocess.TimeoutExpired, OSError):
                        score = None
                out.append({k: r[k] for k in ("project_id", "file_ord", "path")} | {"score": score})
            yield pa.RecordBatch.from_pylist(out, kind)

    return files.where(F.col("path").endswith(".py")).select("project_id", "file_ord", "path", "content").mapInArrow(run, "project_id string, file_ord long, path string, score double")


def capabilities(spark: SparkSession, names: tuple[str, ...] = ("pyspark", "pyarrow", "pandas", "numpy", "duckdb", "flake8", "pylint", "networkx")) -> DataFrame:
    """`name`, `available`, `version` of libraries on the driver."""
    rows = []
    for n in names:
        try:
            rows.append((n, True, importlib.metadata.version(n)))
        except importlib.metadata.PackageNotFoundError:
            rows.append((n, False, None))
    return spark.createDataFrame(rows, "name string, available boolean, version string")


#: What is known of each language.
LANGUAGES = [("python", "tree", True, True, True), ("javascript", "patterns", True, False, False), ("typescript", "patterns", True, False, False), ("c", "tokens", True, False, False), ("cpp", "tokens", True, False, False)]


def languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LANGUAGES, "language string, parser string, functions boolean, security boolean, naming boolean")
