"""Table functions for SQL users: `SELECT t.* FROM files, LATERAL imports(content) AS t`, and of whole tables: `FROM lint_of(TABLE(files) PARTITION BY project_id)`."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, SelectedColumn

from . import pyfacts


class Imports:
    """The imports of a Python text; none where it does not parse."""

    def eval(self, content: str) -> Iterator[tuple]:
        for i in pyfacts.parse(content or "", {"imports"}).get("imports", []):
            yield i["module"], i["name"], i["alias"], i["type"], i["line"]


class Lint:
    """The rules on the tree of a Python text; of one that does not parse the error."""

    def eval(self, content: str, path: str) -> Iterator[tuple]:
        found = pyfacts.parse(content or "", {"lint"})
        if "error" in found:
            yield path, "E001", found.get("error_line"), found.get("error_col"), found["error"]
        for x in found.get("lint", []):
            yield path, x["code"], x["line"], x["col"], x["message"]


class Functions:
    """The functions of a Python text with their size and complexity."""

    def eval(self, content: str) -> Iterator[tuple]:
        for f in pyfacts.parse(content or "", {"functions"}).get("functions", []):
            yield f["name"], f["line"], f["loc"], f["complexity"], f["loop_depth"], f["is_recursive"]


class LintOf:
    """The lint of a table with `path` and `content`: each issue with its number among the partition's issues of its code, then a row a code with their total.

    Columns that the table is partitioned or ordered by may be any; what else it has is carried as
    `keys`, asked for by name. State is a count for each code. `PARTITION BY` decides which files are
    counted together, and one task has them: a part of a project that may be large is the better choice.
    """

    def __init__(self) -> None:
        self.counts: dict[str, int] = {}
        self.keys: tuple = ()

    @staticmethod
    def analyze(files: AnalyzeArgument, keys: AnalyzeArgument | None = None) -> AnalyzeResult:
        """The schema: of the columns named in `keys` (one text, with commas), which are equal in a partition, and of an issue."""
        if not files.isTable:
            raise ValueError("the first argument must be a table: TABLE(files)")
        kinds = {f.name: f.dataType for f in files.dataType.fields}
        if keys is not None and not isinstance(keys.value, str):
            raise ValueError("keys must be a constant text")
        named = [k.strip() for k in (keys.value if keys else "").split(",") if k.strip()]
        missing = [c for c in ["path", "content", *named] if c not in kinds]
        if missing:
            raise ValueError(f"the table has no {', '.join(missing)}")
        out = StructType()
        for k in named:
            out = out.add(k, kinds[k])
        for name, kind in [("path", StringType()), ("code", StringType()), ("line", IntegerType()), ("nth", LongType()), ("total", LongType())]:
            out = out.add(name, kind)
        return AnalyzeResult(schema=out, select=[SelectedColumn(c) for c in dict.fromkeys(["path", "content", *named])])

    def eval(self, files: Row, keys: str = "") -> Iterator[tuple]:
        self.keys = tuple(files[k.strip()] for k in keys.split(",") if k.strip())
        found = pyfacts.parse(files["content"] or "", {"lint"})
        issues = [("E001", found.get("error_line"))] if "error" in found else [(x["code"], x["line"]) for x in found.get("lint", [])]
        for code, line in issues:
            self.counts[code] = self.counts.get(code, 0) + 1
            yield *self.keys, files["path"], code, line, self.counts[code], None

    def terminate(self) -> Iterator[tuple]:
        for code, total in sorted(self.counts.items()):
            yield *self.keys, None, code, None, None, total


TABLES = {
    "imports": (Imports, "module string, name string, alias string, type string, line int"),
    "lint": (Lint, "path string, code string, line int, col int, message string"),
    "functions": (Functions, "name string, line int, loc int, complexity int, loop_depth int, is_recursive boolean"),
}


def register(spark: SparkSession, prefix: str = "code_") -> None:
    """Makes code_imports(content), code_lint(content, path), code_functions(content) and code_lint_of(TABLE(files), keys) known to SQL."""
    spark.udtf.register(f"{prefix}lint_of", udtf(LintOf))
    for name, (cls, schema) in TABLES.items():
        spark.udtf.register(f"{prefix}{name}", udtf(cls, returnType=schema))
