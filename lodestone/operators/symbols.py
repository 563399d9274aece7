"""Symbol queries over parsed files: definitions, references, completions, enclosing functions, hover cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels, text
from . import lint
from .parse import KEYS

DEFINITION_ORDER = {"function": 0, "method": 0, "class": 1, "variable": 2, "constant": 2}
COMPLETION_ORDER = {"function": 0, "method": 0, "class": 1, "variable": 2, "constant": 2, "import": 3, "interface": 4, "type": 4}


def symbols(parsed: DataFrame) -> DataFrame:
    return parsed.select(*KEYS, F.explode("symbols").alias("x")).select(*KEYS, "x.*")


def references(parsed: DataFrame) -> DataFrame:
    """Each place of a name once: definition before call before read; `use`: a whole word where there is no tree."""
    rank = F.when(F.col("x.kind") == "definition", 0).when(F.col("x.kind") == "call", 1).otherwise(2)
    rows = parsed.select(*KEYS, F.explode("refs").alias("x")).select(*KEYS, "x.name", "x.line", "x.col", F.struct(rank, "x.kind").alias("k"))
    return rows.groupBy(*KEYS, "name", "line", "col").agg(F.min("k").alias("k")).select(*KEYS, "name", "line", "col", F.col("k.kind").alias("kind"))


def definitions(parsed: DataFrame, name: str) -> DataFrame:
    found = symbols(parsed).where((F.col("name") == name) & (F.col("kind") != "import"))
    return found.withColumn("rank", labels.mapped(F.col("kind"), DEFINITION_ORDER, 9)).orderBy("rank", "file_ord", "line")


def completions(parsed: DataFrame, prefix: str = "") -> DataFrame:
    """Functions, classes, methods, constants and imports; each label and kind of a file once."""
    rows = symbols(parsed).where(F.col("kind") != "variable").where(F.lower("label").startswith(prefix.lower()))
    out = rows.groupBy(*KEYS, "label", "kind").agg(F.min("line").alias("line"))
    return out.withColumn("rank", labels.mapped(F.col("kind"), COMPLETION_ORDER, 5))


def ordered_completions(rows: DataFrame) -> DataFrame:
    return rows.orderBy("project_id", "file_ord", "rank", "label")


def ordered_references(rows: DataFrame, files: DataFrame) -> DataFrame:
    """References by line and column, each with a preview of its line."""
    body = lint.lines(files).select(*KEYS[:2], "line", text.preview(F.col("text")).alias("preview"))
    return rows.join(body, [*KEYS[:2], "line"], "left").orderBy("project_id", "file_ord", "line", "col")


#: An interval is cut into blocks of 1, 8, 64, ... lines; a line is in one block of each size.
FAN, SIZES = 8, 8


def _blocks(start: Column, end: Column) -> Column:
    """The blocks (size, number) that make up the lines from `start` to `end`: a few of each size at either side."""
    parts = []
    for k in range(SIZES):
        unit, last = FAN**k, k == SIZES - 1
        first, stop = F.ceil(start / unit), F.floor((end + 1) / unit)
        inner, outer = F.ceil(start / (unit * FAN)) * FAN, F.floor((end + 1) / (unit * FAN)) * FAN
        larger = F.lit(False) if last else inner < outer

        def run(a: Column, b: Column, size: int = k) -> Column:
            numbers = F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
            return F.transform(numbers, lambda n: F.struct(F.lit(size).alias("size"), n.alias("number")))

        parts += [run(first, F.when(larger, inner).otherwise(stop)), run(F.when(larger, outer).otherwise(stop), stop)]
    return F.flatten(F.array(*parts))


def enclosing(points: DataFrame, fns: DataFrame) -> DataFrame:
    """For cursor rows (keys, `line`, `symbol`) the innermost function around; without one the first of the symbol's name.

    An interval join by equality: functions are cut into blocks of lines, of which each
    keeps the function that starts last, and a line looks up its block of each size. So
    neither a file's lines nor its functions meet one another. Equal points are one; of
    functions that start together the later one is the inner.
    """
    own, keys = KEYS[:2], points.columns
    f = fns.select(*own, F.col("name").alias("fn"), F.col("line").cast("long").alias("start"), F.col("end_line").cast("long").alias("end"), "fn_ord")
    blocks = f.select(*own, F.explode(_blocks(F.col("start"), F.col("end"))).alias("block"), F.struct("start", "fn_ord", "fn").alias("around")).select(*own, "block.size", "block.number", "around")
    blocks = blocks.groupBy(*own, "size", "number").agg(F.max("around").alias("around"))
    first = f.groupBy(*own, F.col("fn").alias("symbol")).agg(F.min(F.struct("start", "fn_ord", "fn")).alias("named"))
    sizes = F.array(*(F.struct(F.lit(k).alias("size"), F.floor(F.col("line") / FAN**k).alias("number")) for k in range(SIZES)))
    looked = points.withColumn("__b", F.explode(sizes)).select(*keys, F.col("__b.size").alias("size"), F.col("__b.number").alias("number"))
    found = looked.join(blocks, [*own, "size", "number"], "left").groupBy(*keys).agg(F.max("around").alias("around"))
    return found.join(first, [*own, "symbol"], "left").select(*keys, F.coalesce("around.fn", "named.fn").alias("function"))


def hover_cards(fns: DataFrame, findings: DataFrame) -> DataFrame:
    """A card of Markdown for each function: signature, labels, size, findings."""
    own = findings.groupBy(*KEYS[:2], F.col("function").alias("name")).agg(F.array_sort(F.collect_list(F.concat(F.col("cwe"), F.lit(" "), F.col("category")))).alias("found"))
    rows = fns.join(own, [*KEYS[:2], "name"], "left")
    head = F.concat(F.when(F.col("is_async"), "async ").otherwise(""), F.lit("def "), F.col("name"), F.lit("("), F.array_join("args", ", "), F.lit(")"))
    body = F.format_string("time %s, space %s, complexity %d (%s), %d lines", "big_o", "space", "complexity", labels.cc_label(F.col("complexity")), "loc")
    recursion = F.when(F.col("is_tail_recursive"), "tail recursion").when(F.col("is_recursive"), "recursion")
    return rows.select(*KEYS, "fn_ord", "name", "line", F.array_join(F.array_compact(F.concat(F.array(F.concat(F.lit("`"), head, F.lit("`")), body, recursion, F.col("traversal")), F.coalesce("found", F.array().cast("array<string>")))), "\n\n").alias("card"))
