"""Diagrams as text: Mermaid lines gathered in order, a row a project. Sizes are capped as a diagram's must be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import lint

FUNCTIONS, CLASSES, ATTRIBUTES, METHODS, PARTICIPANTS, STEPS, MODELS = 12, 8, 6, 8, 6, 10, 4


def capped(rows: DataFrame, order: list, most: int, by: list[str] | None = None) -> DataFrame:
    w = Window.partitionBy(*(by or ["project_id"])).orderBy(*order)
    return rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)


def joined(rows: DataFrame, head: str) -> DataFrame:
    """Rows `project_id`, `ord` (array<string>), `line` under a head line."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"])
    return rows.groupBy("project_id").agg(F.concat(F.lit(head + "\n"), F.array_join(lines, "\n")).alias("diagram"))


def line(ord_: list, value: Column) -> list[Column]:
    return ["project_id", F.array(*[(F.lit(o) if isinstance(o, str) and o[:1] == "=" else F.col(o)).cast("string") for o in ord_]).alias("ord"), value.alias("line")]


def edges_diagram(nodes: DataFrame, edges: DataFrame, most: int = 60, head: str = "graph TD") -> DataFrame:
    """Nodes `path` and edges `src`, `dst`: import, circular and centrality graphs."""
    n = capped(nodes, ["path"], most).select(*line(["=0", "path"], F.concat(F.lit("  "), text.safe_id(F.col("path")), F.lit('["'), text.short_name(F.col("path")), F.lit('"]'))))
    e = capped(edges, ["src", "dst"], 2 * most).select(*line(["=1", "src", "dst"], F.concat(F.lit("  "), text.safe_id(F.col("src")), F.lit(" --> "), text.safe_id(F.col("dst")))))
    return joined(n.unionByName(e), head)


def cycle_diagram(nodes: DataFrame, edges: DataFrame, most: int = 60) -> DataFrame:
    """An import graph whose edges on cycles are dashed and whose files on cycles are filled; a note where there are none."""
    n = capped(nodes, ["path"], most)
    node = text.safe_id(F.col("path"))
    boxes = n.select(*line(["=0", "path"], F.concat(F.lit("  "), node, F.lit('["'), text.short_name(F.col("path")), F.lit('"]'))))
    arrow = F.when(F.col("is_cycle"), " -.-> ").otherwise(" --> ")
    arrows = capped(edges, ["src", "dst"], 2 * most).select(*line(["=1", "src", "dst"], F.concat(F.lit("  "), text.safe_id(F.col("src")), arrow, text.safe_id(F.col("dst")))))
    styles = n.where("in_cycle").select(*line(["=2", "path"], F.concat(F.lit("  style "), node, F.lit(" fill:#ff336630,stroke:#ff3366,stroke-width:2px"))))
    without = nodes.groupBy("project_id").agg(F.max("in_cycle").alias("any")).where("NOT any")
    note = without.select(*line(["=3"], F.lit('  OK["no circular imports"]\n  style OK fill:#00f5a020,stroke:#00f5a0')))
    return joined(boxes.unionByName(arrows).unionByName(styles).unionByName(note), "flowchart TD")


def call_diagram(calls: DataFrame, most: int = FUNCTIONS) -> DataFrame:
    e = capped(calls, ["caller", "callee"], 4 * most)
    return joined(e.select(*line(["caller", "callee"], F.concat(F.lit("  "), text.safe_id(F.col("caller")), F.lit(" --> "), text.safe_id(F.col("callee"))))), "flowchart LR")


def heatmap_diagram(rows: DataFrame, most: int = FUNCTIONS) -> DataFrame:
    top = capped(rows, ["heat", F.desc("complexity"), "path", "fn_ord"], most)
    shape = F.concat(F.lit("  "), text.safe_id(F.concat_ws("_", "path", "name")), F.lit('["'), F.col("name"), F.lit("\\nCC "), F.col("complexity").cast("string"), F.lit(" "), F.col("big_o"), F.lit('"]'))
    style = F.concat(F.lit("  style "), text.safe_id(F.concat_ws("_", "path", "name")), F.lit(" fill:"), F.col("colour"))
    padded = top.withColumn("k", F.lpad(F.col("k").cast("string"), 4, "0"))
    return joined(padded.select(*line(["=0", "k"], shape)).unionByName(padded.select(*line(["=1", "k"], style))), "flowchart TD")


def class_diagram(classes: DataFrame, edges: DataFrame) -> DataFrame:
    top = capped(classes, ["file_ord", "class_ord"], CLASSES)
    members = F.transform(F.slice("methods", 1, METHODS), lambda m: F.concat(F.lit("    +"), m["name"], F.lit("()")))
    body = F.concat(F.lit("  class "), F.col("name"), F.lit(" {\n"), F.array_join(members, "\n"), F.lit("\n  }"))
    parents = edges.select(*line(["=1", "base", "name"], F.concat(F.lit("  "), F.col("base"), F.lit(" <|-- "), F.col("name"))))
    return joined(top.select(*line(["=0", "name"], body)).unionByName(parents), "classDiagram")


def sequence_diagram(calls: DataFrame) -> DataFrame:
    top = capped(calls, ["file_ord", "caller", "callee"], STEPS)
    return joined(top.select(*line(["caller", "callee"], F.concat(F.lit("  "), F.col("caller"), F.lit("->>"), F.col("callee"), F.lit(": call")))), "sequenceDiagram")


def flowchart(fns: DataFrame) -> DataFrame:
    top = capped(fns, ["file_ord", "fn_ord"], FUNCTIONS)
    padded = top.withColumn("k", F.lpad(F.col("k").cast("string"), 4, "0"))
    return joined(padded.select(*line(["k"], F.concat(F.lit("  START --> "), text.safe_id(F.col("name")), F.lit('["'), F.col("name"), F.lit('"]')))), "flowchart TD")


def pipeline_diagram(steps: DataFrame, models: DataFrame) -> DataFrame:
    """Pipeline steps (`path`, `stage`, `line`, `count`) and models (`path`, `model`) of each file; `project_id` is the file here."""
    s = capped(steps.withColumn("project_id", F.col("path")), ["line", "stage"], STEPS)
    s = s.withColumn("k", F.lpad(F.col("k").cast("string"), 4, "0"))
    m = capped(models.withColumn("project_id", F.col("path")), ["line", "model"], MODELS)
    nodes = s.select(*line(["=0", "k"], F.concat(F.lit("  S"), F.col("k"), F.lit('["'), F.col("stage"), F.when(F.col("count") > 1, F.concat(F.lit(" ("), F.col("count").cast("string"), F.lit("x)"))).otherwise(""), F.lit('"]'))))
    return joined(nodes.unionByName(m.select(*line(["=1", "model"], F.concat(F.lit("  "), F.col("model"), F.lit("(["), F.col("model"), F.lit("])"))))), "flowchart TD")


def chain_diagram(steps: DataFrame, models: DataFrame) -> DataFrame:
    """The same with its arrows: from START over the steps to END, and from the training step to each model."""
    s = capped(steps.withColumn("project_id", F.col("path")), ["line", "stage"], STEPS)
    last = s.groupBy("project_id").agg(F.max("k").alias("n"), F.coalesce(F.min(F.when(F.col("stage") == "entrenamiento", F.col("k"))), F.max("k")).alias("train"))
    node = lambda k: F.concat(F.lit("S"), (k - 1).cast("string"))
    label = F.concat(F.col("stage"), F.when(F.col("count") > 1, F.concat(F.lit("\\n("), F.col("count").cast("string"), F.lit("x)"))).otherwise(""))
    pad = lambda k: F.lpad(k.cast("string"), 4, "0")
    before = F.when(F.col("k") == 1, F.lit("START")).otherwise(node(F.col("k") - 1))
    rows = s.withColumns({"key": pad(F.col("k"))}).select(*line(["=1", "key"], F.concat(F.lit("    "), node(F.col("k")), F.lit('["'), label, F.lit('"]\n    '), before, F.lit(" --> "), node(F.col("k")))))
    m = capped(models.withColumn("project_id", F.col("path")), ["line", "model"], MODELS).join(last, "project_id").withColumn("key", pad(F.col("k")))
    made = F.concat(F.lit("M"), (F.col("k") - 1).cast("string"))
    rows = rows.unionByName(m.select(*line(["=2", "key"], F.concat(F.lit("    "), made, F.lit("(["), F.col("model"), F.lit("\\n"), F.col("type"), F.lit("])\n    "), node(F.col("train")), F.lit(" --> "), made))))
    ends = last.select(*line(["=3"], F.concat(F.lit("    END([End])\n    "), node(F.col("n")), F.lit(" --> END"))))
    return joined(rows.unionByName(ends).unionByName(last.select(*line(["=0"], F.concat(F.lit("    START(["), F.col("project_id"), F.lit("])"))))), "flowchart TD")


def text_flowchart(files: DataFrame, most: int = STEPS) -> DataFrame:
    """Without a parse: a file's functions by their lines, from START over F0, F1, … to END; `project_id` is the file here."""
    name = F.coalesce(F.nullif(F.regexp_extract("text", r"^def\s+(\w+)", 1), F.lit("")), F.nullif(F.regexp_extract("text", r"function\s+(\w+)", 1), F.lit("")))
    rows = lint.lines(files).select(F.col("path").alias("project_id"), "line", name.alias("name")).where(F.col("name").isNotNull())
    top = capped(rows, ["line"], most)
    node = lambda k: F.concat(F.lit("F"), (k - 1).cast("string"))
    key = top.withColumn("key", F.lpad(F.col("k").cast("string"), 4, "0"))
    before = F.when(F.col("k") == 1, F.lit("START")).otherwise(node(F.col("k") - 1))
    boxes = key.select(*line(["=1", "key"], F.concat(F.lit("    "), node(F.col("k")), F.lit('["'), F.col("name"), F.lit('()"]'))))
    arrows = key.select(*line(["=3", "key"], F.concat(F.lit("    "), before, F.lit(" --> "), node(F.col("k")))))
    last = top.groupBy("project_id").agg(F.max("k").alias("n"))
    ends = last.select(*line(["=2"], F.lit("    END([END])"))).unionByName(last.select(*line(["=4"], F.concat(F.lit("    "), node(F.col("n")), F.lit(" --> END")))))
    found = joined(boxes.unionByName(arrows).unionByName(ends).unionByName(last.select(*line(["=0"], F.concat(F.lit("    START(["), F.col("project_id"), F.lit("])"))))), "flowchart TD")
    none = files.select(F.col("path").alias("project_id")).join(found.select("project_id"), "project_id", "left_anti")
    return found.unionByName(none.select("project_id", F.concat(F.lit("flowchart TD\n    A["), F.col("project_id"), F.lit("]\n    B[no functions]\n    A --> B")).alias("diagram")))


def health_cards(scores: DataFrame) -> DataFrame:
    from ..functions.labels import health_tier

    names = ["security", "quality", "complexity", "architecture"]
    cards = F.explode(F.array(*[F.struct(F.lit(n).alias("card"), F.col(n).alias("score")) for n in names]))
    return scores.select("project_id", cards.alias("x")).select("project_id", "x.card", "x.score", health_tier(F.col("x.score")).alias("tier"))
