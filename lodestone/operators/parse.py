"""The one stage in Python: source files in, a nested row of facts for each out.

Narrow, in Arrow batches; the text does not go past it. Everything below it works on
exploded columns, so Catalyst prunes what a query does not use. `facts` names the
outputs that are wanted, since nothing can be pruned through the stage itself.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import schemas
from ..functions import labels, pyfacts, scripts, text

KEYS = ["project_id", "file_ord", "path"]


#: Bytes of input for each core up to which files are dealt over all cores first.
DEALT_BYTES = 32 << 20


def facts_of(path: str, content: str, parser: str | None, wanted: set[str] | None = None) -> dict:
    """The wanted facts of one file; whatever goes wrong is its `error`, never a failed batch."""
    try:
        if parser == "python":
            return pyfacts.parse(content, wanted)
        if parser in ("javascript", "typescript"):
            return scripts.parse_js(content, parser, wanted)
        if parser in ("c", "cpp"):
            return scripts.parse_c(content, parser, wanted)
        return {"language": "unknown", "error": f"no parser for {path}"}
    except Exception as e:  # a row with an error, as the contract says
        return {"language": parser, "error": f"{type(e).__name__}: {e}"}


def column(values: list, kind: pa.DataType) -> pa.Array:
    """Nested rows as Arrow, field by field: several times as fast as row by row."""
    if pa.types.is_struct(kind):
        fields = [column([None if v is None else v.get(f.name) for v in values], f.type) for f in kind]
        return pa.StructArray.from_arrays(fields, fields=list(kind), mask=pa.array([v is None for v in values], pa.bool_()))
    if pa.types.is_list(kind) and pa.types.is_struct(kind.value_type):
        ends = list(accumulate((len(v or ()) for v in values), initial=0))
        starts = [None if v is None else k for v, k in zip(values, ends, strict=False)]
        return pa.ListArray.from_arrays(pa.array([*starts, ends[-1]], pa.int32()), column([x for v in values if v for x in v], kind.value_type), type=kind)
    return pa.array(values, kind)


def narrowed(kind: T.DataType, paths: list[str]) -> T.DataType:
    """Rows with the fields that dotted paths name alone."""
    if not paths or not isinstance(kind, T.ArrayType):
        return kind
    below = lambda name: [p.partition(".")[2] for p in paths if p.partition(".")[0] == name]
    fields = [(f, below(f.name)) for f in kind.elementType.fields]
    return T.ArrayType(T.StructType([T.StructField(f.name, f.dataType if "" in sub else narrowed(f.dataType, sub)) for f, sub in fields if sub]))


def parse_files(files: DataFrame, facts: list[str] | None = None) -> DataFrame:
    """SOURCE_FILE rows to PARSED_FILE rows (or its columns `facts`, beside keys, language and error). Null content is empty.

    A fact such as `classes.name` is a column `classes` whose rows have the named fields alone.

    Facts that are not asked for are not made. Parsing is heavy for its bytes, so an
    input too small for a scan partition for each core is dealt over all cores first.
    """
    wanted = list(schemas.PARSED_FILE)
    if facts is not None:
        whole = {*KEYS, "language", "error", *facts}
        paths = {f.name: [x.partition(".")[2] for x in facts if x.startswith(f"{f.name}.")] for f in wanted}
        wanted = [f if f.name in whole else T.StructField(f.name, narrowed(f.dataType, paths[f.name])) for f in wanted if f.name in whole or paths[f.name]]
    out = T.StructType(wanted)
    schema = to_arrow_schema(out)
    own = [f.name for f in wanted if f.name not in KEYS]
    own_set = set(own)
    cores = files.sparkSession.sparkContext.defaultParallelism
    if not files.isStreaming and int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < cores * DEALT_BYTES:
        files = files.repartition(cores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            path, content, parser = (b.column(k).to_pylist() for k in (2, 3, 4))
            # trees have no cycles: the collector has nothing to find there
            gc.disable()
            try:
                found = [facts_of(p, c or "", k, own_set) for p, c, k in zip(path, content, parser, strict=True)]
            finally:
                gc.enable()
            made = [column([f.get(k) for f in found], schema.field(k).type) for k in own]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(KEYS))), *made], schema=schema)

    return files.select(*KEYS, "content", text.parser_of(F.col("path")).alias("parser")).mapInArrow(run, out)


def _exploded(parsed: DataFrame, column: str, ordinal: str) -> DataFrame:
    return parsed.select(*KEYS, "language", F.posexplode(column).alias(ordinal, "x")).select(*KEYS, "language", ordinal, "x.*")


def functions(parsed: DataFrame) -> DataFrame:
    """A row for each function, with its labels; recurrences are solved over the calls inside its file."""
    f = _exploded(parsed, "functions", "fn_ord")
    heuristic = F.coalesce("label", labels.big_o(F.col("loop_depth"), F.col("is_recursive"), F.col("binary_split")))
    return f.withColumn("big_o", heuristic).withColumn("space", labels.space(F.col("growth_depth"), F.col("is_recursive"), F.col("binary_split"))).drop("label")


def with_recurrences(fns: DataFrame) -> DataFrame:
    """Replaces the labels of divide-and-conquer functions by the master theorem's.

    The work outside the calls has the larger degree of the function's own loops and
    of the functions of its file that it calls; the last definition of a name counts.
    """
    degrees = fns.select(*KEYS[:2], "name", "fn_ord", labels.degree_of(F.col("big_o")).alias("degree")).groupBy(*KEYS[:2], "name").agg(F.max_by("degree", "fn_ord").alias("degree"))
    divided = fns.where(F.col("dc_factor") > 0)
    called = divided.select(*KEYS[:2], "fn_ord", F.col("name").alias("caller"), F.explode("calls").alias("name")).where(F.col("caller") != F.col("name"))
    combined = called.join(degrees, [*KEYS[:2], "name"]).groupBy(*KEYS[:2], "fn_ord").agg(F.max("degree").alias("combine"))
    joined = fns.join(combined, [*KEYS[:2], "fn_ord"], "left")
    a, c = F.col("dc_factor"), F.greatest(F.coalesce("combine", F.lit(0)), F.col("loop_depth"))
    recurrence, inside = labels.master_theorem(a, c)
    solved = F.coalesce(a > 0, F.lit(False))
    theta, omega = labels.theta_omega(F.col("big_o"), F.coalesce("early_exit", F.lit(False)))
    tight = F.concat(F.lit("Θ("), inside, F.lit(")"))
    return joined.select(
        *[c for c in fns.columns if c != "big_o"],
        F.when(solved, F.concat(F.lit("O("), inside, F.lit(")"))).otherwise(F.col("big_o")).alias("big_o"),
        F.when(solved, tight).otherwise(theta).alias("theta"),
        F.when(solved, tight).otherwise(omega).alias("omega"),
        F.when(solved, recurrence).alias("recurrence"),
    )


def classes(parsed: DataFrame) -> DataFrame:
    return _exploded(parsed, "classes", "class_ord")


def imports(parsed: DataFrame) -> DataFrame:
    return _exploded(parsed, "imports", "import_ord")


#: Smells that are a threshold on a fact: kind, rule, message; rules work on a struct or a row's columns.
FUNCTION_SMELLS = [
    ("long_function", lambda f: f["loc"] > 50, lambda f: F.format_string("%d lines (> 50)", f["loc"])),
    ("excessive_parameters", lambda f: F.size(f["args"]) > 5, lambda f: F.format_string("%d parameters (> 5)", F.size(f["args"]))),
    ("deep_nesting", lambda f: f["block_depth"] > 4, lambda f: F.format_string("%d nested blocks (> 4)", f["block_depth"])),
]
CLASS_SMELLS = [
    ("large_class", lambda c: (F.size(c["methods"]) > 15) | (c["loc"] > 300), lambda c: F.format_string("%d methods, %d lines (> 15 or > 300)", F.size(c["methods"]), c["loc"])),
    ("god_object", lambda c: (F.size(c["methods"]) >= 20) & (c["attributes"] >= 10), lambda c: F.format_string("%d methods and %d attributes (20 and 10)", F.size(c["methods"]), c["attributes"])),
]


#: The facts of a parse that smells of functions, smells of classes, and `inheritance` need.
FUNCTION_SMELL_FACTS = [f"functions.{f}" for f in ("name", "line", "loc", "args", "block_depth")]
CLASS_SMELL_FACTS = [f"classes.{f}" for f in ("name", "line", "loc", "attributes", "methods.name")]
INHERITANCE_FACTS = ["classes.name", "classes.bases"]


def structural_smells(parsed: DataFrame) -> DataFrame:
    """Smells that are a threshold on a fact: kind, name, line, message. All rules are tried within a file's row, so the files are parsed once; without the functions or the classes of a parse there are none of theirs."""

    def found(column: str, smells: list) -> Column:
        one = lambda x, kind, message: F.struct(F.lit(kind).alias("kind"), x["name"].alias("name"), x["line"].alias("line"), message(x).alias("message"))
        tried = lambda x: F.array_compact(F.array(*[F.when(rule(x), one(x, kind, message)) for kind, rule, message in smells]))
        none = F.array().cast("array<struct<kind: string, name: string, line: int, message: string>>")
        return F.coalesce(F.flatten(F.transform(column, tried)), none)

    every = [found(c, smells) for c, smells in (("functions", FUNCTION_SMELLS), ("classes", CLASS_SMELLS)) if c in parsed.columns]
    return parsed.select(*KEYS, F.explode(F.concat(*every)).alias("x")).select(*KEYS, "x.*")


def named(parsed: DataFrame, kind: str) -> DataFrame:
    """A row for each export, interface, type or macro: `kind` is the plural."""
    return _exploded(parsed, kind, "ord")


def unused_modules(parsed: DataFrame) -> DataFrame:
    """Imports of JavaScript and TypeScript whose module's base name is nowhere else in the file."""
    return _exploded(parsed, "unused_modules", "ord").select(*KEYS, F.col("name").alias("module"), "line")


def unused_imports(parsed: DataFrame) -> DataFrame:
    """Imports whose alias, name or module root is nowhere used in their file (Python)."""
    i = imports(parsed).where((F.col("language") == "python") & (F.coalesce("name", F.lit("")) != "*"))
    i = i.withColumn("symbol", F.coalesce("alias", "name", F.element_at(F.split("module", r"\."), 1)))
    used = parsed.select(*KEYS[:2], F.explode("used_names").alias("symbol"))
    return i.join(used, [*KEYS[:2], "symbol"], "left_anti").select(*KEYS, "import_ord", "module", "symbol", "line")


def file_calls(fns: DataFrame) -> DataFrame:
    """Call edges between functions of one file, each once."""
    called = fns.select(*KEYS, F.col("name").alias("caller"), F.explode("calls").alias("callee")).where(F.col("caller") != F.col("callee"))
    names = fns.select(*KEYS[:2], F.col("name").alias("callee")).distinct()
    return called.join(names, [*KEYS[:2], "callee"]).select(*KEYS, "caller", "callee").distinct()


def diagram_calls(parsed: DataFrame) -> DataFrame:
    """Call edges between all functions of a file, nested ones included, as a diagram of the file shows them."""
    return _exploded(parsed, "diagram_calls", "ord").select(*KEYS, "caller", "callee")


def inheritance(parsed: DataFrame) -> DataFrame:
    """Edges from a class to those of its bases that are classes of the same file. Within a file's row: files are parsed once, and nothing is shuffled."""
    names = F.transform("classes", lambda c: c["name"])
    known = F.array_intersect(names, F.flatten(F.transform("classes", lambda c: c["bases"])))
    c = parsed.select(*KEYS, known.alias("known"), "classes").where(F.size("known") > 0).select(*KEYS, "known", F.explode("classes").alias("x"))
    return c.select(*KEYS, F.col("x.name").alias("name"), "known", F.explode("x.bases").alias("base")).where(F.array_contains("known", F.col("base"))).drop("known")


def line_counts(content: Column) -> Column:
    """A struct of `loc`, `sloc`, `comments`, `blank`, `multi`: a fold over the lines that remembers the quotes it is inside of.

    A line with an odd one of triple quotes opens a text; the lines up to those that close it are `multi`.
    """
    parts = F.split(content, "\n")
    lines = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    counted = ("loc", "sloc", "comments", "blank", "multi")
    start = F.struct(*(F.lit(0).cast("long").alias(c) for c in counted), F.lit("").alias("quote"))

    def opened(line: Column) -> Column:
        once = lambda q: F.size(F.split(line, q, 3)) == 2
        return F.when(once('"""'), '"""').when(once("'''"), "'''").otherwise("")

    def step(s: Column, raw: Column) -> Column:
        line, inside = text.strip(raw), s["quote"] != ""
        kind = F.when(inside, "multi").when(line == "", "blank").when(line.startswith("#"), "comments").otherwise("sloc")
        quote = F.when(inside, F.when(line.contains(s["quote"]), "").otherwise(s["quote"])).when(kind == "sloc", opened(line)).otherwise("")
        return F.struct((s["loc"] + 1).alias("loc"), *((s[c] + (kind == c).cast("long")).alias(c) for c in counted[1:]), quote.alias("quote"))

    return F.aggregate(lines, start, step, lambda s: F.struct(*(s[c].alias(c) for c in counted)))


#: The facts of a parse that `metrics` needs.
METRIC_FACTS = ["functions", "tokens"]


def metrics(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """Maintainability, Halstead and line counts of each Python file that parses.

    Counts come from token and line rows within a file's own row: nothing is shuffled but
    to bring texts and facts together.
    """
    of = lambda kind: F.transform(F.filter("tokens", lambda t: t["kind"] == kind), lambda t: t["value"])
    kinds = {"operators": of("operator"), "operands": of("operand")}
    counts = F.struct(*(F.size(F.array_distinct(v)).cast("long").alias(f"distinct_{k}") for k, v in kinds.items()), *(F.size(v).cast("long").alias(f"total_{k}") for k, v in kinds.items()))
    cc = F.when(F.size("functions") > 0, F.aggregate("functions", F.lit(0.0), lambda a, f: a + f["complexity"], lambda a: a / F.size("functions"))).otherwise(0.0)
    python = parsed.where((F.col("language") == "python") & F.col("error").isNull())
    own = python.select(*KEYS, counts.alias("halstead"), F.size(of("statement")).cast("long").alias("lloc"), cc.alias("__cc"))
    lines = files.select(*KEYS[:2], line_counts(F.coalesce("content", F.lit(""))).alias("raw"))
    both = own.join(lines, KEYS[:2])
    h = labels.halstead(F.col("halstead"))
    sloc, comments = F.col("raw.sloc"), F.col("raw.comments") + F.col("raw.multi")
    ratio = F.when(sloc > 0, comments / sloc * 100).otherwise(0.0)
    return both.select(*KEYS, "raw.*", "lloc", "halstead.*", *(c.alias(n) for n, c in h.items()), labels.maintainability(h["volume"], F.col("__cc"), sloc.cast("double"), ratio).alias("mi"))


def live_metrics(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """The editor's figures of each file: by syntax tree for Python, by patterns else and where it does not parse."""
    content = F.coalesce("content", F.lit(""))
    lines = text.py_lines(content)
    light = F.transform("light_functions", lambda f: labels.big_o_light(f["loops"], f["recursive"], f["halves"]))
    total = F.size("light_functions")
    tree = {
        "functions": total.cast("long"),
        "classes": F.col("light_classes").cast("long"),
        "imports": F.col("light_imports").cast("long"),
        "avg_cc": F.when(total > 0, F.round(F.aggregate("light_functions", F.lit(0.0), lambda a, f: a + f["cc"]) / total, 1)).otherwise(0.0),
        "max_cc": F.coalesce(F.array_max(F.transform("light_functions", lambda f: f["cc"])), F.lit(0)).cast("long"),
        "big_o_worst": labels.worst_big_o(light),
    }
    s = text.suffix(F.col("path"))
    broken = F.col("error").isNotNull() & (s == ".py")
    js, c = text.live_js(content), text.live_c(content)
    python, other = text.live_fallback(content, True), text.live_fallback(content, False)

    def choose(key: str):
        return (
            F.when(broken, python[key]).when(s == ".py", tree[key]).when(s.isin(".ts", ".tsx", ".js", ".jsx"), js[key]).when(s.isin(".c", ".cpp", ".h", ".hpp"), c[key]).otherwise(other[key])
        )

    fallback = broken | ~s.isin(".py", ".ts", ".tsx", ".js", ".jsx", ".c", ".cpp", ".h", ".hpp")
    joined = files.join(parsed.select(*KEYS[:2], "error", "light_functions", "light_classes", "light_imports"), KEYS[:2], "left")
    return joined.select(
        *KEYS,
        text.language(F.col("path")).alias("language"),
        F.size(lines).cast("long").alias("loc"),
        F.when(fallback, text.source_lines(lines, True)).otherwise(text.source_lines(lines)).alias("sloc"),
        *(choose(k).alias(k) for k in tree),
        broken.alias("safe_mode"),
    )


def wasm_hints(fns: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """What native code would speed up: keys, `fn_ord`, `name`, `line`, `priority`, `reasons`, `recommendation`, `speedup`.

    With `files`, a module that loads .wasm is a hint of priority 5 on line 1 (Python), and
    functions beside Cython code are told so.
    """
    big_o, cc, loc, name = (F.col(c) for c in ("big_o", "complexity", "loc", "name"))
    hot, language = labels.is_hot(big_o), F.col("language")
    python, c = language == "python", language.isin("c", "cpp")
    if files is None:
        rows = fns.withColumn("uses_cython", F.lit(False))
    else:
        rows = fns.join(wasm_modules(files).select(*KEYS[:2], "uses_cython"), KEYS[:2], "left").withColumn("uses_cython", F.coalesce("uses_cython", F.lit(False)))
    own = F.array(
        F.when(hot, F.concat(F.lit("time "), big_o)),
        F.when(cc >= 5, F.format_string("cyclomatic complexity %d", cc)),
        F.when(loc >= 30, F.format_string("%d lines", loc)),
        F.when(labels.is_numeric_name(name), F.lit("the name tells of numeric work")),
    )
    reasons = F.when(python, F.array_compact(own)).when(c, F.array(F.format_string("hot path in C: %s, complexity %d", big_o, cc))).otherwise(F.array(F.concat(F.lit("hot path in a script: "), big_o)))
    wanted = F.when(python, labels.wasm_priority(big_o, cc, loc, name)).when((c & (hot | (cc >= 5))) | (language.isin("javascript", "typescript") & hot), 3).otherwise(0)
    advice = (
        F.when(c, "compile with Emscripten: emcc -O3 -s WASM=1")
        .when(~python, "move it to a Rust or C++ module compiled to WASM")
        .when(F.col("uses_cython"), F.concat(F.lit("add cdef with C types to "), name))
        .when(big_o.isin("O(n²)", "O(n³)"), F.concat(F.lit("type it in Cython, vectorise it with NumPy, or compile it with Emscripten: "), name))
        .when(big_o == "O(2^n)", F.concat(F.lit("memoise it, use dynamic programming, then type it in Cython: "), name))
        .otherwise(F.concat(F.lit("declare it with cdef in a .pyx file: "), name))
    )
    hints = rows.select(*KEYS, "fn_ord", "name", "line", "big_o", wanted.alias("priority"), reasons.alias("reasons"), advice.alias("recommendation"), labels.speedup(big_o, cc, language).alias("speedup")).where("priority > 0")
    if files is None:
        return hints
    modules = wasm_modules(files).where("uses_wasm").where(text.parser_of(F.col("path")) == "python")
    loads = modules.select(*KEYS, F.lit(1 << 30).alias("fn_ord"), F.lit("<module>").alias("name"), F.lit(1).alias("line"), F.lit(None).cast("string").alias("big_o"), F.lit(5).alias("priority"), F.array(F.lit("the file loads .wasm modules")).alias("reasons"), F.lit("give the bindings types").alias("recommendation"), F.lit("N/A").alias("speedup"))
    return hints.unionByName(loads)


def ordered_hints(hints: DataFrame) -> DataFrame:
    """A file's hints, most urgent first, else as they stand in it."""
    return hints.orderBy("project_id", "file_ord", F.desc("priority"), "fn_ord")


def critical_hints(hints: DataFrame) -> DataFrame:
    return hints.where(F.col("priority") >= 4)


def hint_summary(hints: DataFrame) -> DataFrame:
    """Of each project the hints, the critical ones and the files with any."""
    return hints.groupBy("project_id").agg(F.count("*").alias("hints"), F.count_if(F.col("priority") >= 4).alias("critical"), F.countDistinct("file_ord").alias("candidates"))


def wasm_modules(files: DataFrame) -> DataFrame:
    """Whether files load .wasm modules, and whether they use Cython."""
    content = F.coalesce("content", F.lit(""))
    return files.select(*KEYS, content.contains(".wasm").alias("uses_wasm"), content.rlike(r"\bcimport\b|\bcdef\b|\bcpdef\b").alias("uses_cython"))
