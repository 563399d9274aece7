"""Security findings as dataflow over statement rows: where values come from, through which names, into which calls.

The parse gives assignments, calls, what expressions are made of, and which assignment a
name stands for: its last one before, in a call its last one of all, and where that only
passes a name on, what this stands for. Sources, sinks and what lies between are joins and
windows here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .parse import KEYS
from .stepwise import Steps

# What is a source of data from outside, and where such data do harm.
HTTP_ATTRIBUTES = ("args", "form", "values", "json", "GET", "POST", "COOKIES", "headers")
SHELL_CALLS = ("os.system", "os.popen")
SUBPROCESS_CALLS = ("call", "run", "Popen", "check_call", "check_output")
UNSAFE_LOADS = ("pickle.loads", "pickle.load", "marshal.loads")

#: The facts of a parse that `findings` needs.
FACTS = ["assigns", "calls_made", "literals"]
OWN = [*KEYS, "fn"]


def source_of(form: Column, name: Column) -> Column:
    """Where the value of a call, subscript or attribute comes from, if from outside."""
    words = F.split(name, r"\.")
    http = F.when((F.size(words) > 1) & F.element_at(words, -1).isin(*HTTP_ATTRIBUTES), "HTTP request")
    getter = (F.size(words) > 1) & (F.element_at(words, -1) == "get") & F.get(words, F.size(words) - 2).isin(*HTTP_ATTRIBUTES)
    call = F.when(name.isin("input", "raw_input"), "stdin (input())").when(name.isin("os.getenv", "os.environ.get"), "environment variable").when((name == "request.get_json") | getter, "HTTP request")
    subscript = F.when(name == "sys.argv", "CLI argument").when(name == "os.environ", "environment variable").otherwise(http)
    return F.when(form == "call", call).when(form == "subscript", subscript).when(form == "attribute", http)


def sinks(parsed: DataFrame) -> DataFrame:
    """Calls in which data from outside would do harm: `rule` is the first that a call may break."""
    c = parsed.select(*KEYS, F.explode("calls_made").alias("x")).select(*KEYS, "x.*")
    words = F.split("name", r"\.")
    attribute = F.when(F.col("form") == "attribute", F.element_at(words, -1))
    base = F.when(F.col("form") == "attribute", F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), "."))
    c = c.withColumns({"attribute": attribute, "base": base})
    name = F.col("name")
    shell = name.isin(*SHELL_CALLS) | (F.col("attribute").isin(*SUBPROCESS_CALLS) & (F.col("base") == "subprocess") & F.col("shell"))
    unsafe = name.isin(*UNSAFE_LOADS) | ((name == "yaml.load") & ~F.coalesce(F.col("loader").contains("SafeLoader"), F.lit(False)))
    rule = (
        F.when(F.col("attribute").isin("execute", "executemany"), "sql")
        .when(F.coalesce(shell, F.lit(False)), "shell")
        .when((F.col("form") == "name") & (name == "open"), "open")
        .when(name == "os.path.join", "join")
        .when(unsafe, "load")
    )
    return c.withColumn("rule", rule).where("rule IS NOT NULL")


def _leaves(rows: DataFrame, keys: list[str]) -> DataFrame:
    """What expressions are made of, in order: `source`, or `ref`, the order of the assignment whose value counts; `built` on the way included."""
    x = rows.select(*keys, "built", F.posexplode("parts").alias("pos", "p"))
    x = x.select(*keys, (F.col("built") | F.coalesce("p.through", F.lit(False))).alias("built"), "pos", source_of(F.col("p.form"), F.col("p.name")).alias("source"), F.col("p.ref").alias("ref"))
    return x.where("source IS NOT NULL OR ref IS NOT NULL")


def tainted(parsed: DataFrame, steps: Steps) -> DataFrame:
    """Assignments whose value is from outside (keys, `ord`, `source`, `built`).

    An assignment takes the source of the first of its parts that has one. Each round
    settles the assignments whose earlier parts are settled; a value that only passes a
    name on points to where that one has it from, so that chains of such halve in a round.
    """
    a = parsed.select(*KEYS, F.explode("assigns").alias("x")).select(*KEYS, "x.*")
    open_, found = _leaves(a, [*OWN, "ord"]), []
    while True:
        waits = F.col("source").isNull()
        first = Window.partitionBy(*OWN, "ord")
        seen = open_.withColumns({"wait": F.min(F.when(waits, F.col("pos"))).over(first), "has": F.min(F.when(~waits, F.col("pos"))).over(first), "n": F.count("*").over(first)})
        ready = F.col("has").isNotNull() & (F.col("wait").isNull() | (F.col("has") < F.col("wait")))
        seen = steps.keep(seen.withColumn("ready", ready))
        done = seen.where("ready AND pos = has").select(*OWN, "ord", "source", "built")
        found.append(done)
        rest = seen.where("NOT ready")
        if rest.isEmpty():
            break
        # what is left refers to settled values, to values that are open, or to values that carry nothing
        told = done.select(*OWN, F.col("ord").alias("ref"), F.col("source").alias("s"), F.col("built").alias("b"))
        on = rest.where("n = 1 AND ref IS NOT NULL").select(*OWN, F.col("ord").alias("ref"), F.col("ref").alias("next"), F.col("built").alias("through"))
        # where a value passes a name on that is settled in this round, it is told along with it
        on = on.join(told.select(*OWN, F.col("ref").alias("next"), F.col("s").alias("s2"), F.col("b").alias("b2")), [*OWN, "next"], "left")
        still = rest.select(*OWN, F.col("ord").alias("ref")).distinct().withColumn("open", F.lit(True))
        moved = rest.drop("wait", "has", "n", "ready").join(told, [*OWN, "ref"], "left").join(on, [*OWN, "ref"], "left").join(still, [*OWN, "ref"], "left")
        moved = moved.where("ref IS NULL OR s IS NOT NULL OR open")
        open_ = moved.select(
            *OWN, "ord", "pos",
            (F.col("built") | F.coalesce("b", F.lit(False)) | F.coalesce("through", F.lit(False)) | F.coalesce("b2", F.lit(False))).alias("built"),
            F.coalesce("source", "s", "s2").alias("source"),
            F.when(F.coalesce("s", "s2").isNull(), F.coalesce("next", "ref")).alias("ref"),
        )
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    return out


def findings(parsed: DataFrame) -> DataFrame:
    """Security findings of parsed Python files: keys, `language`, `finding_ord`, `cwe`, `category`, `severity`, `confidence`, `source`, `sink`, `line`, `function`.

    Of a call at most one: SQL that is built from outside data, commands, paths, unsafe
    loading, in this order; then names of credentials with a text of their own. Runs at
    once, step by step; needs FACTS.
    """
    steps, kept = Steps(parsed.sparkSession, "dataflow"), Steps(parsed.sparkSession, "findings")
    # the files are parsed once
    parsed = steps.keep(parsed.where("language = 'python'").select(*KEYS, *FACTS))
    found = tainted(parsed, steps)
    calls = sinks(parsed)
    call = [*OWN, "ord"]
    args = calls.select(*call, F.posexplode("args").alias("k", "arg")).select(*call, "k", "arg.*")
    leaves = _leaves(args, [*call, "k"])
    named = leaves.where("source IS NULL").withColumnRenamed("ord", "call").join(found.select(*OWN, F.col("ord").alias("ref"), F.col("source").alias("s"), F.col("built").alias("b")), [*OWN, "ref"])
    known = leaves.where("source IS NOT NULL").select(*call, "k", "pos", "source", "built").unionByName(named.select(*OWN, F.col("call").alias("ord"), "k", "pos", F.col("s").alias("source"), (F.col("built") | F.col("b")).alias("built")))
    one = known.groupBy(*call, "k").agg(F.min_by(F.struct("source", "built"), "pos").alias("t"))
    both = one.groupBy(*call).agg(F.max(F.when(F.col("k") == 0, F.col("t"))).alias("first"), F.min_by(F.when(F.col("k") > 0, F.col("t.source")), F.when(F.col("k") > 0, F.col("k"))).alias("later"))
    c = calls.join(both, call, "left")
    outside, built = F.col("first").isNotNull(), F.coalesce("first.built", F.lit(False))
    source = F.col("first.source")
    written = F.concat("name", F.lit("(...)"))
    sql_sink = F.when(F.col("base") == "?", F.concat("attribute", F.lit("(...)"))).otherwise(F.concat("base", F.lit("."), "attribute", F.lit("(...)")))

    def row(cwe: str, category: str, source: Column, sink: Column, confidence: Column | str = "High") -> Column:
        return F.struct(F.lit(cwe).alias("cwe"), F.lit(category).alias("category"), F.lit("High").alias("severity"), (F.lit(confidence) if isinstance(confidence, str) else confidence).alias("confidence"), source.alias("source"), sink.alias("sink"))

    judged = (
        F.when((F.col("rule") == "sql") & outside & built, row("CWE-89", "SQL Injection", source, sql_sink))
        .when((F.col("rule") == "shell") & outside, row("CWE-78", "Command Injection", source, written))
        .when((F.col("rule") == "open") & outside & built, row("CWE-22", "Path Traversal", source, F.lit("open(...)")))
        .when((F.col("rule") == "join") & F.col("later").isNotNull(), row("CWE-22", "Path Traversal", F.col("later"), F.lit("os.path.join(...)")))
        .when(F.col("rule") == "load", row("CWE-502", "Insecure Deserialization", F.coalesce(source, F.lit("unvalidated deserialization call")), written, F.when(outside, "High").otherwise("Medium")))
    )
    risks = c.withColumn("x", judged).where("x IS NOT NULL").select(*KEYS, "x.*", "line", "function", F.lit(0).alias("family"), "fn", "ord")
    texts = parsed.select(*KEYS, F.posexplode("literals").alias("ord", "x")).select(*KEYS, "ord", "x.*").where(text.is_credential_name(F.col("name")) & ~text.is_placeholder(F.col("value")))
    no = F.lit(None).cast("string")
    secrets = texts.select(*KEYS, F.lit("CWE-798").alias("cwe"), F.lit("Hardcoded Credentials").alias("category"), F.lit("Medium").alias("severity"), F.lit("Medium").alias("confidence"), F.format_string("code literal (`%s`)", "name").alias("source"), no.alias("sink"), "line", no.alias("function"), F.lit(1).alias("family"), F.lit(0).alias("fn"), "ord")
    order = Window.partitionBy(*KEYS).orderBy("line", "family", "fn", "ord")
    rows = risks.unionByName(secrets).select(*KEYS, F.lit("python").alias("language"), (F.row_number().over(order) - 1).alias("finding_ord"), "cwe", "category", "severity", "confidence", "source", "sink", "line", "function")
    result = kept.keep(rows)
    steps.drop()
    return result
