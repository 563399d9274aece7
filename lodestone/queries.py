"""Queries of the analytics operators, each with SQL that says the same over the tables' numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import corpus
from .functions import labels, tables, text
from .operators import dataflow, graph, lint, logs, ml, naming, parse, patterns, rollup, search, symbols, tree
from .operators.parse import KEYS
from .operators.stepwise import Steps
from .sources import zips
from .sources.store import Store
from .streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _functions(files: DataFrame, recurrences: bool = False) -> DataFrame:
    fns = parse.functions(parse.parse_files(files, ["functions"]))
    return parse.with_recurrences(fns) if recurrences else fns


LABEL = "CASE p_size % 5 WHEN 0 THEN 'O(1)' WHEN 1 THEN 'O(n)' WHEN 2 THEN 'O(n²)' WHEN 3 THEN 'O(n³)' ELSE 'O(n^4)' END"


@query(f"SELECT {LABEL} AS big_o, count(*) AS functions FROM part GROUP BY 1")
def bigo_distribution(spark, d):
    return rollup.big_o_distribution(_functions(corpus.loops(spark, d))).select("big_o", "functions")


@query(f"SELECT p_partkey AS part, {LABEL} AS big_o, replace({LABEL}, 'O(', 'Θ(') AS theta, replace({LABEL}, 'O(', 'Ω(') AS omega FROM part")
def bigo_labels(spark, d):
    return _functions(corpus.loops(spark, d), True).select(F.col("file_ord").alias("part"), "big_o", "theta", "omega")


CC = "1 + (p_size % 7) * CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END"


@query(f"SELECT p_partkey AS part, {CC} AS complexity, CASE WHEN {CC} <= 5 THEN 'low' WHEN {CC} <= 10 THEN 'medium' WHEN {CC} <= 20 THEN 'high' ELSE 'critical' END AS level, CASE WHEN {CC} <= 5 THEN 'A' WHEN {CC} <= 10 THEN 'B' WHEN {CC} <= 20 THEN 'C' ELSE 'D' END AS cc_rank FROM part")
def cc_by_function(spark, d):
    return _functions(corpus.branches(spark, d)).select(F.col("file_ord").alias("part"), "complexity", labels.cc_band(F.col("complexity")).alias("level"), labels.cc_rank(F.col("complexity")).alias("cc_rank"))


@query(f"SELECT p_partkey AS part, 'f_' || p_partkey AS name, {CC} AS complexity FROM part ORDER BY complexity DESC, part LIMIT 10")
def top_complex_functions(spark, d):
    return rollup.top_complex(_functions(corpus.branches(spark, d))).select(F.col("file_ord").alias("part"), "name", "complexity")


@query(f"SELECT count(*) AS total, round(avg({CC}), 2) AS avg_cc, count(*) FILTER ({CC} > 10) AS hot, count(*) FILTER (false) AS expensive, count(*) FILTER ({CC} <= 5) AS low, count(*) FILTER ({CC} > 5 AND {CC} <= 10) AS medium, count(*) FILTER ({CC} > 10 AND {CC} <= 20) AS high, count(*) FILTER ({CC} > 20) AS critical FROM part")
def heatmap_summary(spark, d):
    return graph.heatmap_summary(graph.heatmap(_functions(corpus.branches(spark, d)))).drop("project_id")


@query(f"WITH f AS (SELECT p_partkey AS part, {CC} AS complexity FROM part) SELECT part, complexity, CASE WHEN complexity > 20 THEN 0 WHEN complexity > 5 THEN 1 ELSE 3 END + 3 AS heat FROM f")
def heatmap(spark, d):
    return graph.heatmap(_functions(corpus.branches(spark, d))).select(F.col("file_ord").alias("part"), "complexity", "heat")


SMELLS = """
SELECT p_partkey AS part, 'long_function' AS kind, 1 + p_size * 2 AS amount FROM part WHERE 1 + p_size * 2 > 50
UNION ALL SELECT p_partkey, 'excessive_parameters', p_size % 9 FROM part WHERE p_size % 9 > 5"""


@query(SMELLS)
def size_smells(spark, d):
    parsed = parse.parse_files(corpus.sizes(spark, d), parse.FUNCTION_SMELL_FACTS + parse.CLASS_SMELL_FACTS)
    rows = parse.structural_smells(parsed)
    return rows.select(F.col("file_ord").alias("part"), "kind", F.regexp_extract("message", r"^(\d+)", 1).cast("int").alias("amount"))


@query("SELECT p_partkey AS part, p_size % 7 AS depth FROM part WHERE p_size % 7 > 4")
def deep_nesting(spark, d):
    parsed = parse.parse_files(corpus.nesting(spark, d), parse.FUNCTION_SMELL_FACTS + parse.CLASS_SMELL_FACTS)
    rows = parse.structural_smells(parsed).where("kind = 'deep_nesting'")
    return rows.select(F.col("file_ord").alias("part"), F.regexp_extract("message", r"^(\d+)", 1).cast("int").alias("depth"))


@query("""SELECT p_partkey AS part, p_partkey % 3 = 0 AS is_recursive, p_partkey % 3 = 0 AS is_tail_recursive, p_partkey % 2 = 0 AS binary_split,
CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'O(log n)' ELSE 'O(n)' END ELSE 'O(1)' END AS space,
CASE WHEN p_partkey % 3 <> 0 THEN 'O(1)' WHEN p_partkey % 2 = 0 THEN 'O(log n)' ELSE 'O(2^n)' END AS big_o FROM part""")
def recursion_and_space(spark, d):
    return _functions(corpus.nesting(spark, d), True).select(F.col("file_ord").alias("part"), "is_recursive", "is_tail_recursive", "binary_split", "space", "big_o")


@query("""WITH f AS (SELECT p_partkey AS part, p_size % 4 + 1 AS a, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS c FROM part)
SELECT part, 'T(n) = ' || a || 'T(n/2) + ' || CASE c WHEN 0 THEN 'Θ(1)' ELSE 'Θ(n)' END AS recurrence,
CASE WHEN a = 1 THEN CASE c WHEN 0 THEN 'O(log n)' ELSE 'O(n)' END WHEN a = 2 THEN CASE c WHEN 0 THEN 'O(n)' ELSE 'O(n log n)' END WHEN a = 3 THEN 'O(n^1.585)' ELSE 'O(n^2)' END AS big_o FROM f""")
def recurrences(spark, d):
    return _functions(corpus.recursions(spark, d), True).where("recurrence is not null").select(F.col("file_ord").alias("part"), "recurrence", "big_o")


FILES = "f AS (SELECT s_suppkey AS k, count(*) OVER () AS n FROM supplier), i AS (SELECT k AS src, k * 7 % n AS dst, 1 AS o FROM f UNION ALL SELECT k, k * k % n, 2 FROM f), e AS (SELECT DISTINCT src, dst FROM i WHERE src <> dst AND dst IN (SELECT k FROM f))"


def _edges(spark, d):
    files = corpus.imports(spark, d)
    return files, graph.import_edges(parse.imports(parse.parse_files(files, ["imports"])), files)


@query(f"WITH {FILES} SELECT 'm_' || src || '.py' AS src, 'm_' || dst || '.py' AS dst, 'm_' || dst AS via FROM e")
def import_edges(spark, d):
    return _edges(spark, d)[1].select("src", "dst", "via")


DEGREES = f"WITH {FILES}, g AS (SELECT k, n, (SELECT count(*) FROM e WHERE dst = k) AS ca, (SELECT count(*) FROM e WHERE src = k) AS ce FROM f)"


@query(f"{DEGREES} SELECT k AS supplier, ca AS in_degree, ce AS out_degree, round((ca + ce) / (n - 1), 3) AS centrality, CASE WHEN ca + ce > 0 THEN ce / (ca + ce) ELSE 0.0 END AS instability, ca >= 2 AND row_number() OVER (ORDER BY ca DESC, k) <= 5 AS is_hub FROM g")
def degree_centrality(spark, d):
    return graph.degrees(*_edges(spark, d)).select(F.col("file_ord").alias("supplier"), "in_degree", "out_degree", "centrality", "instability", "is_hub")


@query(f"{DEGREES} SELECT k AS supplier, ce = 0 AS isolated FROM g WHERE ca = 0")
def entry_points(spark, d):
    return graph.entry_points(*_edges(spark, d)).select(F.col("file_ord").alias("supplier"), "isolated")


COUPLED = """WITH f AS (SELECT s_suppkey AS k, s_suppkey % 20 AS i, s_suppkey // 20 AS p FROM supplier),
m AS (SELECT p, min(i) AS least, count(*) - 1 AS ce, count(*) FILTER (i BETWEEN 1 AND 4) AS ca FROM f GROUP BY 1 HAVING min(i) = 0)"""


def _coupled(spark, d):
    files = corpus.coupled(spark, d)
    return graph.degrees(files, graph.import_edges(parse.imports(parse.parse_files(files, ["imports"])), files))


@query(COUPLED + " SELECT 'high_efferent_coupling' AS kind, 'k_' || p * 20 || '.py' AS name FROM m WHERE ce > 15 UNION ALL SELECT 'unstable_dependency', 'k_' || p * 20 || '.py' FROM m WHERE ca >= 3 AND ce / (ca + ce) > 0.5")
def coupling_smells(spark, d):
    return graph.coupling_smells(_coupled(spark, d)).select("kind", "name")


@query(COUPLED + " SELECT 't' || p AS project, greatest(ca, CASE WHEN ce > 0 THEN 1 ELSE 0 END) AS most FROM m UNION ALL SELECT DISTINCT 't' || p, 0 FROM f WHERE p NOT IN (SELECT p FROM m)")
def max_in_degree(spark, d):
    return graph.max_in_degree(_coupled(spark, d)).select(F.col("project_id").alias("project"), F.col("max_in_degree").alias("most"))


RINGS = """
WITH RECURSIVE n AS (SELECT s_suppkey AS k, s_suppkey // 30 AS p FROM supplier),
e AS (SELECT a.p, 'r_' || a.k || '.py' AS src, 'r_' || b.k || '.py' AS dst FROM n a JOIN n b ON a.p = b.p AND (b.k = CASE WHEN a.k % 3 = 2 THEN a.k - 2 ELSE a.k + 1 END OR (a.k % 30 = 5 AND b.k = a.k - 1))),
w AS (SELECT p, [src, dst] AS nodes FROM e WHERE src < dst UNION ALL SELECT w.p, list_append(nodes, e.dst) FROM w JOIN e ON e.p = w.p AND e.src = nodes[-1] WHERE e.dst > nodes[1] AND NOT list_contains(nodes, e.dst)),
c AS (SELECT w.p, nodes, row_number() OVER (PARTITION BY w.p ORDER BY len(nodes), nodes) AS r FROM w JOIN e ON e.p = w.p AND e.src = nodes[-1] AND e.dst = nodes[1])
"""


def _cycles(spark, d):
    files = corpus.rings(spark, d)
    return graph.cycles(graph.import_edges(parse.imports(parse.parse_files(files, ["imports"])), files))


@query(RINGS + "SELECT 'b' || p AS project, len(nodes) AS length, array_to_string(nodes, ' ') AS nodes FROM c WHERE r <= 20")
def import_cycles(spark, d):
    return _cycles(spark, d).select(F.col("project_id").alias("project"), F.col("length").cast("long").alias("length"), F.array_join("nodes", " ").alias("nodes"))


@query(RINGS + "SELECT 'circular_dependency' AS kind, array_to_string(nodes, ' → ') || ' → ' || nodes[1] AS name FROM c WHERE r <= 20")
def circular_smells(spark, d):
    return graph.cycle_smells(_cycles(spark, d)).select("kind", "name")


@query(RINGS + "SELECT DISTINCT 'b' || p AS project, unnest(nodes) AS path FROM c WHERE r <= 20")
def cycle_members(spark, d):
    return graph.cycle_members(_cycles(spark, d)).select(F.col("project_id").alias("project"), "path")


@query("SELECT s_suppkey AS supplier, 'json' AS symbol, 1 AS line FROM supplier WHERE s_suppkey % 2 <> 0 UNION ALL SELECT s_suppkey, 'path', 2 FROM supplier WHERE s_suppkey % 3 <> 0")
def unused_imports(spark, d):
    parsed = parse.parse_files(corpus.unused(spark, d), ["imports", "used_names"])
    return parse.unused_imports(parsed).select(F.col("file_ord").alias("supplier"), "symbol", "line")


RISKS = "SELECT p_partkey AS part, CASE p_partkey % 6 WHEN 0 THEN 'CWE-89' WHEN 1 THEN 'CWE-78' WHEN 2 THEN 'CWE-22' ELSE 'CWE-502' END AS cwe, CASE p_partkey % 6 WHEN 0 THEN 'HTTP request' WHEN 1 THEN 'stdin (input())' WHEN 2 THEN 'CLI argument' ELSE 'unvalidated deserialization call' END AS source, CASE WHEN p_partkey % 6 = 3 THEN 'Medium' ELSE 'High' END AS confidence, CASE WHEN p_partkey % 6 = 3 THEN 2 ELSE 3 END AS line FROM part WHERE p_partkey % 6 < 4"


@query(RISKS)
def security_findings(spark, d):
    return dataflow.findings(parse.parse_files(corpus.risky(spark, d), dataflow.FACTS)).select(F.col("file_ord").alias("part"), "cwe", "source", "confidence", "line")


@query(f"WITH r AS ({RISKS}) SELECT count(*) AS high, 0::BIGINT AS medium, 0::BIGINT AS low, 100::BIGINT AS high_percent FROM r")
def severity_counts(spark, d):
    return rollup.severity_counts(dataflow.findings(parse.parse_files(corpus.risky(spark, d), dataflow.FACTS))).select("high", "medium", "low", "high_percent")


@query("SELECT s_suppkey AS supplier, 'CWE-798' AS cwe FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0")
def credentials(spark, d):
    return dataflow.findings(parse.parse_files(corpus.secrets(spark, d), dataflow.FACTS)).select(F.col("file_ord").alias("supplier"), "cwe")


@query("SELECT s_suppkey AS supplier, s_suppkey % 2 = 0 AS telling, s_suppkey % 3 = 0 AS placeholder FROM supplier")
def credential_text(spark, d):
    name, value = F.regexp_extract("content", r"^(\w+) = ", 1), F.regexp_extract("content", '"(.*)"', 1)
    return corpus.secrets(spark, d).select(F.col("file_ord").alias("supplier"), text.is_credential_name(name).alias("telling"), text.is_placeholder(value).alias("placeholder"))


@query("""SELECT CASE p_partkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' ELSE 'c' END AS language, count(*) AS files,
CAST(sum(CASE p_partkey % 3 WHEN 0 THEN 3 * (p_size % 4 + 1) - 1 WHEN 1 THEN 4 * (p_size % 4 + 1) - 1 ELSE 4 * (p_size % 4 + 1) - 1 END) AS BIGINT) AS loc, CAST(sum(p_size % 4 + 1) AS BIGINT) AS functions FROM part GROUP BY 1""")
def language_distribution(spark, d):
    files = corpus.mixed(spark, d)
    return rollup.language_distribution(files, parse.parse_files(files, ["functions"])).select("language", "files", (F.col("loc")).alias("loc"), "functions")


@query("SELECT count(*) AS files, CAST(sum(p_size % 4 + 1) AS BIGINT) AS functions, 0::BIGINT AS classes, 0::BIGINT AS imports FROM part")
def project_totals(spark, d):
    return rollup.totals(parse.parse_files(corpus.mixed(spark, d), ["functions", "classes", "imports"])).drop("project_id")


@query("""SELECT p_partkey AS part, 'Base' AS name, p_size AS methods, p_size AS attributes FROM part UNION ALL SELECT p_partkey, 'Child', 0, 0 FROM part WHERE p_partkey % 2 = 0""")
def class_facts(spark, d):
    rows = parse.classes(parse.parse_files(corpus.classes(spark, d), ["classes"]))
    return rows.select(F.col("file_ord").alias("part"), "name", F.size("methods").alias("methods"), "attributes")


@query("SELECT p_partkey AS part, 'large_class' AS kind FROM part WHERE p_size > 15 UNION ALL SELECT p_partkey, 'god_object' FROM part WHERE p_size >= 20")
def class_smells(spark, d):
    rows = parse.structural_smells(parse.parse_files(corpus.classes(spark, d), parse.CLASS_SMELL_FACTS))
    return rows.where(F.col("kind").isin("large_class", "god_object")).select(F.col("file_ord").alias("part"), "kind")


@query("SELECT p_partkey AS part, 'Child' AS name, 'Base' AS base FROM part WHERE p_partkey % 2 = 0")
def inheritance(spark, d):
    return parse.inheritance(parse.parse_files(corpus.classes(spark, d), parse.INHERITANCE_FACTS)).select(F.col("file_ord").alias("part"), "name", "base")


@query("""SELECT s_suppkey AS supplier, 'single_letter_name' AS kind FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 'inconsistent_casing' FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT s_suppkey, 'shadowed_name' FROM supplier WHERE s_suppkey % 5 = 0""")
def naming_smells(spark, d):
    return naming.naming_smells(parse.parse_files(corpus.names(spark, d), naming.FACTS)).select(F.col("file_ord").alias("supplier"), "kind")


@query("SELECT s_suppkey AS supplier, 'main' AS caller, 'helper' AS callee FROM supplier UNION ALL SELECT s_suppkey, 'helper', 'leaf' FROM supplier WHERE s_suppkey % 2 = 0")
def call_edges(spark, d):
    fns = _functions(corpus.calls(spark, d))
    return graph.call_graph(fns).select(F.col("file_ord").alias("supplier"), "caller", "callee")


@query("SELECT 'p' || s_suppkey AS project, unnest(CASE WHEN s_suppkey % 2 = 0 THEN ['main', 'helper', 'leaf'] ELSE ['main', 'helper'] END) AS name FROM supplier")
def active_functions(spark, d):
    fns = _functions(corpus.calls(spark, d))
    return graph.active_functions(fns, graph.call_graph(fns)).select(F.col("project_id").alias("project"), "name")


@query("SELECT s_suppkey AS supplier, 'C001' AS code, unnest([1, 3, 5]) AS line FROM supplier UNION ALL SELECT s_suppkey, 'C002', 6 FROM supplier")
def python_lint(spark, d):
    files = corpus.calls(spark, d)
    return lint.python_lint(files, parse.parse_files(files, ["lint", "error_line", "error_col"])).select(F.col("file_ord").alias("supplier"), "code", "line")


@query("""WITH m AS (SELECT s_suppkey AS k FROM supplier) SELECT k AS supplier, 'main' AS symbol, 2 AS line, 'main' AS fn FROM m UNION ALL SELECT k, 'leaf', 6, 'leaf' FROM m UNION ALL SELECT k, 'helper', 99, 'helper' FROM m""")
def enclosing_functions(spark, d):
    files = corpus.calls(spark, d)
    points = files.select(*KEYS, F.explode(F.array(*[F.struct(F.lit(s).alias("symbol"), F.lit(n).alias("line")) for s, n in (("main", 2), ("leaf", 6), ("helper", 99))])).alias("x")).select(*KEYS, "x.*")
    return symbols.enclosing(points, _functions(files)).select(F.col("file_ord").alias("supplier"), "symbol", "line", F.col("function").alias("fn"))


@query("SELECT s_suppkey AS supplier, unnest(['main(x)', 'helper(x)', 'leaf(x)']) AS label FROM supplier UNION ALL SELECT s_suppkey, 'leaf(x)' FROM supplier")
def completions(spark, d):
    parsed = parse.parse_files(corpus.calls(spark, d), ["symbols"])
    return symbols.completions(parsed).unionByName(symbols.completions(parsed, "LE")).select(F.col("file_ord").alias("supplier"), "label")


@query("SELECT s_suppkey AS supplier, 1 AS line, 0 AS col, 'old' AS dummy FROM supplier WHERE false UNION ALL SELECT s_suppkey, 3, 5, 'helper' FROM supplier UNION ALL SELECT s_suppkey, 2, 12, 'helper' FROM supplier UNION ALL SELECT s_suppkey, 2, 24, 'helper' FROM supplier")
def rename_edits(spark, d):
    files = corpus.calls(spark, d)
    refs = symbols.references(parse.parse_files(files, ["refs"]))
    return lint.rename_edits(refs, files, "helper", "aid").select(F.col("file_ord").alias("supplier"), "line", "col", F.col("old").alias("dummy"))


SCRIPT_LINT = """WITH s AS (SELECT s_suppkey AS k FROM supplier) SELECT k AS supplier, 'TS001' AS code FROM s WHERE k % 2 = 0 UNION ALL SELECT k, 'TS004' FROM s WHERE k % 3 = 0
UNION ALL SELECT k, 'TS003' FROM s WHERE k % 5 = 0 UNION ALL SELECT k, 'TS005' FROM s WHERE k % 5 = 0 UNION ALL SELECT k, 'E501' FROM s WHERE k % 7 = 0"""


@query(SCRIPT_LINT)
def script_lint(spark, d):
    return lint.script_lint(corpus.scripts(spark, d)).select(F.col("file_ord").alias("supplier"), "code")


@query(f"WITH x AS ({SCRIPT_LINT}) SELECT count(*) AS issues, count(*) FILTER (code = 'TS003') AS errors, count(*) FILTER (code IN ('TS004', 'TS005', 'E501')) AS warnings, count(DISTINCT supplier) AS files FROM x")
def issue_summary(spark, d):
    return lint.issue_summary(lint.script_lint(corpus.scripts(spark, d))).drop("project_id")


@query("SELECT s_suppkey AS supplier, 'run' AS name, ['a'] || CASE WHEN false THEN ['x'] ELSE [] END AS calls FROM supplier")
def js_functions(spark, d):
    return _functions(corpus.scripts(spark, d)).select(F.col("file_ord").alias("supplier"), "name", "calls")


@query("SELECT doc_id, i AS line, length(x) AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE length(x) > 120")
def long_lines(spark, d):
    docs = corpus.table(spark, d, "documents")
    files = docs.select(F.lit("p").alias("project_id"), F.col("doc_id").alias("file_ord"), F.lit("x").alias("path"), F.col("text").alias("content"))
    rows = lint.lines(files).where(F.length("text") > lint.LONG_LINE)
    return rows.select(F.col("file_ord").alias("doc_id"), F.col("line").cast("long").alias("line"), F.length("text").cast("long").alias("chars"))


LEVEL = "CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' WHEN 'signup' THEN 'info' END"


@query("SELECT 'log' || user_id % 10 AS name, count(*) AS total_lines, 0::BIGINT AS critical, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS warning, count(*) FILTER (event_type = 'signup') AS info FROM events GROUP BY 1")
def log_level_counts(spark, d):
    rows = corpus.logs(spark, d).withColumn("level", logs.level_of(F.col("line")))
    return logs.level_counts(rows)


@query("SELECT 'log' || user_id % 10 AS name, event_id AS line_no, 'error' AS level, 'ERROR failed ' || event_id AS line FROM events WHERE event_type = 'error' ORDER BY name, line_no LIMIT 100")
def log_errors(spark, d):
    rows = corpus.logs(spark, d).select("name", F.col("event_id").alias("line_no"), "line", logs.level_of(F.col("line")).alias("level"))
    return logs.error_lines(rows)


STATUS = "CASE WHEN event_type = 'error' THEN 'down' WHEN event_type = 'purchase' THEN 'error' ELSE 'ok' END"


@query(f"SELECT '/u/' || user_id AS url, back, seq, ms, status FROM (SELECT user_id, event_id AS seq, value AS ms, {STATUS} AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events) WHERE back <= 10")
def api_history_last10(spark, d):
    rows = corpus.probes(spark, d).withColumn("status", logs.probe_status(F.col("code"), F.col("error")))
    return logs.history(rows).select("url", F.col("back").cast("long").alias("back"), "seq", "ms", "status")


@query(f"SELECT count(*) AS apis, count(*) FILTER ({STATUS} = 'ok') AS ok, count(*) FILTER ({STATUS} = 'down') AS down, count(*) FILTER ({STATUS} = 'error') AS error FROM events")
def api_badges(spark, d):
    return logs.badges(corpus.probes(spark, d).withColumn("status", logs.probe_status(F.col("code"), F.col("error"))))


@query("SELECT event_id FROM (SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 200)")
def newest_log_entries(spark, d):
    return logs.newest(corpus.logs(spark, d), ["ts", "event_id"]).select("event_id")


@query("SELECT conv_id, turn, i AS line FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations) WHERE contains(lower(x), 'the')")
def grep(spark, d):
    c = corpus.table(spark, d, "conversations")
    files = c.select(F.col("conv_id").cast("string").alias("project_id"), F.col("turn").alias("file_ord"), F.lit("x").alias("path"), F.col("text").alias("content"))
    return search.grep(files, "the").select(F.col("project_id").cast("long").alias("conv_id"), F.col("file_ord").alias("turn"), F.col("line").cast("long").alias("line"))


@query("SELECT page_id, CAST(length(html) - length(replace(html, '{', '')) AS BIGINT) AS opened, CAST(length(html) - length(replace(html, chr(10), '')) AS BIGINT) AS feeds, html LIKE '%track(%' AS tracks FROM pages")
def text_counts(spark, d):
    h = F.col("html")
    return corpus.table(spark, d, "pages").select("page_id", text.count_of(h, "{").alias("opened"), text.line_feeds(h).alias("feeds"), h.contains("track(").alias("tracks"))


@query("SELECT doc_id, octet_length(encode(text)) AS size_bytes, false AS is_binary, regexp_matches(text, '[:\\\\,(\\[{]\\s*$') AS is_truncated FROM documents")
def validate_files(spark, d):
    checks = text.validation(F.lit("x.py"), F.col("text"), F.lit(None).cast("string"))
    return corpus.table(spark, d, "documents").select("doc_id", *(checks[c].alias(c) for c in ("size_bytes", "is_binary", "is_truncated")))


TREE = """WITH p AS (SELECT page_id, string_split(regexp_replace(url, '^https?://', ''), '/') AS a, strlen(html) AS b FROM pages),
x AS (SELECT array_to_string(a[1:k], '/') AS path, k AS depth, a[k] AS name, k = len(a) AS is_file, b FROM (SELECT a, b, unnest(range(1, least(len(a), 10) + 1)) AS k FROM p))"""


@query(TREE + " SELECT path, CAST(depth AS BIGINT) AS depth, name, is_file, CAST(sum(b) AS BIGINT) AS bytes FROM x GROUP BY ALL")
def dir_tree(spark, d):
    pages = corpus.table(spark, d, "pages")
    files = pages.select(F.lit("p").alias("project_id"), F.col("page_id").alias("file_ord"), F.regexp_replace("url", "^https?://", "").alias("path"), F.col("html").alias("content"))
    return tree.tree(files).select("path", F.col("depth").cast("long").alias("depth"), "name", "is_file", "bytes")


@query("SELECT lower(regexp_extract(regexp_extract(p_type, '[^ ]*$'), '^(.).*', 1)) AS letter, count(*) AS files FROM part GROUP BY 1 ORDER BY files DESC, letter LIMIT 10")
def extension_histogram(spark, d):
    p = corpus.table(spark, d, "part")
    last = F.lower(F.substring(F.regexp_extract("p_type", "[^ ]*$", 0), 1, 1))
    files = p.select(F.lit("p").alias("project_id"), F.col("p_partkey").alias("file_ord"), F.concat(F.lit("src/f."), last).alias("path"), F.lit("").alias("content"))
    return tree.extension_histogram(files).select(F.substring("extension", 2, 10).alias("letter"), "files")


@query("SELECT c_custkey AS project, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) <= 20 AS keep FROM customer")
def retention(spark, d):
    rows = corpus.table(spark, d, "customer").select(F.col("c_custkey").alias("project_id"), F.col("c_acctbal").alias("mtime"))
    return tree.retention(rows).select(F.col("project_id").alias("project"), "keep")


@query("SELECT s_suppkey AS supplier, unnest(['Pandas', 'Scikit-learn']) AS library, unnest([1, 2]) AS line FROM supplier")
def ml_libraries(spark, d):
    return ml.libraries(parse.imports(parse.parse_files(corpus.notebooks(spark, d), ["imports"]))).select(F.col("file_ord").alias("supplier"), "library", "line")


ML_STAGES = "SELECT s_suppkey AS supplier, unnest(['carga_datos', 'split', 'entrenamiento']) AS stage, unnest([3, 4, 6])::BIGINT AS line FROM supplier UNION ALL SELECT s_suppkey, 'evaluacion', 7 FROM supplier WHERE s_suppkey % 3 = 0"


@query(ML_STAGES)
def ml_pipeline(spark, d):
    return ml.pipeline(corpus.notebooks(spark, d)).select(F.col("file_ord").alias("supplier"), "stage", "line")


@query("SELECT s_suppkey AS supplier, 'LogisticRegression' AS model, 2::BIGINT AS line FROM supplier")
def ml_models(spark, d):
    return ml.models(corpus.notebooks(spark, d)).select(F.col("file_ord").alias("supplier"), "model", "line")


@query("SELECT s_suppkey AS supplier, 'accuracy' AS metric, 2::BIGINT AS count, 0.5 AS value FROM supplier WHERE s_suppkey % 3 = 0")
def ml_metrics(spark, d):
    return ml.metrics(corpus.notebooks(spark, d)).select(F.col("file_ord").alias("supplier"), "metric", "count", "value")


@query("SELECT s_suppkey AS supplier, 'no_validation' AS rule FROM supplier UNION ALL SELECT s_suppkey, 'split_without_seed' FROM supplier WHERE s_suppkey % 2 <> 0")
def ml_issues(spark, d):
    files = corpus.notebooks(spark, d)
    found = ml.libraries(parse.imports(parse.parse_files(files, ["imports"])))
    return ml.issues(files, found).select(F.col("file_ord").alias("supplier"), "rule")


@query("WITH s AS (SELECT s_suppkey AS k, 100 - 7 - CASE WHEN s_suppkey % 2 <> 0 THEN 7 ELSE 0 END + 5 + CASE WHEN s_suppkey % 3 = 0 THEN 10 ELSE 0 END + CASE WHEN s_suppkey % 2 = 0 THEN 5 ELSE 0 END AS v FROM supplier) SELECT k AS supplier, CAST(least(100, v) AS BIGINT) AS score FROM s")
def ml_score(spark, d):
    files = corpus.notebooks(spark, d)
    found = ml.libraries(parse.imports(parse.parse_files(files, ["imports"])))
    return ml.score(files, ml.pipeline(files), ml.issues(files, found)).select(F.col("file_ord").alias("supplier"), "score")


HEALTH = """WITH f AS (SELECT s_suppkey AS k, s_suppkey % 10 AS i, s_suppkey // 10 AS p FROM supplier),
e AS (SELECT a.p, a.i AS src, b.i AS dst FROM f a JOIN f b ON a.p = b.p AND b.i = CASE WHEN a.i % 3 = 2 THEN a.i - 2 ELSE a.i + 1 END),
c AS (SELECT a.p, count(*) AS cycles FROM e a JOIN e b ON a.p = b.p AND b.src = a.dst JOIN e c ON c.p = a.p AND c.src = b.dst AND c.dst = a.src WHERE a.src < a.dst AND a.src < c.src GROUP BY 1),
n AS (SELECT p, count(*) AS files, count(*) FILTER (k % 7 = 0) AS high, count(*) FILTER (k % 5 = 0) AS structural, count(*) FILTER (k % 2 = 0) AS naming, round(avg(1 + k % 4 * 4), 2) AS cc FROM f GROUP BY 1)
SELECT 'h' || n.p AS project, greatest(0, 100 - 15 * high)::BIGINT AS security, greatest(0, 100 - least(100, round(structural / files * 300 + naming / files * 100)))::BIGINT AS quality,
greatest(0, least(100, round(100 - greatest(0, cc - 5) * 8)))::BIGINT AS complexity, (100 - least(100, 15 * coalesce(cycles, 0)))::BIGINT AS architecture FROM n LEFT JOIN c USING (p)"""


@query(HEALTH)
def health_scores(spark, d):
    files = corpus.unhealthy(spark, d)
    # the files are parsed once for all that looks at them
    parsed = Steps(spark, "health").keep(parse.parse_files(files, ["imports", "functions", "classes", *naming.FACTS, *dataflow.FACTS]))
    edges = graph.import_edges(parse.imports(parsed), files)
    rows = rollup.health(parsed, dataflow.findings(parsed), naming.naming_smells(parsed), graph.coupling_smells(graph.degrees(files, edges)), graph.cycles(edges))
    return rows.withColumnRenamed("project_id", "project")


@query("SELECT p_partkey AS part, CASE p_partkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' ELSE 'c' END AS language, CAST(CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 3 END * (p_size % 4 + 1) AS BIGINT) AS sloc, CAST(p_size % 4 + 1 AS BIGINT) AS functions FROM part")
def live_metrics(spark, d):
    files = corpus.mixed(spark, d)
    rows = parse.live_metrics(files, parse.parse_files(files, ["light_functions", "light_classes", "light_imports"]))
    return rows.select(F.col("file_ord").alias("part"), "language", "sloc", "functions")


@query("SELECT p_partkey AS part, CASE WHEN p_size % 5 = 4 THEN 2 ELSE 3 END AS priority FROM part WHERE p_size % 5 >= 2")
def wasm_hints(spark, d):
    return parse.wasm_hints(_functions(corpus.loops(spark, d))).select(F.col("file_ord").alias("part"), "priority")


@query("SELECT s_suppkey AS supplier, CAST(2 + CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS sloc, CAST(2 + CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS lloc FROM supplier")
def raw_metrics(spark, d):
    files = corpus.unused(spark, d)
    rows = parse.metrics(files, parse.parse_files(files, parse.METRIC_FACTS))
    return rows.select(F.col("file_ord").alias("supplier"), "sloc", "lloc")


# a file of branches(): 3 lines, and two for each if
HALSTEAD = """WITH f AS (SELECT p_partkey AS k, p_size % 7 AS n, p_partkey % 2 = 0 AS even FROM part),
h AS (SELECT k, n, 2 + 2 * n AS sloc, CASE WHEN even THEN 2 ELSE 1 END * n + 1 AS cc,
-- operators: def, return, and if, = and "and"; operands: the name, first, and second, total, 1
2 + CASE WHEN n > 0 THEN 2 + CASE WHEN even THEN 1 ELSE 0 END ELSE 0 END AS n1, 2 + CASE WHEN n > 0 THEN 2 + CASE WHEN even THEN 1 ELSE 0 END ELSE 0 END AS n2,
2 + n * (2 + CASE WHEN even THEN 1 ELSE 0 END) AS t1, 2 + n * (3 + CASE WHEN even THEN 1 ELSE 0 END) AS t2 FROM f),
v AS (SELECT *, (t1 + t2) * log2(n1 + n2) AS volume, n1 / 2 * t2 / n2 AS difficulty FROM h)"""


@query(HALSTEAD + " SELECT k AS part, round(volume, 3) AS volume, round(difficulty, 3) AS difficulty, round(greatest(0, least(100, (171 - 5.2 * ln(volume) - 0.23 * cc - 16.2 * ln(sloc)) * 100 / 171)), 2) AS mi FROM v")
def maintainability(spark, d):
    files = corpus.branches(spark, d)
    rows = parse.metrics(files, parse.parse_files(files, parse.METRIC_FACTS))
    return rows.select(F.col("file_ord").alias("part"), F.round("volume", 3).alias("volume"), F.round("difficulty", 3).alias("difficulty"), "mi")


CARD = """WITH r AS (SELECT p_partkey AS k, p_partkey % 6 AS i FROM part)
SELECT k AS part, '`def f_' || k || '(blob, cursor)`' || chr(10) || chr(10) || 'time O(1), space O(1), complexity 1 (simple), ' || CASE i WHEN 3 THEN 2 WHEN 5 THEN 4 ELSE 3 END || ' lines'
|| CASE WHEN i < 4 THEN chr(10) || chr(10) || CASE i WHEN 0 THEN 'CWE-89 SQL Injection' WHEN 1 THEN 'CWE-78 Command Injection' WHEN 2 THEN 'CWE-22 Path Traversal' ELSE 'CWE-502 Insecure Deserialization' END ELSE '' END AS card FROM r"""


@query(CARD)
def hover_cards(spark, d):
    parsed = parse.parse_files(corpus.risky(spark, d), ["functions", *dataflow.FACTS])
    return symbols.hover_cards(parse.functions(parsed), dataflow.findings(parsed)).select(F.col("file_ord").alias("part"), "card")


STAGE_NAMES = ", ".join(f"'{name}'" for name, _ in ml.STAGES)


@query(f"SELECT s_suppkey AS supplier, [{STAGE_NAMES}][s_suppkey % {len(ml.STAGES)} + 1] AS stage, s_suppkey % 3 + 1 AS line, 2 AS count FROM supplier")
def ml_stages(spark, d):
    return ml.pipeline(corpus.staged(spark, d)).select(F.col("file_ord").alias("supplier"), "stage", "line", "count")


@query("""WITH s AS (SELECT s_suppkey AS k FROM supplier) SELECT k AS supplier, 'run_' || k AS name, 'function' AS kind, 2 AS line FROM s UNION ALL SELECT k, 'Box_' || k, 'class', 3 FROM s
UNION ALL SELECT k, 'Like_' || k, 'interface', 4 FROM s UNION ALL SELECT k, 'Of_' || k, 'type', 5 FROM s""")
def ts_definitions(spark, d):
    rows = symbols.symbols(parse.parse_files(corpus.typed(spark, d), ["symbols"])).where("kind <> 'import'")
    return rows.select(F.col("file_ord").alias("supplier"), "name", "kind", "line")


@query("""WITH s AS (SELECT s_suppkey AS k FROM supplier) SELECT k AS supplier, 2 AS line, 0 AS col, 'definition' AS kind FROM s UNION ALL SELECT k, 2, 16, 'use' FROM s UNION ALL SELECT k, 6, 0, 'use' FROM s""")
def ts_references(spark, d):
    rows = symbols.references(parse.parse_files(corpus.typed(spark, d), ["refs"])).where(F.col("name").startswith("run_"))
    return rows.select(F.col("file_ord").alias("supplier"), "line", "col", "kind")


@query("SELECT s_suppkey AS supplier, unnest(['Like_' || s_suppkey, 'tools']) AS label, unnest([4, 3]) AS rank FROM supplier")
def ts_completions(spark, d):
    parsed = parse.parse_files(corpus.typed(spark, d), ["symbols"])
    rows = symbols.completions(parsed, "li").unionByName(symbols.completions(parsed, "TOO"))
    return rows.select(F.col("file_ord").alias("supplier"), "label", F.col("rank").cast("int").alias("rank"))


@query("SELECT s_suppkey AS supplier, './lib/tools' AS module, 1 AS line FROM supplier WHERE s_suppkey % 2 = 0")
def unused_modules(spark, d):
    return parse.unused_modules(parse.parse_files(corpus.typed(spark, d), ["unused_modules"])).select(F.col("file_ord").alias("supplier"), "module", "line")


@query("SELECT s_suppkey AS supplier, 'word_' || s_suppkey % 3 AS name, unnest([1, 2]) AS line, unnest([0, 4]) AS col, 'use' AS kind FROM supplier")
def references_without_tree(spark, d):
    return symbols.references(parse.parse_files(corpus.broken(spark, d), ["refs"])).select(F.col("file_ord").alias("supplier"), "name", "line", "col", "kind")


@query("SELECT s_suppkey AS supplier, 'E999' AS code, 2 AS line, 5 AS col FROM supplier WHERE s_suppkey % 3 = 0")
def json_errors(spark, d):
    return lint.json_errors(corpus.settings(spark, d)).select(F.col("file_ord").alias("supplier"), "code", "line", "col")


@query(RINGS + "SELECT 'b' || p AS project, count(DISTINCT r) AS cycles, count(DISTINCT path) AS files FROM (SELECT p, r, unnest(nodes) AS path FROM c WHERE r <= 20) GROUP BY 1")
def cycle_summary(spark, d):
    return graph.cycle_summary(_cycles(spark, d)).select(F.col("project_id").alias("project"), "cycles", "files")


@query(f"WITH f AS (SELECT {LABEL} AS big_o, count(*) AS n FROM part GROUP BY 1) SELECT big_o, n AS functions, CASE big_o WHEN 'O(1)' THEN 0 WHEN 'O(n)' THEN 2 WHEN 'O(n²)' THEN 4 WHEN 'O(n³)' THEN 5 ELSE -1 END AS rank, round(100 * n / max(n) OVER ())::BIGINT AS bar, CASE big_o WHEN 'O(1)' THEN '#00f5a0' WHEN 'O(n)' THEN '#ffb627' WHEN 'O(n²)' THEN '#ff3366' WHEN 'O(n³)' THEN '#ff3366' ELSE '#4a5880' END AS colour FROM f")
def bigo_bars(spark, d):
    rows = rollup.big_o_bars(rollup.big_o_distribution(_functions(corpus.loops(spark, d))))
    return rows.select("big_o", "functions", F.col("rank").cast("int").alias("rank"), "bar", "colour")


@query("""WITH h AS (SELECT p_partkey AS k, CASE WHEN p_size % 5 = 4 THEN 2 ELSE 3 END AS priority FROM part WHERE p_size % 5 >= 2)
SELECT k AS part, priority, CASE WHEN p_size % 5 = 4 THEN ['cyclomatic complexity 5'] WHEN p_size % 5 = 3 THEN ['time O(n³)'] ELSE ['time O(n²)'] END AS reasons, CASE WHEN p_size % 5 = 4 THEN '1.5-3x' WHEN p_size % 5 = 3 THEN '10-100x' ELSE '5-30x' END AS speedup FROM h JOIN part ON p_partkey = k""")
def native_hints(spark, d):
    files = corpus.loops(spark, d)
    return parse.ordered_hints(parse.wasm_hints(_functions(files), files)).select(F.col("file_ord").alias("part"), "priority", "reasons", "speedup")


@query("SELECT count(*) AS hints, 0::BIGINT AS critical, count(*) AS candidates FROM part WHERE p_size % 5 >= 2")
def hint_summary(spark, d):
    return parse.hint_summary(parse.wasm_hints(_functions(corpus.loops(spark, d)))).drop("project_id")


@query("SELECT 'log' || user_id % 10 AS name, event_id AS line_no, level FROM (SELECT *, 'error' AS level FROM (SELECT user_id, event_id FROM events WHERE event_type = 'error' ORDER BY 'log' || user_id % 10, event_id LIMIT 100) UNION ALL SELECT *, 'warning' FROM (SELECT user_id, event_id FROM events WHERE event_type = 'purchase' ORDER BY 'log' || user_id % 10, event_id LIMIT 100))")
def log_problems(spark, d):
    rows = corpus.logs(spark, d).select("name", F.col("event_id").alias("line_no"), "line", logs.level_of(F.col("line")).alias("level"))
    return logs.problems(rows).select("name", "line_no", "level")


@query("""SELECT s_suppkey AS supplier, kind, CASE kind WHEN 'single_letter_name' THEN 'Low' WHEN 'inconsistent_casing' THEN 'Medium' ELSE 'High' END AS severity, CASE kind WHEN 'shadowed_name' THEN 0 WHEN 'inconsistent_casing' THEN 1 ELSE 2 END AS rank
FROM (SELECT s_suppkey, 'single_letter_name' AS kind FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 'inconsistent_casing' FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, 'shadowed_name' FROM supplier WHERE s_suppkey % 5 = 0)""")
def smell_severities(spark, d):
    rows = naming.naming_smells(parse.parse_files(corpus.names(spark, d), naming.FACTS))
    return rows.select(F.col("file_ord").alias("supplier"), "kind", labels.smell_severity(F.col("kind")).alias("severity"), labels.kind_rank(F.col("kind")).alias("rank"))


@query("SELECT s_suppkey AS supplier, CASE s_suppkey % 6 WHEN 0 THEN 'php' WHEN 1 THEN 'ruby' WHEN 2 THEN 'sql' WHEN 3 THEN 'yaml' WHEN 4 THEN 'plaintext' ELSE 'python' END AS language, CASE s_suppkey % 6 WHEN 5 THEN 'python' END AS parser FROM supplier")
def language_labels(spark, d):
    s = corpus.table(spark, d, "supplier")
    path = F.concat(F.lit("a/b."), F.get(F.array(*map(F.lit, ("php", "rb", "sql", "YAML", "pyw", "py"))), (F.col("s_suppkey") % 6).cast("int")))
    return s.select(F.col("s_suppkey").alias("supplier"), text.language(path).alias("language"), text.parser_of(path).alias("parser"))


@query("SELECT (SELECT count(*) FROM supplier) AS files, count(*) AS issues, count(*) FILTER (code = 'TS003') AS errors, count(*) FILTER (code IN ('TS004', 'TS005', 'E501')) AS warnings, (SELECT count(*) FROM events) AS apis, (SELECT count(*) FROM events WHERE event_type NOT IN ('error', 'purchase')) AS apis_ok FROM (" + SCRIPT_LINT + ")")
def run_summary(spark, d):
    files = corpus.scripts(spark, d)
    return lint.run_summary(files, lint.script_lint(files), corpus.probes(spark, d).withColumn("status", logs.probe_status(F.col("code"), F.col("error"))))


@query("SELECT count(*) AS lines, count(DISTINCT (conv_id, turn)) AS files FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS x FROM conversations) WHERE contains(lower(x), 'the')")
def grep_total(spark, d):
    c = corpus.table(spark, d, "conversations")
    files = c.select(F.col("conv_id").cast("string").alias("project_id"), F.col("turn").alias("file_ord"), F.lit("x").alias("path"), F.col("text").alias("content"))
    return search.grep_total(search.grep(files, "the"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bigo_distribution(spark, sf_dir)


DOCUMENTED = "d AS (SELECT s_suppkey AS k, s_suppkey % 5 + 1 AS multi, s_suppkey % 4 AS comments, s_suppkey % 3 AS blank, s_suppkey % 7 + 1 AS n FROM supplier)"


@query(f"WITH {DOCUMENTED} SELECT k AS supplier, 1 + multi + comments + blank + n AS loc, 1 + n AS sloc, comments, blank, multi, 1 + n AS lloc FROM d")
def line_counts(spark, d):
    files = corpus.documented(spark, d)
    return parse.metrics(files, parse.parse_files(files, parse.METRIC_FACTS)).select(F.col("file_ord").alias("supplier"), "loc", "sloc", "comments", "blank", "multi", "lloc")


# operators: = and binop; operands: the text, total twice, 1
@query(f"""WITH {DOCUMENTED}, h AS (SELECT k, 1 + n AS sloc, comments + multi AS notes, 2 AS n1, 3 AS n2, 2 * n AS t1, 1 + 3 * n AS t2 FROM d), v AS (SELECT *, (t1 + t2) * log2(n1 + n2) AS volume FROM h)
SELECT k AS supplier, n1 AS distinct_operators, n2 AS distinct_operands, t1 AS total_operators, t2 AS total_operands, round(volume, 3) AS volume,
round(greatest(0, least(100, (171 - 5.2 * ln(volume) - 16.2 * ln(sloc) + 50 * sin(sqrt(2.4 * notes / sloc * 100))) * 100 / 171)), 2) AS mi FROM v""")
def commented_maintainability(spark, d):
    files = corpus.documented(spark, d)
    rows = parse.metrics(files, parse.parse_files(files, parse.METRIC_FACTS))
    return rows.select(F.col("file_ord").alias("supplier"), "distinct_operators", "distinct_operands", "total_operators", "total_operands", F.round("volume", 3).alias("volume"), "mi")


@query("SELECT p_partkey AS part, 'level_' || p_size AS name, 2 * p_size - 1 AS line, '''total'' hides a name of an outer scope' AS message FROM part WHERE p_partkey % 2 = 0 AND p_size > 1")
def deep_shadowing(spark, d):
    rows = naming.naming_smells(parse.parse_files(corpus.nested_scopes(spark, d), naming.FACTS))
    return rows.where("kind = 'shadowed_name'").select(F.col("file_ord").alias("part"), "name", "line", "message")


@query("""SELECT s_suppkey AS supplier, 'single_letter_name' AS kind, 'q' AS name, 2 AS line, 'one-letter variable ''q'' outside a loop or comprehension' AS message FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT s_suppkey, 'inconsistent_casing', 'file', 1, 'snake_case (total_count) beside camelCase (otherCount)' FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT s_suppkey, 'shadowed_name', 'inner', 4 + CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END, '''total_count'' hides a name of an outer scope' FROM supplier WHERE s_suppkey % 5 = 0""")
def naming_messages(spark, d):
    rows = naming.naming_smells(parse.parse_files(corpus.names(spark, d), naming.FACTS))
    return rows.select(F.col("file_ord").alias("supplier"), "kind", "name", "line", "message")


@query("SELECT p_partkey AS part, 'CWE-78' AS cwe, 'stdin (input())' AS source, 'os.system(...)' AS sink, p_size + 3 AS line, 'run' AS function FROM part WHERE p_partkey % 3 <> 0")
def taint_chains(spark, d):
    return dataflow.findings(parse.parse_files(corpus.chains(spark, d), dataflow.FACTS)).select(F.col("file_ord").alias("part"), "cwe", "source", "sink", "line", "function")


@query("""WITH s AS (SELECT count(*) FILTER (p_partkey % 6 < 4) AS high FROM part), m AS (SELECT count(*) FILTER (s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0) AS medium FROM supplier)
SELECT high, medium, 0::BIGINT AS low, round(high * 100 / (high + medium))::BIGINT AS high_percent FROM s, m""")
def severity_mix(spark, d):
    files = corpus.risky(spark, d).unionByName(corpus.secrets(spark, d).withColumn("file_ord", -F.col("file_ord") - 1))
    return rollup.severity_counts(dataflow.findings(parse.parse_files(files, dataflow.FACTS))).select("high", "medium", "low", "high_percent")


ONE_RING = """WITH RECURSIVE n AS (SELECT s_suppkey AS k, s_suppkey % 7 AS i FROM supplier),
e AS (SELECT DISTINCT a.k AS src, b.k AS dst FROM n a JOIN n b ON b.k = CASE WHEN a.i = 6 THEN a.k - 6 ELSE a.k + 1 END OR (a.i = 3 AND a.k // 7 % 3 = 0 AND b.k = a.k - 3) OR (a.i = 0 AND b.k = a.k + 7)),
w AS (SELECT [src, dst] AS p FROM e WHERE src < dst UNION ALL SELECT list_append(p, e.dst) FROM w JOIN e ON e.src = p[-1] WHERE e.dst > p[1] AND NOT list_contains(p, e.dst) AND len(p) < 8 AND e.dst // 7 = p[1] // 7),
c AS (SELECT list_transform(p, lambda k: 'o_' || k || '.py') AS nodes FROM w JOIN e ON e.src = p[-1] AND e.dst = p[1]),
t AS (SELECT CASE WHEN list_position(nodes, list_min(nodes)) = 1 THEN nodes ELSE nodes[list_position(nodes, list_min(nodes)) :] || nodes[: list_position(nodes, list_min(nodes)) - 1] END AS nodes FROM c),
r AS (SELECT nodes, row_number() OVER (ORDER BY len(nodes), nodes) AS cycle_id FROM t QUALIFY cycle_id <= 20)"""


def _one_ring(spark, d):
    files = corpus.one_ring(spark, d)
    edges = graph.import_edges(parse.imports(parse.parse_files(files, ["imports"])), files)
    return files, edges, graph.cycles(edges)


@query(ONE_RING + " SELECT cycle_id, len(nodes) AS length, array_to_string(nodes, ' ') AS nodes FROM r")
def project_cycles(spark, d):
    return _one_ring(spark, d)[2].select("cycle_id", F.col("length").cast("long").alias("length"), F.array_join("nodes", " ").alias("nodes"))


@query(ONE_RING + """, m AS (SELECT x, list(cycle_id ORDER BY cycle_id) AS ids FROM (SELECT unnest(nodes) AS x, cycle_id FROM r) GROUP BY x),
f AS (SELECT DISTINCT nodes[j] AS src, nodes[j % len(nodes) + 1] AS dst FROM (SELECT nodes, unnest(range(1, len(nodes) + 1)) AS j FROM r))
SELECT 'o_' || k || '.py' AS a, NULL AS b, ids IS NOT NULL AS flag, array_to_string(coalesce(ids, []), ' ') AS cycles FROM n LEFT JOIN m ON x = 'o_' || k || '.py'
UNION ALL SELECT 'o_' || e.src || '.py', 'o_' || e.dst || '.py', f.src IS NOT NULL, '' FROM e LEFT JOIN f ON f.src = 'o_' || e.src || '.py' AND f.dst = 'o_' || e.dst || '.py'""")
def cycle_flags(spark, d):
    files, edges, found = _one_ring(spark, d)
    nodes, marked = graph.with_cycle_flags(files.select("project_id", "path"), edges, found)
    own = nodes.select(F.col("path").alias("a"), F.lit(None).cast("string").alias("b"), F.col("in_cycle").alias("flag"), F.array_join(F.col("cycles").cast("array<string>"), " ").alias("cycles"))
    return own.unionByName(marked.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("is_cycle").alias("flag"), F.lit("").alias("cycles")))


def _positioned(rows: DataFrame) -> DataFrame:
    """Rows with their place in the order that an operator gives, from 1: the place in a task's part and the sizes of the parts before; no task gets all rows."""
    number = F.monotonically_increasing_id()
    kept = Steps(rows.sparkSession, "positions").keep(rows.withColumns({"__part": F.shiftright(number, 33), "__at": number.bitwiseAND((1 << 33) - 1)}))
    # a row a part
    sizes = kept.groupBy("__part").agg(F.count("*").alias("n"))
    before = sizes.select("__part", (F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("__before"))
    return kept.join(F.broadcast(before), "__part").withColumn("position", F.col("__before") + F.col("__at") + 1)


@query(f"WITH f AS (SELECT p_partkey AS part, {CC} AS complexity FROM part) SELECT part, row_number() OVER (ORDER BY CASE WHEN complexity > 20 THEN 0 WHEN complexity > 5 THEN 1 ELSE 3 END, complexity DESC, part) AS position FROM f")
def heatmap_order(spark, d):
    return _positioned(graph.ordered_heatmap(graph.heatmap(_functions(corpus.branches(spark, d))))).select(F.col("file_ord").alias("part"), "position")


@query("SELECT p_partkey AS part, row_number() OVER (ORDER BY p_partkey) AS position FROM part WHERE p_size % 5 >= 2")
def hints_order(spark, d):
    files = corpus.loops(spark, d)
    return _positioned(parse.ordered_hints(parse.wasm_hints(_functions(files), files))).select(F.col("file_ord").alias("part"), "position")


@query("""WITH l AS (SELECT CASE p_partkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' ELSE 'c' END AS language,
sum(CASE p_partkey % 3 WHEN 0 THEN 3 * (p_size % 4 + 1) - 1 ELSE 4 * (p_size % 4 + 1) - 1 END) AS loc FROM part GROUP BY 1) SELECT language, row_number() OVER (ORDER BY loc DESC, language) AS position FROM l""")
def languages_order(spark, d):
    files = corpus.mixed(spark, d)
    return _positioned(rollup.languages_by_lines(rollup.language_distribution(files, parse.parse_files(files, ["functions"])))).select("language", "position")


@query(TREE + " SELECT path, row_number() OVER (ORDER BY parent, is_file, lower(name), name) AS position FROM (SELECT DISTINCT path, CASE WHEN depth = 1 THEN '' ELSE path[: len(path) - len(name) - 1] END AS parent, name, is_file FROM x)")
def tree_order(spark, d):
    pages = corpus.table(spark, d, "pages")
    files = pages.select(F.lit("p").alias("project_id"), F.col("page_id").alias("file_ord"), F.regexp_replace("url", "^https?://", "").alias("path"), F.col("html").alias("content"))
    return _positioned(tree.ordered_tree(tree.tree(files))).select("path", "position")


@query("WITH l AS (SELECT s_suppkey AS k, unnest(['helper(x)', 'leaf(x)', 'main(x)']) AS label FROM supplier) SELECT k AS supplier, label, row_number() OVER (ORDER BY 'p' || k, label) AS position FROM l")
def completions_order(spark, d):
    rows = symbols.ordered_completions(symbols.completions(parse.parse_files(corpus.calls(spark, d), ["symbols"])))
    return _positioned(rows).select(F.col("file_ord").alias("supplier"), "label", "position")


@query("WITH s AS (SELECT s_suppkey AS k, unnest([2, 2, 6]) AS line, unnest([0, 16, 0]) AS col FROM supplier) SELECT k AS supplier, line, col, row_number() OVER (ORDER BY k, line, col) AS position FROM s")
def references_order(spark, d):
    files = corpus.typed(spark, d)
    rows = symbols.references(parse.parse_files(files, ["refs"])).where(F.col("name").startswith("run_"))
    return _positioned(symbols.ordered_references(rows, files)).select(F.col("file_ord").alias("supplier"), "line", "col", "position")


@query("SELECT s_suppkey AS supplier, s_suppkey % 3 + 1 AS line, row_number() OVER (ORDER BY s_suppkey) AS position FROM supplier")
def pipeline_order(spark, d):
    return _positioned(ml.ordered_pipeline(ml.pipeline(corpus.staged(spark, d)))).select(F.col("file_ord").alias("supplier"), "line", "position")


@query("SELECT s_suppkey AS supplier, 'main' AS caller, 'helper' AS callee, 'c_' || s_suppkey || '.py' AS callee_path FROM supplier UNION ALL SELECT s_suppkey, 'helper', 'leaf', 'c_' || s_suppkey || '.py' FROM supplier WHERE s_suppkey % 2 = 0")
def call_targets(spark, d):
    return graph.call_graph(_functions(corpus.calls(spark, d))).select(F.col("file_ord").alias("supplier"), "caller", "callee", "callee_path")


@query("""SELECT event_id AS seq, '/u/' || user_id AS url, array_to_string(list(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), ' ') AS ring FROM events""")
def probe_histories(spark, d):
    return logs.histories(corpus.probes(spark, d)).select("seq", "url", F.array_join(F.transform("ring", lambda x: x["seq"].cast("string")), " ").alias("ring"))


@query("""WITH f AS (SELECT p_partkey AS part, p_size % 25 AS called, p_partkey % 25 AS given, p_partkey % 4 + 1 AS line, p_size FROM part)
SELECT part, n_name AS name, 'call' AS kind, line, 2 AS count, NULL AS value, n_regionkey AS region FROM f JOIN nation ON n_nationkey = called
UNION ALL SELECT part, n_name, 'set', line + 2, 1, p_size, n_regionkey FROM f JOIN nation ON n_nationkey = given""")
def pattern_rows(spark, d):
    found = patterns.scan(corpus.worded(spark, d), corpus.nation_patterns(spark, d))
    return found.select(F.col("file_ord").alias("part"), "name", "kind", "line", "count", "value", F.col("attributes")["region"].cast("int").alias("region"))


@query("""WITH f AS (SELECT p_partkey AS part, p_size % 25 AS called, p_partkey % 25 AS given FROM part)
SELECT part, n_name AS rule, 'warning' AS severity FROM f JOIN nation ON n_nationkey = called WHERE called <> given
UNION ALL SELECT part, 'late_' || n_name, 'error' FROM f JOIN nation ON n_nationkey = given AND called = (given + 1) % 25""")
def rule_rows(spark, d):
    """Rules from a table: a call of a function that is never set, and a call before the next function's name is set."""
    word = lambda n: F.concat(F.lit("term_"), (n % 25).cast("string"))
    k, none = F.col("n_nationkey").cast("int"), F.lit(None).cast("array<string>")
    call, assigned = (lambda n: F.concat(F.lit(r"\b"), word(n), F.lit(r"\("))), (lambda n: F.concat(F.lit(r"\b"), word(n), F.lit(" =")))

    def row(rule, severity, has, lacks, first, second):
        own = {"ord": k, "rule": rule, "severity": F.lit(severity), "category": F.lit("own"), "words": F.array(word(k)), "libraries": none, "modules": none, "has": has, "lacks": lacks}
        end = {"counted": F.lit(None).cast("string"), "at_least": F.lit(None).cast("int"), "at_most": F.lit(None).cast("int"), "first": first, "second": second}
        return F.struct(*[c.alias(n) for n, c in (own | end).items()])

    missing = F.lit(None).cast("string")
    both = F.array(row(F.col("n_name"), "warning", F.array(call(k)), F.array(assigned(k)), missing, missing), row(F.concat(F.lit("late_"), "n_name"), "error", none, none, call(k + 1), assigned(k)))
    rules = corpus.table(spark, d, "nation").select(F.explode(both).alias("x")).select("x.*")
    files = corpus.worded(spark, d).withColumns({"libraries": none, "modules": none})
    return patterns.violations(files, rules).select(F.col("file_ord").alias("part"), "rule", "severity")


@query("SELECT p_partkey AS part, 'a' || p_partkey // 4096 AS project, (p_size % 4 + 1) * 26 - 1 AS bytes FROM part WHERE p_partkey % 3 = 0 AND p_partkey // 4096 IN (0, 2)")
def zip_members(spark, d):
    """Files packed into archives and read back: two projects' Python members. The filters reach the archives' listing and the members' names."""
    steps = Steps(spark, "zips")
    files = corpus.mixed(spark, d).withColumn("project_id", F.concat(F.lit("a"), F.floor(F.col("file_ord") / 4096).cast("string")))
    steps.keep(zips.pack(files, f"{steps.path}/archives"))
    rows = zips.read(spark, f"{steps.path}/archives").where(F.col("project_id").isin("a0", "a2") & (F.col("suffix") == ".py") & (F.col("status") == "extracted"))
    return rows.select(F.regexp_extract("path", r"f_(\d+)", 1).cast("long").alias("part"), F.col("project_id").alias("project"), "bytes")


@query("""WITH f AS (SELECT p_partkey AS part, p_partkey % 7 AS project FROM part)
SELECT part, 's' || project AS project, CASE WHEN project = 1 OR part % 2 = 0 THEN 'second' ELSE 'first' END AS version FROM f
WHERE project <> 3 AND (project <> 1 OR part % 2 = 0)
UNION ALL SELECT part, 's3', 'third' FROM f WHERE project = 3 AND part % 5 = 0""")
def stored_projects(spark, d):
    """A store after an upload of all, an update of the even keys, one project replaced, one emptied and filled anew, with a compaction in between."""
    steps = Steps(spark, "store")
    kept = Store(spark, f"{steps.path}/store")
    files = corpus.branches(spark, d).withColumn("project_id", F.concat(F.lit("s"), (F.col("file_ord") % 7).cast("string")))
    version = lambda rows, v: rows.withColumn("content", F.lit(v))
    even = files.where("file_ord % 2 = 0")
    kept.save(version(files, "first"))
    kept.save(version(even, "second"))
    kept.compact()
    kept.delete("s3")
    kept.save(version(even.where("project_id = 's1'"), "second"), replace=True)
    kept.save(version(files.where("project_id = 's3' and file_ord % 5 = 0"), "third"))
    return kept.load().select(F.col("file_ord").alias("part"), F.col("project_id").alias("project"), F.col("content").alias("version"))


@query("""WITH e AS (SELECT DISTINCT user_id, epoch_ms(ts) AS ms, event_id AS seq, event_type AS content FROM events),
f AS (SELECT *, lead(ms) OVER (PARTITION BY user_id ORDER BY ms, seq) AS following FROM e), w(wait) AS (VALUES (600000), (7200000))
SELECT 'u' || user_id AS file, wait, ms AS "at", seq, content FROM f, w WHERE following IS NULL OR following - ms >= wait""")
def edit_pauses(spark, d):
    """Events as edits of their user's file: after which of them the file rests for ten minutes, and for two hours."""
    # the nearest millisecond, halves away from zero, as SQL's epoch_ms has it
    utc = F.timestamp_millis(F.expr("round(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts), -3) div 1000"))
    e = corpus.table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), utc.alias("ts"), F.col("event_id").alias("seq"), F.col("event_type").alias("content"))
    return streams.paused_batch(e, (600_000, 7_200_000))


@query("""WITH f AS (SELECT s_suppkey AS k, 's' || s_suppkey // 8 AS project FROM supplier),
i AS (SELECT project, k, 'C001' AS code, unnest([1, 3, 5]) AS line FROM f UNION ALL SELECT project, k, 'C002', 6 FROM f)
SELECT project, 't_' || k || '.py' AS path, code, line, row_number() OVER (PARTITION BY project, code ORDER BY k, line) AS nth, NULL AS total FROM i
UNION ALL SELECT project, NULL, code, NULL, NULL, count(*) FROM i GROUP BY ALL""")
def lint_of_tables(spark, d):
    """SQL's form of the lint: a table function over projects, with state across the files of each."""
    tables.register(spark)
    files = corpus.calls(spark, d).withColumns({"project_id": F.concat(F.lit("s"), F.floor(F.col("file_ord") / 8).cast("string")), "path": F.concat(F.lit("t_"), F.col("file_ord").cast("string"), F.lit(".py"))})
    return spark.sql("SELECT project_id AS project, path, code, line, nth, total FROM code_lint_of(TABLE(SELECT * FROM {files}) PARTITION BY (project_id) ORDER BY (file_ord), 'project_id')", files=files)


HINTS = """f AS (SELECT p_partkey AS k, p_size % 5 AS n FROM part),
h AS (SELECT k AS part, 'f_' || k AS name, CASE WHEN n = 4 THEN 2 ELSE 3 END AS priority,
CASE WHEN k % 3 = 0 THEN 'add cdef with C types to f_' || k WHEN n < 4 THEN 'type it in Cython, vectorise it with NumPy, or compile it with Emscripten: f_' || k ELSE 'declare it with cdef in a .pyx file: f_' || k END AS recommendation FROM f WHERE n >= 2
UNION ALL SELECT k, '<module>', 5, 'give the bindings types' FROM f WHERE k % 4 = 0)"""


def _native_hints(spark, d):
    files = corpus.native(spark, d)
    return parse.wasm_hints(_functions(files), files).withColumnRenamed("file_ord", "part")


@query(f"WITH {HINTS} SELECT part, name, priority, recommendation FROM h")
def module_hints(spark, d):
    return _native_hints(spark, d).select("part", "name", "priority", "recommendation")


@query(f"WITH {HINTS} SELECT part, name FROM h WHERE priority >= 4")
def critical_hints(spark, d):
    return parse.critical_hints(_native_hints(spark, d)).select("part", "name")


@query("""SELECT s_suppkey AS supplier, 'numpy' AS module, 'NumPy' AS library, 'datos' AS category FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT s_suppkey, 'polars', 'Polars', 'dados' FROM supplier WHERE s_suppkey % 3 = 0""")
def libraries_by_text(spark, d):
    return ml.libraries_by_text(corpus.noted(spark, d)).select(F.col("file_ord").alias("supplier"), "module", "library", "category")


@query("SELECT s_suppkey AS supplier, 'pyodide' AS environment FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT s_suppkey, 'starboard' FROM supplier WHERE s_suppkey % 5 = 0")
def notebook_environments(spark, d):
    return ml.notebook_environments(corpus.noted(spark, d)).select(F.col("file_ord").alias("supplier"), "environment")
