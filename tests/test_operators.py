"""Operators over small source trees, and the column functions they are made of."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.functions import labels, tables, text
from lodestone.operators import graph, lint, logs, ml, parse, render, rollup, search, symbols, tree
from lodestone.plans.project import GRAPHS, Project, analyse_logs, stored
from lodestone.sources import files as source
from lodestone.sources import probes


def project(spark, files):
    return source.inline(spark, "p", [{"filename": k, "content": v} for k, v in files.items()])


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'boolean' if isinstance(v, bool) else 'double' if isinstance(v, float) else 'int'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize("value", ["", "a", "a\n", "a\r\nb", "a\n\nb\n", "a\x0bb\x85c\u2028d", "\n", "\r"])
def test_py_lines(spark, value):
    assert one(spark, text.py_lines(F.col("s")), s=value) == value.splitlines()


@pytest.mark.parametrize(("path", "label", "parser"), [("a/b.py", "python", "python"), ("x.h", "c", "cpp"), ("x.tsx", "typescript", "typescript"), ("Makefile", "plaintext", None), (".env", "plaintext", None)])
def test_languages(spark, path, label, parser):
    assert one(spark, text.language(F.col("s")), s=path) == label
    assert one(spark, text.parser_of(F.col("s")), s=path) == parser


@pytest.mark.parametrize(("a", "c", "inside"), [(2, 1, "n log n"), (1, 0, "log n"), (2, 0, "n"), (3, 1, "n^1.585"), (4, 1, "n^2"), (2, 2, "n^2"), (8, 3, "n^3 log n")])
def test_master_theorem(spark, a, c, inside):
    assert one(spark, labels.master_theorem(F.col("a"), F.col("c"))[1], a=a, c=c) == inside


@pytest.mark.parametrize(("label", "degree"), [("O(1)", 0), ("O(n log n)", 1), ("O(n²)", 2), ("O(n^5)", 5), ("O(2^n)", None), ("O(log n)", None)])
def test_degree(spark, label, degree):
    assert one(spark, labels.degree_of(F.col("s")), s=label) == degree


@pytest.mark.parametrize(("value", "hidden"), [("", True), ("changeme", True), ("xxx", True), ("xx", False), ("your-key", True), ("<a>", True), ("{{a}}", True), ("${A}", True), ("abc", False)])
def test_placeholder(spark, value, hidden):
    assert one(spark, text.is_placeholder(F.col("s")), s=value) is hidden


@pytest.mark.parametrize(("n", "said"), [(0, "0.0 B"), (1024, "1.0 KB"), (1536, "1.5 KB"), (5 << 20, "5.0 MB")])
def test_human_size(spark, n, said):
    assert one(spark, text.human_size(F.col("n")), n=n) == said


@pytest.mark.parametrize(("line", "level"), [("FATAL x", "critical"), ("INFO Error: y", "error"), ("xWARNx", "warning"), ("INFO", "info"), ("info", None), ("", None)])
def test_levels(spark, line, level):
    assert one(spark, logs.level_of(F.col("s")), s=line) == level


def test_candidates(spark):
    found = one(spark, graph.candidates(F.col("m"), F.col("p")), m="./lib/x", p="web/a.ts")
    assert found[:3] == ["web/x.py", "web/x.ts", "web/x.js"] and "web/lib/x.ts" in found and found[-1] == "x/index.js" and len(found) == 13
    assert one(spark, graph.candidates(F.col("m"), F.col("p")), m="os.path", p="a.py")[0] == "path.py"


def test_import_graph(spark):
    p = Project(project(spark, {"a.py": "import b\nimport c\nimport b", "b.py": "import c", "c.py": "import os", "d.py": "x1 = 1", "e.py": "import c"}))
    edges = p.edges.persist()
    assert {(r.src, r.dst, r.line) for r in edges.collect()} == {("a.py", "b.py", 1), ("a.py", "c.py", 2), ("b.py", "c.py", 1), ("e.py", "c.py", 1)}
    nodes = {r.path: r for r in graph.degrees(p.files, edges).collect()}
    assert (nodes["c.py"].in_degree, nodes["c.py"].is_hub, nodes["d.py"].centrality, nodes["a.py"].instability) == (3, True, 0.0, 1.0)
    assert {(r.path, r.isolated) for r in graph.entry_points(p.files, edges).collect()} == {("a.py", False), ("d.py", True), ("e.py", False)}
    assert "a_py --> b_py" in p.graph("import")["diagram"].first().diagram
    p.release()


def test_cycles(spark):
    p = Project(project(spark, {"a.py": "import b", "b.py": "import c\nimport a", "c.py": "import a", "d.py": "import a"}))
    found = p.graph("circular")["cycles"].orderBy("cycle_id").collect()
    assert [r.nodes for r in found] == [["a.py", "b.py"], ["a.py", "b.py", "c.py"]]
    report = p.report()
    assert report["architecture"].count() == 2
    h = report["health"].first()
    assert (h.architecture, h.security, h.complexity) == (100 - 15 * 2 - 0, 100, 100)
    p.release()


def test_no_cycles_and_empty_project(spark):
    p = Project(project(spark, {"a.py": "import b", "b.py": ""}))
    assert p.graph("circular")["cycles"].count() == 0
    p.release()
    empty = Project(source.inline(spark, "p", []))
    assert all(t.count() == 0 for t in empty.report().values())
    empty.release()


def test_every_graph_and_report(spark):
    p = Project(project(spark, {"m.py": "def f(a):\n    for x in a:\n        for y in x: g(y)\n\ndef g(b):\n    return b\n", "t.ts": "console.log(1)\nvar a = 1", "bad.py": "def f(:", "x.md": "text"}))
    for kind in GRAPHS:
        for t in p.graph(kind).values():
            t.collect()
    with pytest.raises(ValueError):
        p.graph("other")
    report = {k: t.collect() for k, t in p.report().items()}
    assert {r.big_o for r in report["big_o"]} == {"O(n²)", "O(1)"}
    assert report["hints"][0].priority == 3
    assert {r.code for r in p.lint()["issues"].collect()} == {"C001", "E001", "TS001", "TS004"}
    assert p.tree().where("path = 'm.py'").first().functions == 2
    for t in (*p.symbols().values(), *p.inspect_ml().values(), p.lint()["locations"], p.lint()["summary"]):
        t.collect()
    p.release()


def test_recurrence_uses_callees(spark):
    code = "def merge(a):\n    for x in a: pass\n\ndef sort(a):\n    h = len(a) // 2\n    x1 = sort(a[:h])\n    y1 = sort(a[h:])\n    return merge(a)\n"
    p = Project(project(spark, {"m.py": code}))
    row = p.functions.where("name = 'sort'").first()
    assert (row.big_o, row.theta, row.recurrence) == ("O(n log n)", "Θ(n log n)", "T(n) = 2T(n/2) + Θ(n)")
    p.release()


def test_definitions_references_and_rename(spark):
    files = project(spark, {"m.py": "def f(a):\n    return a\n\nclass C:\n    def f(self):\n        return f(1)\n"})
    parsed = parse.parse_files(files)
    assert [(r.kind, r.line) for r in symbols.definitions(parsed, "f").collect()] == [("function", 1), ("method", 5)]
    assert {(r.line, r.kind) for r in symbols.references(parsed).where("name = 'f'").collect()} == {(1, "definition"), (5, "definition"), (6, "read")}
    assert lint.rename_edits(symbols.references(parsed), files, "f", "g").count() == 3
    with pytest.raises(ValueError):
        lint.rename_edits(symbols.references(parsed), files, "f", "2g")


def test_issue_merge_keeps_the_first_tool(spark):
    schema = "project_id string, file_ord long, path string, tool string, line int, code string, message string, seq int"
    a = spark.createDataFrame([("p", 0, "a", "pylint", 1, "X", "m" * 50, 0)], schema)
    b = spark.createDataFrame([("p", 0, "a", "ast", 1, "Y", "m" * 60, 0), ("p", 0, "a", "ast", 2, "Y", "m", 0)], schema)
    assert {(r.tool, r.line) for r in lint.merge_issues(a, b).collect()} == {("ast", 1), ("ast", 2)}
    assert lint.filter_issues(a.withColumn("severity", F.lit("error")), "error", "pylint", "MMM").count() == 1


def test_live_metrics(spark):
    files = project(spark, {"a.py": "import os\n# c\ndef f(x):\n    for y in x: pass\n", "b.py": "def f(:\nclass A", "c.js": "function f(a) {\n for (;;) { while (1) {} }\n}", "d.c": "int f(int a) { return 1; }", "e.py": ""})
    rows = {r.path: r for r in parse.live_metrics(files, parse.parse_files(files)).collect()}
    assert (rows["a.py"].big_o_worst, rows["a.py"].imports, rows["a.py"].sloc) == ("O(n)", 1, 3)
    assert (rows["b.py"].safe_mode, rows["b.py"].big_o_worst, rows["b.py"].classes) == (True, "?", 1)
    assert rows["c.js"].big_o_worst == "O(n²)" and rows["d.c"].functions == 1 and rows["e.py"].loc == 0


def test_maintainability(spark):
    files = project(spark, {"a.py": "total = 1 + 1\n", "b.py": "", "c.ts": "x"})
    rows = {r.path: r for r in parse.metrics(files, parse.parse_files(files)).collect()}
    assert rows["b.py"].mi is None and rows["a.py"].volume == 10.0 and 0 <= rows["a.py"].mi <= 100 and "c.ts" not in rows


def test_logs(spark):
    found = analyse_logs(spark.createDataFrame([("a", "INFO x\nERROR y\n\nWARN z\nCRITICAL"), ("b", None)], "name string, content string"))
    assert found["counts"].where("name = 'a'").first().asDict() == {"name": "a", "total_lines": 5, "critical": 1, "error": 1, "warning": 1, "info": 1}
    assert [r.line_no for r in found["errors"].collect()] == [2, 5]
    assert found["error_numbers"].first().error_lines == [2, 5]


def test_ml(spark):
    code = "import torch\nimport numpy as np\nfrom sklearn.preprocessing import StandardScaler\nx = StandardScaler().fit_transform(a)\nb = train_test_split(x)\nloss.backward()\nmodel = LSTM()\nbatch_size = 32\n"
    p = Project(project(spark, {"m.py": code, "empty.py": ""}))
    found = p.inspect_ml()
    assert {r.library for r in found["libraries"].collect()} == {"PyTorch", "NumPy", "Scikit-learn"}
    rules = {r.rule for r in found["issues"].collect()}
    assert {"fit_before_split", "split_without_seed", "torch_without_seed", "numpy_without_seed", "backward_without_zero_grad"} <= rules
    assert found["metrics"].where("metric = 'batch_size'").first().value == 32.0
    assert found["score"].where("path = 'empty.py'").first().score == 100
    assert found["models"].first().model == "LSTM"
    text_only = project(spark, {"a.py": "import PYODIDE, numpy"})
    assert ml.notebook_environments(text_only).first().environment == "pyodide" and ml.libraries_by_text(text_only).first().library == "NumPy" and ml.scores_by_text(text_only).first().score == 50
    p.release()


def test_trees_and_retention(spark):
    files = project(spark, {"a/b/x.py": "12", "a/y.py": "1", "z.py": ""})
    rows = {r.path: r for r in tree.tree(files).collect()}
    assert set(rows) == {"a", "a/b", "a/b/x.py", "a/y.py", "z.py"} and (rows["a"].bytes, rows["a"].is_file, rows["a/b/x.py"].parent) == (3, False, "a/b")
    assert tree.project_info(files).first().asDict() == {"project_id": "p", "files": 3, "bytes": 3, "code_files": 3}
    kept = tree.retention(spark.createDataFrame([(str(k), k) for k in range(25)], "project_id string, mtime int"))
    assert kept.where("keep").count() == 20 and kept.where("not keep").agg(F.max("mtime")).first()[0] == 4


def test_search(spark):
    files = project(spark, {"a.py": "Foo\nfoo(\nbar"})
    assert search.grep(files, "foo").count() == 2 and search.grep(files, "foo", case=True).count() == 1 and search.grep(files, "^b.r$", regex=True).count() == 1
    with pytest.raises(ValueError):
        search.grep(files, "(", regex=True)
    assert search.grep_total(search.grep(files, "foo")).first().asDict() == {"lines": 2, "files": 1} and search.grep_counts(search.grep(files, "foo")).first().lines == 2
    assert search.grep_shown(search.grep(files, "o"), 1).first().more == 1
    assert search.outline_groups(search.outline(project(spark, {"a.ts": "export class A {}\nconst f = (x) => x"}))).count() == 2
    assert "+b" in search.diff(project(spark, {"x": "a", "y": "b"}), "x", "y").first().diff


def test_validation(spark):
    check = lambda path, body, err=None: {k: one(spark, c, p=path, s=body, e=err) for k, c in text.validation(F.col("p"), F.col("s"), F.col("e")).items()}
    assert check("a.py", "\0" * 5)["valid"] is False
    assert check("a.py", "def f(")["is_truncated"] is True
    assert check("a.ts", "{{}")["warnings"] == ["unbalanced braces (+1)"]
    assert check("a.py", "")["warnings"] == ["empty"]
    assert check("a.py", "x", "bad")["safe_mode"] is True


def test_zip_source(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in (("../a.py", "x = 1"), ("node_modules/b.py", "x"), ("c.exe", "x"), ("d/e.ts", "y")):
            z.writestr(name, body)
    rows = source.archives(spark.createDataFrame([("p", bytearray(out.getvalue())), ("q", bytearray(b"no")), ("r", None)], "project_id string, content binary"))
    summary = {r.project_id: r for r in source.archive_summary(rows).collect()}
    assert (summary["p"].extracted, summary["p"].skipped, summary["q"].errors, summary["r"].errors) == (2, 2, 1, 1)
    assert {r.path for r in source.from_archives(rows).collect()} == {"a.py", "d/e.ts"}


def test_folder_source_and_store(spark, tmp_path):
    (tmp_path / "src" / "venv").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_bytes(b"x = '\xff'")
    (tmp_path / "src" / "venv" / "b.py").write_text("x")
    (tmp_path / "src" / "c.py").write_text("  \n")
    (tmp_path / "src" / "d.txt").write_text("x")
    rows = source.folder(spark, str(tmp_path), "p")
    assert [(r.path, r.content) for r in rows.collect()] == [("src/a.py", "x = '�'")]
    store = f"file://{tmp_path}/store"
    source.save(rows, store)
    source.save(source.numbered(spark.createDataFrame([("p", "src/a.py", "x = 2")], "project_id string, path string, content string")), store)
    assert source.load(spark, store, "p").first().content == "x = 2" and source.load(spark, store).count() == 1
    graph_of = stored(spark, store, "p", "import")
    assert [r.path for r in graph_of["files"].collect()] == ["src/a.py"] and graph_of["tree"].count() == 2
    assert source.load(spark, store, "p").count() == 1 and source.one_file(source.load(spark, store), "p", "src/a.py").count() == 1
    with pytest.raises(ValueError):
        source.one_file(rows, "p", "../x")
    assert source.delete(spark, store, "p") is True and source.delete(spark, store, "p") is False
    assert source.cached(spark, spark.range(3), f"{store}-meta").count() == 3
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        source.cached(spark, spark.range(3).select(F.lit(1) / F.lit(0)), f"{store}-broken")
    source.export_report(spark.range(2), f"{store}-report")
    with zipfile.ZipFile(io.BytesIO(source.report_bundle(spark.range(1), "graph TD"))) as z:
        assert set(z.namelist()) == {"report.json", "diagram.mmd"}
    (tmp_path / "a.log").write_text("ERROR x\nfine\n")
    assert {r.level for r in logs.log_lines(source.log_files(spark, f"{tmp_path}/*.log")).collect()} == {"error", None}
    assert source.sessions(spark.sql("SELECT current_timestamp() - make_interval(0, 0, 0, 0, h) AS ts FROM VALUES (1), (30) AS t(h)")).count() == 1


def test_uploads(spark):
    rows = spark.createDataFrame([("p", "../x/a.py", bytearray(b"1")), ("p", "b.exe", bytearray(b"1"))], "project_id string, path string, content binary")
    assert [r.path for r in source.uploads(rows).collect()] == ["x/a.py"] and [r.path for r in source.uploads(rows, False).collect()] == ["a.py"]
    with pytest.raises(ValueError):
        source.inline(spark, "p", [{"filename": "a"}, {"filename": "a"}])


def test_probe_and_tools(spark):
    assert probes.probes(spark.createDataFrame([("http://127.0.0.1:9/",)], "url string"), 0.5).first().status == "down"
    assert probes.external_lint(project(spark, {"a.py": "x"}), "pylint").count() >= 0
    assert probes.capabilities(spark).where("name = 'pyspark'").first().available and probes.languages(spark).count() == 5


def test_scores_and_renderers(spark):
    assert one(spark, rollup.security_score(F.col("h"), F.col("m"), F.col("l")), h=1, m=1, l=1) == 79
    assert one(spark, rollup.quality_score(F.col("s"), F.col("n"), F.col("d")), s=1, n=1, d=10) == 60
    assert one(spark, rollup.complexity_score(F.col("a")), a=7.5) == 80
    assert one(spark, rollup.architecture_score(F.col("c"), F.col("k"), F.col("f")), c=1, k=1, f=10) == 75
    scores = spark.createDataFrame([("p", 90, 60, 10, 80)], "project_id string, security long, quality long, complexity long, architecture long")
    assert {r.card: r.tier for r in render.health_cards(scores).collect()} == {"security": "ok", "quality": "warn", "complexity": "err", "architecture": "ok"}


@pytest.mark.parametrize(
    ("column", "values", "said"),
    [
        (lambda: text.human_lines(F.col("n")), {"n": 1_500_000}, "1.5M"), (lambda: text.human_lines(F.col("n")), {"n": 2600}, "3K"), (lambda: text.human_lines(F.col("n")), {"n": 999}, "999"),
        (lambda: text.preview(F.col("s")), {"s": " " + "a" * 71}, "a" * 70 + "…"), (lambda: text.html_escape(F.col("s")), {"s": "<a & b>"}, "&lt;a &amp; b&gt;"),
        (lambda: text.line_of(F.col("s"), F.col("n")), {"s": "a\nb\nc", "n": 5}, 3), (lambda: text.is_identifier(F.col("s")), {"s": "a_1"}, True), (lambda: text.is_identifier(F.col("s")), {"s": "1a"}, False),
        (lambda: text.project_name(F.col("a"), F.col("b"), F.lit("id")), {"a": " ", "b": " kept "}, "kept"), (lambda: text.suffix_loose(F.col("s")), {"s": "Makefile"}, ".makefile"), (lambda: text.is_json(F.col("s")), {"s": "[1"}, False),
        (lambda: text.clock(F.col("t").cast("timestamp")), {"t": "2024-01-02 03:04:05"}, "03:04:05"),
        (lambda: text.ago(F.col("a").cast("timestamp"), F.col("b").cast("timestamp")), {"a": "2024-01-01 00:00:00", "b": "2024-01-01 02:30:00"}, "2h"),
        (lambda: text.ago(F.col("a").cast("timestamp"), F.col("b").cast("timestamp")), {"a": "2024-01-01 00:00:00", "b": "2024-01-03 00:00:00"}, "2d"),
        (lambda: labels.mi_band(F.col("n")), {"n": 41}, "warn"), (lambda: labels.lint_score_band(F.col("n")), {"n": 8}, "ok"), (lambda: labels.issue_count_band(F.col("n")), {"n": 21}, "err"),
        (lambda: labels.smell_severity(F.col("s")), {"s": "shadowed_name"}, "High"), (lambda: labels.smell_severity(F.col("s")), {"s": "large_class"}, "Medium"), (lambda: labels.smell_severity(F.col("s")), {"s": "long_function"}, "Low"),
        (lambda: labels.mapped(F.col("s"), labels.CC_COLOURS), {"s": "high"}, "#ff8a00"), (lambda: labels.big_o_colour(F.col("s")), {"s": "O(n log n)"}, "#ff8a00"), (lambda: labels.big_o_order(F.col("s")), {"s": "O(n^4)"}, -1),
        (lambda: labels.cc_label(F.col("n")), {"n": 8}, "complex"), (lambda: labels.theta_omega(F.col("s"), F.lit(True))[1], {"s": "O(n)"}, "Ω(1)"), (lambda: labels.theta_omega(F.col("s"), F.lit(True))[0], {"s": "O(n)"}, "varies between Ω(1) and O(n)"),
        (lambda: logs.ping_status(F.col("s")), {"s": "Timeout"}, "down"), (lambda: logs.ping_status(F.col("s")), {"s": "refused"}, "warning"),
        (lambda: lint.is_security_issue(), {"message": "use of Eval", "code": "X"}, True),
    ],
)
def test_column_functions(spark, column, values, said):
    assert one(spark, column(), **values) == said


def test_hints_of_each_language(spark):
    deep = "  for (;;) { for (;;) { } }\n"
    files = project(spark, {"a.py": "cdef x\n", "b.py": "w = 'x.wasm'\ndef sort_all(a):\n    for x in a:\n        for y in a: pass\n", "c.c": "int f(int a) {\n  for (;;) {\n  for (;;) {\n } } }\n", "d.js": "function g() {\n" + deep + "}\n"})
    fns = parse.functions(parse.parse_files(files, ["functions"]))
    rows = {(r.path, r.name): r for r in parse.ordered_hints(parse.wasm_hints(fns, files)).collect()}
    assert rows["b.py", "sort_all"].priority == 5 and len(rows["b.py", "sort_all"].reasons) == 2 and rows["b.py", "<module>"].speedup == "N/A"
    assert rows["c.c", "f"].speedup == "2-10x vs JavaScript" and rows["d.js", "g"].speedup == "3-20x for numeric work" and len(rows) == 4
    assert parse.critical_hints(parse.wasm_hints(fns, files)).count() == 2


def test_script_symbols(spark):
    files = project(spark, {"a.ts": "import { z } from '../x/my-lib'\nclass A extends B {}\nconst f = (x) => x;\nf(A)\n#define"})
    parsed = parse.parse_files(files)
    assert {(r.label, r.kind) for r in symbols.ordered_completions(symbols.completions(parsed)).collect()} == {("A", "class"), ("f", "function"), ("my_lib", "import")}
    rows = symbols.ordered_references(symbols.references(parsed).where("name = 'A'"), files).collect()
    assert [(r.line, r.col, r.kind, r.preview) for r in rows] == [(2, 0, "definition", "class A extends B {}"), (2, 6, "use", "class A extends B {}"), (4, 2, "use", "f(A)")]
    assert [r.name for r in parse.named(parse.parse_files(project(spark, {"a.h": "#define N 1\n"})), "macros").collect()] == ["N"]


# A text that breaks each rule.
RULES = {
    "fit_before_split": "s.fit_transform(a)\ntrain_test_split(a)", "split_without_seed": "train_test_split(a)", "kfold_without_seed": "KFold(3)", "torch_without_seed": "import torch", "tensorflow_without_seed": "import tensorflow",
    "numpy_without_seed": "import numpy", "no_validation": "m.fit(a)", "network_not_normalised": "import keras", "backward_without_zero_grad": "import torch\nloss.backward()", "model_without_device": "import torch\nnn.Module",
    "no_early_stopping": "import keras\nmodel.fit(a)", "no_batch_size": "import torch\nDataLoader(a)", "polars_and_pandas": "import polars\npd.read_csv('a')", "many_conversions": "a.to_pandas()\n" * 4,
    "lightgbm_without_early_stopping": "lgb.train(a)", "lightgbm_without_size": "lgb.train(a)", "spacy_unguarded": "spacy.load('a')", "spacy_in_loop": "nlp = spacy\nfor x in a:\n    y = nlp(x)", "many_debug_calls": "ic(a)\n" * 6, "debug_calls": "ic(a)",
    "image_unchecked": "cv2.imread('a')", "capture_not_released": "cv2.VideoCapture(0)", "figure_not_shown": "px.bar(a)", "test_without_p_value": "ttest_ind(a, b)",
}


def test_every_ml_rule(spark):
    files = project(spark, {f"{k}.py": v for k, v in RULES.items()} | {"clean.py": "x = 1"})
    found = ml.issues(files, ml.libraries(parse.imports(parse.parse_files(files, ["imports"])))).collect()
    for rule in RULES:
        assert rule in {r.rule for r in found if r.path == f"{rule}.py"}
    assert len(RULES) == 24 and not [r for r in found if r.path == "clean.py"]


def test_diagrams_of_scripts(spark):
    flow = {r.project_id: r.diagram for r in render.text_flowchart(project(spark, {"a.py": "def f():\n  pass\ndef g(): pass", "b.js": "x"})).collect()}
    assert "    START --> F0\n    F0 --> F1\n    F1 --> END" in flow["a.py"] and "no functions" in flow["b.js"]
    files = project(spark, {"m.py": "pd.read_csv('a')\nm = LSTM()\nm.fit(a)\nm.fit(b)"})
    chain = render.chain_diagram(ml.pipeline(files), ml.models(files)).first().diagram
    assert 'S1["entrenamiento\\n(2x)"]' in chain and "S0 --> S1" in chain and "S1 --> M0" in chain and "S1 --> END" in chain


def test_reports_in_order(spark):
    files = project(spark, {"a.py": "def f(a1, b1, c1, d1, e1, f1):\n    l = 1\n", "b.py": "import a\nimport xml.etree.xml\n"})
    p = Project(files)
    report = p.report()
    assert [r.family for r in report["by_kind"].collect()] == ["structural", "naming"] and report["totals"].first().unused_imports == 2
    assert p.graph("import")["most"].first().max_in_degree == 1 and p.graph("heatmap")["nodes"].first().name == "f" and p.lint()["cards"].count() > 0
    assert {r.name for r in Project(project(spark, {"c.py": "def f():\n    g()\ndef g(): pass\n"})).graph("call")["nodes"].collect()} == {"f", "g"}
    own = parse.imports(parse.parse_files(project(spark, {"c.py": "import a.b\nimport b.a\n"}), ["imports"]))
    assert [r.nodes for r in graph.module_cycles(own).collect()] == [["a", "b"]]
    p.release()


def test_client_lint_status_and_trees(spark):
    assert {r.code for r in lint.client_lint(project(spark, {"a.js": "debugger\n// TODO: x"})).collect()} == {"DEBUG", "TODO"}
    apis = spark.createDataFrame([("u", "ok", None)], "url string, status string, error string")
    issues = spark.createDataFrame([("warning",)], "severity string")
    none = spark.createDataFrame([], "level string")
    assert lint.overall_status(apis, issues, none).first().status == "warning" and lint.overall_status(apis, issues.limit(0), none).first().status == "ok"
    assert logs.cards(apis, "OK").count() == 1 and logs.all_badges(apis, issues, issues).first().files == 1
    a = spark.createDataFrame([("p", "x", 1), ("p", "y", 1)], "project_id string, path string, bytes int")
    assert {(r.path, r.bytes) for r in tree.merged_tree(a, a.where("path = 'x'").withColumn("bytes", F.lit(2))).collect()} == {("x", 2), ("y", 1)}
    assert [r.name for r in tree.ordered_tree(tree.tree(project(spark, {"b.py": "", "A/c.py": ""}))).where("parent = ''").collect()] == ["A", "b.py"]
    scores = spark.createDataFrame([("p", 8.0), ("p", None), ("p", 9.5)], "project_id string, score double")
    assert lint.mean_score(scores).first().score == 8.75 and probes.rating("Your code has been rated at 7.50/10") == 7.5 and probes.lint_scores(project(spark, {"a.py": "x"})).count() >= 0


def test_table_functions(spark):
    tables.register(spark)
    spark.createDataFrame([("a.py", "import os.path as p\ndef f(x):\n    assert x\n"), ("b.py", "def f(:")], "path string, content string").createOrReplaceTempView("code")
    assert [tuple(r) for r in spark.sql("SELECT t.module, t.alias, t.line FROM code, LATERAL code_imports(content) t").collect()] == [("os.path", "p", 1)]
    assert {(r.path, r.code) for r in spark.sql("SELECT t.* FROM code, LATERAL code_lint(content, path) t").collect()} == {("a.py", "W001"), ("a.py", "C001"), ("b.py", "E001")}
    assert [r.name for r in spark.sql("SELECT t.name FROM code, LATERAL code_functions(content) t").collect()] == ["f"]


def test_table_function_of_a_table(spark):
    tables.register(spark)
    rows = [(1, "a.py", "def f(x):\n    assert x\n"), (1, "b.py", "def f(:"), (2, "c.py", None), (1, None, "def f(:")]
    spark.createDataFrame(rows, "part int, path string, content string").createOrReplaceTempView("parts")
    ask = lambda q: [tuple(r) for r in spark.sql(q).collect()]
    got = ask("SELECT * FROM code_lint_of(TABLE(parts) PARTITION BY (part) ORDER BY (path), 'part')")
    assert {r for r in got if r[1] == "a.py"} == {(1, "a.py", "C001", 1, 1, None), (1, "a.py", "W001", 2, 1, None)}
    assert [r[4] for r in got if r[2] == "E001" and r[5] is None] == [1, 2] and {(r[2], r[5]) for r in got if r[5]} == {("C001", 1), ("W001", 1), ("E001", 2)}
    assert ask("SELECT count(*) FROM code_lint_of(TABLE(parts) WITH SINGLE PARTITION)") == [(7,)]
    assert ask("SELECT * FROM code_lint_of(TABLE(SELECT * FROM parts WHERE false) PARTITION BY part)") == []
    for wrong, said in [("TABLE(SELECT path FROM parts)", "no content"), ("'x'", "must be a table"), ("TABLE(parts), 'other'", "no other")]:
        with pytest.raises(Exception, match=said):
            ask(f"SELECT * FROM code_lint_of({wrong})")


def test_smells_and_inheritance_parse_once_and_shuffle_nothing(spark):
    many = "".join(f"    def m{k}(self):\n        self.v{k} = 1\n" for k in range(20))
    texts = {"a.py": f"class A:\n{many}class B(A, x.C, A):\n    pass\ndef f(a, b, c, d, e, g):\n    pass\n", "b.py": "class C(A):\n    pass\n", "c.py": "class :"}
    files = source.inline(spark, "p", [{"filename": n, "content": c} for n, c in texts.items()])
    whole, narrow = parse.parse_files(files), parse.parse_files(files, parse.FUNCTION_SMELL_FACTS + parse.CLASS_SMELL_FACTS)
    for parsed in (whole, narrow):
        smells = parse.structural_smells(parsed)
        assert smells._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
        assert sorted((r.path, r.kind, r["name"], r.message) for r in smells.collect()) == [
            ("a.py", "excessive_parameters", "f", "6 parameters (> 5)"),
            ("a.py", "god_object", "A", "20 methods and 20 attributes (20 and 10)"),
            ("a.py", "large_class", "A", "20 methods, 41 lines (> 15 or > 300)"),
        ]
    edges = parse.inheritance(parse.parse_files(files, parse.INHERITANCE_FACTS))
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    assert [(r.path, r["name"], r.base) for r in edges.collect()] == [("a.py", "B", "A")] * 2
