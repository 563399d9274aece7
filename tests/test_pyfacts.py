"""Facts of single snippets, with values worked out by hand."""

import ast
import random
import textwrap
import time

import pytest

import plain_cycles as cycles
import plain_facts
import plain_taint
from lodestone.functions import pyfacts, scripts


def facts(code):
    return pyfacts.parse(textwrap.dedent(code))


def only(code):
    return facts(code)["functions"][0]


@pytest.mark.parametrize(
    ("body", "cc"),
    [
        ("return 1", 1),
        ("if a: return 1\n    elif b: return 2\n    return 3", 3),
        ("if a and b or c: return 1", 4),
        ("for x in a:\n        while x: x = 0", 3),
        ("try:\n        pass\n    except A:\n        pass\n    except B:\n        pass", 3),
        ("return [x for x in a if x if not x]", 3),
        ("return 1 if a else 2", 2),
        ("match a:\n        case 1: pass\n        case 2: pass\n        case _: pass", 3),
        ("def g():\n        if a: pass\n    return g", 1),
        ("with a: pass\n    assert b", 1),
    ],
)
def test_cyclomatic(body, cc):
    assert only(f"def f(a, b, c):\n    {body}\n")["complexity"] == cc


def test_light_complexity_counts_more():
    f = only("def f(a):\n    with a: pass\n    assert a\n    def g():\n        if a: pass\n")
    assert (f["complexity"], f["cc_light"]) == (1, 4)


def test_loops_and_early_exit():
    f = only("def f(a):\n    for x in a:\n        if x:\n            for y in x:\n                return y\n")
    assert (f["loop_depth"], f["early_exit"]) == (2, True)
    assert only("def f(a):\n    for x in a: pass\n    return a\n")["early_exit"] is False


def test_merge_sort_and_binary_search():
    m = only("def s(a):\n    h = len(a) // 2\n    x = s(a[:h])\n    y = s(a[h:])\n    return m(x, y)\n")
    assert (m["dc_factor"], m["binary_split"], m["is_recursive"], m["is_tail_recursive"]) == (2, True, True, False)
    b = only("def s(a, k):\n    h = len(a) // 2\n    if k < h:\n        return s(a[:h], k)\n    else:\n        return s(a[h:], k)\n")
    assert (b["dc_factor"], b["is_tail_recursive"]) == (1, True)


@pytest.mark.parametrize(
    ("body", "growth"), [("for x in a: r.append(x)", 1), ("for x in a:\n        for y in x: r[y] = x", 2), ("r = [[y for y in x] for x in a]", 2), ("r.append(a)", 0), ("for x in a: print(x)", 0)]
)
def test_growth(body, growth):
    assert only(f"def f(a, r):\n    {body}\n")["growth_depth"] == growth


def test_block_depth_counts_elif_as_one_more():
    assert only("def f(a):\n    if a: pass\n    elif b: pass\n    elif c: pass\n")["block_depth"] == 3


def test_nested_functions_are_not_listed():
    found = facts("class A:\n    def m(self): pass\nif True:\n    def f():\n        def g(): pass\ntry:\n    pass\nexcept E:\n    def h(): pass\n")
    assert [f["name"] for f in found["functions"]] == ["m", "f"]
    assert {f["name"] for f in found["light_functions"]} == {"m", "f", "g", "h"}


@pytest.mark.parametrize(
    ("body", "cwe"),
    [
        ("n = request.args.get('n')\n    c.execute('x' + n)", ["CWE-89"]),
        ("n = request.args.get('n')\n    c.execute(f'x {n}')", ["CWE-89"]),
        ("n = request.args.get('n')\n    c.execute('x {}'.format(n))", ["CWE-89"]),
        ("n = request.args.get('n')\n    c.execute('x ?', (n,))", []),
        ("n = input()\n    n = 'a'\n    os.system(n)", []),
        ("n = input()\n    os.system(n)", ["CWE-78"]),
        ("n = input()\n    subprocess.run(n)", []),
        ("n = input()\n    subprocess.run(n, shell=True)", ["CWE-78"]),
        ("n = sys.argv[1]\n    open(n)", []),
        ("n = sys.argv[1]\n    open('d/' + n)", ["CWE-22"]),
        ("n = os.environ['A']\n    os.path.join('d', n)", ["CWE-22"]),
        ("yaml.load(x, Loader=yaml.SafeLoader)", []),
        ("yaml.load(x)", ["CWE-502"]),
        ("pickle.loads(x)", ["CWE-502"]),
    ],
)
def test_taint(body, cwe):
    assert [f["cwe"] for f in plain_taint.findings(f"def f(c, x):\n    {body}\n")] == cwe


@pytest.mark.parametrize(("line", "n"), [("api_key = 'abc'", 1), ("api_key = ''", 0), ("api_key = 'xxxx'", 0), ("api_key = '<key>'", 0), ("api_key = '${K}'", 0), ("name = 'abc'", 0), ("pwd: str = 'abc'", 1), ("pwd = other", 0)])
def test_credentials(line, n):
    assert len(plain_taint.findings(line)) == n


def test_naming():
    kinds = lambda code: sorted(r["kind"] for r in plain_facts.naming(ast.parse(code), pyfacts.deep(ast.parse(code).body)))
    assert kinds("x = 1\n") == ["single_letter_name"]
    assert kinds("for i in a: pass\nr = [j for j in a]\n") == ["single_letter_name"]
    assert kinds("def add(a, b): return a + b\n") == []
    assert kinds("one_two = 1\noneTwo = 2\n") == ["inconsistent_casing"]
    assert kinds("total = 1\ndef f():\n    total = 2\n") == ["shadowed_name"]


def test_raw_lines():
    code = '"""a\nb\n"""\n# c\n\nx1 = 1\nif x1:\n    y1 = 2\n'
    assert plain_facts.raw_lines(code, ast.parse(code)) == {"loc": 8, "lloc": 4, "sloc": 4, "comments": 1, "blank": 1, "multi": 2}


def test_halstead_counts():
    assert plain_facts.halstead(ast.parse("total = 1 + 1\n")) == {"distinct_operators": 2, "distinct_operands": 2, "total_operators": 2, "total_operands": 3}


def test_errors_are_facts():
    assert facts("def f(:\n")["error_line"] == 1
    assert facts("x = '\0'")["error"]
    assert facts("")["functions"] == []


def test_classifiers():
    assert only("def f(a):\n    visited = set()\n    q.popleft()\n")["traversal"] == "BFS"
    assert only("def f(a):\n    seen = set()\n    q.pop()\n")["traversal"] == "DFS"
    assert only("def f(a):\n    indegree = {}\n")["traversal"].startswith("Topological")
    assert only("def parse_x(a):\n    return parse_x(a)\n")["grammar_shaped"]
    assert only("def f(a):\n    return re.match('a', a)\n")["uses_regex"]


def test_script_functions():
    js = scripts.parse_js("const even = (n) => n % 2 === 0;\nfunction f(a) {\n  if (a) { return 1 }\n  else if (b) { return 2 }\n}\n", "javascript")
    assert [(f["name"], f["loc"], f["complexity"]) for f in js["functions"]] == [("even", 1, 1), ("f", 4, 3)]
    ts = scripts.parse_js("export interface A {}\ntype B = string;\nexport class C extends A {}\nimport { x } from './y';\n", "typescript")
    assert (ts["interfaces"][0]["name"], ts["types"][0]["name"], ts["classes"][0]["bases"], ts["imports"][0]["module"]) == ("A", "B", ["A"], "./y")
    assert ts["unused_modules"] == [] and ts["exports"] == [{"name": "C", "line": 3}]
    assert scripts.unused_modules([{"module": "a/my-lib.js", "line": 2}, {"module": "b/used", "line": 3}], "from 'a/my-lib.js'; used; used") == [{"name": "a/my-lib.js", "line": 2}]


def test_long_declarations_and_blocks_take_linear_time():
    began = time.perf_counter()
    assert scripts.parse_c("int " + "a* " * 50_000 + ";", "c")["functions"] == []
    assert scripts.parse_js("function f() {\n" + "x\n" * 600 + "}", "javascript")["functions"][0]["loc"] == 500
    assert time.perf_counter() - began < 5


@pytest.mark.parametrize(
    "text",
    ["".join(f"function f{k}(){{if (a) " for k in range(20_000)) + "}" * 20_000, "import" + " " * 50_000, "function f(" * 20_000, "const a = (x" * 20_000 + ")", "function f(x) ;" * 20_000, "/* \n" * 40_000, "a  " * 40_000],
    ids=["nested", "blanks", "unclosed", "constants", "semicolons", "comments", "words"],
)
def test_scripts_are_linear(text):
    """What is on one line, never closed or only white space; the times before were quadratic."""
    began = time.perf_counter()
    js, c = scripts.parse_js(text, "typescript", {"functions", "imports", "unused_modules"}), scripts.parse_c(text, "c")
    assert time.perf_counter() - began < 8
    if text.startswith("function f0"):
        assert len(js["functions"]) == 20_000 and {f["complexity"] for f in js["functions"]} == {20_001} and js["functions"][0]["calls"] is js["functions"][-1]["calls"] and len(js["functions"][0]["calls"]) == 20_001
    assert c["functions"] is not None


def test_functions_inside_functions():
    js = scripts.parse_js("function a(x) {\n  for (;;) { if (x) {} }\n  function b(y) { return c(y) && d\n (y) }\n}\nconst e = (z) =>\n  z ? 1 : 2;\n", "javascript", {"functions"})["functions"]
    assert [(f["name"], f["line"], f["loc"], f["complexity"], f["label"], f["calls"]) for f in js] == [("a", 1, 5, 4, "O(n)", ["a", "b", "c", "d", "for", "if"]), ("b", 3, 2, 2, "O(1)", ["b", "c", "d"]), ("e", 6, 2, 2, "O(1)", [])]


def test_cycles_against_brute_force():
    def brute(pairs):
        out, to = [], {}
        for a, b in pairs:
            if a != b:
                to.setdefault(a, set()).add(b)

        def go(path):
            for x in to.get(path[-1], ()):
                if x == path[0] and len(path) > 1:
                    out.append(path)
                elif x > path[0] and x not in path:
                    go([*path, x])

        for a in to:
            go([a])
        return sorted(out, key=lambda c: (len(c), c))

    rng = random.Random(4)
    for _ in range(400):
        n = rng.randint(2, 8)
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, 20))]
        for most in (1, 20):
            assert cycles.shortest_cycles(pairs, most) == brute(pairs)[:most]
    assert cycles.shortest_cycles([(k, (k + 1) % 500) for k in range(500)], 20) == [list(range(500))]


def test_only_wanted_facts_are_made():
    assert set(pyfacts.parse("import os", {"imports"})) == {"language", "imports"}
    assert set(pyfacts.parse("def f(:", {"refs"})) == {"language", "error", "error_line", "error_col", "refs"}


def test_c():
    c = scripts.parse_c("#include <stdio.h>\n#define N 3\nstruct P { int x; };\nint f(int a) {\n  if (a) { return 1; }\n  return g(a);\n}\n", "c")
    assert (c["functions"][0]["name"], c["functions"][0]["calls"], c["macros"][0]["name"], c["classes"][0]["name"], c["imports"][0]["type"]) == ("f", ["f", "g", "if"], "N", "P", "system_include")


def test_diagram_calls_know_nested_functions():
    code = "def a():\n    def b():\n        c()\n    b()\n    b()\ndef c():\n    x.a()\n    c()\n"
    assert [(e["caller"], e["callee"]) for e in facts(code)["diagram_calls"]] == [("a", "b"), ("a", "c"), ("c", "a"), ("b", "c")]
