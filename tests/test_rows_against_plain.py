"""Naming smells, Halstead and line counts by joins and Columns, against the same rules node by node."""

import ast
import random

import plain_facts

from lodestone.functions import pyfacts
from lodestone.operators import naming, parse
from lodestone.sources import files as source

NAMES = ["q", "x", "_", "é", "total_count", "otherCount", "Other", "max_Size", "__own", "_a_b", "value", "self", "cls", "fooBar", "a_b_c", "ﬁ", "K"]


def program(rng, depth=0, indent=""):
    out = []
    for _ in range(rng.randint(1, 5)):
        name, other = rng.choice(NAMES), rng.choice(NAMES)
        kind = rng.randint(0, 17)
        body = [program(rng, depth + 1, indent + "  ") if depth < 3 else f"{indent}  pass\n" for _ in range(3)] if 6 <= kind <= 13 else [""] * 3
        out.append(indent + [
            f"{name} = {other} + 1", f"{name}: int = 2", f"{name}, ({other}, *q) = a", f"for {name} in a: {other} = 3", f"r = [{name} for {name} in a if {name} and b or not c]", f"{name} += 'a\\tb'",
            f"def {name}({other}, q=1, *args, K=2, **kw):\n{body[0]}", f"class {name}(a.b):\n{body[0]}", f"if {name} > 1:\n{body[0]}{indent}else:\n{body[1]}", f"try:\n{body[0]}{indent}except A:\n{body[1]}{indent}finally:\n{body[2]}",
            f"async def {name}():\n{body[0]}", f"with a as {name}:\n{body[0]}", f"while {name}:\n{body[0]}", f"try:\n{body[0]}{indent}except* A:\n{body[1]}", f"match {name}:\n{indent}  case 1:\n{indent}    {other} = 1",
            f'{name} = """a\n# b\n\n"""', "# note\n\n   \n", f"lambda {name}: {{1: {other}, 'k': [*a, b[1:2]]}}",
        ][kind])
    return "\n".join(out) + ("\n" if rng.random() < 0.9 else f"\n{indent}pass\n")


def programs():
    rng, out = random.Random(6), []
    while len(out) < 220:
        text = program(rng)
        try:
            ast.parse(text)
        except SyntaxError:
            continue
        out.append(text)
    return [*out, "", "x = 1", "\n\n", '"""open', "q = 1\nq = 2; q = 3\n"]


def inline(spark, texts):
    return source.inline(spark, "p", [{"filename": f"f{k}.py", "content": t} for k, t in enumerate(texts)])


def test_naming(spark):
    texts = [t for t in programs() if t != '"""open']
    found = {}
    for r in sorted(naming.naming_smells(parse.parse_files(inline(spark, texts), naming.FACTS)).collect(), key=lambda r: (r.path, r.smell_ord)):
        found.setdefault(r.path, []).append({"kind": r.kind, "name": r["name"], "line": r.line, "message": r.message})
    expected = {}
    for k, t in enumerate(texts):
        tree = ast.parse(t)
        if rows := plain_facts.naming(tree, pyfacts.deep(tree.body)):
            expected[f"f{k}.py"] = rows
    assert {x["kind"] for f in expected.values() for x in f} == {"single_letter_name", "inconsistent_casing", "shadowed_name"}
    assert found == expected


def test_scopes_fifty_deep(spark):
    n = 50
    text = "\n".join(f"{' ' * k}def f{k}():\n{' ' * (k + 1)}v{k if k < n - 1 else 0} = 1" for k in range(n))
    rows = naming.naming_smells(parse.parse_files(inline(spark, [text]), naming.FACTS)).where("kind = 'shadowed_name'").collect()
    assert [(r["name"], r.line) for r in rows] == [(f"f{n - 1}", 2 * n - 1)]


def test_shadowed_names_need_no_pairs_of_scopes(spark):
    texts = ["total = 1\ndef a():\n  def b():\n    total = 2\ndef c():\n  other = 1\ndef d():\n  other = 2\n", "x = 1\ndef f():\n  y = 2\n"]
    parsed = parse.parse_files(inline(spark, texts), naming.FACTS)
    rows = naming.shadowed(parsed)
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.path, r["name"], r.line) for r in rows.collect()] == [("f0.py", "b", 3)]
    assert [(s.id, s["last"]) for s in parsed.orderBy("path").first().scopes] == [(0, 4), (1, 2), (2, 2), (3, 3), (4, 4)]


def test_metrics(spark):
    texts = programs()
    files = inline(spark, texts)
    rows = {r.path: r.asDict() for r in parse.metrics(files, parse.parse_files(files, parse.METRIC_FACTS)).collect()}
    expected = {}
    for k, t in enumerate(texts):
        if t != '"""open':
            tree = ast.parse(t)
            expected[f"f{k}.py"] = plain_facts.halstead(tree) | plain_facts.raw_lines(t, tree)
    assert {p: {c: r[c] for c in expected[p]} for p, r in rows.items()} == expected
