"""Naming, Halstead and line counts of one file, node by node: what the Columns and joins are held against."""

from __future__ import annotations

import ast
from collections.abc import Iterator

from lodestone.functions.pyfacts import DEFS, OPERATORS, UNREAD, blocks_of, bound, deep, logical_lines, scope_names

CASING_IGNORED = {"self", "cls"}


def casing(name: str) -> str | None:
    core = name.strip("_")
    if name.startswith("__") or len(name) <= 1 or not core:
        return None
    if "_" in core:
        return "snake_case" if core == core.lower() else None
    return "camelCase" if name[0].islower() and name != name.lower() else None


def shadowed(body: list[ast.stmt], outer: set[str]) -> Iterator[dict]:
    for s in body:
        if isinstance(s, DEFS):
            names = scope_names(s)
            if hidden := sorted(names & outer):
                yield {"kind": "shadowed_name", "name": s.name, "line": s.lineno, "message": f"'{hidden[0]}' hides a name of an outer scope"}
            yield from shadowed(s.body, outer | names)
        elif isinstance(s, ast.ClassDef):
            yield from shadowed(s.body, outer)
        elif not isinstance(s, ast.TryStar):
            for b in blocks_of(s):
                yield from shadowed(b, outer)


def naming(tree: ast.Module, nodes: list[ast.AST]) -> list[dict]:
    loops = [n.target for n in nodes if isinstance(n, (ast.For, ast.AsyncFor, ast.comprehension))]
    exempt = {(x.id, x.lineno) for t in loops for x in bound(t)}
    out, seen = [], set()
    for n in nodes:
        for t in n.targets if isinstance(n, ast.Assign) else [n.target] if isinstance(n, ast.AnnAssign) else []:
            for x in bound(t):
                key = (x.id, x.lineno)
                if len(x.id) == 1 and x.id.isalpha() and key not in exempt and key not in seen:
                    seen.add(key)
                    out.append({"kind": "single_letter_name", "name": x.id, "line": x.lineno, "message": f"one-letter variable '{x.id}' outside a loop or comprehension"})
    examples: dict[str, list[str]] = {"snake_case": [], "camelCase": []}
    met = set(CASING_IGNORED)
    for n in nodes:
        names = [n.name, *(a.arg for a in n.args.args)] if isinstance(n, DEFS) else [t.id for t in n.targets if isinstance(t, ast.Name)] if isinstance(n, ast.Assign) else []
        for name in names:
            if name not in met:
                met.add(name)
                if (style := casing(name)) and len(examples[style]) < 3:
                    examples[style].append(name)
    if all(examples.values()):
        out.append({"kind": "inconsistent_casing", "name": "file", "line": 1, "message": f"snake_case ({', '.join(examples['snake_case'])}) beside camelCase ({', '.join(examples['camelCase'])})"})
    module = {t.id for s in tree.body for t in (s.targets if isinstance(s, ast.Assign) else [s.target] if isinstance(s, ast.AnnAssign) else []) if isinstance(t, ast.Name)}
    out += shadowed(tree.body, module)
    return sorted(out, key=lambda r: r["line"])


def halstead(tree: ast.Module) -> dict:
    operators: dict[str, int] = {}
    operands: dict[object, int] = {}
    stack: list[tuple[ast.AST, bool]] = [(s, False) for s in tree.body]
    while stack:
        node, star = stack.pop()
        kind = type(node)
        name = OPERATORS.get(kind)
        if kind is ast.BoolOp:
            name = "and" if isinstance(node.op, ast.And) else "or"
        elif kind is ast.ExceptHandler:
            name = "except*" if star else "except"
        if name:
            operators[name] = operators.get(name, 0) + 1
        if kind is ast.comprehension and node.ifs:
            operators["if"] = operators.get("if", 0) + len(node.ifs)
        if kind in (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef):
            key: object = node.name
        elif kind is ast.Attribute:
            key = node.attr
        elif kind is ast.Name:
            key = node.id
        elif kind is ast.Constant:
            key = (type(node.value).__name__, repr(node.value))
        else:
            key = None
        if key is not None:
            operands[key] = operands.get(key, 0) + 1
        skipped = UNREAD.get(kind, ())
        for field, value in ast.iter_fields(node):
            if field not in skipped:
                stack += [(c, kind is ast.TryStar) for c in (value if isinstance(value, list) else [value]) if isinstance(c, ast.AST)]
    return {"distinct_operators": len(operators), "distinct_operands": len(operands), "total_operators": sum(operators.values()), "total_operands": sum(operands.values())}


def raw_lines(content: str, tree: ast.Module | None) -> dict:
    n = {"loc": 0, "lloc": logical_lines(tree.body) if tree else 0, "sloc": 0, "comments": 0, "blank": 0, "multi": 0}
    lines = content.split("\n")
    if lines and not lines[-1]:
        lines.pop()
    quote = None
    for line in (x.strip() for x in lines):
        n["loc"] += 1
        if quote:
            n["multi"] += 1
            quote = None if quote in line else quote
        elif not line:
            n["blank"] += 1
        elif line.startswith("#"):
            n["comments"] += 1
        else:
            n["sloc"] += 1
            quote = next((q for q in ('"""', "'''") if q in line and q not in line.split(q, 1)[1]), None)
    return n
