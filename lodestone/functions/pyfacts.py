"""Facts about Python source text from its syntax tree; no Spark here.

Whatever can be derived from a fact by a plain expression (labels, bands, smells with
a threshold) is left to Columns. A function's facts are about its own body: nested
functions are functions of their own, and only those that stand in class bodies or in
blocks of a module are listed.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from functools import cached_property

LOOPS = (ast.For, ast.AsyncFor, ast.While)
DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
SCOPES = (*DEFS, ast.ClassDef)
TRIES = (ast.Try, ast.TryStar)
COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.GeneratorExp, ast.DictComp)
BLOCKS = (ast.If, *LOOPS, ast.With, ast.AsyncWith, ast.Try)

# Names that the analysers look for.
REGEX_METHODS = {"compile", "match", "fullmatch", "search", "findall", "finditer", "sub", "subn", "split"}
GRAMMAR_NAMES = ("parse", "parser", "grammar", "tokenize", "lexer", "lex_", "ast_")
INDEGREE_NAMES = {"in_degree", "indegree", "in_deg"}
VISITED_NAMES = {"visited", "seen", "explored"}
GROWING_METHODS = {"append", "add", "update", "insert", "extend"}


class _Below(dict):
    """The fields of each type of node that may hold nodes; contexts and operators are told by their parent alone."""

    def __missing__(self, kind: type) -> tuple[str, ...]:
        skipped = {"ctx", "op", "ops", "id", "attr", "kind", "type_comment", "lineno"}
        self[kind] = out = () if kind is ast.Constant else tuple(f for f in kind._fields if f not in skipped)
        return out


BELOW = _Below()


def body_nodes(body: list[ast.stmt]) -> list[ast.AST]:
    """Everything in source order, without the insides of nested functions and classes."""
    out, stack = [], body[::-1]
    while stack:
        node = stack.pop()
        out.append(node)
        if not isinstance(node, SCOPES) and BELOW[type(node)]:
            below = children(node)
            below.reverse()
            stack += below
    return out


def children(node: ast.AST) -> list[ast.AST]:
    out: list[ast.AST] = []
    for name in BELOW[type(node)]:
        value = getattr(node, name, None)
        if value is None:
            continue
        if type(value) is list:
            if value:
                out += [x for x in value if isinstance(x, ast.AST)]
        elif isinstance(value, ast.AST):
            out.append(value)
    return out


def deep(body: list[ast.stmt]) -> list[ast.AST]:
    """Everything, nested functions included, in source order."""
    out, stack = [], body[::-1]
    while stack:
        node = stack.pop()
        out.append(node)
        if BELOW[type(node)]:
            below = children(node)
            below.reverse()
            stack += below
    return out


#: The fields of a statement, or of a part of one, that hold statements.
STATEMENT_LISTS = ("body", "handlers", "orelse", "finalbody", "cases")
#: Types of nodes that hold statements.
HOLDERS = {kind: tuple(f for f in kind._fields if f in STATEMENT_LISTS) for kind in (*SCOPES, ast.If, *LOOPS, ast.With, ast.AsyncWith, *TRIES, ast.ExceptHandler, ast.Match, ast.match_case)}


def statements(body: list[ast.stmt], inside: bool = True) -> list[ast.AST]:
    """The statements among the nodes of `deep`, or of `body_nodes` if not `inside` nested functions and classes, with handlers and cases."""
    out, stack = [], body[::-1]
    while stack:
        node = stack.pop()
        out.append(node)
        held = HOLDERS.get(type(node))
        if held and (inside or not isinstance(node, SCOPES)):
            for name in reversed(held):
                stack += getattr(node, name)[::-1]
    return out


def blocks_of(stmt: ast.stmt) -> list[list[ast.stmt]]:
    """The statement lists inside a compound statement that is no scope and no match."""
    if isinstance(stmt, TRIES):
        return [stmt.body, *(h.body for h in stmt.handlers), stmt.orelse, stmt.finalbody]
    if isinstance(stmt, (ast.If, *LOOPS)):
        return [stmt.body, stmt.orelse]
    return [stmt.body] if isinstance(stmt, (ast.With, ast.AsyncWith)) else []


def dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Name):
        return node.id
    return f"{dotted(node.value)}.{node.attr}" if isinstance(node, ast.Attribute) else "?"


def decorator(node: ast.AST) -> str:
    return decorator(node.func) if isinstance(node, ast.Call) else dotted(node)


def docstring(body: list[ast.stmt]) -> str | None:
    first = body[0] if body else None
    if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
        return first.value.value
    return None


# -- numbers of one function ----------------------------------------------


def decisions(node: ast.AST) -> int:
    """What a node adds to the cyclomatic complexity."""
    if isinstance(node, (ast.If, *LOOPS, ast.IfExp, ast.ExceptHandler)):
        return 1
    if isinstance(node, ast.BoolOp):
        return len(node.values) - 1
    if isinstance(node, ast.comprehension):
        return len(node.ifs)
    return max(0, len(node.cases) - 1) if isinstance(node, ast.Match) else 0


def cyclomatic_light(nodes: list[ast.AST]) -> int:
    """The editor's quick count over all nodes of a function: with, assert and comprehensions count, nested functions too."""
    total = 1
    for node in nodes:
        if isinstance(node, (ast.If, ast.While, ast.For, ast.ExceptHandler, ast.With, ast.Assert, ast.comprehension)):
            total += 1
        elif isinstance(node, ast.BoolOp):
            total += len(node.values) - 1
    return total


def nesting(body: list[ast.stmt], counted: tuple, depth: int = 0) -> int:
    """Deepest nesting of the `counted` statements."""
    most = depth
    for stmt in body:
        inner = depth + isinstance(stmt, counted)
        if isinstance(stmt, ast.TryStar):
            continue
        most = max(most, inner, *(nesting(b, counted, inner) for b in blocks_of(stmt)))
    return most


def leaves_early(body: list[ast.stmt], inside: bool = False) -> bool:
    for stmt in body:
        if inside and isinstance(stmt, (ast.Break, ast.Return)):
            return True
        if any(leaves_early(b, inside or isinstance(stmt, LOOPS)) for b in blocks_of(stmt)):
            return True
    return False


def splits_in_half(nodes: list[ast.AST]) -> bool:
    halving = {ast.FloorDiv: 2, ast.RShift: 1}
    for node in nodes:
        if isinstance(node, ast.BinOp) and isinstance(node.right, ast.Constant) and type(node.right.value) is int and node.right.value == halving.get(type(node.op)):
            return True
    return False


def calls_of(calls: list[ast.Call]) -> list[str]:
    functions = (n.func for n in calls)
    return sorted({f.id if isinstance(f, ast.Name) else f.attr for f in functions if isinstance(f, (ast.Name, ast.Attribute))})


def is_call_of(node: ast.AST | None, name: str) -> bool:
    return isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == name


def self_calls(nodes: list[ast.AST], name: str) -> tuple[int, int]:
    """Calls of the function itself, and those that are returned as they are."""
    return sum(is_call_of(n, name) for n in nodes), sum(isinstance(n, ast.Return) and is_call_of(n.value, name) for n in nodes)


def branch_factor(body: list[ast.stmt], name: str) -> int:
    """Most self-calls that one run can make: branches exclude one another, statements add up."""
    total = 0
    for s in body:
        if isinstance(s, ast.If):
            total += max(branch_factor(s.body, name), branch_factor(s.orelse, name))
        elif isinstance(s, ast.Try):
            total += max([branch_factor(s.body, name), *(branch_factor(h.body, name) for h in s.handlers)]) + branch_factor(s.orelse, name) + branch_factor(s.finalbody, name)
        elif inner := [b for b in blocks_of(s) if not isinstance(s, ast.TryStar)]:
            total += sum(branch_factor(b, name) for b in inner)
        else:
            total += self_calls(deep([s]), name)[0]
    return total


def grows(stmt: ast.stmt) -> bool:
    if isinstance(stmt, ast.Expr):
        return isinstance(stmt.value, ast.Call) and isinstance(stmt.value.func, ast.Attribute) and stmt.value.func.attr in GROWING_METHODS
    if isinstance(stmt, ast.Assign):
        return any(isinstance(t, ast.Subscript) for t in stmt.targets)
    return isinstance(stmt, ast.AugAssign) and isinstance(stmt.target, ast.Subscript)


def growth(body: list[ast.stmt], depth: int = 0) -> int:
    """Deepest loop nesting at which a container grows."""
    most = 0
    for stmt in body:
        inner = depth + isinstance(stmt, LOOPS)
        if isinstance(stmt, ast.TryStar):
            continue
        most = max([most, inner if inner and grows(stmt) else 0, *(growth(b, inner) for b in blocks_of(stmt))])
    return most


def comprehension_depth(node: ast.AST) -> int:
    if isinstance(node, ast.DictComp):
        return 1 + max(comprehension_depth(node.key), comprehension_depth(node.value))
    return 1 + comprehension_depth(node.elt) if isinstance(node, COMPREHENSIONS) else 0


def receivers(calls: list[ast.Call], methods: set[str]) -> set[str]:
    return {n.func.value.id for n in calls if isinstance(n.func, ast.Attribute) and n.func.attr in methods and isinstance(n.func.value, ast.Name)}


def traversal(nodes: list[ast.AST], calls: list[ast.Call], recursive: bool) -> str | None:
    assigned = set()
    for n in nodes:
        targets = n.targets if isinstance(n, ast.Assign) else [n.target] if isinstance(n, ast.AnnAssign) else []
        assigned |= {t.id.lower() for t in targets if isinstance(t, ast.Name)}
    if assigned & INDEGREE_NAMES:
        return "Topological Sort (Kahn's algorithm)"
    if assigned & VISITED_NAMES:
        if receivers(calls, {"popleft"}):
            return "BFS"
        if recursive or receivers(calls, {"append", "pop"}):
            return "DFS"
    return None


def by_type(nodes: list[ast.AST]) -> dict[type, list[ast.AST]]:
    out: dict[type, list[ast.AST]] = {}
    for n in nodes:
        kind = type(n)
        if kind in out:
            out[kind].append(n)
        else:
            out[kind] = [n]
    return out


#: Types of nodes that add to a cyclomatic complexity.
DECIDING = (ast.If, *LOOPS, ast.IfExp, ast.ExceptHandler, ast.BoolOp, ast.comprehension, ast.Match)


def function_facts(f: ast.FunctionDef | ast.AsyncFunctionDef) -> dict:
    nodes = deep(f.body)
    kinds = by_type(nodes)
    of = lambda found, *types: [n for k in types if k in found for n in found[k]]
    own = by_type(body_nodes(f.body)) if any(k in kinds for k in SCOPES) else kinds
    head = by_type(deep([f.args, *f.decorator_list, *([f.returns] if f.returns else [])]))
    calls = of(kinds, ast.Call)
    loops, blocks = any(k in kinds for k in LOOPS), any(k in kinds for k in BLOCKS)
    sites = sum(is_call_of(n, f.name) for n in calls)
    tails = sum(is_call_of(n.value, f.name) for n in of(kinds, ast.Return)) if sites else 0
    recursive, split = sites > 0, splits_in_half(of(kinds, ast.BinOp))
    named = any(k in f.name.lower() for k in GRAMMAR_NAMES)
    counted = (ast.If, ast.While, ast.For, ast.ExceptHandler, ast.With, ast.Assert, ast.comprehension, ast.BoolOp)
    return {
        "name": f.name,
        "line": f.lineno,
        "end_line": f.end_lineno,
        "loc": max(0, f.end_lineno - f.lineno) + 1,
        "args": [a.arg for a in f.args.args],
        "is_async": isinstance(f, ast.AsyncFunctionDef),
        "decorators": [decorator(d) for d in f.decorator_list],
        "docstring": docstring(f.body),
        "returns_annotated": f.returns is not None,
        "complexity": 1 + sum(map(decisions, of(own, *DECIDING))),
        "cc_light": cyclomatic_light([*of(kinds, *counted), *of(head, *counted)]),
        # without a statement that counts there is nothing to look for
        "loop_depth": nesting(f.body, LOOPS) if loops else 0,
        "loop_count": len(of(kinds, ast.For, ast.While)) + len(of(head, ast.For, ast.While)),
        "early_exit": loops and leaves_early(f.body),
        "is_recursive": recursive,
        "is_tail_recursive": recursive and sites == tails,
        "binary_split": split,
        "halves": any(isinstance(n.op, ast.FloorDiv) for n in of(kinds, ast.AugAssign)),
        "dc_factor": branch_factor(f.body, f.name) if recursive and split else 0,
        "growth_depth": max([growth(f.body) if loops else 0, *(comprehension_depth(n) for n in of(kinds, *COMPREHENSIONS))]),
        "block_depth": nesting(f.body, BLOCKS) if blocks else 0,
        "uses_regex": any(isinstance(n.func, ast.Attribute) and n.func.attr in REGEX_METHODS and dotted(n.func.value) == "re" for n in calls),
        "grammar_shaped": named and (recursive or bool(receivers(calls, {"append", "pop"}))),
        "traversal": traversal(of(kinds, ast.Assign, ast.AnnAssign), calls, recursive),
        "calls": calls_of(calls),
    }


def listed_functions(body: list[ast.stmt]) -> Iterator[ast.AST]:
    """Functions of the module, its classes and its blocks; not those inside functions, except or match."""
    for s in body:
        if isinstance(s, DEFS):
            yield s
        elif isinstance(s, ast.ClassDef):
            yield from listed_functions(s.body)
        elif isinstance(s, ast.Try):
            for b in (s.body, s.orelse, s.finalbody):
                yield from listed_functions(b)
        elif not isinstance(s, ast.TryStar):
            for b in blocks_of(s):
                yield from listed_functions(b)


# -- classes and imports ---------------------------------------------------


def class_facts(c: ast.ClassDef) -> dict:
    attributes = set()
    for f in c.body:
        if isinstance(f, ast.FunctionDef):
            for n in statements(f.body, inside=False):
                if isinstance(n, ast.Assign):
                    attributes |= {t.attr for t in n.targets if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self"}
    return {
        "name": c.name,
        "line": c.lineno,
        "end_line": c.end_lineno,
        "loc": max(0, c.end_lineno - c.lineno) + 1,
        "bases": [dotted(b) for b in c.bases],
        "methods": [{"name": f.name, "line": f.lineno, "args": [a.arg for a in f.args.args], "is_async": isinstance(f, ast.AsyncFunctionDef)} for f in c.body if isinstance(f, DEFS)],
        "decorators": [decorator(d) for d in c.decorator_list],
        "docstring": docstring(c.body),
        "attributes": len(attributes),
    }


def import_facts(nodes: list[ast.AST]) -> list[dict]:
    out = []
    for n in nodes:
        if isinstance(n, ast.Import):
            out += [{"module": a.name, "name": None, "alias": a.asname, "type": "import", "line": n.lineno} for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            out += [{"module": n.module or "", "name": a.name, "alias": a.asname, "type": "from_import", "line": n.lineno} for a in n.names]
    return out


# -- statements that data flow through -----------------------------------------


FORMS = {ast.Name: "name", ast.Call: "call", ast.Subscript: "subscript", ast.Attribute: "attribute"}


def parts(e: ast.AST) -> dict:
    """What an expression is made of: names, calls, subscripts and attributes in order; `built` if it joins them to a text."""
    out, stack, first = [], [e], True
    built = False
    while stack:
        x = stack.pop()
        if isinstance(x, ast.BinOp):
            below = [x.left, x.right]
        elif isinstance(x, ast.JoinedStr):
            below = [v.value for v in x.values if isinstance(v, ast.FormattedValue)]
        elif isinstance(x, ast.Call) and isinstance(x.func, ast.Attribute) and x.func.attr == "format":
            below = [*x.args, *(k.value for k in x.keywords)]
        else:
            below = []
            form = FORMS.get(type(x))
            if form:
                out.append({"form": form, "name": dotted(x.func if form == "call" else x.value if form == "subscript" else x)})
            first = False
            continue
        built, first = built or first, False
        stack += below[::-1]
    return {"built": built, "parts": out}


def referred(found: list[dict], last: dict[str, tuple[int, bool]]) -> list[tuple[int, bool]]:
    """Gives the parts that are names what these stand for."""
    out = []
    for p in found:
        if p["form"] == "name" and p["name"] in last:
            p["ref"], p["through"] = last[p["name"]]
            out.append(last[p["name"]])
    return out


def values(nodes: list[ast.AST]) -> tuple[list[dict], dict[str, tuple[int, bool]]]:
    """A function's assignments to names that parts may stand for, in order, and what each name stands for at the end.

    A name stands for its last assignment before (`ref`); where that one only passes a name on, for the
    one that this stands for, and `through` says whether a text is built on the way. Such an assignment
    is no row, nor is one that holds nothing that could have a source.
    """
    out, last = [], {}
    for i, n in enumerate(nodes):
        if isinstance(n, ast.Assign) and (names := [t.id for t in n.targets if isinstance(t, ast.Name)]):
            value = parts(n.value)
            refs = referred(value["parts"], last)
            here = (i, False)
            if all(p["form"] == "name" for p in value["parts"]) and len(refs) < 2:
                here = (refs[0][0], refs[0][1] or value["built"]) if refs else None
            if here == (i, False):
                out.append({"ord": i, "targets": names} | value)
            for name in names:
                if here:
                    last[name] = here
                else:
                    last.pop(name, None)
    return out, last


def assigns(functions: list[tuple[list[dict], dict]]) -> list[dict]:
    """Assignments to names in functions, as `values` tells them: function, order, names, and the parts of the value."""
    return [{"fn": k} | row for k, (rows, _) in enumerate(functions) for row in rows]


def calls_made(functions: list[tuple[ast.AST, list[ast.AST]]], known: list[tuple[list[dict], dict]]) -> list[dict]:
    """Calls in functions: callee as written, what its keywords say, and the parts of its arguments; a name stands for its last assignment of all."""
    out = []
    for k, ((f, nodes), (_, last)) in enumerate(zip(functions, known, strict=True)):
        for i, n in enumerate(nodes):
            if isinstance(n, ast.Call):
                shell = any(x.arg == "shell" and isinstance(x.value, ast.Constant) and x.value.value is True for x in n.keywords)
                loader = next((x.value.attr for x in n.keywords if x.arg == "Loader" and isinstance(x.value, ast.Attribute)), None)
                form = {ast.Name: "name", ast.Attribute: "attribute"}.get(type(n.func), "other")
                args = [parts(x) for x in n.args]
                for x in args:
                    referred(x["parts"], last)
                out.append({"fn": k, "function": f.name, "ord": i, "line": n.lineno, "form": form, "name": dotted(n.func), "shell": shell, "loader": loader, "args": args})
    return out


def literals(nodes: list[ast.AST]) -> list[dict]:
    """Names that a text is assigned to, with the text."""
    out = []
    for n in nodes:
        targets = n.targets if isinstance(n, ast.Assign) else [n.target] if isinstance(n, ast.AnnAssign) and n.value else []
        if targets and isinstance(n.value, ast.Constant) and isinstance(n.value.value, str):
            out += [{"name": t.id, "value": n.value.value, "line": n.lineno} for t in targets if isinstance(t, ast.Name)]
    return out


# -- naming ----------------------------------------------------------------


def bound(target: ast.AST) -> Iterator[ast.Name]:
    if isinstance(target, ast.Name):
        yield target
    elif isinstance(target, (ast.Tuple, ast.List)):
        for e in target.elts:
            yield from bound(e)
    elif isinstance(target, ast.Starred):
        yield from bound(target.value)


def scope_names(f: ast.AST) -> set[str]:
    a = f.args
    names = {x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs, a.vararg, a.kwarg) if x}
    for n in statements(f.body, inside=False):
        targets = n.targets if isinstance(n, ast.Assign) else [n.target] if isinstance(n, (ast.AnnAssign, ast.For, ast.AsyncFor)) else []
        names |= {t.id for t in targets if isinstance(t, ast.Name)}
    return names


def scopes(tree: ast.Module) -> list[dict]:
    """The module and the functions that see one another's names: number, the scope around, the last number inside, name, line, and the names that are bound there."""
    module = {t.id for s in tree.body for t in (s.targets if isinstance(s, ast.Assign) else [s.target] if isinstance(s, ast.AnnAssign) else []) if isinstance(t, ast.Name)}
    out = [{"id": 0, "parent": None, "name": None, "line": 0, "names": sorted(module)}]
    stack = [(s, 0) for s in reversed(tree.body)]
    while stack:
        s, parent = stack.pop()
        if isinstance(s, DEFS):
            out.append({"id": len(out), "parent": parent, "name": s.name, "line": s.lineno, "names": sorted(scope_names(s))})
            below, parent = s.body, len(out) - 1
        elif isinstance(s, ast.ClassDef):
            below = s.body
        else:
            below = [] if isinstance(s, ast.TryStar) else [x for b in blocks_of(s) for x in b]
        stack += [(x, parent) for x in reversed(below)]
    # numbers are given from the outside in, so the scopes inside a scope follow it
    for s in reversed(out):
        s["last"] = max(s["id"], s.get("last", 0))
        if s["parent"] is not None:
            out[s["parent"]]["last"] = max(s["last"], out[s["parent"]].get("last", 0))
    return out


def bindings(nodes: list[ast.AST]) -> list[dict]:
    """Names in source order and how they are bound: by an assignment, a loop, or (`named`) where casing counts."""
    out = []
    for n in nodes:
        if isinstance(n, (ast.For, ast.AsyncFor, ast.comprehension)):
            out += [("loop", x.id, x.lineno) for x in bound(n.target)]
        targets = n.targets if isinstance(n, ast.Assign) else [n.target] if isinstance(n, ast.AnnAssign) else []
        out += [("assign", x.id, x.lineno) for t in targets for x in bound(t)]
        named = [n.name, *(a.arg for a in n.args.args)] if isinstance(n, DEFS) else [t.id for t in targets if isinstance(t, ast.Name)] if isinstance(n, ast.Assign) else []
        out += [("named", name, n.lineno) for name in named]
    return [{"ord": k, "role": role, "name": name, "line": line} for k, (role, name, line) in enumerate(out)]


# -- Halstead and lines ----------------------------------------------------

#: A node's operator; those with operands of their own are in halstead().
OPERATORS = {
    ast.FunctionDef: "def", ast.AsyncFunctionDef: "async def", ast.ClassDef: "class", ast.Return: "return", ast.Delete: "del", ast.Assign: "=", ast.AugAssign: "aug=",
    ast.AnnAssign: "=", ast.For: "for", ast.AsyncFor: "for", ast.While: "while", ast.If: "if", ast.With: "with", ast.AsyncWith: "with", ast.Try: "try", ast.TryStar: "try*",
    ast.Assert: "assert", ast.Import: "import", ast.ImportFrom: "import", ast.Global: "global", ast.Nonlocal: "nonlocal", ast.Pass: "pass", ast.Break: "break",
    ast.Continue: "continue", ast.Match: "match", ast.match_case: "case", ast.NamedExpr: ":=", ast.BinOp: "binop", ast.UnaryOp: "unary", ast.Lambda: "lambda", ast.IfExp: "ifexp",
    ast.Dict: "{}", ast.Set: "{}", ast.ListComp: "[for]", ast.SetComp: "{for}", ast.DictComp: "{k:v for}", ast.GeneratorExp: "(for)", ast.comprehension: "for", ast.Await: "await",
    ast.Yield: "yield", ast.YieldFrom: "yield from", ast.Compare: "compare", ast.Call: "()", ast.Attribute: ".", ast.Subscript: "[]", ast.Starred: "*", ast.List: "[]", ast.Tuple: "()",
    ast.Slice: ":", ast.JoinedStr: "f-string",
}
#: Parts of a node that hold no operators or operands.
UNREAD = {
    ast.FunctionDef: {"args", "decorator_list", "returns", "type_params"}, ast.AsyncFunctionDef: {"args", "decorator_list", "returns", "type_params"}, ast.ClassDef: {"bases", "keywords", "decorator_list", "type_params"},
    ast.AnnAssign: {"annotation"}, ast.With: {"optional_vars"}, ast.Lambda: {"args"}, ast.match_case: {"pattern", "guard"}, ast.withitem: {"optional_vars"}, ast.ExceptHandler: {"type"},
    ast.FormattedValue: {"format_spec"}, ast.Raise: {"exc", "cause"}, ast.Assert: {"msg"},
}


def tokens(tree: ast.Module) -> list[dict]:
    """Operators, operands and logical lines, an entry for each time; constants by type and text."""
    out = [("statement", None)] * logical_lines(tree.body)
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
            out.append(("operator", name))
        if kind is ast.comprehension and node.ifs:
            out += [("operator", "if")] * len(node.ifs)
        if kind in (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef):
            key = node.name
        elif kind is ast.Attribute:
            key = node.attr
        elif kind is ast.Name:
            key = node.id
        elif kind is ast.Constant:
            key = f"{type(node.value).__name__} {node.value!r}"
        else:
            key = None
        if key is not None:
            out.append(("operand", key))
        skipped = UNREAD.get(kind, ())
        for field, value in ast.iter_fields(node):
            if field not in skipped:
                stack += [(c, kind is ast.TryStar) for c in (value if isinstance(value, list) else [value]) if isinstance(c, ast.AST)]
    return [{"kind": kind, "value": value} for kind, value in out]


def logical_lines(body: list[ast.stmt]) -> int:
    holders = (*SCOPES, ast.If, *LOOPS, ast.With, ast.AsyncWith, *TRIES)
    return sum(1 + (logical_lines(s.body) if isinstance(s, holders) else 0) for s in body)


# -- lint and symbols ------------------------------------------------------


def lint(nodes: list[ast.AST]) -> list[dict]:
    out = []
    for n in nodes:
        at = {"line": getattr(n, "lineno", None), "col": getattr(n, "col_offset", 0)}
        if isinstance(n, ast.Assert):
            out.append(at | {"code": "W001", "message": "assert is switched off by -O"})
        elif isinstance(n, ast.ExceptHandler) and n.type is None:
            out.append(at | {"code": "W002", "message": "bare except catches everything"})
        elif isinstance(n, ast.Global):
            out.append(at | {"code": "W003", "message": f"global variable: {', '.join(n.names)}"})
        elif isinstance(n, DEFS) and not (isinstance(n.body[0], ast.Expr) and isinstance(n.body[0].value, ast.Constant)):
            out.append(at | {"code": "C001", "message": f"'{n.name}' has no docstring"})
        elif is_call_of(n, "print"):
            out.append(at | {"code": "C002", "message": "print() instead of logging"})
    return out


def symbols(nodes: list[ast.AST]) -> tuple[list[dict], list[dict]]:
    """Definitions and references, a row each; a query filters them by name."""
    found, refs = [], []
    for n in nodes:
        if isinstance(n, DEFS):
            found.append({"name": n.name, "kind": "method" if n.col_offset else "function", "line": n.lineno, "col": n.col_offset, "label": f"{n.name}({', '.join(a.arg for a in n.args.args)})"})
            refs.append({"name": n.name, "kind": "definition", "line": n.lineno, "col": n.col_offset})
        elif isinstance(n, ast.ClassDef):
            found.append({"name": n.name, "kind": "class", "line": n.lineno, "col": n.col_offset, "label": n.name})
            refs.append({"name": n.name, "kind": "definition", "line": n.lineno, "col": n.col_offset})
        elif isinstance(n, (ast.Assign, ast.AnnAssign)):
            for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                if isinstance(t, ast.Name):
                    found.append({"name": t.id, "kind": "constant" if t.id.isupper() else "variable", "line": n.lineno, "col": t.col_offset, "label": t.id})
        elif isinstance(n, (ast.Import, ast.ImportFrom)):
            found += [{"name": a.asname or a.name.split(".")[0], "kind": "import", "line": n.lineno, "col": n.col_offset, "label": a.asname or a.name} for a in n.names]
        elif isinstance(n, ast.Name):
            refs.append({"name": n.id, "kind": "read", "line": n.lineno, "col": n.col_offset})
        elif isinstance(n, ast.Attribute):
            refs.append({"name": n.attr, "kind": "call", "line": n.end_lineno, "col": n.col_offset})
    return found, refs


def light_function(f: ast.AST) -> dict:
    nodes = list(ast.walk(f))
    return {
        "name": f.name,
        "cc": cyclomatic_light(nodes),
        "loops": sum(isinstance(n, (ast.For, ast.While)) for n in nodes),
        "recursive": any(is_call_of(n, f.name) for n in nodes),
        "halves": any(isinstance(n, ast.AugAssign) and isinstance(n.op, ast.FloorDiv) for n in nodes),
    }


def diagram_calls(functions: list[ast.AST]) -> list[dict]:
    """Calls between the functions of a file, nested ones included, by name; each pair once, as met."""
    names, pairs = {f.name for f in functions}, {}
    for f in functions:
        for n in ast.walk(f):
            callee = {ast.Name: "id", ast.Attribute: "attr"}.get(type(n.func)) if isinstance(n, ast.Call) else None
            if callee and (to := getattr(n.func, callee)) in names and to != f.name:
                pairs[f.name, to] = None
    return [{"caller": a, "callee": b} for a, b in pairs]


class File:
    """A parsed file; what several facts need is made once, and only if one is asked for."""

    def __init__(self, content: str):
        self.content, self.tree = content, ast.parse(content)

    @cached_property
    def nodes(self) -> list[ast.AST]:
        return deep(self.tree.body)

    @cached_property
    def statements(self) -> list[ast.AST]:
        return statements(self.tree.body)

    @cached_property
    def bodies(self) -> list[tuple[ast.AST, list[ast.AST]]]:
        return [(f, body_nodes(f.body)) for f in self.listed]

    @cached_property
    def values(self) -> list[tuple[list[dict], dict]]:
        return [values(nodes) for _, nodes in self.bodies]

    @cached_property
    def walked(self) -> list[ast.AST]:
        return list(ast.walk(self.tree))

    @cached_property
    def listed(self) -> list[ast.AST]:
        return list(listed_functions(self.tree.body))

    @cached_property
    def named(self) -> tuple[list[dict], list[dict]]:
        return symbols(self.walked)


FACTS = {
    "functions": lambda f: [function_facts(x) for x in f.listed],
    "classes": lambda f: [class_facts(n) for n in f.statements if isinstance(n, ast.ClassDef)],
    "imports": lambda f: import_facts(f.statements),
    "assigns": lambda f: assigns(f.values),
    "calls_made": lambda f: calls_made(f.bodies, f.values),
    "literals": lambda f: literals(f.statements),
    "bindings": lambda f: bindings(f.nodes),
    "scopes": lambda f: scopes(f.tree),
    "used_names": lambda f: sorted({n.id for n in f.nodes if isinstance(n, ast.Name)} | {n.attr for n in f.nodes if isinstance(n, ast.Attribute)}),
    "lint": lambda f: lint(f.walked),
    "symbols": lambda f: f.named[0],
    "refs": lambda f: f.named[1],
    "tokens": lambda f: tokens(f.tree),
    "light_functions": lambda f: [light_function(n) for n in f.walked if isinstance(n, DEFS)],
    "diagram_calls": lambda f: diagram_calls([n for n in f.walked if isinstance(n, DEFS)]),
    "light_imports": lambda f: sum(isinstance(n, (ast.Import, ast.ImportFrom)) for n in f.statements),
    "light_classes": lambda f: sum(isinstance(n, ast.ClassDef) for n in f.statements),
}
#: Every whole word of a file, for files without a tree.
WORD = re.compile(r"[^\W\d]\w*")


def parse(content: str, wanted: set[str] | None = None) -> dict:
    """The wanted facts of a file, all if None; a syntax error is a fact as well, and leaves its words as references."""
    try:
        file = File(content)
    except SyntaxError as e:
        failed = {"error": e.msg, "error_line": e.lineno, "error_col": e.offset}
    except (ValueError, RecursionError, MemoryError) as e:
        failed = {"error": str(e) or type(e).__name__}
    else:
        return {"language": "python"} | {k: fact(file) for k, fact in FACTS.items() if wanted is None or k in wanted}
    if wanted is None or "refs" in wanted:
        failed["refs"] = [{"name": m[0], "kind": "use", "line": k, "col": m.start()} for k, line in enumerate(content.splitlines(), 1) for m in WORD.finditer(line)]
    return {"language": "python"} | failed
