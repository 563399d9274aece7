"""Findings of one file, statement by statement: what the joins over statement rows are held against."""

from __future__ import annotations

import ast
import re

from lodestone.functions import rules
from lodestone.functions.pyfacts import body_nodes, deep, dotted, listed_functions

HTTP_ATTRIBUTES = {"args", "form", "values", "json", "GET", "POST", "COOKIES", "headers"}
SHELL_CALLS = {"os.system", "os.popen"}
SUBPROCESS_CALLS = {"call", "run", "Popen", "check_call", "check_output"}
UNSAFE_LOADS = {"pickle.loads", "pickle.load", "marshal.loads"}


def taint_source(e: ast.AST) -> str | None:
    if isinstance(e, ast.Call):
        if isinstance(e.func, ast.Name) and e.func.id in ("input", "raw_input"):
            return "stdin (input())"
        name = dotted(e.func)
        if name in ("os.getenv", "os.environ.get"):
            return "environment variable"
        if name == "request.get_json":
            return "HTTP request"
        if isinstance(e.func, ast.Attribute) and e.func.attr == "get" and dotted(e.func.value).rsplit(".", 1)[-1] in HTTP_ATTRIBUTES:
            return "HTTP request"
        return None
    if isinstance(e, ast.Subscript):
        known = {"sys.argv": "CLI argument", "os.environ": "environment variable"}.get(dotted(e.value))
        return known or ("HTTP request" if isinstance(e.value, ast.Attribute) and e.value.attr in HTTP_ATTRIBUTES else None)
    return "HTTP request" if isinstance(e, ast.Attribute) and e.attr in HTTP_ATTRIBUTES else None


def taint(e: ast.AST, tainted: dict) -> tuple[str, bool] | None:
    """Where an expression's data come from, and whether it is built from them."""
    if direct := taint_source(e):
        return direct, False
    if isinstance(e, ast.Name):
        return tainted.get(e.id)
    parts: list[ast.AST] = []
    if isinstance(e, ast.BinOp):
        parts = [e.left, e.right]
    elif isinstance(e, ast.JoinedStr):
        parts = [v.value for v in e.values if isinstance(v, ast.FormattedValue)]
    elif isinstance(e, ast.Call) and isinstance(e.func, ast.Attribute) and e.func.attr == "format":
        parts = [*e.args, *(k.value for k in e.keywords)]
    found = next((t for p in parts if (t := taint(p, tainted))), None)
    return (found[0], True) if found else None


def finding_of(call: ast.Call, tainted: dict) -> dict | None:
    """At most one finding: SQL, then command, path, deserialisation."""
    name, first = dotted(call.func), call.args[0] if call.args else None
    attribute = call.func.attr if isinstance(call.func, ast.Attribute) else None
    own_taint = taint(first, tainted) if first is not None else None

    def row(cwe, category, source, sink, confidence="High"):
        return {"cwe": cwe, "category": category, "severity": "High", "confidence": confidence, "source": source, "sink": sink}

    if attribute in ("execute", "executemany") and own_taint and own_taint[1]:
        base = dotted(call.func.value)
        return row("CWE-89", "SQL Injection", own_taint[0], f"{attribute}(...)" if base == "?" else f"{base}.{attribute}(...)")
    shell = any(k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True for k in call.keywords)
    if own_taint and (name in SHELL_CALLS or (attribute in SUBPROCESS_CALLS and dotted(call.func.value) == "subprocess" and shell)):
        return row("CWE-78", "Command Injection", own_taint[0], f"{name}(...)")
    if isinstance(call.func, ast.Name) and name == "open" and own_taint and own_taint[1]:
        return row("CWE-22", "Path Traversal", own_taint[0], "open(...)")
    if name == "os.path.join":
        for later in call.args[1:]:
            if t := taint(later, tainted):
                return row("CWE-22", "Path Traversal", t[0], "os.path.join(...)")
    safe = any(k.arg == "Loader" and isinstance(k.value, ast.Attribute) and "SafeLoader" in k.value.attr for k in call.keywords)
    if name in UNSAFE_LOADS or (name == "yaml.load" and not safe):
        source, confidence = (own_taint[0], "High") if own_taint else ("unvalidated deserialization call", "Medium")
        return row("CWE-502", "Insecure Deserialization", source, f"{name}(...)", confidence)
    return None


def function_findings(f: ast.AST) -> list[dict]:
    tainted: dict[str, tuple[str, bool]] = {}
    nodes = body_nodes(f.body)
    for n in nodes:
        if isinstance(n, ast.Assign):
            info = taint(n.value, tainted)
            for t in n.targets:
                if isinstance(t, ast.Name):
                    if info:
                        tainted[t.id] = info
                    else:
                        tainted.pop(t.id, None)
    rows = [found | {"line": n.lineno, "function": f.name} for n in nodes if isinstance(n, ast.Call) and (found := finding_of(n, tainted))]
    return sorted(rows, key=lambda r: r["line"])


def is_placeholder(value: str) -> bool:
    return re.match(rules.PLACEHOLDER, value.strip()) is not None


def credentials(nodes: list[ast.AST]) -> list[dict]:
    out = []
    for n in nodes:
        targets = n.targets if isinstance(n, ast.Assign) else [n.target] if isinstance(n, ast.AnnAssign) and n.value else []
        if targets and isinstance(n.value, ast.Constant) and isinstance(n.value.value, str) and not is_placeholder(n.value.value):
            for t in targets:
                if isinstance(t, ast.Name) and re.search(rules.CREDENTIAL, t.id.lower()):
                    out.append({"cwe": "CWE-798", "category": "Hardcoded Credentials", "severity": "Medium", "confidence": "Medium", "source": f"code literal (`{t.id}`)", "sink": None, "line": n.lineno, "function": None})
    return out


def findings(content: str) -> list[dict]:
    tree = ast.parse(content)
    return sorted([x for g in listed_functions(tree.body) for x in function_findings(g)] + credentials(deep(tree.body)), key=lambda r: r["line"])
