"""Text operators as pure Column expressions: lines, counts, names, sizes, validation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules

# Line breaks of str.splitlines, white space of str.strip, names and suffixes.
BREAKS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
SPACE = "[\\s\x1c-\x1f\x85\\p{Z}]"
LANGUAGES = {
    ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".c": "c", ".cpp": "cpp", ".h": "c", ".hpp": "cpp", ".java": "java",
    ".go": "go", ".rs": "rust", ".php": "php", ".rb": "ruby", ".sql": "sql", ".md": "markdown", ".json": "json", ".yaml": "yaml",
}


def py_lines(text: Column) -> Column:
    """str.splitlines: no empty line behind the last break."""
    parts = F.split(text, BREAKS)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def count_of(text: Column, piece: str) -> Column:
    """Occurrences of a piece that do not overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))) / len(piece)).cast("long")


def matches(text: Column, pattern: str | Column) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def line_feeds(text: Column) -> Column:
    return count_of(text, "\n")


def line_of(text: Column, position: Column) -> Column:
    """The line of a 1-based position; null position: null."""
    return (line_feeds(F.substring(text, F.lit(1), position - 1)) + 1).cast("int")


def first_line_of(text: Column, pattern: str | Column) -> Column:
    """The line of the first match, or null: by splitting there, as positions of matches are not at hand."""
    return F.when(F.rlike(text, F.lit(pattern)), line_feeds(F.get(F.split(text, pattern, 2), F.lit(0))) + 1)


def source_lines(lines: Column, fallback: bool = False) -> Column:
    """Lines that are neither blank nor comments; the fallback knows block comments as well."""
    marks = r"#|//|/\*|\*" if fallback else "#|//"
    return F.size(F.filter(lines, lambda x: ~is_blank(x) & ~strip(x).rlike(f"^(?:{marks})"))).cast("long")


def short_name(path: Column) -> Column:
    return F.element_at(F.split(F.element_at(F.split(path, "/"), -1), r"\\"), -1)


def safe_id(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9_]", "_")


def suffix(path: Column) -> Column:
    """The lower-case suffix with its dot; hidden files without another dot have none."""
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"[^.](\.[^.]+)$", 1))


def suffix_loose(path: Column) -> Column:
    """What is behind the last dot, dotless names included: the whole name then."""
    return F.concat(F.lit("."), F.lower(F.element_at(F.split(path, r"\."), -1)))


def language(path: Column) -> Column:
    items = [F.lit(x) for pair in LANGUAGES.items() for x in pair]
    return F.coalesce(F.create_map(*items)[suffix(path)], F.lit("plaintext"))


def parser_of(path: Column) -> Column:
    """Which parser takes a file; C headers go to that of C++. Null: unsupported."""
    s = suffix(path)
    return F.when(s == ".py", "python").when(s.isin(".js", ".jsx"), "javascript").when(s.isin(".ts", ".tsx"), "typescript").when(s == ".c", "c").when(s.isin(".cpp", ".cc", ".cxx", ".hpp", ".h"), "cpp")


def human_size(n: Column) -> Column:
    out, value = None, n.cast("double")
    for k, unit in enumerate(("B", "KB", "MB", "GB")):
        text = F.format_string(f"%.1f {unit}", value / 1024**k)
        out = F.when(value < 1024 ** (k + 1), text) if out is None else out.when(value < 1024 ** (k + 1), text)
    return out.otherwise(F.format_string("%.1f TB", value / 1024**4))


def human_lines(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1_000_000)).when(n >= 1000, F.concat(F.round(n / 1000).cast("long").cast("string"), F.lit("K"))).otherwise(n.cast("string"))


def ago(then: Column, now: Column) -> Column:
    minutes = F.floor((F.unix_timestamp(now) - F.unix_timestamp(then)) / 60)
    return F.when(minutes < 1, "<1m").when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m"))).when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h"))).otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit("d")))


def preview(line: Column) -> Column:
    text = strip(line)
    return F.when(F.length(text) > 70, F.concat(F.substring(text, 1, 70), F.lit("…"))).otherwise(text)


def is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def is_credential_name(name: Column) -> Column:
    return F.lower(name).rlike(rules.CREDENTIAL)


def is_placeholder(value: Column) -> Column:
    return strip(value).rlike(rules.PLACEHOLDER)


def is_identifier(text: Column) -> Column:
    return text.rlike("^[a-zA-Z_][a-zA-Z0-9_]*$")


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def clock(at: Column | None = None) -> Column:
    """The session's local time of day, of now if no time is given."""
    return F.date_format(F.current_timestamp() if at is None else at, "HH:mm:ss")


def null_ratio(text: Column) -> Column:
    return count_of(text, "\x00") / F.greatest(F.length(text), F.lit(1))


def brace_balance(text: Column) -> Column:
    return count_of(text, "{") - count_of(text, "}")


def looks_cut_off(text: Column) -> Column:
    return rstrip(text).rlike(r"[:\\,(\[{]$")


def project_name(asked: Column, stored: Column, fallback: Column) -> Column:
    return F.coalesce(F.nullif(strip(asked), F.lit("")), F.nullif(strip(stored), F.lit("")), fallback)


def safe_path(path: Column) -> Column:
    """A relative path without empty, . and .. parts."""
    return F.array_join(F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", ".", "..")), "/")


def validation(path: Column, text: Column, syntax_error: Column) -> dict[str, Column]:
    """What a file's check says; binary files get nothing but that."""
    s, binary = suffix(path), null_ratio(text) > 0.01
    balance, feeds = brace_balance(rstrip(text)), line_feeds(text)
    scripted = s.isin(".ts", ".js") & ~is_blank(text)
    notes = F.array_compact(
        F.array(
            F.when((s == ".py") & looks_cut_off(text), "truncated"),
            F.when(scripted & (balance != 0), F.format_string("unbalanced braces (%+d)", balance)),
            F.when((s == ".py") & syntax_error.isNotNull(), F.concat(F.lit("syntax error: "), syntax_error)),
            F.when(~F.is_valid_utf8(text), "not UTF-8"),
            F.when(feeds > 5000, F.format_string("very long (%d lines)", feeds)),
            F.when(is_blank(text), "empty"),
        )
    )
    return {
        "is_binary": binary,
        "valid": ~binary,
        "encoding_ok": F.is_valid_utf8(text),
        "is_truncated": ~binary & (s == ".py") & looks_cut_off(text),
        "safe_mode": ~binary & (s == ".py") & syntax_error.isNotNull(),
        "warnings": F.when(binary, F.array().cast("array<string>")).otherwise(notes),
        "errors": F.when(binary, F.array(F.lit("binary file"))).otherwise(F.array().cast("array<string>")),
        "size_bytes": F.octet_length(text).cast("long"),
    }


def live_js(text: Column) -> dict[str, Column]:
    # The editor's patterns for JavaScript and TypeScript.
    functions = matches(text, r"\bfunction\s+\w+\s*\(|=>\s*\{|=>\s*[^{]")
    tokens = matches(text, r"\b(if|else|for|while|switch|catch|&&|\|\||\?)\b")
    nested = text.rlike(r"(?s)(?:for|while)\s*\([^)]*\)\s*\{[^{}]*(?:for|while)\s*\(")
    label = F.when(matches(text, r"\b(?:for|while)\s*\(") == 0, "O(1)").when(nested, "O(n²)").otherwise("O(n)")
    return {"functions": functions, "classes": matches(text, r"\bclass\s+\w+"), "imports": matches(text, r"(?m)^import\s+"), "avg_cc": F.round(tokens / F.greatest(functions, F.lit(1)), 1), "max_cc": tokens, "big_o_worst": label}


def live_c(text: Column) -> dict[str, Column]:
    # The editor's patterns for C and C++.
    functions = matches(text, r"\w+\s+\w+\s*\([^)]*\)\s*\{")
    tokens = matches(text, r"\b(if|else|for|while|switch|case|&&|\|\|)\b")
    nested = matches(text, r"(?s)for\s*\(.*\)\s*\{[^}]*for")
    label = F.when(nested >= 2, "O(n²)").when(nested == 1, "O(n)").otherwise("O(1)")
    return {"functions": functions, "classes": matches(text, r"\b(class|struct)\s+\w+"), "imports": matches(text, '#include\\s*[<"]'), "avg_cc": F.round(tokens / F.greatest(functions, F.lit(1)), 1), "max_cc": tokens, "big_o_worst": label}


def live_fallback(text: Column, python: bool) -> dict[str, Column]:
    # The patterns for text that does not parse.
    if python:
        found = matches(text, r"(?m)^\s*(?:async\s+)?def\s+\w+\s*\("), matches(text, r"(?m)^\s*class\s+\w+"), matches(text, r"(?m)^(?:import|from)\s+")
    else:
        found = matches(text, r"\bfunction\s+\w+|\w+\s*=\s*(?:async\s*)?\("), matches(text, r"\bclass\s+\w+"), matches(text, r"(?m)^(?:import|#include|require)\s+")
    return dict(zip(("functions", "classes", "imports"), found, strict=True)) | {"avg_cc": F.lit(0.0), "max_cc": F.lit(0).cast("long"), "big_o_worst": F.lit("?")}
