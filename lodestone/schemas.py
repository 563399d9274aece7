"""Schemas: one fixed set for all languages; what a language lacks is null or empty."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType(), "strings": T.ArrayType(T.StringType())}


def fields(spec: str, **nested: T.DataType) -> T.StructType:
    """From "name kind, …" and fields of types of their own; no session is needed for it."""
    plain = [T.StructField(name, _KINDS[kind]) for name, kind in (x.split() for x in spec.split(",") if x.strip())]
    return T.StructType([*plain, *(T.StructField(k, v) for k, v in nested.items())])


def rows(struct: T.StructType) -> T.ArrayType:
    return T.ArrayType(struct)


SOURCE_FILE = fields("project_id string, file_ord long, path string, content string")
FUNCTION = fields(
    "name string, line int, end_line int, loc int, args strings, is_async boolean, decorators strings, docstring string, returns_annotated boolean, complexity int, cc_light int, "
    "loop_depth int, loop_count int, early_exit boolean, is_recursive boolean, is_tail_recursive boolean, binary_split boolean, halves boolean, dc_factor int, growth_depth int, "
    "block_depth int, uses_regex boolean, grammar_shaped boolean, traversal string, calls strings, label string"
)
METHOD = fields("name string, line int, args strings, is_async boolean")
CLASS = fields("name string, line int, end_line int, loc int, bases strings, decorators strings, docstring string, attributes int", methods=rows(METHOD))
IMPORT = fields("module string, name string, alias string, type string, line int")
PART = fields("form string, name string, ref int, through boolean")
VALUE = fields("built boolean", parts=rows(PART))
NAMED = fields("name string, line int")
PARSED_FILE = T.StructType(
    [
        *fields("project_id string, file_ord long, path string, language string, error string, error_line int, error_col int").fields,
        *fields(
            "",
            functions=rows(FUNCTION), classes=rows(CLASS), imports=rows(IMPORT),
            bindings=rows(fields("ord int, role string, name string, line int")),
            scopes=rows(fields("id int, parent int, last int, name string, line int, names strings")),
            tokens=rows(fields("kind string, value string")),
            assigns=rows(fields("fn int, ord int, targets strings, built boolean", parts=rows(PART))),
            calls_made=rows(fields("fn int, function string, ord int, line int, form string, name string, shell boolean, loader string", args=rows(VALUE))),
            literals=rows(fields("name string, value string, line int")),
            exports=rows(NAMED), interfaces=rows(NAMED), types=rows(NAMED), macros=rows(NAMED), unused_modules=rows(NAMED),
            lint=rows(fields("code string, line int, col int, message string")),
            symbols=rows(fields("name string, kind string, line int, col int, label string")),
            refs=rows(fields("name string, kind string, line int, col int")),
            diagram_calls=rows(fields("caller string, callee string")),
            light_functions=rows(fields("name string, cc int, loops int, recursive boolean, halves boolean")),
        ).fields,
        *fields("used_names strings, light_imports int, light_classes int").fields,
    ]
)
